"""Claims on runs: of several processors that work on one lake, one has a run at a time.

A claim is an empty file ``claims/run-<id>/<n>`` that is created only if it isn't there.  Whoever
creates the next number has the run; a claim that is older than the lease is taken to be
a dead processor's, and the next number is free.  Nobody's claim is ever replaced, so two can't both win.
Ages are the file's time against this driver's clock: the lease should be far above the clocks' difference.
"""

from __future__ import annotations

import time
from datetime import timedelta

from tidemark.sources.files import LakeFiles


class Claims:
    def __init__(self, files: LakeFiles, lake: str, lease: timedelta):
        self._files, self._root, self._lease = files, f"{lake}/claims", lease
        self.held: dict[str, int] = {}

    def _folder(self, run: str) -> str:
        return f"{self._root}/run-{run}"

    def _newest(self, run: str) -> tuple[int, int] | None:
        """Number and time (milliseconds) of a run's newest claim."""
        return max(((int(name), at) for name, at in self._files.names(self._folder(run)) if name.isdigit()), default=None)

    def take(self, run: str) -> bool:
        """Claims the run; false if somebody else has it."""
        newest = self._newest(run)
        if newest and time.time() * 1000 - newest[1] < self._lease.total_seconds() * 1000:
            return run in self.held and self.held[run] == newest[0]
        number = newest[0] + 1 if newest else 0
        self._files.make(self._folder(run))
        if not self._files.create(f"{self._folder(run)}/{number:09d}"):
            return False
        self.held[run] = number
        return True

    def lost(self) -> list[str]:
        """The runs that others have claimed since, because the lease was over."""
        newest = {run: self._newest(run) for run in self.held}
        return [run for run, n in self.held.items() if newest[run] is None or newest[run][0] != n]

    def release(self, run: str) -> None:
        """Gives the run up; only this claim's own file goes."""
        number = self.held.pop(run, None)
        if number is not None:
            self._files.delete(f"{self._folder(run)}/{number:09d}")
