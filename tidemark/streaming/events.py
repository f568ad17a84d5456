"""Streaming forms: events without repeats, retry state, traces, and the processing of new runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.runs import process_runs_idempotent
from tidemark.schemas import MANIFEST

RETRY = "request_id string, attempts long, first_failed_at timestamp, last_failed_at timestamp, last_error_type string, last_error_message string, changed_at timestamp"
RETRY_STATE = "attempts long, first_failed_at timestamp, last_failed_at timestamp, last_error_type string, last_error_message string"


def dedupe_stream(events: DataFrame, late: str = "1 day", time: str = "occurred_at") -> DataFrame:
    """Each event id once, as long as its repeats come within `late` of it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])


def retry_state_stream(outcomes: DataFrame) -> DataFrame:
    """The retry state of a request after each batch that has outcomes of it (request_id, at, ok, error_type, error_message).

    attempts is 0 after a success, and nothing is kept of the request then.  Outcomes of a request must come in batches in
    their order; within a batch they are sorted.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, first, last, kind, message = state.get if state.exists else (0, None, None, None, None)
        rows = pd.concat(batches).sort_values(["at", "ok"], kind="stable")
        for at, ok, error_type, error_message in rows[["at", "ok", "error_type", "error_message"]].itertuples(index=False):
            if ok:
                attempts, first, last, kind, message = 0, None, None, None, None
            else:
                attempts, first, last, kind, message = attempts + 1, first or at, at, error_type, error_message
        if attempts:
            state.update((attempts, first, last, kind, message))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({
            "request_id": [key[0]], "attempts": [attempts], "first_failed_at": pd.to_datetime(pd.Series([first])), "last_failed_at": pd.to_datetime(pd.Series([last])),
            "last_error_type": [kind], "last_error_message": [message], "changed_at": [rows["at"].max()],
        })

    return outcomes.groupBy("request_id").applyInPandasWithState(fold, RETRY, RETRY_STATE, "update", GroupStateTimeout.NoTimeout)


def trace_stream(requests: DataFrame, completions: DataFrame, late: str = "1 day", within: str = "7 days") -> DataFrame:
    """Requests with their completions while both streams run: (request_event_id, requested_at) and (for_request, ingested_at).

    A completion further than `within` from its request isn't joined; a request without one
    comes out when that time is over.
    """
    a = requests.withWatermark("requested_at", late)
    b = completions.withWatermark("ingested_at", late)
    near = F.expr(f"for_request = request_event_id and ingested_at >= requested_at - interval {within} and ingested_at <= requested_at + interval {within}")
    return a.join(b, near, "leftOuter")


def _plain_time(column: str) -> Column:
    """A time that no watermark belongs to: a stream can have one only."""
    return F.timestamp_micros(F.unix_micros(column)).alias(column)


def pipeline_trace_stream(requests: DataFrame, ingested: DataFrame, processed: DataFrame, *, within: str = "7 days", late: str = "1 day") -> DataFrame:
    """Each request with its ingestion and its processing while all three streams run.

    requests: request_event_id, requested_at; ingested: ingestion_event_id, for_request, ingested_at; processed:
    processing_event_id, for_ingestion, processed_at.  Each step is joined if it is at most
    `within` before or behind the one it names.  A whole trace comes out at once; a request whose ingestion or
    processing is missing (null) comes out when its time is over: when all
    streams are three times `within` and `late` beyond it.
    """
    led = trace_stream(requests, ingested, late, within)
    led = led.select("request_event_id", "requested_at", "ingestion_event_id", _plain_time("ingested_at"))
    near = F.expr(
        f"for_ingestion = ingestion_event_id and processed_at >= ingested_at - interval {within} and processed_at <= ingested_at + interval {within} "
        # What follows from these; said of the request, it tells Spark when a row's time is over, also where nothing was ingested.
        # (In brackets: of intervals one after another Spark sees the last when it decides how long to wait.)
        f"and processed_at >= requested_at - (interval {within} + interval {within}) and processed_at <= requested_at + (interval {within} + interval {within})"
    )
    traced = led.join(processed.withWatermark("processed_at", late), near, "leftOuter")
    return traced.select("request_event_id", "ingestion_event_id", "processing_event_id", _plain_time("requested_at"), "ingested_at", _plain_time("processed_at"))


# Times are microseconds here: plain numbers, in every time zone of a worker.
ATTEMPTS = "request_id string, attempts long, first_failed_at long, last_failed_at long, last_error_type string, last_error_message string, route string, newly_dead boolean"
FAILURE = "at: bigint, error_type: string, error_message: string"


class RetryProcessor(StatefulProcessor):
    """The retry state of a request from outcomes that come in any order, as long as they aren't late.

    Failures above the watermark are kept one by one, as a success between them may still come;
    those below are summed up (old).  A success is kept until the watermark passes it, in one value with the failures
    since (cleared): each value that is read or written costs a message to Spark and its answer.
    """

    def __init__(self, max_attempts: int):
        self._max = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # has_old: whether there is an old value too, so that it is read only then.
        self._cleared = handle.getValueState("cleared", f"at bigint, failures array<struct<{FAILURE}, n: bigint>>, has_old boolean")
        self._old = handle.getValueState("old", "attempts bigint, first_at bigint, at bigint, error_type string, error_message string")

    def _known(self) -> tuple[int | None, Counter, tuple | None]:
        """The last success, the failures since with their numbers, and the sum of those below the watermark."""
        cleared, failures, has_old = self._cleared.get() if self._cleared.exists() else (None, [], True)
        old = tuple(self._old.get()) if has_old and self._old.exists() else None
        return cleared, Counter({tuple(f)[:3]: f[3] for f in failures}), old

    def _keep(self, cleared: int | None, failures: Counter, has_old: bool) -> None:
        if failures or cleared is not None:
            self._cleared.update((cleared, [(*f, n) for f, n in failures.items()], has_old))
        else:
            self._cleared.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        cleared, failures, old = self._known()
        had_old, newest = old is not None, _newest(cleared, failures)
        was_dead = failures.total() + (old[0] if old else 0) >= self._max
        for row in rows:
            if not row.ok:
                if cleared is None or row.us > cleared:
                    failures[row.us, row.error_type, row.error_message] += 1
            elif cleared is None or row.us > cleared:
                cleared = row.us
                # What is behind it is forgotten as it comes: of a request with many outcomes little is held.
                failures = Counter({f: n for f, n in failures.items() if f[0] > cleared}) if failures else failures
        if old and cleared is not None and old[2] <= cleared:
            old = None
            self._old.clear()
        self._keep(cleared, failures, old is not None)
        # When all that is known is below the watermark, it is summed up or given up.
        now = _newest(cleared, failures)
        if now is not None and now != newest:
            self._handle.registerTimer(now // 1000 + 1)
        attempts = failures.total() + (old[0] if old else 0)
        first = min([f[0] for f in failures] + ([old[1]] if old else []), default=None)
        last = max([*failures, *([old[2:]] if old else [])], key=_latest, default=(None, None, None))
        dead = attempts >= self._max
        route = "dead-letter" if dead else "pending" if attempts else "cleared"
        yield Row(request_id=key[0], attempts=attempts, first_failed_at=first, last_failed_at=last[0], last_error_type=last[1], last_error_message=last[2], route=route, newly_dead=dead and not was_dead)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        cleared, failures, old = self._known()
        below = {f: n for f, n in failures.items() if f[0] <= watermark}
        if below:
            firsts, lasts = [f[0] for f in below], list(below)
            if old:
                firsts.append(old[1])
                lasts.append(old[2:])
            old = (sum(below.values()) + (old[0] if old else 0), min(firsts), *max(lasts, key=_latest))
            self._old.update(old)
        if below or (cleared is not None and cleared <= watermark):
            self._keep(cleared if cleared is not None and cleared > watermark else None, Counter({f: n for f, n in failures.items() if f not in below}), old is not None)
        return iter(())

    def close(self) -> None:
        pass


def _newest(cleared: int | None, failures: Counter) -> int | None:
    return max([f[0] for f in failures] + ([] if cleared is None else [cleared]), default=None)


def _latest(failure: tuple) -> tuple:
    """The order of failures, of which the last is said: by time, then error, nulls first."""
    return failure[0], *((x is not None, x or "") for x in failure[1:3])


def retry_states(outcomes: DataFrame, *, late: str = "1 day", max_attempts: int = 3) -> DataFrame:
    """The retry state of a request (with its route: pending, dead-letter or cleared) after each batch with outcomes of it (request_id, at, ok, error_type, error_message).

    It is what `retry_state` gives for all outcomes so far, in whatever order they come, if none is later than
    `late`.  newly_dead marks the row with which a request becomes a dead letter.  Of a request that
    succeeded nothing is kept once the watermark has passed its success.  Runs with state
    in RocksDB: see `run_to_table`.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be 1 or above")
    failed = lambda name: F.when(~F.col("ok"), F.col(name)).alias(name)
    rows = outcomes.withWatermark("at", late).select("request_id", "at", F.unix_micros("at").alias("us"), "ok", failed("error_type"), failed("error_message"))
    states = rows.groupBy("request_id").transformWithState(RetryProcessor(max_attempts), ATTEMPTS, "Update", "EventTime")
    times = {n: F.timestamp_micros(n).alias(n) for n in ("first_failed_at", "last_failed_at")}
    return states.select(*(times.get(n, F.col(n)) for n in states.columns))


def dead_letters(states: DataFrame) -> DataFrame:
    """Each request as it becomes a dead letter, once, as long as no success is between."""
    return states.where("newly_dead").drop("route", "newly_dead")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """What is started meanwhile keeps its state in RocksDB, as stateful processors need it."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def process_stream(spark: SparkSession, lake: str, checkpoint: str) -> StreamingQuery:
    """Processes the runs of manifests as they arrive; what a batch has done once isn't done again."""
    manifests = spark.readStream.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{lake}/manifests")

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            process_runs_idempotent(batch.sparkSession, lake)

    return manifests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(query: StreamingQuery) -> None:
    """Waits for the end of a stream over what is there; its failure is raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", *, rocksdb: bool = False) -> DataFrame:
    """Everything that is there now, through the stream, as a table.

    In other modes than append each batch has a directory of its own (column _batch), which
    a batch that is tried again overwrites.
    """
    spark = stream.sparkSession
    with state_in_rocksdb(spark) if rocksdb else nullcontext():
        if mode == "append":
            query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        else:
            query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/_batch_of={n}")).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finished(query)
    if mode == "append":
        return spark.read.parquet(path)
    return spark.read.schema(f"{stream._jdf.schema().toDDL()}, _batch_of bigint").parquet(path).withColumnRenamed("_batch_of", "_batch")
