"""Benchmark leaks by edit distance: CGK embedding, bit-sampling LSH, exact verification.

A document leaks an item if some run of its words is within max_edits * (the item's
words) word edits of the whole item.  Words are compared as numbers of the
benchmark's vocabulary; all other words are 0.

1. Windows: the q-gram lemma says how many of the item's word triples a window
   within the distance must share.  Only starts with as many benchmark triples ahead go on;
   no leak is lost by this.
2. The CGK random walk reads a window word by word; a random bit of (step, word)
   says whether it moves on.  Windows at a small edit distance get sequences at a small
   Hamming distance.  Items are put into classes of about equal length; windows are
   embedded for each class, in twice as many steps as its items have words.
3. Each repetition draws its own walk and samples a few steps of it; windows and items
   that agree in all of them are candidates.  Repetitions go on until edited copies of
   the items themselves, with edits spread (by other words of the benchmark, or by unknown ones),
   bunched at the head and bunched at the tail, are each found with the wanted recall: first
   copies that all repetitions are tried on, then copies drawn anew, and for both the lower
   bound of the recall must be at the goal.  A class that many repetitions don't bring
   there is searched by the q-gram lemma alone, item by item: that loses nothing.
4. Candidates are verified by the exact edit distance of the item to the best run of
   words around the window.

Items so short that no edit is allowed (up to four words) are looked up as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, slices, written

WORDS = re.compile(r"\w+").findall
SAMPLED = 3
#: A class that needs more repetitions is searched item by item.
MOST_REPEATS = 48
#: Edited copies of a class's items that its repetitions are tried on, for each kind of edits.
TRIALS = 256
#: Standard errors between a recall that was found and the bound that is claimed.
SURE = 2.33
#: Odd multipliers of the hashes.
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LEAKS = "item_id bigint, item_words int, distance int, similarity double, first_word int, n_words int"


def edits_allowed(words: int, share: float) -> int:
    return int(share * words + 1e-9)


def triple_keys(ids: np.ndarray) -> np.ndarray:
    """A hash of each three neighbouring word numbers."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        k = (x[:-2] * K1 ^ x[1:-1]) * K2 ^ x[2:]
        k = k * K1
    return k ^ (k >> np.uint64(29))


def run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring words' hashes."""
    k = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            k = (k ^ words[i : i + len(k)]) * K1
            k ^= k >> np.uint64(29)
    return k


@dataclass
class SizeClass:
    """Items of about equal length and how they are searched."""

    items: list[int]
    #: For each repetition: an odd multiplier for each step, the sampled steps, and the items' keys in order with the items.
    turns: list[np.ndarray] = field(default_factory=list)
    samples: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)
    #: The lower bound of the least recall of all kinds of edits, on copies that hadn't decided anything.
    recall: float = 0.0
    #: If the repetitions don't reach the recall: the items' triples in order, with the items.
    triples: np.ndarray | None = None
    triple_owners: np.ndarray | None = None


@dataclass
class Benchmark:
    """What the tasks need of a block of items."""

    item_ids: list
    words: dict[str, int]
    items: list[np.ndarray]
    share: float
    bitmap: np.ndarray
    classes: list[SizeClass]
    #: A random number for each word number.
    hashes: np.ndarray
    #: For each length of items that allow no edit, their run keys in order with the items.
    exact: dict[int, tuple[np.ndarray, np.ndarray]]


def walk_keys(words: np.ndarray, starts: np.ndarray, turns: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """The sampled steps of the CGK walks from starts, hashed.

    words: the words' hashes.  A step's random bit of a word is the top bit of their hash times the step's multiplier.
    """
    at = starts.copy()
    last = len(words) - 1
    key = np.zeros(len(starts), np.uint64)
    wanted = set(samples.tolist())
    with np.errstate(over="ignore"):
        for step in range(int(samples.max()) + 1):
            word = words[np.minimum(at, last)]
            if step in wanted:
                key = (key ^ word) * K1
                key ^= key >> np.uint64(32)
            at += ((word * turns[step]) >> np.uint64(63)).view(np.int64)
    return key


def _others(n: int, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """n words in place of others: unknown ones (0), or any of the vocabulary, numbers 1 to `vocabulary`."""
    return rng.integers(1, vocabulary + 1, n) if vocabulary else np.zeros(n, np.int64)


def edited_spread(item: np.ndarray, edits: int, rng: np.random.Generator, vocabulary: int = 0) -> np.ndarray:
    """Words replaced, put in and left out, anywhere."""
    words = item.tolist()
    for new in _others(edits, vocabulary, rng).tolist():
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        if kind == 0:
            words[at] = new
        elif kind == 1:
            words.insert(at, new)
        elif len(words) > 1:
            del words[at]
    return np.array(words, np.int64)


def edited_at_head(item: np.ndarray, edits: int, rng: np.random.Generator, vocabulary: int = 0) -> np.ndarray:
    """The first words replaced or missing."""
    return np.concatenate([_others(edits * int(rng.integers(2)), vocabulary, rng), item[edits:]])


def edited_at_tail(item: np.ndarray, edits: int, rng: np.random.Generator, vocabulary: int = 0) -> np.ndarray:
    """The last words replaced or missing."""
    return np.concatenate([item[: len(item) - edits], _others(edits * int(rng.integers(2)), vocabulary, rng)])


#: Each kind of edits that must be found: how, and whether by words of the benchmark.
EDITS = [(edit, known) for edit in (edited_spread, edited_at_head, edited_at_tail) for known in (False, True)]


def surely(found: np.ndarray) -> float:
    """The lower bound of the least recall: found says for each kind and copy whether it was met."""
    n, p = found.shape[1], float(found.mean(axis=1).min())
    # Wilson's bound: it stays below 1 where all were found.
    return (p + SURE**2 / (2 * n) - SURE * (p * (1 - p) / n + SURE**2 / (4 * n * n)) ** 0.5) / (1 + SURE**2 / n)


def prepare(rows: list[tuple], *, share: float = 0.2, recall: float = 0.95, seed: int = 5) -> Benchmark:
    """The block's tables, from (item_id, text) rows.  Items without words are no items."""
    split = [(i, WORDS((t or "").lower())) for i, t in rows]
    split = [(i, w) for i, w in split if w]
    words: dict[str, int] = {}
    items = [np.array([words.setdefault(x, len(words) + 1) for x in w], np.int32) for _, w in split]
    rng = np.random.Generator(np.random.PCG64(seed))
    hashes = rng.integers(0, 1 << 64, len(words) + 1, dtype=np.uint64)
    bitmap = np.zeros(1 << 22, bool)
    exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    order = sorted(range(len(items)), key=lambda i: len(items[i]))
    near = [i for i in order if edits_allowed(len(items[i]), share)]
    for n in {len(items[i]) for i in order} - {len(items[i]) for i in near}:
        owners = np.array([i for i in order if len(items[i]) == n])
        keys = np.concatenate([run_keys(hashes[items[i]], n) for i in owners])
        exact[n] = np.sort(keys), owners[np.argsort(keys, kind="stable")]
    for i in near:
        bitmap[(triple_keys(items[i]) >> np.uint64(42)).astype(np.int64)] = True
    classes = []
    while near:
        longest = max(len(items[near[0]]), int(len(items[near[0]]) * 1.25))
        inside = [i for i in near if len(items[i]) <= longest]
        near = near[len(inside) :]
        classes.append(_size_class(inside, items, hashes, share, recall, rng))
    return Benchmark([i for i, _ in split], words, items, share, bitmap, classes, hashes, exact)


def _laid(texts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, with unknown words between them, and where each begins."""
    pad = np.zeros(gap, np.int64)
    starts = gap + np.cumsum([0, *(len(t) + gap for t in texts[:-1])])
    return np.concatenate([pad, *(x for t in texts for x in (t, pad))]), starts.astype(np.int64)


@dataclass
class Trial:
    """Edited copies of a class's items, laid one after another, and which of them have been met."""

    tried: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    found: np.ndarray

    def meet(self, keys: np.ndarray, turns: np.ndarray, samples: np.ndarray) -> None:
        """Takes a repetition in: keys are those of the class's items in it."""
        met = walk_keys(self.words, self.starts, turns, samples).reshape(len(EDITS), len(self.tried), -1) == keys[self.tried][None, :, None]
        self.found |= met.any(axis=2)


def _trial(inside: list[int], items: list[np.ndarray], hashes: np.ndarray, share: float, rng: np.random.Generator) -> Trial:
    """Copies with as many edits as are allowed: items evenly over the class, each as often as TRIALS lets."""
    widest, steps = edits_allowed(len(items[inside[-1]]), share), 2 * len(items[inside[0]])
    tried = np.linspace(0, len(inside) - 1, TRIALS).round().astype(np.int64)
    vocabulary = len(hashes) - 1
    copies = [edit(items[inside[k]], edits_allowed(len(items[inside[k]]), share), rng, vocabulary if known else 0) for edit, known in EDITS for k in tried]
    edited, begins = _laid(copies, steps + widest)
    starts = (begins[:, None] + np.arange(-widest, widest + 1)).ravel()
    return Trial(tried, hashes[edited], starts, np.zeros((len(EDITS), len(tried)), bool))


def _size_class(inside: list[int], items: list[np.ndarray], hashes: np.ndarray, share: float, recall: float, rng: np.random.Generator) -> SizeClass:
    out, steps = SizeClass(inside), 2 * len(items[inside[0]])
    originals, at = _laid([items[i] for i in inside], steps)
    original_words = hashes[originals]
    trial, every = _trial(inside, items, hashes, share, rng), []
    for _ in range(MOST_REPEATS):
        turns = rng.integers(0, 1 << 64, steps, dtype=np.uint64) | np.uint64(1)
        samples = np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False))
        keys = walk_keys(original_words, at, turns, samples)
        by_key = np.argsort(keys, kind="stable")
        out.turns.append(turns)
        out.samples.append(samples)
        out.keys.append(keys[by_key])
        out.owners.append(np.asarray(inside)[by_key])
        every.append((keys, turns, samples))
        trial.meet(*every[-1])
        if surely(trial.found) >= recall:
            # These copies have decided when to stop: others judge, and are what the next repetitions are tried on.
            trial = _trial(inside, items, hashes, share, rng)
            for repetition in every:
                trial.meet(*repetition)
            out.recall = surely(trial.found)
            if out.recall >= recall:
                return out
    pairs = np.unique(np.concatenate([np.stack([triple_keys(items[i]), np.full(len(items[i]) - 2, i, np.uint64)]) for i in inside], axis=1), axis=1)
    out.triples, out.triple_owners, out.recall = pairs[0], pairs[1].astype(np.int64), 1.0
    return out


def best_run(item: np.ndarray, ids: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, end) of the run of ids nearest to item in word edits; the first and shortest of several."""
    ramp = np.arange(len(ids) + 1)
    row = np.zeros(len(ids) + 1, np.int64)
    for i, word in enumerate(item.tolist(), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (ids != word), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    distance = int(row[end])
    # The same backwards from there gives the beginning.
    back, ramp = ids[:end][::-1], np.arange(end + 1)
    row = ramp.copy()
    for i, word in enumerate(item[::-1].tolist(), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (back != word), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - ramp) + ramp
    return distance, end - int(row.argmin()), end


def leaks_in(texts: list[str | None], bench: Benchmark) -> Iterator[tuple]:
    """(number of the text, item_id, item_words, distance, similarity, first_word, n_words) of each text and item it leaks."""
    if not bench.items:
        return
    longest = max(map(len, bench.items))
    gap = longest + edits_allowed(longest, bench.share) + 3
    known, pieces, begins, at = bench.words.get, [], [], 0
    for t in texts:
        begins.append(at)
        found = list(map(known, WORDS((t or "").lower()), repeat(0)))
        pieces.append(np.array(found, np.int64))
        pieces.append(np.zeros(gap, np.int64))
        at += len(found) + gap
    ids, begins_at = np.concatenate(pieces), np.array(begins)
    best: dict[tuple[int, int], tuple] = {}
    _look_up(ids, begins_at, bench, best)
    for cell in sorted(set(_candidates(ids, begins_at, bench))):
        _verify(bench, begins, cell, best, pieces)
    for (text, i), (distance, first, end) in sorted(best.items()):
        size = len(bench.items[i])
        yield text, bench.item_ids[i], size, distance, 1 - distance / size, first, end - first


def _look_up(ids: np.ndarray, begins_at: np.ndarray, bench: Benchmark, best: dict) -> None:
    """Puts the first place of each item that allows no edit into best."""
    for n, (keys, owners) in bench.exact.items():
        runs = run_keys(bench.hashes[ids], n)
        low, high = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
        for at in np.flatnonzero(high > low).tolist():
            text = int(np.searchsorted(begins_at, at, "right")) - 1
            for i in owners[low[at] : high[at]].tolist():
                if (text, i) not in best and np.array_equal(ids[at : at + n], bench.items[i]):
                    first = at - int(begins_at[text])
                    best[text, i] = 0, first, first + n


def _candidates(ids: np.ndarray, begins_at: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int, int, int]]:
    """(item, text, part, back): what to verify around the part-th stretch of the item's length, from `back` words before it."""
    triples = triple_keys(ids)
    hit = bench.bitmap[(triples >> np.uint64(42)).astype(np.int64)]
    hit &= (ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)
    words = bench.hashes[ids]
    before = np.concatenate([[0], np.cumsum(hit)])
    text_at = lambda place: int(np.searchsorted(begins_at, place, "right")) - 1
    for c in bench.classes:
        if c.triples is not None:
            for i, place in _sharing(c, ids, triples, hit, bench):
                size = len(bench.items[i])
                yield i, text_at(place), place // size, size + 2 * edits_allowed(size, bench.share)
            continue
        lengths = sorted({len(bench.items[i]) for i in c.items})
        ahead = lengths[-1] + edits_allowed(lengths[-1], bench.share) - 2
        need = min(_triples_needed(n, bench.share) for n in lengths)
        reach = np.minimum(np.arange(len(hit)) + ahead, len(hit))
        starts = np.flatnonzero(before[reach] - before[:-1] >= need)
        for r in range(len(c.keys) if len(starts) else 0):
            keys = walk_keys(words, starts, c.turns[r], c.samples[r])
            low, high = np.searchsorted(c.keys[r], keys, "left"), np.searchsorted(c.keys[r], keys, "right")
            for n in np.flatnonzero(high > low):
                for i in c.owners[r][low[n] : high[n]].tolist():
                    size = len(bench.items[i])
                    yield i, text_at(starts[n]), int(starts[n]) // size, edits_allowed(size, bench.share)


def _sharing(c: SizeClass, ids: np.ndarray, triples: np.ndarray, hit: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int]]:
    """(item, place) wherever a window from place shares as many triples with the item as the q-gram lemma asks for."""
    places = np.flatnonzero(hit)
    low, high = np.searchsorted(c.triples, triples[places], "left"), np.searchsorted(c.triples, triples[places], "right")
    number = high - low
    each = np.repeat(np.arange(len(places)), number)
    owner = c.triple_owners[np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number) + low[each]]
    order = np.lexsort((places[each], owner))
    owner, place = owner[order], places[each][order]
    for i in c.items:
        size = len(bench.items[i])
        need = _triples_needed(size, bench.share)
        if need <= 0:  # every stretch
            yield from ((i, at) for at in range(0, len(ids), size))
            continue
        own = place[np.searchsorted(owner, i, "left") : np.searchsorted(owner, i, "right")]
        if len(own) >= need:
            near = own[need - 1 :] - own[: len(own) - need + 1] < size + edits_allowed(size, bench.share) - 2
            yield from ((i, at) for at in own[: len(own) - need + 1][near].tolist())


def _triples_needed(words: int, share: float) -> int:
    return max(0, words - 2 - 3 * edits_allowed(words, share))


def _verify(bench: Benchmark, begins: list[int], cell: tuple[int, int, int, int], best: dict, pieces: list[np.ndarray]) -> None:
    i, text, part, back = cell
    item, begin = bench.items[i], begins[text]
    size, allowed = len(item), edits_allowed(len(item), bench.share)
    first = max(0, part * size - begin - back)
    run = pieces[2 * text][first : max(0, part * size - begin + 2 * (size + allowed))]
    distance, a, b = best_run(item, run)
    if distance <= allowed and (distance, first + a) < best.get((text, i), (allowed + 1, 0))[:2]:
        best[text, i] = distance, first + a, first + b


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about block_bytes of text, one after another: the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield sorted(map(tuple, (rows if n == 1 else rows.where(part == b)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def _leaks_of(docs: DataFrame, bench: Benchmark) -> tuple[DataFrame, Broadcast]:
    """The leaks of a block's items, and what was sent to the tasks for it."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(bench), docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            found = list(leaks_in(batch.column(1).to_pylist(), sent.value))
            if found:
                n, *columns = zip(*found, strict=True)
                types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(n)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(c.split()[0] for c in LEAKS.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, {LEAKS}"), sent


def _by_block(docs: DataFrame, benchmark: DataFrame, share: float, recall: float, block_bytes: int, step: Callable[[DataFrame, Benchmark], tuple[DataFrame, Broadcast]]) -> Iterator[DataFrame]:
    """step's rows for each block of the benchmark.

    Of several blocks each one's rows are written before the next is made, and what was sent for it is given up: neither
    the driver nor a task ever holds two.
    """
    blocks = blocks_of(benchmark, block_bytes)
    rows, following = next(blocks), next(blocks, None)
    if following is None:
        yield step(docs, prepare(rows, share=share, recall=recall))[0]
        return
    while rows is not None:
        found, sent = step(docs, prepare(rows, share=share, recall=recall))
        yield written(found, "leaks")
        sent.destroy()
        rows, following = following, next(blocks, None)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.2, recall: float = 0.95, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id and where.

    first_word and n_words give the run of words (of letters, digits and underscores,
    in lower case) that is nearest to the item, distance its word edits.  Null and
    empty texts leak nothing, items without words are never leaked, and items of up to four
    words are leaked by the same words only.  Null ids stay null; repeated rows are
    reported each.  The benchmark is taken in blocks of
    block_bytes, each broadcast with its tables, some six times as large; documents aren't shuffled, and
    are read once for each block.
    """
    return reduce(DataFrame.unionByName, _by_block(docs, benchmark, share, recall, block_bytes, _leaks_of))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.2, recall: float = 0.95, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""

    def kept(rows: DataFrame, bench: Benchmark) -> tuple[DataFrame, Broadcast]:
        sent = rows.sparkSession.sparkContext.broadcast(bench)
        return rows.where(_clean(sent)("text")), sent

    def leaking(rows: DataFrame, bench: Benchmark) -> tuple[DataFrame, Broadcast]:
        sent = rows.sparkSession.sparkContext.broadcast(bench)
        marks = rows.where(~_clean(sent)("text")).select(*(c.alias(n) for c, n in zip(mark, names, strict=True)))
        return marks, sent

    # A document's text alone says whether it leaks: its hash of 128 bits stands for it.
    names = [free_name(docs, "leak_one"), free_name(docs, "leak_two")]
    mark = [F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])]
    blocks = blocks_of(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return kept(docs, prepare(first, share=share, recall=recall))[0]
    found = reduce(DataFrame.unionByName, _by_block(docs, benchmark, share, recall, block_bytes, leaking)).distinct()
    return docs.join(found, (mark[0] == found[names[0]]) & (mark[1] == found[names[1]]), "left_anti")


def _clean(sent):
    """A pandas UDF: whether a text leaks no item of the broadcast block."""

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            kept = np.ones(len(series), bool)
            for first in range(0, len(series), 256):
                for n, *_ in leaks_in(series.iloc[first : first + 256].tolist(), sent.value):
                    kept[first + n] = False
            yield pd.Series(kept)

    return clean
