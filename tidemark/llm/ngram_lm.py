"""Stupid-backoff scores of documents against n-gram counts of the whole corpus.

Counts are tables partitioned by the n-gram's hash; documents are scored by joining
their n-grams with the tables.  To keep both joins small, documents are dealt into
chunks of a few MB by a hash, and a chunk asks for each of its distinct n-grams once:

1. a chunk's distinct n-grams, hashed and with their numbers, go out as one packed row
   for each part of the hash space;
2. a part adds up the numbers of every n-gram over all chunks (the count table) and
   joins its totals to what each chunk asked, in the chunk's order;
3. a chunk meets its totals, scores the words of its documents and sums them.

A row for each chunk and part is what keeps the numbers small: as plain rows (n-gram,
chunk, number) they would be several times as many bytes.  That there is one for each
pair must not make them many, so the sizes of chunks and parts grow with the square root
of the corpus, from 16 GB of text on, up to 16 times (then a task needs about 1.5 GB).  An
n-gram that is in every document comes once from each chunk.

Chunks that could grow no further would make the packed rows grow with the square of the
corpus.  So beyond 4 TB of text (a parameter) the same three steps run on plain rows, which
grow in proportion to it: a chunk writes a row for each of its distinct n-grams, Spark sums
them by n-gram and joins the sums back.  Scores are the same in both forms.

Hashes have as many bits as keep the chance that an n-gram meets another's hash near one in
a million, at every size of the corpus.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, merged_copies, repeated, written

find_words = re.compile(WORD).findall
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of an n-gram's hash beyond those that number all n-grams.
SPARE_BITS = 20
#: Bytes of text from which on chunks and parts grow, and how far.
GROWS_FROM, MOST_GROWTH = 16 << 30, 16
#: How far chunks of plain rows grow: a row takes more memory than its packed form.
MOST_PLAIN_GROWTH = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed: high planes are nearly empty."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes[: max(1, int(values.max(initial=0)).bit_length() + 7 >> 3)].tobytes(), 1)


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


@dataclass(frozen=True)
class ChunkGrams:
    """The n-grams of the texts of a chunk."""

    #: Words of each text.
    lengths: np.ndarray
    #: For each order, the distinct hashes in order, the number of each, and for each word of the
    #: chunk the number of the n-gram that ends there (-1: the text has too few words before it).
    distinct: list[np.ndarray]
    numbers: list[np.ndarray]
    at: list[np.ndarray]


def hash_bits(words: int, order: int) -> int:
    return min(64, (max(1, words) * order).bit_length() + SPARE_BITS)


def grams_of(texts: list[str | None], order: int, bits: int, times: np.ndarray) -> ChunkGrams:
    """times: how often each text counts."""
    found = [find_words(t.lower()) if t else [] for t in texts]
    lengths = np.array([len(w) for w in found], np.int64)
    hashes: dict[str, int] = {}
    for w in found:
        for x in set(w).difference(hashes):
            hashes[x] = xxhash.xxh3_64_intdigest(x)
    get = hashes.__getitem__
    words = np.fromiter((h for w in found for h in map(get, w)), np.uint64, int(lengths.sum()))
    ahead = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight = np.repeat(times, lengths)
    distinct, numbers, at = [], [], []
    gram = mixed(words)
    for o in range(1, order + 1):
        if o > 1:
            longer = np.zeros_like(gram)
            longer[o - 1 :] = mixed(gram[o - 2 : -1] * np.uint64(3) + words[o - 1 :]) if len(gram) >= o else 0
            gram = longer
        whole = ahead >= o - 1
        keys, inverse = np.unique(gram[whole] >> np.uint64(64 - bits), return_inverse=True)
        n = np.bincount(inverse, weight[whole], len(keys)).astype(np.int64)
        where = np.full(len(words), -1, np.int64)
        where[whole] = inverse
        distinct.append(keys)
        numbers.append(n)
        at.append(where)
    return ChunkGrams(lengths, distinct, numbers, at)


def part_bounds(parts: int, bits: int) -> np.ndarray:
    """Where the hash space is cut into parts: the first hash of each."""
    return np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)


def score_chunk(grams: ChunkGrams, totals: list[np.ndarray], corpus_words: int, alpha: float, min_count: int) -> np.ndarray:
    """The log score of each text: the sum over its words."""
    n = int(grams.lengths.sum())
    counts = [np.where(at >= 0, np.append(t, 0)[at], 0).astype(np.float64) for t, at in zip(totals, grams.at, strict=True)]
    score, done, backoffs = np.zeros(n), np.zeros(n, bool), np.zeros(n)
    for o in range(len(counts), 0, -1):
        possible = grams.at[o - 1] >= 0
        kept = possible & ~done & (counts[o - 1] >= (min_count if o > 1 else 1))
        context = np.full(n, float(corpus_words)) if o == 1 else np.concatenate([[1.0], counts[o - 2][:-1]])
        score[kept] = np.log(counts[o - 1][kept] / context[kept]) + backoffs[kept] * math.log(alpha)
        done |= kept
        backoffs[possible & ~done] += 1
    sums = np.concatenate([[0.0], np.cumsum(score)])
    ends = np.cumsum(grams.lengths)
    return sums[ends] - sums[ends - grams.lengths]


def backoff_scores(
    docs: DataFrame, *, order: int = 3, alpha: float = 0.4, min_count: int = 2, chunk_bytes: int = 4 << 20, part_keys: int = 2_000_000,
    packed_up_to: int = GROWS_FROM * MOST_GROWTH**2,
) -> DataFrame:
    """doc_id, n_words, log_score and mean_log of every row of docs.

    Words are runs of anything but ASCII white space, in lower case.  A word's score
    is log(c(its n-gram) / c(its context)) for the longest n-gram up to `order` in its
    text that occurs min_count times in the corpus (words need 1), plus log(alpha)
    for each longer one that doesn't; a single word's is log(c / words of the corpus).
    log_score is the sum, mean_log the mean (null without words).  Null and empty texts
    have 0 words and a score of 0.  Repeated rows count and are scored each; null ids
    stay null; other columns of docs are left out.  Empty tables give empty results.

    packed_up_to: the bytes of text beyond which counts travel as plain rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(WORD))).alias("words")).first()
    words, n_bytes = size.words or 0, size.bytes or 0
    packed = n_bytes <= packed_up_to
    growth = min(MOST_GROWTH if packed else MOST_PLAIN_GROWTH, max(1.0, math.sqrt(n_bytes / GROWS_FROM)))
    chunks = max(1, math.ceil(n_bytes / (chunk_bytes * growth)))
    parts = max(1, math.ceil(words / (part_keys * growth)))
    bits = hash_bits(words, order)
    rows, merged = merged_copies(docs)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def grams(rows: pa.Table) -> ChunkGrams:
        return grams_of(rows.column("text").to_pylist(), order, bits, rows.column("times").to_numpy())

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        found, bounds, out = grams(rows), part_bounds(parts, bits), []
        for o in range(order):
            cuts = [*np.searchsorted(found.distinct[o], bounds).tolist(), len(found.distinct[o])]
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    gaps = np.diff(found.distinct[o][a:b], prepend=bounds[p])
                    out.append((o * parts + p, key[0].as_py(), b - a, pack(gaps), pack(found.numbers[o][a:b])))
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "chunk", "n", "gaps", "numbers"])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        # Gaps count from the part's first hash: that is the same for all cells and needn't be added.
        sizes = rows.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(unpack(g, n), dtype=np.uint64) for g, n in zip(rows.column("gaps").to_pylist(), sizes, strict=True)])
        numbers = np.concatenate([unpack(c, n) for c, n in zip(rows.column("numbers").to_pylist(), sizes, strict=True)])
        order_of = np.argsort(keys, kind="stable")
        keys = keys[order_of]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(numbers[order_of], first)
        totals = np.empty_like(sums, shape=len(keys))
        totals[order_of] = np.repeat(sums, np.diff(first, append=len(keys)))
        ends = np.cumsum(sizes)
        answers = [pack(totals[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
        return pa.Table.from_arrays([rows.column("part"), rows.column("chunk"), rows.column("n"), pa.array(answers, pa.binary())], ["part", "chunk", "n", "totals"])

    def scores_of(rows: pa.Table, found: ChunkGrams, totals: list[np.ndarray]) -> pa.Table:
        logs = score_chunk(found, totals, words, alpha, min_count)
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("times"), pa.array(found.lengths), pa.array(logs)], ["doc_id", "times", "n_words", "log_score"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        found = grams(rows)
        by_order: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(order)]
        for p, n, t in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "totals")), strict=True):
            by_order[p // parts].append((p, unpack(t, n)))
        none = np.zeros(0, np.uint64)
        totals = [np.concatenate([none, *(t for _, t in sorted(cells, key=lambda x: x[0]))]) for cells in by_order]
        return scores_of(rows, found, totals)

    def ask_plainly(key: tuple, rows: pa.Table) -> pa.Table:
        found = grams(rows)
        sizes = [len(d) for d in found.distinct]
        columns = [
            pa.array(np.repeat(np.arange(order, dtype=np.int32), sizes)), pa.array(np.concatenate(found.distinct).view(np.int64)),
            pa.array(np.full(sum(sizes), key[0].as_py(), np.int64)), pa.array(np.concatenate(found.numbers)),
        ]
        return pa.Table.from_arrays(columns, ["gram_order", "gram", "chunk", "n"])

    def score_plainly(rows: pa.Table, answers: pa.Table) -> pa.Table:
        found = grams(rows)
        orders, keys, totals = (answers.column(c).to_numpy() for c in ("gram_order", "gram", "total"))
        # A chunk gets each n-gram that it asked for once, so that in order they are its own.
        in_order = totals[np.lexsort((keys.view(np.uint64), orders))]
        return scores_of(rows, found, np.split(in_order, np.cumsum([len(d) for d in found.distinct])[:-1]))

    result = f"doc_id {kind}, times bigint, n_words bigint, log_score double"
    by_chunk = chunked.groupBy("chunk")
    if packed:
        asked = by_chunk.applyInArrow(ask, "part bigint, chunk bigint, n bigint, gaps binary, numbers binary")
        answered = asked.groupBy("part").applyInArrow(total, "part bigint, chunk bigint, n bigint, totals binary")
        scored = by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(score, result)
    else:
        asked = written(by_chunk.applyInArrow(ask_plainly, "gram_order int, gram bigint, chunk bigint, n bigint"), "asked-grams")
        # An n-gram has a row for each chunk at most, far fewer than a task has.
        counts = asked.groupBy("gram_order", "gram").agg(F.sum("n").alias("total"))
        answered = asked.join(counts, ["gram_order", "gram"]).select("gram_order", "gram", "chunk", "total")
        scored = by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(score_plainly, result)
    every = repeated(scored) if merged else scored.drop("times")
    return every.withColumn("mean_log", F.try_divide(F.col("log_score"), F.col("n_words")))
