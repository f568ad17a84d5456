"""Compression of vectors to codes: a codebook for each part, nearest entries by equal-average search.

Components become integers, floor(scale * x), so that all distances, sums and means are
exact and no result depends on the order of rows.  The entries of a part's codebook are sorted
by the sum of their components.  By the inequality of Cauchy and Schwarz the squared
distance of two parts is at least the squared gap of their sums over their length:
the search begins at a part's own sum and goes outward, to the nearer sum each time, until
the gap's square over the length is strictly above the best distance.  Ties go to the lower
entry, and a tie can't be behind that bound.

The codebooks (parts x entries vectors) are all that the driver holds and tasks are sent.  Each
round reads the vectors where they are; a task sums what it assigns to each entry, and only
these sums are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, written

#: Up to so many different labels their sums are broadcast (some 2 MB); more are joined by shuffle.
FEW_LABELS = 50_000


@dataclass(frozen=True)
class Codebooks:
    """entries: one array (entries, width) of int64 for each part."""

    entries: list[np.ndarray]
    dim: int
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def whole(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    v = F.col(f"`{vector}`") if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, finite), F.lit(False))


def largest_component(dim: int) -> int:
    """Components up to this size keep all distances of vectors within 64 bits."""
    return int((2**60 / max(1, dim)) ** 0.5)


def as_parts(vectors: np.ndarray, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, dim) floats as integers (parts, n, width), and which of the n can be coded.

    Widths are equal: where dim is no multiple of parts, zeros are added at the end.
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * scale)
    fit = (np.abs(scaled) <= largest_component(vectors.shape[1])).all(axis=1)
    scaled[~fit] = 0
    width = -(-vectors.shape[1] // parts)
    padded = np.zeros((len(vectors), parts * width), np.int64)
    padded[:, : vectors.shape[1]] = scaled
    return padded.reshape(len(vectors), parts, width).transpose(1, 0, 2), fit


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point (n, width) the number of the nearest entry, the lowest of several, and the squared distance."""
    n, width, k = len(points), points.shape[1], len(entries)
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sums, own = entries.sum(axis=1)[order], points.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best, found = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    open_ = np.arange(n)
    # Beyond both ends stands a gap that nothing is nearer than.
    far = np.inf
    while len(open_):
        l, r, s = left[open_], right[open_], own[open_]
        gap_left = np.where(l >= 0, s - sums[np.maximum(l, 0)], far)
        gap_right = np.where(r < k, sums[np.minimum(r, k - 1)] - s, far)
        gap = np.minimum(gap_left, gap_right)
        # In floats, and a trifle less than it is: so an equal distance is never taken for a larger one.
        inside = (gap < far) & (gap * gap / width * (1 - 1e-12) <= best[open_])
        at_left = (gap_left <= gap_right)[inside]
        open_ = open_[inside]
        entry = order[np.where(at_left, left[open_], right[open_])]
        difference = points[open_] - entries[entry]
        distance = np.einsum("ij,ij->i", difference, difference)
        better = (distance < best[open_]) | ((distance == best[open_]) & (entry < found[open_]))
        best[open_[better]], found[open_[better]] = distance[better], entry[better]
        left[open_] -= at_left
        right[open_] += ~at_left
    return found, best


def _vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors (m, dim) of a column that are whole and of the length dim, their rows, and which rows are whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten() if column.null_count else column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(there, lengths, 0)
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    kept = there & (bad[ends] == bad[ends - lengths])
    rows = np.flatnonzero(kept & (lengths == dim))
    at = (ends - lengths)[rows][:, None] + np.arange(dim)
    return values[at], rows, kept


def first_codebooks(vectors: DataFrame, *, parts: int, entries: int, scale: int, vector: str, key: str) -> Codebooks | None:
    """The parts of the whole vectors with the smallest keys (null keys last, then by components); None where there is no vector.

    Vectors have the length of the first of these.
    """
    kept = vectors.where(whole(vector) & (F.size(f"`{vector}`") > 0))
    order = [F.col(f"`{key}`").asc_nulls_last(), F.col(f"`{vector}`")]
    first = kept.orderBy(*order).select(vector).first()
    if first is None:
        return None
    dim = len(first[0])
    most = largest_component(dim)
    fits = F.forall(F.col(f"`{vector}`"), lambda x: (x.cast("double") * scale >= -most) & (x.cast("double") * scale < most + 1))
    taken = kept.where((F.size(f"`{vector}`") == dim) & fits).orderBy(*order).select(vector).limit(entries).collect()
    if not taken:
        return None
    by_part, _ = as_parts(np.array([r[0] for r in taken], np.float64), parts, scale)
    return Codebooks([p.copy() for p in by_part], dim, scale)


def refined(vectors: DataFrame, books: Codebooks, vector: str) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry becomes the floor of the mean of its parts."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    width = books.entries[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value.entries
        shape = (len(entries), len(entries[0]))
        totals, counts = np.zeros((*shape, width), np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            found, _, _ = _vectors_of(batch.column(0), sent.value.dim)
            points, fit = as_parts(found, len(entries), sent.value.scale)
            for p, book in enumerate(entries):
                mine = points[p][fit]
                entry, _ = nearest(mine, book)
                np.add.at(totals[p], entry, mine)
                counts[p] += np.bincount(entry, minlength=shape[1])
        part, entry = np.nonzero(counts)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), *(pa.array(totals[part, entry, i]) for i in range(width))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"x{i}" for i in range(width))])

    names = [f"x{i}" for i in range(width)]
    partial = vectors.select(F.col(f"`{vector}`").alias("v")).mapInArrow(sums, "part int, entry int, n bigint, " + ", ".join(f"{x} bigint" for x in names))
    # Sums of 128 bits or so at most: a decimal holds what 64 bits can't.
    wide = lambda x: F.sum(F.col(x).cast("decimal(20,0)"))
    found = partial.groupBy("part", "entry").agg(wide("n").alias("n"), *(wide(x).alias(x) for x in names)).collect()  # parts x entries rows
    sent.unpersist()
    out = [b.copy() for b in books.entries]
    for r in found:
        out[r.part][r.entry] = [int(r[x]) // int(r.n) for x in names]
    return Codebooks(out, books.dim, books.scale)


def train_codebooks(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding", key: str = "vec_id") -> Codebooks | None:
    """Codebooks after so many rounds over all vectors; entries that no part is nearest to stay as they are."""
    books = first_codebooks(vectors, parts=parts, entries=entries, scale=scale, vector=vector, key=key)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books, vector)
    return books


def encoded(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, with code (two hex digits, or as many as an entry needs, for each part) and error.

    The vector column is left out.  code and error are null where a vector can't be coded:
    it has another length than the codebooks', or components above `largest_component`.
    """
    own = [c for c in vectors.columns if c.lower() not in (vector.lower(), "code", "error")]
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in own)
    schema = ", ".join(x for x in (kinds, "code string", "error bigint") if x)
    if books is None:
        return vectors.where(whole(vector)).select(*(F.col(f"`{c}`") for c in own), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    digits = max(2, -(-(len(books.entries[0]) - 1).bit_length() // 4))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            found, rows, kept = _vectors_of(batch.column(0), books.dim)
            points, fit = as_parts(found, len(books.entries), books.scale)
            codes, errors = np.zeros((len(rows), len(books.entries)), np.int64), np.zeros(len(rows), np.int64)
            for p, book in enumerate(books.entries):
                codes[:, p], distance = nearest(points[p], book)
                errors += distance
            texts, far = np.full(batch.num_rows, None, object), np.ones(batch.num_rows, bool)
            far[rows[fit]] = False
            texts[rows] = ["".join(f"{x:0{digits}x}" for x in row) for row in codes.tolist()]
            full = np.zeros(batch.num_rows, np.int64)
            full[rows] = errors
            texts[far] = None
            at = pa.array(np.flatnonzero(kept))
            columns = [batch.column(i) for i in range(1, batch.num_columns)] + [pa.array(texts, pa.string()), pa.array(full, mask=far)]
            yield pa.RecordBatch.from_arrays([c.take(at) for c in columns], [*own, "code", "error"])

    return vectors.select(F.col(f"`{vector}`"), *(F.col(f"`{c}`") for c in own)).mapInArrow(code, schema)


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error: the errors of all rows with the label, null labels together.

    A label that holds much of the rows is summed in the tasks before anything is shuffled.
    The sums of few labels are broadcast, so that no label's rows meet in a task; those of many are joined,
    where Spark splits a label that is much above the others.
    """
    rows = written(coded.drop(*[c for c in coded.columns if c.lower() == "label_error"]), "vector-codes")
    key, total = free_name(rows, "its_label"), "label_error"
    sums = written(rows.groupBy(F.col(f"`{label}`").alias(key)).agg(F.sum("error").alias(total)), "label-errors")
    few = sums.count() <= FEW_LABELS
    return rows.join(F.broadcast(sums) if few else sums, F.col(f"`{label}`").eqNullSafe(F.col(key)), "left").drop(key)


def compressed(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """The rows whose vector is whole, without it: code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped.  Vectors have the length of the
    first kept one that isn't empty; rows with others, or with components that leave no
    room for exact distances (above 2^27 at 64 dimensions, after scaling), stay without code and error.  Null keys come last
    in the choice of the first entries, equal keys by their components; with fewer vectors
    than entries the codebooks are smaller.  Repeated rows count as often as they come.  Columns
    with the names of new ones are replaced.  Empty tables give empty results.
    """
    books = train_codebooks(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale, vector=vector, key=key)
    coded = with_label_errors(encoded(vectors, books, vector), label)
    return coded.withColumn("codebooks_sha256", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()))
