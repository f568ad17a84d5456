"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

A byte-level BPE never merges across pre-tokens, so the number of tokens of a text
is the sum of the numbers of its pre-tokens.  The first tier is a compact table of
frequent pre-tokens and their lengths, those of the words that a count over the whole
corpus finds most frequent, broadcast to the workers; pre-tokens that it lacks are encoded by the tokenizer library once and kept in a cache of the worker.
No pre-token is shuffled by itself: for the table each task sends one summary of its most frequent
words, and summaries are merged by sixteen into others of the same size.  Which pre-tokens either tier
holds never changes a count.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, slices, text_or_empty, written

# The pattern by which the byte-level BPE splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that every Unicode version sorts alike into letters, numbers and
#: white space.  A text with any other is left to the library as a whole.
SETTLED = re.compile("[^\x00-ͷΆ-ԯ‐-‧‰-⁞₠-₿぀-ヿ一-龥가-힣]")
#: A longer pre-token is encoded each time it comes, so that the caches stay small.
LONGEST_KEPT = 64


def load_tokenizer(path: str):
    """The library's tokenizer, in one thread: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Lengths(dict):
    """Both tiers; a pre-token that neither holds is encoded and kept in the second."""

    def __init__(self, frequent: dict[str, int], tokenizer, cache_entries: int):
        super().__init__(frequent)
        self.tokenizer, self.cache_entries, self.cache = tokenizer, cache_entries, {}

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= LONGEST_KEPT:
                if len(self.cache) >= self.cache_entries:
                    self.cache.clear()
                self.cache[piece] = n
        return n


class TokenCounter:
    """Counts tokens in one worker."""

    def __init__(self, tokenizer_path: str, frequent: dict[str, int], cache_entries: int):
        self.tokenizer = load_tokenizer(tokenizer_path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = _Lengths(frequent, self.tokenizer, cache_entries)
        self.split = regex.compile(PATTERN).findall

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SETTLED.search(text) or any(a in text for a in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, self.split(text)))


def pack_table(lengths: dict[str, int]) -> tuple[str, np.ndarray]:
    """The first tier for the broadcast: the pre-tokens in one string and an array of lengths."""
    return "\0".join(lengths), np.fromiter(lengths.values(), np.uint16, len(lengths))


def unpack_table(packed: tuple[str, np.ndarray]) -> dict[str, int]:
    keys, lengths = packed
    return dict(zip(keys.split("\0"), lengths.tolist(), strict=True)) if len(lengths) else {}


def _summary(seen: Counter[str], entries: int) -> pa.RecordBatch:
    """One row: the most frequent words of seen, twice as many as are asked for, and their numbers."""
    top = [(w, n) for w, n in seen.most_common(2 * entries) if len(w) < LONGEST_KEPT]
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["words", "numbers"])


def frequent_words(docs: DataFrame, text: str, entries: int, fan_in: int = 16) -> dict[str, int]:
    """The most frequent words between white space of all texts, with their numbers.

    Each task counts its whole texts; when it holds eight times as many words as are
    asked for, it drops the rarer half.  Its summary has at most twice the words asked for, and so has
    that of fan_in summaries.  A word that no step drops has its true number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches, 0):
            for t in batch.column(0).to_pylist():
                seen.update((t or "").split())
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))
        yield _summary(seen, entries)

    def merge(group: pa.Table) -> pa.Table:
        seen: Counter[str] = Counter()
        for words, numbers in zip(group.column("words"), group.column("numbers"), strict=True):
            for w, n in zip(words.as_py(), numbers.as_py(), strict=True):
                seen[w] += n
        merged = pa.Table.from_batches([_summary(seen, entries)])
        return merged.append_column("part", group.column("part").slice(0, 1))

    kind = "words array<string>, numbers array<bigint>"
    # Written, so that texts are read once: one row for each task.
    found = written(docs.select(F.col(f"`{text}`")).mapInArrow(count, kind).withColumn("part", F.spark_partition_id()), "word-summaries")
    left = found.count()
    while left > 1:
        left = -(-left // fan_in)
        found = found.withColumn("part", F.col("part") % left).groupBy("part").applyInArrow(merge, f"{kind}, part int")
    rows = found.select("words", "numbers").collect()  # one
    return dict(list(zip(rows[0].words, rows[0].numbers, strict=True))[:entries]) if rows else {}


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text: str, table_entries: int) -> dict[str, int]:
    """The most frequent pre-tokens with their lengths: those of the corpus' most frequent words, each after a space."""
    seen: Counter[str] = Counter()
    split = regex.compile(PATTERN).findall
    for word, n in frequent_words(docs, text, table_entries).items():
        for piece in split(f" {word}"):
            seen[piece] += n
    pieces = [p for p, _ in seen.most_common(table_entries) if "\0" not in p]
    found = load_tokenizer(tokenizer_path).encode_batch(pieces, add_special_tokens=False) if pieces else []
    return {p: len(e.ids) for p, e in zip(pieces, found, strict=True)}


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    text: str = "text",
    limit: int = 512,
    table_entries: int = 32768,
    cache_entries: int = 200_000,
) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to docs, one row for each of its rows.

    Null texts count as empty: 0 bytes, 0 tokens, not over the limit.  Empty tables
    give empty results; repeated rows are counted each; texts are never cut.  A
    column of docs that has one of the three names is replaced.
    tokenizer_path: a byte-level BPE file that every executor can open by this path.
    """
    table = docs.sparkSession.sparkContext.broadcast(pack_table(frequent_lengths(docs, tokenizer_path, text, table_entries)))

    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    inner = docs.select(*(F.col(f"`{c}`") for c in kept))
    read, counted = free_name(inner, "text_to_count"), free_name(inner, "n_tokens")
    carried = [c for c in kept if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path, unpack_table(table.value), cache_entries)
        for batch in slices(batches, batch_text):
            n = [counter.count(t) for t in batch.column(batch_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:batch_text], pa.array(n, pa.int64())], [*batch.schema.names[:batch_text], counted])

    sent = inner.select(*(F.col(f"`{c}`") for c in carried), F.octet_length(text_or_empty(text)).cast("long").alias(free_name(inner, "n_bytes")), F.col(f"`{text}`").alias(read))
    batch_text = len(sent.columns) - 1
    fields = [*sent.schema.fields[:-1]]
    out = sent.mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{counted}` bigint"]))
    return out.withColumn("over_limit", F.col(counted) > limit)
