"""Mixing sources to target weights, in DataFrame operations alone.

The documents of a source, in a seeded random order, form one line of words, which is cut
into blocks of equal numbers of words.  A document belongs to the block in which it begins.
The mix takes the line up to the source's quota; a quota above the source's size goes on to a
second pass of the line.  A splitting tree deals the blocks to output shards: at
each node a multivariate hypergeometric draw says how many blocks of each source go
to the left half of the shards, so that each shard gets its exact number of blocks and
the numbers are those of a random deal.  The blocks' numbers are permuted (b becomes (a b + c) modulo
their number, with a seeded a that is prime to it), and each shard draws the next so many of every
source's permuted blocks, disjoint from all others', and shuffles the documents that it got by a hash.

So the quotas alone decide what is taken, and the tree decides who gets it.  Only the
sources' totals reach the driver, which draws the tree.  If there are too many sources for
that, their targets are found by aggregates, and the tree deals the blocks of groups of
sources: the words that the mix takes of a group's sources, one source after another, are a line.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, root_buckets, scattered, written

#: As many sources are summarised on the driver.  More are dealt in groups, of which there are as many as GROUPS.
MOST_SOURCES = 100_000
GROUPS = 4096
#: The library's hypergeometric draw takes fewer than 1e9 blocks.
MOST_BLOCKS = 1 << 29


@dataclass(frozen=True)
class SourceQuota:
    source: str | None
    size: int
    target: float
    #: Words that the mix takes, words of a block, and the blocks' number.
    words: int
    block: int
    blocks: int
    #: The permutation of the blocks: b goes to (factor * b + shift) modulo their number.
    factor: int
    shift: int
    #: For each shard, the permuted block before which its interval ends.
    ends: list[int]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """How many words each source should give.

    Sources in code-point order, null last, weigh `weights` in turn and share
    `share` times all words; none gives more than `most` times its own, and what is
    above goes to the others by weight until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be"))
    order += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, given = share * sum(sizes.values()), {}
    open_ = list(order)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            given |= {s: unit * weight[s] for s in open_}
            break
        given |= {s: float(most * sizes[s]) for s in above}
        rest -= sum(most * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in set(above)]
    return {s: given[s] for s in order}


def deal_blocks(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """blocks of each source dealt to shards: a matrix (shards, sources) with exact sums.

    Shards get equal numbers of blocks, or one more.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    each = np.full(shards, sum(blocks) // shards)
    each[: sum(blocks) % shards] += 1
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = have
            return
        mid = (first + last) // 2
        left = rng.multivariate_hypergeometric(have, int(each[first:mid].sum()), method="marginals")
        split(left, first, mid)
        split(have - left, mid, last)

    split(np.asarray(blocks, np.int64), 0, shards)
    return out


def quotas(sizes: dict[str | None, int], goal: dict[str | None, float], shards: int, seed: int, block_words: int = 1) -> list[SourceQuota]:
    words = [round(t) for t in goal.values()]
    block = max(block_words, -(-sum(words) // MOST_BLOCKS))
    blocks = [-(-w // block) for w in words]
    ends = np.cumsum(deal_blocks(blocks, shards, seed), axis=0)
    rng, out = np.random.Generator(np.random.PCG64(seed + 1)), []
    for i, (source, target) in enumerate(goal.items()):
        n = max(1, blocks[i])
        factor = int(rng.integers(1, n + 1))
        while math.gcd(factor, n) > 1:
            factor = int(rng.integers(1, n + 1))
        out.append(SourceQuota(source, sizes[source], target, words[i], block, n, factor % n, int(rng.integers(n)), ends[:, i].tolist()))
    return out


_DEAL = ("block", "blocks", "factor", "shift", "ends")


def _table(spark: SparkSession, rows: list[SourceQuota]) -> DataFrame:
    """The quotas as a DataFrame made of a literal: one row for each source.

    s numbers the sources, quota says how many words of it the mix takes, offset where
    they begin in the line of the source's group (here each source is one); the others say how the line's blocks are dealt.
    """
    text = json.dumps([{"s": i, "source": q.source, "source_size": q.size, "target": q.target, "quota": q.words, **{c: getattr(q, c) for c in _DEAL}} for i, q in enumerate(rows)])
    kind = "array<struct<s:int,source:string,source_size:bigint,target:double,quota:bigint,block:bigint,blocks:bigint,factor:bigint,shift:bigint,ends:array<bigint>>>"
    listed = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    return listed.select("s", F.col("source").alias("_tidemark_source"), "source_size", "target", "quota", F.lit(0).cast("long").alias("offset"), *_DEAL)


def _grouped_table(totals: DataFrame, shards: int, weights: tuple[float, ...], share: float, most: float, seed: int, block_words: int) -> DataFrame:
    """What `_table` gives, for any number of sources, from totals (_tidemark_source, bucket, words)."""
    source = F.col("_tidemark_source")
    sized = totals.groupBy(source).agg(F.sum("words").cast("long").alias("source_size"))
    dealt = sized.repartitionByRange(source.isNull(), source).withColumn("range", F.spark_partition_id())
    ranged = written(dealt, "mix-sources")
    in_range = Window.partitionBy("range").orderBy(source.isNull(), source)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task's range
    firsts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = ranged.withColumn("place", F.row_number().over(in_range)).join(firsts, "range").withColumn("s", F.col("place") - 1 + F.col("earlier"))
    each = F.array(*(F.lit(float(w)) for w in weights))
    weighed = written(numbered.select("s", source, "source_size", F.get(each, (F.col("s") % len(weights)).cast("int")).alias("weight")), "mix-weights")

    # The share of a weight rises until no open source would give more than it may.
    unit, above = 0.0, F.lit(False)
    while True:
        closed, open_ = F.when(above, F.col("source_size")).otherwise(0), F.when(above, 0.0).otherwise(F.col("weight"))
        found = weighed.agg(F.sum("source_size").alias("all"), F.sum(closed).alias("closed"), F.sum(open_).alias("open")).first()
        higher = (share * found["all"] - most * found["closed"]) / found["open"] if found["open"] else unit
        if higher <= unit:
            break
        unit = higher
        above = F.lit(unit) * F.col("weight") > most * F.col("source_size")
    target = F.when(above, most * F.col("source_size")).otherwise(unit * F.col("weight"))
    aimed = weighed.withColumn("target", target.cast("double")).withColumn("quota", F.rint("target").cast("long")).withColumn("g", F.pmod(F.xxhash64("s"), F.lit(GROUPS)).cast("int"))
    earlier = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(aimed.withColumn("offset", F.coalesce(F.sum("quota").over(earlier), F.lit(0))), "mix-quotas")
    lines = {r.g: r.words for r in placed.groupBy("g").agg(F.sum("quota").alias("words")).orderBy("g").collect()}
    groups = quotas({str(g): w for g, w in lines.items()}, {str(g): float(w) for g, w in lines.items()}, shards, seed, block_words)
    deal = _table(totals.sparkSession, groups).select(F.col("_tidemark_source").cast("int").alias("g"), *_DEAL)
    return placed.join(F.broadcast(deal), "g").select("s", source, "source_size", "target", "quota", "offset", *_DEAL)


def mix(docs: DataFrame, *, size: str | None = None, shards: int = 24, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 23, block_words: int = 4096, whole: bool = False) -> DataFrame:
    """docs with source_size, target, taken and pieces, one row for each of its rows.

    size: a column that holds the words of each row; without it they are counted in
    text.  pieces is an array of (pass, shard, block, n_words, local_order): how often the mix
    takes the document, for which shard and in which block of its source's line, and a hash whose order is the shard's shuffled
    one; `taken` is the sum of words.  Quotas are met to the word: of the document at which one
    ends the first words are taken.  With `whole` documents are taken whole or not at
    all: that one if half of it or more is within.  Blocks have block_words words, or more
    where there would be more than 2^29.  Documents without words and null texts give none.  A null
    source is a source.  Reruns take the same, however the input is cut into tasks: the order is a hash of doc_id and size,
    and rows that share both can stand for each other.  Columns of docs with the names
    of new ones are replaced.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    new = ("source_size", "target", "taken", "pieces")
    own = [c for c in docs.columns if c.lower() not in new]
    counted = F.col(f"`{size}`").cast("long") if size else word_count(F.col("text"))
    sized = docs.select(*(F.col(f"`{c}`") for c in own), counted.alias("_tidemark_size"))
    rows, _ = scattered(sized, [F.col("doc_id"), F.col("_tidemark_size")], root_buckets(docs.count()), seed, "_tidemark_bucket", "_tidemark_order")
    totals = written(rows.groupBy(F.col("source").alias("_tidemark_source"), F.col("_tidemark_bucket").alias("bucket")).agg(F.sum("_tidemark_size").alias("words")), "mix-totals")
    found = totals.groupBy("_tidemark_source").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        dealt = written(_grouped_table(totals, shards, weights, share, most, seed, block_words), "mix-dealt")
    else:
        sizes = {r[0]: r[1] for r in found}
        dealt = F.broadcast(_table(spark, quotas(sizes, targets(sizes, weights, share, most), shards, seed, block_words)))  # one row a source, at most MOST_SOURCES

    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        totals.join(dealt.select("s", F.col("_tidemark_source").alias("source")), totals["_tidemark_source"].eqNullSafe(F.col("source")))
        .select(F.col("s").alias("_tidemark_s"), F.col("bucket").alias("_tidemark_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_tidemark_start"))
    )
    inside = Window.partitionBy("_tidemark_s", "_tidemark_bucket").orderBy("_tidemark_order", "_tidemark_size").rowsBetween(Window.unboundedPreceding, -1)
    lined = (
        rows.join(dealt.select(F.col("s").alias("_tidemark_s"), "_tidemark_source"), rows["source"].eqNullSafe(F.col("_tidemark_source")))
        .drop("_tidemark_source")
        .withColumn("_tidemark_words", F.coalesce(F.sum("_tidemark_size").over(inside), F.lit(0)))
        .join(starts, ["_tidemark_s", "_tidemark_bucket"])
        .join(dealt.select(F.col("s").alias("_tidemark_s"), "source_size", "target", F.col("quota").alias("_tidemark_quota"), F.col("offset").alias("_tidemark_offset"), *(F.col(c).alias(f"_tidemark_{c}") for c in _DEAL)), "_tidemark_s")
    )
    start, end_of = F.col("_tidemark_start") + F.col("_tidemark_words"), F.col("_tidemark_quota")
    passes = F.when((F.col("_tidemark_size") > 0) & (end_of > 0), F.sequence(F.lit(0), F.ceil(end_of / F.col("source_size")).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def piece(p: Column) -> Column:
        first = start + p * F.col("source_size")
        block = F.floor((F.col("_tidemark_offset") + first) / F.col("_tidemark_block"))
        place = F.pmod(F.col("_tidemark_factor") * block + F.col("_tidemark_shift"), F.col("_tidemark_blocks"))
        shard = F.size(F.filter(F.slice("_tidemark_ends", F.lit(1), F.lit(shards - 1)), lambda e: e <= place)) if shards > 1 else F.lit(0)
        words = F.col("_tidemark_size") if whole else F.least(F.col("_tidemark_size"), end_of - first)
        order = F.xxhash64(F.lit(seed + 2), p, F.col("doc_id"), F.col("_tidemark_size"))
        within = (end_of - first) * 2 >= F.col("_tidemark_size") if whole else words > 0
        return F.when(within, F.struct(p.alias("pass"), shard.cast("int").alias("shard"), block.alias("block"), words.alias("n_words"), order.alias("local_order")))

    pieces = F.filter(F.transform(passes, piece), lambda x: x.isNotNull()).alias("pieces")
    return lined.select(*(F.col(f"`{c}`") for c in own), "source_size", "target", pieces).select(
        "*", F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["n_words"]).alias("taken")
    )


def mixed_documents(mixed: DataFrame) -> DataFrame:
    """The mix as documents: one row for each time that `mix(whole=True)` takes a document, with docs' columns and the shard and local_order of the row."""
    return mixed.select("*", F.inline("pieces")).drop("source_size", "target", "taken", "pieces", "pass", "block", "n_words")
