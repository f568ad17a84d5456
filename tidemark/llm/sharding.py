"""Shuffled shards by a two-pass external shuffle, in DataFrame operations alone.

The first pass scatters the rows by a seeded hash into buckets that fit in memory.
The second shuffles each bucket: its rows are numbered by a second hash, and a
Fisher-Yates shuffle of those numbers (Spark's ``shuffle``) gives their places.  The
buckets in order, each in its shuffled order, are one permutation of all rows.  It is cut
into shards of equal numbers of rows (or one more); so a bucket goes to one shard,
seldom to two, and the task that shuffled it writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, root_buckets, scattered, scratch_path, text_or_empty

#: Buckets that a task permutes at once.
BUCKETS_A_TASK = 256


def bucket_permutations(counts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(bucket, offset, perm) from (bucket, n): where the bucket starts and the shuffled numbers 0 to n - 1.

    ``shuffle`` draws from one generator for each partition.  With a number of partitions that
    depends on the number of buckets alone, each sorted by bucket, reruns draw the same.  (The
    bucket is dealt by another type than it is returned in: a join then deals these rows like the
    documents instead of the documents like them.)
    """
    # One row for each bucket, about the square root of the row count.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbers = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    dealt = placed.withColumn("bucket", F.col("bucket").cast("int")).repartition(max(8, -(-buckets // BUCKETS_A_TASK)), "bucket")
    return dealt.sortWithinPartitions("bucket").select(F.col("bucket").cast("long").alias("bucket"), "offset", F.shuffle(numbers, F.lit(seed)).alias("perm"))


def record_size(text: Column) -> Column:
    """A record's size: the text's UTF-8 bytes (null: none) plus 8."""
    return (F.octet_length(text_or_empty(text)) + 8).cast("long")


def shard_rows(docs: DataFrame, shards: int, *, seed: int = 17, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with the columns shard and slot.

    Slots count from 0 without gaps in each shard.  Rows scatter by the hash of the key
    columns, which should tell rows apart: null ids are as good as others, and
    equal rows are kept, each in a slot of its own.  Columns of docs with the new names
    are replaced.  Empty tables give empty results.  Reruns give the same rows the same
    places, however the input is cut into tasks; rows of one key can stand for each other.
    """
    n = docs.count()
    buckets = root_buckets(n)
    number_, bucket_, order_, place_, perm_, offset_ = (free_name(docs, f"_tidemark_{x}") for x in ("number", "bucket", "order", "place", "perm", "offset"))
    rows, counts = scattered(docs, [F.col(f"`{c}`") for c in key], buckets, seed, bucket_, order_)
    counts = counts.withColumnRenamed(bucket_, "bucket")
    perms = bucket_permutations(counts, buckets, seed).select(F.col("bucket").alias(bucket_), F.col("offset").alias(offset_), F.col("perm").alias(perm_))
    number = F.row_number().over(Window.partitionBy(bucket_).orderBy(order_)) - 1
    # The permutations hold as many numbers as there are rows: they are merged with the buckets, not broadcast.
    joined = rows.withColumn(number_, number).join(perms.hint("merge"), bucket_)
    placed = joined.withColumn(place_, F.col(offset_) + F.get(F.col(perm_), F.col(number_)))
    # The first `longer` shards have a row more than the others.
    each, longer = divmod(n, shards)
    place, edge = F.col(place_), longer * (each + 1)
    short = max(1, each)
    shard = F.when(place < edge, F.floor(place / (each + 1))).otherwise(longer + F.floor((place - edge) / short)).cast("int")
    slot = F.when(place < edge, place % (each + 1)).otherwise((place - edge) % short).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, shard.alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard of `shard_rows`' result as a directory shard=N of Parquet files, rows in slot order.

    The tasks that shuffled the buckets write them: nothing is shuffled again.  The file
    commit protocol keeps retried tasks from writing rows twice.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def written_shards(sharded: DataFrame) -> DataFrame:
    """The rows of `shard_rows`, written to the shared folder as shards and read again."""
    path = scratch_path(sharded.sparkSession, "shards")
    write_shards(sharded, path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
