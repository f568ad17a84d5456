"""What several operators share: the scratch folder, text helpers and Arrow slices."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts count them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session names in ``spark.checkpoint.dir``.  Where nothing is set, a
    local session (as in tests) gets a folder of its own; a cluster is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again.

    It cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def root_buckets(rows: int) -> int:
    """About the square root of the row count.

    With so many buckets both the rows of a bucket and the table of all buckets
    stay small: 1e11 rows give 316 k buckets of 316 k rows.
    """
    return max(1, math.isqrt(max(0, rows - 1)) + 1)


def numbered(rows: DataFrame, order: list[str], number: str) -> DataFrame:
    """rows with their place in the order of some columns, from 0, written.

    Rows that are equal in all columns can stand for each other, and are dealt to several tasks; so what has which number doesn't
    depend on how the input is cut.  Columns that have no hash (maps, variants) don't count.
    """
    whole, salt, at, task, before = (free_name(rows, f"_tidemark_{x}") for x in ("whole", "salt", "at", "task", "before"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind))
    marked = rows.withColumns({whole: hashed, salt: F.pmod(F.monotonically_increasing_id(), F.lit(1024))})
    by = [*order, whole, salt]
    # A task's rows in order, and its own place among the tasks: the id has both.
    placed = written(marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()).drop(whole, salt), "numbered")
    task_of, place = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(task_of.alias(task)).agg(F.count(F.lit(1)).alias("n"))  # one row for each task
    earlier = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(task, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    return placed.join(F.broadcast(firsts), task_of == F.col(task)).withColumn(number, F.col(before) + place).drop(at, task, before)


def scattered(docs: DataFrame, key: list[Column], buckets: int, seed: int, bucket: str, order: str) -> tuple[DataFrame, DataFrame]:
    """docs with the columns bucket (0 to buckets - 1) and order, both hashes of key, and a table (bucket, n) of the buckets' rows.

    Rows that share a key share a bucket.  Only where a bucket has far more rows than it
    should are the keys of its rows counted; rows of a key that would fill a bucket alone
    are numbered, and the number draws the bucket: the same for every run and every cut of the input.
    """
    rows = docs.select("*", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).alias(bucket), F.xxhash64(F.lit(seed + 1), *key).alias(order))
    count_of = lambda df: written(df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), "buckets")
    counts = count_of(rows)
    full = counts.where(F.col("n") > 8 * max(2, buckets)).select(bucket)
    if full.isEmpty():
        return rows, counts
    # At most rows / buckets of them, about as many as buckets.
    keys = rows.select(bucket, order).join(F.broadcast(full), bucket).groupBy(order).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > buckets)
    keys = F.broadcast(written(keys.select(order), "hot-keys"))
    number = free_name(rows, "_tidemark_number")
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(order), F.col(number)), F.lit(buckets))
    hot = numbered(rows.join(keys, order), [order], number).withColumn(bucket, drawn).drop(number)
    spread = rows.join(keys, order, "left_anti").unionByName(hot)
    return spread, count_of(spread)


def merged_copies(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The doc_id and text of docs with the column times, and whether any isn't 1: rows of one id and text that are very many are one row.

    Only ids that very many rows share (a null id counts as one) are looked at closer; where there are
    none, all rows come as they are, once each.
    """
    n = docs.count()
    most = max(1000, 8 * root_buckets(n))
    rows = docs.select("doc_id", "text", F.lit(1).cast("long").alias("times"))
    # Of ids and copies together at most n / most, fewer than the square root of n.
    ids = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("doc_id").alias("its_id")), "hot-ids")
    if ids.isEmpty():
        return rows, False
    mark = F.xxhash64("text").alias("mark")
    marked = docs.select("doc_id", "text", mark)
    held = marked.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("its_id"))).groupBy("its_id", F.col("mark").alias("its_mark")).agg(F.count(F.lit(1)).alias("n"))
    copies = F.broadcast(written(held.where(F.col("n") > most).select("its_id", "its_mark"), "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))
    merged = marked.join(copies, same, "left_semi").groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    return marked.join(copies, same, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("times")).unionByName(merged.select("doc_id", "text", "times")), True


def repeated(rows: DataFrame, times: str = "times", at_once: int = 10_000) -> DataFrame:
    """Each row as often as its column times says, without the column; no task makes all copies of a row that has very many."""
    rows = written(rows, "once")
    parts = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / at_once)), lambda i: F.least(F.lit(at_once).cast("long"), F.col(times) - i * at_once)))
    few, many = rows.where(F.col(times) <= at_once), rows.where(F.col(times) > at_once)
    dealt = many.withColumn(times, parts).repartition(64)
    return few.unionByName(dealt).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each have about most_bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [n or 0 for n in pa.compute.binary_length(batch.column(text_at)).to_pylist()]
        first = held = 0
        for i, n in enumerate(sizes):
            if i > first and held + n > most_bytes:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)
