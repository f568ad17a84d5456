"""Receipts: what says that a run's processing is complete, kept beside its report in the lake.

A receipt is a ``processing.completed`` event at ``quality/…/run-<id>/processing-completed.json``.  It is
written once; one that is there must be the one that is found again, but for its time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import runs
from tidemark.operators.events import UUID, decode_events, encode_events, receipt_id, receipt_violations
from tidemark.schemas import ENDPOINTS, EVENT_TYPES, RIVER_STATIONS
from tidemark.sources import lake as L
from tidemark.sources.files import LakeFiles

NAME = "processing-completed.json"
#: What every receipt's data must say; those of snapshots also where their stations are.
FIELDS = ("provider", "endpoint", "run_id", "manifest_path", "quality_report_path", "observation_output_path", "ingestion_event_id", "request_event_id")


def run_folder(kind: str, endpoint: Column, captured_at: str, run_id: Column) -> Column:
    """A run's place below the lake's root, in processed/dataset=… or quality."""
    at = [F.concat(F.lit(f"{n}="), c) for n, c in L.hour_columns(captured_at).items()]
    return F.concat_ws("/", F.lit(kind), F.concat(F.lit("endpoint="), endpoint), *at, F.concat(F.lit("run-"), run_id))


def run_results(manifests: DataFrame, commits: DataFrame) -> DataFrame:
    """One row for each run of which everything is committed: where its outputs and its report are, and when it was complete.

    manifest_path is the manifest's key, if manifests have a column of that name, else null.
    """
    pending = runs.pending_runs(manifests, commits).select("run_id")
    rows = F.max(F.when(F.col("dataset") == "observations", F.col("row_count"))).alias("row_count")
    done = commits.groupBy("run_id").agg(rows, F.max("committed_at").alias("completed_at"))
    endpoint, run = F.col("endpoint"), F.col("run_id")
    place = lambda kind: run_folder(kind, endpoint, "captured_at", run)
    manifest = F.col("manifest_path") if "manifest_path" in manifests.columns else F.lit(None).cast("string")
    whole = manifests.join(pending, "run_id", "left_anti").join(done, "run_id")
    return whole.select(
        "provider", "endpoint", "run_id", "captured_at", manifest.alias("manifest_path"), F.concat(place("quality"), F.lit("/report.json")).alias("quality_report_path"),
        place("processed/dataset=observations").alias("observation_output_path"), F.when(endpoint == RIVER_STATIONS, place("processed/dataset=stations")).alias("station_output_path"),
        "row_count", "completed_at",
    )


def processing_receipts(ingested: DataFrame, results: DataFrame) -> DataFrame:
    """A receipt for each ingestion event (event_id, correlation_id, run_id, request_event_id) whose run has results, with its path.

    Its id is a hash of the ingestion event's, so it is the same whoever writes it.
    """
    found = ingested.withColumnRenamed("event_id", "ingestion_event_id").join(results, "run_id")
    said = [*FIELDS[:5], "station_output_path", *FIELDS[5:]]
    data = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, said)), F.array(*said)), lambda _, v: v.isNotNull())
    path = F.concat(F.regexp_replace("quality_report_path", "/[^/]*$", "/"), F.lit(NAME))
    return found.select(
        path.alias("path"), "endpoint", "run_id", "captured_at", receipt_id(F.col("ingestion_event_id")).alias("event_id"), F.lit(EVENT_TYPES[2]).alias("event_type"),
        F.col("completed_at").alias("occurred_at"), "correlation_id", F.lit(1).alias("schema_version"), data.alias("data"),
    )


def scan_receipts(spark: SparkSession, lake: str) -> DataFrame:
    """The receipts of a lake as events, with their path below its root and what is wrong with them as events (errors); none: no rows."""
    files = LakeFiles(spark, lake)
    pattern = f"{lake}/quality/endpoint=*/*/*/*/*/*/{NAME}"
    if not files.matching(pattern):
        return decode_events(spark.createDataFrame([], "path string, value string"))
    texts = spark.read.option("wholetext", True).text(pattern)
    path = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "(quality/endpoint=.*)$", 1)
    return decode_events(texts.select(path.alias("path"), "value"))


def store_receipts(spark: SparkSession, lake: str, receipts: DataFrame) -> DataFrame:
    """Writes the receipts that aren't there; returns those of the lake.

    Two receipts for one path, or one that differs from what is there in more than its time, are an error, and
    nothing is written.  Of two writers at once one wins, and the other finds its receipt.
    """
    files, staging = LakeFiles(spark, lake), f"{lake}/staging/{uuid.uuid4().hex}"
    try:
        text = encode_events(receipts)
        held = receipts.select(*receipts.columns, text.alias("value"))
        held.write.parquet(f"{staging}/receipts")
        held = spark.read.schema(held.schema).parquet(f"{staging}/receipts")
        twice = held.groupBy("path").agg(F.count_distinct("event_id").alias("n")).where("n > 1").limit(10).collect()
        if twice:
            raise ValueError(f"several ingestions say that they are one run: {[r.path for r in twice]}")
        there = scan_receipts(spark, lake)
        _no_conflicts(there, held)
        new = held.dropDuplicates(["path"]).join(there.select("path"), "path", "left_anti")
        stamped = new.select("endpoint", *(c.alias(n) for n, c in L.hour_columns("captured_at").items()), F.col("run_id").alias("_run"), "value")
        stamped.write.partitionBy("endpoint", "year", "month", "day", "hour", "_run").text(f"{staging}/quality")
        for part in files.matching(f"{staging}/quality/*/*/*/*/*/_run=*/part-*"):
            folder = part.rsplit("/", 1)[0]
            levels = folder.split("/")[-6:-1]
            files.move(part, "/".join([lake, "quality", *levels, f"run-{L.value_in_path(folder)}", NAME]))
        stored = scan_receipts(spark, lake)
        _no_conflicts(stored, held)  # another writer's may have come between
        return stored
    finally:
        files.delete(staging)


def _no_conflicts(there: DataFrame, held: DataFrame) -> None:
    mine = there.join(held.select("path"), "path", "left_semi")
    odd = receipt_violations(mine, held).limit(10).collect()
    if odd:
        raise ValueError(f"receipts differ from those that are there: {[(r.event_id, r.kind) for r in odd]}")


def receipt_faults(receipts: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """The receipts (path, event_id, event_type, data, errors) that aren't as they must be, with what is wrong: faults.

    event: no event; event_type: another event; a field's name: it is missing, blank, unknown (provider, endpoint) or no
    UUID (ids); path: the receipt isn't beside its report.
    """
    of = lambda name: F.element_at("data", name)
    blank = lambda name: F.coalesce(F.trim(of(name)) == "", F.lit(True))
    snapshot = F.coalesce(of("endpoint") == RIVER_STATIONS, F.lit(False))
    wrong = {
        "provider": ~F.coalesce(of("provider").isin(*providers), F.lit(False)), "endpoint": ~F.coalesce(of("endpoint").isin(*ENDPOINTS), F.lit(False)),
        **{n: blank(n) for n in FIELDS[2:6]}, "station_output_path": snapshot & blank("station_output_path"), **{n: ~F.coalesce(of(n).rlike(UUID), F.lit(False)) for n in FIELDS[6:]},
    }
    beside = F.concat(F.regexp_extract(of("quality_report_path"), "^(.*)/[^/]*$", 1), F.lit(f"/{NAME}"))
    checks = [F.when(F.col("event_type") != EVENT_TYPES[2], F.lit("event_type")), *(F.when(bad, F.lit(n)) for n, bad in wrong.items())]
    checks.append(F.when(~F.coalesce(F.col("path") == beside, F.lit(False)), F.lit("path")))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    faults = F.when(F.size("errors") > 0, F.array(F.lit("event"))).otherwise(found)
    return receipts.select("path", "event_id", faults.alias("faults")).where("size(faults) > 0")
