"""Runs: which are committed, which are pending, and processing that can be run again."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality, transforms
from tidemark.operators.claims import Claims
from tidemark.schemas import PROCESSED, RIVER, RIVER_STATIONS
from tidemark.sources import lake as L
from tidemark.sources.files import LakeFiles

DATASETS = ("stations", "observations")
#: The time by which a data set's files are found.
TIMES = {"stations": "ingested_at", "observations": "observed_at"}
FILES = "array<struct<name: string, rows: bigint, first_at: timestamp, last_at: timestamp, first_station: string, last_station: string>>"
COMMITS = f"run_id string, endpoint string, dataset string, row_count bigint, committed_at timestamp, folder string, columns string, files {FILES}"
VERDICTS = "endpoint string, run_id string, manifests bigint, pages bigint, missing bigint, mismatched bigint, miscounted bigint"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table of the lake; empty before its first row."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def commit_log(spark: SparkSession, lake: str) -> DataFrame:
    """What was committed: one row for each run and data set; empty before the first.

    folder is the run's place below the lake's root (null without rows), columns the columns of its files, files what each holds.
    """
    return _table(spark, f"{lake}/commits", COMMITS)


def file_catalog(spark: SparkSession, lake: str, dataset: str) -> DataFrame:
    """The committed files of a data set: path, run_id, columns, rows, the first and last time and station."""
    held = commit_log(spark, lake).where((F.col("dataset") == dataset) & F.col("folder").isNotNull())
    rows = held.select("run_id", "endpoint", "folder", "columns", F.inline("files"))
    return rows.select(F.concat_ws("/", "folder", "name").alias("path"), "run_id", "endpoint", "columns", "rows", "first_at", "last_at", "first_station", "last_station").distinct()


def scan_committed(spark: SparkSession, lake: str, dataset: str, *, start: datetime | None = None, end: datetime | None = None, station: str | None = None, endpoint: str | None = None) -> DataFrame:
    """Rows of a data set's committed files; only those that may hold the time (start to end, end excluded), station and endpoint are listed and opened.

    The rows themselves are filtered alike.  Their columns come from the commits: no
    footer is opened for them, and files that lack a column of others give nulls.  The driver
    gets one path for each file that is read.
    """
    path, at = F.col("path"), F.col(TIMES[dataset])
    files, wanted = file_catalog(spark, lake, dataset), F.lit(True)
    if start is not None:
        files, wanted = files.where(F.col("last_at") >= F.lit(start)), wanted & (at >= F.lit(start))
    if end is not None:
        files, wanted = files.where(F.col("first_at") < F.lit(end)), wanted & (at < F.lit(end))
    if station is not None:
        files, wanted = files.where(F.lit(station).between(F.col("first_station"), F.col("last_station"))), wanted & (F.col("station_id") == station)
    if endpoint is not None:
        files, wanted = files.where(F.col("endpoint") == endpoint), wanted & (F.col("endpoint") == endpoint)
    found = files.select(F.concat(F.lit(f"{lake}/"), path).alias("path"), "columns").collect()
    columns = dict(c.split(" ", 1) for kinds in [PROCESSED[dataset], *sorted({r.columns for r in found})] for c in kinds.split(", "))
    schema = ", ".join(f"{n} {t}" for n, t in columns.items())
    return L.scan_folders(spark, lake, dataset, [r.path for r in found], schema).where(wanted)


def committed_runs(manifests: DataFrame, commits: DataFrame, present: DataFrame) -> DataFrame:
    """The state of each planned run and data set: complete, incomplete (rows without a commit) or absent.

    present (run_id, dataset) lists what has rows in the processed tables.
    """
    wanted = F.when(F.col("endpoint") == RIVER, F.array(F.lit("observations"))).otherwise(F.array(F.lit("stations"), F.lit("observations")))
    planned = manifests.select("endpoint", "run_id", F.explode(wanted).alias("dataset"))
    done = commits.groupBy("run_id", "dataset").agg(F.max("row_count").alias("row_count"))
    there = present.select("run_id", "dataset", F.lit(True).alias("there")).distinct()
    state = F.when(F.col("row_count").isNotNull(), "complete").when(F.col("there"), "incomplete").otherwise("absent")
    return planned.join(done, ["run_id", "dataset"], "left").join(there, ["run_id", "dataset"], "left").select("endpoint", "run_id", "dataset", state.alias("state"), "row_count")


def pending_runs(manifests: DataFrame, commits: DataFrame) -> DataFrame:
    """Manifests of runs that lack a commit of any of their data sets."""
    sets = commits.groupBy("run_id").agg(F.countDistinct("dataset").alias("n"))
    need = F.when(F.col("endpoint") == RIVER, 1).otherwise(2)
    done = manifests.select("endpoint", "run_id").join(sets, "run_id").where(F.col("n") >= need).select("run_id")
    return manifests.join(done, "run_id", "left_anti")


@dataclass(frozen=True)
class Processed:
    """The tables of pending runs, before they are written."""

    stations: DataFrame
    observations: DataFrame

    def __getitem__(self, dataset: str) -> DataFrame:
        return getattr(self, dataset)


def process(spark: SparkSession, manifests: DataFrame) -> Processed:
    """Typed rows of all the manifests' runs in one job for each endpoint; only the pages that they list are read."""
    runs = manifests.select("run_id", "captured_at")
    of = {}
    for endpoint in (RIVER, RIVER_STATIONS):
        pages = L.scan_listed_pages(spark, manifests, endpoint)
        of[endpoint] = L.parse_records(L.explode_records(pages, runs), endpoint)
    history = transforms.transform_historical_observations(of[RIVER]).withColumn("endpoint", F.lit(RIVER))
    current = transforms.transform_station_observations(of[RIVER_STATIONS]).withColumn("endpoint", F.lit(RIVER_STATIONS))
    stations = transforms.transform_stations(of[RIVER_STATIONS]).withColumn("endpoint", F.lit(RIVER_STATIONS))
    return Processed(stations, history.unionByName(current))


def quality_reports(manifests: DataFrame, stations: DataFrame, observations: DataFrame) -> DataFrame:
    """One report for each run: its data sets' quality and, for snapshots, the health of the data."""
    summary = lambda flagged, name: quality.dataset_quality_summary(flagged, ["run_id"]).select("run_id", F.struct("total_rows", "pass_rows", "warn_rows", "fail_rows", "affected_rows", "pass_ratio", "status", "error_counts", "warning_counts").alias(name))
    health = quality.current_data_health(stations, observations.where(F.col("endpoint") == RIVER_STATIONS))
    health = health.select("run_id", F.struct(*(c for c in health.columns if c != "run_id")).alias("current_data_health"))
    runs = manifests.select("run_id", "endpoint", "captured_at")
    joined = runs.join(summary(quality.station_quality(stations), "station_summary"), "run_id", "left").join(summary(quality.observation_quality(observations), "observation_summary"), "run_id", "left").join(health, "run_id", "left")
    return joined.withColumn("report_version", F.lit(1))


def process_runs_idempotent(spark: SparkSession, lake: str, *, runs_at_once: int = 1000, lease: timedelta = timedelta(hours=2)) -> DataFrame:
    """Processes every completed run that isn't committed, and returns what each run has.

    Up to runs_at_once runs, the oldest first, go together.  Those that nobody else works on are claimed.  Of
    these the pages are compared with the manifests: a run of which a page is missing, altered or holds another
    number of records is rejected (`rejected_runs`) and looked at again by the next call; the others go
    on.  Their rows and reports are staged, and each run's directory gets its name in one
    step; then the runs are committed.  Whatever a writer that died has left is taken up: a
    directory that is there is whole, and must hold the rows and the report that are found again, or
    it is an error, as runs are immutable.  A rerun finds nothing to do.  Claims of dead
    processors are taken over when they are older than the lease.
    """
    files = LakeFiles(spark, lake)
    claims, call = Claims(files, lake, lease), uuid.uuid4().hex
    _sweep(files, lake, lease)
    staging = f"{lake}/staging/{call}"
    files.make(staging)
    try:
        batch = 0
        while _next_batch(spark, lake, files, claims, f"{staging}/{batch}", f"{staging}/left", runs_at_once):
            batch += 1
    finally:
        for run in list(claims.held):
            claims.release(run)
        files.delete(staging)
    return commit_log(spark, lake).select("run_id", "endpoint", "dataset", "row_count").distinct()


def _sweep(files: LakeFiles, lake: str, lease: timedelta) -> None:
    """Removes what calls staged that died twice the lease ago."""
    for name, at in files.names(f"{lake}/staging"):
        if time.time() * 1000 - at > 2000 * lease.total_seconds():
            files.delete(f"{lake}/staging/{name}")


def _kept(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_file(rows: DataFrame, files: LakeFiles, staging: str, table: str) -> None:
    """Adds rows, few for each run, to a table as one file: it is there as a whole or not at all.

    Spark's own append would share a folder with those of other processors, and the first that ends removes it.
    """
    rows.coalesce(1).write.parquet(staging)
    for part in files.matching(f"{staging}/part-*"):
        files.move(part, f"{table}/{part.rsplit('/', 1)[1]}")


def _next_batch(spark: SparkSession, lake: str, files: LakeFiles, claims: Claims, path: str, left_path: str, runs_at_once: int) -> bool:
    """Works on the oldest pending runs that this call hasn't left aside; false if there are none."""
    left = _table(spark, left_path, "run_id string")
    waiting = pending_runs(L.scan_manifests(spark, lake), commit_log(spark, lake)).join(left, "run_id", "left_anti")
    oldest = waiting.groupBy("run_id").agg(F.min("captured_at").alias("at")).orderBy("at", "run_id").limit(runs_at_once)
    # Manifests are small: one row for each run.  Written, so that all steps see the same runs.
    todo = _kept(waiting.join(F.broadcast(oldest.select("run_id")), "run_id", "left_semi"), f"{path}/manifests")
    runs = sorted(r.run_id for r in todo.select("run_id").distinct().collect())
    if not runs:
        return False
    mine = spark.createDataFrame([(r,) for r in runs if claims.take(r)], "run_id string")
    # Others may have committed some of them before they were claimed.
    todo = _kept(pending_runs(todo, commit_log(spark, lake)).join(mine, "run_id", "left_semi"), f"{path}/claimed")
    verdicts = _kept(L.run_verdicts(todo, L.listed_lineage(spark, todo)), f"{path}/verdicts")
    bad = verdicts.where("not intact").drop("intact")
    known = _table(spark, f"{lake}/rejected", VERDICTS)
    new = bad.join(known, known.columns, "left_anti")
    if not new.isEmpty():
        append_file(new.withColumn("rejected_at", F.current_timestamp()), files, f"{path}/rejected", f"{lake}/rejected")
    intact = _kept(todo.join(verdicts.where("intact"), "run_id", "left_semi"), f"{path}/intact")
    if not intact.isEmpty():
        _process_batch(spark, lake, files, claims, intact, path)
    # Whatever isn't committed now is rejected or somebody else's.
    spark.createDataFrame([(r,) for r in runs], "run_id string").write.mode("append").parquet(left_path)
    for run in list(claims.held):
        claims.release(run)
    return True


def rejected_runs(spark: SparkSession, lake: str) -> DataFrame:
    """The runs that were rejected and aren't committed since, as they were seen last: how many pages are listed, missing, altered and miscounted."""
    seen = _table(spark, f"{lake}/rejected", f"{VERDICTS}, rejected_at timestamp")
    last = seen.groupBy("endpoint", "run_id").agg(F.max_by(F.struct("manifests", "pages", "missing", "mismatched", "miscounted", "rejected_at"), "rejected_at").alias("v"))
    done = commit_log(spark, lake).select("endpoint", "run_id").distinct()
    return last.select("endpoint", "run_id", "v.*").join(done, ["endpoint", "run_id"], "left_anti")


def _process_batch(spark: SparkSession, lake: str, files: LakeFiles, claims: Claims, todo: DataFrame, staging: str) -> None:
    """Stages, publishes, reports and commits the runs of todo."""
    found, staged = process(spark, todo), {}
    for dataset in DATASETS:
        L.stage_processed(found[dataset], f"{staging}/processed", dataset)
        # Read while they are here: publication moves them away.
        at = files.matching(f"{staging}/processed/dataset={dataset}")
        staged[dataset] = spark.read.schema(f"{PROCESSED[dataset]}, {L.PATH_COLUMNS}").option("basePath", f"{staging}/processed").parquet(*at) if at else spark.createDataFrame([], f"{PROCESSED[dataset]}, {L.PATH_COLUMNS}")
    reports = _kept(quality_reports(todo, staged["stations"], staged["observations"]), f"{staging}/reports")
    L.stage_reports(reports, f"{staging}/quality")
    counts = {d: _kept(staged[d].groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count")), f"{staging}/counts-{d}") for d in DATASETS}
    lost = claims.lost()
    if lost:
        raise RuntimeError(f"the lease of these runs was over before they were published: {lost[:10]}")
    folders = {}
    for dataset in DATASETS:
        moved, taken = L.publish_runs(files, f"{staging}/processed/dataset={dataset}", f"{lake}/processed/dataset={dataset}", 5)
        folders[dataset] = moved | taken
        _same_rows(spark, lake, dataset, taken, counts[dataset])
    publish_reports(spark, lake, files, f"{staging}/quality", reports)
    planned = committed_runs(todo, commit_log(spark, lake).limit(0), spark.createDataFrame([], "run_id string, dataset string")).select("run_id", "endpoint", "dataset")
    held = [_held_files(spark, lake, d, folders[d]) for d in DATASETS]
    done = planned.join(held[0].unionByName(held[1]), ["run_id", "dataset"], "left")
    commits = done.select("run_id", "endpoint", "dataset", F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"), F.current_timestamp().alias("committed_at"), "folder", "columns", "files")
    append_file(commits, files, f"{staging}/commits", f"{lake}/commits")


def _same_rows(spark: SparkSession, lake: str, dataset: str, taken: dict[str, str], counts: DataFrame) -> None:
    """An error if directories that were there before hold other numbers of rows than their runs have."""
    if taken:
        held = L.scan_folders(spark, lake, dataset, taken.values()).groupBy("run_id").agg(F.count(F.lit(1)).alias("held"))
        there = spark.createDataFrame([(r,) for r in taken], "run_id string").join(held, "run_id", "left")
        odd = there.join(counts, "run_id", "left").where("not (held <=> row_count)").limit(10).collect()
        if odd:
            raise ValueError(f"{dataset} without a commit have other rows than their run: {[(r.run_id, r.held, r.row_count) for r in odd]}")


def _held_files(spark: SparkSession, lake: str, dataset: str, folders: dict[str, str]) -> DataFrame:
    """What runs' directories hold: one row for each run, with its rows, columns and files."""
    if not folders:
        return spark.createDataFrame([], f"run_id string, row_count bigint, files {FILES}, folder string, dataset string, columns string")
    at, station = F.col(TIMES[dataset]), F.col("station_id")
    rows = L.scan_folders(spark, lake, dataset, folders.values()).select("run_id", F.col("_metadata.file_name").alias("name"), at.alias("at"), station.alias("station"))
    of_file = rows.groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("station").alias("first_station"), F.max("station").alias("last_station"))
    files = of_file.groupBy("run_id").agg(F.sum("rows").alias("row_count"), F.array_sort(F.collect_list(F.struct("name", "rows", "first_at", "last_at", "first_station", "last_station"))).alias("files"))
    root = f"{lake}/"
    places = spark.createDataFrame([(r, f.removeprefix(root)) for r, f in folders.items()], "run_id string, folder string")
    return files.join(F.broadcast(places), "run_id").withColumns({"dataset": F.lit(dataset), "columns": F.lit(PROCESSED[dataset])})


def publish_reports(spark: SparkSession, lake: str, files: LakeFiles, staging: str, reports: DataFrame) -> None:
    """Gives each run's report its place, quality/…/run-<id>/report.json; one that is there must be the same, or it is an error."""
    for part in files.matching(f"{staging}/*/*/*/*/*/*/part-*"):
        files.move(part, f"{part.rsplit('/', 1)[0]}/report.json")
    _, taken = L.publish_runs(files, staging, f"{lake}/quality", 5)
    if taken:
        at = sorted(f"{x}/report.json" for x in taken.values() if files.exists(f"{x}/report.json"))
        there = spark.read.schema("value string").option("wholetext", True).text(at) if at else spark.createDataFrame([], "value string")
        there = there.select(F.get_json_object("value", "$.run_id").alias("run_id"), F.regexp_replace("value", r"\n$", "").alias("known"))
        asked = spark.createDataFrame([(r,) for r in taken], "run_id string")
        compared = asked.join(reports.select("run_id", L.report_text(reports).alias("said")), "run_id").join(there, "run_id", "left")
        changed = compared.where("not (known <=> said)").limit(10).collect()
        if changed:
            raise ValueError(f"reports differ from those that are there: {[r.run_id for r in changed]}")


def read_reports(spark: SparkSession, lake: str, schema: str) -> DataFrame:
    """(endpoint, run_id, report): the reports as structs of the schema."""
    texts = L._files(spark, f"{lake}/quality/endpoint=*/*/*/*/*/*/report.json", "text", "value string", wholetext=True)
    of = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return texts.select(of("endpoint"), of("run_id"), F.from_json("value", schema).alias("report"))


def run_catalog(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each idempotency prefix (event-<uuid>) of run ids in paths (path): its next attempt, and its completed run.

    Runs are named <prefix>-attempt-NNNN; other names are ignored.  Several completed
    runs of one prefix are marked as a conflict.
    """
    uuid = "event-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    named = r"run_id=(" + uuid + r")-attempt-(\d{4})(?:/|$)"
    tried = paths.select(F.regexp_extract("path", named, 1).alias("prefix"), F.regexp_extract("path", named, 2).alias("attempt")).where("prefix <> ''")
    last = tried.groupBy("prefix").agg((F.max(F.col("attempt").cast("int")) + 1).alias("next_attempt"))
    ended = manifests.where("status = 'completed'").select(F.regexp_extract("run_id", f"^({uuid})-attempt-\\d{{4}}$", 1).alias("prefix"), "run_id").where("prefix <> ''")
    done = ended.groupBy("prefix").agg(F.min("run_id").alias("completed_run"), F.countDistinct("run_id").alias("completed_runs"))
    return last.join(done, "prefix", "left").select("prefix", "next_attempt", "completed_run", (F.coalesce("completed_runs", F.lit(0)) > 1).alias("conflict"))
