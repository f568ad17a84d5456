"""The lake: paths, scans of raw pages, manifests and processed tables, and sinks.

Raw pages are JSON files below
``raw/provider=…/endpoint=…/year=…/month=…/day=…/hour=…/run_id=…/page=N/``; processed
tables are Parquet below ``processed/dataset=…/endpoint=…/year=…/month=…/day=…/hour=…/run-…``,
reports are JSON below ``quality/endpoint=…/year=…/…/hour=…/run-…``.  What a run has is a
directory, which is staged elsewhere and gets its name in one step: it is whole or not there.
Small files that don't change any more may be packed: ``packs/kind=…/`` keeps the path below
the lake's root and the text of many in one Parquet file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import MANIFEST, PROCESSED, TEXT_PAGE, fields, page_schema, record_schema
from tidemark.sources.files import LakeFiles, value_in_path

PAGE_IN_PATH = r"page=(\d+)/[^/]+$"


#: What globs give a meaning to.
PATTERN_MARKS = set("\\*?{}[]")


class MissingDataset(ValueError):
    """The lake holds no files of a data set."""


class RunExists(ValueError):
    """A run's output is there already."""


def lake_path(kind: str, provider: Column, endpoint: Column, captured_at: Column, run_id: Column, *rest: Column) -> Column:
    """The key of a run's files in the lake, from the UTC time of capture."""
    hours = F.date_format(F.to_utc_timestamp(captured_at, F.current_timezone()), "'year='yyyy'/month='MM'/day='dd'/hour='HH")
    return F.concat_ws("/", F.lit(kind), F.concat(F.lit("provider="), provider), F.concat(F.lit("endpoint="), endpoint), hours, F.concat(F.lit("run_id="), run_id), *rest)


def page_key(index: Column) -> Column:
    return F.format_string("page=%06d/payload.json", index)


@contextmanager
def folders_by_core(spark: SparkSession) -> Iterator[None]:
    """What is loaded meanwhile is listed by some tasks for each core; else each of up to 10 000 folders is a task of its own."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _files(spark: SparkSession, root: str, fmt: str, schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options).format(fmt)
    try:
        with folders_by_core(spark):
            return (reader.schema(schema) if schema else reader).load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise MissingDataset(f"no files below {root}") from e
        raise


def pages_of_files(files: DataFrame, endpoint: str) -> DataFrame:
    """The pages' fields, and provider, run_id, page_index and file from their paths."""
    return _pages(files.select("*", F.col("_metadata.file_path").alias("file")), endpoint)


def _pages(files: DataFrame, endpoint: str) -> DataFrame:
    file, fields_ = F.col("file"), [c for c in files.columns if c != "file"]
    return files.select(*fields_, F.lit(endpoint).alias("endpoint"), F.regexp_extract(file, r"provider=([^/]+)/", 1).alias("provider"), F.regexp_extract(file, r"run_id=([^/]+)/", 1).alias("run_id"), F.regexp_extract(file, PAGE_IN_PATH, 1).cast("int").alias("page_index"), "file")


def packed_pages(spark: SparkSession, lake: str) -> DataFrame | None:
    """(path below the lake's root, file: the whole path, value) of the packed raw pages; None if there are no packs of them."""
    files, at = LakeFiles(spark, lake), f"{lake}/packs/kind=raw"
    if not files.exists(at):
        return None
    return spark.read.schema("path string, value string").parquet(at).select("path", F.concat(F.lit(f"{files.whole(lake)}/"), "path").alias("file"), "value")


def _parsed_pages(packed: DataFrame, endpoint: str, schema: str) -> DataFrame:
    # Generated: filters pushed below, as those of an explode, would parse each page again.
    parsed = packed.where(F.col("path").contains(f"/endpoint={endpoint}/")).select("file", F.explode(F.array(F.from_json("value", schema))).alias("page"))
    return _pages(parsed.select("page.*", "file"), endpoint)


def listed_folders(spark: SparkSession, manifests: DataFrame) -> list[str]:
    """The folders of the manifests' runs, as far as they are there; one path for each run reaches the driver.

    Names that a reader would take for patterns are left out.
    """
    keys = manifests.select(F.explode("raw_pages.payload_key").alias("key"))
    at = sorted(r.at for r in keys.select(F.regexp_extract("key", r"^(.*/run_id=[^/]+)/", 1).alias("at")).distinct().collect() if r.at and not set(r.at.rsplit("/", 1)[1]) & PATTERN_MARKS)
    if not at:
        return []
    files = LakeFiles(spark, at[0])
    return [p for p in at if files.exists(p)]


def listed_packs(spark: SparkSession, manifests: DataFrame) -> DataFrame | None:
    """The packed pages of the manifests' runs; None if their lakes have no packs.

    One range of paths for each lake reaches the driver: other row groups of the packs aren't read.
    """
    page = F.regexp_extract("key", "^.*/(raw/provider=.*)$", 1)
    keys = manifests.select(F.explode("raw_pages.payload_key").alias("key")).select(F.regexp_extract("key", "^(.*)/raw/provider=", 1).alias("root"), page.alias("path")).where("path <> ''")
    folder, found = F.regexp_extract("path", "^(.*/run_id=[^/]+)/", 1), None
    for r in keys.groupBy("root").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect():
        packed = packed_pages(spark, r.root)
        if packed is not None:
            runs = keys.where(F.col("root") == r.root).select(folder.alias("folder")).distinct()
            packed = packed.where(F.col("path").between(r.first, r.last)).withColumn("folder", folder).join(F.broadcast(runs), "folder", "left_semi").drop("folder")
            found = packed if found is None else found.unionByName(packed)
    return found


def scan_listed_pages(spark: SparkSession, manifests: DataFrame, endpoint: str) -> DataFrame:
    """The pages of the endpoint that the manifests list, records as JSON texts.  Only these runs' directories, and packed pages, are read."""
    of_endpoint = manifests.where(F.col("endpoint") == endpoint)
    at, packed = listed_folders(spark, of_endpoint), listed_packs(spark, of_endpoint)
    pages = None if packed is None else _parsed_pages(packed, endpoint, TEXT_PAGE)
    if at:
        with folders_by_core(spark):
            loose = pages_of_files(spark.read.schema(TEXT_PAGE).option("recursiveFileLookup", True).json(at), endpoint)
        pages = loose if pages is None else loose.unionByName(pages)
    if pages is None:
        return spark.createDataFrame([], f"{TEXT_PAGE}, endpoint string, provider string, run_id string, page_index int, file string")
    keys = of_endpoint.select("run_id", F.explode("raw_pages.payload_key").alias("key"))
    listed = keys.select("run_id", F.regexp_extract("key", PAGE_IN_PATH, 1).cast("int").alias("page_index")).distinct()
    return pages.join(F.broadcast(listed), ["run_id", "page_index"], "left_semi").select(pages.columns)


def scan_raw_pages(spark: SparkSession, lake: str, endpoint: str, run_id: str | None = None, *, typed: bool = True) -> DataFrame:
    """Pages of an endpoint (of one run, if it is named), packed ones too: the page's fields, and provider, run_id, page_index and file from its path.

    typed: records as structs; else each as its JSON text, so that an element that is
    no object doesn't take the page's others with it.
    """
    runs = f"run_id={run_id}" if run_id is not None else "run_id=*"
    at = f"{lake}/raw/provider=*/endpoint={endpoint}/*/*/*/*/{runs}"
    schema, packed = page_schema(endpoint) if typed else TEXT_PAGE, packed_pages(spark, lake)
    if packed is None:
        return pages_of_files(_files(spark, at, "json", schema, recursiveFileLookup=True), endpoint)
    pages = _parsed_pages(packed if run_id is None else packed.where(F.col("path").contains(f"/{runs}/")), endpoint, schema)
    try:
        return pages_of_files(_files(spark, at, "json", schema, recursiveFileLookup=True), endpoint).unionByName(pages)
    except MissingDataset:  # all of them are packed
        return pages


def require_pages(pages: DataFrame) -> DataFrame:
    if pages.isEmpty():
        raise MissingDataset("the run has no pages")
    return pages


def explode_records(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each record that isn't null: record, provider, run_id, source_page_index, ingested_at.

    runs (run_id, captured_at) gives each run its time of capture; a page of an
    unknown run has none.  It is broadcast, one small row for each run: a shuffle would bring
    all records of a run to one task.
    """
    rows = pages.select("endpoint", "provider", "run_id", F.col("page_index").alias("source_page_index"), F.explode("results").alias("record")).where("record is not null")
    return rows.join(F.broadcast(runs.select("run_id", F.col("captured_at").alias("ingested_at"))), "run_id", "left")


def parse_records(rows: DataFrame, endpoint: str) -> DataFrame:
    """explode_records' rows of text pages with typed records; elements that are no objects are left out.

    Generated: filters on records or their fields, pushed below, would parse each text again.
    """
    typed = F.when(F.ltrim("record").startswith("{"), F.from_json("record", record_schema(endpoint)))
    return rows.select(*(F.explode(F.array(typed)).alias(c) if c == "record" else c for c in rows.columns)).where("record is not null")


def raw_page_counts(pages: DataFrame) -> DataFrame:
    """For each page the records read, beside the count that it states."""
    return pages.select("endpoint", "run_id", "page_index", F.coalesce(F.size("results"), F.lit(0)).alias("records"), F.col("count").alias("stated"))


def scan_processed(spark: SparkSession, lake: str, dataset: str) -> DataFrame:
    """All files of a data set with the columns of their path; files that lack a column give nulls.

    Every file's footer is read for its columns: `tidemark.operators.runs.scan_committed` takes them from the commits.
    """
    root = f"{lake}/processed"
    df = _files(spark, f"{root}/dataset={dataset}", "parquet", None, mergeSchema=True, basePath=root)
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(None).cast(t).alias(n) for n, t in fields(PROCESSED[dataset]).items() if n.lower() not in have))


PATH_COLUMNS = "dataset string, endpoint string, year int, month int, day int, hour int"


def scan_folders(spark: SparkSession, lake: str, dataset: str, folders: Iterable[str], columns: str | None = None) -> DataFrame:
    """Rows of a data set in some folders or files of it: nothing else is listed or opened."""
    at, schema = sorted(folders), f"{columns or PROCESSED[dataset]}, {PATH_COLUMNS}"
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{lake}/processed").parquet(*at)


def scan_hours(spark: SparkSession, lake: str, dataset: str, hours: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """Rows of a data set in some (endpoint, year, month, day, hour) in UTC: only their directories are listed and read."""
    files = LakeFiles(spark, lake)
    at = ["{}/processed/dataset={}/endpoint={}/year={:04}/month={:02}/day={:02}/hour={:02}".format(lake, dataset, *h) for h in set(hours)]
    return scan_folders(spark, lake, dataset, filter(files.exists, at))


def scan_manifests(spark: SparkSession, lake: str) -> DataFrame:
    """Completed run manifests, packed ones too, that have what a manifest must have.  Page keys below the lake's root are made whole paths."""
    rows = _files(spark, f"{lake}/manifests", "json", MANIFEST, recursiveFileLookup=True).withColumn("modified_at", F.col("_metadata.file_modification_time"))
    if LakeFiles(spark, lake).exists(f"{lake}/packs/kind=manifests"):
        packed = packed_files(spark, lake).where("kind = 'manifests'")
        rows = rows.unionByName(packed.select(F.from_json("value", MANIFEST).alias("m"), "modified_at").select("m.*", "modified_at"))
    rows = rows.withColumn("raw_pages", F.transform("raw_pages", lambda p: p.withField("payload_key", absolute_key(lake, p["payload_key"]))))
    return rows.where((F.col("status") == "completed") & F.col("run_id").isNotNull() & F.col("endpoint").isNotNull() & F.col("captured_at").isNotNull())


def latest_manifest(manifests: DataFrame, by: str = "captured_at") -> DataFrame:
    """The newest manifest of each endpoint, by time of capture (or modified_at)."""
    best = manifests.groupBy("endpoint").agg(F.max(F.struct(by, "run_id")).alias("best"))
    return manifests.join(best.select("endpoint", F.col("best.run_id").alias("run_id")), ["endpoint", "run_id"], "left_semi")


def absolute_key(lake: str, key: Column) -> Column:
    return F.when(key.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), key).otherwise(F.concat(F.lit(f"{lake}/"), key))


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, of which there are several spellings."""
    return F.regexp_replace(path, "^file:/+", "/")


def _lineage(files: DataFrame) -> DataFrame:
    page = F.from_json(F.col("content").cast("string"), TEXT_PAGE)
    return files.select(
        F.regexp_extract("path", r"endpoint=([^/]+)/", 1).alias("endpoint"), F.regexp_extract("path", r"run_id=([^/]+)/", 1).alias("run_id"), F.regexp_extract("path", PAGE_IN_PATH, 1).cast("int").alias("page_index"),
        F.coalesce(F.size(page["results"]), F.lit(0)).cast("long").alias("record_count"), plain_path(F.col("path")).alias("payload_key"),
        F.col("length").alias("payload_size_bytes"), F.sha2("content", 256).alias("payload_sha256"),
    )


def _packed_bytes(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("file").alias("path"), F.encode("value", "utf-8").alias("content"), F.octet_length("value").cast("bigint").alias("length"))


def raw_lineage(spark: SparkSession, lake: str, endpoint: str = "*") -> DataFrame:
    """Size, SHA-256 and number of records of each raw page (of all endpoints, or one), packed ones too, from one reading of its bytes."""
    at, packed = f"{lake}/raw/provider=*/endpoint={endpoint}/*/*/*/*/run_id=*", packed_pages(spark, lake)
    if packed is None:
        return _lineage(_files(spark, at, "binaryFile", None, recursiveFileLookup=True))
    pages = _lineage(_packed_bytes(packed if endpoint == "*" else packed.where(F.col("path").contains(f"/endpoint={endpoint}/"))))
    try:
        return _lineage(_files(spark, at, "binaryFile", None, recursiveFileLookup=True)).unionByName(pages)
    except MissingDataset:  # all of them are packed
        return pages


def listed_lineage(spark: SparkSession, manifests: DataFrame) -> DataFrame:
    """What `raw_lineage` gives, of the manifests' runs alone; runs without a folder or packed pages have no rows."""
    at, packed = listed_folders(spark, manifests), listed_packs(spark, manifests)
    pages = None if packed is None else _lineage(_packed_bytes(packed))
    if at:
        with folders_by_core(spark):
            loose = _lineage(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at))
        pages = loose if pages is None else loose.unionByName(pages)
    return pages if pages is not None else spark.createDataFrame([], "endpoint string, run_id string, page_index int, record_count bigint, payload_key string, payload_size_bytes bigint, payload_sha256 string")


def verify_lineage(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """For each page that a manifest lists, whether its file is there and as it was: ok, missing, mismatch or miscounted.

    miscounted: the bytes are the same, but they don't hold as many records as the manifest says.
    """
    page = manifests.schema["raw_pages"].dataType.elementType.names
    wanted = F.col("page.record_count") if "record_count" in page else F.lit(None).cast("long")
    listed = manifests.select("endpoint", "run_id", F.explode("raw_pages").alias("page")).select("endpoint", "run_id", "page.page_index", "page.payload_key", "page.payload_sha256", wanted.alias("wanted"))
    found = files.select(F.col("payload_key").alias("found_key"), F.col("payload_sha256").alias("found_sha256"), F.col("record_count").alias("found"))
    status = (
        F.when(F.col("found_sha256").isNull(), "missing").when(~F.col("found_sha256").eqNullSafe(F.col("payload_sha256")), "mismatch")
        .when(F.col("wanted") != F.col("found"), "miscounted").otherwise("ok")
    )
    return listed.join(found, plain_path(F.col("payload_key")) == F.col("found_key"), "left").select("endpoint", "run_id", "page_index", "payload_key", status.alias("status"))


def run_verdicts(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(endpoint, run_id, manifests, pages, missing, mismatched, miscounted, intact) of each run.

    A run is intact if it has one manifest, which lists pages, all of them are ok, and its name can be one of a directory.
    """
    pages = verify_lineage(manifests, files).groupBy("endpoint", "run_id")
    states = pages.agg(F.count(F.lit(1)).alias("pages"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("missing", "missing"), ("mismatch", "mismatched"), ("miscounted", "miscounted"))))
    runs = manifests.groupBy("endpoint", "run_id").agg(F.count(F.lit(1)).alias("manifests"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = runs.join(states, ["endpoint", "run_id"], "left").select("endpoint", "run_id", "manifests", *(zero(c) for c in ("pages", "missing", "mismatched", "miscounted")))
    named = ~F.col("run_id").rlike(r"[/=\\*?{}\[\]]|^\s*\.{0,2}\s*$")
    return joined.withColumn("intact", F.expr("manifests = 1 and pages > 0 and missing + mismatched + miscounted = 0") & named)


def hour_columns(captured_at: str) -> dict[str, Column]:
    """year, month, day and hour of a time in UTC, as they are written in paths."""
    at = F.to_utc_timestamp(F.col(captured_at), F.current_timezone())
    return {name: F.date_format(at, kind) for name, kind in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))}


_RUN = "_run"


def stage_processed(df: DataFrame, root: str, dataset: str, captured_at: str = "ingested_at") -> None:
    """Writes rows (endpoint, run_id and the data set's columns) below a staging folder, a directory for each run.

    A run's rows are brought together, as far as Spark thinks them few enough for a task; so runs have few files.
    """
    stamped = df.withColumns({"dataset": F.lit(dataset), **hour_columns(captured_at), _RUN: F.col("run_id")})
    path = ["dataset", "endpoint", "year", "month", "day", "hour", _RUN]
    stamped.hint("rebalance", *path[1:]).write.mode("append").option("compression", "snappy").partitionBy(*path).parquet(root)


def publish_runs(files: LakeFiles, staging: str, root: str, depth: int) -> tuple[dict[str, str], dict[str, str]]:
    """Moves each run's staged directory to its place: (those moved, those whose place was taken), run by run.

    staging and root have the same `depth` levels of directories above a run's.  One name for each run reaches the driver.
    """
    moved, taken = {}, {}
    for folder in sorted(files.matching("/".join([staging, *["*"] * depth, f"{_RUN}=*"]))):
        run = value_in_path(folder)
        # A segment of a path that no reader takes for a pattern or a partition.
        if set(run) & {"/", "=", *PATTERN_MARKS} or run.strip() in ("", ".", ".."):
            raise ValueError(f"{run!r} is no name for a run")
        parts = folder.split("/")
        levels = parts[len(parts) - 1 - depth : -1]
        target = "/".join([root, *levels, f"run-{run}"])
        (moved if files.move(folder, target) else taken)[run] = target
    return moved, taken


def write_processed(df: DataFrame, lake: str, dataset: str, captured_at: str = "ingested_at") -> None:
    """Writes runs' rows (endpoint, run_id and the data set's columns), each run to a directory that must not be there yet.

    Raises RunExists if some are; the others are written.
    """
    spark, staging = df.sparkSession, f"{lake}/staging/{uuid.uuid4().hex}"
    files = LakeFiles(spark, lake)
    try:
        stage_processed(df, f"{staging}/processed", dataset, captured_at)
        _, taken = publish_runs(files, f"{staging}/processed", f"{lake}/processed", 6)
    finally:
        files.delete(staging)
    if taken:
        raise RunExists(f"{dataset} of these runs are there already: {sorted(taken)[:10]}")


def write_run(df: DataFrame, path: str) -> None:
    """Writes one run's table to a path of its own, which must not be there yet."""
    df.write.mode("errorifexists").option("compression", "snappy").parquet(path)


def write_quality_report(reports: DataFrame, path: str) -> None:
    """One JSON report for each run, below a directory of the run, which must not be there yet."""
    reports.select("run_id", report_text(reports).alias("value")).write.mode("errorifexists").partitionBy("run_id").text(path)


def report_text(reports: DataFrame) -> Column:
    """The canonical JSON of a report: fields in order, nulls said."""
    return F.to_json(F.struct(*sorted(reports.columns)), {"ignoreNullFields": "false"})


def stage_reports(reports: DataFrame, root: str) -> None:
    """Writes reports (endpoint, run_id, captured_at, …) below a staging folder, a directory with one file for each run."""
    stamped = reports.select("endpoint", *(c.alias(n) for n, c in hour_columns("captured_at").items()), F.col("run_id").alias(_RUN), report_text(reports).alias("value"))
    stamped.write.mode("append").partitionBy("endpoint", "year", "month", "day", "hour", _RUN).text(root)


def quarantine_envelopes(invalid: DataFrame, provider: str) -> DataFrame:
    """What is kept of each record that failed validation."""
    return invalid.select(F.lit(provider).alias("provider"), "endpoint", "run_id", "captured_at", "page_index", "record_index", F.col("raw").alias("raw_record"), "issues")


def write_quarantine(envelopes: DataFrame, path: str) -> None:
    envelopes.write.mode("append").partitionBy("endpoint", "run_id").json(path)


#: Pages are long texts: small row groups, as readers take many rows at once.
PAGE_PACKS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10}
PACK = "path string, value string, modified_at timestamp, kind string"


def pack_files(files: DataFrame, lake: str) -> None:
    """Adds files (kind, path below the lake's root, value: their text) to the lake's packs: a file for each of them is too much where they are many and small."""
    files.select("path", "value", F.current_timestamp().alias("modified_at"), "kind").write.mode("append").partitionBy("kind").parquet(f"{lake}/packs")


def pack_pages(pages: DataFrame, lake: str) -> None:
    """Adds raw pages (path below the lake's root, value: their text) to the lake's packs.  A page is packed or a file of its own, not both.

    In order of path, so that row groups of other endpoints and runs are passed over.
    """
    pages.select("path", "value", F.current_timestamp().alias("modified_at")).sortWithinPartitions("path").write.mode("append").options(**PAGE_PACKS).parquet(f"{lake}/packs/kind=raw")


def packed_files(spark: SparkSession, lake: str) -> DataFrame:
    return spark.read.schema(PACK).parquet(f"{lake}/packs")


def lake_files(spark: SparkSession, lake: str, kinds: Iterable[str] = ("raw", "quarantine", "manifests")) -> DataFrame:
    """(kind, path, length, modified_at) of every file below the lake's folders of some kinds, and of the packed ones; listed in parallel and not opened."""
    files, kinds = LakeFiles(spark, lake), list(kinds)
    at = [f"{lake}/{k}" for k in kinds if files.exists(f"{lake}/{k}")]
    rows = spark.createDataFrame([], "kind string, path string, length bigint, modified_at timestamp")
    if at:
        with folders_by_core(spark):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
        root = F.length(F.lit(files.whole(lake))) + 2
        below = F.expr("path").substr(root, F.length("path"))
        rows = listed.select(F.substring_index(below, "/", 1).alias("kind"), below.alias("path"), "length", F.col("modificationTime").alias("modified_at"))
    if files.exists(f"{lake}/packs"):
        packed = packed_files(spark, lake).where(F.col("kind").isin(kinds))
        rows = rows.unionByName(packed.select("kind", "path", F.octet_length("value").cast("bigint").alias("length"), "modified_at"))
    return rows


def compact(spark: SparkSession, lake: str, dataset: str, to: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrites a data set of many small files into few, by endpoint and day, at a new place."""
    scan_processed(spark, lake, dataset).repartition("endpoint", "year", "month", "day").write.option("maxRecordsPerFile", rows_per_file).partitionBy("endpoint", "year", "month", "day").parquet(to)
