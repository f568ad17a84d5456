"""What must not grow faster than the input: files, tasks of one run, and how often a record is looked at."""

import json
from pathlib import Path

from pyspark.sql import functions as F

import pytest

from tidemark.operators import events as E
from tidemark.operators import quality, runs, transforms, validation
from tidemark.plans import testdata as D
from tidemark.schemas import RIVER, RIVER_STATIONS
from tidemark.sources import lake as L

EVENT = "event-00000000-0000-0000-0000-00000000000"


def events(spark, path, n, users):
    kinds = F.get(F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase"))), ((F.col("id") / users).cast("int") % 5))
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), (F.col("id") % users).alias("user_id"), kinds.alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_attempts_of_many_users_are_few_files(spark, tmp_path):
    lake = D.attempts_lake(spark, events(spark, tmp_path, 1500, 300))
    assert len([p for p in Path(lake.removeprefix("file:")).rglob("run_id=*") if p.is_dir()]) <= D.LOOSE_USERS * 5
    listed = L.lake_files(spark, lake)
    assert listed.where("path not like '%/run_id=%'").count() == 0 and listed.select("path").distinct().count() == listed.count() == 1500
    assert runs.run_catalog(listed, L.scan_manifests(spark, lake)).where("completed_run is not null and not conflict").count() == 300


def test_packed_files_are_listed_beside_others(spark, tmp_path):
    at = tmp_path / f"raw/provider=p/endpoint={RIVER_STATIONS}/run_id={EVENT}1-attempt-0001"
    at.mkdir(parents=True)
    (at / "x.json").write_text("{}")
    manifest = {"status": "completed", "endpoint": RIVER_STATIONS, "captured_at": "2026-09-01T00:00:00Z"}
    (tmp_path / "manifests").mkdir()
    (tmp_path / "manifests/a.json").write_text(json.dumps(manifest | {"run_id": f"{EVENT}2-attempt-0001"}))
    packed = [("quarantine", f"quarantine/run_id={EVENT}1-attempt-0003/x.json", "{}"), ("manifests", f"manifests/run_id={EVENT}1-attempt-0002/x.json", json.dumps(manifest | {"run_id": f"{EVENT}1-attempt-0002"}))]
    L.pack_files(spark.createDataFrame(packed, "kind string, path string, value string"), str(tmp_path))
    files, found = L.lake_files(spark, str(tmp_path)), L.scan_manifests(spark, str(tmp_path))
    assert sorted((r.kind, r.length) for r in files.collect() if r.kind != "manifests") == [("quarantine", 2), ("raw", 2)] and files.count() == 4
    assert L.lake_files(spark, str(tmp_path), ["quarantine"]).count() == 1
    assert {(r.run_id, r.captured_at.month) for r in found.collect()} == {(f"{EVENT}1-attempt-0002", 9), (f"{EVENT}2-attempt-0001", 9)}
    assert {r.prefix: (r.next_attempt, r.completed_run) for r in runs.run_catalog(files, found).collect()} == {f"{EVENT}1": (4, f"{EVENT}1-attempt-0002")}


@pytest.fixture
def whole_plans(spark):
    """Plans are said in full, and nothing is broadcast because it happens to be small."""
    names = {"spark.sql.debug.maxToStringFields": "100000", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield lambda df: df._jdf.queryExecution()
    for n, v in before.items():
        spark.conf.set(n, v)


def some_pages(spark):
    rows = [("river", "p", "r", 1, ['{"id": 1}', "[]", None]), ("river", "p", "r", 2, ['{"id": "x", "title": 1}'])]
    return spark.createDataFrame(rows, "endpoint string, provider string, run_id string, page_index int, results array<string>")


@pytest.mark.parametrize("endpoint", [RIVER, RIVER_STATIONS])
def test_a_record_is_judged_once(spark, whole_plans, endpoint):
    """Each field's type is asked once or, with its parts, a few times, also where issues are filtered by."""
    bad = validation.split_valid(validation.validate_records(some_pages(spark), endpoint))[1]
    assert whole_plans(bad).optimizedPlan().toString().count("variant_get(") <= 3 * len(validation.RULES[endpoint]) + 10
    assert sorted((r.record_index, len(r.issues) > 1) for r in bad.select("record_index", "issues").collect()) == [(0, True), (1, False), (2, False), (3, True)]


def test_records_of_a_run_are_not_brought_to_one_task(spark, whole_plans):
    runs_of = spark.createDataFrame([("r", 1), ("s", 2)], "run_id string, captured_at int")
    rows = L.explode_records(some_pages(spark), runs_of)
    assert "SortMergeJoin" not in whole_plans(rows).executedPlan().toString() and rows.where("ingested_at = 1").count() == 3
    done = spark.createDataFrame([("e", "c", "r"), ("f", "d", "t")], "event_id string, correlation_id string, run_id string")
    found = E.completion_receipts(done, runs_of.select("run_id", F.lit(5).alias("row_count"), F.current_timestamp().alias("completed_at")))
    assert "SortMergeJoin" not in whole_plans(found).executedPlan().toString() and found.count() == 1


def test_folders_are_listed_by_core(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with L.folders_by_core(spark):
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before


def test_an_event_is_hashed_and_looked_into_once(spark, whole_plans, tmp_path):
    """Each id of a line is one digest, and each field of a decoded one is read once, for its value and its error alike."""
    lines = D.pipeline_lines(spark, events(spark, tmp_path, 20, 4))
    assert whole_plans(lines).optimizedPlan().toString().count("md5(") == 4
    plain = spark.createDataFrame([("{}",)], "value string")
    assert whole_plans(E.decode_events(plain)).optimizedPlan().toString().count("try_variant_get(") <= 8
    found = {(r.line, r.event_id) for r in E.decode_events(lines).where("size(errors) = 0").collect()}
    assert found == {(r.line, r.uuid) for r in D.table(spark, str(tmp_path), "events").where("event_type in ('click', 'signup', 'purchase')").select(F.col("event_id").alias("line"), D.event_uuid(F.col("event_id")).alias("uuid")).collect()}


def test_a_record_is_parsed_once(spark, whole_plans):
    """Whatever is asked of its fields, also where rows are filtered by them."""
    ended = spark.createDataFrame([("r", None)], "run_id string, captured_at timestamp")
    for endpoint, of in ((RIVER, transforms.transform_historical_observations), (RIVER_STATIONS, transforms.transform_station_observations)):
        rows = of(L.parse_records(L.explode_records(some_pages(spark), ended), endpoint))
        assert whole_plans(rows).optimizedPlan().toString().count("from_json(") == 1


def test_rows_without_a_key_are_not_brought_to_one_task(spark, whole_plans):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(400).select(F.col("id").cast("string").alias("station_id"), F.when(F.col("id") < 0, "never").alias("station_series_id"), F.lit("n").alias("station_name"), F.lit("b").alias("basin_name"), F.lit("r").alias("run_id"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"))
        graded = quality.station_quality(rows).select("quality_status", F.spark_partition_id().alias("task"))
        assert {r.n > 50 for r in graded.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()} == {True} and graded.select("task").distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_summary_flags_rows_once(spark, whole_plans):
    lists = ((["a", "b"], ["w"]), (["b"], []), ([], ["w"]), ([], []))
    rows = spark.createDataFrame([("r", "fail", *lists[0]), ("r", "fail", *lists[1]), ("r", "warn", *lists[2]), ("s", "pass", *lists[3])], "run_id string, quality_status string, quality_errors array<string>, quality_warnings array<string>")
    out = quality.dataset_quality_summary(rows, ["run_id"])
    assert whole_plans(out).optimizedPlan().toString().count("LogicalRDD") + whole_plans(out).optimizedPlan().toString().count("LocalRelation") == 1
    found = {r.run_id: r for r in out.collect()}
    assert [tuple(x) for x in found["r"].error_counts] == [("a", 1), ("b", 2)] and [tuple(x) for x in found["r"].warning_counts] == [("w", 2)]
    assert (found["r"].total_rows, found["r"].pass_rows, found["r"].warn_rows, found["r"].fail_rows, found["r"].status) == (3, 0, 1, 2, "fail")
    assert (found["s"].error_counts, found["s"].warning_counts, found["s"].pass_rows, found["s"].status) == (None, None, 1, "pass")


def test_pages_of_many_events_are_few_files(spark, tmp_path, monkeypatch):
    """Packed pages are read, compared and processed as those in files of their own are."""
    monkeypatch.setattr(D, "PAGE_EVENTS", 10)
    sf_dir = events(spark, tmp_path / "sf", 600, 4)
    lake = D.raw_lake(spark, sf_dir)
    at = Path(lake.removeprefix("file:"))
    assert 0 < len([p for p in at.rglob("page=*") if p.is_dir()]) <= D.LOOSE_PAGES * 6
    known = {(r.endpoint, r.page): r.n for r in D.raw_records(spark, sf_dir).groupBy("endpoint", "page").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(known) > 60 and {(r.endpoint, r.page_index): r.record_count for r in L.raw_lineage(spark, lake).collect()} == known
    for endpoint in (RIVER, RIVER_STATIONS):
        mine = {page: n for (e, page), n in known.items() if e == endpoint}
        assert {r.page_index: r.records for r in L.raw_page_counts(L.scan_raw_pages(spark, lake, endpoint, typed=False)).collect()} == mine
        assert L.scan_raw_pages(spark, lake, endpoint, f"run-0-{endpoint}").count() == len(mine) and L.scan_raw_pages(spark, lake, endpoint, "run-9").count() == 0
        assert {r.page_index for r in L.scan_listed_pages(spark, L.scan_manifests(spark, lake), endpoint).collect()} == set(mine)

    def harm(rows):
        """One packed page of the snapshots is said to be other bytes."""
        odd = lambda p: p.withField("payload_sha256", F.when((F.col("endpoint") == RIVER_STATIONS) & (p["page_index"] == 50), "0").otherwise(p["payload_sha256"]))
        return rows.withColumn("raw_pages", F.transform("raw_pages", odd))

    other = str(tmp_path / "other")
    D.add_manifests(spark, sf_dir, other, F.lit(True), harm)
    good = D.raw_records(spark, sf_dir).where((F.col("endpoint") == RIVER) & (F.col("event_id") % 41 != 0)).count()
    assert [(r.run_id, r.row_count) for r in runs.process_runs_idempotent(spark, other).collect()] == [(f"run-0-{RIVER}", good)]
    assert [(r.run_id, r.missing, r.mismatched, r.miscounted) for r in runs.rejected_runs(spark, other).collect()] == [(f"run-0-{RIVER_STATIONS}", 0, 1, 0)]
