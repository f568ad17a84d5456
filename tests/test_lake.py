"""Raw pages to processed tables: scans, transforms, validation, lineage, runs."""

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import clean_text, normalize_trend
from tidemark.operators import runs, transforms, validation
from tidemark.schemas import RIVER, RIVER_STATIONS
from tidemark.sources import lake as L
from tidemark.streaming.events import process_stream

GOOD = {"id": 5, "createdOn": "2026-09-01T00:00:00Z", "modifiedOn": "2026-09-01T00:00:00Z", "title": " Gauge ", "basin": "", "point": {"type": "Point", "coordinates": [85.5, 27.5]}, "waterLevel": 1.5, "waterLevelOn": "2026-09-01T05:45:00+05:45", "steady": "steady", "station": 44, "province": 3}


def put(lake: Path, endpoint: str, run: str, page: int, results: list) -> dict:
    at = lake / f"raw/provider=p/endpoint={endpoint}/year=2026/month=09/day=01/hour=00/run_id={run}/page={page:06d}/payload.json"
    at.parent.mkdir(parents=True)
    body = json.dumps({"count": 99, "next": None, "previous": None, "results": results}).encode()
    at.write_bytes(body)
    return {"page_index": page, "record_count": len(results), "payload_key": str(at), "payload_sha256": hashlib.sha256(body).hexdigest()}


def manifest(lake: Path, endpoint: str, run: str, pages: list, status: str = "completed") -> None:
    at = lake / f"manifests/endpoint={endpoint}/run_id={run}/manifest.json"
    at.parent.mkdir(parents=True)
    at.write_text(json.dumps({"manifest_version": 1, "status": status, "provider": "p", "endpoint": endpoint, "run_id": run, "captured_at": "2026-09-01T00:30:00Z", "raw_pages": pages}))


@pytest.fixture
def lake(tmp_path):
    station = {k: v for k, v in GOOD.items() if k != "station"}
    a = put(tmp_path, RIVER, "007", 1, [GOOD, None, GOOD | {"id": 6, "waterLevelOn": "never"}])
    b = put(tmp_path, RIVER, "007", 2, [GOOD | {"id": 7, "waterLevel": "wrong"}, "oops"])
    c = put(tmp_path, RIVER_STATIONS, "s1", 1, [station, station | {"id": 8, "waterLevelOn": None, "point": None}])
    manifest(tmp_path, RIVER, "007", [a, b])
    manifest(tmp_path, RIVER_STATIONS, "s1", [c])
    manifest(tmp_path, RIVER_STATIONS, "s2", [], "failed")
    return tmp_path


def captures(spark):
    return spark.createDataFrame([("007", datetime(2026, 9, 1, 0, 30)), ("s1", datetime(2026, 9, 1, 0, 30))], "run_id string, captured_at timestamp")


def test_scan_and_transform(spark, lake):
    typed = L.scan_raw_pages(spark, str(lake), RIVER, "007")
    assert {(r.run_id, r.page_index, None if r.results is None else len(r.results)) for r in typed.collect()} == {("007", 1, 3), ("007", 2, None)}
    text = L.scan_raw_pages(spark, str(lake), RIVER, typed=False)
    assert {(r.page_index, r.records, r.stated) for r in L.raw_page_counts(text).collect()} == {(1, 3, 99), (2, 2, 99)}
    rows = L.parse_records(L.explode_records(text, captures(spark)), RIVER)
    got = {r.source_record_id: r for r in transforms.transform_historical_observations(rows).collect()}
    assert set(got) == {"5", "6", "7"}
    r = got["5"]
    assert (r.station_id, r.latitude, r.longitude, r.observed_at, r.trend, r.source_page_index, r.ingested_at, r.river_name) == ("44", 27.5, 85.5, datetime(2026, 9, 1), "STABLE", 1, datetime(2026, 9, 1, 0, 30), None)
    assert got["6"].observed_at is None and got["7"].water_level_m is None
    snap = L.parse_records(L.explode_records(L.scan_raw_pages(spark, str(lake), RIVER_STATIONS, typed=False), captures(spark)), RIVER_STATIONS)
    s = {r.station_id: r for r in transforms.transform_stations(snap).collect()}
    assert s["5"].province_id == 3 and s["8"].latitude is None and s["5"].station_name == " Gauge "
    assert [r.source_record_id for r in transforms.transform_station_observations(snap).collect()] == ["station-snapshot:5:2026-09-01T05:45:00+05:45"]
    assert transforms.map_domain(snap, RIVER_STATIONS)["stations"].where("station_id = '5'").first().station_name == "Gauge"
    for f, endpoint in ((transforms.transform_stations, RIVER), (transforms.transform_historical_observations, RIVER_STATIONS)):
        with pytest.raises(ValueError):
            f(rows, endpoint)
    with pytest.raises(ValueError):
        L.scan_raw_pages(spark, str(lake), "other")
    with pytest.raises(L.MissingDataset):
        L.scan_processed(spark, str(lake), "stations")
    with pytest.raises(L.MissingDataset):
        L.require_pages(text.limit(0))


def test_expressions(spark):
    rows = spark.createDataFrame([(" rising ",), ("Falling",), ("steady",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(normalize_trend(F.col("x"))).collect()] == ["RISING", "FALLING", "STABLE", "UNKNOWN", "UNKNOWN"]
    assert [r[0] for r in spark.createDataFrame([("\t a b  ",), (" \n",), (None,)], "x string").select(clean_text(F.col("x"))).collect()] == ["a b", None, None]


@pytest.mark.parametrize(
    ("change", "issues"),
    [
        ({}, []),
        ({"extra": {"a": 1}, "dataSourceId": "x", "stationSeriesId": None, "id": "12", "waterLevel": "1.5", "elevation": 3}, []),
        ({"id": 5.5}, [("int_type", "id")]),
        ({"id": None}, [("int_type", "id")]),
        ({"title": 7}, [("string_type", "title")]),
        ({"waterLevel": "high"}, [("float_type", "waterLevel")]),
        ({"waterLevelOn": None}, [("datetime_type", "waterLevelOn")]),
        ({"station": ...}, [("missing", "station")]),
        ({"point": None}, [("model_type", "point")]),
        ({"point": {"type": "Line", "coordinates": [1.0]}}, [("literal_error", "point.type"), ("missing", "point.coordinates")]),
        ({"point": {"type": "Point", "coordinates": [1.0, 2.0, 3.0]}}, [("too_long", "point.coordinates")]),
        ({"point": {"type": "Point", "coordinates": [1, "x"]}}, [("float_type", "point.coordinates")]),
        ({"point": {"type": "Point", "coordinates": [1, 2], "z": 1}}, [("extra_forbidden", "point")]),
    ],
)
def test_rules(spark, change, issues):
    record = {k: v for k, v in (GOOD | change).items() if v is not ...}
    row = spark.createDataFrame([(json.dumps(record),)], "raw string").select(validation.validation_issues(F.try_parse_json("raw"), RIVER).alias("i")).first()
    assert sorted((i.error_type, ".".join(i.location)) for i in row.i) == sorted(issues)


def test_validation_and_metrics(spark, lake):
    checked = validation.validate_records(L.scan_raw_pages(spark, str(lake), RIVER, typed=False), RIVER, start_index=10)
    valid, invalid = validation.split_valid(checked)
    assert [r.record.id for r in valid.collect()] == [5]
    assert sorted((r.record_index, [i.error_type for i in r.issues]) for r in invalid.collect()) == [(11, ["model_type"]), (12, ["datetime_type"]), (13, ["float_type"]), (14, ["model_type"])]
    metrics = validation.ingestion_metrics(checked)
    assert metrics.first()[2:] == (5, 1, 4, 0, 1, 0) and validation.metrics_invariants(metrics).count() == 0
    assert validation.metrics_invariants(metrics.withColumn("records_valid", F.lit(0)).withColumn("quarantined", F.lit(4))).first().violations == ["valid_plus_invalid", "observations_above_valid"]


def test_lineage(spark, lake):
    manifests = L.scan_manifests(spark, str(lake))
    assert {r.run_id for r in manifests.collect()} == {"007", "s1"}
    files = lambda: L.raw_lineage(spark, str(lake), RIVER)
    river = manifests.where(F.col("endpoint") == RIVER)
    assert {r.status for r in L.verify_lineage(river, files()).collect()} == {"ok"}
    at = lake / f"raw/provider=p/endpoint={RIVER}/year=2026/month=09/day=01/hour=00/run_id=007"
    (at / "page=000001/payload.json").write_text("{}")
    (at / "page=000002/payload.json").rename(at / "page=000002/other.json")
    assert {r.page_index: r.status for r in L.verify_lineage(river, files()).collect()} == {1: "mismatch", 2: "missing"}


def test_runs_are_processed_once(spark, lake):
    first = sorted(map(tuple, runs.process_runs_idempotent(spark, str(lake)).collect()))
    assert first == [("007", RIVER, "observations", 3), ("s1", RIVER_STATIONS, "observations", 1), ("s1", RIVER_STATIONS, "stations", 2)]
    assert sorted(map(tuple, runs.process_runs_idempotent(spark, str(lake)).collect())) == first
    assert L.scan_processed(spark, str(lake), "observations").count() == 4
    kind = "station_summary struct<total_rows: bigint>, current_data_health struct<total_stations: bigint>"
    report = runs.read_reports(spark, str(lake), kind).where("run_id = 's1'").first().report
    assert report.station_summary.total_rows == 2 and report.current_data_health.total_stations == 2
    report_files = sorted(str(p.relative_to(lake)) for p in lake.glob("quality/**/*.json"))
    assert report_files == sorted(f"quality/endpoint={e}/year=2026/month=09/day=01/hour=00/run-{r}/report.json" for e, r in ((RIVER, "007"), (RIVER_STATIONS, "s1")))
    assert not list((lake / "staging").iterdir()) and not list(lake.glob("claims/*/*"))
    state = runs.committed_runs(L.scan_manifests(spark, str(lake)), runs.commit_log(spark, str(lake)).where("dataset <> 'stations'"), L.scan_processed(spark, str(lake), "stations").select("run_id", F.lit("stations").alias("dataset")))
    assert {(r.run_id, r.dataset): r.state for r in state.collect()} == {("007", "observations"): "complete", ("s1", "observations"): "complete", ("s1", "stations"): "incomplete"}
    L.compact(spark, str(lake), "observations", f"{lake}/compact")
    assert spark.read.parquet(f"{lake}/compact").count() == 4


def test_runs_go_in_batches_and_read_their_own_pages(spark, lake):
    put(lake, RIVER, "unlisted", 1, [GOOD])
    todo = L.scan_manifests(spark, str(lake))
    pages = L.scan_listed_pages(spark, todo, RIVER)
    assert {(r.run_id, r.page_index) for r in pages.collect()} == {("007", 1), ("007", 2)}
    assert not any("unlisted" in f for f in pages.inputFiles())
    assert L.scan_listed_pages(spark, todo.limit(0), RIVER).count() == 0
    assert runs.process_runs_idempotent(spark, str(lake), runs_at_once=1).count() == 3
    hours = [(RIVER, 2026, 9, 1, 0)]
    assert L.scan_hours(spark, str(lake), "observations", hours).count() == 3
    assert L.scan_hours(spark, str(lake), "observations", [(RIVER, 2020, 1, 1, 0)]).count() == 0


def test_rows_without_a_commit_are_an_error(spark, lake):
    L.write_processed(spark.createDataFrame([("007", RIVER, datetime(2026, 9, 1))], "run_id string, endpoint string, ingested_at timestamp"), str(lake), "observations")
    with pytest.raises(ValueError, match="without a commit"):
        runs.process_runs_idempotent(spark, str(lake))


def test_runs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a b", RIVER, datetime(2026, 9, 1, 5)), ("x%1", RIVER, datetime(2026, 9, 1, 6))], "run_id string, endpoint string, ingested_at timestamp")
    L.write_processed(rows, str(tmp_path), "observations")
    folders = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("processed/*/*/*/*/*/*/*"))
    assert folders == [f"processed/dataset=observations/endpoint={RIVER}/year=2026/month=09/day=01/hour={h}/run-{r}" for h, r in (("05", "a b"), ("06", "x%1"))]
    with pytest.raises(L.RunExists):
        L.write_processed(rows.limit(1), str(tmp_path), "observations")
    assert L.scan_processed(spark, str(tmp_path), "observations").count() == 2 and not list((tmp_path / "staging").iterdir())
    for bad in ("a/b", "..", " ", "a*", "{b}", "c=1"):
        with pytest.raises(ValueError, match="no name for a run"):
            L.write_processed(rows.limit(1).withColumn("run_id", F.lit(bad)), str(tmp_path), "observations")


def test_new_manifests_are_processed_as_they_come(spark, lake):
    for _ in range(2):
        process_stream(spark, str(lake), f"{lake}/state").awaitTermination()
    assert runs.commit_log(spark, str(lake)).count() == 3
    d = put(lake, RIVER, "008", 1, [GOOD | {"id": 70}])
    manifest(lake, RIVER, "008", [d])
    process_stream(spark, str(lake), f"{lake}/state").awaitTermination()
    assert L.scan_processed(spark, str(lake), "observations").where("run_id = '008'").count() == 1


def test_sinks_do_not_overwrite(spark, tmp_path):
    df = spark.range(2)
    L.write_run(df, f"{tmp_path}/run")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        L.write_run(df, f"{tmp_path}/run")


def test_paths(spark):
    key = L.lake_path("raw", F.lit("p"), F.lit(RIVER), F.lit(datetime(2026, 9, 1, 7, tzinfo=UTC)), F.lit("r"), L.page_key(F.lit(3)))
    assert spark.range(1).select(key).first()[0] == "raw/provider=p/endpoint=river/year=2026/month=09/day=01/hour=07/run_id=r/page=000003/payload.json"


def test_plain_records_are_told_by_their_types_and_others_by_the_rules(spark):
    point = lambda *at, **more: {"point": {"type": "Point", "coordinates": list(at)} | more}
    plain = [{}, point(85, 27.5), point(85, 27), {"basin": None, "waterLevel": 3, "province": None}, {"dataSourceId": "x", "image": "ä", "waterLevel": None}, {"createdOn": "2026-09-01"}, {"waterLevel": 1e300}]
    odd = [
        {"id": None}, {"id": "5"}, {"id": 5.0}, {"id": 5.5}, {"id": 10**30}, {"title": None}, {"title": 7}, {"basin": 1}, {"createdOn": "never"}, {"createdOn": 5}, {"createdOn": None}, {"waterLevelOn": "no time"},
        {"waterLevel": "1.5"}, {"waterLevel": True}, {"province": 1.5}, {"dataSourceId": 1.5}, {"unknown": 1}, {"a b": "x"}, {"affectedDemography": {"maleCount": "1", "femaleCount": 1.5}}, {"affectedDemography": 1},
        point(), point(1.5), point(1.5, 2.5, 3.5), point(1.5, None), point(None, None), point("1", 2.5), point("x", 2.5), point(1.5, True), point(1.5, 2.5, type="Line"), point(1.5, 2.5, type=None), point(1.5, 2.5, z=1), {"point": None}, {"point": [1, 2]},
        {"point": {"type": "Point"}}, {"point": {"coordinates": [1.5, 2.5]}}, {"point": {"type": "Point", "coordinates": 1}},
    ]
    for endpoint in (RIVER, RIVER_STATIONS):
        texts = [(n < len(plain), json.dumps(GOOD | more)) for n, more in enumerate(plain + odd)]
        texts += [(False, json.dumps({k: v for k, v in GOOD.items() if k != gone})) for gone in ("id", "title", "point", "createdOn")] + [(False, t) for t in ('"oops"', "null", "[]", "{}", "not json", '{"id":1,"id":2}')]
        if endpoint == RIVER_STATIONS:
            texts = [(p, json.dumps({k: v for k, v in json.loads(t).items() if k != "station"}) if t.startswith('{"id": ') else t) for p, t in texts]
        rows = spark.createDataFrame(texts, "plain boolean, text string")
        v = F.try_parse_json("text")
        told = rows.select("plain", "text", validation._is_plain(v, endpoint).alias("found"), validation.validation_issues(v, endpoint).alias("issues")).collect()
        assert [r.text for r in told if r.found != r.plain] == [] and all(not r.issues for r in told if r.found)
        pages = rows.groupBy().agg(F.collect_list("text").alias("results")).select(F.lit(endpoint).alias("endpoint"), F.lit("p").alias("provider"), F.lit("r").alias("run_id"), F.lit(0).alias("page_index"), "results")
        judged = {r.raw: r.issues for r in validation.validate_records(pages, endpoint).collect()}
        assert judged == {r.text: r.issues for r in told}
