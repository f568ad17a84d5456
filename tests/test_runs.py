"""Processing of runs: the gate by lineage, publication, claims, the catalog of files and the listing of attempts."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_lake import GOOD, lake, manifest, put  # noqa: F401  (a fixture)
from tidemark.operators import claims, receipts, runs
from tidemark.schemas import RIVER, RIVER_STATIONS
from tidemark.sources import lake as L
from tidemark.sources.files import LakeFiles
from tidemark.streaming.events import finished, process_stream

ALL = [("007", RIVER, "observations", 3), ("s1", RIVER_STATIONS, "observations", 1), ("s1", RIVER_STATIONS, "stations", 2)]


def process(spark, lake, **options):  # noqa: F811
    return sorted(map(tuple, runs.process_runs_idempotent(spark, str(lake), **options).collect()))


def rejected(spark, lake):  # noqa: F811
    return {r.run_id: (r.manifests, r.pages, r.missing, r.mismatched, r.miscounted) for r in runs.rejected_runs(spark, str(lake)).collect()}


def page(lake, run, n, endpoint=RIVER):  # noqa: F811
    return lake / f"raw/provider=p/endpoint={endpoint}/year=2026/month=09/day=01/hour=00/run_id={run}/page={n:06d}/payload.json"


def test_damaged_runs_are_rejected_until_they_are_whole(spark, lake):  # noqa: F811
    good = page(lake, "007", 1).read_bytes()
    page(lake, "007", 1).write_bytes(good.replace(b"5", b"6"))
    page(lake, "s1", 1, RIVER_STATIONS).rename(lake / "kept.json")
    d = put(lake, RIVER, "ok", 1, [GOOD])
    e = put(lake, RIVER, "few", 1, [GOOD, GOOD])
    f = put(lake, RIVER, "twice", 1, [GOOD])
    manifest(lake, RIVER, "ok", [d])
    manifest(lake, RIVER, "few", [e | {"record_count": 3}])
    manifest(lake, RIVER, "none", [])
    manifest(lake, RIVER, "no*name", [put(lake, RIVER, "no*name", 1, [GOOD])])
    manifest(lake, RIVER, "twice", [f])
    manifest(lake / "manifests/again", RIVER, "twice", [f])
    for _ in range(2):
        assert process(spark, lake, runs_at_once=2) == [("ok", RIVER, "observations", 1)]
        assert rejected(spark, lake) == {"007": (1, 2, 0, 1, 0), "s1": (1, 1, 1, 0, 0), "few": (1, 1, 0, 0, 1), "none": (1, 0, 0, 0, 0), "no*name": (1, 1, 1, 0, 0), "twice": (2, 2, 0, 0, 0)}
    assert spark.read.parquet(f"{lake}/rejected").count() == 6, "the same verdict is kept once"
    assert not list(lake.glob("claims/*/*")), "rejected runs aren't held"
    page(lake, "007", 1).write_bytes(good)
    (lake / "kept.json").rename(page(lake, "s1", 1, RIVER_STATIONS))
    finished(process_stream(spark, str(lake), f"{lake}/state"))
    assert process(spark, lake) == sorted([*ALL, ("ok", RIVER, "observations", 1)])
    assert set(rejected(spark, lake)) == {"few", "none", "no*name", "twice"}


def test_keys_below_the_root_are_found(spark, lake):  # noqa: F811
    d = put(lake, RIVER, "relative", 1, [GOOD])
    manifest(lake, RIVER, "relative", [d | {"payload_key": d["payload_key"].removeprefix(f"{lake}/")}])
    assert ("relative", RIVER, "observations", 1) in process(spark, lake)


class Gone(OSError):
    pass


def dies(monkeypatch, of, name, at, before=True):
    """The at-th call of of.name ends the machine, before or behind what it does."""
    calls, real = [], getattr(of, name)

    def run(*args, **named):
        calls.append(1)
        if len(calls) == at and before:
            raise Gone
        out = real(*args, **named)
        if len(calls) == at:
            raise Gone
        return out

    monkeypatch.setattr(of, name, run)


# A killed one does nothing at its end; others clean up behind themselves.
STEPS = [(False, L, "stage_processed", 2, True), (False, L, "publish_runs", 2, True), (True, LakeFiles, "move", 1, False), (False, LakeFiles, "move", 6, False), (False, runs, "publish_reports", 1, True), (True, runs, "append_file", 1, True)]


@pytest.mark.parametrize("step", STEPS, ids=["stage", "second table", "inside a move", "after a report", "reports", "commit"])
def test_a_processor_that_died_is_taken_up(spark, lake, monkeypatch, step):  # noqa: F811
    killed = step[0]
    with monkeypatch.context() as m:
        dies(m, *step[1:])
        if killed:
            m.setattr(claims.Claims, "release", lambda *_: None)
            m.setattr(LakeFiles, "delete", lambda *_: None)
        with pytest.raises(Gone):
            process(spark, lake)
    assert runs.commit_log(spark, str(lake)).count() == 0
    if killed:
        assert process(spark, lake) == [], "its claims hold"
        assert list((lake / "staging").iterdir()), "and what it staged may be in use"
    assert process(spark, lake, lease=timedelta(0) if killed else timedelta(hours=2)) == ALL
    assert L.scan_processed(spark, str(lake), "observations").count() == 4 and L.scan_processed(spark, str(lake), "stations").count() == 2
    assert runs.read_reports(spark, str(lake), "report_version int").count() == 2 and not list((lake / "staging").iterdir())


def test_two_processors_at_once(spark, lake):  # noqa: F811
    for i in range(3):
        manifest(lake, RIVER, f"r{i}", [put(lake, RIVER, f"r{i}", 1, [GOOD | {"id": i}])])
    failed = []

    def work():
        try:
            process(spark, lake, runs_at_once=2)
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=work) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and process(spark, lake) == sorted([*ALL, *((f"r{i}", RIVER, "observations", 1) for i in range(3))])
    assert runs.commit_log(spark, str(lake)).count() == 6 and L.scan_processed(spark, str(lake), "observations").count() == 7


def test_claims(spark, tmp_path):
    files = LakeFiles(spark, str(tmp_path))
    one, other, late = (claims.Claims(files, str(tmp_path), timedelta(hours=h)) for h in (1, 1, 0))
    assert one.take("a") and one.take("a") and not other.take("a") and other.take("b")
    assert late.take("a") and one.lost() == ["a"] and late.lost() == []
    one.release("a")
    assert not other.take("a"), "a claim that was lost isn't the new one"
    late.release("a")
    assert other.take("a") and other.lost() == []


def test_moves_and_files_are_made_once(spark, tmp_path):
    files = LakeFiles(spark, str(tmp_path))
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    assert files.move(f"{tmp_path}/a", f"{tmp_path}/to/c") and not files.move(f"{tmp_path}/b", f"{tmp_path}/to/c")
    assert (tmp_path / "to/c/x").read_text() == "a" and (tmp_path / "b/x").exists()
    assert files.move(f"{tmp_path}/b/x", f"{tmp_path}/y") and not files.move(f"{tmp_path}/y", f"{tmp_path}/to/c/x")
    assert files.create(f"{tmp_path}/z") and not files.create(f"{tmp_path}/z") and files.names(f"{tmp_path}/nothing") == []


def test_reads_open_the_files_of_their_time_and_station(spark, tmp_path):
    for day in (1, 2, 3):
        at = [GOOD | {"id": day, "station": day, "waterLevelOn": f"2026-09-0{day}T12:00:00Z"}]
        manifest(tmp_path, RIVER, f"d{day}", [put(tmp_path, RIVER, f"d{day}", 1, at)])
    process(spark, tmp_path)
    read = lambda **k: runs.scan_committed(spark, str(tmp_path), "observations", **k)
    day = read(start=datetime(2026, 9, 2), end=datetime(2026, 9, 3))
    assert [r.station_id for r in day.collect()] == ["2"] and len(day.inputFiles()) == 1 and "run-d2" in day.inputFiles()[0]
    assert [r.run_id for r in read(station="3").collect()] == ["d3"] and len(read(station="3").inputFiles()) == 1
    assert read().count() == 3 and read(endpoint=RIVER_STATIONS).count() == 0 and read(start=datetime(2027, 1, 1)).columns == read().columns
    # A later file with a column more: the commits say so, and older files give nulls.
    wide = spark.createDataFrame([("d4", "s", 1.5)], "run_id string, station_id string, flow double")
    wide.write.parquet(f"{tmp_path}/processed/dataset=observations/endpoint={RIVER}/year=2026/month=09/day=04/hour=00/run-d4")
    columns = F.lit("run_id string, station_id string, flow double").alias("columns")
    folder = f"processed/dataset=observations/endpoint={RIVER}/year=2026/month=09/day=04/hour=00/run-d4"
    name = next((tmp_path / folder).glob("part-*")).name
    row = spark.createDataFrame([("d4", RIVER, "observations", 1, None, folder, [(name, 1, None, None, "s", "s")])], f"run_id string, endpoint string, dataset string, row_count bigint, committed_at timestamp, folder string, files {runs.FILES}")
    row.select("run_id", "endpoint", "dataset", "row_count", "committed_at", "folder", columns, "files").write.mode("append").parquet(f"{tmp_path}/commits")
    assert {(r.run_id, r.flow) for r in read().collect()} == {("d1", None), ("d2", None), ("d3", None), ("d4", 1.5)}


def test_attempts_are_listed(spark, tmp_path):
    event = "event-00000000-0000-0000-0000-00000000000"
    for kind, run in (("raw", f"{event}1-attempt-0001"), ("quarantine", f"{event}1-attempt-0003"), ("raw", f"{event}1-attempt-12"), ("raw", "other"), ("manifests", f"{event}2-attempt-0002")):
        at = tmp_path / kind / f"provider=p/endpoint={RIVER_STATIONS}/run_id={run}"
        at.mkdir(parents=True)
        (at / "x.json").write_text("{}")
    files = L.lake_files(spark, str(tmp_path))
    assert {r.kind for r in files.collect()} == {"raw", "quarantine", "manifests"} and files.count() == 5
    found = spark.createDataFrame([("completed", f"{event}2-attempt-0002")], "status string, run_id string")
    rows = {r.prefix: (r.next_attempt, r.completed_run, r.conflict) for r in runs.run_catalog(files, found).collect()}
    assert rows == {f"{event}1": (4, None, False), f"{event}2": (3, f"{event}2-attempt-0002", False)}
    assert L.lake_files(spark, f"{tmp_path}/nothing").count() == 0


def ingestion(spark, *runs_of):
    rows = [(f"aaaaaaaa-bbbb-4ccc-8ddd-eeeeeeeeee{i:02}", f"aaaaaaaa-bbbb-4ccc-8ddd-ffffffffff{i:02}", run, f"aaaaaaaa-bbbb-4ccc-8ddd-dddddddddd{i:02}") for i, run in enumerate(runs_of)]
    return spark.createDataFrame(rows, "event_id string, correlation_id string, run_id string, request_event_id string")


def test_receipts_are_written_once(spark, lake):  # noqa: F811
    process(spark, lake)
    at = str(lake)
    manifests = L.scan_manifests(spark, at).withColumn("manifest_path", F.lit("manifests/x"))
    results = receipts.run_results(manifests, runs.commit_log(spark, at))
    found = receipts.processing_receipts(ingestion(spark, "007", "s1", "never"), results)
    assert receipts.scan_receipts(spark, at).count() == 0
    stored = receipts.store_receipts(spark, at, found.where("run_id = '007'"))
    file = lake / f"quality/endpoint={RIVER}/year=2026/month=09/day=01/hour=00/run-007/processing-completed.json"
    before = file.read_bytes()
    later = found.withColumn("occurred_at", F.expr("occurred_at + interval 1 day"))
    stored = receipts.store_receipts(spark, at, later)
    assert file.read_bytes() == before, "another time alone is no other receipt"
    rows = {r.data["run_id"]: r for r in stored.collect()}
    assert set(rows) == {"007", "s1"} and not any(r.errors for r in rows.values())
    assert {k for r in rows.values() for k in r.data} == {*receipts.FIELDS, "station_output_path"} and "station_output_path" not in rows["007"].data
    assert all((lake / rows["s1"].data[k]).exists() for k in ("quality_report_path", "observation_output_path", "station_output_path"))
    assert receipts.receipt_faults(stored, ("p",)).count() == 0
    with pytest.raises(ValueError, match="receipts differ"):
        receipts.store_receipts(spark, at, receipts.processing_receipts(ingestion(spark, "007").withColumn("correlation_id", F.lit("other")), results))
    with pytest.raises(ValueError, match="several ingestions"):
        receipts.store_receipts(spark, at, receipts.processing_receipts(ingestion(spark, "s1", "s1"), results))
    assert not list((lake / "staging").iterdir()) and receipts.scan_receipts(spark, at).count() == 2


def test_faulty_receipts_are_found(spark, lake):  # noqa: F811
    process(spark, lake)
    manifests = L.scan_manifests(spark, str(lake)).withColumn("manifest_path", F.lit("manifests/x"))
    found = receipts.processing_receipts(ingestion(spark, "s1"), receipts.run_results(manifests, runs.commit_log(spark, str(lake)))).withColumn("errors", F.array().cast("array<string>"))

    def faults(change):
        rows = receipts.receipt_faults(change(found), ("p",)).collect()
        return rows[0].faults if rows else []

    data = lambda k, v: lambda r: r.withColumn("data", F.map_concat(F.map_filter("data", lambda x, _: x != k), F.create_map(F.lit(k), F.lit(v).cast("string"))))
    assert faults(lambda r: r) == []
    assert faults(lambda r: r.withColumn("path", F.lit("quality/elsewhere/processing-completed.json"))) == ["path"]
    assert faults(lambda r: r.withColumn("event_type", F.lit("ingestion.completed"))) == ["event_type"]
    assert faults(lambda r: r.withColumn("errors", F.array(F.lit("not_json")))) == ["event"]
    assert faults(data("quality_report_path", None)) == ["quality_report_path", "path"] and faults(data("quality_report_path", "x")) == ["path"]
    for k, v in (("provider", "q"), ("endpoint", "sea"), ("run_id", " "), ("manifest_path", None), ("observation_output_path", ""), ("station_output_path", None), ("ingestion_event_id", "1"), ("request_event_id", None)):
        assert faults(data(k, v)) == [k]
