"""Pipeline events in batch and as streams."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import runs
from tidemark.streaming import events as S

ID = "aaaaaaaa-bbbb-4ccc-8ddd-eeeeeeeeeee{}"
T0 = datetime(2026, 9, 1)


def line(n: int, kind: str = "ingestion.requested", **k) -> str:
    return json.dumps({"event_id": ID.format(n), "event_type": kind, "occurred_at": "2026-09-01T00:00:00+05:45", "correlation_id": ID.format(0), "schema_version": 1, "data": {"a": 1, "b": None}} | k)


def test_decoding(spark):
    lines = [line(1), line(2, "other"), line(3, occurred_at="2026-09-01T00:00:00"), line(4, data={"a": [1]}), line(5, schema_version=0), "not json", line(6, data=None), None]
    got = [r.errors for r in E.decode_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got[:5] == [[], ["event_type"], ["occurred_at"], ["data"], ["schema_version"]] and got[5][0] == got[7][0] == "not_json" and got[6] == ["data"]
    first = E.decode_events(spark.createDataFrame([(line(1),)], "value string")).first()
    assert first.occurred_at == datetime(2026, 8, 31, 18, 15) and first.data == {"a": "1", "b": None}


def outcomes(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("b", 1, False), ("b", 2, True), ("c", 5, False), ("c", 6, False), ("c", 7, False)]
    return spark.createDataFrame([(r, T0 + timedelta(hours=h), ok, f"E{h}", f"m{h}") for r, h, ok in rows], "request_id string, at timestamp, ok boolean, error_type string, error_message string")


def test_retries(spark):
    state = E.dead_letter_split(E.retry_state(outcomes(spark)))
    got = {r.request_id: (r.attempts, r.first_failed_at.hour, r.last_error_type, r.route) for r in state.collect()}
    assert got == {"a": (2, 3, "E4", "pending"), "c": (3, 5, "E7", "dead-letter")}


def test_retry_stream_agrees_with_the_batch(spark, tmp_path):
    outcomes(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(outcomes(spark).schema).parquet(f"{tmp_path}/in")
    table = S.run_to_table(S.retry_state_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state", "update")
    last = {r.request_id: (r.attempts, r.last_error_type) for r in table.collect()}
    assert last == {"a": (2, "E4"), "b": (0, None), "c": (3, "E7")}


def test_nothing_is_kept_of_a_request_that_succeeded(spark, tmp_path):
    rows = outcomes(spark)
    rows.where("hour(at) <= 1").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    read = lambda: {r.request_id: r.attempts for r in S.run_to_table(S.retry_state_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state", "update").collect()}
    assert read() == {"a": 1, "b": 1}
    rows.where("hour(at) > 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = S.run_to_table(S.retry_state_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state", "update")
    assert {(r.request_id, r._batch): r.attempts for r in table.collect()} == {("a", 0): 1, ("b", 0): 1, ("a", 1): 2, ("b", 1): 0, ("c", 1): 3}
    kept = spark.read.format("statestore").load(f"{tmp_path}/state")
    assert {r.key.request_id for r in kept.select("key").collect()} == {"a", "c"}


def test_traces_of_two_streams(spark, tmp_path):
    asked = spark.createDataFrame([("a", T0), ("b", T0)], "request_event_id string, requested_at timestamp")
    done = spark.createDataFrame([("a", T0 + timedelta(hours=3)), ("b", T0 + timedelta(days=9)), ("x", T0)], "for_request string, ingested_at timestamp")
    for name, rows in (("asked", asked), ("done", done)):
        rows.write.parquet(f"{tmp_path}/{name}")
    of = lambda name, rows: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}")
    out = S.run_to_table(S.trace_stream(of("asked", asked), of("done", done)), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [(r.request_event_id, r.ingested_at) for r in out.where("for_request is not null").collect()] == [("a", T0 + timedelta(hours=3))]


def test_traces_of_three_streams(spark, tmp_path):
    hours = lambda h: T0 + timedelta(hours=h)
    kinds = {
        "asked": ("request_event_id string, requested_at timestamp", [("whole", hours(0)), ("alone", hours(0)), ("half", hours(1)), ("late", hours(0)), ("open", hours(99))]),
        "ingested": ("ingestion_event_id string, for_request string, ingested_at timestamp", [("i1", "whole", hours(4)), ("i2", "half", hours(2)), ("i3", "late", hours(11)), ("x", "none", hours(100))]),
        "processed": ("processing_event_id string, for_ingestion string, processed_at timestamp", [("p1", "i1", hours(9)), ("p2", "i2", hours(20)), ("y", "none", hours(100))]),
    }
    streams = []
    for name, (schema, rows) in kinds.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}"))
    traced = S.pipeline_trace_stream(*streams, within="10 hours", late="1 hour")
    rows = S.run_to_table(traced, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    # The ingestion that came too late isn't joined, nor is such a processing; what isn't over yet waits.
    assert {(r.request_event_id, r.ingestion_event_id, r.processing_event_id) for r in rows} == {("whole", "i1", "p1"), ("alone", None, None), ("half", "i2", None), ("late", None, None)}
    assert next(r for r in rows if r.request_event_id == "whole").processed_at == hours(9)


STATE = ["request_id", "attempts", "first_failed_at", "last_failed_at", "last_error_type", "last_error_message"]


def test_retry_states_of_outcomes_in_any_order(spark, tmp_path):
    rng = random.Random(11)
    rows = [(f"r{rng.randint(0, 12)}", T0 + timedelta(minutes=rng.randint(0, 60)), rng.random() < 0.2, rng.choice(["E", "F", None]), rng.choice(["m", None])) for _ in range(250)]
    schema = outcomes(spark).schema
    for i in range(5):
        spark.createDataFrame(rows[i * 50 : (i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = S.run_to_table(S.retry_states(stream, late="2 hours"), f"{tmp_path}/out", f"{tmp_path}/state", "update", rocksdb=True).cache()
    want = {r.request_id: tuple(r) for r in E.dead_letter_split(E.retry_state(spark.createDataFrame(rows, schema))).select(*STATE, "route").collect()}
    last = table.groupBy("request_id").agg(F.max_by(F.struct(*STATE[1:], "route"), "_batch").alias("s")).select("request_id", "s.*")
    assert {r.request_id: tuple(r) for r in last.collect() if r.attempts} == want
    assert table.select("_batch").distinct().count() == 5
    # A dead letter comes once for each time that a request goes over the limit.
    gone = {(r.request_id, r.last_failed_at) for r in S.dead_letters(table).collect()}
    over, was = set(), {}
    for r in table.orderBy("request_id", "_batch").collect():
        if r.attempts >= 3 and was.get(r.request_id, 0) < 3:
            over.add((r.request_id, r.last_failed_at))
        was[r.request_id] = r.attempts
    assert gone == over and over


def test_states_below_the_watermark_are_summed_up_or_given_up(spark, tmp_path):
    batches = [[("a", 1, False), ("a", 2, False), ("b", 1, True), ("c", 1, False)], [("z", 50, True)], [("z", 60, True), ("a", 61, False)], [("c", 70, True)], [("z", 200, True)], [("z", 201, True)]]
    schema = outcomes(spark).schema
    for rows in batches:
        said = [(r, T0 + timedelta(hours=h), ok, f"E{h}", None) for r, h, ok in rows]
        spark.createDataFrame(said, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = S.run_to_table(S.retry_states(stream, late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/state", "update", rocksdb=True)
    said = {(r.request_id, r._batch): (r.attempts, r.route) for r in table.collect()}
    assert said["a", 0] == (2, "pending") and said["a", 2] == (3, "dead-letter") and said["c", 0] == (1, "pending") and said["c", 3] == (0, "cleared")
    assert table.where("request_id = 'a' and _batch = 2").first().first_failed_at == T0 + timedelta(hours=1)
    kept = lambda name: {r.key.request_id for r in spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").select("key").collect()}
    assert kept("old") == {"a"} and "b" not in kept("cleared") and "c" not in kept("cleared")


def test_decoding_one_type_only(spark):
    lines = [line(1), line(2, "ingestion.completed"), "not json", line(3, "other")]
    some = E.decode_events(spark.createDataFrame([(x,) for x in lines], "value string"), types=("ingestion.completed",))
    assert [r.event_id for r in some.collect()] == [ID.format(2)]


def test_each_event_once(spark, tmp_path):
    rows = [(ID.format(i % 3), T0 + timedelta(minutes=i)) for i in range(9)]
    events = spark.createDataFrame(rows, "event_id string, occurred_at timestamp")
    assert {r.event_id: r.occurred_at.minute for r in E.dedupe_events(events).collect()} == {ID.format(i): i for i in range(3)}
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    assert S.run_to_table(S.dedupe_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state").count() == 3


def test_conflicts_and_catalog(spark):
    records = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "request_id string, run int")
    assert [r.request_id for r in E.execution_conflicts(records).collect()] == ["b"]
    p = f"event-{ID.format(1)}"
    paths = spark.createDataFrame([(f"raw/run_id={p}-attempt-0002/page=1",), (f"q/run_id={p}-attempt-0010",), (f"raw/run_id={p}-attempt-99/x",), ("raw/run_id=other/x",)], "path string")
    done = spark.createDataFrame([(f"{p}-attempt-0002", "completed"), (f"{p}-attempt-0003", "failed")], "run_id string, status string")
    assert [tuple(r) for r in runs.run_catalog(paths, done).collect()] == [(p, 11, f"{p}-attempt-0002", False)]
    twice = done.withColumn("status", F.lit("completed"))
    assert runs.run_catalog(paths, twice).first().conflict


def test_trace_and_receipts(spark):
    lines = [line(1), line(2, "ingestion.completed", data={"request_event_id": ID.format(1)}), line(3, "processing.completed", data={"ingestion_event_id": ID.format(2)}), line(4)]
    events = E.decode_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {tuple(r)[:3] for r in E.pipeline_trace(events).select("request_event_id", "ingestion_event_id", "processing_event_id").collect()} == {(ID.format(1), ID.format(2), ID.format(3)), (ID.format(4), None, None)}
    ingested = spark.createDataFrame([(ID.format(2), ID.format(0), "r", "river")], "event_id string, correlation_id string, run_id string, endpoint string")
    receipts = E.completion_receipts(ingested, spark.createDataFrame([("r", 5, T0)], "run_id string, row_count bigint, completed_at timestamp"))
    again = E.completion_receipts(ingested, spark.createDataFrame([("r", 5, T0 + timedelta(days=1))], "run_id string, row_count bigint, completed_at timestamp"))
    assert E.receipt_violations(receipts, again).count() == 0
    other = E.completion_receipts(ingested, spark.createDataFrame([("r", 6, T0)], "run_id string, row_count bigint, completed_at timestamp"))
    assert [(r.kind, '"5"' in r.said, '"6"' in r.expected) for r in E.receipt_violations(receipts, other).collect()] == [("changed", True, True)]
    assert [r.kind for r in E.receipt_violations(receipts, other.limit(0)).collect()] == ["unknown"]
    said = receipts.select(E.encode_events(receipts).alias("j")).first().j
    assert list(json.loads(said)) == sorted(json.loads(said))


class CountedState:
    """A value of the state store that counts the messages it would cost."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        self.calls.append(name)
        return {"exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None)}[name]


class CountedHandle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, schema):
        return CountedState(self.calls)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.append(at)


def test_a_request_of_a_batch_costs_few_messages_to_the_state_store():
    handle, p = CountedHandle(), S.RetryProcessor(3)
    p.init(handle)
    row = lambda us, ok=False, kind="E": Row(request_id="a", us=us, ok=ok, error_type=None if ok else kind, error_message=None)

    def said(*rows):
        handle.calls.clear()
        out = [x for x in p.handleInputRows(("a",), iter(rows), None)]
        return out[0].attempts, out[0].first_failed_at, out[0].last_failed_at, out[0].route, out[0].newly_dead, len(handle.calls)

    # However many outcomes come, and failures in no order; a known request without anything newer needs no timer.
    assert said(*(row(1000 * n) for n in (9, 3, 7, 9)), *(row(1000 * n, True) for n in range(1, 4))) == (3, 7000, 9000, "dead-letter", True, 4)
    assert said(row(8000)) == (4, 7000, 9000, "dead-letter", False, 3) and handle.timers == [10]
    assert said(row(8500, True)) == (2, 9000, 9000, "pending", False, 3)
    assert said(row(9000, True), row(8900)) == (0, None, None, "cleared", False, 3)
    assert said(*(row(9500 + n % 2, kind=("E", "F")[n % 2]) for n in range(6)))[:5] == (6, 9500, 9501, "dead-letter", True)
