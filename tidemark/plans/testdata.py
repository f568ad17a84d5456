"""The network's tables and lake, projected from the star schema that queries are given.

Every projection is written twice: as a DataFrame and as SQL for the oracle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.schemas import RIVER, RIVER_STATIONS
from tidemark.sources import lake as L
from tidemark.sources.files import LakeFiles

PAGE_EVENTS = 2000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Where it isn't set a local session gets a folder of its own; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/network-{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, share: float = 0.4) -> DataFrame:
    """Observations from events.  share: of the events' number, how many record ids there are."""
    events = table(spark, sf_dir, "events")
    ids = events.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).cast("bigint")).scalar()
    return events.withColumn("rec", F.col("event_id") % ids).selectExpr(
        "event_id", "event_id as tie", "concat('rec-', cast(rec as string)) as source_record_id", "cast(user_id as string) as station_id", "date_trunc('hour', ts) as observed_at",
        "case when event_type <> 'error' then value end as water_level_m", "cast(event_id % 100 as double) as warning_level_m", "cast((event_id * 7) % 100 as double) as danger_level_m",
        "case when event_id % 17 <> 0 then cast(event_id % 200 - 100 as double) end as latitude", "cast(event_id % 400 - 200 as double) as longitude",
        f"case when event_type in ('click', 'signup') then '{RIVER_STATIONS}' else '{RIVER}' end as endpoint", "concat('run-', cast(least((day(ts) - 1) div 10, 2) as string)) as run_id",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(10 * cast(least((day(ts) - 1) div 10, 2) + 1 as int)) - interval 12 hours as ingested_at",
    )


def observations_sql(share: float = 0.4) -> str:
    m = f"(select cast(floor(count(*) * {share}) as bigint) from events)"
    run = "least((day(ts) - 1) // 10, 2)"
    return f"""select event_id, event_id as tie, 'rec-' || cast(event_id % {m} as varchar) as source_record_id, cast(user_id as varchar) as station_id, date_trunc('hour', ts) as observed_at,
        case when event_type <> 'error' then value end as water_level_m, cast(event_id % 100 as double) as warning_level_m, cast((event_id * 7) % 100 as double) as danger_level_m,
        case when event_id % 17 <> 0 then cast(event_id % 200 - 100 as double) end as latitude, cast(event_id % 400 - 200 as double) as longitude,
        case when event_type in ('click', 'signup') then '{RIVER_STATIONS}' else '{RIVER}' end as endpoint, 'run-' || cast({run} as varchar) as run_id,
        timestamp '2024-01-01 00:00:00' + to_days(cast(10 * ({run} + 1) as integer)) - interval 12 hours as ingested_at from events"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations from all customers, a copy for each of the three runs."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "cast(c_custkey as string) as station_id", "case when c_custkey % 11 <> 0 then concat('series-', cast(c_custkey % 50 as string)) end as station_series_id",
        "case when c_custkey % 13 <> 0 then c_name else '  ' end as station_name", "case when n_nationkey = 3 then '' when n_nationkey = 7 then '  ' else n_name end as basin_name",
        "cast(c_custkey % 200 - 100 as double) as latitude", "case when c_custkey % 19 <> 0 then cast(c_custkey % 360 - 180 as double) end as longitude",
        f"'{RIVER_STATIONS}' as endpoint", "concat('run-', cast(run as string)) as run_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(10 * (run + 1)) - interval 12 hours as ingested_at",
    )


STATIONS_SQL = f"""select cast(c_custkey as varchar) as station_id, case when c_custkey % 11 <> 0 then 'series-' || cast(c_custkey % 50 as varchar) end as station_series_id,
        case when c_custkey % 13 <> 0 then c_name else '  ' end as station_name, case when n_nationkey = 3 then '' when n_nationkey = 7 then '  ' else n_name end as basin_name,
        cast(c_custkey % 200 - 100 as double) as latitude, case when c_custkey % 19 <> 0 then cast(c_custkey % 360 - 180 as double) end as longitude,
        '{RIVER_STATIONS}' as endpoint, 'run-' || cast(run as varchar) as run_id, timestamp '2024-01-01 00:00:00' + to_days(cast(10 * (run + 1) as integer)) - interval 12 hours as ingested_at
        from customer join nation on c_nationkey = n_nationkey cross join (values (0), (1), (2)) r(run)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(endpoint, run_id, ingested_at, page, event_id, record): each event as a record's JSON text, some of them damaged.

    By event_id: multiples of 23 have an unreadable time, of 29 no title, of 31 an id
    that is no number, of 37 a point with one coordinate, of 41 are no objects; those
    without a latitude have no point.
    """
    rows = observations(spark, sf_dir)
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    e = F.col("event_id")
    point = F.struct(F.lit("Point").alias("type"), F.when(e % 37 == 0, F.array("longitude")).otherwise(F.array("longitude", "latitude")).alias("coordinates"))
    point = F.when(F.col("latitude").isNotNull(), point)
    when = F.when(e % 23 == 0, "no time").otherwise(F.date_format("observed_at", iso))
    record = F.struct(
        e.alias("id"), F.when(F.col("endpoint") == RIVER, F.col("station_id").cast("bigint")).alias("station"), F.date_format("observed_at", iso).alias("createdOn"), F.date_format("ingested_at", iso).alias("modifiedOn"),
        F.when(e % 29 != 0, F.concat(F.lit(" Gauge "), "station_id")).alias("title"), F.when(e % 3 != 0, F.lit("Upper ")).alias("basin"), point.alias("point"), F.col("water_level_m").alias("waterLevel"),
        F.col("warning_level_m").alias("warningLevel"), F.col("danger_level_m").alias("dangerLevel"), when.alias("waterLevelOn"),
        F.get(F.array(F.lit("RISING"), F.lit(" steady "), F.lit("FALLING"), F.lit("odd")), (e % 4).cast("int")).alias("steady"), (e % 7).alias("province"),
    )
    text = F.to_json(record)
    damaged = F.when(e % 41 == 0, '"oops"').when(e % 31 == 0, F.regexp_replace(text, r'"id":(\d+)', '"id":"x$1"')).otherwise(text)
    return rows.select("endpoint", F.concat_ws("-", "run_id", "endpoint").alias("run_id"), "ingested_at", F.floor(e / PAGE_EVENTS).cast("int").alias("page"), "event_id", damaged.alias("record"))


def raw_records_sql() -> str:
    return f"select * replace (run_id || '-' || endpoint as run_id), event_id // {PAGE_EVENTS} as page, event_id % 41 = 0 as no_object, event_id % 31 = 0 as bad_id, event_id % 23 = 0 as bad_time from ({observations_sql()})"


#: Pages below this number are files of their own in `raw_lake`.
LOOSE_PAGES = 3
_lakes: dict[tuple, str] = {}


def input_key(spark: SparkSession, sf_dir: str) -> tuple:
    """What made things are kept by: the session, and the input with its files' times."""
    return spark.sparkContext.applicationId, sf_dir, *sorted(LakeFiles(spark, sf_dir).names(sf_dir))


def new_lake(spark: SparkSession, sf_dir: str, runs: Column) -> str:
    """A lake with the manifests of some runs of `raw_lake`, which name its pages, and nothing processed."""
    lake = shared_path(spark, "lake")
    add_manifests(spark, sf_dir, lake, runs)
    return lake


#: Runs that `damaged_lake` harms, with what happens to a page of each.
DAMAGED = {"run-0-river": "missing", "run-1-river-stations": "mismatched", "run-2-river": "miscounted"}


def damaged_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake whose manifests name the pages of `raw_lake`; of three runs the first page is elsewhere, of other bytes, or of more records."""
    harm = F.create_map(*(F.lit(x) for pair in DAMAGED.items() for x in pair))[F.col("run_id")]

    def odd(p: Column, i: Column) -> Column:
        here = lambda kind: F.coalesce((harm == kind) & (i == 0), F.lit(False))
        return (
            p.withField("payload_key", F.when(here("missing"), F.concat(p["payload_key"], F.lit(".gone"))).otherwise(p["payload_key"]))
            .withField("payload_sha256", F.when(here("mismatched"), F.reverse(p["payload_sha256"])).otherwise(p["payload_sha256"]))
            .withField("record_count", F.when(here("miscounted"), p["record_count"] + 1).otherwise(p["record_count"]))
        )

    lake = shared_path(spark, "lake")
    add_manifests(spark, sf_dir, lake, F.lit(True), lambda rows: rows.withColumn("raw_pages", F.transform("raw_pages", odd)))
    return lake


def add_manifests(spark: SparkSession, sf_dir: str, lake: str, runs: Column, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    rows = change(L.scan_manifests(spark, raw_lake(spark, sf_dir)).where(runs).drop("modified_at"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{lake}/manifests")


def raw_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake with the raw pages and manifests of all runs, made once for a session and input.

    The first pages of runs are files of their own; the others, whose number grows with the input, are packed.
    """
    key = input_key(spark, sf_dir)
    if key not in _lakes:
        lake = shared_path(spark, "lake")
        pages = raw_records(spark, sf_dir).groupBy("endpoint", "run_id", "ingested_at", "page").agg(F.array_sort(F.collect_list(F.struct("event_id", "record"))).alias("r"))
        body = F.concat(F.lit('{"count":'), F.size("r").cast("string"), F.lit(',"next":null,"previous":null,"results":['), F.array_join(F.transform("r", lambda x: x["record"]), ","), F.lit("]}"))
        at = F.col("ingested_at")
        folders = ["provider", "endpoint", "year", "month", "day", "hour", "run_id", "page"]
        keyed = pages.select(body.alias("value"), F.lit("gauges").alias("provider"), "endpoint", F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.hour(at).alias("hour"), "run_id", "page")
        loose = F.col("page") < LOOSE_PAGES
        keyed.where(loose).write.partitionBy(*folders).text(f"{lake}/raw")
        path = F.concat_ws("/", F.lit("raw"), *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in folders), F.lit("payload.json"))
        L.pack_pages(keyed.where(~loose).select(path.alias("path"), "value"), lake)
        manifests(spark, sf_dir, lake).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{lake}/manifests")
        _lakes[key] = lake
    return _lakes[key]


#: Users whose attempts `attempts_lake` keeps as files of their own.
LOOSE_USERS = 20


def attempts_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake with the files of attempts: an event is one of its user's, by number; views and errors have names that are none.

    Those of a few users are files in folders of their own; the others, whose number grows with the input, are packed.
    """
    prefix = F.concat(F.lit("event-"), event_uuid(F.col("user_id")))
    number = F.format_string("-attempt-%04d", F.col("event_id") % 5 + 1)
    run = F.concat(prefix, F.when(F.col("event_type") == "view", F.lit("-odd")).when(F.col("event_type") == "error", F.lit("-attempt-99")).otherwise(number))
    kind = F.when(F.col("event_type") == "signup", "quarantine").when(F.col("event_type") == "purchase", "manifests").otherwise("raw")
    loose = F.coalesce(F.col("user_id") < LOOSE_USERS, F.lit(False))
    tries = table(spark, sf_dir, "events").select(kind.alias("kind"), loose.alias("loose"), run.alias("run_id"), F.lit("gauges").alias("provider"), F.lit(RIVER_STATIONS).alias("endpoint")).distinct()
    lake = shared_path(spark, "lake")
    manifest = F.to_json(F.struct(F.lit("completed").alias("status"), "provider", "endpoint", "run_id", F.lit("2024-01-01T00:00:00Z").alias("captured_at")))
    files = tries.withColumn("value", F.when(F.col("kind") == "manifests", manifest).otherwise("{}"))
    for of in ("raw", "quarantine", "manifests"):
        files.where("loose").where(F.col("kind") == of).select("value", "provider", "endpoint", "run_id").repartition(8, "run_id").write.partitionBy("provider", "endpoint", "run_id").text(f"{lake}/{of}")
    path = F.concat_ws("/", "kind", F.concat(F.lit("provider="), "provider"), F.concat(F.lit("endpoint="), "endpoint"), F.concat(F.lit("run_id="), "run_id"), F.lit("payload.json"))
    L.pack_files(files.where("not loose").select("kind", path.alias("path"), "value"), lake)
    return lake


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, captured_at) of the lake's runs: each endpoint has its own."""
    return observations(spark, sf_dir).groupBy(F.concat_ws("-", "run_id", "endpoint").alias("run_id")).agg(F.max("ingested_at").alias("captured_at"))


def manifests(spark: SparkSession, sf_dir: str, lake: str) -> DataFrame:
    """One manifest for each run of the lake."""
    lines = L.raw_lineage(spark, lake)
    page = F.struct("page_index", "record_count", "payload_key", "payload_size_bytes", "payload_sha256")
    runs = lines.groupBy("endpoint", "run_id").agg(F.array_sort(F.collect_list(page)).alias("raw_pages"))
    return runs.join(F.broadcast(captures(spark, sf_dir)), "run_id").select(F.lit(1).alias("manifest_version"), F.lit("completed").alias("status"), F.lit("gauges").alias("provider"), "endpoint", "run_id", "captured_at", "raw_pages")


def pipeline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of pipeline events: views have an unknown type, errors are other JSON."""
    n = {"event": F.col("event_id"), "request": F.col("event_id") - F.col("event_id") % 5, "ingestion": F.col("event_id") - F.col("event_id") % 3, "user": F.col("user_id")}
    # Generated: in texts that only some rows have, each part of an id would hash again.
    e = table(spark, sf_dir, "events").select("*", F.explode(F.array(F.struct(*(_digest(x).alias(name) for name, x in n.items())))).alias("digests"))
    event, request, ingestion, user = (_as_uuid(F.col(f"digests.{name}")) for name in n)
    kind = F.create_map(*(F.lit(x) for x in ("click", "ingestion.requested", "signup", "ingestion.completed", "purchase", "processing.completed", "view", "page.viewed")))[F.col("event_type")]
    data = F.create_map(F.lit("request_event_id"), request, F.lit("ingestion_event_id"), ingestion, F.lit("user"), F.col("user_id").cast("string"))
    line = F.to_json(F.struct(event.alias("event_id"), kind.alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("occurred_at"), user.alias("correlation_id"), F.lit(1).alias("schema_version"), data.alias("data")))
    return e.select(F.col("event_id").alias("line"), F.when(F.col("event_type") == "error", F.col("props")).otherwise(line).alias("value"))


_events: dict[tuple, str] = {}


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pipeline_lines`, decoded once for a session and input and kept as a table."""
    key = input_key(spark, sf_dir)
    if key not in _events:
        path = shared_path(spark, "events")
        E.decode_events(pipeline_lines(spark, sf_dir)).drop("value").write.parquet(path)
        _events[key] = path
    return spark.read.parquet(_events[key])


def event_uuid(n: Column) -> Column:
    return _as_uuid(_digest(n))


def _digest(n: Column) -> Column:
    return F.md5(n.cast("string").cast("binary"))


def _as_uuid(h: Column) -> Column:
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def event_uuid_sql(n: str) -> str:
    h = f"md5(cast({n} as varchar))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts: each event is one of its user's, errors and views fail."""
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as request_id", "cast(ts as timestamp) as at", "event_type not in ('error', 'view') as ok", "event_type as error_type", "props as error_message")
