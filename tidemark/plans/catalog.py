"""The registered queries and, where SQL can express them, their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import events as E
from tidemark.operators import quality as Q
from tidemark.operators import reads as R
from tidemark.operators import receipts, runs, transforms, validation
from tidemark.operators import views as V
from tidemark.plans import testdata as D
from tidemark.schemas import EVENT_TYPES, RIVER, RIVER_STATIONS
from tidemark.sources import lake as L
from tidemark.streaming import events as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

START, END = datetime(2024, 1, 8, tzinfo=UTC), datetime(2024, 1, 22, tzinfo=UTC)
STATION = "7"

# The SQL twins share these tables; each is the SQL of the view of its name.
_TABLES = {
    "obs": D.observations_sql(),
    "obs_dup": D.observations_sql(0.25),
    "sta": D.STATIONS_SQL,
    "latest_run": f"select run_id, max(ingested_at) as latest_ingested_at from sta where endpoint = '{RIVER_STATIONS}' group by run_id order by 2 desc nulls last, 1 desc nulls last limit 1",
    "cur_sta": f"select * from sta where endpoint = '{RIVER_STATIONS}' and run_id in (select run_id from latest_run)",
    "cur_obs": f"select * from obs where endpoint = '{RIVER_STATIONS}' and run_id in (select run_id from latest_run)",
    "hist": f"""select * from obs where endpoint = '{RIVER}'
        qualify source_record_id is null or trim(source_record_id) = '' or row_number() over (partition by source_record_id order by ingested_at desc nulls last, run_id desc nulls last, tie desc) = 1""",
    "history": """select * exclude (priority) from (select *, 1 as priority from cur_obs union all select *, 0 from hist) where trim(station_id) <> '' and observed_at is not null
        qualify row_number() over (partition by station_id, observed_at order by ingested_at desc nulls last, priority desc, source_record_id desc nulls last, tie desc) = 1""",
    "latest_obs": "select * from history qualify row_number() over (partition by station_id order by observed_at desc nulls last, ingested_at desc nulls last, source_record_id desc nulls last, tie desc) = 1",
    "cur_latest": "select * from cur_obs where trim(station_id) <> '' qualify row_number() over (partition by station_id order by observed_at desc nulls last, ingested_at desc nulls last, source_record_id desc nulls last, tie desc) = 1",
    "snap": """select s.*, o.source_record_id, o.observed_at, o.water_level_m, o.ingested_at as observation_ingested_at, o.observed_at is not null as has_observation,
        (epoch(o.ingested_at) - epoch(o.observed_at)) / 3600.0 as observation_age_hours from cur_sta s left join cur_latest o using (station_id)""",
    "cls": """select coalesce(nullif(trim(basin_name), ''), 'Unknown') as basin_name, has_observation, observed_at, water_level_m,
        case when not has_observation then 'missing' when observation_age_hours is null then 'unassessable' when observation_age_hours < 0 then 'future' when observation_age_hours <= 24 then 'fresh' else 'stale' end as f from snap""",
    "basins": """select *, case when total_stations > 0 then stations_with_observation::double / total_stations else 0.0 end as coverage_ratio,
        case when stations_with_observation > 0 then fresh_observations::double / stations_with_observation else 0.0 end as freshness_ratio from (
        select basin_name, count(*) as total_stations, count(*) filter (has_observation) as stations_with_observation, count(*) filter (not has_observation) as stations_without_observation,
        count(*) filter (f = 'fresh') as fresh_observations, count(*) filter (f = 'stale') as stale_observations, count(*) filter (f = 'future') as future_observations, count(*) filter (f = 'unassessable') as unassessable_observations,
        count(*) filter (has_observation and water_level_m is not null) as observations_with_water_level, count(*) filter (has_observation and water_level_m is null) as observations_without_water_level,
        min(observed_at) as oldest_observed_at, max(observed_at) as latest_observed_at from cls group by 1)""",
    "raw": D.raw_records_sql(),
    "dup_rec": "select run_id, source_record_id from obs_dup group by all having count(*) > 1",
    "dup_time": "select run_id, station_id, observed_at from obs_dup group by all having count(*) > 1",
    "oq": f"""select o.*, concat_ws(',', case when latitude < -90 or latitude > 90 then 'invalid_latitude' end, case when longitude < -180 or longitude > 180 then 'invalid_longitude' end,
        case when r_run is not null then 'duplicate_source_record_id' end) as errors,
        concat_ws(',', case when water_level_m is null then 'missing_water_level' end, case when latitude is null or longitude is null then 'missing_coordinates' end, case when abs(water_level_m) >= 10000 then 'suspicious_water_level' end,
        case when warning_level_m > danger_level_m then 'warning_above_danger' end, case when endpoint = '{RIVER_STATIONS}' and epoch(ingested_at) - epoch(observed_at) > 86400 then 'stale_current_observation' end,
        case when t_run is not null then 'duplicate_station_observed_at' end) as warnings
        from obs_dup o left join (select run_id as r_run, source_record_id as r_id from dup_rec) on o.run_id = r_run and source_record_id = r_id
        left join (select run_id as t_run, station_id as t_id, observed_at as t_at from dup_time) on o.run_id = t_run and station_id = t_id and observed_at = t_at""",
    "oqs": "select *, case when errors <> '' then 'fail' when warnings <> '' then 'warn' else 'pass' end as quality_status from oq",
    "dup_series": "select run_id, station_series_id from sta where station_series_id is not null group by all having count(*) > 1",
    "sq": """select s.*, concat_ws(',', case when trim(station_name) = '' then 'missing_station_name' end, case when latitude < -90 or latitude > 90 then 'invalid_latitude' end, case when longitude < -180 or longitude > 180 then 'invalid_longitude' end) as errors,
        concat_ws(',', case when s.station_series_id is null then 'missing_station_series_id' end, case when trim(basin_name) = '' then 'missing_basin_name' end, case when latitude is null or longitude is null then 'missing_coordinates' end,
        case when d.run_id is not null then 'duplicate_station_series_id' end) as warnings
        from sta s left join dup_series d on s.run_id = d.run_id and s.station_series_id = d.station_series_id""",
    "ev": f"""select event_id as line, case when event_type = 'error' then null else {D.event_uuid_sql('event_id')} end as event_id,
        case event_type when 'click' then 'ingestion.requested' when 'signup' then 'ingestion.completed' when 'purchase' then 'processing.completed' when 'view' then 'page.viewed' end as event_type, ts as occurred_at,
        {D.event_uuid_sql('event_id - event_id % 5')} as request_event_id, {D.event_uuid_sql('event_id - event_id % 3')} as ingestion_event_id, user_id from events where event_type <> 'error'""",
    "att": "select cast(user_id as varchar) as request_id, ts as tried, event_type not in ('error', 'view') as ok, event_type as error_type, props as error_message from events",
}


def _sql(text: str) -> str:
    """text with the shared tables that it needs before it."""
    import re

    need, todo = [], [text]
    while todo:
        for name in re.findall(r"\b(?:from|join|in \(select run_id from|all select \*, 0 from)\s+(\w+)", todo.pop()):
            if name in _TABLES:
                need.append(name)
                todo.append(_TABLES[name])
    order = [n for n in _TABLES if n in need]
    return (f"with {', '.join(f'{n} as materialized ({_TABLES[n]})' for n in order)} " if order else "") + text


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql(sql)
        return f

    return put


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return D.stations(spark, sf_dir), D.observations(spark, sf_dir)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.current_river_snapshot(*both(spark, sf_dir))


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.basin_current_summary(snapshot(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.station_observation_history(*both(spark, sf_dir))


# Views


@query("select * from latest_run")
def latest_current_run(spark, sf_dir):
    return V.latest_current_run(D.stations(spark, sf_dir))


@query("select * from cur_sta")
def current_stations(spark, sf_dir):
    return V.current_stations(D.stations(spark, sf_dir))


@query("select * from cur_obs")
def current_observations(spark, sf_dir):
    return V.current_observations(*both(spark, sf_dir))


@query("select * from hist")
def historical_observations(spark, sf_dir):
    return V.historical_observations(D.observations(spark, sf_dir))


@query("select * from history")
def station_observation_history(spark, sf_dir):
    return history(spark, sf_dir)


@query("select * from latest_obs")
def latest_observation_per_station(spark, sf_dir):
    return V.latest_observation_per_station(history(spark, sf_dir))


@query("select * from latest_obs")
def latest_of_stored_history(spark, sf_dir):
    """The same from a history that is stored by station: nothing is shuffled."""
    table = f"history_{uuid.uuid4().hex}"
    V.store_history(history(spark, sf_dir), table, D.shared_path(spark, "history"), 8)
    return V.latest_observation_per_station(spark.table(table))


@query("select * from cur_latest")
def current_observation_per_station(spark, sf_dir):
    return V.current_observation_per_station(V.current_observations(*both(spark, sf_dir)))


@query("select * from obs qualify row_number() over (partition by station_id, run_id order by water_level_m desc nulls last, event_id desc) = 1")
def latest_per_key(spark, sf_dir):
    rows = D.observations(spark, sf_dir)
    return V.latest_per_key(rows, ["station_id", "run_id"], [F.desc_nulls_last("water_level_m"), F.desc("event_id")])


@query("select * from snap")
def current_river_snapshot(spark, sf_dir):
    return snapshot(spark, sf_dir)


@query("select * from basins")
def basin_current_summary(spark, sf_dir):
    return basins(spark, sf_dir)


_SUMS = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in V.COUNTS)
_NETWORK = f"""select *, case when total_stations > 0 then stations_with_observation::double / total_stations else 0.0 end as coverage_ratio,
    case when stations_with_observation > 0 then fresh_observations::double / stations_with_observation else 0.0 end as freshness_ratio
    from (select count(*) as basins_represented, {_SUMS}, min(oldest_observed_at) as oldest_observed_at, max(latest_observed_at) as latest_observed_at from basins)"""


@query(_NETWORK)
def current_network_summary(spark, sf_dir):
    return V.current_network_summary(basins(spark, sf_dir))


# Reads


@query("select * from snap order by station_name nulls last, station_id nulls last")
def get_current_snapshot(spark, sf_dir):
    return R.get_current_snapshot(snapshot(spark, sf_dir))


@query(f"select * from snap where station_id = '{STATION}' order by ingested_at desc nulls last, source_record_id desc nulls last limit 1")
def get_station(spark, sf_dir):
    return R.get_station(snapshot(spark, sf_dir), f" {STATION} ")


@query(f"select * from history where station_id = '{STATION}' and observed_at >= timestamp '2024-01-08' and observed_at < timestamp '2024-01-22' order by observed_at, source_record_id nulls last")
def get_station_history(spark, sf_dir):
    return R.get_station_history(history(spark, sf_dir), STATION, START, END)


@query("select * from history where observed_at >= timestamp '2024-01-08' and observed_at < timestamp '2024-01-22'")
def time_range_filter(spark, sf_dir):
    return R.time_range_filter(history(spark, sf_dir), START, END)


@query("select * from basins order by total_stations desc, basin_name")
def get_basin_summaries(spark, sf_dir):
    return R.get_basin_summaries(basins(spark, sf_dir))


@query(_NETWORK)
def get_network_summary(spark, sf_dir):
    return R.get_network_summary(V.current_network_summary(basins(spark, sf_dir)))


@query(f"select * from history where station_id = '{STATION}' order by observed_at desc nulls last, source_record_id desc nulls last limit 20")
def recent_observations(spark, sf_dir):
    return R.recent_observations(history(spark, sf_dir), STATION)


@query("select * from snap where has_observation order by observed_at desc nulls last, station_id limit 10")
def newest_of_snapshot(spark, sf_dir):
    return R.newest_of_snapshot(snapshot(spark, sf_dir))


@query("select * from snap where not has_observation")
def stations_without_observation(spark, sf_dir):
    return R.stations_without_observation(snapshot(spark, sf_dir))


@query("""select * from snap where contains(lower(concat_ws(' ', station_id, coalesce(nullif(trim(station_name), ''), 'Unnamed station'), coalesce(nullif(trim(basin_name), ''), 'Unknown'))), 'nation_1') and has_observation and water_level_m is not null""")
def station_filter(spark, sf_dir):
    return R.station_filter(snapshot(spark, sf_dir), " Nation_1", observation="with", level="available")


@query("select * from basins where contains(lower(basin_name), 'nation_2')")
def basin_search(spark, sf_dir):
    return R.basin_search(basins(spark, sf_dir), "NATION_2")


@query("select * from snap where abs(latitude) <= 90 and abs(longitude) <= 180")
def valid_coordinates(spark, sf_dir):
    return R.mapped_stations(snapshot(spark, sf_dir))


@query("""select * exclude (n) from (select *, row_number() over (order by station_name nulls last, station_id nulls last) as n, cast(least(2, greatest(1, ceil((select count(*) from snap) / 20.0))) as integer) as page,
    cast(greatest(1, ceil((select count(*) from snap) / 20.0)) as integer) as total_pages from snap) where (n - 1) // 20 + 1 = page""")
def station_page(spark, sf_dir):
    return R.station_page(snapshot(spark, sf_dir), 2)


@query("""select * exclude (n) from (select *, row_number() over (order by station_name nulls last, station_id nulls last) as n, cast(least(3, greatest(1, ceil((select count(*) from snap) / 20.0))) as integer) as page,
    cast(greatest(1, ceil((select count(*) from snap) / 20.0)) as integer) as total_pages from snap) where (n - 1) // 20 + 1 = page""")
def station_page_stored(spark, sf_dir):
    """A page of the stations as they were kept in the order of pages."""
    path = D.shared_path(spark, "pages")
    R.write_station_pages(snapshot(spark, sf_dir), path)
    return R.read_station_page(spark, path, 3)


@query("select endpoint, count(*) as n_rows from obs group by 1")
def endpoint_counts(spark, sf_dir):
    return R.endpoint_counts(D.observations(spark, sf_dir))


@query("select min(observed_at) as first_observed_at, max(observed_at) as last_observed_at from obs")
def time_range(spark, sf_dir):
    return R.observed_range(D.observations(spark, sf_dir))


@query("""select 'current_stations' as view, count(*) as n_rows from cur_sta union all select 'historical_observations', count(*) from hist union all
    select 'station_observation_history', count(*) from history union all select 'current_river_snapshot', count(*) from snap""")
def view_counts(spark, sf_dir):
    s, o = both(spark, sf_dir)
    return R.view_counts({"current_stations": V.current_stations(s), "historical_observations": V.historical_observations(o), "station_observation_history": V.station_observation_history(s, o), "current_river_snapshot": V.current_river_snapshot(s, o)})


@query("""select count(*) as n_rows, count(distinct station_id) as n_stations, count(*) filter (has_observation) as with_observation, count(*) filter (not has_observation) as without_observation,
    min(observation_age_hours) as min_age_hours, avg(observation_age_hours) as avg_age_hours, max(observation_age_hours) as max_age_hours from snap""")
def snapshot_profile(spark, sf_dir):
    return R.snapshot_profile(snapshot(spark, sf_dir))


@query("select station_id, count(*) as observations, min(observed_at) as first_observed_at, max(observed_at) as last_observed_at from history group by 1")
def station_activity(spark, sf_dir):
    return R.station_activity(history(spark, sf_dir))


@query("select station_id, count(*) as observations, min(observed_at) as first_observed_at, max(observed_at) as last_observed_at from history group by 1 order by 2 desc, 1 limit 1")
def busiest_station(spark, sf_dir):
    return R.busiest_station(history(spark, sf_dir))


@query("select count(*) as duplicate_keys from (select station_id, observed_at from obs group by all having count(*) > 1)")
def duplicate_key_check(spark, sf_dir):
    return R.duplicate_key_check(D.observations(spark, sf_dir))


@query("select *, basin_total = snapshot_rows as matches from (select (select coalesce(sum(total_stations), 0)::bigint from basins) as basin_total, (select count(*) from snap) as snapshot_rows)")
def reconcile_totals(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    return R.reconcile_totals(V.basin_current_summary(s), s)


@query("""select coalesce(sum(total_stations), 0)::bigint as total_stations, count(*) filter (total_stations > 0 and stations_without_observation = 0) as complete_basins,
    coalesce(sum(total_stations) filter (basin_name = 'Unknown'), 0)::bigint as unknown_basin_stations from basins""")
def network_overview_kpis(spark, sf_dir):
    return R.network_overview_kpis(basins(spark, sf_dir))


@query("""select station_id, count(*) as points, count(water_level_m) as points_with_level, min(observed_at) as first_observed_at, max(observed_at) as last_observed_at,
    arg_min_null(water_level_m, observed_at) as first_level_m, arg_max_null(water_level_m, observed_at) as last_level_m from history group by 1""")
def station_history_summary(spark, sf_dir):
    return R.station_history_summary(history(spark, sf_dir))


@query("select basin_name, total_stations, stations_with_observation, stations_without_observation from basins order by 2 desc, 1 limit 10")
def top_basins(spark, sf_dir):
    return R.top_basins(basins(spark, sf_dir))


@query("select distinct coalesce(nullif(trim(basin_name), ''), 'Unknown') as basin_name from snap")
def basin_options(spark, sf_dir):
    return R.basin_options(snapshot(spark, sf_dir))


# Expressions


@query("select event_id, case when upper(trim(event_type)) in ('RISING', 'FALLING') then upper(trim(event_type)) when upper(trim(event_type)) = 'STEADY' then 'STABLE' else 'UNKNOWN' end as trend from (select event_id, list_value('rising', ' steady ', 'FALLING', event_type)[cast(event_id % 4 as integer) + 1] as event_type from events)")
def normalize_trend(spark, sf_dir):
    said = F.get(F.array(F.lit("rising"), F.lit(" steady "), F.lit("FALLING"), F.col("event_type")), (F.col("event_id") % 4).cast("int"))
    return D.table(spark, sf_dir, "events").select("event_id", C.normalize_trend(said).alias("trend"))


@query("select station_id, run_id, coalesce(nullif(trim(basin_name), ''), 'Unknown') as basin, trim(station_name) = '' as blank_name, nullif(trim(station_name), '') as clean_name from sta")
def basin_label(spark, sf_dir):
    """basin_label, is_blank and clean_text over all stations."""
    return D.stations(spark, sf_dir).select("station_id", "run_id", C.basin_label(F.col("basin_name")).alias("basin"), C.is_blank(F.col("station_name")).alias("blank_name"), C.clean_text(F.col("station_name")).alias("clean_name"))


@query("""select event_id, (epoch(ingested_at) - epoch(observed_at)) / 3600.0 as age_hours,
    case when epoch(ingested_at) < epoch(observed_at) then 'future' when epoch(ingested_at) - epoch(observed_at) <= 86400 then 'fresh' else 'stale' end as freshness from obs""")
def freshness_status(spark, sf_dir):
    """observation_age_hours and freshness_status of all observations."""
    age = C.observation_age_hours(F.col("observed_at"), F.col("ingested_at"))
    return D.observations(spark, sf_dir).select("event_id", age.alias("age_hours"), C.freshness_status(F.col("observed_at").isNotNull(), age).alias("freshness"))


@query("select event_id, longitude as lon, latitude as lat, case when event_id % 3 = 0 then null else observed_at end as parsed from obs")
def point_coordinates(spark, sf_dir):
    """point_lon, point_lat and safe_timestamp of all observations."""
    point = F.struct(F.array("longitude", "latitude").alias("coordinates"))
    text = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return D.observations(spark, sf_dir).select("event_id", C.point_lon(point).alias("lon"), C.point_lat(point).alias("lat"), C.safe_timestamp(text).alias("parsed"))


@query("select station_id, run_id, nullif(trim(station_name), '') as name from sta")
def clean_text(spark, sf_dir):
    return D.stations(spark, sf_dir).select("station_id", "run_id", C.clean_text(F.col("station_name")).alias("name"))


@query("select station_id, run_id, station_series_id is null or trim(station_series_id) = '' as blank_series, trim(station_name) = '' as blank_name from sta")
def is_blank(spark, sf_dir):
    return D.stations(spark, sf_dir).select("station_id", "run_id", C.is_blank(F.col("station_series_id")).alias("blank_series"), C.is_blank(F.col("station_name")).alias("blank_name"))


def _point() -> Column:
    """A point that lacks its latitude for every fifth event, and all for every seventh."""
    short = F.when(F.col("event_id") % 5 == 0, F.array("longitude")).otherwise(F.array("longitude", "latitude"))
    return F.when(F.col("event_id") % 7 != 0, F.struct(short.alias("coordinates")))


@query("select event_id, case when event_id % 7 <> 0 then longitude end as lon from obs")
def point_lon(spark, sf_dir):
    return D.observations(spark, sf_dir).select("event_id", C.point_lon(_point()).alias("lon"))


@query("select event_id, case when event_id % 7 <> 0 and event_id % 5 <> 0 then latitude end as lat from obs")
def point_lat(spark, sf_dir):
    return D.observations(spark, sf_dir).select("event_id", C.point_lat(_point()).alias("lat"))


@query("select event_id, case when event_id % 3 <> 0 then observed_at end as parsed from obs")
def safe_timestamp(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("on "), F.col("station_id"))).otherwise(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return D.observations(spark, sf_dir).select("event_id", C.safe_timestamp(text).alias("parsed"))


@query("select event_id, (epoch(ingested_at) - epoch(observed_at)) / 3600.0 as age_hours from obs")
def observation_age_hours(spark, sf_dir):
    return D.observations(spark, sf_dir).select("event_id", C.observation_age_hours(F.col("observed_at"), F.col("ingested_at")).alias("age_hours"))


@query("select station_id, has_observation from snap")
def has_observation(spark, sf_dir):
    return snapshot(spark, sf_dir).select("station_id", "has_observation")


# Quality


def joined_rules() -> list[Column]:
    return [F.array_join("quality_errors", ",").alias("errors"), F.array_join("quality_warnings", ",").alias("warnings")]



def graded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.observation_quality(D.observations(spark, sf_dir, 0.25))


@query("select event_id, run_id, errors, warnings, quality_status from oqs")
def observation_quality(spark, sf_dir):
    return graded_observations(spark, sf_dir).select("event_id", "run_id", *joined_rules(), "quality_status")


@query("select station_id, run_id, errors, warnings, case when errors <> '' then 'fail' when warnings <> '' then 'warn' else 'pass' end as quality_status from sq")
def station_quality(spark, sf_dir):
    return Q.station_quality(D.stations(spark, sf_dir)).select("station_id", "run_id", *joined_rules(), "quality_status")


@query("select event_id, concat_ws(',', case when water_level_m is null then 'no_level' end, case when warning_level_m > danger_level_m then 'odd_levels' end) as flags from obs")
def rule_flags(spark, sf_dir):
    rules = [("no_level", F.col("water_level_m").isNull()), ("odd_levels", F.col("warning_level_m") > F.col("danger_level_m"))]
    return D.observations(spark, sf_dir).select("event_id", F.array_join(C.rule_flags(rules), ",").alias("flags"))


@query("select event_id, latitude is not null and (latitude < -90 or latitude > 90) as bad_latitude, longitude < -180 or longitude > 180 as bad_longitude from obs")
def range_rule(spark, sf_dir):
    c = F.col
    return D.observations(spark, sf_dir).select("event_id", Q.outside(c("latitude"), 90).alias("bad_latitude"), Q.outside(c("longitude"), 180).alias("bad_longitude"))


@query("select event_id, latitude is null or longitude is null as no_pair from obs")
def missing_pair_rule(spark, sf_dir):
    return D.observations(spark, sf_dir).select("event_id", Q.missing_pair(F.col("latitude"), F.col("longitude")).alias("no_pair"))


@query("select event_id, coalesce(warning_level_m > danger_level_m, false) as odd_levels from obs")
def cross_field_rule(spark, sf_dir):
    return D.observations(spark, sf_dir).select("event_id", Q.above(F.col("warning_level_m"), F.col("danger_level_m")).alias("odd_levels"))


@query(f"select event_id, endpoint = '{RIVER_STATIONS}' and epoch(ingested_at) - epoch(observed_at) > 86400 as stale from obs")
def stale_rule(spark, sf_dir):
    return D.observations(spark, sf_dir).select("event_id", Q.stale(24.0).alias("stale"))


@query("select o.event_id, r.run_id is not null as repeated from obs_dup o left join dup_rec r on o.run_id = r.run_id and o.source_record_id = r.source_record_id")
def duplicate_in_run(spark, sf_dir):
    return Q.duplicate_in_run(D.observations(spark, sf_dir, 0.25), ["source_record_id"], "repeated").select("event_id", "repeated")


@query("select event_id from oqs where contains(warnings, 'warning_above_danger')")
def rows_by_rule(spark, sf_dir):
    return Q.rows_by_rule(graded_observations(spark, sf_dir), "warning_above_danger").select("event_id")


@query("select event_id, quality_status from oqs where quality_status <> 'pass'")
def rows_not_passing(spark, sf_dir):
    return Q.rows_not_passing(graded_observations(spark, sf_dir)).select("event_id", "quality_status")


@query("select run_id, quality_status, count(*) as n_rows from oqs group by all")
def status_counts(spark, sf_dir):
    return Q.status_counts(graded_observations(spark, sf_dir), ["run_id"])


_FIRED = "select run_id, 'error' as severity, unnest(string_split(errors, ',')) as rule from oqs union all select run_id, 'warning', unnest(string_split(warnings, ',')) from oqs"


@query(f"select run_id, severity, rule, count(*) as n_rows from ({_FIRED}) where rule <> '' group by all")
def rule_counts(spark, sf_dir):
    return Q.rule_counts(graded_observations(spark, sf_dir), ["run_id"])


@query(f"""select t.*, e.rules as error_rules, w.rules as warning_rules from (select run_id, count(*) as total_rows, count(*) filter (quality_status = 'pass') as pass_rows, count(*) filter (quality_status = 'warn') as warn_rows, count(*) filter (quality_status = 'fail') as fail_rows,
    count(*) filter (quality_status <> 'pass') as affected_rows, count(*) filter (quality_status = 'pass')::double / count(*) as pass_ratio,
    case when count(*) filter (quality_status = 'fail') > 0 then 'fail' when count(*) filter (quality_status = 'warn') > 0 then 'warn' else 'pass' end as status from oqs group by 1) t
    left join (select run_id, string_agg(rule || '=' || n, ',' order by rule) as rules from (select run_id, rule, count(*) as n from ({_FIRED}) where rule <> '' and severity = 'error' group by all) group by 1) e using (run_id)
    left join (select run_id, string_agg(rule || '=' || n, ',' order by rule) as rules from (select run_id, rule, count(*) as n from ({_FIRED}) where rule <> '' and severity = 'warning' group by all) group by 1) w using (run_id)""")
def dataset_quality_summary(spark, sf_dir):
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["rule"], F.lit("="), x["n_rows"].cast("string"))), ",")
    out = Q.dataset_quality_summary(graded_observations(spark, sf_dir), ["run_id"])
    return out.withColumn("error_rules", said("error_counts")).withColumn("warning_rules", said("warning_counts")).drop("error_counts", "warning_counts")


@query(f"""select *, total_stations - stations_with_observation as stations_without_observation, stations_with_observation::double / total_stations as coverage_ratio, fresh_observations::double / total_observations as freshness_ratio,
    case when fresh_observations = 0 then 'fail' when total_stations > stations_with_observation or stale_observations > 0 or future_observations > 0 then 'warn' else 'pass' end as status
    from (select s.run_id, count(*) as total_stations, count(o.station_id) as stations_with_observation from (select distinct run_id, station_id from sta) s
    left join (select distinct run_id, station_id from obs where endpoint = '{RIVER_STATIONS}') o on s.run_id = o.run_id and s.station_id = o.station_id group by 1)
    join (select run_id, count(*) as total_observations, count(*) filter (a between 0 and 86400) as fresh_observations, count(*) filter (a > 86400) as stale_observations, count(*) filter (a < 0) as future_observations,
    count(*) filter (a is null) as unassessable_observations, min(observed_at) as oldest_observed_at, max(observed_at) as latest_observed_at from (select *, epoch(ingested_at) - epoch(observed_at) as a from obs where endpoint = '{RIVER_STATIONS}') group by 1) using (run_id)""")
def current_data_health(spark, sf_dir):
    s, o = both(spark, sf_dir)
    return Q.current_data_health(s, o.where(F.col("endpoint") == RIVER_STATIONS))


# Raw pages, validation, lineage


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = D.raw_lake(spark, sf_dir)
    return L.scan_raw_pages(spark, lake, RIVER, typed=False).unionByName(L.scan_raw_pages(spark, lake, RIVER_STATIONS, typed=False))


def records(spark: SparkSession, sf_dir: str, endpoint: str) -> DataFrame:
    pages = L.scan_raw_pages(spark, D.raw_lake(spark, sf_dir), endpoint, typed=False)
    return L.parse_records(L.explode_records(pages, D.captures(spark, sf_dir)), endpoint)


_PAGES = "select endpoint, run_id, cast(page as integer) as page_index, count(*) as n, count(*) filter (no_object) as odd from raw group by all"


@query(f"select endpoint, run_id, page_index, n as stated, case when odd = 0 then n end as typed_records from ({_PAGES})")
def scan_raw_pages(spark, sf_dir):
    """Typed pages; an element that is no object takes its page's records with it."""
    lake = D.raw_lake(spark, sf_dir)
    scans = [L.scan_raw_pages(spark, lake, e) for e in (RIVER, RIVER_STATIONS)]  # each is listed once
    pages = scans[0].drop("results").unionByName(scans[1].drop("results"))
    sizes = [s.select("file", F.when(F.col("results").isNotNull(), F.size("results").cast("bigint")).alias("typed_records")) for s in scans]
    return pages.join(sizes[0].union(sizes[1]), "file").select("endpoint", "run_id", "page_index", F.col("count").alias("stated"), "typed_records")


@query(f"select endpoint, run_id, page_index, n as records, n as stated from ({_PAGES})")
def raw_page_counts(spark, sf_dir):
    return L.raw_page_counts(text_pages(spark, sf_dir)).withColumn("records", F.col("records").cast("bigint"))


@query("select run_id, cast(page as integer) as source_page_index, case when not bad_id then event_id end as id, ingested_at from raw where not no_object")
def explode_records(spark, sf_dir):
    wanted = ["run_id", "source_page_index", F.col("record.id").alias("id"), "ingested_at"]
    return records(spark, sf_dir, RIVER).select(*wanted).union(records(spark, sf_dir, RIVER_STATIONS).select(*wanted))


_TREND = "case cast(event_id % 4 as integer) when 0 then 'RISING' when 1 then 'STABLE' when 2 then 'FALLING' else 'UNKNOWN' end as trend"


@query(f"""select case when not bad_id then cast(event_id as varchar) end as source_record_id, station_id, case when event_id % 29 <> 0 then ' Gauge ' || station_id end as station_name, case when event_id % 37 <> 0 then latitude end as latitude, case when latitude is not null then longitude end as longitude,
    case when not bad_time then observed_at end as observed_at, water_level_m, warning_level_m, {_TREND}, ingested_at, run_id, cast(page as integer) as source_page_index from raw where endpoint = '{RIVER}' and not no_object""")
def transform_historical_observations(spark, sf_dir):
    rows = transforms.transform_historical_observations(records(spark, sf_dir, RIVER))
    return rows.select("source_record_id", "station_id", "station_name", "latitude", "longitude", "observed_at", "water_level_m", "warning_level_m", "trend", "ingested_at", "run_id", "source_page_index")


@query(f"""select case when not bad_id then cast(event_id as varchar) end as station_id, case when event_id % 3 <> 0 then 'Upper ' end as basin_name, case when latitude is not null then longitude end as longitude, event_id % 7 as province_id, observed_at as source_created_at, ingested_at, run_id, cast(page as integer) as source_page_index
    from raw where endpoint = '{RIVER_STATIONS}' and not no_object""")
def transform_stations(spark, sf_dir):
    rows = transforms.transform_stations(records(spark, sf_dir, RIVER_STATIONS))
    return rows.select("station_id", "basin_name", "longitude", "province_id", "source_created_at", "ingested_at", "run_id", "source_page_index")


@query(f"""select case when not bad_id then 'station-snapshot:' || event_id || ':' || strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') end as source_record_id, case when not bad_id then cast(event_id as varchar) end as station_id, observed_at, water_level_m, {_TREND}, run_id
    from raw where endpoint = '{RIVER_STATIONS}' and not no_object and not bad_time""")
def transform_station_observations(spark, sf_dir):
    rows = transforms.transform_station_observations(records(spark, sf_dir, RIVER_STATIONS))
    return rows.select("source_record_id", "station_id", "observed_at", "water_level_m", "trend", "run_id")


def validated(spark: SparkSession, sf_dir: str, endpoint: str) -> DataFrame:
    return validation.validate_records(L.scan_raw_pages(spark, D.raw_lake(spark, sf_dir), endpoint, typed=False), endpoint)


def all_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, RIVER).drop("record").union(validated(spark, sf_dir, RIVER_STATIONS).drop("record"))


_INDEXED = "select *, row_number() over (partition by endpoint, run_id order by event_id) - 1 as record_index from raw"
_ISSUES = f"""select endpoint, run_id, record_index, case when no_object then 'model_type@' else concat_ws(';', case when bad_id then 'int_type@id' end, case when event_id % 29 = 0 then 'missing@title' end,
    case when latitude is null then 'missing@point' when event_id % 37 = 0 then 'missing@point.coordinates' end, case when bad_time then 'datetime_type@waterLevelOn' end) end as issues from ({_INDEXED})"""


def _issue_texts(rows: DataFrame) -> DataFrame:
    said = F.transform("issues", lambda i: F.concat(i["error_type"], F.lit("@"), F.array_join(i["location"], ".")))
    return rows.select("endpoint", "run_id", F.col("record_index").cast("bigint").alias("record_index"), F.array_join(said, ";").alias("issues"))


@query(_ISSUES)
def validate_records(spark, sf_dir):
    return _issue_texts(all_validated(spark, sf_dir))


@query(f"select run_id, record_index, issues from ({_ISSUES}) where endpoint = '{RIVER}' and issues <> ''")
def rules_river(spark, sf_dir):
    return _issue_texts(validation.split_valid(validated(spark, sf_dir, RIVER))[1]).drop("endpoint")


@query(f"select run_id, record_index, issues from ({_ISSUES}) where endpoint = '{RIVER_STATIONS}' and issues <> ''")
def rules_station(spark, sf_dir):
    return _issue_texts(validation.split_valid(validated(spark, sf_dir, RIVER_STATIONS))[1]).drop("endpoint")


@query(f"select split_part(issue, '@', 1) as error_type, split_part(issue, '@', 2) as location, count(*) as n_rows from (select unnest(string_split(issues, ';')) as issue from ({_ISSUES}) where issues <> '') group by all")
def validation_issues(spark, sf_dir):
    rows = all_validated(spark, sf_dir).select(F.explode("issues").alias("i")).select("i.error_type", F.array_join("i.location", ".").alias("location"))
    return rows.groupBy("error_type", "location").agg(F.count(F.lit(1)).alias("n_rows"))


_METRICS = f"""select endpoint, run_id, count(*) as records_received, count(*) filter (issues = '') as records_valid, count(*) filter (issues <> '') as records_invalid,
    count(*) filter (issues = '' and endpoint = '{RIVER_STATIONS}') as stations_emitted, count(*) filter (issues = '') as observations_emitted, 0::bigint as records_without_observation from ({_ISSUES}) group by 1, 2"""


@query(_METRICS)
def ingestion_metrics(spark, sf_dir):
    return validation.ingestion_metrics(all_validated(spark, sf_dir))


@query(f"""select endpoint, run_id, case when endpoint = '{RIVER}' then 'valid_plus_invalid,batch_total' else 'observations_above_valid,quarantined_not_invalid' end as violations from ({_METRICS}) where records_valid > 0""")
def metrics_invariants(spark, sf_dir):
    """The runs' numbers, of which some are changed: history lacks a valid record, snapshots have observations and quarantined records too many."""
    river = F.col("endpoint") == RIVER
    said = validation.ingestion_metrics(all_validated(spark, sf_dir)).where("records_valid > 0").withColumns({
        "records_valid": F.col("records_valid") - river.cast("int"), "observations_emitted": F.when(river, F.col("observations_emitted") - 1).otherwise(F.col("records_valid") + 1),
        "quarantined": F.col("records_invalid") + F.when(river, 0).otherwise(2),
    })
    return validation.metrics_invariants(said).select("endpoint", "run_id", F.array_join("violations", ",").alias("violations"))


@query(f"select endpoint, run_id from ({_METRICS})")
def metrics_without_violations(spark, sf_dir):
    """The runs whose own numbers contradict nothing: all of them."""
    metrics = validation.ingestion_metrics(all_validated(spark, sf_dir))
    metrics = metrics.withColumn("quarantined", F.col("records_invalid"))
    return metrics.join(validation.metrics_invariants(metrics).select("endpoint", "run_id"), ["endpoint", "run_id"], "left_anti").select("endpoint", "run_id")


@query(f"""select cast(event_id as varchar) as source_record_id, station_id, 'Gauge ' || station_id as station_name, case when event_id % 3 <> 0 then 'Upper' end as basin_name, observed_at, {_TREND}
    from raw where endpoint = '{RIVER}' and not (no_object or bad_id or bad_time or event_id % 29 = 0 or event_id % 37 = 0 or latitude is null)""")
def map_domain(spark, sf_dir):
    valid = validation.split_valid(validated(spark, sf_dir, RIVER))[0].join(F.broadcast(D.captures(spark, sf_dir).withColumnRenamed("captured_at", "ingested_at")), "run_id").withColumnRenamed("page_index", "source_page_index")
    return transforms.map_domain(valid, RIVER)["observations"].select("source_record_id", "station_id", "station_name", "basin_name", "observed_at", "trend")


@query(f"select endpoint, run_id, record_index, issues from ({_ISSUES}) where issues <> ''")
def quarantine_sink(spark, sf_dir):
    """Envelopes of the invalid records, written and read again."""
    path = D.shared_path(spark, "quarantine")
    bad = all_validated(spark, sf_dir).where("size(issues) > 0").join(F.broadcast(D.captures(spark, sf_dir)), "run_id")
    L.write_quarantine(L.quarantine_envelopes(bad, "gauges"), path)
    kind = f"provider string, endpoint string, run_id string, captured_at timestamp, page_index int, record_index bigint, raw_record string, issues array<{validation.ISSUE}>"
    return _issue_texts(spark.read.schema(kind).json(path))


@query(f"select endpoint, run_id, page_index, n as record_count, 64 as digest_length from ({_PAGES})")
def raw_lineage(spark, sf_dir):
    lake = D.raw_lake(spark, sf_dir)
    rows = L.raw_lineage(spark, lake, RIVER).unionByName(L.raw_lineage(spark, lake, RIVER_STATIONS))
    return rows.select("endpoint", "run_id", "page_index", "record_count", F.length("payload_sha256").alias("digest_length"))


@query(f"select endpoint, run_id, count(*) as pages from ({_PAGES}) group by all")
def scan_manifests(spark, sf_dir):
    return L.scan_manifests(spark, D.raw_lake(spark, sf_dir)).select("endpoint", "run_id", F.size("raw_pages").cast("bigint").alias("pages"))


@query(f"select endpoint, max(run_id) as run_id from ({_PAGES}) group by 1")
def latest_manifest(spark, sf_dir):
    return L.latest_manifest(L.scan_manifests(spark, D.raw_lake(spark, sf_dir))).select("endpoint", "run_id")


@query(f"select endpoint, run_id, page_index, case page_index % 5 when 1 then 'mismatch' when 2 then 'missing' else 'ok' end as status from ({_PAGES})")
def verify_lineage(spark, sf_dir):
    """Manifests of which some pages are said to be other bytes, or elsewhere."""
    lake = D.raw_lake(spark, sf_dir)
    odd = lambda p: F.struct(
        p["page_index"].alias("page_index"), F.when(p["page_index"] % 5 == 2, F.concat(p["payload_key"], F.lit(".gone"))).otherwise(p["payload_key"]).alias("payload_key"),
        F.when(p["page_index"] % 5 == 1, F.reverse(p["payload_sha256"])).otherwise(p["payload_sha256"]).alias("payload_sha256"),
    )
    listed = L.scan_manifests(spark, lake).withColumn("raw_pages", F.transform("raw_pages", odd))
    return L.verify_lineage(listed, L.raw_lineage(spark, lake, RIVER).unionByName(L.raw_lineage(spark, lake, RIVER_STATIONS))).drop("payload_key")


# Runs

_DONE = f"""select run_id, endpoint, 'observations' as dataset, count(*) as row_count from raw where not no_object and (endpoint = '{RIVER}' or not bad_time) group by 1, 2
    union all select run_id, endpoint, 'stations', count(*) from raw where not no_object and endpoint = '{RIVER_STATIONS}' group by 1, 2"""
_processed: dict[tuple, str] = {}


def processed_lake(spark: SparkSession, sf_dir: str) -> str:
    """The raw lake with all its runs processed, once for a session and input."""
    key = D.input_key(spark, sf_dir)
    if key not in _processed:
        lake = D.raw_lake(spark, sf_dir)
        runs.process_runs_idempotent(spark, lake)
        _processed[key] = lake
    return _processed[key]


@query(_DONE)
def process_runs_idempotent(spark, sf_dir):
    """Processes all runs; processing again leaves everything as it is."""
    return runs.process_runs_idempotent(spark, processed_lake(spark, sf_dir))


@query(f"select run_id, endpoint, dataset, 'complete' as state, row_count from ({_DONE})")
def committed_runs(spark, sf_dir):
    lake = processed_lake(spark, sf_dir)
    present = [L.scan_processed(spark, lake, d).select("run_id", F.lit(d).alias("dataset")) for d in ("stations", "observations")]
    return runs.committed_runs(L.scan_manifests(spark, lake), runs.commit_log(spark, lake), present[0].union(present[1]))


_BAD = ", ".join(f"'{r}'" for r in D.DAMAGED)


@query(f"""select endpoint, run_id, 1::bigint as manifests, count(*) as pages, (run_id = 'run-0-river')::bigint as missing, (run_id = 'run-1-river-stations')::bigint as mismatched, (run_id = 'run-2-river')::bigint as miscounted
    from ({_PAGES}) where run_id in ({_BAD}) group by 1, 2""")
def rejected_runs(spark, sf_dir):
    """The runs of a damaged lake that processing keeps apart."""
    lake = D.damaged_lake(spark, sf_dir)
    runs.process_runs_idempotent(spark, lake)
    return runs.rejected_runs(spark, lake).drop("rejected_at")


@query(f"select * from ({_DONE}) where run_id not in ({_BAD})")
def process_stream_damaged(spark, sf_dir):
    """A damaged lake's manifests as a stream: the intact runs are committed, the others aren't."""
    lake = D.damaged_lake(spark, sf_dir)
    S.finished(S.process_stream(spark, lake, D.shared_path(spark, "stream-state")))
    return runs.commit_log(spark, lake).select("run_id", "endpoint", "dataset", "row_count")


@query(f"""select run_id, 'observations' as dataset, count(*) as n_rows, min(observed_at) filter (not bad_time) as first_at, max(observed_at) filter (not bad_time) as last_at from raw where not no_object and (endpoint = '{RIVER}' or not bad_time) group by 1
    union all select run_id, 'stations', count(*), max(ingested_at), max(ingested_at) from raw where not no_object and endpoint = '{RIVER_STATIONS}' group by 1""")
def file_catalog(spark, sf_dir):
    """The committed files' rows and times, by run."""
    lake = processed_lake(spark, sf_dir)
    of = lambda d: runs.file_catalog(spark, lake, d).withColumn("dataset", F.lit(d))
    return of("observations").unionByName(of("stations")).groupBy("run_id", "dataset").agg(F.sum("rows").alias("n_rows"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


@query(f"""select endpoint, run_id, source_page_index, count(*) as n_rows, count(water_level_m) as levels from (select *, cast(page as integer) as source_page_index from raw) where not no_object and not bad_time
    and observed_at >= timestamp '2024-01-08' and observed_at < timestamp '2024-01-22' group by 1, 2, 3""")
def scan_committed(spark, sf_dir):
    """Observations of a time, of which only the files that may hold some are opened."""
    rows = runs.scan_committed(spark, processed_lake(spark, sf_dir), "observations", start=START, end=END)
    return rows.groupBy("endpoint", "run_id", "source_page_index").agg(F.count(F.lit(1)).alias("n_rows"), F.count("water_level_m").alias("levels"))


@query(f"select endpoint, run_id, count(*) as n_rows, count(*) filter (water_level_m is not null) as levels from raw where not no_object and (endpoint = '{RIVER}' or not bad_time) group by 1, 2")
def scan_processed(spark, sf_dir):
    rows = L.scan_processed(spark, processed_lake(spark, sf_dir), "observations")
    return rows.groupBy("endpoint", "run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("water_level_m").alias("levels"))


@query("select endpoint, run_id, year(ingested_at) as year, month(ingested_at) as month, day(ingested_at) as day, hour(ingested_at) as hour, count(*) as n_rows from sta group by all")
def write_processed(spark, sf_dir):
    """Stations written to a new lake and read again with the columns of their paths."""
    lake = D.shared_path(spark, "processed")
    L.write_processed(D.stations(spark, sf_dir), lake, "stations")
    keys = ["endpoint", "run_id", "year", "month", "day", "hour"]
    hours = L.scan_processed(spark, lake, "stations").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return hours.withColumns({c: F.col(c).cast("bigint") for c in keys[2:]})


@query("select run_id, count(*) as total_rows, count(*) filter (quality_status = 'fail') as fail_rows from oqs group by 1")
def write_quality_report(spark, sf_dir):
    """Reports of all runs, written as JSON and read again."""
    path = D.shared_path(spark, "reports")
    L.write_quality_report(Q.dataset_quality_summary(graded_observations(spark, sf_dir), ["run_id"]), path)
    return spark.read.schema("run_id string, total_rows bigint, fail_rows bigint").json(path)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.concat(F.lit("event-"), D.event_uuid(F.col("user_id")))
    run = F.when(F.col("event_type") == "view", F.concat(prefix, F.lit("-odd"))).otherwise(F.concat(prefix, F.format_string("-attempt-%04d", F.col("event_id") % 40)))
    return D.table(spark, sf_dir, "events").select(run.alias("run_id"), "event_type")


@query(f"""with r as (select 'event-' || {D.event_uuid_sql('user_id')} as prefix, event_id % 40 as n, event_type from events where event_type <> 'view') select a.prefix, cast(a.n + 1 as integer) as next_attempt, d.prefix || '-attempt-' || lpad(cast(d.lo as varchar), 4, '0') as completed_run, coalesce(d.c, 0) > 1 as conflict
    from (select prefix, max(n) as n from r group by 1) a left join (select prefix, min(n) as lo, count(distinct n) as c from r where event_type = 'purchase' group by 1) d using (prefix)""")
def run_catalog(spark, sf_dir):
    tries = _attempts(spark, sf_dir)
    paths = tries.select(F.concat(F.lit("raw/run_id="), "run_id", F.lit("/page=0/payload.json")).alias("path"))
    return runs.run_catalog(paths, tries.where("event_type = 'purchase'").select("run_id", F.lit("completed").alias("status")))


@query(f"""with r as (select 'event-' || {D.event_uuid_sql('user_id')} as prefix, event_id % 5 + 1 as n, event_type from events where event_type not in ('view', 'error'))
    select a.prefix, cast(a.n + 1 as integer) as next_attempt, d.prefix || '-attempt-' || lpad(cast(d.lo as varchar), 4, '0') as completed_run, coalesce(d.c, 0) > 1 as conflict
    from (select prefix, max(n) as n from r group by 1) a left join (select prefix, min(n) as lo, count(distinct n) as c from r where event_type = 'purchase' group by 1) d using (prefix)""")
def run_catalog_listed(spark, sf_dir):
    """Attempts found by listing a lake's raw, quarantine and manifest files, some of which have names that are none."""
    lake = D.attempts_lake(spark, sf_dir)
    return runs.run_catalog(L.lake_files(spark, lake), L.scan_manifests(spark, lake))


# Events


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decode_events(D.pipeline_lines(spark, sf_dir))


def valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decoded_events(spark, sf_dir).where("size(errors) = 0").drop("errors")


@query("""select line, event_id, event_type, occurred_at, case when event_type = 'page.viewed' then 'event_type' else '' end as errors from ev
    union all select event_id, null, null, null, 'event_id,event_type,occurred_at,correlation_id,schema_version,data' from events where event_type = 'error'""")
def decode_events(spark, sf_dir):
    return decoded(spark, sf_dir).select("line", "event_id", "event_type", "occurred_at", F.array_join("errors", ",").alias("errors"))


@query("select cast(event_id % (select count(*) // 4 from events) as varchar) as event_id, min(event_id) as line from events group by 1")
def dedupe_events(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    quarter = events.agg(F.floor(F.count(F.lit(1)) / 4)).scalar()
    repeated = events.select((F.col("event_id") % quarter).cast("string").alias("event_id"), F.col("event_id").alias("line"))
    return E.dedupe_events(repeated, "line")


@query("""select 'req-' || cast(event_id % (select count(*) // 3 from events) as varchar) as request_id, count(*) as records, count(distinct cast(user_id % 3 as varchar) || '/' || (event_type = 'error')) as versions from events group by 1 having versions > 1""")
def execution_conflicts(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    third = events.agg(F.floor(F.count(F.lit(1)) / 3)).scalar()
    said = events.select(F.concat(F.lit("req-"), (F.col("event_id") % third).cast("string")).alias("request_id"), (F.col("user_id") % 3).alias("owner"), (F.col("event_type") == "error").alias("bad"))
    return E.execution_conflicts(said)


_RETRY = """select request_id, count(*) as attempts, min(tried) as first_failed_at, max(tried) as last_failed_at, arg_max(error_type, tried) as last_error_type, arg_max(error_message, tried) as last_error_message
    from att left join (select request_id, max(tried) as cleared_at from att where ok group by 1) using (request_id) where not ok and (cleared_at is null or tried > cleared_at) group by 1"""


@query(_RETRY)
def retry_state(spark, sf_dir):
    return E.retry_state(D.outcomes(spark, sf_dir))


@query(f"select *, case when attempts >= 2 then 'dead-letter' else 'pending' end as route from ({_RETRY})")
def dead_letter_split(spark, sf_dir):
    return E.dead_letter_split(E.retry_state(D.outcomes(spark, sf_dir)), max_attempts=2)


@query("select line, event_id from ev where event_type = 'ingestion.requested'")
def pending_by_type(spark, sf_dir):
    """One type's events, of which alone the lines are decoded."""
    lines = E.decode_events(D.pipeline_lines(spark, sf_dir), types=EVENT_TYPES[:1])
    return E.pending_by_type(lines.where("size(errors) = 0"), EVENT_TYPES[0]).select("line", "event_id")


@query("""select r.event_id as request_event_id, i.event_id as ingestion_event_id, p.event_id as processing_event_id from (select * from ev where event_type = 'ingestion.requested') r
    left join (select * from ev where event_type = 'ingestion.completed') i on i.request_event_id = r.event_id left join (select * from ev where event_type = 'processing.completed') p on p.ingestion_event_id = i.event_id""")
def pipeline_trace(spark, sf_dir):
    return E.pipeline_trace(valid_events(spark, sf_dir)).select("request_event_id", "ingestion_event_id", "processing_event_id")


def _receipts(spark: SparkSession, sf_dir: str, run: Column | None = None, kept: str = "true") -> DataFrame:
    run = F.col("line") % 3 if run is None else run
    done = E.pending_by_type(valid_events(spark, sf_dir), EVENT_TYPES[1]).where(kept).select("event_id", "correlation_id", F.concat(F.lit("run-"), run.cast("string")).alias("run_id"), F.lit(RIVER).alias("endpoint"))
    counts = D.observations(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count"), F.max("ingested_at").alias("completed_at"))
    return E.completion_receipts(done, counts)


@query("""select e.event_id as ingestion_event_id, 'run-' || cast(e.line % 3 as varchar) as run_id, cast(c.n as varchar) as row_count from ev e join (select run_id, count(*) as n from obs group by 1) c on c.run_id = 'run-' || cast(e.line % 3 as varchar) where e.event_type = 'ingestion.completed'""")
def completion_receipts(spark, sf_dir):
    rows = _receipts(spark, sf_dir)
    return rows.select(*(F.element_at("data", c).alias(c) for c in ("ingestion_event_id", "run_id", "row_count")))


@query("""select event_id as ingestion_event_id, case when line % 11 = 0 then 'unknown' else 'changed' end as kind, 'run-' || cast(case when line % 7 = 0 then line + 1 else line end % 3 as varchar) as said_run
    from ev where event_type = 'ingestion.completed' and (line % 7 = 0 or line % 11 = 0)""")
def receipt_violations(spark, sf_dir):
    """Receipts, of which some name another run and all another time, against recomputed ones, of which some are missing."""
    line = F.col("line")
    said = _receipts(spark, sf_dir, F.when(line % 7 == 0, line + 1).otherwise(line) % 3).withColumn("occurred_at", F.expr("occurred_at + interval 1 hour"))
    found = E.receipt_violations(said, _receipts(spark, sf_dir, kept="line % 11 <> 0"))
    of = lambda name: F.get_json_object("said", f"$.data.{name}")
    return found.select(of("ingestion_event_id").alias("ingestion_event_id"), "kind", of("run_id").alias("said_run"))


_RUN_NUMBERS = " union all ".join(f"select 'run-{i // 2}-{(RIVER, RIVER_STATIONS)[i % 2]}' as run_id, {i} as k" for i in range(6))


@query(f"""select s.endpoint, run_id, 'quality/endpoint=' || s.endpoint || hour_path || '/run-' || run_id || '/processing-completed.json' as path,
    'processed/dataset=observations/endpoint=' || s.endpoint || hour_path || '/run-' || run_id as observation_output_path, s.outputs, e.event_id as ingestion_event_id, e.request_event_id
    from (select run_id, endpoint, case when endpoint = '{RIVER}' then 1 else 2 end::bigint as outputs, strftime(max(ingested_at), '/year=%Y/month=%m/day=%d/hour=%H') as hour_path from raw group by all) s
    join ({_RUN_NUMBERS}) k using (run_id) join (select line % 6 as k, min(line) as line from ev where event_type = 'ingestion.completed' group by 1) f using (k) join ev e using (line)""")
def stored_receipts(spark, sf_dir):
    """Receipts of the processed runs, each by the first ingestion event of its number, written to the lake and read again; writing again changes nothing."""
    lake = processed_lake(spark, sf_dir)
    numbers = spark.sql(_RUN_NUMBERS)
    # One type's events, of which alone the lines are decoded; kept, one row for each run, as receipts are stored twice.
    lines = E.decode_events(D.pipeline_lines(spark, sf_dir), types=EVENT_TYPES[1:2]).where("size(errors) = 0")
    done = E.pending_by_type(lines, EVENT_TYPES[1])
    first = done.groupBy((F.col("line") % 6).cast("int").alias("k")).agg(F.min_by(F.struct("event_id", "correlation_id", F.element_at("data", "request_event_id").alias("request_event_id")), "line").alias("e"))
    kept = D.shared_path(spark, "ingested")
    first.select("k", "e.*").coalesce(1).write.parquet(kept)
    ingested = spark.read.parquet(kept).join(numbers, "k").drop("k")
    manifests = L.scan_manifests(spark, lake).withColumn("manifest_path", F.concat(F.lit("manifests/"), "run_id"))
    found = receipts.processing_receipts(ingested, receipts.run_results(manifests, runs.commit_log(spark, lake)))
    for _ in range(2):
        stored = receipts.store_receipts(spark, lake, found)
    of = lambda name: F.element_at("data", name).alias(name)
    outputs = F.size(F.filter(F.map_keys("data"), lambda k: k.like("%output_path"))).cast("bigint").alias("outputs")
    return stored.where("size(errors) = 0").select(of("endpoint"), of("run_id"), "path", of("observation_output_path"), outputs, of("ingestion_event_id"), of("request_event_id"))


_PLANTED = {"line % 7 = 0": "path", "line % 11 = 0": "observation_output_path", "line % 13 = 0": "provider", "line % 3 = 0 and line % 5 = 0": "station_output_path", "line % 17 = 0": "request_event_id"}


@query("select line, faults from (select line, concat_ws(',', " + ", ".join(f"case when {w} then '{n}' end" for w, n in sorted(_PLANTED.items(), key=lambda x: ("provider", "observation_output_path", "station_output_path", "request_event_id", "path").index(x[1])))
       + ") as faults from ev where event_type = 'ingestion.completed') where faults <> ''")
def receipt_faults(spark, sf_dir):
    """A receipt for each ingestion event, of which some are at a wrong path, lack an output or an id, or are of an unknown provider."""
    bad = {n: F.expr(w) for w, n in _PLANTED.items()}
    done = E.pending_by_type(valid_events(spark, sf_dir), EVENT_TYPES[1])
    run = F.concat(F.lit("run-"), F.col("line").cast("string"))
    endpoint = F.when(F.col("line") % 3 == 0, RIVER_STATIONS).otherwise(RIVER)
    at = F.date_trunc("hour", "occurred_at")
    results = done.select(
        run.alias("run_id"), "line", endpoint.alias("endpoint"), F.when(bad["provider"], "other").otherwise("gauges").alias("provider"), at.alias("captured_at"), F.col("occurred_at").alias("completed_at"), F.concat(F.lit("manifests/"), run).alias("manifest_path"),
    )
    place = lambda kind: receipts.run_folder(kind, F.col("endpoint"), "captured_at", F.col("run_id"))
    results = results.withColumns({
        "quality_report_path": F.concat(place("quality"), F.lit("/report.json")), "observation_output_path": F.when(~bad["observation_output_path"], place("processed/dataset=observations")),
        "station_output_path": F.when((F.col("endpoint") == RIVER_STATIONS) & ~bad["station_output_path"], place("processed/dataset=stations")),
    })
    request = F.when(~bad["request_event_id"], F.element_at("data", "request_event_id")).otherwise("nobody")
    found = receipts.processing_receipts(done.select("event_id", "correlation_id", run.alias("run_id"), request.alias("request_event_id")), results)
    line = F.regexp_extract("run_id", r"(\d+)$", 1).cast("bigint").alias("line")
    moved = F.when(F.regexp_extract("run_id", r"(\d+)$", 1).cast("bigint") % 7 == 0, F.regexp_replace("path", "run-", "ran-")).otherwise(F.col("path")).alias("path")
    texts = found.select(moved, line, E.encode_events(found).alias("value"))
    faults = receipts.receipt_faults(E.decode_events(texts), ("gauges",))
    return faults.select(F.regexp_extract("path", r"-(\d+)/[^/]*$", 1).cast("bigint").alias("line"), F.array_join("faults", ",").alias("faults"))


# Streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = D.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("select cast(event_id as varchar) as event_id, event_type from events")
def dedupe_events_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("timestamp").alias("occurred_at"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.run_to_table(S.dedupe_stream(twice), D.shared_path(spark, "stream"), D.shared_path(spark, "stream-state")).select("event_id", "event_type")


@query(f"""select r.event_id as request_event_id, i.event_id as ingestion_event_id, i.ts as ingested_at from events r join events i on {D.event_uuid_sql('i.event_id - i.event_id % 5')} = {D.event_uuid_sql('r.event_id')}
    where r.event_type = 'click' and i.event_type = 'signup' and i.ts between r.ts - interval 7 days and r.ts + interval 7 days""")
def trace_stream(spark, sf_dir):
    """Requests and their completions while both streams run; requests without one wait for it."""
    of = lambda kind: event_stream(spark, sf_dir).where(F.col("event_type") == kind)
    asked = of("click").select(D.event_uuid(F.col("event_id")).alias("request_event_id"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("requested_at"))
    done = of("signup").select(D.event_uuid(F.col("event_id") - F.col("event_id") % 5).alias("for_request"), F.col("event_id").alias("ingestion_event_id"), F.col("ts").cast("timestamp").alias("ingested_at"))
    traced = S.run_to_table(S.trace_stream(asked, done), D.shared_path(spark, "stream"), D.shared_path(spark, "stream-state"))
    return traced.where("ingestion_event_id is not null").select(F.col("request").alias("request_event_id"), "ingestion_event_id", "ingested_at")


@query(f"select request_id, attempts, last_failed_at from ({_RETRY})")
def retry_state_stream(spark, sf_dir):
    rows = event_stream(spark, sf_dir).selectExpr("cast(user_id as string) as request_id", "cast(ts as timestamp) as at", "event_type not in ('error', 'view') as ok", "event_type as error_type", "props as error_message")
    table = S.run_to_table(S.retry_state_stream(rows), D.shared_path(spark, "stream"), D.shared_path(spark, "stream-state"), "update")
    last = table.groupBy("request_id").agg(F.max_by(F.struct("attempts", "last_failed_at"), "_batch").alias("s"))
    return last.select("request_id", "s.attempts", "s.last_failed_at").where("attempts > 0")


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three streams of a trace: clicks ask, signups and purchases complete."""
    of = lambda kind, *columns: event_stream(spark, sf_dir).where(F.col("event_type") == kind).select(*columns)
    at, number = F.col("ts").cast("timestamp"), F.col("event_id")
    return (
        of("click", number.alias("request_event_id"), at.alias("requested_at")),
        of("signup", number.alias("ingestion_event_id"), (number - number % 5).alias("for_request"), at.alias("ingested_at")),
        of("purchase", number.alias("processing_event_id"), (number - number % 3).alias("for_ingestion"), at.alias("processed_at")),
    )


@query("""with r as (select * from events where event_type = 'click'), i as (select * from events where event_type = 'signup'), p as (select * from events where event_type = 'purchase'),
    w as (select least((select max(ts) from r), (select max(ts) from i), (select max(ts) from p)) - interval 1 hour as watermark)
    select r.event_id as request_event_id, i.event_id as ingestion_event_id, p.event_id as processing_event_id, p.event_id is null as overdue from r cross join w
    left join i on i.event_id - i.event_id % 5 = r.event_id and i.ts between r.ts - interval 2 days and r.ts + interval 2 days
    left join p on p.event_id - p.event_id % 3 = i.event_id and p.ts between i.ts - interval 2 days and i.ts + interval 2 days where p.event_id is not null or r.ts < watermark - interval 6 days""")
def pipeline_trace_stream(spark, sf_dir):
    """Requests with both completions while three streams run, and those whose time is over without."""
    traced = S.pipeline_trace_stream(*_legs(spark, sf_dir), within="2 days", late="1 hour")
    table = S.run_to_table(traced, D.shared_path(spark, "stream"), D.shared_path(spark, "stream-state"))
    return table.select("request_event_id", "ingestion_event_id", "processing_event_id", F.col("processing_event_id").isNull().alias("overdue"))


def _shuffled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each request from outcomes that come in three batches, each with rows of all times."""
    path = D.shared_path(spark, "outcomes")
    rows = D.outcomes(spark, sf_dir)
    rows.repartition(3, F.xxhash64("request_id", "at")).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    states = S.retry_states(stream, late="400 days", max_attempts=2)
    table = S.run_to_table(states, D.shared_path(spark, "stream"), D.shared_path(spark, "stream-state"), "update", rocksdb=True)
    last = F.struct("attempts", "first_failed_at", "last_failed_at", "last_error_type", "last_error_message", "route")
    return table.groupBy("request_id").agg(F.max_by(last, "_batch").alias("s")).select("request_id", "s.*")


@query(_RETRY)
def retry_states(spark, sf_dir):
    """The states of requests whose outcomes come in no order."""
    return _shuffled_states(spark, sf_dir).where("attempts > 0").drop("route")


@query(f"select request_id, attempts, last_failed_at from ({_RETRY}) where attempts >= 2")
def dead_letters(spark, sf_dir):
    """The requests that such a stream gives up."""
    return _shuffled_states(spark, sf_dir).where("route = 'dead-letter'").select("request_id", "attempts", "last_failed_at")


@query(_DONE)
def process_stream(spark, sf_dir):
    """The runs' manifests as a stream into a lake of its own, in two batches: each run is processed once."""
    history = F.col("endpoint") == RIVER
    lake, state = D.new_lake(spark, sf_dir, history), D.shared_path(spark, "stream-state")
    for batch in range(2):
        if batch:
            D.add_manifests(spark, sf_dir, lake, ~history)
        S.finished(S.process_stream(spark, lake, state))
    return runs.commit_log(spark, lake).select("run_id", "endpoint", "dataset", "row_count")
