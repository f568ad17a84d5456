"""Views and reads on a basin fixture whose numbers are known."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import reads, views
from tidemark.schemas import RIVER, RIVER_STATIONS

STA = "station_id string, station_name string, basin_name string, latitude double, longitude double, run_id string, ingested_at timestamp, endpoint string"
OBS = "source_record_id string, station_id string, observed_at timestamp, water_level_m double, run_id string, ingested_at timestamp, endpoint string"
NOW = datetime(2026, 9, 30, 10)


@pytest.fixture(scope="module")
def lake(spark):
    stations = [(s, n, b, 27.0, 85.0, "r2", NOW, RIVER_STATIONS) for s, n, b in (("44", "A", "Koshi"), ("45", "B", "Koshi"), ("46", None, "Karnali"), ("47", "D", " "))]
    stations += [("99", "Old", "Old", 0.0, 0.0, "r1", datetime(2026, 9, 29), RIVER_STATIONS), ("98", "River", "X", 0.0, 0.0, "r9", datetime(2026, 10, 9), RIVER)]
    seen = [("o1", "44", datetime(2026, 9, 30, 9), 1.0), ("o2", "45", datetime(2026, 9, 28, 10), None), ("o3", "46", datetime(2026, 9, 30, 11), 2.0), ("o0", "44", datetime(2026, 9, 30, 8), 0.5)]
    observations = [(*o, "r2", NOW, RIVER_STATIONS) for o in seen] + [("o9", "44", datetime(2026, 9, 29), 9.0, "r1", datetime(2026, 9, 29), RIVER_STATIONS)]
    history = [("h1", "44", datetime(2026, 9, 1), 1.0, "a", datetime(2026, 9, 2), RIVER), ("h1", "44", datetime(2026, 9, 1), 1.05, "b", datetime(2026, 9, 3), RIVER)]
    history += [(" ", "45", datetime(2026, 9, 1), 3.0, "a", datetime(2026, 9, 2), RIVER), (None, "45", datetime(2026, 9, 1), 4.0, "a", datetime(2026, 9, 2), RIVER), ("h5", "44", datetime(2026, 9, 30, 9), 7.0, "a", NOW, RIVER), ("h6", None, datetime(2026, 9, 1), 1.0, "a", NOW, RIVER), ("h7", "44", None, 1.0, "a", NOW, RIVER)]
    return spark.createDataFrame(stations, STA), spark.createDataFrame(observations + history, OBS)


def test_basins_and_network(lake):
    basins = views.basin_current_summary(views.current_river_snapshot(*lake))
    got = {r.basin_name: r for r in basins.collect()}
    assert set(got) == {"Koshi", "Karnali", "Unknown"}
    k = got["Koshi"]
    assert (k.total_stations, k.fresh_observations, k.stale_observations, k.coverage_ratio, k.freshness_ratio) == (2, 1, 1, 1.0, 0.5)
    assert (k.observations_with_water_level, k.observations_without_water_level) == (1, 1)
    assert got["Karnali"].future_observations == 1
    u = got["Unknown"]
    assert (u.total_stations, u.stations_with_observation, u.coverage_ratio, u.freshness_ratio) == (1, 0, 0.0, 0.0)
    n = views.current_network_summary(basins).collect()
    assert len(n) == 1 and (n[0].basins_represented, n[0].total_stations, n[0].coverage_ratio) == (3, 4, 0.75) and n[0].freshness_ratio == pytest.approx(1 / 3)
    assert reads.reconcile_totals(basins, views.current_river_snapshot(*lake)).first().matches
    assert [r.basin_name for r in reads.top_basins(basins).collect()] == ["Koshi", "Karnali", "Unknown"]
    assert reads.network_overview_kpis(basins).first()[:] == (4, 2, 1)


def test_empty_network_is_one_row_of_zeros(lake):
    none = [df.limit(0) for df in lake]
    row = views.current_network_summary(views.basin_current_summary(views.current_river_snapshot(*none))).collect()
    assert len(row) == 1 and row[0].total_stations == 0 and row[0].latest_observed_at is None and row[0].coverage_ratio == 0.0


def test_history_keeps_the_newest_of_a_record_and_all_blank_ones(lake):
    rows = views.historical_observations(lake[1]).collect()
    assert [r.water_level_m for r in rows if r.source_record_id == "h1"] == [1.05]
    assert sorted(r.water_level_m for r in rows if not (r.source_record_id or "").strip()) == [3.0, 4.0]
    merged = views.station_observation_history(*lake)
    assert reads.duplicate_key_check(merged).first()[0] == 0
    at = merged.where("station_id = '44' and observed_at = timestamp'2026-09-30 09:00:00'").collect()
    assert [r.source_record_id for r in at] == ["o1"]  # as new as h5, but current
    assert merged.where("station_id is null or observed_at is null").count() == 0
    latest = {r.station_id: r.source_record_id for r in views.latest_observation_per_station(merged).collect()}
    assert latest == {"44": "o1", "45": "o2", "46": "o3"}


def test_reads(lake):
    snapshot = views.current_river_snapshot(*lake)
    assert [r.station_id for r in reads.get_current_snapshot(snapshot).collect()] == ["44", "45", "47", "46"]
    assert reads.get_station(snapshot, " 45 ").first().source_record_id == "o2" and reads.get_station(snapshot, "1").count() == 0
    with pytest.raises(ValueError):
        reads.get_station(snapshot, "  ")
    history = views.station_observation_history(*lake)
    times = [r.observed_at for r in reads.get_station_history(history, "44", datetime(2026, 9, 1), datetime(2026, 9, 30, 9)).collect()]
    assert times == [datetime(2026, 9, 1), datetime(2026, 9, 30, 8)]
    with pytest.raises(ValueError):
        reads.time_range_filter(history, NOW, NOW)
    ids = lambda **k: {r.station_id for r in reads.station_filter(snapshot, **k).collect()}
    assert ids(query=" UNKNOWN") == {"47"} and ids(query="unnamed") == {"46"} and ids(basin="Koshi") == {"44", "45"}
    assert ids(observation="without") == {"47"} and ids(level="missing") == {"45"} and ids(level="available", query="4") == {"44", "46"}
    assert [r.basin_name for r in reads.basin_options(snapshot).collect()] == ["Karnali", "Koshi", "Unknown"]
    page = reads.station_page(snapshot, 9, size=3).collect()
    assert [(r.station_id, r.page, r.total_pages) for r in page] == [("46", 2, 2)]
    s = {r.station_id: r for r in reads.station_history_summary(history).collect()}["45"]
    assert (s.points, s.points_with_level) == (2, 1)


def test_register(spark, lake):
    views.register(spark, *lake)
    assert spark.sql("select sum(total_stations) from basin_current_summary").first()[0] == 4


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=12))
def test_latest_per_key_is_the_first_of_the_order(spark, rows):
    df = spark.createDataFrame([(k, a, b, i) for i, (k, a, b) in enumerate(rows)], "k string, a int, b int, i int")
    order = [F.desc_nulls_last("a"), F.asc_nulls_last("b"), F.asc("i")]
    want = {}
    for i, (k, a, b) in enumerate(rows):
        rank = (a is None, -(a or 0), b is None, b or 0, i)
        want[k] = min(want.get(k, rank), rank)
    assert {r.k: r.i for r in views.latest_per_key(df, ["k"], order).collect()} == {k: v[-1] for k, v in want.items()}


def test_the_network_has_one_summary(spark):
    from tidemark.operators.reads import get_network_summary

    one = spark.createDataFrame([(3, None)], "total_stations int, latest_observed_at timestamp")
    assert get_network_summary(one).collect() == one.collect()
    for odd in (one.limit(0), one.union(one)):
        with pytest.raises(Exception, match="one summary"):
            get_network_summary(odd).collect()


def test_stored_history_is_not_shuffled(spark, tmp_path):
    rows = [(str(i % 7), datetime(2026, 9, 1 + i // 10), datetime(2026, 9, 20), f"r{i}") for i in range(60)] + [("hot", datetime(2026, 9, 1), datetime(2026, 9, 20), f"h{i}") for i in range(50)]
    history = spark.createDataFrame(rows, "station_id string, observed_at timestamp, ingested_at timestamp, source_record_id string")
    views.store_history(history, "history_of_test", f"{tmp_path}/history", 4)
    stored = spark.table("history_of_test")
    latest = views.latest_observation_per_station(stored)
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, views.latest_observation_per_station(history).collect()))
    assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, stored.collect())) == sorted(rows)
    spark.sql("drop table history_of_test")


def test_stored_pages_are_those_of_the_sort(spark, tmp_path):
    rows = [(f"s{i}", None if i % 9 == 0 else f"name {i * 7 % 50}") for i in range(205)] + [(None, "name 3"), (None, None)]
    stations = spark.createDataFrame(rows, "station_id string, station_name string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    reads.write_station_pages(stations, f"{tmp_path}/pages")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for page in (-1, 1, 2, 7, 11, 99):
        stored = reads.read_station_page(spark, f"{tmp_path}/pages", page)
        assert list(map(tuple, stored.collect())) == list(map(tuple, reads.station_page(stations, page).collect()))
    everything = spark.read.parquet(f"{tmp_path}/pages/rows").inputFiles()
    assert len(stored.inputFiles()) == 1 < len(everything)
    reads.write_station_pages(stations.limit(0), f"{tmp_path}/none")
    assert reads.read_station_page(spark, f"{tmp_path}/none", 4).count() == 0
