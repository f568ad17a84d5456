"""Row rules, summaries and health."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import quality as Q
from tidemark.schemas import RIVER, RIVER_STATIONS

OBS = "source_record_id string, station_id string, observed_at timestamp, run_id string, latitude double, longitude double, water_level_m double, warning_level_m double, danger_level_m double, ingested_at timestamp, endpoint string"
NOW = datetime(2026, 9, 30, 10)


def row(**k):
    base = {"source_record_id": "a", "station_id": "s", "observed_at": NOW, "run_id": "r", "latitude": 1.0, "longitude": 2.0, "water_level_m": 3.0, "warning_level_m": 4.0, "danger_level_m": 5.0, "ingested_at": NOW, "endpoint": RIVER_STATIONS}
    return tuple((base | k).values())


def graded(spark, *rows):
    return [(r.quality_errors, r.quality_warnings, r.quality_status) for r in Q.observation_quality(spark.createDataFrame(list(rows), OBS)).collect()]


@pytest.mark.parametrize(
    ("change", "errors", "warnings"),
    [
        ({}, [], []),
        ({"source_record_id": " "}, ["missing_source_record_id"], []),
        ({"source_record_id": "\t"}, [], []),
        ({"station_id": None, "run_id": "", "observed_at": None}, ["missing_station_id", "missing_observed_at", "missing_run_id"], []),
        ({"latitude": 90.1, "longitude": -181.0}, ["invalid_latitude", "invalid_longitude"], []),
        ({"latitude": None}, [], ["missing_coordinates"]),
        ({"water_level_m": None}, [], ["missing_water_level"]),
        ({"water_level_m": -99991.53125}, [], ["suspicious_water_level"]),
        ({"warning_level_m": 6.0}, [], ["warning_above_danger"]),
        ({"observed_at": NOW - timedelta(hours=24)}, [], []),
        ({"observed_at": NOW - timedelta(hours=24, seconds=1)}, [], ["stale_current_observation"]),
        ({"observed_at": NOW - timedelta(days=9), "endpoint": RIVER}, [], []),
        ({"observed_at": NOW + timedelta(days=9)}, [], []),
    ],
)
def test_rules(spark, change, errors, warnings):
    assert graded(spark, row(**change)) == [(errors, warnings, "fail" if errors else "warn" if warnings else "pass")]


def test_duplicates_are_within_runs(spark):
    got = graded(spark, row(), row(), row(run_id="q"), row(source_record_id="", station_id="t"), row(source_record_id="", station_id="u"), row(source_record_id="z"))
    flags = sorted((("duplicate_source_record_id" in e), ("duplicate_station_observed_at" in w)) for e, w, _ in got)
    assert flags == [(False, False)] * 3 + [(False, True), (True, True), (True, True)]


def test_policy_limits():
    with pytest.raises(ValueError):
        Q.Policy(max_age_hours=0)


def test_stations(spark):
    kind = "station_id string, station_series_id string, station_name string, basin_name string, latitude double, longitude double, run_id string"
    rows = [("1", "x", "n", "b", 1.0, 1.0, "r"), ("1", "x", "n", "", 1.0, None, "r"), (None, None, " ", None, 99.0, 1.0, "r")]
    got = sorted((r.quality_errors, r.quality_warnings) for r in Q.station_quality(spark.createDataFrame(rows, kind)).collect())
    assert got == [
        (["duplicate_station_id"], ["duplicate_station_series_id"]), (["duplicate_station_id"], ["missing_basin_name", "missing_coordinates", "duplicate_station_series_id"]),
        (["missing_station_id", "missing_station_name", "invalid_latitude"], ["missing_station_series_id", "missing_basin_name"]),
    ]


def test_summaries(spark):
    flagged = Q.observation_quality(spark.createDataFrame([row(), row(source_record_id="b", water_level_m=None, station_id="t"), row(source_record_id=None, latitude=None, station_id="u")], OBS))
    r = Q.dataset_quality_summary(flagged, ["run_id"]).first()
    assert (r.total_rows, r.pass_rows, r.warn_rows, r.fail_rows, r.affected_rows, r.status) == (3, 1, 1, 1, 2, "fail") and r.pass_ratio == pytest.approx(1 / 3)
    assert [tuple(x) for x in r.warning_counts] == [("missing_coordinates", 1), ("missing_water_level", 1)]
    none = Q.dataset_quality_summary(flagged.limit(0)).first()
    assert (none.total_rows, none.pass_ratio, none.status) == (0, 0.0, "fail")
    assert Q.rows_by_rule(flagged, "missing_water_level").count() == 1 and Q.rows_not_passing(flagged).count() == 2


def test_health(spark):
    stations = spark.createDataFrame([("r", "1"), ("r", "1"), ("r", "2"), ("r", " "), ("q", "1")], "run_id string, station_id string")
    times = [("r", "1", NOW, NOW), ("r", "1", NOW - timedelta(days=2), NOW), ("r", "9", NOW + timedelta(hours=1), NOW), ("r", "1", NOW, None)]
    got = {r.run_id: r for r in Q.current_data_health(stations, spark.createDataFrame(times, "run_id string, station_id string, observed_at timestamp, ingested_at timestamp")).collect()}
    r = got["r"]
    assert (r.total_stations, r.stations_with_observation, r.fresh_observations, r.stale_observations, r.future_observations, r.unassessable_observations, r.status) == (2, 1, 1, 1, 1, 1, "warn")
    assert (r.coverage_ratio, r.freshness_ratio) == (0.5, 0.25) and got["q"].status == "fail" and got["q"].total_observations == 0
