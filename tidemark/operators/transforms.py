"""Typed station and observation rows from the raw records of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clean_text, normalize_trend, point_lat, point_lon, safe_timestamp
from tidemark.schemas import OBSERVATIONS, RIVER, RIVER_STATIONS, STATIONS, fields


def guard_endpoint(endpoint: str, wanted: str) -> None:
    if endpoint != wanted:
        raise ValueError(f"this transform takes records of {wanted!r}, not of {endpoint!r}")


def typed(df: DataFrame, columns: dict[str, Column], schema: str) -> DataFrame:
    """The schema's columns, in its order and types, and whatever columns are more."""
    kinds = fields(schema)
    return df.select(*(columns[n].cast(t).alias(n) for n, t in kinds.items()), *(c.alias(n) for n, c in columns.items() if n not in kinds))


def _common(text: bool) -> dict[str, Column]:
    """Columns that all rows have; text: clean texts, as the domain rows have them."""
    r = lambda name: F.col(f"record.{name}")
    say = (lambda name: clean_text(r(name))) if text else r
    return {
        "station_name": say("title"), "basin_name": say("basin"), "latitude": point_lat(r("point")), "longitude": point_lon(r("point")), "provider": F.col("provider"),
        "original_source": say("dataSource"), "source_created_at": safe_timestamp(r("createdOn")), "source_modified_at": safe_timestamp(r("modifiedOn")),
        "ingested_at": F.col("ingested_at"), "run_id": F.col("run_id"), "source_page_index": F.col("source_page_index"),
    }


def _levels(text: bool) -> dict[str, Column]:
    r = lambda name: F.col(f"record.{name}")
    return {
        "source_station_series_id": r("stationSeriesId").cast("string"), "river_name": F.lit(None).cast("string"), "observed_at": safe_timestamp(r("waterLevelOn")),
        "water_level_m": r("waterLevel"), "warning_level_m": r("warningLevel"), "danger_level_m": r("dangerLevel"), "trend": normalize_trend(r("steady")),
        "official_status": clean_text(r("status")) if text else r("status"),
    }


def transform_historical_observations(records: DataFrame, endpoint: str = RIVER, clean: bool = False) -> DataFrame:
    """History records as observations; a time that can't be read stays as null."""
    guard_endpoint(endpoint, RIVER)
    own = {"source_record_id": F.col("record.id").cast("string"), "station_id": F.col("record.station").cast("string")}
    return typed(records, own | _common(clean) | _levels(clean), OBSERVATIONS)


def transform_stations(records: DataFrame, endpoint: str = RIVER_STATIONS, clean: bool = False) -> DataFrame:
    """Snapshot records as stations, with the population counts that a record may have.

    Areas are read by either spelling of their fields.
    """
    guard_endpoint(endpoint, RIVER_STATIONS)
    r = lambda name: F.col(f"record.{name}")
    own = {
        "station_id": r("id").cast("string"), "station_series_id": r("stationSeriesId").cast("string"), "elevation_m": r("elevation"),
        **{f"{a}_id": F.coalesce(r(f"{a}Id"), r(a)) for a in ("province", "district", "municipality", "ward")},
        "description": clean_text(r("description")) if clean else r("description"),
        **{f"affected_{a}_count": F.col(f"record.affectedDemography.{a}Count") for a in ("male", "female", "household")},
    }
    return typed(records, own | _common(clean), STATIONS)


def transform_station_observations(records: DataFrame, endpoint: str = RIVER_STATIONS, clean: bool = False) -> DataFrame:
    """Snapshot records as observations with made ids; those without a readable time are dropped."""
    guard_endpoint(endpoint, RIVER_STATIONS)
    made = F.concat(F.lit("station-snapshot:"), F.col("record.id").cast("string"), F.lit(":"), F.col("record.waterLevelOn"))
    own = {"source_record_id": made, "station_id": F.col("record.id").cast("string")}
    return typed(records, own | _common(clean) | _levels(clean), OBSERVATIONS).where("observed_at is not null")


def map_domain(records: DataFrame, endpoint: str) -> dict[str, DataFrame]:
    """Validated records as domain rows: texts clean, ids texts."""
    if endpoint == RIVER:
        return {"observations": transform_historical_observations(records, endpoint, clean=True)}
    return {"stations": transform_stations(records, endpoint, clean=True), "observations": transform_station_observations(records, endpoint, clean=True)}
