"""Derived tables: deduplicated histories, the current snapshot, and its summaries.

Each is a function of DataFrames; `register` also makes them views.  Orders that
decide which row stays end in `tie`, a column that makes them total, if the input has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import FRESH_HOURS, basin_label, freshness_status, is_blank, observation_age_hours, ratio
from tidemark.schemas import RIVER, RIVER_STATIONS


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order.  Spark keeps the first rows of each task's groups before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def newest(df: DataFrame, *columns: str) -> list[Column]:
    """Descending, nulls last, with df's tie-breaker at the end."""
    return [F.desc_nulls_last(c) for c in (*columns, *(["tie"] if "tie" in df.columns else []))]


def latest_current_run(stations: DataFrame) -> DataFrame:
    """The run of the newest snapshot of stations: run_id and latest_ingested_at, at most one row."""
    runs = stations.where(F.col("endpoint") == RIVER_STATIONS).groupBy("run_id").agg(F.max("ingested_at").alias("latest_ingested_at"))
    return runs.orderBy(F.desc_nulls_last("latest_ingested_at"), F.desc_nulls_last("run_id")).limit(1)


def of_latest_run(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """The snapshot rows of the latest run, which is one row at most."""
    return rows.where(F.col("endpoint") == RIVER_STATIONS).join(F.broadcast(latest.select("run_id")), "run_id", "left_semi")


def current_stations(stations: DataFrame) -> DataFrame:
    return of_latest_run(stations, latest_current_run(stations))


def current_observations(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """The latest run is the stations' one."""
    return of_latest_run(observations, latest_current_run(stations))


def historical_observations(observations: DataFrame) -> DataFrame:
    """History rows, one for each source record over all runs; rows without a record id all stay."""
    rows = observations.where(F.col("endpoint") == RIVER)
    blank = is_blank(F.col("source_record_id"))
    # Apart, so that blank ids don't meet in one task and the rank is a plain first row.
    return latest_per_key(rows.where(~blank), ["source_record_id"], newest(rows, "ingested_at", "run_id")).unionByName(rows.where(blank))


def station_observation_history(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Current and historical rows with a station and a time, one for each of both; current ones go first."""
    both = current_observations(stations, observations).withColumn("_priority", F.lit(1)).unionByName(historical_observations(observations).withColumn("_priority", F.lit(0)))
    rows = both.where(~is_blank(F.col("station_id")) & F.col("observed_at").isNotNull())
    return latest_per_key(rows, ["station_id", "observed_at"], newest(rows, "ingested_at", "_priority", "source_record_id")).drop("_priority")


def latest_observation_per_station(history: DataFrame) -> DataFrame:
    return latest_per_key(history, ["station_id"], newest(history, "observed_at", "ingested_at", "source_record_id"))


def current_observation_per_station(current: DataFrame) -> DataFrame:
    return latest_observation_per_station(current.where(~is_blank(F.col("station_id"))))


def current_river_snapshot(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Every station row of the latest run with its newest current observation, if any."""
    picked = current_observation_per_station(current_observations(stations, observations)).select(
        "station_id", "source_record_id", "observed_at", "water_level_m", F.col("ingested_at").alias("observation_ingested_at")
    )
    return (
        current_stations(stations).join(picked, "station_id", "left")
        .withColumn("has_observation", F.col("observed_at").isNotNull())
        .withColumn("observation_age_hours", observation_age_hours(F.col("observed_at"), F.col("observation_ingested_at")))
    )


COUNTS = (
    "total_stations", "stations_with_observation", "stations_without_observation", "fresh_observations", "stale_observations", "future_observations",
    "unassessable_observations", "observations_with_water_level", "observations_without_water_level",
)


def basin_current_summary(snapshot: DataFrame, limit: float = FRESH_HOURS) -> DataFrame:
    """For each basin, how many stations report and how fresh they are."""
    has = F.col("has_observation")
    rows = snapshot.select(
        basin_label(F.col("basin_name")).alias("basin_name"), "has_observation", "observed_at", F.col("water_level_m").isNotNull().alias("level"),
        freshness_status(has, F.col("observation_age_hours"), limit).alias("freshness"),
    )
    of = lambda status: F.count_if(F.col("freshness") == status)
    measures = (
        F.count(F.lit(1)), F.count_if(has), F.count_if(~has), of("fresh"), of("stale"), of("future"), of("unassessable"), F.count_if(has & F.col("level")), F.count_if(has & ~F.col("level")),
    )
    summed = rows.groupBy("basin_name").agg(*(m.alias(n) for m, n in zip(measures, COUNTS, strict=True)), F.min("observed_at").alias("oldest_observed_at"), F.max("observed_at").alias("latest_observed_at"))
    return with_ratios(summed)


def with_ratios(summary: DataFrame) -> DataFrame:
    return summary.withColumn("coverage_ratio", ratio(F.col("stations_with_observation"), F.col("total_stations"))).withColumn(
        "freshness_ratio", ratio(F.col("fresh_observations"), F.col("stations_with_observation"))
    )


def current_network_summary(basins: DataFrame) -> DataFrame:
    """All basins as one row; of none, zeros and null times."""
    summed = basins.agg(
        F.count(F.lit(1)).alias("basins_represented"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS),
        F.min("oldest_observed_at").alias("oldest_observed_at"), F.max("latest_observed_at").alias("latest_observed_at"),
    )
    return with_ratios(summed)


def register(spark: SparkSession, stations: DataFrame, observations: DataFrame) -> None:
    """All derived tables as temporary views."""
    snapshot = current_river_snapshot(stations, observations)
    history = station_observation_history(stations, observations)
    basins = basin_current_summary(snapshot)
    for name, df in {
        "stations": stations, "observations": observations, "latest_current_run": latest_current_run(stations), "current_stations": current_stations(stations),
        "current_observations": current_observations(stations, observations), "historical_observations": historical_observations(observations),
        "station_observation_history": history, "latest_observation_per_station": latest_observation_per_station(history),
        "current_observation_per_station": current_observation_per_station(current_observations(stations, observations)), "current_river_snapshot": snapshot,
        "basin_current_summary": basins, "current_network_summary": current_network_summary(basins),
    }.items():
        df.createOrReplaceTempView(name)


def store_history(history: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Keeps a history as a table in buckets by station, each in order of station and time.

    One shuffle here, and none for whatever goes by station later (`latest_observation_per_station` and
    every window by station).  The table's name and path must be free.
    """
    history.repartition(buckets, "station_id").write.mode("errorifexists").format("parquet").bucketBy(buckets, "station_id").sortBy("station_id", "observed_at").option("path", path).saveAsTable(table)
