"""The reads built on the views: ordered snapshots, histories, rankings, filters and pages."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import all_of, basin_label, clean_text, is_blank, valid_coordinates

PAGE_SIZE = 20


def get_current_snapshot(snapshot: DataFrame) -> DataFrame:
    return snapshot.orderBy(F.asc_nulls_last("station_name"), F.asc_nulls_last("station_id"))


def wanted_station(station_id: str) -> str:
    wanted = (station_id or "").strip()
    if not wanted:
        raise ValueError("the station id is blank")
    return wanted


def get_station(snapshot: DataFrame, station_id: str) -> DataFrame:
    """The snapshot row of a station, none if it isn't known; of several the newest by ingestion and record."""
    return snapshot.where(F.col("station_id") == wanted_station(station_id)).orderBy(F.desc_nulls_last("ingested_at"), F.desc_nulls_last("source_record_id")).limit(1)


def time_range(start: datetime | None, end: datetime | None) -> tuple[datetime | None, datetime | None]:
    """Both bounds in UTC; a bound without a zone is UTC already."""
    zoned = lambda t: t if t is None else t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    start, end = zoned(start), zoned(end)
    if start is not None and end is not None and start >= end:
        raise ValueError("the start must be before the end")
    return start, end


def time_range_filter(rows: DataFrame, start: datetime | None = None, end: datetime | None = None, column: str = "observed_at") -> DataFrame:
    """start <= column < end; either bound may be missing."""
    start, end = time_range(start, end)
    bounds = [F.col(column) >= F.lit(start)] if start is not None else []
    return rows.where(all_of(bounds + ([F.col(column) < F.lit(end)] if end is not None else [])))


def get_station_history(history: DataFrame, station_id: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    rows = time_range_filter(history.where(F.col("station_id") == wanted_station(station_id)), start, end)
    return rows.orderBy("observed_at", F.asc_nulls_last("source_record_id"))


def get_basin_summaries(basins: DataFrame) -> DataFrame:
    return basins.orderBy(F.desc("total_stations"), "basin_name")


def get_network_summary(network: DataFrame) -> DataFrame:
    """The one row of the network; a table that has none or several is an error."""
    whole = network.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("row"))
    said = F.concat(F.lit("the network has one summary, not "), F.col("n").cast("string"))
    return whole.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(said)).alias("row")).select("row.*")


def recent_observations(history: DataFrame, station_id: str, n: int = 20) -> DataFrame:
    return history.where(F.col("station_id") == wanted_station(station_id)).orderBy(F.desc_nulls_last("observed_at"), F.desc_nulls_last("source_record_id")).limit(n)


def newest_of_snapshot(snapshot: DataFrame, n: int = 10) -> DataFrame:
    return snapshot.where("has_observation").orderBy(F.desc_nulls_last("observed_at"), "station_id").limit(n)


def stations_without_observation(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("not has_observation").orderBy("station_id")


def station_filter(snapshot: DataFrame, query: str = "", basin: str | None = None, observation: str | None = None, level: str | None = None) -> DataFrame:
    """Stations whose id, name or basin contain query, of one basin, with or without observation, with a level or one missing."""
    name = F.coalesce(clean_text(F.col("station_name")), F.lit("Unnamed station"))
    text = F.lower(F.concat_ws(" ", "station_id", name, basin_label(F.col("basin_name"))))
    has, known = F.col("has_observation"), F.col("water_level_m").isNotNull()
    conditions: list[Column] = [text.contains(query.strip().lower())] if query.strip() else []
    conditions += [basin_label(F.col("basin_name")) == basin] if basin is not None else []
    conditions += [{"with": has, "without": ~has}[observation]] if observation is not None else []
    conditions += [{"available": known, "missing": has & ~known}[level]] if level is not None else []
    return snapshot.where(all_of(conditions))


def basin_search(basins: DataFrame, query: str) -> DataFrame:
    return basins.where(F.lower("basin_name").contains(query.strip().lower()))


def mapped_stations(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(valid_coordinates(F.col("latitude"), F.col("longitude")))


def station_page(snapshot: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """A page of the stations by name and id, with its number and how many there are; numbers beyond the ends give the first or last."""
    total = max(1, -(-snapshot.count() // size))
    page = min(max(1, page), total)
    rows = snapshot.orderBy(F.asc_nulls_last("station_name"), F.asc_nulls_last("station_id")).offset((page - 1) * size).limit(size)
    return rows.withColumn("page", F.lit(page)).withColumn("total_pages", F.lit(total))


_PLACES = "file string, first_id bigint, first_place bigint, n bigint"


def write_station_pages(snapshot: DataFrame, path: str) -> None:
    """Keeps the stations in the order of their pages, so that `read_station_page` finds one without counting or sorting.

    rows: the stations in files of neighbours; places: for each file its rows and the place of the first.
    """
    order = [F.asc_nulls_last("station_name"), F.asc_nulls_last("station_id")]
    # Rows of a task are neighbours, tasks are in order, and the id counts a task's rows.
    ordered = snapshot.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered.write.parquet(f"{path}/rows")
    kept = snapshot.sparkSession.read.schema(ordered.schema).parquet(f"{path}/rows")
    files = kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files.select("file", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_place"), "n").coalesce(1).write.parquet(f"{path}/places")


def read_station_page(spark: SparkSession, path: str, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """The page that `station_page` gives, in its order, from what `write_station_pages` has kept: only files with rows of the page are opened."""
    places = spark.read.schema(_PLACES).parquet(f"{path}/places")
    total = max(1, -(-(places.agg(F.sum("n")).first()[0] or 0) // size))
    page = min(max(1, page), total)
    first, end = (page - 1) * size, page * size
    held = places.where((F.col("first_place") < end) & (F.col("first_place") + F.col("n") > first)).collect()
    stored = spark.read.parquet(*([f"{path}/rows/{r.file}" for r in held] or [f"{path}/rows"]))
    wanted = F.lit(False)
    for r in held:
        wanted |= (F.col("_id") >= r.first_id + max(0, first - r.first_place)) & (F.col("_id") < r.first_id + min(r.n, end - r.first_place))
    return stored.where(wanted).orderBy("_id").drop("_id").withColumn("page", F.lit(page)).withColumn("total_pages", F.lit(total))


def endpoint_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n_rows"))


def observed_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))


def view_counts(views: dict[str, DataFrame]) -> DataFrame:
    """How many rows each has."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view"), "n_rows") for name, df in views.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.union(df)
    return out


def snapshot_profile(snapshot: DataFrame) -> DataFrame:
    has, age = F.col("has_observation"), F.col("observation_age_hours")
    return snapshot.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), F.count_if(has).alias("with_observation"), F.count_if(~has).alias("without_observation"),
        F.min(age).alias("min_age_hours"), F.avg(age).alias("avg_age_hours"), F.max(age).alias("max_age_hours"),
    )


def station_activity(history: DataFrame) -> DataFrame:
    return history.groupBy("station_id").agg(F.count(F.lit(1)).alias("observations"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))


def busiest_station(history: DataFrame) -> DataFrame:
    return station_activity(history).orderBy(F.desc("observations"), "station_id").limit(1)


def duplicate_key_check(rows: DataFrame, keys: tuple[str, ...] = ("station_id", "observed_at")) -> DataFrame:
    """How many keys have several rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))


def reconcile_totals(basins: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Whether the basins' stations add up to the snapshot's rows."""
    parts = basins.agg(F.coalesce(F.sum("total_stations"), F.lit(0)).alias("n")).select(F.col("n").alias("basin_total"), F.lit(0).alias("snapshot_rows"))
    whole = snapshot.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("basin_total"), F.col("n").alias("snapshot_rows"))
    sums = parts.union(whole).agg(F.sum("basin_total").alias("basin_total"), F.sum("snapshot_rows").alias("snapshot_rows"))
    return sums.withColumn("matches", F.col("basin_total") == F.col("snapshot_rows"))


def network_overview_kpis(basins: DataFrame) -> DataFrame:
    return basins.agg(
        F.coalesce(F.sum("total_stations"), F.lit(0)).alias("total_stations"), F.count_if((F.col("total_stations") > 0) & (F.col("stations_without_observation") == 0)).alias("complete_basins"),
        F.coalesce(F.sum(F.when(F.col("basin_name") == "Unknown", F.col("total_stations"))), F.lit(0)).alias("unknown_basin_stations"),
    )


def station_history_summary(history: DataFrame) -> DataFrame:
    """Of each station: points, points with a level, and the level at the first and last of them."""
    order = F.struct("observed_at", F.coalesce("source_record_id", F.lit("")))
    return history.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("points"), F.count("water_level_m").alias("points_with_level"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"),
        F.min_by("water_level_m", order).alias("first_level_m"), F.max_by("water_level_m", order).alias("last_level_m"),
    )


def top_basins(basins: DataFrame, n: int = 10) -> DataFrame:
    return basins.orderBy(F.desc("total_stations"), "basin_name").limit(n).select("basin_name", "total_stations", "stations_with_observation", "stations_without_observation")


def basin_options(snapshot: DataFrame) -> DataFrame:
    """The basins' labels, Unknown last."""
    labels = snapshot.select(basin_label(F.col("basin_name")).alias("basin_name")).distinct()
    return labels.orderBy(F.col("basin_name") == "Unknown", "basin_name")


def rows_without_station(rows: DataFrame) -> DataFrame:
    return rows.where(is_blank(F.col("station_id")))
