"""Quality rules of rows, runs and data sets.

Rules never drop or repair a row; they say what is wrong with it.  All measures
describe the data, not the rivers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_of, is_blank, ratio, rule_flags
from tidemark.schemas import RIVER_STATIONS


@dataclass(frozen=True)
class Policy:
    """From which age a current observation is stale, and from which level one is suspicious."""

    max_age_hours: float = 24.0
    suspicious_level_m: float = 10_000.0

    def __post_init__(self) -> None:
        if self.max_age_hours <= 0 or self.suspicious_level_m <= 0:
            raise ValueError("the limits of the policy must be above 0")


def duplicate_in_run(df: DataFrame, keys: list[str], flag: str, spread: list[str] | None = None) -> DataFrame:
    """df with a flag on rows whose keys others of the same run have too; null or blank runs and keys never are.

    Only repeated keys are joined back.  Rows with a blank key meet none; they are spread by the
    values of some columns (spread), as they would all go to one task of the join.
    """
    texts = dict(df.dtypes)
    filled = lambda c: ~is_blank(F.col(c)) if texts[c] == "string" else F.col(c).isNotNull()
    by = ["run_id", *keys]
    whole = all_of([filled(c) for c in by])
    # No constant for the rows with keys: the optimizer would take it out of the join's keys.
    parted = df.withColumn("_part", F.when(whole, F.xxhash64(*by)).otherwise(F.xxhash64(*(spread or by))))
    repeated = parted.where(whole).groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*by, "_part", F.lit(True).alias(flag))
    return parted.join(repeated, [*by, "_part"], "left").select(*df.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def outside(c: Column, most: float) -> Column:
    return c.isNotNull() & ((c < -most) | (c > most))


def missing_pair(a: Column, b: Column) -> Column:
    """Either of two values that belong together is missing."""
    return a.isNull() | b.isNull()


def above(low: Column, high: Column) -> Column:
    """A limit that is above the one it should be below; where one is missing, it isn't."""
    return F.coalesce(low > high, F.lit(False))


def stale(limit_hours: float) -> Column:
    """A row of a snapshot older than the limit.  History is never stale, and future rows aren't either."""
    age = F.unix_timestamp("ingested_at") - F.unix_timestamp("observed_at")
    return F.coalesce((F.col("endpoint") == RIVER_STATIONS) & (age > limit_hours * 3600), F.lit(False))


def graded(df: DataFrame, errors: list[tuple[str, Column]], warnings: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """keep and the rules that fired, their counts, and the status: fail for any error, warn for any warning, else pass."""
    flagged = df.select(*keep, rule_flags(errors).alias("quality_errors"), rule_flags(warnings).alias("quality_warnings"))
    n, m = F.size("quality_errors"), F.size("quality_warnings")
    return flagged.select("*", n.alias("quality_error_count"), m.alias("quality_warning_count"), F.when(n > 0, "fail").when(m > 0, "warn").otherwise("pass").alias("quality_status"))


def observation_quality(observations: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """observations with their quality columns; endpoint says which rows can be stale."""
    c, keep = F.col, observations.columns
    spread = ["source_record_id", "station_id", "observed_at", "latitude", "longitude", "water_level_m"]
    rows = duplicate_in_run(duplicate_in_run(observations, ["source_record_id"], "_same_record", spread), ["station_id", "observed_at"], "_same_time", spread)
    errors = [
        ("missing_source_record_id", is_blank(c("source_record_id"))), ("missing_station_id", is_blank(c("station_id"))), ("missing_observed_at", c("observed_at").isNull()),
        ("missing_run_id", is_blank(c("run_id"))), ("invalid_latitude", outside(c("latitude"), 90)), ("invalid_longitude", outside(c("longitude"), 180)), ("duplicate_source_record_id", c("_same_record")),
    ]
    warnings = [
        ("missing_water_level", c("water_level_m").isNull()), ("missing_coordinates", missing_pair(c("latitude"), c("longitude"))),
        ("suspicious_water_level", F.abs("water_level_m") >= policy.suspicious_level_m), ("warning_above_danger", above(c("warning_level_m"), c("danger_level_m"))),
        ("stale_current_observation", stale(policy.max_age_hours)), ("duplicate_station_observed_at", c("_same_time")),
    ]
    return graded(rows, errors, warnings, keep)


def station_quality(stations: DataFrame) -> DataFrame:
    """stations with their quality columns."""
    c, keep = F.col, stations.columns
    spread = ["station_id", "station_series_id", "station_name", "latitude", "longitude"]
    rows = duplicate_in_run(duplicate_in_run(stations, ["station_id"], "_same_station", spread), ["station_series_id"], "_same_series", spread)
    errors = [
        ("missing_station_id", is_blank(c("station_id"))), ("missing_station_name", is_blank(c("station_name"))), ("missing_run_id", is_blank(c("run_id"))),
        ("invalid_latitude", outside(c("latitude"), 90)), ("invalid_longitude", outside(c("longitude"), 180)), ("duplicate_station_id", c("_same_station")),
    ]
    warnings = [
        ("missing_station_series_id", is_blank(c("station_series_id"))), ("missing_basin_name", is_blank(c("basin_name"))),
        ("missing_coordinates", missing_pair(c("latitude"), c("longitude"))), ("duplicate_station_series_id", c("_same_series")),
    ]
    return graded(rows, errors, warnings, keep)


def rows_by_rule(flagged: DataFrame, rule: str) -> DataFrame:
    return flagged.where(F.array_contains("quality_errors", rule) | F.array_contains("quality_warnings", rule))


def rows_not_passing(flagged: DataFrame) -> DataFrame:
    return flagged.where("quality_status <> 'pass'")


def status_counts(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return flagged.groupBy(*(by or []), "quality_status").agg(F.count(F.lit(1)).alias("n_rows"))


def rule_counts(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows each rule fired on, by severity and rule."""
    by = by or []
    named = lambda severity: F.transform(f"quality_{severity}s", lambda r: F.struct(F.lit(severity).alias("severity"), r.alias("rule")))
    fired = flagged.select(*by, F.explode(F.concat(named("error"), named("warning"))).alias("fired"))
    return fired.groupBy(*by, F.col("fired.severity").alias("severity"), F.col("fired.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_rows"))


def dataset_quality_summary(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each group (or all rows): totals by status, the share that passes, the worst status, and rule counts in order of rule.

    Rule counts are given where there are groups; each lists as many as there are rules.
    """
    by = by or []
    named = ("pass", "warn", "fail")
    if by:
        # The rows' kinds are few, as rules are; so rows are flagged once, for totals and rules alike.
        kinds = flagged.groupBy(*by, "quality_status", "quality_errors", "quality_warnings").agg(F.count(F.lit(1)).alias("n"))
        of = lambda s: F.coalesce(F.sum(F.when(F.col("quality_status") == s, F.col("n"))), F.lit(0).cast("long")).alias(f"{s}_rows")
        totals = kinds.groupBy(*by).agg(F.sum("n").alias("total_rows"), *map(of, named), F.collect_list(F.struct("quality_errors", "quality_warnings", "n")).alias("_kinds"))
    else:
        totals = flagged.agg(F.count(F.lit(1)).alias("total_rows"), *(F.count_if(F.col("quality_status") == s).alias(f"{s}_rows") for s in named))
    status = F.when((F.col("total_rows") == 0) | (F.col("fail_rows") > 0), "fail").when(F.col("warn_rows") > 0, "warn").otherwise("pass")
    out = totals.withColumn("affected_rows", F.col("warn_rows") + F.col("fail_rows")).withColumn("pass_ratio", ratio(F.col("pass_rows"), F.col("total_rows"))).withColumn("status", status)
    if not by:
        return out
    fired = {s: _rules_of_kinds(f"quality_{s}s") for s in ("error", "warning")}
    none = (F.size(fired["error"]) == 0) & (F.size(fired["warning"]) == 0)
    return out.select(*(c for c in out.columns if c != "_kinds"), *(F.when(~none, fired[s]).alias(f"{s}_counts") for s in fired))


def _rules_of_kinds(of: str) -> Column:
    """How many rows each rule of a list fired on, in order of rule, from _kinds: rows' lists with their number."""
    rules = F.array_sort(F.array_distinct(F.flatten(F.transform("_kinds", lambda k: k[of]))))
    times = lambda k, rule: F.size(F.filter(k[of], lambda r: r == rule)) * k["n"]
    counted = lambda rule: F.aggregate("_kinds", F.lit(0).cast("long"), lambda n, k: n + times(k, rule))
    return F.transform(rules, lambda rule: F.struct(rule.alias("rule"), counted(rule).alias("n_rows")))


def current_data_health(stations: DataFrame, observations: DataFrame, limit_hours: float = 24.0) -> DataFrame:
    """Of each run: how many of its stations have observations, and how fresh these are.

    Coverage is over distinct station ids, freshness over all observations.
    """
    ids = stations.where(~is_blank(F.col("station_id"))).select("run_id", "station_id").distinct()
    seen = observations.where(~is_blank(F.col("station_id"))).select("run_id", "station_id", F.lit(1).alias("seen")).distinct()
    covered = ids.join(seen, ["run_id", "station_id"], "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("total_stations"), F.count("seen").alias("stations_with_observation"))
    age = F.unix_timestamp("ingested_at") - F.unix_timestamp("observed_at")
    seconds = limit_hours * 3600
    measured = observations.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_observations"), F.count_if((age >= 0) & (age <= seconds)).alias("fresh_observations"), F.count_if(age > seconds).alias("stale_observations"),
        F.count_if(age < 0).alias("future_observations"), F.count_if(age.isNull()).alias("unassessable_observations"),
        F.min("observed_at").alias("oldest_observed_at"), F.max("observed_at").alias("latest_observed_at"),
    )
    both = covered.join(measured, "run_id", "full_outer")
    numbers = [c for c in both.columns if c not in ("run_id", "oldest_observed_at", "latest_observed_at")]
    out = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers}).withColumn("stations_without_observation", F.expr("total_stations - stations_with_observation"))
    bad = F.expr("total_stations = 0 or total_observations = 0 or fresh_observations = 0")
    odd = F.expr("stations_without_observation > 0 or stale_observations > 0 or future_observations > 0 or unassessable_observations > 0")
    return (
        out.withColumn("coverage_ratio", ratio(F.col("stations_with_observation"), F.col("total_stations")))
        .withColumn("freshness_ratio", ratio(F.col("fresh_observations"), F.col("total_observations")))
        .withColumn("status", F.when(bad, "fail").when(odd, "warn").otherwise("pass"))
    )
