"""Column expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A current observation is fresh up to this age.
FRESH_HOURS = 24.0
#: ASCII and other white space that counts as blank in texts from the source.
WHITE = r"^[\s\u0085  -     　]+|[\s\u0085  -     　]+$"


def is_blank(c: Column) -> Column:
    """Null, or nothing but spaces (a tab is something)."""
    return c.isNull() | (F.trim(c) == "")


def clean_text(c: Column) -> Column:
    """Without white space at the ends; nothing left is null."""
    return F.nullif(F.regexp_replace(c, WHITE, ""), F.lit(""))


def basin_label(c: Column) -> Column:
    """The trimmed basin, or Unknown."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))


def normalize_trend(c: Column) -> Column:
    """RISING, FALLING or STABLE (from STEADY); all else is UNKNOWN."""
    up = F.upper(F.trim(c))
    return F.when(up.isin("RISING", "FALLING"), up).when(up == "STEADY", "STABLE").otherwise("UNKNOWN")


def point_lon(point: Column) -> Column:
    return F.try_element_at(point["coordinates"], F.lit(1))


def point_lat(point: Column) -> Column:
    return F.try_element_at(point["coordinates"], F.lit(2))


def safe_timestamp(c: Column) -> Column:
    """An ISO time with an offset, or null."""
    return F.try_to_timestamp(c)


def observation_age_hours(observed: Column, ingested: Column) -> Column:
    """Whole seconds between them in hours; negative for observations of the future."""
    return (F.unix_timestamp(ingested) - F.unix_timestamp(observed)) / F.lit(3600.0)


def freshness_status(has_observation: Column, age_hours: Column, limit: float = FRESH_HOURS) -> Column:
    return F.when(~has_observation, "missing").when(age_hours.isNull(), "unassessable").when(age_hours < 0, "future").when(age_hours <= limit, "fresh").otherwise("stale")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    """Both there, finite and on the globe."""
    inside = lambda c, most: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= most)
    return inside(latitude, 90) & inside(longitude, 180)


def rule_flags(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules)), lambda x: x.isNotNull())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
