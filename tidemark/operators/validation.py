"""Validation of raw records: what is wrong with each, and what runs received.

A record is the JSON text of one element of a page.  Rules are a table of fields;
each failure is an issue (error_type, location, message).  Numbers and dates may come as
texts that read as such, and whole numbers as floats without a fraction; other types
don't pass for each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import RIVER, RIVER_STATIONS, record_schema

ISSUE = "struct<error_type: string, location: array<string>, message: string>"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False


_REQUIRED = [Field("id", "int", True), Field("createdOn", "datetime", True), Field("modifiedOn", "datetime", True), Field("title", "string", True), Field("point", "point", True)]
_OPTIONAL = [
    *(Field(n, "string") for n in ("basin", "image", "status", "steady", "description", "dataSource")), *(Field(n, "float") for n in ("waterLevel", "dangerLevel", "warningLevel", "elevation")),
    *(Field(n, "int") for n in ("stationSeriesId", "ward", "municipality", "district", "province")), Field("dataSourceId", "int_or_string"),
]
RULES: dict[str, list[Field]] = {
    RIVER: [*_REQUIRED, Field("waterLevelOn", "datetime", True), Field("station", "int", True), *_OPTIONAL],
    RIVER_STATIONS: [*_REQUIRED, Field("waterLevelOn", "datetime"), Field("affectedDemography", "demography"), *_OPTIONAL],
}
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
COUNTS = ("maleCount", "femaleCount", "householdCount")
WHOLE, NUMBER = r"^\s*[+-]?\d+(\.0*)?\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _issue(fails: Column, error_type: str, location: list[str], message: str) -> Column:
    """A list of one issue, or of none."""
    issue = F.struct(F.lit(error_type).alias("error_type"), F.array(*map(F.lit, location)).cast("array<string>").alias("location"), F.lit(message).alias("message"))
    return F.when(fails, F.array(issue).cast(f"array<{ISSUE}>")).otherwise(_none())


def _kind(value: Column) -> Column:
    """The JSON type of a variant: STRING, BIGINT, DECIMAL…, DOUBLE, BOOLEAN, OBJECT…, ARRAY…, VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _readings(v: Column, endpoint: str) -> Column:
    """What the rules ask of a record v (a variant): for each field its type (null: it is absent) and its text.

    Each is read once: rules that looked into the variant themselves would do so in every place that names it.
    """

    def read(at: str) -> Column:
        return F.struct(_kind(F.try_variant_get(v, f"$.{at}", "variant")).alias("kind"), F.try_variant_get(v, f"$.{at}", "string").alias("text"))

    kind = lambda at: _kind(F.try_variant_get(v, at, "variant"))
    found = [F.try_variant_get(v, "$", "map<string,variant>").isNotNull().alias("is_object")]
    for field in RULES[endpoint]:
        at = f"$.{field.name}"
        if field.kind == "demography":
            found.append(F.struct(kind(at).alias("kind"), *(read(f"{field.name}.{n}").alias(n) for n in COUNTS)).alias(field.name))
        elif field.kind == "point":
            items = F.try_variant_get(v, f"{at}.coordinates", "array<variant>")
            floats = F.forall(items, lambda x: F.coalesce(_kind(x).isin(*NUMBERS) | ((_kind(x) == "STRING") & F.try_variant_get(x, "$", "string").rlike(NUMBER)), F.lit(False)))
            keys = F.map_keys(F.try_variant_get(v, at, "map<string,variant>"))
            found.append(F.struct(
                kind(at).alias("kind"), kind(f"{at}.type").alias("type_kind"), F.try_variant_get(v, f"{at}.type", "string").alias("type"), kind(f"{at}.coordinates").alias("coordinates"),
                F.coalesce(F.size(items), F.lit(0)).alias("n"), floats.alias("floats"), F.coalesce(F.size(F.array_except(keys, F.array(F.lit("type"), F.lit("coordinates")))) > 0, F.lit(False)).alias("more"),
            ).alias(field.name))
        elif field.kind == "string":
            found.append(F.struct(kind(at).alias("kind"), F.lit(None).cast("string").alias("text")).alias(field.name))
        else:
            found.append(read(field.name).alias(field.name))
    return F.struct(*found)


_NUMBER_KIND = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
_PLAIN_KIND = {"string": "STRING", "int": "BIGINT", "float": _NUMBER_KIND, "int_or_string": "(?:BIGINT|STRING)", "datetime": "STRING", "point": f"OBJECT<coordinates: ARRAY<{_NUMBER_KIND}>, type: STRING>", "demography": "VOID"}


def _is_plain(v: Column, endpoint: str) -> Column:
    """Whether a record v (a variant) has only known fields, each of the type that a valid one has as a rule, and nothing else is wrong: then it has no issues.

    The types of all fields are one text, in the order of their names.  What isn't plain may still be valid.
    """

    def said(field: Field) -> str:
        kind = _PLAIN_KIND[field.kind]
        return rf"{field.name}: {kind}(?:, |>$)" if field.required else rf"(?:{field.name}: (?:{kind}|VOID)(?:, |>$))?"

    shape = "^OBJECT<" + "".join(map(said, sorted(RULES[endpoint], key=lambda f: f.name))) + "$"
    times = [F.try_variant_get(v, f"$.{f.name}", "string") for f in RULES[endpoint] if f.kind == "datetime"]
    at = F.try_variant_get(v, "$.point.coordinates", "array<double>")
    # An array's type doesn't tell of nulls in it.
    point = (F.try_variant_get(v, "$.point.type", "string") == "Point") & (F.size(at) == 2) & F.get(at, 0).isNotNull() & F.get(at, 1).isNotNull()
    good = F.schema_of_variant(v).rlike(shape) & point
    for text in times:
        good = good & (text.isNull() | F.try_to_timestamp(text).isNotNull())
    return F.coalesce(good, F.lit(False))


def _field_issues(read: Column, field: Field, at: list[str] | None = None) -> list[Column]:
    """The issues of one field, from its readings."""
    at = at or [field.name]
    kind = read["kind"]
    absent = kind.isNull()
    there = ~absent & (kind != "VOID")
    out = [_issue(absent, "missing", at, "the field is required")] if field.required else []
    wrong = lambda ok, name, say: _issue((there if not field.required else ~absent) & ~F.coalesce(ok, F.lit(False)), name, at, say)
    if field.kind == "demography":
        is_object = kind == "OBJECT"
        inner = [c for n in COUNTS for c in _field_issues(read[n], Field(n, "int"), [*at, n])]
        return [wrong(is_object, "model_type", "an object is wanted"), *(F.when(is_object, c).otherwise(_none()) for c in inner)]
    if field.kind == "point":
        is_object, no_coordinates, n = F.coalesce(kind == "OBJECT", F.lit(False)), read["coordinates"].isNull(), read["n"]
        listed = F.coalesce(read["coordinates"] == "ARRAY", F.lit(False))
        return [
            *out, _issue(~absent & ~is_object, "model_type", at, "a point is wanted"),
            _issue(is_object & read["type_kind"].isNull(), "missing", [*at, "type"], "the field is required"),
            _issue(is_object & (read["type"] != "Point"), "literal_error", [*at, "type"], "only Point is taken"),
            _issue(is_object & no_coordinates, "missing", [*at, "coordinates"], "the field is required"),
            _issue(is_object & ~no_coordinates & ~listed, "tuple_type", [*at, "coordinates"], "two numbers are wanted"),
            _issue(listed & (n < 2), "missing", [*at, "coordinates"], "two numbers are wanted"),
            _issue(listed & (n > 2), "too_long", [*at, "coordinates"], "two numbers are wanted"),
            _issue(listed & (n > 0) & ~read["floats"], "float_type", [*at, "coordinates"], "numbers are wanted"),
            _issue(is_object & read["more"], "extra_forbidden", at, "the point has more fields"),
        ]
    text = read["text"]
    number = kind.isin(*NUMBERS)
    whole = (number & (text.cast("double") == F.floor(text.cast("double")))) | ((kind == "STRING") & text.rlike(WHOLE))
    match field.kind:
        case "string":
            return [*out, wrong(kind == "STRING", "string_type", "a text is wanted")]
        case "int":
            return [*out, wrong(whole, "int_type", "a whole number is wanted")]
        case "float":
            return [*out, wrong(number | ((kind == "STRING") & text.rlike(NUMBER)), "float_type", "a number is wanted")]
        case "int_or_string":
            return [*out, wrong(whole | (kind == "STRING"), "int_type", "a whole number or a text is wanted")]
    return [*out, wrong(number | ((kind == "STRING") & F.try_to_timestamp(text).isNotNull()), "datetime_type", "a time is wanted")]


def _issues(read: Column, endpoint: str) -> Column:
    """The issues of a record from its readings."""
    found = F.concat(*(c for f in RULES[endpoint] for c in _field_issues(read[f.name], f)))
    return F.when(read["is_object"], found).otherwise(_issue(F.lit(True), "model_type", [], "an object is wanted"))


def validation_issues(v: Column, endpoint: str) -> Column:
    """The issues of a record, as a variant that is null for a text that is no JSON; none: it is valid."""
    return F.get(F.transform(F.array(_readings(v, endpoint)), lambda r: _issues(r, endpoint)), 0)


def validate_records(pages: DataFrame, endpoint: str, start_index: int = 0) -> DataFrame:
    """Every element of the text pages with its place, issues and, if it has none, its typed record.

    record_index counts on over the pages of a run from start_index: elements of
    earlier pages come from the counts of the pages, which are few for a run.
    """
    if start_index < 0:
        raise ValueError("start_index must be 0 or above")
    earlier = Window.partitionBy("run_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    counted = pages.select("endpoint", "run_id", "page_index", F.coalesce(F.size("results"), F.lit(0)).alias("n"))
    offsets = counted.select("run_id", "page_index", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    # Joined as pages: their elements would be many more rows to shuffle.
    placed = pages.select("endpoint", "provider", "run_id", "page_index", "results").join(offsets, ["run_id", "page_index"])
    rows = placed.select("endpoint", "provider", "run_id", "page_index", "offset", F.posexplode("results").alias("pos", "raw"))
    raw = F.coalesce("raw", F.lit("null"))
    # Generated: each use of an expression would parse and judge the text again, also in filters pushed below.
    parsed = rows.select("*", F.explode(F.array(F.try_parse_json(raw))).alias("parsed"))
    # Most records are plain; the rules are asked about the others.
    known = parsed.select("*", F.explode(F.array(_is_plain(F.col("parsed"), endpoint))).alias("plain"))
    read = known.select("*", F.explode(F.array(F.when(~F.col("plain"), _readings(F.col("parsed"), endpoint)))).alias("read"))
    judged = read.select("*", F.explode(F.array(F.when(F.col("plain"), _none()).otherwise(_issues(F.col("read"), endpoint)))).alias("issues"))
    return judged.select(
        "endpoint", "provider", "run_id", "page_index", (F.col("offset") + F.col("pos") + start_index).alias("record_index"), raw.alias("raw"), "issues"
    ).withColumn("record", F.when(F.size("issues") == 0, F.from_json("raw", record_schema(endpoint))))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where(F.size("issues") == 0).drop("issues"), validated.where(F.size("issues") > 0).drop("record")


def ingestion_metrics(validated: DataFrame) -> DataFrame:
    """For each run what came in and what became of it."""
    valid, snapshot, observed = F.col("valid"), F.col("endpoint") == RIVER_STATIONS, F.coalesce("observed", F.lit(False))
    rows = validated.select("endpoint", "run_id", "raw", (F.size("issues") == 0).alias("valid"))
    time = F.try_to_timestamp(F.try_variant_get(F.try_parse_json("raw"), "$.waterLevelOn", "string"))
    # Generated, as above: the text is read once for both numbers.
    rows = rows.select("*", F.explode(F.array(F.when(valid, time.isNotNull()))).alias("observed"))
    return rows.groupBy("endpoint", "run_id").agg(
        F.count(F.lit(1)).alias("records_received"), F.count_if(valid).alias("records_valid"), F.count_if(~valid).alias("records_invalid"),
        F.count_if(valid & snapshot).alias("stations_emitted"), F.count_if(observed).alias("observations_emitted"), F.count_if(valid & ~observed).alias("records_without_observation"),
    )


def metrics_invariants(metrics: DataFrame) -> DataFrame:
    """The runs whose numbers contradict each other, with what does."""
    checks = {
        "valid_plus_invalid": "records_valid + records_invalid <> records_received", "stations_above_valid": "stations_emitted > records_valid",
        "observations_above_valid": "observations_emitted > records_valid", "without_above_valid": "records_without_observation > records_valid",
        **({"finished_before_started": "finished_at < started_at"} if "finished_at" in metrics.columns else {}),
        **({"quarantined_not_invalid": "quarantined <> records_invalid"} if "quarantined" in metrics.columns else {}),
        # Each record of a historical batch becomes an observation or is quarantined.
        **({"batch_total": f"endpoint = '{RIVER}' and observations_emitted + quarantined <> records_received"} if "quarantined" in metrics.columns else {}),
    }
    found = F.filter(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return metrics.withColumn("violations", found).where(F.size("violations") > 0)
