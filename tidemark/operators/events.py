"""Pipeline events: decoding, duplicates, conflicts, retries, traces and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import EVENT_TYPES

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ZONED = r"^\d{4}-\d\d-\d\d[T ].*(Z|[+-]\d\d:?\d\d)$"


def decode_events(lines: DataFrame, value: str = "value", types: tuple[str, ...] | None = None) -> DataFrame:
    """Envelopes from JSON texts, with the list of what is wrong; rows without errors are events.

    data keeps scalars only, as texts.  types: only texts that may hold events of these types
    are decoded; the others are left out before.
    """
    if types:
        lines = lines.where(F.get_json_object(value, "$.event_type").isin(*types))
    # Generated: each use of an expression would parse the text, or look for the field, again, also in filters pushed below.
    v, e = F.col("_parsed"), lambda name: F.col(f"_e.{name}")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    names = ("event_id", "event_type", "occurred_at", "correlation_id")
    found = F.struct(
        v.isNotNull().alias("json"), *map(text, names), F.try_to_timestamp(text("occurred_at")).alias("at"), F.try_variant_get(v, "$.schema_version", "int").alias("schema_version"),
        F.try_variant_get(v, "$.data", "map<string,variant>").alias("pairs"),
    )
    kind = F.schema_of_variant
    scalar = F.forall(F.map_values(e("pairs")), lambda x: ~F.coalesce(kind(x).startswith("OBJECT") | kind(x).startswith("ARRAY"), F.lit(False)))
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    errors = [
        F.when(~e("json"), F.lit("not_json")), bad(e("event_id").rlike(UUID), "event_id"), bad(e("event_type").isin(*EVENT_TYPES), "event_type"),
        bad(e("occurred_at").rlike(ZONED) & e("at").isNotNull(), "occurred_at"), bad(e("correlation_id").rlike(UUID), "correlation_id"), bad(e("schema_version") >= 1, "schema_version"),
        bad(e("pairs").isNotNull() & scalar, "data"),
    ]
    texts = F.transform_values(e("pairs"), lambda _, x: F.try_variant_get(x, "$", "string"))
    parsed = lines.select("*", F.explode(F.array(F.try_parse_json(value))).alias("_parsed")).select(*lines.columns, F.explode(F.array(found)).alias("_e"))
    return parsed.select(
        *lines.columns, e("event_id"), e("event_type"), e("at").alias("occurred_at"), e("correlation_id"), e("schema_version"), texts.alias("data"),
        F.filter(F.array(*errors), lambda x: x.isNotNull()).alias("errors"),
    )


def encode_events(events: DataFrame) -> Column:
    """The canonical JSON of an envelope: keys in order."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("data")))
    return F.to_json(F.struct("correlation_id", entries.alias("data"), "event_id", "event_type", "occurred_at", "schema_version"))


def dedupe_events(events: DataFrame, order: str = "occurred_at") -> DataFrame:
    """One row for each event id, the first by order."""
    return events.groupBy("event_id").agg(F.min_by(F.struct(*(c for c in events.columns if c != "event_id")), F.struct(order)).alias("e")).select("event_id", "e.*").select(*events.columns)


def execution_conflicts(records: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests that have records which differ."""
    whole = F.xxhash64(*(c for c in records.columns if c != key))
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.countDistinct(whole).alias("versions")).where("versions > 1")


def retry_state(outcomes: DataFrame) -> DataFrame:
    """Failures since the last success of each request.

    outcomes: request_id, at, ok, error_type, error_message.  Requests without a
    failure after their last success have no state.
    """
    ended = outcomes.where("ok").groupBy("request_id").agg(F.max("at").alias("cleared_at"))
    open_ = outcomes.where("not ok").join(ended, "request_id", "left").where("cleared_at is null or at > cleared_at")
    last = F.struct("at", "error_type", "error_message")
    state = open_.groupBy("request_id").agg(F.count(F.lit(1)).alias("attempts"), F.min("at").alias("first_failed_at"), F.max(last).alias("last"))
    return state.select("request_id", "attempts", "first_failed_at", F.col("last.at").alias("last_failed_at"), F.col("last.error_type").alias("last_error_type"), F.col("last.error_message").alias("last_error_message"))


def dead_letter_split(state: DataFrame, max_attempts: int = 3) -> DataFrame:
    if max_attempts < 1:
        raise ValueError("max_attempts must be 1 or above")
    return state.withColumn("route", F.when(F.col("attempts") >= max_attempts, "dead-letter").otherwise("pending"))


def pending_by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def pipeline_trace(events: DataFrame) -> DataFrame:
    """Each request with the completions that name it, and the time each step took.

    ingestion.completed carries request_event_id, processing.completed ingestion_event_id.
    """
    requests = events.where(F.col("event_type") == EVENT_TYPES[0]).select(F.col("event_id").alias("request_event_id"), F.col("occurred_at").alias("requested_at"))
    ingested = events.where(F.col("event_type") == EVENT_TYPES[1]).select(F.element_at("data", "request_event_id").alias("request_event_id"), F.col("event_id").alias("ingestion_event_id"), F.col("occurred_at").alias("ingested_at"))
    processed = events.where(F.col("event_type") == EVENT_TYPES[2]).select(F.element_at("data", "ingestion_event_id").alias("ingestion_event_id"), F.col("event_id").alias("processing_event_id"), F.col("occurred_at").alias("processed_at"))
    return requests.join(ingested, "request_event_id", "left").join(processed, "ingestion_event_id", "left").select(
        "request_event_id", "ingestion_event_id", "processing_event_id", "requested_at", "ingested_at", "processed_at",
        (F.unix_timestamp("ingested_at") - F.unix_timestamp("requested_at")).alias("ingestion_seconds"), (F.unix_timestamp("processed_at") - F.unix_timestamp("ingested_at")).alias("processing_seconds"),
    )


def receipt_id(ingestion_event_id: Column) -> Column:
    """The id of the completion of an ingestion event: a UUID of its hash, the same each time."""
    h = F.sha1(F.concat(F.lit("processing.completed:"), ingestion_event_id))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def completion_receipts(ingested: DataFrame, results: DataFrame) -> DataFrame:
    """A processing.completed event for each ingestion event whose run has results.

    ingested: event_id, correlation_id, run_id; results: run_id, row_count, completed_at: one small row for each
    run, broadcast, as a shuffle would bring all events of a run to one task.  Those that the
    lake keeps also say where outputs and reports are: `tidemark.operators.receipts`.
    """
    data = F.create_map(F.lit("ingestion_event_id"), F.col("event_id"), F.lit("run_id"), F.col("run_id"), F.lit("row_count"), F.col("row_count").cast("string"))
    return ingested.join(F.broadcast(results), "run_id").select(
        receipt_id(F.col("event_id")).alias("event_id"), F.lit(EVENT_TYPES[2]).alias("event_type"), F.col("completed_at").alias("occurred_at"), "correlation_id", F.lit(1).alias("schema_version"), data.alias("data"),
    )


def receipt_violations(receipts: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Receipts that differ from the recomputed ones in anything but their time (kind: changed), or that nothing gives (unknown)."""
    said = F.to_json(F.struct("event_type", "correlation_id", "schema_version", F.map_from_entries(F.array_sort(F.map_entries("data"))).alias("data")))
    a = receipts.select("event_id", said.alias("said"))
    b = recomputed.select("event_id", said.alias("expected"))
    kind = F.when(F.col("expected").isNull(), "unknown").otherwise("changed").alias("kind")
    return a.join(b, "event_id", "left").where(~F.col("said").eqNullSafe(F.col("expected"))).select("event_id", kind, "said", "expected")
