"""Fixed schemas, as DDL texts, and allowed values of the monitoring network.  Every field is nullable."""

RIVER, RIVER_STATIONS = "river", "river-stations"
ENDPOINTS = (RIVER, RIVER_STATIONS)


POINT = "struct<type: string, coordinates: array<double>>"
DEMOGRAPHY = "struct<maleCount: bigint, femaleCount: bigint, householdCount: bigint>"
_SHARED = (
    f"id bigint, createdOn string, modifiedOn string, title string, basin string, point {POINT}, waterLevel double, image string, dangerLevel double, "
    "warningLevel double, waterLevelOn string, status string, elevation double, steady string, description string, stationSeriesId bigint, dataSource string, "
    "dataSourceId string, ward bigint, municipality bigint, district bigint, province bigint, wardId bigint, municipalityId bigint, districtId bigint, provinceId bigint"
)
#: A record of each endpoint.
RECORDS = {RIVER: f"{_SHARED}, station bigint", RIVER_STATIONS: f"{_SHARED}, affectedDemography {DEMOGRAPHY}"}


def record_schema(endpoint: str) -> str:
    if endpoint not in RECORDS:
        raise ValueError(f"no record schema for the endpoint {endpoint!r}")
    return RECORDS[endpoint]


def page_schema(endpoint: str) -> str:
    """A page of the endpoint with typed records."""
    return f"count bigint, next string, previous string, results array<struct<{record_schema(endpoint)}>>"


#: A page whose records are kept as JSON text, so that no element can spoil the others.
TEXT_PAGE = "count bigint, next string, previous string, results array<string>"

STATIONS = (
    "station_id string, station_series_id string, station_name string, basin_name string, latitude double, longitude double, elevation_m double, province_id bigint, "
    "district_id bigint, municipality_id bigint, ward_id bigint, description string, provider string, original_source string, source_created_at timestamp, "
    "source_modified_at timestamp, ingested_at timestamp, run_id string, source_page_index int"
)
OBSERVATIONS = (
    "source_record_id string, station_id string, source_station_series_id string, station_name string, river_name string, basin_name string, latitude double, "
    "longitude double, observed_at timestamp, water_level_m double, warning_level_m double, danger_level_m double, trend string, official_status string, provider string, "
    "original_source string, source_created_at timestamp, source_modified_at timestamp, ingested_at timestamp, run_id string, source_page_index int"
)
PROCESSED = {"stations": STATIONS, "observations": OBSERVATIONS}


def fields(flat: str) -> dict[str, str]:
    """Names and types of a schema without nested types."""
    return dict(field.split() for field in flat.split(", "))



MANIFEST = (
    "manifest_version int, status string, provider string, endpoint string, run_id string, captured_at timestamp, started_at timestamp, finished_at timestamp, "
    "duration_ms double, metrics struct<records_received: bigint, records_valid: bigint, records_invalid: bigint, stations_emitted: bigint, observations_emitted: bigint, "
    "records_without_observation: bigint>, raw_pages array<struct<page_index: int, record_count: bigint, payload_key: string, metadata_key: string, "
    "payload_size_bytes: bigint, payload_sha256: string>>, quarantine_objects array<struct<page_index: int, record_index: bigint, object_key: string>>"
)
EVENT_TYPES = ("ingestion.requested", "ingestion.completed", "processing.completed")
