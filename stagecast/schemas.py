"""Declared schemas; nothing is inferred."""

OBSERVATION = """
    source string, time_series_id string, gauge_id string, parameter_code string,
    event_time timestamp, value double, unit string, first_seen_at timestamp,
    ingested_at timestamp, source_modified_at timestamp, qualifiers array<string>,
    approved boolean, payload_hash string
"""
REVISION = OBSERVATION + ", raw_payload map<string,string>"

# one feature of a landed continuous-values payload
FEATURE_PROPERTIES = """
    value string, time string, datetime string, phenomenonTime string, time_series_id string,
    monitoring_location_id string, unit_of_measure string, last_modified string,
    qualifier array<string>, approval_status string
"""

ENVELOPE = """
    schema_version int, event_type string,
    observation struct<source:string, time_series_id:string, gauge_id:string,
        parameter_code:string, event_time:timestamp, value:double, unit:string,
        first_seen_at:timestamp, ingested_at:timestamp, source_modified_at:timestamp,
        qualifiers:array<string>, approved:boolean, raw_payload_hash:string>,
    raw_payload map<string,string>
"""

BASIN = """
    slug string, name string, target_name string, gauge_id string, nwps_id string,
    flood_stage_ft double, latitude double, longitude double, river string
"""

SNAPSHOT_METADATA = """
    flood struct<categories:map<string,string>>,
    datums struct<vertical:struct<value:array<string>>>
"""

POINT = "struct<horizon_hours:int, valid_at:timestamp, quantiles:map<string,double>>"
FORECAST = f"""
    id string, target_id string, issued_at timestamp, newest_observation_at timestamp,
    observation_age_minutes double, available_data_cutoff timestamp, snapshot_id string,
    stage_model_version string, model_status string, discharge_model_version string,
    threshold_version string, mode string, freshness string, degradation_reasons array<string>,
    stage array<{POINT}>, maximum_stage array<{POINT}>, discharge array<{POINT}>,
    threshold_crossings array<struct<threshold_name:string, threshold_ft:double,
        horizon_hours:int, median_crosses:boolean, forecast_interval_straddles:boolean>>,
    horizon_model_mapping map<int,string>
"""
