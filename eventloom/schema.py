"""Declared schemas; nothing is inferred from data."""

CATALOG = (
    "key STRING, title STRING, description STRING, url STRING, city STRING, location STRING, is_online BOOLEAN, start_date DATE, "
    "end_date DATE, category STRING, is_free BOOLEAN, price STRING, provider STRING, content_hash STRING, first_seen_at TIMESTAMP, "
    "last_seen_at TIMESTAMP, status STRING, status_reason STRING, version INT"
)
EVENT = "title STRING, description STRING, url STRING, city STRING, location STRING, is_online BOOLEAN, start_date DATE, end_date DATE, category STRING, is_free BOOLEAN, price STRING, provider STRING"
CANDIDATE = "source STRING, event_key STRING, rank INT, score DOUBLE"
INTERACTION = "user_id STRING, type STRING, at TIMESTAMP, event_key STRING, query STRING"
VERTEX = "id STRING, type STRING, name STRING, events BIGINT, cities ARRAY<STRING>, categories ARRAY<STRING>, first_seen DATE, last_seen DATE"
EDGE = "source STRING, type STRING, target STRING"
EXTRACTED = "url STRING, cluster STRING, field STRING, value STRING, status STRING, confidence DOUBLE, source STRING"
