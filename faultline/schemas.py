"""Row shapes and fixed values shared by every stage."""

from pyspark.sql import types as T

RAW_EVENT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("seq_no", T.LongType()),
    ]
)

# What every parser returns for one payload; ``error`` is '' for a parsed payload.
PARSED = (
    "struct<severity:int,timestamp:timestamp,service:string,host:string,message:string,"
    "stack_frames:array<string>,fields:map<string,string>,error:string>"
)

FIELD_ERRORS = "array<struct<field:string,error:string>>"

DEAD_LETTER = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq_no", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("failed_at", T.TimestampType()),
        T.StructField("attempt_count", T.IntegerType()),
    ]
)

DIAGNOSIS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("root_cause", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("affected_component", T.StringType()),
        T.StructField("fix_commands", T.ArrayType(T.StringType())),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("tokens_used", T.IntegerType()),
    ]
)

# Source names, severity scale and level words.
SOURCES = ("json", "syslog", "stacktrace")
SEVERITIES = ("unknown", "debug", "info", "warn", "error", "fatal")
ERROR_LEVEL = SEVERITIES.index("error")
LEVEL_WORDS = {
    "debug": ("debug", "trace"),
    "info": ("info", "notice", "informational"),
    "warn": ("warn", "warning"),
    "error": ("error", "err"),
    "fatal": ("fatal", "panic", "critical", "crit", "emerg", "alert"),
}

# Error texts a consumer of the dead letters can match on.
EMPTY_PAYLOAD = "domain: empty raw payload"
UNKNOWN_SOURCE = "domain: unknown source type"
MISSING_SERVICE = "domain: missing service name"
MISSING_MESSAGE = "domain: missing message body"
INVALID_TIMESTAMP = "domain: invalid or zero timestamp"
UNHANDLED_SOURCE = "ingest: unhandled source type"
INVALID_JSON = "ingest: invalid json payload"
EMPTY_STACK_TRACE = "ingest: empty stack trace payload"
VALIDATION_FAILED = "domain: validation failed"
NIL_REQUEST = "llm: nil diagnosis request"
PROVIDER_FAILED = "llm: provider request failed"
INVALID_RESPONSE = "llm: invalid json response from provider"

# Reasons of our own: lines that framing leaves out.
LINE_TOO_LONG = "ingest: line too long"
STREAM_STOPPED = "ingest: stream stopped at a long line"
