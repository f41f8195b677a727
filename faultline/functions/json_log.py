"""JSON log lines to the parsed event struct."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import text as X
from faultline.functions.compute import built_once, compute_once
from faultline.functions.parsed import parse_failure
from faultline.functions.severity import parse_severity
from faultline.functions.timestamps import number_time, text_time

# Key names per target, matched without case. Of several names present the
# first in this order is taken.
SERVICE_KEYS = ("service", "app", "app_name", "service_name")
LEVEL_KEYS = ("level", "severity", "log_level", "lvl")
MESSAGE_KEYS = ("msg", "message", "error", "err_msg")
HOST_KEYS = ("host", "hostname", "server")
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp")
STACK_KEYS = ("stack", "stacktrace", "trace", "exception")
KNOWN_KEYS = SERVICE_KEYS + LEVEL_KEYS + MESSAGE_KEYS + HOST_KEYS + TIME_KEYS + STACK_KEYS

# Variant type names of numbers that are not plain integers.
REAL_KINDS = ("DECIMAL", "DOUBLE", "FLOAT")

# How decoding to text spells numbers that may have been written otherwise.
REAL_TEXT = r"^-?[0-9]+(?:\.[0-9]+(?:E-?[0-9]+)?|E-?[0-9]+)$"

UNKNOWN_SERVICE = "unknown-service"
NULL_TEXT = "<nil>"

# Strict JSON: the reader's lenient defaults are switched off.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _kind(value: Column) -> Column:
    """Type name of a value: STRING, BIGINT, OBJECT and so on."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _number_literal(payload: Column, key: Column, value: Column) -> Column:
    """The number as written: fractions and exponents are looked up in the payload."""
    pattern = F.concat(F.lit('"\\Q'), key, F.lit('\\E"\\s*:\\s*(-?[0-9][-+.0-9eE]*)'))
    same = F.filter(
        F.regexp_extract_all(payload, pattern, F.lit(1)),
        lambda written: written.try_cast("double") == value.cast("double"),
    )
    return F.coalesce(F.try_element_at(same, F.lit(-1)), value.cast("string"))


def _value_sql(name: str) -> str:
    """Value of the key with this lower-case name; null when there is none.

    The key lists run backwards, so that of a repeated key the last one counts. The lookups are SQL text because
    a plan of many columns takes long to put together call by call.
    """
    return f"get(_values, CAST(array_position(_names, '{name}') AS INT) - 1)"


def _first_text(names: tuple[str, ...]) -> Column:
    """Text under the first of the names that holds one."""
    values = [_value_sql(name) for name in names]
    texts = [f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN CAST({v} AS STRING) END" for v in values]
    return F.expr(f"coalesce({', '.join(texts)}, '')")


def _frames(value: Column) -> Column:
    """Stack value to trimmed, non-blank frames: text by line, arrays by text element."""
    kind = _kind(value)
    elements = F.filter(
        value.cast("array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"
    )
    parts = F.when(kind == "STRING", X.lines(value.cast("string"))).when(
        kind == "ARRAY", F.transform(elements, lambda v: v.cast("string"))
    )
    return F.filter(F.transform(parts, X.strip), lambda frame: frame != "")


def _stack_frames() -> Column:
    stacks = F.expr(f"array({', '.join(map(_value_sql, STACK_KEYS))})")
    none = F.array().cast("array<string>")
    return F.flatten(
        F.transform(
            F.filter(stacks, lambda stack: stack.isNotNull()),
            lambda stack: F.coalesce(_frames(stack), none),
        )
    )


def _extra_fields(document: Column, payload: Column) -> Column:
    """The other keys with their values as text; nested values stay compact JSON.

    Decoding to text gives most values as they are. Numbers with a fraction or exponent are
    rewritten by it and get their literal back; repeated keys take the longer way.
    """
    texts = F.map_filter(
        F.from_json(document, "map<string,string>", STRICT),
        lambda key, text: ~F.lower(key).isin(*KNOWN_KEYS),
    )

    def as_written(key: Column, text: Column) -> Column:
        value = F.get("_values", F.array_position("_keys", key).cast("int") - 1)
        literal = F.when(
            _kind(value).isin(*REAL_KINDS), _number_literal(payload, key, value)
        ).otherwise(text)
        return (
            F.when(text.isNull(), F.lit(NULL_TEXT))
            .when(F.rlike(text, F.lit(REAL_TEXT)), literal)
            .otherwise(text)
        )

    unique = F.size(F.array_distinct("_keys")) == F.size("_keys")
    return F.when(unique, F.transform_values(texts, as_written)).otherwise(
        _extra_fields_by_type(payload)
    )


def _extra_fields_by_type(payload: Column) -> Column:
    """Other keys of documents with repeated keys."""

    def with_text(entry: Column) -> Column:
        key, value, kind = entry["key"], entry["value"], entry["kind"]
        text = (
            F.when(kind == "VOID", F.lit(NULL_TEXT))
            .when(kind.isin("OBJECT", "ARRAY"), F.to_json(value))
            .when(kind.isin(*REAL_KINDS), _number_literal(payload, key, value))
            .otherwise(value.cast("string"))
        )
        return F.struct(key.alias("key"), text.alias("value"))

    entries = F.arrays_zip(
        F.col("_keys").alias("key"), F.col("_names").alias("name"), F.col("_values").alias("value")
    )
    extra = F.filter(
        entries,
        lambda e, i: ~e["name"].isin(*KNOWN_KEYS)
        & (F.array_position("_keys", e["key"]) == i + 1),
    )
    typed = F.transform(
        extra,
        lambda e: F.struct(
            e["key"].alias("key"), e["value"].alias("value"), _kind(e["value"]).alias("kind")
        ),
    )
    return F.map_from_entries(F.transform(typed, with_text))


@built_once
def _steps(rows: str, out: str) -> tuple[Column, dict, dict, dict]:
    """The columns of ``parse_json``, step by step."""
    payload = F.col("payload")
    null_document = F.rlike(payload, F.lit(r"^[ \t\r\n]*null(?![A-Za-z0-9_])"))
    document = F.when(null_document, F.lit("{}")).otherwise(payload)
    decoded = F.when(F.col(rows), F.from_json(document, "map<string,variant>", STRICT))
    entries = {
        "_keys": F.reverse(F.map_keys("_object")),
        "_names": F.reverse(F.transform(F.map_keys("_object"), F.lower)),
        "_values": F.reverse(F.map_values("_object")),
    }
    time = F.expr(f"coalesce({', '.join(map(_value_sql, TIME_KEYS))})")
    time_names = [f"WHEN array_contains(_names, '{name}') THEN '{name}'" for name in TIME_KEYS]
    time_key = F.expr(f"CASE {' '.join(time_names)} END")
    texts = {
        "_level": F.lower(_first_text(LEVEL_KEYS)),
        "_service": F.nullif(_first_text(SERVICE_KEYS), F.lit("")),
        "_time_kind": _kind(time),
        "_time_text": F.when(
            _kind(time).isin(*REAL_KINDS), _number_literal(payload, time_key, time)
        ).otherwise(time.try_cast("string")),
    }
    kind, text = F.col("_time_kind"), F.col("_time_text")
    instant = F.when(kind == "STRING", text_time(text)).when(
        kind.isin("BIGINT", *REAL_KINDS), number_time(text)
    )
    stream_id = F.nullif(X.or_empty(F.col("stream_id")), F.lit(""))
    event = F.struct(
        parse_severity(F.col("_level")).alias("severity"),
        F.coalesce(instant, "received_at").alias("timestamp"),
        F.coalesce("_service", stream_id, F.lit(UNKNOWN_SERVICE)).alias("service"),
        _first_text(HOST_KEYS).alias("host"),
        _first_text(MESSAGE_KEYS).alias("message"),
        _stack_frames().alias("stack_frames"),
        F.lit(None).alias("fields"),
        F.lit("").alias("error"),
    ).cast(S.PARSED)
    failure = parse_failure(
        F.when(X.or_empty(payload) == "", S.EMPTY_PAYLOAD).otherwise(S.INVALID_JSON)
    )
    is_object = F.col("_keys").isNotNull()
    parsed = F.when(is_object, event).otherwise(failure)
    fields = F.when(is_object, _extra_fields(document, payload)).cast("map<string,string>")
    return decoded, entries, texts, {out: F.when(F.col(rows), parsed), f"{out}_fields": fields}


def parse_json(df: DataFrame, rows: Column, out: str) -> DataFrame:
    """Add ``out`` (struct ``PARSED``) for the rows where ``rows`` holds, null elsewhere.

    The object is decoded once per row. A ``null`` document counts as an empty object. The extra fields are a
    column of their own, ``<out>_fields``, so that they cost nothing where nobody selects them.
    """
    flag = f"{out}_rows"
    decoded, entries, texts, outs = _steps(flag, out)
    df = df.withColumn(flag, rows).withColumn("_object", decoded)
    df = compute_once(df, **entries).drop("_object")
    df = compute_once(df, **texts)
    return df.withColumns(outs).drop(flag, *entries, *texts)
