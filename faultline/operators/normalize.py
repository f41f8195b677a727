"""Raw events to normalized, validated and signed events in one narrow pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import signature as G
from faultline.functions import validate as V
from faultline.functions.compute import built_once, compute_once
from faultline.functions.event_id import event_id
from faultline.functions.json_log import parse_json
from faultline.functions.parsed import parse_failure
from faultline.functions.severity import is_error_level, severity_name
from faultline.functions.stacktrace import parse_stacktrace
from faultline.functions.syslog import parse_syslog
from faultline.functions.text import or_empty

# Source name to parser. A parser adds one struct column for the rows it is given, and may add the
# fields as a column of their own (see ``parse_json``); callers may pass their own table to replace one
# or to serve more sources.
PARSERS = {"json": parse_json, "syslog": parse_syslog, "stacktrace": parse_stacktrace}


def parse(raw: DataFrame, parsers=None, rows: Column | None = None) -> DataFrame:
    """Route every row to the parser of its source; adds ``parsed`` (struct ``PARSED``) and ``fields``.

    All parsers work on the same scan: a row takes the branch of its source and skips the
    others. Rows outside ``rows`` stay unparsed, sources without parser get an error.
    """
    parsers = PARSERS if parsers is None else parsers
    wanted = F.lit(True) if rows is None else rows
    outs = []
    df = raw
    for source, parser in parsers.items():
        out = f"_parsed_{source}"
        df = parser(df, wanted & (F.col("source") == source), out)
        outs.append(out)
    parsed = F.coalesce(*outs, _unhandled())
    apart = [name for name in (f"{out}_fields" for out in outs) if name in df.columns]
    df = compute_once(df, parsed=F.when(wanted, parsed)).drop(*outs)
    return df.withColumn("fields", F.coalesce(F.col("parsed")["fields"], *apart)).drop(*apart)


@built_once
def _unhandled() -> Column:
    return parse_failure(F.format_string(S.UNHANDLED_SOURCE + ': "%s"', or_empty(F.col("source"))))


@built_once
def _raw_errors() -> Column:
    return V.raw_errors(F.col("source"), F.col("payload"), F.col("received_at"))


@built_once
def _outcome(max_frames: int, carried: tuple[str, ...]) -> tuple[Column, Column, Column, list]:
    """Validation findings, failed step, template and the columns of the result of ``normalize``."""
    parsed = F.col("parsed")
    readable = or_empty(parsed["error"]) == ""
    event_errors = F.when(
        parsed.isNotNull() & readable,
        V.event_errors(
            F.col("source"), parsed["service"], parsed["message"], parsed["timestamp"]
        ),
    ).otherwise(F.array().cast(S.FIELD_ERRORS))
    raw_bad, event_bad = V.has_errors(F.col("_raw_errors")), V.has_errors(F.col("_event_errors"))
    step = F.when(raw_bad, "raw").when(~readable, "parse").when(event_bad, "event").otherwise("")
    template = G.error_template(
        parsed["severity"],
        parsed["service"],
        parsed["message"],
        parsed["stack_frames"],
        max_frames,
    )
    template = F.when(F.col("failed_step") == "", template).otherwise("")
    result = [
        event_id(F.col("stream_id"), F.col("seq_no")).alias("event_id"),
        "source",
        F.coalesce(parsed["severity"], F.lit(0)).alias("severity"),
        severity_name(F.coalesce(parsed["severity"], F.lit(0))).alias("severity_name"),
        parsed["timestamp"].alias("timestamp"),
        or_empty(parsed["service"]).alias("service"),
        or_empty(parsed["host"]).alias("host"),
        or_empty(parsed["message"]).alias("message"),
        F.coalesce(parsed["stack_frames"], F.array().cast("array<string>")).alias("stack_frames"),
        "fields",
        G.signature(F.col("template")).alias("signature"),
        "template",
        F.octet_length("payload").alias("raw_size"),
        "stream_id",
        "seq_no",
        "received_at",
        "payload",
        *carried,
        "failed_step",
        F.when(raw_bad, F.col("_raw_errors")).otherwise(F.col("_event_errors")).alias("errors"),
        F.when(raw_bad, V.error_text(F.col("_raw_errors")))
        .when(~readable, parsed["error"])
        .otherwise(V.error_text(F.col("_event_errors")))
        .alias("reason"),
    ]
    return event_errors, step, template, result


def normalize(
    raw: DataFrame, parsers=None, max_frames: int = G.DEFAULT_MAX_FRAMES
) -> DataFrame:
    """Raw event table (``RAW_EVENT``) to one row per raw event with its outcome.

    Validation, parsing, id, validation of the result and the signature, in this order; a row
    stops at its first failed step. ``failed_step`` is '' for accepted rows and names the step
    otherwise, ``reason`` says why, ``errors`` lists the validation findings. The raw columns
    stay on the row so that a reject can be written as dead letter.
    """
    df = compute_once(raw, _raw_errors=_raw_errors())
    df = parse(df, parsers, rows=~V.has_errors(F.col("_raw_errors")))
    carried = tuple(name for name in ("attempt_count",) if name in raw.columns)
    event_errors, step, template, result = _outcome(max_frames, carried)
    df = compute_once(df, _event_errors=event_errors).withColumn("failed_step", step)
    return compute_once(df, template=template).select(*result)


def accepted(normalized: DataFrame) -> DataFrame:
    """The normalized events, without the columns that only matter to rejects."""
    return normalized.filter(F.col("failed_step") == "").drop(
        "payload", "failed_step", "errors", "reason"
    )


def rejected(normalized: DataFrame) -> DataFrame:
    """Raw events that failed a step, with the reason."""
    carried = [name for name in ("attempt_count",) if name in normalized.columns]
    return normalized.filter(F.col("failed_step") != "").select(
        "source", "payload", "stream_id", "received_at", "seq_no", *carried, "failed_step", "errors", "reason"
    )


def error_events(normalized: DataFrame) -> DataFrame:
    """Accepted events severe enough for error correlation."""
    return accepted(normalized).filter(is_error_level(F.col("severity")))
