"""RFC 3164 syslog lines to the parsed event struct."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import text as X
from faultline.functions.compute import built_once
from faultline.functions.parsed import fallback_service, parse_failure
from faultline.functions.timestamps import syslog_time

STAMP_LENGTH = 15

# Severity name per syslog level 0 to 7.
LEVEL_NAMES = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")


def syslog_severity(level: Column) -> Column:
    """Syslog level to severity; anything outside 0 to 7 is unknown."""
    scale = F.array(*[F.lit(S.SEVERITIES.index(name)) for name in LEVEL_NAMES])
    return F.when(level.between(0, 7), F.get(scale, level.cast("int"))).otherwise(0).cast("int")


def priority(line: Column) -> Column:
    """The signed number in the leading ``<...>``; null when there is none."""
    return F.nullif(F.regexp_extract(line, r"^<([+-]?[0-9]+)>", 1), F.lit("")).try_cast("bigint")


def tag_name(tag: Column) -> Column:
    return F.substring_index(tag, "[", 1)


def tag_pid(tag: Column) -> Column:
    """Text in the first brackets of ``name[pid]``; '' when they are missing or open."""
    return F.regexp_extract(tag, r"^[^\[]*\[([^\]]*)\]", 1)


@built_once
def _steps(rows: str, out: str) -> list[dict[str, Column]]:
    """The columns of ``parse_syslog``, step by step."""
    received_at = F.col("received_at")
    fallback = fallback_service(F.col("stream_id"))
    pri, header, tag = F.col("_pri"), F.col("_header"), F.col("_tag")
    stamp = F.substring("_rest", 1, STAMP_LENGTH)
    long_enough = F.octet_length("_rest") >= STAMP_LENGTH
    whole_stamp = (F.length(stamp) == STAMP_LENGTH) & long_enough
    rest = F.when(
        F.col("_time").isNotNull(),
        X.strip(F.expr(f"substring(_rest, {STAMP_LENGTH + 1})")),
    ).otherwise(F.col("_rest"))
    colon = F.locate(":", F.col("_rest"))
    first_tag = F.when(F.size(header) >= 2, F.get(header, F.lit(1))).otherwise(F.get(header, F.lit(0)))
    message = F.when(colon > 0, X.strip(F.col("_rest").substr(colon + 1, F.length("_rest"))))
    pri_fields = F.create_map(
        F.lit("syslog_facility"),
        F.expr("_pri div 8").cast("string"),
        F.lit("syslog_pri"),
        pri.cast("string"),
    )
    pid_field = F.create_map(F.lit("pid"), tag_pid(tag))
    event = F.struct(
        syslog_severity(pri % 8).alias("severity"),
        F.coalesce(F.col("_time"), received_at).alias("timestamp"),
        F.coalesce(F.nullif(X.or_empty(tag_name(tag)), F.lit("")), fallback).alias("service"),
        F.when(F.size(header) >= 2, F.get(header, F.lit(0))).otherwise("").alias("host"),
        F.coalesce(message, F.col("_rest")).alias("message"),
        F.array().alias("stack_frames"),
        F.when(tag.isNull(), pri_fields)
        .otherwise(F.map_concat(pri_fields, pid_field))
        .alias("fields"),
        F.lit("").alias("error"),
    ).cast(S.PARSED)
    whole_line = F.struct(
        F.lit(S.SEVERITIES.index("info")).alias("severity"),
        received_at.alias("timestamp"),
        fallback.alias("service"),
        F.lit("").alias("host"),
        F.col("_line").alias("message"),
        F.array().alias("stack_frames"),
        F.create_map().alias("fields"),
        F.lit("").alias("error"),
    ).cast(S.PARSED)
    parsed = (
        F.when(X.or_empty(F.col("payload")) == "", parse_failure(F.lit(S.EMPTY_PAYLOAD)))
        .when(pri.isNull(), whole_line)
        .otherwise(event)
    )
    return [
        {"_line": F.when(F.col(rows), X.strip(F.col("payload")))},
        {"_pri": priority(F.col("_line")), "_rest": X.strip(F.regexp_replace("_line", r"^<[+-]?[0-9]+>", ""))},
        {"_time": F.when(whole_stamp, syslog_time(stamp, received_at))},
        {"_rest": rest},
        {"_header": F.when(colon > 0, X.words(F.substring_index("_rest", ":", 1)))},
        {"_tag": first_tag},
        {out: F.when(F.col(rows), parsed)},
    ]


def parse_syslog(df: DataFrame, rows: Column, out: str) -> DataFrame:
    """Add ``out`` (struct ``PARSED``) for the rows where ``rows`` holds, null elsewhere.

    A line without a usable priority is kept whole as an info message.
    """
    flag = f"{out}_rows"
    df = df.withColumn(flag, rows)
    for step in _steps(flag, out):
        df = df.withColumns(step)
    return df.drop(flag, "_line", "_pri", "_rest", "_time", "_header", "_tag")
