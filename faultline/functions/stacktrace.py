"""Multi-line stack traces to the parsed event struct."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import text as X
from faultline.functions.compute import built_once
from faultline.functions.parsed import fallback_service, parse_failure

# Words in the first line that make a trace fatal.
FATAL_WORDS = ("panic", "fatal", "critical")


@built_once
def _steps(rows: str, out: str) -> list[dict[str, Column]]:
    """The columns of ``parse_stacktrace``, step by step."""
    clean = F.filter(
        F.transform(X.lines(F.col("payload")), X.chomp), lambda line: line != ""
    )
    kept = F.col("_lines")
    message = F.get(kept, F.lit(0))
    lowered = F.lower(message)
    fatal = F.lit(False)
    for word in FATAL_WORDS:
        fatal = fatal | F.contains(lowered, F.lit(word))
    severity = F.when(fatal, S.SEVERITIES.index("fatal")).otherwise(S.ERROR_LEVEL)
    event = F.struct(
        severity.alias("severity"),
        F.col("received_at").alias("timestamp"),
        fallback_service(F.col("stream_id")).alias("service"),
        F.lit("").alias("host"),
        message.alias("message"),
        F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))).alias("stack_frames"),
        F.create_map().alias("fields"),
        F.lit("").alias("error"),
    ).cast(S.PARSED)
    parsed = (
        F.when(X.or_empty(F.col("payload")) == "", parse_failure(F.lit(S.EMPTY_PAYLOAD)))
        .when(F.size(kept) == 0, parse_failure(F.lit(S.EMPTY_STACK_TRACE)))
        .otherwise(event)
    )
    return [{"_lines": F.when(F.col(rows), clean)}, {out: F.when(F.col(rows), parsed)}]


def parse_stacktrace(df: DataFrame, rows: Column, out: str) -> DataFrame:
    """Add ``out`` (struct ``PARSED``): first line is the message, the others are frames."""
    flag = f"{out}_rows"
    df = df.withColumn(flag, rows)
    for step in _steps(flag, out):
        df = df.withColumns(step)
    return df.drop(flag, "_lines")
