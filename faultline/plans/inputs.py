"""Log inputs derived from the given tables, for Spark and as SQL for the checks.

Texts are built by SQL that both engines understand; ``SPARK`` and ``DUCK`` hold the few
expressions they spell differently.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import spread

SPARK = {
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
    "epoch_ms": "unix_millis(cast(ts as timestamp))",
    "epoch_s": "unix_seconds(cast(ts as timestamp))",
    "escaped_newline": "char(92) || 'n'",
    "syslog_time": "date_format(ts, 'MMM') || ' ' || lpad(cast(day(ts) as string), 2, ' ')"
    " || date_format(ts, ' HH:mm:ss')",
    "bad_time": "date_format(ts, 'MMM d HH:mm:ss')",
}
DUCK = {
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
    "epoch_ms": "(epoch_us(ts) // 1000)",
    "epoch_s": "(epoch_us(ts) // 1000000)",
    "escaped_newline": "chr(92) || 'n'",
    "syslog_time": "strftime(ts, '%b') || ' ' || lpad(cast(day(ts) as varchar), 2, ' ')"
    " || strftime(ts, ' %H:%M:%S')",
    "bad_time": "strftime(ts, '%b %-d %H:%M:%S')",
}

LEVEL = (
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'fatal'"
    " WHEN 'click' THEN 'warn' WHEN 'view' THEN 'info' ELSE 'debug' END"
)
MESSAGE = (
    "event_type || ' failed after ' || event_id || ' ms at 10.0.0.' || (user_id % 250)"
    " || ':5432 for ''u' || user_id || ''''"
)
# Like MESSAGE, with a phrase that the diagnosis rules know.
INCIDENT = (
    "CASE event_id % 6 WHEN 0 THEN 'panic: Nil Pointer access ' WHEN 1 THEN 'dial tcp timeout '"
    " WHEN 2 THEN 'cannot allocate buffer ' WHEN 3 THEN 'no room left ' ELSE '' END || "
    + MESSAGE
)


def json_payload(words: dict, message: str = MESSAGE) -> str:
    """JSON log line; ``event_id % 10`` selects one of the shapes the parser must handle."""
    service = "'\"service\":\"svc-' || (user_id % 5) || '\",'"
    level = f"'\"level\":\"' || {LEVEL} || '\",'"
    text = f"'\"msg\":\"' || {message} || '\",'"
    time = f"'\"time\":\"' || {words['iso']} || '\",'"
    rest = (
        "'\"host\":\"host-' || (user_id % 7) || '\",\"ctx\":' || props || ',\"try\":'"
        " || (event_id % 4) || ',\"ratio\":1.50,\"ok\":true,\"none\":null}'"
    )
    string_stack = (
        "'\"stack\":\"main.load:app.go:' || event_id || "
        f"{words['escaped_newline']} || '  main.run +0x' || event_id || '\",'"
    )
    array_stack = "'\"trace\":[\"app.py:' || event_id || '\",7,\" core.py:12 \",\"\"],'"
    return (
        "CASE event_id % 10 WHEN 9 THEN ''"
        f" WHEN 1 THEN '{{' || {level} || {text} || {time} || {rest}"
        f" WHEN 2 THEN '{{' || {service} || '\"Level\":\"' || {LEVEL} || '\",\"err_msg\":\"'"
        f" || {message} || '\",' || {time} || {rest}"
        f" WHEN 3 THEN '{{' || {service} || {level} || {text} || '\"time\":'"
        f" || {words['epoch_ms']} || ',' || {rest}"
        f" WHEN 4 THEN '{{' || {service} || {level} || {text} || '\"time\":'"
        f" || {words['epoch_s']} || ',' || {rest}"
        f" WHEN 5 THEN '{{' || {service} || {level} || {text} || {time} || {string_stack} || {rest}"
        f" WHEN 6 THEN '{{' || {service} || {level} || {text} || {time} || {array_stack} || {rest}"
        f" WHEN 7 THEN '{{' || {service} || {level} || '\"msg\":\"cut'"
        f" WHEN 8 THEN '{{' || {service} || {level} || '\"msg\":' || event_id || ',' || {time} || {rest}"
        f" ELSE '{{' || {service} || {level} || {text} || {time} || {rest} END"
    )


def syslog_payload(words: dict) -> str:
    """Syslog line; ``event_id % 8`` selects the variant: no priority, no pid, bad time."""
    pri = "'<' || (8 * (user_id % 24) + event_id % 8) || '>'"
    tag = "' host-' || (user_id % 7) || ' svc-' || (user_id % 5)"
    pid = "'[' || event_id || ']'"
    return (
        f"CASE event_id % 8 WHEN 5 THEN {words['syslog_time']} || {tag} || {pid} || ': ' || {MESSAGE}"
        f" WHEN 6 THEN {pri} || {words['syslog_time']} || {tag} || ': ' || {MESSAGE}"
        f" WHEN 7 THEN {pri} || {words['bad_time']} || {tag} || {pid} || ': ' || {MESSAGE}"
        f" ELSE {pri} || {words['syslog_time']} || {tag} || {pid} || ': ' || {MESSAGE} END"
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _raw(spark: SparkSession, folder: str, source: str, payload: str) -> DataFrame:
    # Spread: parsing takes far longer than reading, and a small file is a single task.
    return spread(table(spark, folder, "events")).select(
        F.expr(source).alias("source"),
        F.expr(payload).alias("payload"),
        F.expr("'user-' || user_id").alias("stream_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        (F.col("event_id") + 1).alias("seq_no"),
    )


def _raw_sql(source: str, payload: str) -> str:
    return (
        f"SELECT {source} AS source, {payload} AS payload, 'user-' || user_id AS stream_id,"
        " ts AS received_at, event_id + 1 AS seq_no FROM events"
    )


def json_raw(spark: SparkSession, folder: str, message: str = MESSAGE) -> DataFrame:
    return _raw(spark, folder, "'json'", json_payload(SPARK, message))


def syslog_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder, "'syslog'", syslog_payload(SPARK))


JSON_RAW = _raw_sql("'json'", json_payload(DUCK))
INCIDENT_RAW = _raw_sql("'json'", json_payload(DUCK, INCIDENT))
SYSLOG_RAW = _raw_sql("'syslog'", syslog_payload(DUCK))

# Text lines of the documents, turned into stack traces: some lines become continuations, some
# blank. ``line`` and its place ``n`` (from 0) are the inputs.
_REWRITTEN = (
    "CASE WHEN {n} % 7 IN (1, 2) THEN {tab} || {line} WHEN {n} % 7 = 3 THEN ''"
    " WHEN {n} % 7 = 5 THEN '    ' || {line} WHEN {n} % 11 = 0 THEN 'at ' || {line}"
    " ELSE {line} END"
)


def trace_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as line rows, one stream per document."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
        .select(
            F.lit("stacktrace").alias("source"),
            F.expr("'doc-' || doc_id").alias("stream_id"),
            F.col("n").cast("bigint").alias("line_no"),
            F.expr(_REWRITTEN.format(n="n", line="raw", tab="char(9)")).alias("line"),
            F.expr("timestamp '2024-02-01 00:00:00'").alias("received_at"),
        )
    )


def trace_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same streams with one whole text per row."""
    rewritten = _REWRITTEN.format(n="i", line="x", tab="char(9)")
    return table(spark, folder, "documents").select(
        F.lit("stacktrace").alias("source"),
        F.expr("'doc-' || doc_id").alias("stream_id"),
        F.expr(
            f"array_join(transform(split(text, '\\n', -1), (x, i) -> {rewritten}), '\\n')"
        ).alias("text"),
        F.expr("timestamp '2024-02-01 00:00:00'").alias("received_at"),
    )


TRACE_LINES = (
    "SELECT stream_id, line_no, "
    + _REWRITTEN.format(n="line_no", line="raw", tab="chr(9)")
    + " AS line FROM (SELECT 'doc-' || doc_id AS stream_id,"
    " unnest(string_split(text, chr(10))) AS raw,"
    " generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
)


def signature_events(spark: SparkSession, folder: str, signature: str) -> DataFrame:
    """Events with a ready-made signature expression."""
    return table(spark, folder, "events").select(
        F.expr(signature).alias("signature"),
        F.expr("'user-' || user_id").alias("stream_id"),
        (F.col("event_id") + 1).alias("seq_no"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


def signature_events_sql(signature: str) -> str:
    return (
        f"SELECT {signature} AS signature, 'user-' || user_id AS stream_id,"
        " event_id + 1 AS seq_no, epoch_us(ts) AS t FROM events"
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Short log messages and whole documents."""
    short = table(spark, folder, "events").select(
        F.expr("'e-' || event_id").alias("id"),
        F.expr("'svc-' || (user_id % 5)").alias("service"),
        F.expr(MESSAGE).alias("message"),
    )
    long = table(spark, folder, "documents").select(
        F.expr("'d-' || doc_id").alias("id"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
    )
    return short.unionByName(long)


MESSAGES = (
    "SELECT 'e-' || event_id AS id, 'svc-' || (user_id % 5) AS service,"
    f" {MESSAGE} AS message FROM events UNION ALL"
    " SELECT 'd-' || doc_id, source, text FROM documents"
)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as numbered stream records with skipped and swapped numbers."""
    return table(spark, folder, "conversations").select(
        F.expr("'conv-' || conv_id").alias("stream_id"),
        F.expr("turn + turn div 3").alias("seq_no"),
        F.expr(f"timestamp_seconds({_TURN_SECOND})").alias("received_at"),
    )


# Every fourth turn arrives after the next two.
_TURN_SECOND = "1704067200 + 2 * turn + CASE WHEN turn % 4 = 1 THEN 5 ELSE 0 END"
TURNS = (
    "SELECT 'conv-' || conv_id AS stream_id, turn + turn // 3 AS seq_no,"
    f" {_TURN_SECOND} AS t FROM conversations"
)
