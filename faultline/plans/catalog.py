"""One query per operator, each over the whole tables of a folder."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import severity as L
from faultline.functions import signature as G
from faultline.functions import text as X
from faultline.functions import validate as V
from faultline.functions.event_id import event_id
from faultline.operators import deadletter as D
from faultline.operators import dedup as U
from faultline.operators import diagnose as P
from faultline.operators import framing as R
from faultline.operators import metrics as M
from faultline.operators import normalize as N
from faultline.plans import inputs as I
from faultline.session import materialize, new_folder, spread
from faultline.sources import jsonl, text as files
from faultline.streaming import answers, counters
from faultline.streaming import dedup as stream_dedup
from faultline.streaming import frames as stream_frames
from faultline.streaming import ingest as stream_ingest

HOUR = 3600
LINE_BYTES = 6000
# Documents in one dropped trace file.
TRACES_PER_FILE = 200
# Small enough that the spread path serves every signature of the test tables.
SPREAD_ALL = 500
AS_OF = "timestamp '2024-01-15 00:00:00'"


def micros(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def joined(column: Column | str, by: str = "|") -> Column:
    return F.array_join(column, by)


# Sources, framing, sinks


def frame_lines_of_text(spark: SparkSession, folder: str) -> DataFrame:
    streams = I.trace_texts(spark, folder).withColumn("source", F.lit("json"))
    return R.frame_text(streams).select("stream_id", "seq_no", "payload")


def frame_lines_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = I.trace_lines(spark, folder).withColumn("source", F.lit("json"))
    return R.frame_lines(lines).select("stream_id", "seq_no", "payload")


def frame_blocks_of_text(spark: SparkSession, folder: str) -> DataFrame:
    return R.frame_text(I.trace_texts(spark, folder)).select("stream_id", "seq_no", "payload")


def frame_blocks_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    return R.frame_blocks(I.trace_lines(spark, folder)).select("stream_id", "seq_no", "payload")


def frame_by_source(spark: SparkSession, folder: str) -> DataFrame:
    lines = I.trace_lines(spark, folder).withColumn(
        "source",
        F.when(F.endswith("stream_id", F.lit("7")), "stacktrace").otherwise("syslog"),
    )
    return R.frame(lines).select("source", "stream_id", "seq_no", "payload")


def _language_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as single lines; a few streams hold everything."""
    return I.table(spark, folder, "documents").select(
        F.lit("json").alias("source"),
        F.concat_ws("/", "lang", "source").alias("stream_id"),
        F.col("doc_id").alias("line_no"),
        F.translate("text", "\n", " ").alias("line"),
        F.lit(None).cast("timestamp").alias("received_at"),
    )


def long_lines_stop(spark: SparkSession, folder: str) -> DataFrame:
    lines = _language_lines(spark, folder)
    framed = R.frame_lines(lines, max_line_bytes=LINE_BYTES, stop_at_long_line=True)
    return framed.select("stream_id", "seq_no", "payload")


def long_lines_left_out(spark: SparkSession, folder: str) -> DataFrame:
    lines = _language_lines(spark, folder)
    framed = R.frame_lines(lines, max_line_bytes=LINE_BYTES, stop_at_long_line=False)
    return framed.select("stream_id", "seq_no", "payload")


def long_lines_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    texts = I.trace_texts(spark, folder)
    found = R.long_lines_of_text(texts, max_line_bytes=LINE_BYTES)
    return D.dead_letters(found, attempts=1).select(
        "event_id", "reason", F.octet_length("raw_payload").alias("bytes")
    )


def _letter_rows(found: DataFrame) -> DataFrame:
    return D.dead_letters(found, attempts=1).select(
        "event_id", "stream_id", "seq_no", "reason", F.octet_length("raw_payload").alias("bytes")
    )


def long_line_letters_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _letter_rows(R.long_lines(_language_lines(spark, folder), LINE_BYTES))


def long_line_letters_of_stop(spark: SparkSession, folder: str) -> DataFrame:
    """All that ``long_lines_stop`` leaves out: the long line and what follows it."""
    return _letter_rows(R.long_lines(_language_lines(spark, folder), LINE_BYTES, stop_at_long_line=True))


def long_line_letters_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """The language streams as one file each, read in place."""
    path = new_folder(spark, "log-files")
    lines = _language_lines(spark, folder).withColumn("log", F.regexp_replace("stream_id", "[^a-z0-9]", "-"))
    ordered = lines.repartition("log").sortWithinPartitions("log", "line_no")
    ordered.select("log", "line").write.partitionBy("log").text(path)
    found = R.long_file_lines(files.read_lines(spark, path, "json"), LINE_BYTES)
    named = found.withColumn("stream_id", F.regexp_extract("stream_id", "log=([^/]*)", 1))
    return _letter_rows(named)


def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as log files and read back in place."""
    path = new_folder(spark, "log-files")
    I.table(spark, folder, "documents").select("text").write.text(path)
    framed = R.number_file_lines(files.read_lines(spark, path, "json"))
    per_file = framed.groupBy("stream_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("seq_no").alias("d"),
        F.max("seq_no").alias("last"),
        F.sum(F.octet_length("payload")).alias("bytes"),
    )
    return per_file.agg(
        F.sum("n").alias("records"),
        F.sum("d").alias("numbers"),
        F.sum("last").alias("last_numbers"),
        F.sum("bytes").alias("bytes"),
    )


def event_ids(spark: SparkSession, folder: str) -> DataFrame:
    stream = F.expr("CASE WHEN user_id % 9 = 0 THEN '' ELSE 'user-' || user_id END")
    return I.table(spark, folder, "events").select(
        F.col("event_id").alias("row"), event_id(stream, F.col("event_id") + 1).alias("id")
    )


def _json_events(spark: SparkSession, folder: str, message: str = I.MESSAGE) -> DataFrame:
    return N.normalize(I.json_raw(spark, folder, message))


def _dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    rejected = N.rejected(_json_events(spark, folder))
    return D.dead_letters(
        rejected,
        attempts=((F.col("seq_no") - 1) % 5).cast("int"),
        failed_at=F.col("received_at"),
    )


def _letter_columns(letters: DataFrame) -> DataFrame:
    return letters.select(
        *[name for name in letters.columns if name != "failed_at"],
        micros("failed_at").alias("failed_at"),
    )


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return _letter_columns(_dead_letters(spark, folder))


def dead_letter_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "dead-letters")
    jsonl.write_json_lines(_dead_letters(spark, folder), path)
    return _letter_columns(jsonl.read_dead_letters(spark, path))


def dead_letter_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Replayed letters fail again for the same reason."""
    again = N.normalize(D.replay(_dead_letters(spark, folder)))
    return again.groupBy("failed_step", "reason").agg(F.count("*").alias("events"))


def retry_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = D.retry_plan(
        _dead_letters(spark, folder),
        retryable=F.col("reason") != S.INVALID_JSON,
    )
    wait = micros("next_attempt_at") - micros("failed_at")
    return plan.select(
        "event_id",
        "attempt_count",
        "eligible",
        F.col("delay_cap_ms").cast("bigint").alias("delay_cap_ms"),
        F.coalesce((wait >= 0) & (wait <= F.col("delay_cap_ms") * 1000), F.lit(False)).alias(
            "within_cap"
        ),
    )


# Validation


def _questionable(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events where every invariant is broken by some rows."""
    return I.table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("seq_no"),
        F.expr("CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'stacktrace'"
               " WHEN 3 THEN 'csv' ELSE '' END").alias("source"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '' ELSE props END").alias("payload"),
        F.expr("CASE WHEN event_id % 7 <> 0 THEN cast(ts as timestamp) END").alias("received_at"),
        F.expr("CASE WHEN user_id % 4 = 0 THEN '' ELSE event_type END").alias("service"),
        F.expr("CASE WHEN user_id % 6 = 0 THEN '' ELSE props END").alias("message"),
    )


def raw_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _questionable(spark, folder)
    errors = V.raw_errors(F.col("source"), F.col("payload"), F.col("received_at"))
    return rows.withColumn("errors", errors).select(
        "seq_no", F.size("errors").alias("findings"), V.error_text(F.col("errors")).alias("text")
    )


def event_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _questionable(spark, folder)
    errors = V.event_errors(
        F.col("source"), F.col("service"), F.col("message"), F.col("received_at")
    )
    return rows.withColumn("errors", errors).select(
        "seq_no", F.size("errors").alias("findings"), V.error_text(F.col("errors")).alias("text")
    )


def error_membership(spark: SparkSession, folder: str) -> DataFrame:
    rows = _questionable(spark, folder)
    errors = V.raw_errors(F.col("source"), F.col("payload"), F.col("received_at"))
    return rows.withColumn("errors", errors).select(
        "seq_no",
        V.has_error(F.col("errors"), S.UNKNOWN_SOURCE).alias("unknown_source"),
        V.has_error(F.col("errors"), S.INVALID_TIMESTAMP).alias("invalid_timestamp"),
        V.has_errors(F.col("errors")).alias("invalid"),
    )


def source_check(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _questionable(spark, folder)
        .groupBy("source")
        .agg(F.count("*").alias("events"))
        .withColumn("valid", V.source_valid(F.col("source")))
    )


def accepted_and_rejected(spark: SparkSession, folder: str) -> DataFrame:
    events = _json_events(spark, folder)
    return (
        N.accepted(events)
        .groupBy(F.lit("").alias("failed_step"))
        .agg(F.count("*").alias("events"))
        .unionByName(
            N.rejected(events).groupBy("failed_step").agg(F.count("*").alias("events"))
        )
    )


def severity_compare(spark: SparkSession, folder: str) -> DataFrame:
    severity = L.parse_severity(F.expr(I.LEVEL))
    return I.table(spark, folder, "events").select(
        "event_id",
        severity.alias("severity"),
        L.severity_name(severity).alias("name"),
        L.at_least(severity, F.lit(3)).alias("at_least_warn"),
        L.is_error_level(severity).alias("error_level"),
    )


SEVERITY_WORDS = (
    "debug", "trace", "info", "notice", "informational", "warn", "warning", "error", "err",
    "fatal", "panic", "critical", "crit", "emerg", "alert", "verbose", "",
)


def severity_words(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*map(F.lit, SEVERITY_WORDS))
    word = F.get(words, (F.col("event_id") % len(SEVERITY_WORDS)).cast("int"))
    return (
        I.table(spark, folder, "events")
        .groupBy(word.alias("word"))
        .agg(F.count("*").alias("events"))
        .withColumn("severity", L.parse_severity(F.col("word")))
        .withColumn("name", L.severity_name(F.col("severity")))
    )


# Parsing


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "severity",
        micros("timestamp").alias("timestamp"),
        "service",
        "host",
        "message",
        "raw_size",
    )


def json_events(spark: SparkSession, folder: str) -> DataFrame:
    return _event_columns(N.accepted(_json_events(spark, folder)))


def json_frames(spark: SparkSession, folder: str) -> DataFrame:
    events = N.accepted(_json_events(spark, folder)).filter(F.size("stack_frames") > 0)
    return events.select(
        "event_id",
        F.size("stack_frames").alias("n_frames"),
        joined("stack_frames").alias("frames"),
    )


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    events = N.accepted(_json_events(spark, folder))
    return events.select("event_id", X.text_map(F.col("fields")).alias("fields"))


def json_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return N.rejected(_json_events(spark, folder)).select(
        "stream_id", "seq_no", "failed_step", "reason"
    )


def syslog_events(spark: SparkSession, folder: str) -> DataFrame:
    return _event_columns(N.accepted(N.normalize(I.syslog_raw(spark, folder))))


def syslog_fields(spark: SparkSession, folder: str) -> DataFrame:
    events = N.accepted(N.normalize(I.syslog_raw(spark, folder)))
    return events.select("event_id", X.text_map(F.col("fields")).alias("fields"))


def stacktrace_events(spark: SparkSession, folder: str) -> DataFrame:
    events = N.accepted(N.normalize(R.frame_text(I.trace_texts(spark, folder))))
    return events.select(
        "event_id",
        "severity",
        "service",
        "message",
        F.size("stack_frames").alias("n_frames"),
        joined("stack_frames").alias("frames"),
        "raw_size",
    )


def _mixed_raw(spark: SparkSession, folder: str) -> DataFrame:
    traces = R.frame_text(I.trace_texts(spark, folder))
    return (
        I.json_raw(spark, folder).unionByName(I.syslog_raw(spark, folder)).unionByName(traces)
    )


def routed_events(spark: SparkSession, folder: str) -> DataFrame:
    """All three sources through one scan of their union."""
    return (
        N.normalize(_mixed_raw(spark, folder))
        .groupBy("source", "failed_step", "severity_name")
        .agg(
            F.count("*").alias("events"),
            F.sum("raw_size").alias("bytes"),
            F.count_if(F.col("signature") != "").alias("signed"),
        )
    )


# Signatures


def message_templates(spark: SparkSession, folder: str) -> DataFrame:
    return I.messages(spark, folder).select(
        "id", G.normalize_message(F.col("message")).alias("template")
    )


FRAME_SHAPES = (
    "'main.load:app.go:' || event_id",
    "'  main.run(0xc000' || event_id || ', 0x1) +0x' || event_id || ' '",
    "'app/core.go:12 +0x' || (event_id % 16)",
    "'at com.app.Core.run(Core.java:' || event_id || ')'",
    "'plain.frame'",
)


def _frames() -> Column:
    return F.array(*map(F.expr, FRAME_SHAPES))


def frame_templates(spark: SparkSession, folder: str) -> DataFrame:
    return (
        I.table(spark, folder, "events")
        .select("event_id", F.posexplode(_frames()).alias("place", "frame"))
        .select("event_id", "place", G.normalize_frame(F.col("frame")).alias("template"))
    )


def message_signatures(spark: SparkSession, folder: str) -> DataFrame:
    template = G.template(
        F.col("service"), F.col("message"), F.array().cast("array<string>")
    )
    return I.messages(spark, folder).select("id", G.signature(template).alias("signature"))


def signature_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures with all, two and the default number of frames."""
    service, message = F.expr("'svc-' || (user_id % 5)"), F.expr(I.MESSAGE)
    frames = F.concat(_frames(), F.array(F.concat(F.lit("tail."), F.col("event_type"))))

    def at(depth: int) -> Column:
        return G.signature(G.template(service, message, frames, depth))

    return I.table(spark, folder, "events").select(
        "event_id", at(6).alias("all_frames"), at(2).alias("two_frames"), at(0).alias("default")
    )


def empty_signature(spark: SparkSession, folder: str) -> DataFrame:
    """No signature without service and message."""
    service = F.expr("CASE WHEN event_id % 3 = 0 THEN '' ELSE 'svc' END")
    message = F.expr("CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END")
    template = G.template(service, message, F.array().cast("array<string>"))
    return I.table(spark, folder, "events").select(
        "event_id", G.signature(template).alias("signature")
    )


def error_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return N.accepted(_json_events(spark, folder)).select("event_id", "signature", "template")


# Deduplication

BY_USER = "event_type || '-' || user_id"
BY_TYPE = "event_type"
SOME_UNSIGNED = "CASE WHEN user_id % 10 = 0 THEN '' ELSE event_type || '-' || user_id END"


def _deduped(spark, folder, signature=BY_USER, seconds=6 * HOUR, **options) -> DataFrame:
    return U.dedup(I.signature_events(spark, folder, signature), seconds, **options)


def _dedup_columns(deduped: DataFrame) -> DataFrame:
    return deduped.select(
        "signature", "stream_id", "seq_no", micros("window_start").alias("window_start"),
        "is_novel", "window_count",
    )


def dedup_events(spark: SparkSession, folder: str) -> DataFrame:
    return _dedup_columns(_deduped(spark, folder))


def dedup_few_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return _dedup_columns(_deduped(spark, folder, BY_TYPE, HOUR))


def dedup_hot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return _dedup_columns(_deduped(spark, folder, BY_TYPE, HOUR, hot_rows=SPREAD_ALL))


def dedup_default_window(spark: SparkSession, folder: str) -> DataFrame:
    return _dedup_columns(_deduped(spark, folder, BY_TYPE, 0))


def dedup_unsigned(spark: SparkSession, folder: str) -> DataFrame:
    return _dedup_columns(_deduped(spark, folder, SOME_UNSIGNED))


def novel_events(spark: SparkSession, folder: str) -> DataFrame:
    return U.novel(_deduped(spark, folder)).select("signature", "stream_id", "seq_no")


def _record_columns(records: DataFrame) -> DataFrame:
    return records.select(
        "signature",
        micros("first_seen").alias("first_seen"),
        micros("last_seen").alias("last_seen"),
        "count",
    )


def window_records(spark: SparkSession, folder: str) -> DataFrame:
    return _record_columns(U.window_records(_deduped(spark, folder)))


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    return _record_columns(U.current_records(_deduped(spark, folder)))


def tracked_records(spark: SparkSession, folder: str) -> DataFrame:
    return _record_columns(
        U.tracked_records(_deduped(spark, folder), F.expr(AS_OF), 6 * HOUR)
    )


def tracked_count(spark: SparkSession, folder: str) -> DataFrame:
    return U.tracked_count(_deduped(spark, folder), F.expr(AS_OF), 6 * HOUR)


# Metrics


def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    return M.stats(N.normalize(_mixed_raw(spark, folder)), "source")


def ingest_totals(spark: SparkSession, folder: str) -> DataFrame:
    return M.stats(_json_events(spark, folder))


def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    found = M.sequence_gaps(I.turns(spark, folder))
    return found.select("stream_id", "previous_seq", "seq_no", "missing", "reordered")


def sequence_gaps_hot_stream(spark: SparkSession, folder: str) -> DataFrame:
    found = M.sequence_gaps(I.turns(spark, folder), hot_rows=0)
    return found.select("stream_id", "previous_seq", "seq_no", "missing", "reordered")


def missing_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return M.missing_ranges(I.turns(spark, folder))


def missing_ranges_hot_stream(spark: SparkSession, folder: str) -> DataFrame:
    return M.missing_ranges(I.turns(spark, folder), hot_rows=0)


def sequence_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.sequence_summary(I.turns(spark, folder))


def ingestion_lag(spark: SparkSession, folder: str) -> DataFrame:
    events = N.accepted(_json_events(spark, folder)).withColumn(
        "received_at", F.col("received_at") + F.expr("make_dt_interval(0, 0, 0, seq_no % 90)")
    )
    return M.ingestion_lag(materialize(events.select("service", "received_at", "timestamp")))


def throughput(spark: SparkSession, folder: str) -> DataFrame:
    return M.throughput(N.accepted(_json_events(spark, folder))).select(
        micros("bucket_start").alias("bucket_start"), "stream_id", "events", "bytes"
    )


def _catalogue_columns(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        "signature", "template", "events",
        micros("first_seen").alias("first_seen"), micros("last_seen").alias("last_seen"),
    )


def template_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return _catalogue_columns(M.template_catalogue(N.accepted(_json_events(spark, folder))))


def top_templates(spark: SparkSession, folder: str) -> DataFrame:
    return _catalogue_columns(M.top_templates(N.accepted(_json_events(spark, folder)), 10))


# Diagnosis


def _incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Novel error events with the count of their window."""
    errors = materialize(N.error_events(_json_events(spark, folder, I.INCIDENT)))
    return U.incidents(U.dedup(errors, HOUR))


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    return _incidents(spark, folder).select(
        "event_id", "signature", "service", "dedup_count", micros("timestamp").alias("timestamp")
    )


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _incidents(spark, folder).select("event_id", P.prompt(HOUR).alias("prompt"))


def diagnosis_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request file written and read back."""
    path = new_folder(spark, "requests")
    jsonl.write_json_lines(P.requests(_incidents(spark, folder), HOUR), path)
    stored = jsonl.read_json_lines(spark, path, "event_id string, signature string, body string")
    body = F.from_json(
        "body",
        "model string, messages array<struct<role:string,content:string>>, temperature double",
    )
    return stored.select("event_id", "signature", body.alias("b")).select(
        "event_id",
        "signature",
        F.col("b.model").alias("model"),
        F.size("b.messages").alias("messages"),
        F.col("b.messages")[0]["role"].alias("role"),
        F.col("b.messages")[0]["content"].alias("content"),
        (F.col("b.temperature") * 10).cast("int").alias("temperature_tenths"),
    )


def _diagnosis_columns(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.select(
        "event_id",
        "signature",
        "root_cause",
        "severity",
        "affected_component",
        joined("fix_commands").alias("fix_commands"),
        F.round(F.col("confidence_score") * 100).cast("int").alias("confidence_percent"),
        "tokens_used",
        "failure",
    )


def rule_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnosis_columns(P.diagnose(_incidents(spark, folder)))


def diagnosis_texts(spark: SparkSession, folder: str) -> DataFrame:
    return P.diagnosis_texts(P.diagnose(_incidents(spark, folder)))


def table_rule_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """Rules taken from a table: one for each nation, for messages with its key or name."""
    nation = F.lower("n_name")
    by_nation = spark.read.parquet(f"{folder}/nation.parquet").select(
        (F.lit(100) - F.col("n_nationkey")).alias("priority"),
        F.array(nation, F.concat(F.lit("AFTER "), F.col("n_nationkey"))).alias("phrases"),
        F.concat(F.lit("trouble in "), nation).alias("root_cause"),
        F.lit("warn").alias("severity"),
        F.lit(None).cast("string").alias("component"),
        F.array(F.concat(F.lit("page {service} of "), nation)).alias("commands"),
    )
    return _diagnosis_columns(P.diagnose(materialize(_incidents(spark, folder)), by_nation))


def many_rule_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """One rule for each order: messages with its key or from the address of its customer."""
    by_order = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.expr("o_orderkey % 1009").alias("priority"),
        F.expr("array('AFTER ' || o_orderkey || ' MS', ' at 10.0.0.' || (o_custkey % 997) || ':')").alias("phrases"),
        F.expr("'order ' || o_orderkey || ' of {service}: {message}'").alias("root_cause"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'warn' END").alias("severity"),
        F.lit("orders").alias("component"),
        F.expr("array('hold ' || o_orderkey, null)").alias("commands"),
    )
    return _diagnosis_columns(P.diagnose(materialize(_incidents(spark, folder)), by_order))


def missing_events(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that lost their event."""
    lost = N.error_events(_json_events(spark, folder, I.INCIDENT)).withColumn(
        "event_id", F.when(F.col("seq_no") % 4 != 0, F.col("event_id"))
    )
    found = P.diagnose(lost)
    return found.groupBy("failure").agg(
        F.count("*").alias("requests"), F.count("root_cause").alias("diagnoses")
    )


# Answers to requests, by sequence number: usable, unusable and failed ones, and none at all.
ANSWER_STATUS = "CASE WHEN seq_no % 8 = 1 THEN 503 ELSE 200 END"
ANSWER_BODY = (
    "CASE seq_no % 8 WHEN 1 THEN 'busy' WHEN 2 THEN '{{\"root_cause\": \"cut'"
    " WHEN 3 THEN '{{\"root_cause\": 7}}'"
    " ELSE '{{\"event_id\": \"other\", \"root_cause\": \"cause ' || {id} || '\", \"severity\":"
    " \"error\", \"affected_component\": \"db\", \"fix_commands\": [\"restart ' || seq_no ||"
    " '\", \"check\"], \"confidence_score\": 0.5, \"tokens_used\": ' || seq_no || '}}' END"
)


def diagnosis_responses(spark: SparkSession, folder: str) -> DataFrame:
    asked = materialize(N.error_events(_json_events(spark, folder, I.INCIDENT)))
    told = asked.select(
        F.expr("CASE WHEN seq_no % 8 <> 0 THEN event_id END").alias("event_id"),
        F.expr(ANSWER_STATUS).alias("status"),
        F.expr(ANSWER_BODY.format(id="event_id")).alias("body"),
    )
    return _diagnosis_columns(P.responses(asked.select("event_id", "signature"), told))


def error_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON log lines to novel error incidents per service and signature."""
    errors = materialize(
        N.error_events(_json_events(spark, folder)).select(
            "service", "signature", "template", "stream_id", "seq_no", "received_at"
        )
    )
    deduped = U.dedup(errors, HOUR)
    return deduped.groupBy("service", "signature", "template").agg(
        F.count_if("is_novel").alias("incidents"),
        F.count("*").alias("events"),
        F.max("window_count").alias("largest_window"),
        micros(F.min("received_at")).alias("first_seen"),
        micros(F.max("received_at")).alias("last_seen"),
    )


# Streams, run until the input is used up


_SIGNED = "signature string, stream_id string, seq_no bigint, received_at timestamp"


def _arriving(spark: SparkSession, folder: str, signature: str, files_at_once: int = 1, parts: int = 4) -> DataFrame:
    """Signature events as a stream of ``parts`` files with the events in no order.

    A last file holds one event without signature, a year later, which moves the clock of the stream past all others.
    """
    path = new_folder(spark, "signature-events")
    events = I.signature_events(spark, folder, signature)
    shuffled = events.withColumn("part", F.pmod(F.xxhash64("seq_no"), F.lit(parts)).cast("int"))
    shuffled.repartition(parts, "part").write.partitionBy("part").parquet(f"{path}/events")
    last = events.agg((F.max("received_at") + F.expr("interval 365 days")).alias("received_at"))
    last = last.select(F.lit("").alias("signature"), F.lit("clock").alias("stream_id"), F.lit(0).cast("bigint").alias("seq_no"), "received_at")
    last.coalesce(1).write.parquet(f"{path}/events/part={parts}")
    return (
        spark.readStream.schema(_SIGNED)
        .option("maxFilesPerTrigger", files_at_once)
        .option("recursiveFileLookup", "true")
        .parquet(f"{path}/events")
        .select(*[name.split()[0] for name in _SIGNED.split(", ")])
    )


def stream_dedup_events(spark: SparkSession, folder: str) -> DataFrame:
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    events = (
        spark.readStream.schema(columns)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
        .select(
            F.expr(BY_USER).alias("signature"),
            F.expr("'user-' || user_id").alias("stream_id"),
            (F.col("event_id") + 1).alias("seq_no"),
            F.col("ts").cast("timestamp").alias("received_at"),
        )
    )
    deduped = stream_dedup.dedup_stream(events, 6 * HOUR)
    stored = stream_ingest.run_to_table(deduped, new_folder(spark, "stream-dedup"))
    return _dedup_columns(stored)


def stream_dedup_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Events in no order over several batches; held back by the clock of the stream, they give the windows of the batch form."""
    events = _arriving(spark, folder, BY_USER)
    deduped = stream_dedup.dedup_stream(events, 6 * HOUR, lateness_seconds=40 * 24 * HOUR, ordered=True)
    stored = stream_ingest.run_to_table(deduped, new_folder(spark, "stream-ordered"))
    return _dedup_columns(stored.filter("stream_id <> 'clock'"))


def _stream_state(spark: SparkSession, folder: str) -> DataFrame:
    """The records in the state of a stream over all signature events, read from its progress folder."""
    path = new_folder(spark, "stream-state")
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    events = spark.readStream.schema(columns).option("pathGlobFilter", "events.parquet").parquet(folder)
    signed = events.select(
        F.expr(BY_USER).alias("signature"), F.expr("'user-' || user_id").alias("stream_id"),
        (F.col("event_id") + 1).alias("seq_no"), F.col("ts").cast("timestamp").alias("received_at"),
    )
    stream_ingest.run_to_table(stream_dedup.dedup_stream(signed, 6 * HOUR), path)
    return stream_dedup.stream_records(spark, path + "-progress")


def stream_current_records(spark: SparkSession, folder: str) -> DataFrame:
    return _record_columns(_stream_state(spark, folder))


def stream_tracked_count(spark: SparkSession, folder: str) -> DataFrame:
    """Records less than one window old at the last event of all."""
    last = I.signature_events(spark, folder, BY_USER).agg(F.max("received_at")).first()[0]
    return stream_dedup.stream_tracked_count(_stream_state(spark, folder), F.lit(last), 6 * HOUR)


def stream_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and answers arriving as files, answers up to six minutes later; those after four minutes come too late.

    A last request and a last answer, a year later, move both clocks past all others; the request waits at the end.
    """
    path = new_folder(spark, "responses")
    asked = materialize(N.error_events(_json_events(spark, folder, I.INCIDENT)))
    sent = asked.select("event_id", "signature", F.col("received_at").alias("sent_at"))
    told = asked.select(
        F.expr("CASE WHEN seq_no % 8 <> 0 THEN event_id END").alias("event_id"),
        F.expr(ANSWER_STATUS).alias("status"),
        F.expr(ANSWER_BODY.format(id="event_id")).alias("body"),
        (F.col("received_at") + F.expr("make_dt_interval(0, 0, seq_no % 7, 0)")).alias("answered_at"),
    )
    last = asked.agg((F.max("received_at") + F.expr("interval 365 days")).alias("at"))
    for name, rows, end in (
        ("sent", sent, last.select(F.lit("clock").alias("event_id"), F.lit("").alias("signature"), F.col("at").alias("sent_at"))),
        ("told", told, last.select(F.lit("clock").alias("event_id"), F.lit(500).alias("status"), F.lit("").alias("body"), F.col("at").alias("answered_at"))),
    ):
        rows.repartition(2).write.parquet(f"{path}/{name}/1")
        end.coalesce(1).write.parquet(f"{path}/{name}/2")

    def arriving(name: str, rows: DataFrame) -> DataFrame:
        reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return reader.parquet(f"{path}/{name}")

    found = answers.match_answers(arriving("sent", sent), arriving("told", told), 240, lateness_seconds=40 * 24 * HOUR)
    stored = stream_ingest.run_to_table(found, new_folder(spark, "stream-responses"))
    return _diagnosis_columns(stored)


def stream_stats(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines arriving as five files, one a batch; a listener writes the counters of every batch."""
    path, rows = new_folder(spark, "json-raw"), new_folder(spark, "counters")
    I.json_raw(spark, folder).repartition(5, "seq_no").write.parquet(path)
    raw = spark.readStream.schema(S.RAW_EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    listener = counters.BatchCounters(spark, rows)
    spark.streams.addListener(listener)
    try:
        # A file is one batch, and more than one task can parse it.
        passed = counters.observed(N.normalize(spread(raw))).filter("failed_step = ''").select("event_id")
        query = stream_ingest.start_to_table(passed, new_folder(spark, "stream-stats"))
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return counters.totals(counters.batch_counters(spark, rows))


def stream_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Trace files dropped into a folder, framed, parsed and signed as a stream.

    A blank line follows every document, so that it does not matter which share a file. The files are small: each is one row
    to ``stream_files``.
    """
    path = new_folder(spark, "trace-files")
    texts = I.trace_texts(spark, folder).select(F.concat("text", F.lit("\n")))
    texts.write.option("maxRecordsPerFile", TRACES_PER_FILE).text(path)
    arriving = files.stream_files(
        spark, path, "stacktrace", F.expr("timestamp '2024-02-01 00:00:00'")
    )
    events = N.accepted(N.normalize(R.frame_text(arriving)))
    signed = events.select("source", "severity", "raw_size", "stack_frames", "message")
    stored = stream_ingest.run_to_table(signed, new_folder(spark, "stream-traces"))
    return stored.groupBy("source", "severity").agg(
        F.count("*").alias("events"),
        F.sum("raw_size").alias("bytes"),
        F.sum(F.size("stack_frames")).alias("frames"),
    )


def stream_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines arriving as files: rejects go to the dead letters."""
    path = new_folder(spark, "json-raw")
    I.json_raw(spark, folder).write.parquet(path)
    raw = spark.readStream.schema(S.RAW_EVENT).parquet(path)
    table, letters = new_folder(spark, "events"), new_folder(spark, "letters")
    stream_ingest.run_ingest(raw, table, letters, failed_at=F.col("received_at"))
    stored = jsonl.read_dead_letters(spark, letters)
    return stored.groupBy("source", "reason").agg(
        F.count("*").alias("letters"), F.max("seq_no").alias("last_seq")
    )


def _over_files(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Documents as files of three log streams, a hundred documents a file, framed in two runs of one query."""
    path, records = new_folder(spark, "log-files"), new_folder(spark, "records")
    lines = I.trace_lines(spark, folder).select(
        "line", "line_no", F.expr("CAST(substring(stream_id, 5) AS BIGINT)").alias("doc")
    )
    half = (lines.agg(F.max("doc")).first()[0] or 0) // 200
    placed = lines.withColumns({"log": F.expr("doc % 3"), "chunk": F.expr("lpad(doc div 100, 9, '0')")})
    for part in (F.expr("doc div 100") <= half, F.expr("doc div 100") > half):
        ordered = placed.filter(part).repartition("log", "chunk").sortWithinPartitions("log", "chunk", "doc", "line_no")
        ordered.select("log", "chunk", "line").write.mode("append").partitionBy("log", "chunk").text(path)
        stream = F.concat(F.lit("log-"), F.regexp_extract("_metadata.file_path", "log=([0-9]+)", 1))
        framed = stream_frames.frame_stream(stream_frames.stream_lines(spark, path, source, stream))
        stored = stream_ingest.run_to_table(framed, records)
    columns = ["stream_id", "seq_no", "payload"]
    waiting = stream_frames.open_blocks(spark, records + "-progress")
    return stored.filter("reason = ''").select(columns).union(waiting.select(columns))


def stream_lines_over_files(spark: SparkSession, folder: str) -> DataFrame:
    return _over_files(spark, folder, "json")


def stream_blocks_over_files(spark: SparkSession, folder: str) -> DataFrame:
    return _over_files(spark, folder, "stacktrace")


QUERIES = {
    query.__name__: query
    for query in (
        error_incidents,
        frame_lines_of_text,
        frame_lines_of_rows,
        frame_blocks_of_text,
        frame_blocks_of_rows,
        frame_by_source,
        long_lines_stop,
        long_lines_left_out,
        long_lines_dead_letters,
        long_line_letters_of_rows,
        long_line_letters_of_stop,
        long_line_letters_of_files,
        file_lines,
        event_ids,
        dead_letters,
        dead_letter_round_trip,
        dead_letter_replay,
        retry_plan,
        raw_validation,
        event_validation,
        error_membership,
        source_check,
        accepted_and_rejected,
        severity_compare,
        severity_words,
        json_events,
        json_frames,
        json_fields,
        json_rejects,
        syslog_events,
        syslog_fields,
        stacktrace_events,
        routed_events,
        message_templates,
        frame_templates,
        message_signatures,
        signature_depth,
        empty_signature,
        error_signatures,
        dedup_events,
        dedup_few_signatures,
        dedup_hot_signatures,
        dedup_default_window,
        dedup_unsigned,
        novel_events,
        window_records,
        current_records,
        tracked_records,
        tracked_count,
        ingest_stats,
        ingest_totals,
        sequence_gaps,
        sequence_gaps_hot_stream,
        missing_ranges,
        missing_ranges_hot_stream,
        sequence_summary,
        ingestion_lag,
        throughput,
        template_catalogue,
        top_templates,
        incidents,
        prompts,
        diagnosis_requests,
        diagnosis_responses,
        rule_diagnosis,
        diagnosis_texts,
        table_rule_diagnosis,
        many_rule_diagnosis,
        missing_events,
        stream_dedup_events,
        stream_dedup_ordered,
        stream_current_records,
        stream_tracked_count,
        stream_stats,
        stream_responses,
        stream_traces,
        stream_dead_letters,
        stream_lines_over_files,
        stream_blocks_over_files,
    )
}
