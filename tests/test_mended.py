"""Null keys and times, odd answers, retries, long lines and counters: nothing is lost."""

import datetime
import random

from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import deadletter as D
from faultline.operators import dedup as U
from faultline.operators import diagnose as P
from faultline.operators import framing as R
from faultline.operators import metrics as M
from faultline.operators import normalize as N
from faultline.operators.slices import sliced_by_position
from faultline.sources import text as text_files
from faultline.session import materialize
from faultline.streaming import ingest

AT = datetime.datetime(2024, 3, 5, 12, 0, 0)
RAW = "source string, payload string, stream_id string, received_at timestamp, seq_no bigint"


def test_gaps_do_not_depend_on_size(spark):
    rows = [(None, AT, 1), (None, AT + datetime.timedelta(seconds=1), 5), ("a", AT, 1), ("a", AT, 2)]
    events = spark.createDataFrame(rows, "stream_id string, received_at timestamp, seq_no bigint")
    found = [sorted(map(tuple, M.sequence_gaps(events, hot).collect())) for hot in (100, 0)]
    assert found[0] == found[1]
    assert [(r[0], r[4]) for r in found[0]] == [("", 3)]


def test_events_without_time_are_novel(spark):
    rows = [("s", None, 1), ("s", AT, 2), ("s", AT, 3), ("t", None, 4)]
    events = spark.createDataFrame(rows, "signature string, received_at timestamp, seq_no bigint")
    events = events.withColumn("stream_id", F.lit("x"))
    for hot in (100, 1):
        got = {r.seq_no: (r.is_novel, r.window_count) for r in U.dedup(events, hot_rows=hot).collect()}
        assert got == {1: (True, 1), 2: (True, 1), 3: (False, 2), 4: (True, 1)}


def test_lines_without_stream_or_source_are_kept(spark):
    rows = [("json", None, 0, "a"), ("json", None, 1, "b"), (None, "s", 0, "c")]
    lines = spark.createDataFrame(rows, "source string, stream_id string, line_no bigint, line string")
    got = R.frame(lines.withColumn("received_at", F.lit(AT))).collect()
    assert sorted((r.source, r.stream_id, r.seq_no, r.payload) for r in got) == [
        ("", "s", 1, "c"), ("json", "", 1, "a"), ("json", "", 2, "b"),
    ]


def test_a_long_line_does_not_split_its_block(spark):
    text = "t\n\tat a\n" + "x" * 5000 + "\n\tat b\nend"
    streams = spark.createDataFrame([("stacktrace", "s", text)], "source string, stream_id string, text string")
    streams = streams.withColumn("received_at", F.lit(AT))
    lines = streams.select("source", "stream_id", "received_at", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    for framed in (R.frame_text(streams, max_line_bytes=4096), R.frame(lines, 4096)):
        assert [r.payload for r in framed.orderBy("seq_no").collect()] == ["t\n\tat a\n\tat b", "end"]
    letters = R.long_lines(lines, 4096).collect()
    assert [(r.stream_id, r.seq_no, r.reason) for r in letters] == [("s", -3, S.LINE_TOO_LONG)]
    files = lines.withColumn("_slice", F.lit(0))
    assert R.number_file_lines(files, 4096).count() == 4 and R.long_file_lines(files, 4096).count() == 1


def test_left_out_lines_have_ids_that_no_record_has(spark, tmp_path):
    """Records and letters together are all lines with text, and no two of them share an id, in every form of framing."""
    long = "x" * 5000
    texts = {"a": f"a\n\n{long}\nb\n\r\nc\n{long}1", "b": "\n\none\ntwo", "c": long}
    streams = spark.createDataFrame([("json", k, v) for k, v in texts.items()], "source string, stream_id string, text string").withColumn("received_at", F.lit(AT))
    lines = streams.select("source", "stream_id", "received_at", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = text_files.read_lines(spark, str(tmp_path), "json")
    for framed, left in (
        (R.frame_text(streams, max_line_bytes=4096), R.long_lines_of_text(streams, max_line_bytes=4096)),
        (R.frame(lines, 4096), R.long_lines(lines, 4096)),
        (R.number_file_lines(files, 4096), R.long_file_lines(files, 4096)),
        (R.frame_text(streams, "text", 4096, True), R.long_lines_of_text(streams, "text", 4096, True)),
        (R.frame(lines, 4096, True), R.long_lines(lines, 4096, True)),
    ):
        rows = [*framed.select("stream_id", "seq_no", "payload").collect(), *left.select("stream_id", "seq_no", "payload").collect()]
        assert len({(r.stream_id, r.seq_no) for r in rows}) == len(rows) == 8
        wanted = sorted(x for t in texts.values() for x in t.replace("\r", "").split("\n") if x)
        assert sorted(r.payload for r in rows) == wanted
        assert len({r.event_id for r in D.dead_letters(left, attempts=1).collect()}) == left.count()
    reasons = {(r.stream_id, r.seq_no): r.reason for r in left.collect()}
    assert reasons == {("a", -3): S.LINE_TOO_LONG, ("a", -4): S.STREAM_STOPPED, ("a", -6): S.STREAM_STOPPED, ("a", -7): S.LINE_TOO_LONG, ("c", -1): S.LINE_TOO_LONG}


def trace_lines(spark, count=400, seed=5):
    rng = random.Random(seed)
    kinds = ["error x", "\tat a", "", "    more", "plain", "at b", "\r", None, " at c"]
    rows = [
        ("stacktrace", stream, n, rng.choices(kinds, [3, 6, 1, 3, 1, 2, 1, 1, 2])[0])
        for stream in ("s", "t") for n in range(count)
    ]
    lines = spark.createDataFrame(rows, "source string, stream_id string, line_no bigint, line string")
    return lines.withColumn("received_at", F.lit(AT))


def test_blocks_do_not_depend_on_slices(spark):
    lines = trace_lines(spark)
    one, *others = (
        sorted(
            (r.stream_id, r.seq_no, r.payload)
            for r in R.frame_blocks(sliced_by_position(lines, "line_no", rows)).collect()
        )
        for rows in (1000, 1, 3, 17)
    )
    assert one and all(other == one for other in others)
    dense = lines.fillna("", ["line"])
    framed = sorted((r.stream_id, r.seq_no, r.payload) for r in R.frame_blocks(dense).collect())
    in_order = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    texts = dense.groupBy("source", "stream_id", "received_at").agg(
        F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("text")
    )
    assert framed == sorted((r.stream_id, r.seq_no, r.payload) for r in R.frame_text(texts).collect())


def test_blocks_read_their_input_twice(spark, tmp_path):
    trace_lines(spark).write.parquet(str(tmp_path / "lines"))
    framed = R.frame_blocks(spark.read.parquet(str(tmp_path / "lines")))
    plan = framed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and plan.count("Exchange ") <= 5


def test_answers(spark):
    asked = spark.createDataFrame([(k, "sig") for k in "abcde"], "event_id string, signature string")
    answers = [
        ("a", 200, '{"ROOT_CAUSE": "x", "Severity": "error"}'), ("b", 200, '{"confidence_score": NaN}'),
        ("c", 200, '{"event_id": 7}'), ("d", 503, "busy"), ("d", 200, '{"root_cause": "y"}'), (None, 200, "{}"),
    ]
    got = P.responses(asked, spark.createDataFrame(answers, "event_id string, status int, body string")).collect()
    assert len(got) == 5
    got = {r.event_id: (r.root_cause, r.failure) for r in got}
    assert got["a"] == ("x", "") and got["d"] == ("y", "")
    assert got["b"][1] == got["c"][1] == S.INVALID_RESPONSE and got["e"][1] == S.PROVIDER_FAILED


def test_short_syslog_stamps_are_no_times(spark):
    rows = [("syslog", "<13>Oct 1 22:14:15", "s", AT, 1), ("syslog", "<13>Oct  1 22:14:15 h t: m", "s", AT, 2)]
    got = {r.seq_no: r for r in N.normalize(spark.createDataFrame(rows, RAW)).collect()}
    assert (got[1].host, got[1].service, got[1].message) == ("Oct", "1", "14:15")
    assert got[2].message == "m" and got[2].timestamp.month == 10


def test_retries_end(spark):
    raw = spark.createDataFrame([("json", "{", "s", AT, 1)], RAW)
    attempts = []
    for _ in range(3):
        letters = materialize(D.dead_letters(N.rejected(N.normalize(raw))))
        plan = D.retry_plan(letters).collect()
        attempts.append((plan[0].attempt_count, plan[0].eligible, plan[0].delay_cap_ms))
        raw = D.replay(letters)
    assert attempts == [(1, True, 100.0), (2, True, 200.0), (3, False, 400.0)]
    fixed = letters.withColumn("failed_at", F.lit(AT))
    first, second = (D.retry_plan(x, max_attempts=9).first().next_attempt_at for x in (fixed, fixed.repartition(5)))
    assert first == second


def test_counters_of_many_batches(spark, tmp_path):
    folder, count = str(tmp_path / "counts"), 120
    rows = spark.range(count).selectExpr("id AS batch", "3L AS ingested", "2L AS parsed", "1L AS errors")
    rows.coalesce(1).write.partitionBy("batch").parquet(folder)
    assert ingest.counted_totals(spark, folder) == {"ingested": 360, "parsed": 240, "errors": 120}


def test_ingest_writes_counters(spark, tmp_path):
    raw = spark.createDataFrame([("json", '{"message": "m"}', "s", AT, 1), ("json", "{", "s", AT, 2)], RAW)
    raw.write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    paths = [str(tmp_path / x) for x in ("events", "letters", "counts")]
    for _ in range(2):
        ingest.run_ingest(stream, paths[0], paths[1], counters=paths[2])
    assert ingest.counted_totals(spark, paths[2]) == {"ingested": 2, "parsed": 1, "errors": 1}
