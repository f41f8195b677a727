"""Dead letters, diagnosis and reports on small rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import validate as V
from faultline.operators import deadletter as D
from faultline.operators import diagnose as P
from faultline.operators import metrics as M
from faultline.sources import jsonl

AT = datetime(2024, 5, 6, 7, 8, 9, 123456)


def letters(spark):
    rows = [("json", '{"a":<&>', "st", AT, 42), ("syslog", "<bad", "", AT, 100)]
    raw = spark.createDataFrame(rows, S.RAW_EVENT)
    return D.dead_letters(raw, F.lit("why \"quoted\""), attempts=2, failed_at=F.col("received_at"))


def test_dead_letters_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "a" / "b")
    written = sorted(letters(spark).collect())
    jsonl.write_json_lines(letters(spark), path)
    assert sorted(jsonl.read_dead_letters(spark, path).collect()) == written
    assert [row.event_id for row in written] == ["evt-100", "st-42"]
    jsonl.write_json_lines(letters(spark), path)
    assert jsonl.read_dead_letters(spark, path).count() == 4
    raw = D.replay(jsonl.read_dead_letters(spark, path)).first()
    assert set(raw.asDict()) == {*S.RAW_EVENT.names, "attempt_count"}
    assert raw.attempt_count == 2


def test_retry_plan(spark):
    data = letters(spark).withColumn("attempt_count", F.explode(F.array(*map(F.lit, [-1, 0, 2, 3, 90]))))
    plan = D.retry_plan(data, base_ms=100, max_ms=5000).filter("stream_id = 'st'").collect()
    got = {r.attempt_count: (r.eligible, r.delay_cap_ms) for r in plan}
    assert got == {
        -1: (True, 100.0), 0: (True, 100.0), 2: (True, 200.0), 3: (False, 400.0), 90: (False, 5000.0),
    }
    for row in plan:
        if row.eligible:
            wait = row.next_attempt_at - row.failed_at
            assert timedelta(0) <= wait <= timedelta(milliseconds=row.delay_cap_ms)
    never = D.retry_plan(data, retryable=F.lit(False))
    assert never.filter("eligible").count() == 0


def test_validation_helpers(spark):
    row = spark.range(1).select(
        V.raw_errors(F.lit("csv"), F.lit(""), F.lit(None).cast("timestamp")).alias("e")
    )
    text, has, missing = row.select(
        V.error_text(F.col("e")), V.has_error(F.col("e"), S.UNKNOWN_SOURCE),
        V.has_error(F.col("e"), S.MISSING_MESSAGE),
    ).first()
    assert text == (
        "domain: validation failed: payload: domain: empty raw payload; source: domain: unknown"
        " source type; received_at: domain: invalid or zero timestamp"
    )
    assert has and not missing


EVENT = (
    "event_id string, service string, host string, severity int, timestamp timestamp,"
    " message string, signature string, stack_frames array<string>, fields map<string,string>,"
    " dedup_count bigint"
)


def event(spark, message="lost", **changes):
    row = {
        "event_id": "e-1", "service": "pay", "host": "h1", "severity": 4, "timestamp": AT,
        "message": message, "signature": "abc", "stack_frames": ["m.a:1", "m.b:2"],
        "fields": {"z": "1", "env": "prod"}, "dedup_count": 7,
    } | changes
    return spark.createDataFrame([tuple(row.values())], EVENT)


def test_prompt(spark):
    text = event(spark).select(P.prompt(300)).first()[0]
    for part in (
        "Service: pay\nHost: h1\nSeverity: error\nTimestamp: 2024-05-06T07:08:09Z\nEvent ID: e-1\n",
        "Signature Hash: abc\nOccurrence Frequency: 7 times in the last 5m0s\n\n",
        "=== ERROR MESSAGE ===\nlost\n\n",
        "[1] m.a:1\n[2] m.b:2\n\n",
        "- env: prod\n- z: 1\n\n",
    ):
        assert part in text
    bare = event(spark, host="", signature="", stack_frames=[], fields={}).select(P.prompt(0)).first()[0]
    assert "in the last 5m0s" in bare
    for part in ("Host", "Signature Hash", "STACK", "METADATA"):
        assert part not in bare


@pytest.mark.parametrize(
    ("seconds", "text"),
    [(300, "5m0s"), (3600, "1h0m0s"), (1.5, "1.5s"), (90, "1m30s"), (0.25, "250ms"), (0, "0s")],
)
def test_durations(seconds, text):
    assert P.duration_text(int(seconds * 1_000_000)) == text


@pytest.mark.parametrize(
    ("message", "severity", "component"),
    [
        ("a NIL Pointer", "fatal", "pay"),
        ("dial tcp: timeout after dereference", "fatal", "pay"),
        ("connection refused", "error", "database-pool"),
        ("no room left", "fatal", "k8s-pod-memory"),
        ("odd", "error", "pay"),
    ],
)
def test_rules(spark, message, severity, component):
    row = P.diagnose(event(spark, message)).first()
    assert (row.severity, row.affected_component, row.failure) == (severity, component, "")
    assert row.fix_commands and row.confidence_score is None and row.tokens_used is None
    text = P.diagnosis_texts(P.diagnose(event(spark, message))).first().text
    assert text == row.root_cause + "\nFixes: " + "; ".join(row.fix_commands)


def test_own_rules_and_missing_event(spark):
    rule = P.Rule(("odd",), "seen {message}", "warn", "disk", ("fix {service}",))
    row = P.diagnose(event(spark, "odd thing"), rules=(rule,)).first()
    assert (row.root_cause, row.severity, row.fix_commands) == ("seen odd thing", "warn", ["fix pay"])
    assert P.diagnose(event(spark, event_id=None)).first().failure == S.NIL_REQUEST


def test_rules_of_a_table(spark):
    columns = "priority int, phrases array<string>, root_cause string, severity string, component string, commands array<string>"
    rows = [
        (None, ["thing"], "last", "warn", "", ["x"]), (2, ["ODD", None], "second", None, None, None),
        (1, ["other"], "first", "warn", "", ["x"]), (0, None, "never", "warn", "", ["x"]),
    ]
    table = spark.createDataFrame(rows, columns)
    row = P.diagnose(event(spark, "odd thing"), table).first()
    assert (row.root_cause, row.severity, row.affected_component, row.fix_commands) == ("second", "error", "pay", [])
    row = P.diagnose(event(spark, "odd thing"), table.limit(0)).first()
    assert row.root_cause.startswith("Unhandled") and row == P.diagnose(event(spark, "odd thing"), ()).first()


def test_responses(spark):
    asked = spark.createDataFrame([(str(i), f"s{i}") for i in range(7)], "event_id string, signature string")
    bodies = [
        (200, '{"event_id":"x","root_cause":"c","fix_commands":["a"],"confidence_score":1,"tokens_used":3}'),
        (500, "down"), (200, "{"), (200, '{"severity":1}'), (200, "null"), (200, '{"tokens_used":1.5}'),
    ]
    answers = spark.createDataFrame(
        [(str(i), status, body) for i, (status, body) in enumerate(bodies)],
        "event_id string, status int, body string",
    )
    rows = {r.event_id: r for r in P.responses(asked, answers).collect()}
    assert (rows["0"].signature, rows["0"].root_cause, rows["0"].fix_commands) == ("s0", "c", ["a"])
    assert (rows["0"].confidence_score, rows["0"].tokens_used, rows["0"].failure) == (1.0, 3, "")
    assert rows["1"].failure == S.PROVIDER_FAILED + ": http status 500: down"
    assert [rows[k].failure for k in "235"] == [S.INVALID_RESPONSE] * 3
    assert (rows["4"].failure, rows["4"].root_cause) == ("", "")
    assert rows["6"].failure == S.PROVIDER_FAILED


@pytest.mark.parametrize("hot_rows", [1000, 0])
def test_sequence_gaps(spark, hot_rows):
    order = [1, 2, 5, 4, 6, 7]
    rows = [("a", n, AT + timedelta(seconds=i)) for i, n in enumerate(order)]
    rows += [("b", n, AT) for n in (3, 4, 5)]
    data = spark.createDataFrame(rows, "stream_id string, seq_no bigint, received_at timestamp")
    got = sorted((r.seq_no, r.missing, r.reordered) for r in M.sequence_gaps(data, hot_rows).collect())
    assert got == [(4, 0, True), (5, 2, False), (6, 1, False)]
