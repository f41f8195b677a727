from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import normalize as N

AT = datetime(2023, 3, 5, 6, 7, 8)


def normalized(spark, source, payloads, stream="st"):
    rows = [(source, p, stream, AT, i) for i, p in enumerate(payloads)]
    found = N.normalize(spark.createDataFrame(rows, S.RAW_EVENT)).collect()
    return sorted(found, key=lambda row: row.seq_no)


def one(spark, source, payload, stream="st"):
    return normalized(spark, source, [payload], stream)[0]


def test_json_aliases_and_fields(spark):
    row = one(
        spark,
        "json",
        '{"APP":"api","Lvl":"CRIT","err_msg":"down","server":"h1","n":1.50,"e":2e5,"z":null,'
        '"o":{"a":[1, 2]},"t":true,"level":3}',
    )
    assert (row.service, row.severity_name, row.message, row.host) == ("api", "fatal", "down", "h1")
    assert row.fields == {"n": "1.50", "e": "2e5", "z": "<nil>", "o": '{"a":[1,2]}', "t": "true"}
    assert row.raw_size == len(row.payload) and row.event_id == "st-0" and len(row.signature) == 32


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ('"2024-05-06T07:08:09.5+02:00"', datetime(2024, 5, 6, 5, 8, 9, 500000)),
        ('"2024-05-06T07:08:09Z"', datetime(2024, 5, 6, 7, 8, 9)),
        ('"2024-05-06 07:08:09"', datetime(2024, 5, 6, 7, 8, 9)),
        ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000250", datetime(2023, 11, 14, 22, 13, 20, 250000)),
        ("1700000000.25", datetime(2023, 11, 14, 22, 13, 20, 250000)),
        ('"2024-02-30T00:00:00Z"', AT),
        ('"soon"', AT),
        ("true", AT),
        ("null", AT),
    ],
)
def test_json_times(spark, value, expected):
    assert one(spark, "json", f'{{"msg":"m","@timestamp":{value}}}').timestamp == expected


def test_json_stacks(spark):
    rows = normalized(
        spark,
        "json",
        [
            r'{"msg":"m","stack":" a \n\n b"}',
            '{"msg":"m","Exception":["x ",1,null,"  ","y"]}',
            r'{"msg":"m","trace":"2","stack":"1"}',
            '{"msg":"m","stack":5}',
        ],
    )
    assert [row.stack_frames for row in rows] == [["a", "b"], ["x", "y"], ["1", "2"], []]


@pytest.mark.parametrize(
    ("payload", "step", "reason"),
    [
        ("", "raw", "domain: validation failed: payload: domain: empty raw payload"),
        ('{"msg":', "parse", S.INVALID_JSON),
        ("[1]", "parse", S.INVALID_JSON),
        ("{'msg':1}", "parse", S.INVALID_JSON),
        ("null", "event", "domain: validation failed: message: domain: missing message body"),
        ('{"msg":7}', "event", "domain: validation failed: message: domain: missing message body"),
        ('{"msg":"a"} trailing', "", ""),
        ('{"msg":"a","msg":"b"}', "", ""),
    ],
)
def test_json_outcomes(spark, payload, step, reason):
    row = one(spark, "json", payload)
    assert (row.failed_step, row.reason) == (step, reason)
    if "b" in payload:
        assert row.message in ("a", "b") and (row.message == "b") == ('"b"' in payload)


def test_json_service_defaults(spark):
    assert one(spark, "json", '{"msg":"m"}').service == "st"
    assert one(spark, "json", '{"msg":"m"}', "").service == "unknown-service"


def test_syslog(spark):
    rows = normalized(
        spark,
        "syslog",
        [
            "<34>Oct 11 22:14:15 box su[77]: failed: twice",
            "<165>Mar  1 01:02:03 tagonly: m",
            "no priority here",
            "<999>x: y",
            "<-9>a b c: d",
            "<13>Feb 29 01:02:03 h t[: m",
            "<13>Oct 1 22:14:15 h t: m",
            "<abc>x",
            "<13>",
        ],
    )
    got = [(r.severity_name, r.service, r.host, r.message, r.timestamp) for r in rows]
    assert got[0] == ("fatal", "su", "box", "failed: twice", datetime(2023, 10, 11, 22, 14, 15))
    assert rows[0].fields == {"syslog_facility": "4", "syslog_pri": "34", "pid": "77"}
    assert got[1] == ("info", "tagonly", "", "m", datetime(2023, 3, 1, 1, 2, 3))
    assert got[2] == ("info", "st", "", "no priority here", AT) and rows[2].fields == {}
    assert got[3] == ("debug", "x", "", "y", AT)
    assert got[4] == ("unknown", "b", "a", "d", AT)
    assert got[5] == ("info", "t", "h", "m", datetime(2023, 3, 1, 1, 2, 3))
    assert got[6] == ("info", "1", "Oct", "14:15 h t: m", AT)
    assert got[7] == ("info", "st", "", "<abc>x", AT)
    assert rows[8].failed_step == "event"


def test_stack_trace(spark):
    row = one(spark, "stacktrace", "PANIC: boom\r\n\tmain.a()\n\n  main.b()\r\n", "")
    assert (row.message, row.severity_name, row.service) == ("PANIC: boom", "fatal", "app")
    assert row.stack_frames == ["\tmain.a()", "  main.b()"]
    assert one(spark, "stacktrace", "\n\r\n").reason == S.EMPTY_STACK_TRACE


def test_sources_are_routed_and_parsers_can_be_replaced(spark):
    assert one(spark, "csv", "x").failed_step == "raw"
    raw = spark.createDataFrame([("csv", "x", "st", AT, 1)], S.RAW_EVENT)
    assert N.parse(raw).first().parsed.error == 'ingest: unhandled source type: "csv"'

    def parse_csv(df, rows, out):
        return df.withColumn(
            out,
            F.when(
                rows,
                F.struct(
                    F.lit(4).alias("severity"),
                    F.col("received_at").alias("timestamp"),
                    F.lit("svc").alias("service"),
                    F.lit("").alias("host"),
                    F.col("payload").alias("message"),
                    F.array().alias("stack_frames"),
                    F.create_map().alias("fields"),
                    F.lit("").alias("error"),
                ).cast(S.PARSED),
            ),
        )

    parsed = N.parse(raw, {"csv": parse_csv}).first().parsed
    assert (parsed.message, parsed.error) == ("x", "")


def test_zero_time_is_invalid(spark):
    raw = spark.createDataFrame([("json", "{}", "st", None, 1)], S.RAW_EVENT)
    row = N.normalize(raw).first()
    assert [tuple(e) for e in row.errors] == [("received_at", S.INVALID_TIMESTAMP)]


def test_unselected_fields_are_not_decoded(spark):
    """Fields that nobody selects leave the plan, and with them the second decode and the numbers as written."""
    raw = spark.createDataFrame([("json", '{"message": "m", "a": 1.50}', "s", None, 1)], S.RAW_EVENT)

    def plan(columns):
        frame = N.normalize(raw, {"json": N.PARSERS["json"]}).select(*columns)
        return frame._jdf.queryExecution().optimizedPlan().toString()

    without, fields = plan(["event_id", "signature", "failed_step"]), plan(["event_id", "fields"])
    assert "transform_values" not in without and without.count("MapType(StringType,StringType") == 0
    assert "transform_values" in fields


def test_columns_are_built_once(spark):
    """A second plan takes the columns of the first; results are the same and do not depend on which came first."""
    raw = spark.createDataFrame([("json", '{"message": "m", "level": "error"}', "s", None, 1)], S.RAW_EVENT).withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    first, second = N.normalize(raw), N.normalize(raw.withColumn("attempt_count", F.lit(3)))
    assert first.collect() == second.drop("attempt_count").collect() and second.first().attempt_count == 3
