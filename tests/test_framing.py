import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.operators import framing as R
from faultline.operators.slices import SLICE
from faultline.sources import text as files
from tests.models import blocks

AT = datetime(2024, 1, 1)
PARTS = ["", "", "a", "at x", "at ", "\tat y", "    z", "   ", "\t", "  at q", "b\r", "\r", "\r\r"]


def samples(count=400):
    rng = random.Random(3)
    return ["\n".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(count)]


def streams(spark, texts, source):
    rows = [(source, f"s{i}", text, AT) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "source string, stream_id string, text string, received_at timestamp")


def line_rows(spark, texts, source, rows_per_slice=4):
    rows = [
        (source, f"s{i}", n // rows_per_slice, n, line, AT)
        for i, text in enumerate(texts)
        for n, line in enumerate(text.split("\n"))
    ]
    return spark.createDataFrame(
        rows,
        f"source string, stream_id string, {SLICE} bigint, line_no bigint, line string, received_at timestamp",
    )


def payloads(framed):
    out = {}
    for row in sorted(framed.collect(), key=lambda r: (r.stream_id, r.seq_no)):
        out.setdefault(row.stream_id, []).append(row.payload)
        assert row.seq_no == len(out[row.stream_id])
    return out


def expected(texts, model):
    found = {f"s{i}": model(text) for i, text in enumerate(texts)}
    return {key: value for key, value in found.items() if value}


def plain_lines(text):
    lines = [line[:-1] if line.endswith("\r") else line for line in text.split("\n")]
    return [line for line in lines if line]


@pytest.mark.parametrize(("source", "model"), [("stacktrace", blocks), ("json", plain_lines)])
def test_framing_equals_model(spark, source, model):
    texts = samples()
    assert payloads(R.frame_text(streams(spark, texts, source))) == expected(texts, model)
    assert payloads(R.frame(line_rows(spark, texts, source))) == expected(texts, model)


def test_long_lines(spark):
    long = "x" * 5000
    texts = [f"one\n{long}\ntwo", "x" * 4095, "x" * 4096, f"t\n\tat a\n{long}\n\tat b"]
    for source in ("json", "stacktrace"):
        stop = R.frame_text(streams(spark, texts, source), "text", 4096, True)
        rows = R.frame(line_rows(spark, texts, source), 4096, True)
        assert payloads(stop) == payloads(rows)
    assert payloads(stop) == {"s0": ["one"], "s1": ["x" * 4095], "s3": ["t\n\tat a"]}
    keep = R.frame_text(streams(spark, texts, "json"), max_line_bytes=10, stop_at_long_line=False)
    assert payloads(keep)["s0"] == ["one", "two"]
    left = R.long_lines_of_text(streams(spark, texts, "json"), max_line_bytes=0)
    assert left.count() == 0
    left = R.long_lines_of_text(streams(spark, texts, "json"), max_line_bytes=4096)
    assert sorted((r.stream_id, r.seq_no) for r in left.collect()) == [("s0", -2), ("s2", -1), ("s3", -3)]


def test_files_are_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "y" * (i % 50) if i % 7 else "" for i in range(20_000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("only\r\nthis\rone\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = files.read_lines(spark, str(tmp_path), "json")
        assert read.select(SLICE).distinct().count() > 3
        for framed in (R.number_file_lines(read), R.frame_lines(read)):
            got = payloads(framed)
            got = {key.rsplit("/", 1)[1]: value for key, value in got.items()}
            assert got["a.log"] == [line for line in lines if line]
            assert got["b.log"] == ["only", "this\rone"]
        traces = payloads(R.frame_blocks(files.read_lines(spark, str(tmp_path), "stacktrace")))
        assert sum(map(len, traces.values())) == len([x for x in lines if x]) + 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_received_at_is_kept(spark):
    row = R.frame_text(streams(spark, ["a"], "json")).first()
    assert (row.received_at, row.source) == (AT, "json")
    assert files.read_lines(spark, __file__, "json").filter(F.col("received_at").isNull()).count() == 0
