"""Streams over several files, in several batches and runs, against the framing of the whole stream."""

import random

import pytest
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators.framing import frame
from faultline.streaming import frames, ingest

PARTS = [
    {"a": ["x failed", "\tat one"], "b": ["panic: b", "", "next", "    deep"]},
    {"a": ["\tat two", "", "\tat alone"], "b": ["\tat three", "y" * 5000, "\tat four"]},
    {"a": ["    more", "z failed"], "c": ["only"]},
    {"b": ["", "last"]},
]


AT = "timestamp '2024-01-01 00:00:00'"
COLUMNS = ["source", "stream_id", "seq_no", "payload", "received_at"]


def batch_frames(spark, source, whole):
    rows = [(source, name, n, line) for name, lines in whole.items() for n, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "source string, stream_id string, line_no bigint, line string")
    table = table.withColumn("received_at", F.expr(AT))
    return sorted(map(tuple, frame(table, 4096).select(COLUMNS).collect()))


def write_part(tmp_path, number, part, whole):
    for name, lines in part.items():
        whole[name] = whole.get(name, []) + lines
        path = tmp_path / "in" / name
        path.mkdir(parents=True, exist_ok=True)
        (path / f"{number:03d}.log").write_text("\n".join(lines) + "\n")


def arriving(spark, tmp_path, source, **options):
    stream = F.regexp_extract("_metadata.file_path", "/([^/]*)/[^/]*$", 1)
    return frames.stream_lines(spark, str(tmp_path / "in"), source, stream, F.expr(AT), **options)


def all_records(spark, stored, out):
    found = stored.filter("reason = ''").select(COLUMNS).union(frames.open_blocks(spark, out + "-progress").select(COLUMNS))
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("source", ["stacktrace", "json"])
def test_streams_go_on(spark, tmp_path, source):
    """Every part is a run of its own and goes on from the state of the one before."""
    out, whole = str(tmp_path / "out"), {}
    for number, part in enumerate(PARTS):
        write_part(tmp_path, number, part, whole)
        stored = ingest.run_to_table(frames.frame_stream(arriving(spark, tmp_path, source), 4096), out)
    assert all_records(spark, stored, out) == batch_frames(spark, source, whole)
    letters = stored.filter("reason <> ''").collect()
    assert [(r.stream_id, r.seq_no, r.payload, r.reason) for r in letters] == [("b", -1, "y" * 5000, S.LINE_TOO_LONG)]


@pytest.mark.parametrize("records_per_batch", [3, 10_000])
def test_chunks_are_stitched(spark, tmp_path, records_per_batch):
    """Random traces in files that end anywhere, several files a batch, chunks of a few lines."""
    rng = random.Random(records_per_batch)
    kinds = ["boom", "boom", "\tat x", "\tat y", "    deep", "  at z", "", "", "\r", "   ", "long " * 1000, "at", " at q\r"]
    out, whole = str(tmp_path / "out"), {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records_per_batch)
    try:
        for run in range(2):
            for number in range(4):
                part = {name: [rng.choice(kinds) for _ in range(rng.randint(0, 12))] for name in "abc"}
                write_part(tmp_path, run * 10 + number, {k: v for k, v in part.items() if v}, whole)
            stored = ingest.run_to_table(frames.frame_stream(arriving(spark, tmp_path, "stacktrace", files_per_batch=12), 4096), out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all_records(spark, stored, out) == batch_frames(spark, "stacktrace", whole)
    letters = stored.filter("reason <> ''").collect()
    assert len({(r.stream_id, r.seq_no) for r in letters}) == len(letters) == sum(x.startswith("long") for v in whole.values() for x in v)
    assert all(r.seq_no < 0 for r in letters)


def test_state_is_one_row_a_stream(spark, tmp_path):
    write_part(tmp_path, 0, PARTS[0], {})
    out = str(tmp_path / "out")
    ingest.run_to_table(frames.frame_stream(arriving(spark, tmp_path, "stacktrace"), 4096), out)
    state = spark.read.format("statestore").option("stateVarName", frames.STREAM_STATE).load(out + "-progress")
    assert sorted((r.key.stream_id, r.value.last_seq, r.value.payload) for r in state.collect()) == [("a", 0, "x failed\n\tat one"), ("b", 1, "next\n    deep")]


def test_the_keyed_step_sees_no_records(spark, tmp_path):
    """Only rows of bounded size per chunk meet in the one task of a stream."""
    write_part(tmp_path, 0, PARTS[0], {})
    plan = frames.frame_stream(arriving(spark, tmp_path, "json"))._jdf.queryExecution().analyzed()

    def nodes(node):
        yield node
        children = node.children().iterator()
        while children.hasNext():
            yield from nodes(children.next())

    keyed = [node for node in nodes(plan) if node.nodeName().startswith("TransformWithState")]
    assert len(keyed) == 1
    assert "binary" not in keyed[0].children().head().schema().simpleString()
