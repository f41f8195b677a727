import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import dedup as U
from tests.models import windows

START = datetime(2024, 1, 1)
COLUMNS = "signature string, stream_id string, seq_no bigint, received_at timestamp"


def frame(spark, events):
    rows = [(s, st, n, START + timedelta(microseconds=t)) for s, t, st, n in events]
    return spark.createDataFrame(rows, COLUMNS)


def micros(instant):
    return None if instant is None else (instant - START) // timedelta(microseconds=1)


def found(deduped):
    rows = deduped.collect()
    assert all(r.is_novel == (r.window_count == 1) for r in rows)
    return sorted(
        (
            (r.signature, micros(r.received_at), r.stream_id, r.seq_no),
            micros(r.window_start),
            r.window_count,
        )
        for r in rows
    )


def events(kind, count=1500):
    """Times in microseconds for a window of one second."""
    rng = random.Random(kind)
    if kind == "dense":
        times = [rng.randrange(20_000_000) for _ in range(count)]
    elif kind == "sparse":
        times = [rng.randrange(3_000_000_000) for _ in range(count)]
    elif kind == "burst":
        times = [rng.choice((0, 990_000, 9_000_000)) + rng.randrange(999_999) for _ in range(count)]
    elif kind == "ties":
        times = [rng.randrange(12) * 500_000 for _ in range(count)]
    else:
        times = [i * 13_000 for i in range(count)]
    keys = rng.choices(["hot", "b", "c", ""], weights=[70, 15, 10, 5], k=count)
    return [(k, t, f"st-{rng.randrange(5)}", i) for i, (k, t) in enumerate(zip(keys, times))]


@pytest.mark.parametrize("kind", ["dense", "sparse", "burst", "ties", "regular"])
@pytest.mark.parametrize("hot_rows", [10**9, 60])
def test_windows_equal_model(spark, kind, hot_rows):
    rows = events(kind)
    deduped = U.dedup(frame(spark, rows), 1, hot_rows=hot_rows)
    assert found(deduped) == windows(rows, 1_000_000)


def test_state_crosses_arrow_batches(spark):
    rows = [("k", i * 400_000, "st", i) for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(U.dedup(frame(spark, rows), 1)) == windows(rows, 1_000_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_default_window_and_boundary(spark):
    minute = 60_000_000
    rows = [("k", t, "st", i) for i, t in enumerate((0, 5 * minute - 1, 5 * minute, 9 * minute))]
    assert [count for _, _, count in found(U.dedup(frame(spark, rows), 0))] == [1, 2, 1, 2]


def test_records_and_eviction(spark):
    rows = [("a", 0, "s", 1), ("a", 500_000, "s", 2), ("a", 2_000_000, "s", 3), ("b", 100, "s", 4)]
    deduped = U.dedup(frame(spark, rows), 1).persist()
    records = {(r.signature, r["count"]) for r in U.window_records(deduped).collect()}
    assert records == {("a", 2), ("a", 1), ("b", 1)}
    assert {(r.signature, r["count"]) for r in U.current_records(deduped).collect()} == {
        ("a", 1),
        ("b", 1),
    }

    def tracked(micros_after):
        at = F.lit(START + timedelta(microseconds=micros_after))
        return U.tracked_count(deduped, at, 1).first()[0]

    assert [tracked(t) for t in (600_000, 1_000_100, 1_499_999, 1_500_000, 2_500_000)] == [
        2, 1, 1, 0, 1,
    ]


def test_incidents_carry_the_full_count(spark):
    rows = [("a", i * 1000, "s", i) for i in range(50)] + [("", 5, "s", 90), ("", 6, "s", 91)]
    got = U.incidents(U.dedup(frame(spark, rows), 1)).collect()
    assert sorted((r.seq_no, r.dedup_count) for r in got) == [(0, 50), (90, 1), (91, 1)]


def test_one_signature_with_many_hits(spark):
    rows = [("k", i % 900, f"st-{i % 50}", i) for i in range(5000)]
    assert U.dedup(frame(spark, rows), 60).agg(F.max("window_count")).first()[0] == 5000


def test_events_without_time_are_incidents_of_their_own(spark):
    at = START
    rows = [("s", None, 1), ("s", None, 2), ("s", at, 3), ("s", at, 4), ("t", None, 5), ("", None, 6)]
    events = spark.createDataFrame(rows, "signature string, received_at timestamp, seq_no bigint")
    found = U.dedup(events.withColumn("stream_id", F.lit("x")))
    got = {r.seq_no: r.dedup_count for r in U.incidents(found).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 5: 1, 6: 1}
    assert [(r.signature, r["count"]) for r in U.window_records(found).collect()] == [("s", 2)]
