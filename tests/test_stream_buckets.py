"""State of deduplicated streams by buckets of signatures: few rows of state for many signatures, each signature on its own."""

import time

import pytest

from faultline.operators import dedup as U
from faultline.streaming import dedup as D
from faultline.streaming import ingest
from tests.models import windows
from tests.test_dedup import found, frame
from tests.test_stream_state import SECOND, shuffled
from tests.test_streaming import arriving

ROWS = [(f"k{i % 3000}", (i * 7919) % 100_003 * 1000, f"st-{i % 7}", i) for i in range(9000)]


def state(spark, out, name):
    return spark.read.format("statestore").option("stateVarName", name).load(out + "-progress")


def test_records_of_many_signatures_take_few_rows_of_state(spark, tmp_path):
    rows, out = sorted(ROWS, key=lambda r: r[1:]), str(tmp_path / "out")
    stored = ingest.run_to_table(D.dedup_stream(arriving(spark, tmp_path / "in", [rows[:4000], rows[4000:]]), 20), out)
    assert found(stored) == windows(rows, 20 * SECOND)
    assert state(spark, out, "record").count() <= 1024
    names = ["signature", "first_seen", "last_seen", "count"]
    batch = U.current_records(U.dedup(frame(spark, rows), 20)).select(names)
    assert sorted(map(tuple, D.stream_records(spark, out + "-progress").select(names).collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("buckets", [1, 1024])
def test_waiting_events_of_many_signatures_take_few_rows_of_state(spark, tmp_path, buckets):
    rows, source, out = shuffled(ROWS), tmp_path / "in", str(tmp_path / "out")
    options = {"buckets": buckets} if buckets == 1 else {}
    deduped = D.dedup_stream(arriving(spark, source, [rows[:4000], rows[4000:]]), 20, lateness_seconds=200, ordered=True, **options)
    ingest.run_to_table(deduped, out)
    assert 0 < state(spark, out, "held").select("key").distinct().count() <= buckets
    # The clock passes half of the events, then all of them.
    half = next(t for t in range(50 * SECOND, 60 * SECOND, 1000) if all(abs(r[1] - t) > 3000 for r in ROWS))
    for number, at in enumerate((half + 200 * SECOND, 3600 * SECOND), 5):
        frame(spark, [("", at, "clock", number)]).coalesce(1).write.mode("append").parquet(f"{source}/{number:03d}")
        stored = ingest.run_to_table(deduped, out).filter("stream_id <> 'clock'")
        assert found(stored) == [w for w in windows(rows, 20 * SECOND) if number == 6 or w[0][1] <= half]
    assert state(spark, out, "held").count() == 0


def test_records_of_one_bucket_go_one_by_one(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [[("a", 0, "s", 1), ("b", 50 * SECOND, "s", 2)], [("c", 51 * SECOND, "s", 3)]]
    ingest.run_to_table(D.dedup_stream(arriving(spark, tmp_path / "in", batches), 1, lateness_seconds=10, buckets=1), out)
    assert sorted(r.signature for r in D.stream_records(spark, out + "-progress").collect()) == ["b", "c"]


def test_records_of_one_bucket_live_for_their_own_time(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    deduped = D.dedup_stream(arriving(spark, source, [[("a", 0, "s", 1), ("b", 0, "s", 2)]]), 3600, ttl_seconds=12, buckets=1)
    ingest.run_to_table(deduped, out, by_clock=True)
    time.sleep(8)
    frame(spark, [("b", 1, "s", 3)]).coalesce(1).write.mode("append").parquet(f"{source}/001")
    ingest.run_to_table(deduped, out, by_clock=True)
    time.sleep(6)
    frame(spark, [("c", 2, "s", 4)]).coalesce(1).write.mode("append").parquet(f"{source}/002")
    ingest.run_to_table(deduped, out, by_clock=True)
    assert {r.signature: r["count"] for r in D.stream_records(spark, out + "-progress").collect()} == {"b": 2, "c": 1}
