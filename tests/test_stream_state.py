"""State of streams: order by the clock of the stream, eviction without loss, records read while the state is kept, counters."""

import random
import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators import dedup as U
from faultline.operators import normalize as N
from faultline.streaming import counters, ingest
from faultline.streaming import dedup as D
from tests.models import windows
from tests.test_dedup import START, events, found, frame, micros
from tests.test_streaming import arriving

SECOND = 1_000_000


def shuffled(rows, seed=3):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


def test_ordered_stream_equals_batch_whatever_the_order(spark, tmp_path):
    """Events in no order, in files of which some are only there after a restart from the checkpoint."""
    rows = shuffled(events("dense", 500))
    end = [("", 3600 * SECOND, "clock", 0)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    stream = arriving(spark, source, [rows[:120], rows[120:300]])
    deduped = D.dedup_stream(stream, 1, lateness_seconds=60, ordered=True)
    first = ingest.run_to_table(deduped, out)
    # Nothing signed can be released before the clock has passed it.
    assert first.filter("signature <> ''").count() == 0
    held = spark.read.format("statestore").option("stateVarName", "held").load(out + "-progress")
    assert held.count() > 0
    for number, part in enumerate((rows[300:], end), 5):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{source}/{number:03d}")
    stored = ingest.run_to_table(deduped, out)
    assert found(stored.filter("stream_id <> 'clock'")) == windows(rows, SECOND)
    # The clock has passed all windows: neither waiting events nor records are left.
    assert spark.read.format("statestore").option("stateVarName", "held").load(out + "-progress").count() == 0


def test_ordered_stream_releases_what_the_clock_has_passed(spark, tmp_path):
    batches = [[("k", 10 * SECOND, "s", 1), ("k", 0, "s", 2)], [("k", 500_000, "s", 3), ("z", 70 * SECOND, "s", 4)], [("k", 900_000, "s", 5), ("k", 10 * SECOND + 1, "s", 6)], [("k", 950_000, "s", 7)]]
    stream = arriving(spark, tmp_path / "in", batches)
    stored = ingest.run_to_table(D.dedup_stream(stream, 1, lateness_seconds=30, ordered=True), str(tmp_path / "out"))
    got = {r.seq_no: (micros(r.window_start), r.window_count) for r in stored.collect()}
    # 5 is later than the lateness, but those before it still wait; 7 comes when they are gone and counts in the window open then.
    assert got == {1: (10 * SECOND, 1), 2: (0, 1), 3: (0, 2), 5: (0, 3), 6: (10 * SECOND, 2), 7: (10 * SECOND, 3)}


def test_watermark_evicts_and_drops_nothing(spark, tmp_path):
    rows = [("k", i * 700_000, "st", i) for i in range(20)]
    late = [("k", 5, "st", 100), ("new", 6, "st", 101)]
    batches = [rows, [("z", 900 * SECOND, "st", 99)], late]
    out = str(tmp_path / "out")
    deduped = D.dedup_stream(arriving(spark, tmp_path / "in", batches[:2]), 1, lateness_seconds=60)
    ingest.run_to_table(deduped, out)
    records = D.stream_records(spark, out + "-progress")
    assert [r.signature for r in records.collect()] == ["z"]
    frame(spark, late).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/009")
    stored = ingest.run_to_table(deduped, out)
    assert stored.count() == 23
    assert {r.seq_no: r.is_novel for r in stored.filter("seq_no >= 99").collect()} == {99: True, 100: True, 101: True}


def test_time_to_live_evicts_and_drops_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    stream = arriving(spark, source, [[("a", 0, "s", 1), ("b", 0, "s", 2)]])
    deduped = D.dedup_stream(stream, 3600, ttl_seconds=4)
    ingest.run_to_table(deduped, out, by_clock=True)
    records = lambda: {r.signature: r["count"] for r in D.stream_records(spark, out + "-progress").collect()}
    assert records() == {"a": 1, "b": 1}
    frame(spark, [("b", 1, "s", 3)]).coalesce(1).write.mode("append").parquet(f"{source}/001")
    ingest.run_to_table(deduped, out, by_clock=True)
    time.sleep(6)
    frame(spark, [("c", 2, "s", 4), ("a", 3, "s", 5)]).coalesce(1).write.mode("append").parquet(f"{source}/002")
    stored = ingest.run_to_table(deduped, out, by_clock=True)
    # The old records are gone, no event is: the last of "a" opens a window again.
    assert records() == {"a": 1, "c": 1}
    assert sorted((r.seq_no, r.is_novel) for r in stored.collect())[::4] == [(1, True), (5, True)]
    assert stored.count() == 5


def test_records_are_read_from_the_state(spark, tmp_path):
    rows = sorted(events("sparse", 300), key=lambda r: r[1:])
    source, out = tmp_path / "in", str(tmp_path / "out")
    deduped = D.dedup_stream(arriving(spark, source, [rows[:100], rows[100:200]]), 1)
    ingest.run_to_table(deduped, out)
    for more in (0, 100):
        if more:
            frame(spark, rows[200:]).coalesce(1).write.mode("append").parquet(f"{source}/005")
            ingest.run_to_table(deduped, out)
        batch = U.dedup(frame(spark, rows[: 200 + more]), 1)
        names = ["signature", "first_seen", "last_seen", "count"]
        wanted = sorted(map(tuple, U.current_records(batch).select(names).collect()))
        records = D.stream_records(spark, out + "-progress")
        assert sorted(map(tuple, records.select(names).collect())) == wanted
    as_of = F.lit(START + timedelta(seconds=2990))
    assert D.stream_tracked_count(records, as_of, 20).first()[0] == sum(
        (START + timedelta(seconds=2990) - r[2]).total_seconds() < 20 for r in wanted
    )


def test_rows_keep_their_columns(spark, tmp_path):
    """Result names are replaced, all other columns are kept, also such as the library uses inside."""
    data = frame(spark, [("k", 0, "s", 1), ("k", 1, "s", 2), (None, 2, "s", 3)]).selectExpr(
        "*", "'x' AS rows", "1 AS place", "2 AS window_count", "'y' AS is_novel", "3 AS _t", "array(1, 2) AS list", "4 AS micros"
    )
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    stored = ingest.run_to_table(D.dedup_stream(stream, 1), str(tmp_path / "out"))
    batch = U.dedup(data, 1)
    assert stored.columns == batch.columns == ["signature", "stream_id", "seq_no", "received_at", "rows", "place", "_t", "list", "micros", "window_start", "is_novel", "window_count"]
    assert sorted(map(str, stored.collect())) == sorted(map(str, batch.collect()))
    assert sorted((r.seq_no, r._t, r.window_count, r.list) for r in batch.collect()) == [(1, 3, 1, [1, 2]), (2, 3, 2, [1, 2]), (3, 3, 1, [1, 2])]


def test_frequent_signature_in_one_batch(spark, tmp_path):
    rows = [("k", (i * 7919) % 100_003 * 100, f"st-{i % 50}", i) for i in range(30_000)]
    frame(spark, rows).repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("signature string, stream_id string, seq_no bigint, received_at timestamp").parquet(str(tmp_path / "in"))
    stored = ingest.run_to_table(D.dedup_stream(stream, 1), str(tmp_path / "out"))
    assert found(stored) == windows(rows, SECOND)


@pytest.mark.parametrize("name, options", [("ordered", {"ordered": True}), ("both", {"ttl_seconds": 1, "lateness_seconds": 1})])
def test_options_that_do_not_go_together(spark, name, options):
    with pytest.raises(ValueError):
        D.dedup_stream(frame(spark, []), 1, **options)


def test_slice_maps(spark):
    """The map of a slice tells where a plain walk ends, for every window that may be open before it."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        width = int(rng.integers(1, 30))
        times = np.sort(rng.integers(100, 100 + int(rng.integers(1, 120)), int(rng.integers(1, 40))))
        ends, last, tail = U.slice_map(times, width)
        for start in range(100 - 2 * width, int(times[0]) + 1):
            at, count = start, 0
            for t in times:
                at, count = (int(t), 1) if t >= at + width else (at, count + 1)
            entry = int(np.searchsorted(ends, start + width))
            got = (int(last[entry]), int(tail[entry])) if entry < len(ends) else (start, len(times))
            assert got == (at, count)


def raw_files(spark, folder, files):
    rows = [("json", '{"level":"error","msg":"m"}' if i % 3 else "{", "st", START, i) for i in range(files)]
    spark.createDataFrame(rows, S.RAW_EVENT).repartition(files, "seq_no").write.option("maxRecordsPerFile", 1).parquet(folder)
    return spark.readStream.schema(S.RAW_EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counters_of_many_batches_by_a_listener(spark, tmp_path):
    files, rows = 104, str(tmp_path / "counters")
    stream = raw_files(spark, str(tmp_path / "raw"), files)
    listener = counters.BatchCounters(spark, rows)
    spark.streams.addListener(listener)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "10")
    try:
        passed = counters.observed(N.normalize(stream)).filter("failed_step = ''").select("event_id")
        for _ in range(2):  # the second run finds nothing new
            query = ingest.start_to_table(passed, str(tmp_path / "out"))
            query.awaitTermination()
            listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    table = counters.batch_counters(spark, rows)
    bad = len(range(0, files, 3))
    assert tuple(counters.totals(table).first()) == (files, files, files - bad, bad)
    assert table.select("query_id").distinct().count() == 1


def test_listener_tells_of_failure(spark, tmp_path):
    listener = counters.BatchCounters(spark, "no-such-scheme://x")
    stream = raw_files(spark, str(tmp_path / "raw"), 1)
    spark.streams.addListener(listener)
    try:
        query = ingest.start_to_table(counters.observed(N.normalize(stream)).select("event_id"), str(tmp_path / "out"))
        query.awaitTermination()
        with pytest.raises(Exception, match="no-such-scheme"):
            listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
