from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.sources import jsonl
from faultline.streaming import dedup as stream_dedup
from faultline.streaming import ingest
from tests.models import windows
from tests.test_dedup import COLUMNS, events, found, frame, micros

START = datetime(2024, 1, 1)


def arriving(spark, folder, batches):
    """Each batch as one file, taken one per trigger in order."""
    for number, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/{number:03d}")
    return (
        spark.readStream.schema(COLUMNS)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(folder))
    )


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(events("dense", 600), key=lambda r: (r[1], r[2], r[3]))
    stream = arriving(spark, tmp_path / "in", [rows[i : i + 150] for i in range(0, 600, 150)])
    stored = ingest.run_to_table(stream_dedup.dedup_stream(stream, 1), str(tmp_path / "out"))
    assert found(stored) == windows(rows, 1_000_000)


def test_eviction_by_watermark_keeps_results(spark, tmp_path):
    rows = [("k", i * 700_000, "st", i) for i in range(40)] + [("z", 40_000_000, "st", 99)]
    stream = arriving(spark, tmp_path / "in", [rows[i : i + 10] for i in range(0, 41, 10)])
    deduped = stream_dedup.dedup_stream(stream, 1, lateness_seconds=60)
    stored = ingest.run_to_table(deduped, str(tmp_path / "out"))
    assert found(stored) == windows(rows, 1_000_000)


def test_stream_events_without_time_are_novel(spark, tmp_path):
    rows = [("k", "st", 1, START), ("k", "st", 2, None), ("k", "st", 3, START), ("k", "st", 4, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    stored = ingest.run_to_table(stream_dedup.dedup_stream(stream, 1), str(tmp_path / "out"))
    got = sorted((r.seq_no, r.is_novel, micros(r.window_start)) for r in stored.collect())
    assert got == [(1, True, 0), (2, True, None), (3, False, 0), (4, True, None)]


def test_late_event_counts_as_duplicate(spark, tmp_path):
    batches = [[("k", 5_000_000, "st", 1)], [("k", 4_900_000, "st", 2)], [("k", 5_100_000, "st", 3)]]
    stream = arriving(spark, tmp_path / "in", batches)
    stored = ingest.run_to_table(stream_dedup.dedup_stream(stream, 1), str(tmp_path / "out"))
    got = sorted((r.seq_no, micros(r.window_start), r.window_count) for r in stored.collect())
    assert got == [(1, 5_000_000, 1), (2, 5_000_000, 2), (3, 5_000_000, 3)]


def raw_stream(spark, folder, count=20, bad=4):
    rows = [
        ("json", f'{{"level":"error","msg":"failed {i}"}}' if i >= bad else "{", "st",
         START + timedelta(seconds=i), i)
        for i in range(count)
    ]
    spark.createDataFrame(rows, S.RAW_EVENT).repartition(3).write.parquet(folder)
    return spark.readStream.schema(S.RAW_EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingest_files_events_and_letters(spark, tmp_path):
    raw = raw_stream(spark, str(tmp_path / "raw"))
    table, letters = str(tmp_path / "events"), str(tmp_path / "letters")
    ingest.run_ingest(raw, table, letters)
    ingest.run_ingest(raw, table, letters)  # nothing new: nothing is written twice
    stored = spark.read.parquet(table)
    assert stored.count() == 16 and stored.select("signature").distinct().count() == 1
    found_letters = jsonl.read_dead_letters(spark, letters)
    assert found_letters.count() == 4
    assert {r.reason for r in found_letters.collect()} == {S.INVALID_JSON}
