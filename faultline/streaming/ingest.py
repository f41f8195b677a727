"""Streaming ingest: normalized events to a table, rejects to the dead letters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.deadletter import dead_letters
from faultline.operators.metrics import stats_columns
from faultline.operators.normalize import accepted, normalize, rejected
from faultline.sources.jsonl import write_json_lines


def run_to_table(stream: DataFrame, path: str, by_clock: bool = False) -> DataFrame:
    """Write what is available of ``stream`` to a table and read it back; progress and state are kept beside the table.

    A query that keeps time by the clock asks for another batch without end. With ``by_clock`` it gets only batches with data.
    """
    spark, option = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "false" if by_clock else before)
    try:
        query = start_to_table(stream, path)
    finally:
        spark.conf.set(option, before)
    query.awaitTermination()
    return spark.read.parquet(path)


def start_to_table(stream: DataFrame, path: str):
    """Start to write what is available of ``stream``."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", path + "-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def start_ingest(
    raw: DataFrame,
    table: str,
    letters: str,
    parsers=None,
    attempts: int | None = None,
    failed_at: Column | None = None,
    trigger: dict | None = None,
    counters: str | None = None,
):
    """Start a query that normalizes raw events, keeps accepted ones and files rejects.

    Both outputs of a batch are folders named after it and are overwritten when the batch runs
    again, so a restart neither loses nor repeats rows. With ``counters`` each batch also writes its
    counts there, see ``counted_totals``.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        events = normalize(batch, parsers).persist()
        try:
            accepted(events).write.mode("overwrite").parquet(f"{table}/batch={number}")
            write_json_lines(
                dead_letters(rejected(events), attempts=attempts, failed_at=failed_at),
                f"{letters}/batch={number}",
                mode="overwrite",
            )
            if counters:
                counts = events.agg(*stats_columns()).coalesce(1)
                counts.write.mode("overwrite").parquet(f"{counters}/batch={number}")
        finally:
            events.unpersist()

    return (
        raw.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", table + "-progress")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def run_ingest(raw: DataFrame, table: str, letters: str, **options) -> None:
    """Ingest what is available, then return."""
    start_ingest(raw, table, letters, trigger={"availableNow": True}, **options).awaitTermination()


def counted_totals(spark: SparkSession, counters: str) -> dict[str, int]:
    """Sum of the counters over all batches that ``start_ingest`` has written, across restarts."""
    schema = "ingested bigint, parsed bigint, errors bigint"
    rows = spark.read.schema(schema).option("basePath", counters).parquet(counters)
    names = ("ingested", "parsed", "errors")
    row = rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]).first()
    return {name: row[name] for name in names}
