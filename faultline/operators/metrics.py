"""Counters and reports over normalized events."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import or_empty
from faultline.operators.quantiles import exact_quantile
from faultline.operators.slices import previous_value, sliced_by_range

# Streams with more events than this are compared slice by slice.
HOT_ROWS = 2_000_000


def stats_columns() -> list:
    """Ingested, parsed and error counts; for ``agg`` and for ``observe``."""
    failed = F.col("failed_step") != ""
    return [
        F.count("*").alias("ingested"),
        F.count_if(~failed).alias("parsed"),
        F.count_if(failed).alias("errors"),
    ]


def stats(normalized: DataFrame, *by: str) -> DataFrame:
    """Counts over all rows, or per group."""
    grouped = normalized.groupBy(*by) if by else normalized
    return grouped.agg(*stats_columns())


def sequence_gaps(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose sequence number does not follow the one received before in its stream.

    This is the view in the order of arrival: ``missing`` counts the numbers skipped, which may still
    come later, ``reordered`` marks a number not above the one before. For the numbers that never come see
    ``missing_ranges``. Rows without stream are one stream named ''.
    """
    events = events.withColumn("stream_id", or_empty(F.col("stream_id")))
    largest = events.groupBy("stream_id").count().agg(F.max("count")).first()[0] or 0
    order = ["received_at", "seq_no"]
    if largest <= hot_rows:
        before = Window.partitionBy("stream_id").orderBy(*order)
        paired = events.withColumn("previous_seq", F.lag("seq_no").over(before))
    else:
        sliced = sliced_by_range(events, ["stream_id"], order)
        paired = previous_value(sliced, ["stream_id"], order, "seq_no", "previous_seq")
    return (
        paired.filter(F.col("seq_no") != F.col("previous_seq") + 1)
        .withColumn(
            "missing", F.greatest(F.col("seq_no") - F.col("previous_seq") - 1, F.lit(0))
        )
        .withColumn("reordered", F.col("seq_no") <= F.col("previous_seq"))
        .select("stream_id", "received_at", "previous_seq", "seq_no", "missing", "reordered")
    )


def missing_ranges(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ranges of sequence numbers that a stream lacks between its least and greatest, whatever the order of arrival.

    Columns: stream_id, missing_from, missing_to, missing (how many). Repeated numbers count once, null numbers do not count;
    rows without stream are one stream named ''.
    """
    numbers = events.select(or_empty(F.col("stream_id")).alias("stream_id"), "seq_no").dropna().distinct()
    largest = numbers.groupBy("stream_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= hot_rows:
        by_number = Window.partitionBy("stream_id").orderBy("seq_no")
        paired = numbers.withColumn("below", F.lag("seq_no").over(by_number))
    else:
        sliced = sliced_by_range(numbers, ["stream_id"], ["seq_no"])
        paired = previous_value(sliced, ["stream_id"], ["seq_no"], "seq_no", "below")
    return paired.filter(F.col("seq_no") > F.col("below") + 1).select(
        "stream_id",
        (F.col("below") + 1).alias("missing_from"),
        (F.col("seq_no") - 1).alias("missing_to"),
        (F.col("seq_no") - F.col("below") - 1).alias("missing"),
    )


def sequence_summary(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per stream: events, first and last number, repeated (events beyond the first of a number), missing, and reordered
    (arrivals that do not go beyond the one before)."""
    named = events.withColumn("stream_id", or_empty(F.col("stream_id")))
    numbers = named.groupBy("stream_id", "seq_no").agg(F.count("*").alias("times"))
    last, first = F.max("seq_no"), F.min("seq_no")
    counts = numbers.groupBy("stream_id").agg(
        F.sum("times").alias("events"),
        first.alias("first_seq"),
        last.alias("last_seq"),
        F.sum(F.when(F.col("seq_no").isNotNull(), F.col("times") - 1).otherwise(0)).alias("repeated"),
        F.coalesce(last - first + 1 - F.count("seq_no"), F.lit(0)).alias("missing"),
    )
    back = sequence_gaps(named, hot_rows).groupBy("stream_id").agg(F.count_if("reordered").alias("reordered"))
    return counts.join(back, "stream_id", "left").fillna(0, ["reordered"])


def ingestion_lag(events: DataFrame) -> DataFrame:
    """Delay between event time and reception per service, in microseconds; the median is exact (the lower one of two).

    ``events`` is read twice: store it first when it is costly to compute.
    """
    lag = F.unix_micros("received_at") - F.unix_micros("timestamp")
    lags = events.select("service", lag.alias("lag"))
    median = exact_quantile(lags, "service", "lag", 0.5, "median_lag_us")
    counts = lags.groupBy("service").agg(
        F.count("*").alias("events"),
        F.min("lag").alias("min_lag_us"),
        F.max("lag").alias("max_lag_us"),
        F.sum("lag").alias("total_lag_us"),
    )
    return counts.join(median, "service", "left")


def throughput(events: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Events and payload bytes per time bucket and stream."""
    return (
        events.groupBy(F.window("received_at", bucket).alias("_bucket"), "stream_id")
        .agg(F.count("*").alias("events"), F.sum("raw_size").alias("bytes"))
        .select(F.col("_bucket.start").alias("bucket_start"), "stream_id", "events", "bytes")
    )


def template_catalogue(signed: DataFrame) -> DataFrame:
    """Which template stands behind a signature, and how often and when it was seen."""
    return (
        signed.filter(F.col("signature") != "")
        .groupBy("signature", "template")
        .agg(
            F.count("*").alias("events"),
            F.min("received_at").alias("first_seen"),
            F.max("received_at").alias("last_seen"),
        )
    )


def top_templates(signed: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent templates; ties go by signature."""
    catalogue = template_catalogue(signed)
    return catalogue.orderBy(F.col("events").desc(), "signature").limit(k)
