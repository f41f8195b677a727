"""Ordered computations inside groups of any size.

A window over a group puts the whole group into one task. These helpers cut groups into slices
that are contiguous in the requested order and bounded in rows, compute inside the slices, and
carry the small per-slice results across.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

SLICE = "_slice"


def sliced_by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cut by range partitioning: slice = partition, so its size is that of one partition.

    The rows are stored because a second evaluation could draw other range bounds.
    """
    ranged = df.repartitionByRange(*[F.col(name) for name in keys + order])
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()))


def sliced_by_position(df: DataFrame, position: str, rows: int = 1_000_000) -> DataFrame:
    """Cut by a dense position column, ``rows`` positions per slice; needs no extra pass."""
    return df.withColumn(SLICE, F.floor(F.col(position) / rows).cast("bigint"))


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the rows of the group up to and including this row."""
    per_slice = df.groupBy(*keys, SLICE).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys, SLICE, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried")
    )
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(carried, [*keys, SLICE])
        .withColumn(out, F.col("_carried") + F.col("_inside"))
        .drop("_inside", "_carried")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: ``value`` of the row before this one in the group, null for the first."""
    per_slice = df.groupBy(*keys, SLICE).agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_last")
    )
    slices = Window.partitionBy(*keys).orderBy(SLICE)
    carried = per_slice.select(*keys, SLICE, F.lag("_last").over(slices).alias("_carried"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        df.withColumn("_before", F.lag(F.struct(F.col(value))).over(inside))
        .join(carried, [*keys, SLICE])
        .withColumn(
            out,
            F.when(F.col("_before").isNull(), F.col("_carried")).otherwise(
                F.col("_before")[value]
            ),
        )
        .drop("_before", "_carried")
    )
