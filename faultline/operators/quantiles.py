"""Exact quantiles of groups of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.slices import running_total, sliced_by_range


def exact_quantile(rows: DataFrame, by: str, value: str, share: float, name: str) -> DataFrame:
    """For each group the least value that at least ``share`` of its values do not exceed: (``by``, ``name``).

    Values are counted first, so a group is sorted by its distinct values, over as many tasks as these need. Slices of
    the sorted values carry one sum each; the value at which the running count reaches the rank is the
    quantile. Null values do not count; groups without values and the null group have no row.
    """
    held = rows.select(F.col(by).alias("group"), F.col(value).alias("value")).dropna()
    counted = held.groupBy("group", "value").agg(F.count("*").alias("times"))
    sliced = sliced_by_range(counted, ["group"], ["value"])
    totals = sliced.groupBy("group").agg(F.greatest(F.ceil(F.sum("times") * F.lit(share)), F.lit(1)).alias("rank"))
    upto = running_total(sliced, ["group"], ["value"], F.col("times"), "upto").join(totals, "group")
    at_rank = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("times") < F.col("rank"))
    return upto.filter(at_rank).select(F.col("group").alias(by), F.col("value").alias(name))
