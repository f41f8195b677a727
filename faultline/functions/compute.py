"""Columns that are computed once, whatever is built on top of them."""

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def built_once(build: Callable) -> Callable:
    """Keep the columns that ``build`` makes for the same plain arguments.

    Columns that only name columns do not depend on a DataFrame, but putting a deep one together takes hundreds of calls
    into the JVM. A stream that is normalized batch by batch, or a second query, then takes them as they are.
    """
    held: dict = {}

    @wraps(build)
    def columns(*args):
        jvm = SparkContext._jvm
        if args not in held or held[args][0] is not jvm:
            held[args] = (jvm, build(*args))
        return held[args][1]

    return columns


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections and filters only refer to.

    A plain projection is merged with what follows: a filter on a derived column is rewritten in
    terms of the source and evaluates the whole derivation a second time, and deep derivations
    grow beyond planning. The optimizer does not look through a generator, and one that yields
    exactly one row costs little. It only hands on the columns of a projection below it, so that
    the work itself is done in generated code.
    """
    held = {name: f"_held_{name}" for name in columns}
    projected = df.select("*", *[columns[name].alias(held[name]) for name in columns])
    row = F.struct(*[F.col(held[name]).alias(name) for name in columns])
    return projected.select(*df.columns, F.inline_outer(F.array(row)))
