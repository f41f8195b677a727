"""Embedding columns as numpy matrices."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> F.Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def rows(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(uid, id, dim, vec): vec holds the components as little-endian doubles, null if the vector takes no part. A uid
    names a row of the table once it is written; ids may be null or repeat."""
    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    source = source.select("id", F.when(usable("v"), F.col("v")).alias("v"))

    def packed(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch.column("v")
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # one zero only
            ends = np.cumsum(size)
            vec = [values[e - n : e].astype("<f8").tobytes() if n else None for e, n in zip(ends, size, strict=True)]
            uids = np.arange(uid, uid + batch.num_rows)
            uid += batch.num_rows
            yield pa.RecordBatch.from_pydict({"uid": uids, "id": batch.column("id"), "dim": size.astype(np.int32), "vec": pa.array(vec, pa.binary())})

    return source.mapInArrow(packed, "uid long, id long, dim int, vec binary")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary vectors of one dimension as rows."""
    values = b"".join(column.to_pylist())
    return np.frombuffer(values, "<f8").reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; first by their largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
