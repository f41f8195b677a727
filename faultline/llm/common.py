"""What several operators share: columns of their own, folds, hot groups in blocks, groups in sorted batches."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import new_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: computed once, with columns to prune."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: Column | str, of: int) -> Column:
    """crc32 of the value as text, modulo ``of``; null counts as the text "" so that every row has a fold."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % of


def running_before(totals: DataFrame, order: str, total: str, name: str, *within: str) -> DataFrame:
    """``totals`` (one row per partition of a written table: its size is that of a file list) with sums of earlier rows."""
    from pyspark.sql import Window

    frame = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(total).over(frame), F.lit(0)).cast("long"))


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, from batches in which equal keys are adjacent."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        values = [rows.column(k).combine_chunks() for k in keys]
        new = np.zeros(rows.num_rows, bool)
        for v in values:
            v = np.asarray(v)
            new[1:] |= v[1:] != v[:-1]
        first = tuple(v[0].as_py() for v in values)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        last = tuple(v[len(v) - 1].as_py() for v in values)
        cuts = [0, *np.flatnonzero(new).tolist(), rows.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.concat_tables([*held, rows.slice(a, b - a)])
            held = []
        held.append(rows.slice(cuts[-2]))
    if held:
        yield pa.concat_tables(held)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def fresh_name(stem: str) -> str:
    """A column name that no table of the user has."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"


def bucket_tasks(banded: DataFrame, block: int, weight: str | None = None, most_weight: int = 1) -> DataFrame:
    """Comparison tasks for the buckets of ``banded`` (rep, band, hash): (band, hash, i, j, own, rep).

    Members of a bucket are dealt into blocks of about ``block`` members (and ``most_weight`` of ``weight``), and a task is a pair
    of blocks, so that a hot bucket is many tasks of bounded size. Buckets of one member are dropped, and of buckets with the
    same members all but the one of the lowest band.
    """
    weights = F.sum(weight) if weight else F.count("*")
    buckets = banded.groupBy("band", "hash").agg(
        F.count("*").alias("members"), weights.alias("weight"), F.min("rep").alias("low"), F.max("rep").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2"),
    ).filter("members > 1")
    alike = ["members", "weight", "low", "high", "x1", "x2"]
    buckets = buckets.groupBy(*alike).agg(F.min(F.struct("band", "hash")).alias("b")).select("b.*", "members", "weight")
    count = F.ceil(F.col("members") / block)
    blocks = F.greatest(count, F.ceil(F.col("weight") / most_weight)) if weight else count
    members = banded.select("rep", "band", "hash").join(buckets, ["band", "hash"]).withColumn("blocks", blocks.cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select("band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")


#: The columns that name a task of :func:`bucket_tasks`.
TASK = ["band", "hash", "i", "j"]


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix ``near`` connects."""
    left, out = near.any(axis=1), []
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo:
            one = todo.pop()
            new = np.flatnonzero(near[one] & left)
            left[new] = False
            out += [(one, x) for x in new.tolist()]
            todo += new.tolist()
    return out


LINKS = "a long, b long, links long"


def link_rows(near: np.ndarray, reps: np.ndarray, copies: np.ndarray) -> pa.RecordBatch | None:
    """What a task returns for its links: (a, null, number of rows linked to a) and edges (a, b, 0) that connect them."""
    links = near @ copies
    hit = np.flatnonzero(links)
    if not len(hit):
        return None
    edges = np.array(spanning(near), np.int64).reshape(-1, 2)
    a = np.concatenate([reps[hit], reps[edges[:, 0]]])
    b = pa.array(np.concatenate([np.zeros(len(hit), np.int64), reps[edges[:, 1]]]), mask=np.arange(len(a)) < len(hit))
    n_links = np.concatenate([links[hit], np.zeros(len(edges), np.int64)])
    return pa.RecordBatch.from_pydict({"a": a, "b": b, "links": n_links})


def first_links(near: np.ndarray, group: pa.Table, hashes: np.ndarray) -> np.ndarray:
    """``near`` without the diagonal, pairs of an earlier band and, in a task of two blocks, pairs of one block."""
    for b in range(group.column("band")[0].as_py()):
        near &= hashes[:, b][:, None] != hashes[:, b][None, :]
    np.fill_diagonal(near, False)
    if group.column("i")[0] != group.column("j")[0]:
        own = group.column("own").to_numpy()
        near &= own[:, None] != own[None, :]
    return near
