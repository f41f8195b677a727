"""Approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two D, sent through three rounds of random sign flips and fast Hadamard transforms (a pseudo-
rotation), and falls into the bucket of the signed axis it is nearest to: 2 D buckets in each of ``tables`` tables. A query
looks into the buckets of its ``probes`` nearest axes of every table; all rows found there are ranked by their exact
distance in double precision. Every row is in the index.

The number of probes is fitted: on a bounded sample (``sample_rows`` rows, ``sample_queries`` queries, by hash of the id) the true
neighbours are computed, and the smallest number that finds the target share of them is taken. A sample is thinner than
the table, its neighbours are farther, so the full table does better. Where directions say little (norms that differ, for
one), the fit rises to all axes, which is an exhaustive search. Queries that find fewer than k rows though there are more, and
all queries of a dimension the sample says nothing about, are searched again over all axes of one table: exhaustively.

Buckets are dealt into blocks of bounded size on both sides, so hot buckets are many tasks; a task returns at most k rows a
query. Rules: unusable vectors (null, empty, zero, null or non-finite components) and other dimensions than the query's
take no part. Ties go to the smaller id, then to the earlier row. A query never finds its own row, but finds copies of it.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import vectors as V
from faultline.llm.common import groups, stored


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalized fast Hadamard transform of the rows."""
    n = x.shape[1]
    half = 1
    while half < n:
        pair = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table: signs and transform, three times."""
    size = 1 << max(x.shape[1] - 1, 1).bit_length()
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    random = np.random.default_rng([table, size])
    for _ in range(3):
        out = hadamard(out * random.choice([-1.0, 1.0], size))
    return out


def axes(x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: axis + D for its negative side."""
    y = rotated(V.unit(x), table)
    both = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def nearest(x: np.ndarray, ids: np.ndarray, uids: np.ndarray, q: np.ndarray, q_uids: np.ndarray, k: int):
    """(query, row, distance) of the k nearest rows of each query, without rows of the query's uid."""
    square = (x * x).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T
    square[q_uids[:, None] == uids[None, :]] = np.inf
    k_ = min(k, len(x)) - 1
    limit = np.partition(square, k_, axis=1)[:, k_]
    slack = 1e-9 * (1 + np.abs(x).max() ** 2 + np.abs(q).max() ** 2) * x.shape[1]
    row, col = np.nonzero((square <= limit[:, None] + slack) & np.isfinite(square))
    exact = np.sqrt(((x[col] - q[row]) ** 2).sum(axis=1))
    order = np.lexsort((uids[col], ids[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k], exact[rank < k]


def fit_probes(held: DataFrame, is_query, k: int, tables: int, recall: float, sample_rows: int, sample_queries: int) -> tuple[int, list[int]]:
    """The smallest number of probes that reaches ``recall`` on the sample, at least 1, and the dimensions it was fitted on."""
    by_hash = lambda df, n: df.orderBy(F.xxhash64("id"), "uid").limit(n)
    ids = by_hash(held.select("uid", "id", "dim"), sample_rows).union(by_hash(held.filter(is_query).select("uid", "id", "dim"), sample_queries))
    got = held.join(F.broadcast(ids.select("uid").distinct()), "uid", "left_semi").withColumn("is_query", is_query).toArrow()
    worst, fitted = 1, []
    dims = got.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = got.filter(pa.array(dims == dim))
        x, uids = V.matrix(part.column("vec")), part.column("uid").to_numpy()
        at = np.flatnonzero(part.column("is_query").to_numpy(zero_copy_only=False))
        at = at[np.argsort(uids[at] * 2654435761 % 4294967291)][:sample_queries]
        if len(at) and len(x) > 1:
            row, col, _ = nearest(x, part.column("id").to_numpy(), uids, x[at], uids[at], k)
            best = np.full(len(row), 1 << 30)
            for t in range(tables):
                home, order = axes(x, t)[:, 0], axes(x[at], t, 1 << 30)
                best = np.minimum(best, np.argsort(order, axis=1)[row, home[col]])
            fitted.append(dim)
            worst = max(worst, int(np.sort(best)[math.ceil(recall * len(best)) - 1]) + 1)
    return worst, fitted


def search(
    table: DataFrame, is_query, k: int = 10, tables: int = 2, recall: float = 0.96, block: int = 4096, sample_rows: int = 4000, sample_queries: int = 100,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, ``key``, score): for each row where ``is_query`` (a condition on the column ``id``) holds its k nearest rows
    found by Euclidean distance (score). Rows with a null id are neither queries nor found."""
    held = stored(V.rows(table, key, column).filter("vec is not null and id is not null"), "vectors")
    probes, fitted = fit_probes(held, is_query, k, tables, recall, sample_rows, sample_queries)
    queries = held.filter(is_query).select("uid", "dim", "vec")
    first = stored(_ranked(held, queries, probes, tables, k, block), "neighbours")
    found = first.groupBy(F.col("q").alias("uid")).agg(F.count("*").alias("found"))
    rows = held.groupBy("dim").agg(F.count("*").alias("rows"))
    enough = (F.coalesce("found", F.lit(0)) >= F.least(F.lit(k), F.col("rows") - 1)) & F.col("dim").isin(fitted)
    short = queries.join(F.broadcast(rows), "dim").join(found, "uid", "left").filter(~enough)
    short = stored(short.select("uid", "dim", "vec"), "short_queries")
    if not short.isEmpty():
        again = _ranked(held, short, 1 << 30, 1, k, block)
        first = first.join(short.select(F.col("uid").alias("q")), "q", "left_anti").unionByName(again)
    return first.select("query_id", "rank", F.col("id").alias(key), "score")


def _ranked(held: DataFrame, queries: DataFrame, probes: int, tables: int, k: int, block: int) -> DataFrame:
    """(q, query_id, rank, id, score): the k nearest rows in the ``probes`` nearest buckets of each table, for each of ``queries``."""

    def placed(count: int):
        def run(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                    x, uids = V.matrix(part.column("vec")), part.column("uid").to_numpy()
                    for t in range(tables):
                        found = axes(x, t, count)
                        n = found.shape[1]
                        yield pa.RecordBatch.from_pydict({"uid": np.repeat(uids, n), "dim": np.full(n * len(x), dim, np.int32), "t": np.full(n * len(x), t, np.int32), "bucket": found.reshape(-1).astype(np.int32)})

        return run

    spot = ["dim", "t", "bucket"]
    index = held.mapInArrow(placed(1), "uid long, dim int, t int, bucket int")
    looks = queries.mapInArrow(placed(probes), "uid long, dim int, t int, bucket int")
    # At most tables x 2 D rows for each dimension.
    sizes = index.groupBy(*spot).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = looks.groupBy(*spot).agg(F.ceil(F.count("*") / block).cast("int").alias("asks"))
    sizes = F.broadcast(stored(sizes.join(asked, spot), "bucket_sizes"))
    part = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(sizes, spot).select(*spot, "uid", part("blocks").alias("i"), every("asks").alias("j"), F.lit(0).alias("side"))
    asks = looks.join(sizes, spot).select(*spot, "uid", every("blocks").alias("i"), part("asks").alias("j"), F.lit(1).alias("side"))
    task = [*spot, "i", "j"]
    both = rows.union(asks).join(held.select("uid", "id", "vec"), "uid")

    def rank(batches):
        for group in groups(batches, *task):
            side = group.column("side").to_numpy()
            if side.min() == side.max():
                continue
            x, ids, uids = V.matrix(group.column("vec")), group.column("id").to_numpy(), group.column("uid").to_numpy()
            at, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for a in range(0, len(ask), 256):
                some = ask[a : a + 256]
                row, col, score = nearest(x[at], ids[at], uids[at], x[some], uids[some], k)
                yield pa.RecordBatch.from_pydict({"q": uids[some][row], "query_id": ids[some][row], "uid": uids[at][col], "id": ids[at][col], "score": score})

    found = both.repartition(*task).sortWithinPartitions(*task).select(*task, "side", "uid", "id", "vec").mapInArrow(rank, "q long, query_id long, uid long, id long, score double")
    order = Window.partitionBy("q").orderBy("score", "id", "uid")
    found = found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return found.select("q", "query_id", "rank", "id", "score")
