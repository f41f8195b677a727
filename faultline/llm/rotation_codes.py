"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is padded with zeros to D dimensions and rotated at random; its code is the vector of its signs, o' = signs / sqrt(D),
kept with the correction factor <o', o>. For another rotated unit vector q, <o', q> / <o', o> is an unbiased estimate of the
cosine <o, q>, with an error of about sqrt((1 - f^2) / f^2 / (D - 1)), f being the factor. The q of an estimate is itself kept in
four bits a dimension, rounded at random so that the estimate stays unbiased; this adds at most half a step of error.

1. Equal vectors are one representative. Bits of the codes, in ``tables`` groups, give the buckets in which vectors are
   compared; number and width of the groups follow from the number of vectors, the threshold and the target recall.
2. In a bucket (hot ones in blocks), codes and factors alone give an estimate and a confidence bound for each pair.
3. Only members of pairs whose upper bound reaches the threshold are joined with their vectors, and the cosine is computed in
   double precision; that value alone decides. Each pair counts in the first table it shares.

Rules. Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different
dimensions do not link. Every row counts, also of repeated or null ids; null ids rank behind all others.
"""

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import vectors as V
from faultline.llm.common import LINKS, TASK, bucket_tasks, first_links, groups, link_rows, stored
from faultline.llm.graph import components
from faultline.llm.textbatch import mixed


@lru_cache(maxsize=8)
def rotation(dim: int, number: int) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of D dimensions, D a multiple of 64 and 128 at least."""
    size = max(128, -(-dim // 64) * 64)
    random = np.random.default_rng([number, dim])
    q, r = np.linalg.qr(random.standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def tables_for(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(tables, bits): bits for about ``bucket`` vectors in a bucket, tables for ``recall`` at the threshold."""
    bits = min(max(math.ceil(math.log2(max(n, 1) / bucket)), 4), 40)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - p)), bits


def encode(x: np.ndarray, tables: int, bits: int, seed: int):
    """Codes, factors, four-bit values with their lowest value and step, and table hashes of unit vectors."""
    dim = x.shape[1]
    x = x.astype(np.float32)
    first = x @ rotation(dim, 0)
    size = first.shape[1]
    code = first > 0
    factor = np.abs(first).sum(axis=1) / math.sqrt(size)
    low = first.min(axis=1)
    step = np.maximum((first.max(axis=1) - low) / 15, 1e-12)
    random = np.random.default_rng(seed)
    value = np.floor((first - low[:, None]) / step[:, None] + random.random(first.shape, np.float32)).clip(0, 15).astype(np.uint8)
    signs = [code]
    while sum(s.shape[1] for s in signs) < tables * bits:
        signs.append(x @ rotation(dim, len(signs)) > 0)
    used = np.concatenate(signs, axis=1)[:, : tables * bits].reshape(len(x), tables, bits)
    hashes = (used * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    hashes = mixed(hashes * np.uint64(4096) + np.uint64(dim)) ^ mixed(np.arange(1, tables + 1, dtype=np.uint64))[None, :]
    return np.packbits(code, axis=1), factor, value[:, ::2] | value[:, 1::2] << 4, low, step, hashes.view(np.int64)


def estimates(group: pa.Table, confidence: float) -> np.ndarray:
    """Upper confidence bounds of the cosines between all rows of a group, from codes only."""
    code = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(group.num_rows, -1)
    value = np.frombuffer(b"".join(group.column("value").to_pylist()), np.uint8).reshape(group.num_rows, -1)
    factor, low, step = (group.column(c).to_numpy() for c in ("factor", "low", "step"))
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    size = signs.shape[1]
    q = np.empty((len(value), size), np.float32)
    q[:, ::2], q[:, 1::2] = value & 15, value >> 4
    q = q * step[:, None] + low[:, None]
    cosine = (signs @ q.T) / (math.sqrt(size) * factor[:, None])
    error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (size - 1))[:, None] + step[None, :] / (2 * factor[:, None])
    bound = cosine + confidence * error
    return np.minimum(bound, bound.T)


def near_vectors(
    table: DataFrame, threshold: float = 0.9, recall: float = 0.999, confidence: float = 4.5, bucket: int = 64, block: int = 1024,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(``key``, n_links, component_id, kept) for every row: the number of other rows with a cosine of at least
    ``threshold``, the smallest id reachable by links, and whether that is the row's own id."""
    held = stored(V.rows(table, key, column), "vectors")
    place = F.struct(F.col("id").isNull().alias("null_id"), F.col("id").alias("id"))
    classes = stored(
        held.filter("vec is not null").groupBy("dim", "vec").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.min(place).alias("first")),
        "vector_classes",
    )
    tables, bits = tables_for(classes.count(), threshold, recall, bucket)

    def codes(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                reps = part.column("rep").to_numpy()
                for a in range(0, len(reps), 2048):
                    some = part.slice(a, 2048)
                    code, factor, value, low, step, hashes = encode(V.unit(V.matrix(some.column("vec"))), tables, bits, zlib.crc32(reps[a].tobytes()))
                    yield pa.RecordBatch.from_pydict({
                        "rep": reps[a : a + 2048], "code": [x.tobytes() for x in code], "factor": factor, "value": [x.tobytes() for x in value],
                        "low": low, "step": step, "tables": pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, tables, dtype=np.int32), hashes.reshape(-1)),
                    })

    coded = stored(
        classes.select("rep", "dim", "vec").mapInArrow(codes, "rep long, code binary, factor float, value binary, low float, step float, tables array<long>"),
        "codes",
    )
    banded = coded.select("rep", F.posexplode("tables").alias("band", "hash"))
    members = stored(bucket_tasks(banded, block), "members")
    compared = members.join(coded.drop("tables"), "rep").repartition(*TASK).sortWithinPartitions(*TASK)

    def candidates(batches):
        for group in groups(batches, *TASK):
            near = estimates(group, confidence) >= threshold
            np.fill_diagonal(near, False)
            if group.column("i")[0] != group.column("j")[0]:
                own = group.column("own").to_numpy()
                near &= own[:, None] != own[None, :]
            hit = np.flatnonzero(near.any(axis=1))
            if len(hit):
                yield from group.select([*TASK, "own", "rep"]).take(hit).to_batches()

    wanted = "band int, hash long, i int, j int, own int, rep long"
    close = stored(compared.select(*TASK, "own", "rep", "code", "factor", "value", "low", "step").mapInArrow(candidates, wanted), "candidates")
    exact = close.join(classes.select("rep", "vec", "copies"), "rep").join(coded.select("rep", "tables"), "rep")

    def verify(batches):
        for group in groups(batches, *TASK):
            x = V.unit(V.matrix(group.column("vec")))
            hashes = group.column("tables").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            near = first_links(x @ x.T >= threshold, group, hashes)
            found = link_rows(near, group.column("rep").to_numpy(), group.column("copies").to_numpy())
            if found:
                yield found

    exact = exact.repartition(*TASK).sortWithinPartitions(*TASK)
    links = stored(exact.select(*TASK, "own", "rep", "copies", "tables", "vec").mapInArrow(verify, LINKS), "links")
    roots = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    sums = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = classes.join(sums, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    first = stored(joined.groupBy("root").agg(F.min("first").alias("least")), "roots")
    joined = joined.join(first, "root").select(
        "dim", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least.id").alias("least")
    )
    out = held.join(joined, ["dim", "vec"], "left").withColumn("component_id", F.when(F.col("n_links").isNotNull(), F.col("least")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
