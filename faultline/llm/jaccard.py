"""Similarity join on word n-grams: MinHash bands find candidates, whole n-gram sets decide.

1. One pass over the texts gives each row its set's fingerprint and one hash per band. Rows of equal sets form a class and
   go on as one representative with a number of copies.
2. The band count and the rows per band are chosen so that a pair at the threshold meets in some band with the target
   recall (:func:`bands_for`). Representatives are shuffled on band hashes; buckets of one member are dropped, and of buckets with
   the same members only the one of the lowest band is kept.
3. A bucket is compared in blocks of bounded size, so that a hot one is many tasks. A task gets the texts of its members,
   builds their n-gram sets, counts common n-grams by matrix products and keeps the pairs at or above the threshold. A
   pair counts in the first band it shares, so every link counts once although no pair is written out.
4. A task returns each member's number of links and a spanning forest of them; components of these give the classes.

Words are runs of letters and digits, A-Z lowered; sets are of 52-bit hashes of ``n`` words. Rules: a text of 1 to n - 1 words has
one n-gram, all its words; texts without a word and null texts link with nothing. Every row is a document of its own, also
with a repeated or null doc_id. The smallest doc_id of a class stays (null ids last; the earliest row among equal ids).
All columns of the input are kept; those called class_id, n_links or kept are replaced.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import LINKS, TASK, bucket_tasks, first_links, groups, link_rows, stored
from faultline.llm.graph import components
from faultline.llm.textbatch import NOT_ALNUM, WINDOW, hash_words, mixed, row_of, row_slices, utf8, words

_BITS = np.uint64(52)
_LOW = np.uint64((1 << 52) - 1)


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows per band): as many rows as the hashes allow such that a pair at ``threshold`` meets with ``recall``."""
    best = None
    for rows in range(1, most_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def ngram_sets(column: pa.Array, n: int):
    """(first row, past-the-end row, sorted n-gram hashes of each row one after the other, offsets), distinct by row."""
    data, offsets = utf8(column)
    for first, last in row_slices(offsets, 4 * WINDOW):
        for low in range(first, last, 4000):  # the row of a hash must fit above its 52 bits
            high = min(low + 4000, last)
            part = offsets[low : high + 1] - offsets[low]
            bytes_ = data[offsets[low] : offsets[high]]
            starts, ends = words(bytes_, part, NOT_ALNUM)
            keys = hash_words(bytes_, starts, ends, lower=True)
            row = row_of(part, starts)
            bounds = np.searchsorted(starts, part)
            short = np.diff(bounds) < n
            value = np.zeros(len(keys), np.uint64)
            for i in range(n):
                shifted = np.zeros(len(keys), np.uint64)
                shifted[: max(len(keys) - i, 0)] = keys[i:]
                if i:  # words of the next text do not count
                    shifted[np.minimum(np.arange(len(keys)) + i, len(keys)) >= bounds[row + 1]] = 0
                value = (value << np.uint64(9) | value >> np.uint64(55)) + mixed(shifted + np.uint64(i))
            at = np.arange(len(keys))
            whole = (at + n <= bounds[row + 1]) | (short[row] & (at == bounds[row]))
            grams = (row[whole].astype(np.uint64) << _BITS) | (mixed(value[whole]) & _LOW)
            grams = np.unique(grams)
            cuts = np.searchsorted(grams, np.arange(high - low + 1).astype(np.uint64) << _BITS)
            yield low, high, grams & _LOW, cuts


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 11) -> DataFrame:
    """``docs`` with _uid, _k1 and _k2 (fingerprint of the set), _n (its size) and _bands."""
    schema = T.StructType(
        docs.schema.fields
        + [T.StructField(c, T.LongType()) for c in ("_uid", "_k1", "_k2", "_n")]
        + [T.StructField("_bands", T.ArrayType(T.LongType()))]
    )
    text_at = docs.columns.index("text")
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, grams, cuts in ngram_sets(batch.column(text_at), n):
                size = np.diff(cuts)
                filled = np.flatnonzero(size)
                spread = mixed(grams)
                keys = np.zeros((2, last - first), np.uint64)
                least = np.zeros((bands * rows, len(filled)), np.uint64)
                if len(filled):
                    begin = cuts[:-1][filled]
                    keys[0, filled] = np.add.reduceat(spread, begin)
                    keys[1, filled] = np.add.reduceat(mixed(spread ^ shifts[0]), begin)
                    held = np.empty_like(spread)
                    for k in range(bands * rows):
                        np.multiply(spread, factors[k], out=held)
                        held ^= shifts[k]
                        least[k] = np.minimum.reduceat(held, begin)
                hashes = np.zeros((len(filled), bands), np.uint64)
                for b in range(bands):
                    value = np.full(len(filled), b + 1, np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        value = mixed(value + least[k])
                    hashes[:, b] = value
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                own = [pa.array(np.arange(uid, uid + last - first))]
                own += [pa.array(k.view(np.int64)) for k in keys] + [pa.array(size)]
                own += [pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.reshape(-1).view(np.int64)))]
                uid += last - first
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=schema.names)

    return docs.mapInArrow(sign, schema)


def common_counts(grams: np.ndarray, cuts: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """How many hashes each two sets have in common: products of their incidence matrices, by columns."""
    n = len(cuts) - 1
    row = np.repeat(np.arange(n), np.diff(cuts))
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((n, n), np.float32), int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, chunk):
        low, high = np.searchsorted(column, [a, a + chunk])
        cells = np.zeros((n, min(chunk, width - a)), np.float32)
        cells[row[low:high], column[low:high] - a] = 1
        out += cells @ cells.T
    return out


def similarity_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128, block: int = 256, block_ngrams: int = 1 << 19
) -> DataFrame:
    """``docs`` with class_id, n_links (documents linked directly: equal sets, or similarity of at least ``threshold``)
    and kept (one row of each class)."""
    bands, rows = bands_for(threshold, recall, most_hashes)
    docs = docs.drop("class_id", "n_links", "kept")
    # Other columns travel in one struct, so that none can have the name of one of ours.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []
    held = stored(signatures(docs.select("doc_id", "text", *row), n, bands, rows), "signatures")
    key = ["_k1", "_k2", "_n"]
    # Null ids count as the largest.
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_uid").alias("uid"))
    classes = stored(
        held.filter("_n > 0").groupBy(*key).agg(
            F.min("_uid").alias("rep"), F.count("*").alias("copies"), F.min(place).alias("first"), F.any_value("_bands").alias("bands")
        ),
        "classes",
    )
    banded = classes.select("rep", "_n", F.posexplode("bands").alias("band", "hash"))
    members = stored(bucket_tasks(banded, block, "_n", block_ngrams), "members")
    wanted = members.select("rep").distinct().join(classes.select("rep", "copies", "bands"), "rep")
    texts = held.select(F.col("_uid").alias("rep"), "text").join(wanted, "rep")
    tasks = members.join(texts, "rep").repartition(*TASK).sortWithinPartitions(*TASK)

    def verify(batches):
        for group in groups(batches, *TASK):
            size = group.num_rows
            if size < 2:
                continue
            grams, cuts = [], [np.zeros(1, np.int64)]
            for _, _, g, c in ngram_sets(group.column("text").combine_chunks(), n):
                grams.append(g)
                cuts.append(c[1:] + cuts[-1][-1])
            cuts = np.concatenate(cuts)
            common = common_counts(np.concatenate(grams), cuts)
            own = np.diff(cuts)
            near = common >= threshold * (own[:, None] + own[None, :] - common) - 1e-6
            hashes = group.column("bands").combine_chunks().flatten().to_numpy().reshape(size, bands)
            near = first_links(near, group, hashes)
            found = link_rows(near, group.column("rep").to_numpy(), group.column("copies").to_numpy())
            if found:
                yield found

    found = stored(
        tasks.select(*TASK, "own", "rep", "copies", "bands", "text").mapInArrow(verify, LINKS), "links"
    )
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).withColumnsRenamed({"node": "rep"})
    joined = classes.select("rep", *key, "copies", "first").join(links, "rep", "left").join(roots, "rep", "left")
    joined = joined.withColumn("root", F.coalesce("root", "rep"))
    # Written, so that the join is a stage of its own and splits a root that very many texts have.
    first = stored(joined.groupBy("root").agg(F.min("first").alias("keeper")), "roots")
    joined = joined.join(first, "root").select(
        *key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "keeper", F.lit(True).alias("worded")
    ).filter("n_links > 0")
    placed = held.drop("_bands").join(joined, key, "left")
    return placed.select(
        *[F.col(f"row.`{c}`" if c in rest else c).alias(c) for c in docs.columns],
        F.when(F.col("worded"), F.col("keeper.doc_id")).otherwise(F.col("doc_id").cast("long")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("keeper.uid") == F.col("_uid"), F.lit(True)).alias("kept"),
    )
