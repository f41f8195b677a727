"""Ranked lexical search by NRA over impact-sorted lists.

A term's contribution to a document's score, its impact, is w * ((10**9 * tf) div (1000 * tf + 8 * m)); w weighs rare terms, m long
documents (:func:`weights`, :func:`impacts`). Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased.

Method. Documents are dealt into shards of bounded size; each holds for every query term the list of its documents, highest
impact first. For a query all its lists are read in step and only forward, never at a document's place. What has been read of
a document is its lower bound; adding the last impact read of each list in which it has not been seen gives the upper bound. Reading
goes on until no unseen document can reach the k-th best lower bound and every document that could reach it, a tie
included, has equal bounds: its score is then final. The k-th best score of the shards that a task has finished is where
the next shard's bound starts.

Scale. Query terms travel to the documents, not documents to the queries: one scan counts the terms of the queries in each document, the
counts are stored, and each task reads shards of them. Only the best k rows a task and query are shuffled. Queries are taken in
blocks of about ``most_terms`` distinct terms (a block is never less than one query), so what is broadcast is bounded.
The numbers of documents and terms and the document frequencies are sums over all documents. Terms are compared by 64-bit hashes.

Rules. Every row is a document of its own, also with a repeated or null key; every query row is a query of its own. Null and
empty texts have no terms: they are no documents and find nothing. Equal scores go by the key, null first. Only scores above 0
count. Other columns do not matter.
"""

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm.common import stored
from faultline.llm.textbatch import NOT_ALNUM, WINDOW, hash_words, row_of, row_slices, utf8, words

_FIRST_READ = 128


def term_hashes(column: pa.Array):
    """(first row, past-the-end row, row of each term, hash of each term), in windows over whole texts."""
    data, offsets = utf8(column)
    for first, last in row_slices(offsets, 4 * WINDOW):
        a, part = offsets[first], offsets[first : last + 1] - offsets[first]
        bytes_ = data[a : offsets[last]]
        starts, ends = words(bytes_, part, NOT_ALNUM)
        yield first, last, row_of(part, starts), hash_words(bytes_, starts, ends, lower=True)


def weights(documents: int, frequencies: list[int]) -> list[int]:
    return [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies]


def impacts(tf: np.ndarray, terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """Impacts of weight 1 for ``tf`` occurrences in documents of ``terms`` terms."""
    if len(terms) and 75 * int(terms.max()) * documents >= 1 << 63:
        m = np.array([25 + 75 * int(n) * documents // all_terms for n in terms])
    else:
        m = 25 + 75 * terms * documents // max(all_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Lists(NamedTuple):
    """The lists of a shard: those of term t are ``document`` and ``impact`` from ``start[t]`` to ``start[t + 1]``."""

    start: np.ndarray
    document: np.ndarray
    impact: np.ndarray
    documents: int


def lists_of(document: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, terms: int) -> Lists:
    order = np.lexsort((-impact, term))
    start = np.searchsorted(term[order], np.arange(terms + 1))
    return Lists(start, document[order], impact[order], documents)


def best(lists: Lists, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of all that may be among the best k: those with a score of the k-th best or more, and of ``floor``."""
    begin, size = lists.start[terms], lists.start[terms + 1] - lists.start[terms]
    used = np.flatnonzero(size)
    begin, size, repeats = begin[used].tolist(), size[used].tolist(), repeats[used].tolist()
    lower = np.zeros(lists.documents, np.int64)
    read, last = [0] * len(size), [0] * len(size)
    depth = _FIRST_READ
    while True:
        for i, (a, n, r) in enumerate(zip(begin, size, repeats, strict=True)):
            to = min(n, depth)
            if read[i] < to:
                lower[lists.document[a + read[i] : a + to]] += r * lists.impact[a + read[i] : a + to]
                read[i] = to
                last[i] = 0 if to == n else r * int(lists.impact[a + to - 1])
        unseen = sum(last)
        reach = max(floor, 1, int(np.partition(lower, -k)[-k]) if len(lower) >= k else 0)
        if unseen < reach:
            gap = np.full(lists.documents, unseen)
            for a, n, f in zip(begin, read, last, strict=True):
                if f:
                    gap[lists.document[a : a + n]] -= f
            able = np.flatnonzero(lower + gap >= reach)
            if not gap[able].any():
                return able, lower[able]
        depth *= 4


class Block(NamedTuple):
    """Queries: row number, terms as places in ``vocabulary`` (sorted hashes) and their repeats."""

    rows: list[int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: np.ndarray


def _queries(queries: DataFrame, item: str, text: str) -> DataFrame:
    """Stored queries: row, item, number of distinct terms, their hashes and repeats."""
    held = queries.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*held.schema.fields[:2], *T._parse_datatype_string("n int, terms binary, repeats binary").fields])

    def counted(batches):
        for batch in batches:
            n, terms, repeats = [], [], []
            for first, last, row, found in term_hashes(batch.column(2)):
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    distinct, count = np.unique(found[a:b], return_counts=True)
                    n.append(len(distinct))
                    terms.append(distinct.astype("<u8").tobytes())
                    repeats.append(count.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(terms, pa.binary()), pa.array(repeats, pa.binary())], names=schema.names)

    return stored(held.mapInArrow(counted, schema).filter("n > 0"), "queries")


def _counted(docs: DataFrame, key: str, text: str, shared) -> DataFrame:
    """Documents with terms: key, number of terms, the query terms in them (places in the vocabulary) and how often they occur."""
    held = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([held.schema.fields[0], *T._parse_datatype_string("n long, terms binary, tf binary").fields])

    def counted(batches):
        vocabulary = shared.value.vocabulary
        for batch in batches:
            for first, last, row, found in term_hashes(batch.column(1)):
                many = last - first
                n = np.bincount(row, minlength=many)
                at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
                hit = vocabulary[at] == found
                pairs, tf = np.unique(row[hit] * len(vocabulary) + at[hit], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(many + 1) * len(vocabulary)).tolist()
                terms, tf = (pairs % len(vocabulary)).astype("<u4"), tf.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, many),
                    pa.array(n),
                    pa.array([terms[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([tf[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ], names=schema.names).filter(pa.array(n > 0))

    return stored(held.mapInArrow(counted, schema), "counts")


def _bytes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def _frequencies(counts: DataFrame, terms: int) -> list[int]:
    def summed(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_bytes(batch.column(0), "<u4")[0], minlength=terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": used, "df": total[used]})

    found = counts.select("terms").mapInArrow(summed, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = [0] * terms
    for row in found.collect():
        out[row.term] = row.df
    return out


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 10, most_terms: int = 1 << 20, shard: int = 1 << 14) -> DataFrame:
    """The ``k`` best documents of each query: ``item``, rank (from 1), ``key``, score."""
    asked = _queries(queries, item, text)
    total = asked.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // most_terms))
    found = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).select("row", "terms", "repeats").collect()
        part = _search_block(docs, rows, key, text, k, shard)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = ranked.join(asked.select("row", "item"), "row")
    return named.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _search_block(docs: DataFrame, rows: list, key: str, text: str, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    hashes = [np.frombuffer(r.terms, "<u8") for r in rows]
    vocabulary = np.unique(np.concatenate([*hashes, np.zeros(1, np.uint64)]))
    block = Block([r.row for r in rows], [np.searchsorted(vocabulary, h) for h in hashes], [np.frombuffer(r.repeats, "<i8") for r in rows], vocabulary)
    shared = spark.sparkContext.broadcast(block)
    counts = _counted(docs, key, text, shared)
    documents, all_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = spark.sparkContext.broadcast(np.array(weights(documents, _frequencies(counts, len(vocabulary))), np.int64))
    schema = T.StructType([T.StructField("row", T.LongType()), counts.schema["key"], T.StructField("score", T.LongType())])
    key_type = to_arrow_type(counts.schema["key"].dataType)

    def searched(batches):
        at, w = shared.value, weight.value
        tops = [(np.zeros(0, np.int64), pa.array([], key_type))] * len(at.rows)
        held, rows, postings = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, shard):
                piece = batch.slice(a, shard)
                held.append(piece)
                rows += piece.num_rows
                postings += sum(len(v) for v in piece.column("terms").to_pylist()) // 4
                if rows >= shard or postings >= 1 << 22:
                    _search_shard(held, at, w, tops, k, documents, all_terms)
                    held, rows, postings = [], 0, 0
        if held:
            _search_shard(held, at, w, tops, k, documents, all_terms)
        for row, (scores, keys) in zip(at.rows, tops, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(scores), pa.int64()), keys, pa.array(scores)], names=schema.names)

    return counts.mapInArrow(searched, schema)


def _search_shard(held: list, block: Block, weight: np.ndarray, tops: list, k: int, documents: int, all_terms: int) -> None:
    """Merges the shard's best documents into ``tops`` (scores and keys by query)."""
    rows = pa.Table.from_batches(held).combine_chunks()
    terms, sizes = _bytes(rows.column("terms"), "<u4")
    tf = _bytes(rows.column("tf"), "<u4")[0].astype(np.int64)
    document = np.repeat(np.arange(rows.num_rows), sizes)
    impact = impacts(tf, np.repeat(rows.column("n").to_numpy(), sizes), documents, all_terms) * weight[terms]
    lists = lists_of(document, terms, impact, rows.num_rows, len(weight))
    keys = rows.column("key").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    for i, (mine, repeats) in enumerate(zip(block.terms, block.repeats, strict=True)):
        scores, names = tops[i]
        floor = int(scores[k - 1]) if len(scores) >= k else 1
        able, found = best(lists, mine, repeats, k, floor)
        if len(able):
            scores = np.concatenate([scores, found])
            names = pa.concat_arrays([names, keys.take(pa.array(able))])
            order = pc.sort_indices(
                pa.table({"score": scores, "key": names}), sort_keys=[("score", "descending"), ("key", "ascending")], null_placement="at_start"
            ).slice(0, k)
            tops[i] = scores[order.to_numpy()], names.take(order)
