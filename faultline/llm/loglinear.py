"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation, and an add-one base.

Tokens are words (runs of bytes that are not ASCII white space, A-Z lowered) and one end after the last word. All training
documents are counted: token counts by a distributed sum, and the counts of neighbouring tokens over the model's
vocabulary (the ``vocabulary`` most frequent tokens, end and other), at most vocabulary ** 2 figures whatever the input.

Model. s(h, w) = a(h) . r(w) + b(w) for the token w after h; the first token follows an end. Noise-contrastive estimation
tells pairs seen in the corpus from pairs with w drawn from the unigram distribution. Since the pair counts are at hand,
the expectation over the noise is taken exactly and each step uses all of them. Scores are normalized over the whole
vocabulary by one batched matrix product, giving a table of log-probabilities. A token outside the vocabulary gets the
probability of "other" times its own share among such tokens, (c + 1) / (N' + V' + 1), so that texts have probabilities.

Counts of the ``frequent`` most frequent words are broadcast (a fixed bound); all other words of a text go through a join
with the counts. Words are compared by 64-bit hashes.

Rules. Null text is empty: one end. Every row is scored, repeated rows and ids too; only doc_id and text are read. Words
of equal count are ranked by hash. Without training rows N = V = 0, and the base of every token is 1.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import stored
from faultline.llm.encoding import KeyTable
from faultline.llm.textbatch import WINDOW, hash_words, row_of, row_slices, segment_sums, utf8, words

#: The hash that stands for the end token; words with this hash are moved to the next value.
END = np.uint64(1)


def tokens(column: pa.Array):
    """(first row, past-the-end row, hashes of the tokens with ends, offsets of the rows) over whole texts."""
    data, offsets = utf8(column)
    for first, last in row_slices(offsets, 4 * WINDOW):
        part = offsets[first : last + 1] - offsets[first]
        bytes_ = data[offsets[first] : offsets[last]]
        starts, ends = words(bytes_, part)
        keys = hash_words(bytes_, starts, ends, lower=True)
        keys[keys <= END] = END + np.uint64(1)
        bounds = np.searchsorted(starts, part)
        yield first, last, np.insert(keys, bounds[1:], END), bounds + np.arange(last - first + 1)


def count(docs: DataFrame) -> DataFrame:
    """(word, c): the count of every distinct token of ``docs``; word is its hash as a long."""

    def sums(batches):
        for batch in batches:
            for _, _, keys, _ in tokens(batch.column("text")):
                word, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": word.view(np.int64), "n": n.astype(np.int64)})

    found = docs.select("text").mapInArrow(sums, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The frequent words with their counts; the first ``size`` of them are the model's, then end, then other."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray, size: int):
        self.words, self.counts = words_, counts
        self.size = min(size, len(words_))
        self.end, self.other = self.size, self.size + 1

    def table(self) -> KeyTable:
        table = KeyTable(len(self.words))
        table.add(self.words)
        return table


def pairs(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Counts of neighbouring tokens of all ``docs`` over the vocabulary, by (previous, token)."""
    shared, n = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.size + 2

    def sums(batches):
        v = shared.value
        table, total = v.table(), np.zeros(n * n, np.int64)
        for batch in batches:
            for _, _, keys, offsets in tokens(batch.column("text")):
                at = np.where(keys == END, v.end, v.other)
                place = table.find(keys)
                at = np.where((place >= 0) & (place < v.size), place, at)
                before = np.concatenate([[v.end], at[:-1]])
                total += np.bincount(before * n + at, minlength=n * n)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int64), "n": total[cell]})

    rows = docs.select("text").mapInArrow(sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def fit(counts: np.ndarray, size: int = 24, noise: int = 10, steps: int = 120, rate: float = 0.05, penalty: float = 1e-7, seed: int = 7):
    """Context vectors, word vectors and word biases from pair counts, by noise-contrastive estimation."""
    n = len(counts)
    random = np.random.default_rng(seed)
    unigram = counts.sum(axis=0) + 1.0
    unigram /= unigram.sum()
    total = max(counts.sum(), 1.0)
    seen = (counts / total).astype(np.float32)
    drawn = (noise * seen.sum(axis=1, keepdims=True) * unigram[None, :]).astype(np.float32)
    shift = np.log(noise * unigram).astype(np.float32)
    params = [random.normal(0, 0.05, (n, size)).astype(np.float32) for _ in range(2)] + [np.log(unigram).astype(np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        a, r, b = params
        from_corpus = 1 / (1 + np.exp(-np.clip(a @ r.T + b - shift, -30, 30)))
        slope = drawn * from_corpus - seen * (1 - from_corpus)
        slopes = [slope @ r + penalty * a, slope.T @ a + penalty * r, slope.sum(axis=0)]
        for p, g, m in zip(params, slopes, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= rate * (1 - step / (steps + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
    return params


def log_table(params) -> np.ndarray:
    """log10 P(token | previous), normalized over the vocabulary: rows are previous tokens."""
    a, r, b = (p.astype(np.float64) for p in params)
    s = a @ r.T + b
    top = s.max(axis=1, keepdims=True)
    return (s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))) / np.log(10)


def score(docs: DataFrame, train: DataFrame, vocabulary: int = 1022, frequent: int = 1 << 16, **settings) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, learning from ``train``."""
    spark = docs.sparkSession
    counts = stored(count(train), "token_counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    plain = counts.filter(F.col("word") != int(END))
    top = plain.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    ends = sum(r.c for r in counts.filter(F.col("word") == int(END)).collect())
    known = Vocabulary(top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy(), vocabulary)
    own = int(known.counts[: known.size].sum()) + ends
    n_other, v_other = n_all - own, v_all - known.size - (1 if ends else 0)
    logs = log_table(fit(pairs(train, known), **settings)).astype(np.float32)
    shared = spark.sparkContext.broadcast((known, logs))
    schema = (
        "uid long, doc_id long, n_tokens long, n_known long, logs double, model double, n_other long,"
        " rare array<long>, times array<long>"
    )

    def partial(batches):
        v, table_of_logs = shared.value
        table, row_id = v.table(), TaskContext.get().partitionId() << 40
        log_counts = np.append(np.log10(v.counts + 1.0), np.log10(ends + 1.0))
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False) if batch.column("doc_id").null_count == 0 else None
            for first, last, keys, offsets in tokens(batch.column("text")):
                place = table.find(keys)
                is_end, rows = keys == END, last - first
                place[is_end] = len(v.words)
                in_model = place < v.size
                at = np.where(is_end, v.end, np.where((place >= 0) & in_model, place, v.other))
                before = np.concatenate([[v.end], at[:-1]])
                row = row_of(offsets, np.arange(len(keys)))
                weights = table_of_logs[before, at].astype(np.float64)
                held = place >= 0
                each = np.where(held, log_counts[place], 0.0)
                others = (at == v.other) & held
                model = np.bincount(row, weights + np.where(others, each, 0.0), minlength=rows)
                seen = held & (~is_end | (ends > 0))
                order = np.flatnonzero(~held)
                order = order[np.lexsort((keys[order], row[order]))]
                k, r = keys[order], row[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                at_new = np.flatnonzero(new)
                cuts = np.searchsorted(r[at_new], np.arange(rows + 1)).astype(np.int32)
                times = np.diff(at_new, append=len(k))
                ids = doc_ids[first:last] if doc_ids is not None else batch.column("doc_id").slice(first, rows)
                yield pa.RecordBatch.from_pydict({
                    "uid": np.arange(row_id, row_id + rows), "doc_id": ids, "n_tokens": np.diff(offsets),
                    "n_known": segment_sums(seen.astype(np.int64), offsets), "logs": np.bincount(row, each, minlength=rows),
                    "model": model, "n_other": segment_sums((at == v.other).astype(np.int64), offsets),
                    "rare": pa.ListArray.from_arrays(pa.array(cuts), pa.array(k[at_new].view(np.int64))),
                    "times": pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int64))),
                })
                row_id += rows

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = stored(source.mapInArrow(partial, schema), "token_scores")
    rare = held.select("uid", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    found = rare.join(counts, "word").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known")
    )
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    base = float(np.log10(n_all + v_all + 1))
    share = float(np.log10(n_other + v_other + 1))
    return held.drop("rare", "times").join(found, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + more_logs - F.col("n_other") * share).alias("score"),
    )
