"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are sums over all training rows: each task adds up its own, the shuffle adds the tasks up,
and the result has at most languages x ``buckets`` rows whatever the input. The log-probability matrix is broadcast, and
texts are scored in numpy: the n-grams of a batch are looked up and summed by text, without a dense vector per text.

Rules. Letters are lowered and everything that is not a letter counts as one space. A text without a letter, a null text,
or any text when nothing was learned, gets ``und`` and score 0. Among equally likely languages the first by name wins.
Rows with null text or lang teach nothing. More columns are carried along by :func:`predict`. More than ``most_languages``
languages raise an error, as the broadcast would have no bound.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import fresh_name
from faultline.llm.textbatch import WINDOW, mixed, row_slices, utf8

UNKNOWN = "und"
_SALTS = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For the characters up to U+FFFF: the lower case, 32 for what is no letter. Above, all count as letters."""
    low = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low[c] = ord(x.lower()) if len(x.lower()) == 1 else c
    return low


_LOW: list[np.ndarray] = []


def ngrams(column: pa.Array, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-the-end row, row of each n-gram in that range, bucket of each n-gram), over whole texts.

    Texts are joined with a space on both sides, runs of spaces count once, and no n-gram crosses two texts.
    """
    if not _LOW:
        _LOW.append(_letters())
    data, offsets = utf8(column)
    head = (data & 0xC0) != 0x80
    for first, last in row_slices(offsets, WINDOW):
        a, b = offsets[first], offsets[last]
        chars = np.frombuffer(data[a:b].tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum(head[a:b])])
        cuts = before[offsets[first : last + 1] - a]
        low = np.where(chars < 1 << 16, _LOW[0].take(np.minimum(chars, 0xFFFF)), chars)
        # A space before each text and one at the end.
        low = np.insert(low, cuts, 32)
        row = np.repeat(np.arange(last - first + 1, dtype=np.int32), np.diff(cuts, append=cuts[-1]) + 1)
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (row[1:] != row[:-1])
        low, row = low[keep].astype(np.uint64), row[keep]
        code = mixed(low + np.uint64(1))
        for n in orders:
            m = len(low) - n + 1
            if m <= 0:
                continue
            value = code[:m] + _SALTS[n - 1]
            for i in range(1, n):
                value = (value << np.uint64(13) | value >> np.uint64(51)) + code[i : m + i]
            # The space that starts the next text ends this one.
            within = (row[:m] == row[n - 1 : m + n - 1]) | ((row[:m] == row[n - 2 : m + n - 2]) & (low[n - 1 : m + n - 1] == 32)) if n > 1 else low[:m] != 32
            bucket = (mixed(value) & np.uint64(buckets - 1)).astype(np.int32)
            yield first, last, row[:m][within], bucket[within]


def has_letter(column) -> F.Column:
    return F.coalesce(F.col(column).rlike("\\p{L}"), F.lit(False))


def learn(docs: DataFrame, orders: tuple[int, ...] = (2, 3), buckets: int = 1 << 14, alpha: float = 0.5, most_languages: int = 256):
    """The model from all rows of ``docs`` (text, lang): names, log priors, log-probability matrix (buckets x names)."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).filter(has_letter("text") & F.col("lang").isNotNull())

    def count(batches):
        names: dict[str, int] = {}
        sums = np.zeros((0, buckets), np.int64)
        docs_of = np.zeros(0, np.int64)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for x in langs:
                names.setdefault(x, len(names))
            if len(names) > most_languages:
                raise ValueError(f"more than {most_languages} languages")
            grow = len(names) - len(sums)
            sums = np.concatenate([sums, np.zeros((grow, buckets), np.int64)])
            docs_of = np.concatenate([docs_of, np.zeros(grow, np.int64)])
            which = np.array([names[x] for x in langs], np.int64)
            docs_of += np.bincount(which, minlength=len(names))
            for first, _, row, bucket in ngrams(batch.column("text"), orders, buckets):
                sums += np.bincount(which[first + row] * buckets + bucket, minlength=sums.size).reshape(sums.shape)
        for name, i in names.items():
            at = np.flatnonzero(sums[i])
            # Bucket -1 holds the number of texts.
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * (len(at) + 1), "bucket": pa.array([-1, *at], pa.int32()), "n": pa.array([docs_of[i], *sums[i][at]], pa.int64())}
            )

    total = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in total.filter("bucket = -1").select("lang").limit(most_languages + 1).collect())
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    got = total.toArrow().to_pydict()  # at most names x (buckets + 1) rows
    of = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), buckets + 1))
    for lang, bucket, n in zip(got["lang"], got["bucket"], got["n"], strict=True):
        counts[of[lang], bucket] = n
    docs_of, counts = counts[:, -1], counts[:, :-1] + alpha
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts
    return names, np.log(docs_of / max(docs_of.sum(), 1)), np.ascontiguousarray(logs.T), orders


def predict(docs: DataFrame, model) -> DataFrame:
    """``docs`` with lang_pred, score (the posterior of the predicted language), n_grams and typicality.

    The posterior only compares the learned languages and nears 1 for any text of some length. Typicality says how the text fits the
    one predicted, whatever its length: the mean log-probability of its n-grams less the mean for texts of that language, in
    standard deviations of a single n-gram. Columns of these four names are replaced.
    """
    names, priors, logs, orders = model
    shares = np.exp(logs)
    usual = (shares * logs).sum(axis=0)
    spread = np.sqrt(np.maximum((shares * logs**2).sum(axis=0) - usual**2, 1e-12))
    shared = docs.sparkSession.sparkContext.broadcast((priors, logs, usual, spread))
    column = fresh_name("prediction")
    schema = T.StructType([
        *docs.schema.fields, T.StructField(column, T.IntegerType()), T.StructField(f"{column}_score", T.DoubleType()),
        T.StructField(f"{column}_n", T.LongType()), T.StructField(f"{column}_fit", T.DoubleType()),
    ])
    text_at = docs.columns.index("text")

    def score(batches):
        prior, matrix, usual, spread = shared.value
        for batch in batches:
            sums, n = np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows, np.int64)
            for first, last, row, bucket in ngrams(batch.column(text_at), orders, len(matrix)):
                found = matrix[bucket]
                n[first:last] += np.bincount(row, minlength=last - first)[: last - first]
                for k in range(len(names)):
                    sums[first:last, k] += np.bincount(row, found[:, k], minlength=last - first)[: last - first]
            each = sums / np.maximum(n, 1)[:, None]
            sums += prior
            best = sums.argmax(axis=1)
            fit = (each[np.arange(len(best)), best] - usual[best]) / spread[best]
            top = 1 / np.exp(sums - sums[np.arange(len(sums)), best][:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(top), pa.array(n), pa.array(fit)], names=schema.names)

    lettered = has_letter("text")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "n_grams", "typicality")]
    if not names:
        none = [F.lit(0).cast("long").alias("n_grams"), F.lit(None).cast("double").alias("typicality")]
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *none)
    scored = docs.mapInArrow(score, schema)
    known = F.array(*[F.lit(x) for x in names])
    return scored.select(
        *kept, F.when(lettered, known[F.col(column)]).otherwise(UNKNOWN).alias("lang_pred"), F.when(lettered, F.col(f"{column}_score")).otherwise(0.0).alias("score"),
        F.col(f"{column}_n").alias("n_grams"), F.when(lettered, F.col(f"{column}_fit")).alias("typicality"),
    )


def in_language(least: float = -2.0, margin: float = 6.0) -> F.Column:
    """Whether a row of :func:`predict` is a text of its language: typicality of at least ``least`` less ``margin`` standard errors, so that
    few n-grams, whose mean says little, are not held against a text."""
    error = F.lit(margin) / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1)))
    return (F.col("lang_pred") != UNKNOWN) & (F.col("typicality") >= F.lit(least) - error)
