"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled texts; labels other than toxic are never used as negatives. With
the class prior p of toxic texts among the unlabelled, the risk of a scorer g under a loss l is estimated as

    p * mean over toxic of l(g)  +  max(0, mean over unlabelled of l(-g)  -  p * mean over toxic of l(-g)),

and where the second term is below zero a step is taken that raises it (it can only be negative by overfitting). Texts
are sets of hashed words and word beginnings, so neither length nor repetition counts. Features that are no more (or less)
frequent in toxic texts than chance allows are left out, which keeps noise out of long texts.

The classifier is fitted on a bounded sample (``most_toxic`` and ``most_unlabelled`` rows and 128 MB of text each, those with the
smallest hashes of their ids); scoring reads every whole text.

Rules. Null and empty texts have no feature and get the score of the intercept. Without a toxic training text every score
is 0. Labels are 0 or 1; null or repeated labels of a document: toxic if any row says so. Other columns are carried along.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import fresh_name
from faultline.llm.textbatch import NOT_ALNUM, WINDOW, hash_words, mixed, row_of, row_slices, utf8, words

_PREFIXES = (4, 5, 6)


def features(column: pa.Array, buckets: int):
    """(first row, past-the-end row, distinct row * buckets + bucket), over whole texts: words and word beginnings."""
    data, offsets = utf8(column)
    for first, last in row_slices(offsets, 4 * WINDOW):
        a, part = offsets[first], offsets[first : last + 1] - offsets[first]
        bytes_ = data[a : offsets[last]]
        starts, ends = words(bytes_, part, NOT_ALNUM)
        row = row_of(part, starts) * buckets
        found = []
        for n in (0, *_PREFIXES):
            longer = ends - starts > n
            begin = starts[longer]
            keys = hash_words(bytes_, begin, np.minimum(ends[longer], begin + n) if n else ends[longer], lower=True)
            found.append(row[longer] + (mixed(keys + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64))
        yield first, last, np.unique(np.concatenate(found))


def _rows(df: DataFrame, buckets: int) -> list[np.ndarray]:
    """The feature sets of a bounded number of rows."""

    def sets(batches):
        for batch in batches:
            for first, last, found in features(batch.column("text"), buckets):
                cuts = np.searchsorted(found, np.arange(last - first + 1) * buckets)
                of = found & (buckets - 1)
                yield pa.RecordBatch.from_pydict({"f": [of[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return [np.frombuffer(r.f, "<u4") for r in df.select("text").mapInArrow(sets, "f binary").collect()]


def _first(df: DataFrame, n: int, key: str, most_bytes: int = 1 << 27) -> DataFrame:
    """At most ``n`` rows, of at most ``most_bytes`` bytes of text together: those with the smallest hashes of ``key``.

    ``df`` has key, text, and from where it is read a number (``uid``) and the length (``size``) of every row; only these are sorted.
    """
    rows = df.select("uid", F.xxhash64(key).alias("h"), key, "size")
    uids, total = [], 0
    for row in rows.orderBy("h", key, "uid").limit(n).select("uid", "size").collect():
        total += row.size
        if uids and total > most_bytes:
            break
        uids.append((row.uid,))
    return df.join(F.broadcast(df.sparkSession.createDataFrame(uids, "uid long")), "uid", "left_semi")


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, buckets: int, steps: int = 200, rate: float = 0.1, penalty: float = 1e-4):
    """Weights by bucket and intercept; full-batch Adam on the non-negative risk."""
    n_p, n_u = len(toxic), max(len(unlabelled), 1)
    df_p = np.bincount(np.concatenate(toxic), minlength=buckets)
    df_u = np.bincount(np.concatenate(unlabelled), minlength=buckets) if unlabelled else np.zeros(buckets, int)
    share = (df_p + df_u) / (n_p + n_u)
    spread = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12
    z = (df_p / n_p - df_u / n_u) / spread
    used = np.flatnonzero((np.abs(z) > 5) & (df_p + df_u >= 5))
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))

    def flat(rows):
        size = np.array([len(x) for x in rows], np.int64)
        at = place[np.concatenate(rows)] if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), size)
        return row[at >= 0], at[at >= 0], len(rows)

    sides = {"p": flat(toxic), "u": flat(unlabelled)}
    w, bias = np.zeros(len(used)), np.log(prior / (1 - prior))
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1):
        g = {k: bias + np.bincount(r, w[c], minlength=n) for k, (r, c, n) in sides.items()}
        # Derivatives of the logistic loss l(g) = log(1 + exp(-g)) and of l(-g) = log(1 + exp(g)).
        kept = np.log1p(np.exp(np.clip(g["u"], -50, 50))).mean() if len(g["u"]) else 0.0
        rest = kept - prior * np.log1p(np.exp(np.clip(g["p"], -50, 50))).mean()
        as_negative = {"p": -prior * sigmoid(g["p"]) / n_p, "u": sigmoid(g["u"]) / n_u}
        if rest >= 0:
            d = {"p": prior * (sigmoid(g["p"]) - 1) / n_p + as_negative["p"], "u": as_negative["u"]}
        else:
            d = {k: -v for k, v in as_negative.items()}
        slope = sum(np.bincount(c, d[k][r], minlength=len(w)) for k, (r, c, _) in sides.items()) + penalty * w
        slope = np.append(slope, sum(x.sum() for x in d.values()))
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(buckets)
    weights[used] = w
    return weights, float(bias)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", prior: float | None = None, buckets: int = 1 << 18, most_toxic: int = 4000, most_unlabelled: int = 12000):
    """The classifier from the rows of ``docs`` (training rows only) and ``labels`` (``key``, toxic). The class prior is
    the share of toxic rows among the labelled ones unless given (0.1 if all labelled rows are toxic)."""
    said = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    docs = docs.select(key, "text", F.monotonically_increasing_id().alias("uid"), size)
    marked = docs.join(said, key)
    confirmed = marked.filter("toxic = 1")
    toxic = _rows(_first(confirmed, most_toxic, key), buckets)
    if not toxic:
        return None
    if prior is None:
        ones, rows = said.join(docs.select(key).distinct(), key, "left_semi").agg(F.sum("toxic"), F.count("*")).first()
        prior = ones / rows if ones < rows else 0.1
    unlabelled = _rows(_first(docs.dropna(subset=[key]), most_unlabelled, key), buckets)
    return fit(toxic, unlabelled, min(max(prior, 1e-4), 0.9), buckets)


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = fresh_name("score")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    text_at = docs.columns.index("text")

    def scored(batches):
        weights, bias = shared.value
        for batch in batches:
            g = np.full(batch.num_rows, bias)
            for first, last, found in features(batch.column(text_at), len(weights)):
                values = weights[found & (len(weights) - 1)]
                hit = values != 0
                g[first:last] += np.bincount(found[hit] // len(weights), values[hit], minlength=last - first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(g, -50, 50))))], names=schema.names)

    done = docs.mapInArrow(scored, schema)
    return done.select(*kept, F.col(column).alias("score"), (F.col(column) >= 0.5).cast("int").alias("predicted"))
