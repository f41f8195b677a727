"""What the review of round 3 found: names, samples, stages on odd input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import encoding, jaccard, language, token_store, toxicity
from faultline.session import new_folder
from tests.llm.test_operators import LONG, TEXTS

FOLDER = "/root/testdata/sf0.01"
SAME = "the cat sat on the mat and the dog lay by the door"


def test_jaccard_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, SAME), (2, SAME + " today"), (3, "something else"), (None, SAME)], "doc_id long, text string")
    odd = rows.selectExpr("*", "'a' AS _n", "'b' AS _uid", "1 AS _k1", "2 AS _k2", "array(1) AS _bands", "'c' AS keeper", "'d' AS worded", "3 AS root", "4 AS rep", "5 AS row", "6 AS class_id")
    got = jaccard.similarity_classes(odd)
    assert got.columns == [*[c for c in odd.columns if c != "class_id"], "class_id", "n_links", "kept"]
    assert sorted((r.doc_id or 0, r.class_id, r.n_links, r.kept, r._n, r._bands, r.root, r.row) for r in got.collect()) == [
        (0, 1, 2, False, "a", [1], 3, 5), (1, 1, 2, True, "a", [1], 3, 5), (2, 1, 2, False, "a", [1], 3, 5), (3, 3, 0, True, "a", [1], 3, 5),
    ]


def test_toxicity_sample_is_bounded(spark):
    """One id on very many rows, and long texts, stay within rows and bytes."""
    rows = spark.range(5000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("words "), F.col("id")).alias("text"), F.col("id").alias("uid"), F.lit(8).alias("size"))
    assert toxicity._first(rows, 400, "doc_id").count() == 400
    assert toxicity._first(rows, 400, "doc_id", most_bytes=100).count() < 15
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    docs = rows.drop("uid", "size").withColumn("uid", F.lit("mine"))
    scored = toxicity.score(docs, toxicity.learn(docs, labels, most_toxic=50, most_unlabelled=50))
    assert scored.count() == 5000 and scored.first().uid == "mine"


@pytest.mark.parametrize("words, least", [(20, 1 << 14), (8, 500)])
def test_dictionary_for_short_documents(spark, words, least):
    """Short documents, and small tables, get a shared dictionary that makes them smaller."""
    many = 20_000 if words == 20 else 2_000
    pool = ["alpha", "river", "stone", "green", "quickly", "seven", "market", "window"]
    text = F.concat_ws(" ", *[F.array(*map(F.lit, pool))[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(8)).cast("int")] for i in range(words)])
    docs = spark.range(many).select(F.col("id").alias("doc_id"), text.alias("text"))
    sizes = {}
    for size in (1 << 15, 0):
        path = new_folder(spark, "store")
        token_store.write_store(docs, path, dictionary_bytes=size)
        meta = spark.read.parquet(f"{path}/meta").first()
        assert len(meta.dictionary) >= least if size else meta.dictionary == b""
        sizes[size] = spark.read.parquet(f"{path}/blocks").agg(F.sum(F.length("payload"))).first()[0]
        assert token_store.read_store(spark, path).count() == many
    assert sizes[1 << 15] < 0.9 * sizes[0]
    assert encoding.vocabulary_path()


def test_typicality_tells_noise_from_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learn(docs)
    noise = ["qwertz asdfgh yxcvbn asdf jklo qwer uiop zxcv bnm", "Съешь ещё этих мягких французских булок да выпей чаю", "xqzj vkwq zzxq kjqx vvqz qqkx jjvz", "日本語の文章です。これは長い文です。それから、もう一つ。"]
    clean = ["the of and", "Die der und.", "El de la", "le la de les", "Be."]
    texts = spark.createDataFrame([(t, t in clean) for t in noise + clean], "text string, good boolean")
    got = {r.text: r for r in language.predict(texts, model).withColumn("kept", language.in_language()).collect()}
    assert all(r.kept == r.good for r in got.values()), {k: (r.typicality, r.n_grams) for k, r in got.items() if r.kept != r.good}
    # By hand, for one text.
    names, priors, logs, orders = model
    import numpy as np
    import pyarrow as pa

    found = np.concatenate([b for *_, b in language.ngrams(pa.array(["Die der und."]), orders, len(logs))])
    k = names.index(got["Die der und."].lang_pred)
    p = np.exp(logs[:, k])
    mean = (p * logs[:, k]).sum()
    want = (logs[found, k].mean() - mean) / np.sqrt((p * (logs[:, k] - mean) ** 2).sum())
    assert got["Die der und."].typicality == pytest.approx(want) and got["Die der und."].n_grams == len(found)
    # All but very few of the documents are texts of their languages.
    assert language.predict(docs, model).filter(~language.in_language() & language.has_letter("text")).count() <= 0.002 * docs.count()


def test_language_stage_decides(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bad = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(["12 34", "zxqj vkwq kjxq wvzx " * 20, "Съешь ещё этих мягких булок " * 5])], docs.schema)
    kept = corpus_pipeline.in_a_language(spark, docs.unionByName(bad), FOLDER)
    assert kept.filter("doc_id >= 1000000000").count() == 0 and kept.count() > 0.99 * docs.filter(language.has_letter("text")).count()
    # Without any known language nothing is judged and nothing goes.
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.in_a_language(spark, blank, FOLDER).count() == docs.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows(spark, name, stage):
    """Null, empty and very long texts, repeated and null ids, columns of any name, and an empty table."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.limit(40).select("doc_id", "text", F.col("lang"), "source", "n_chars")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in TEXTS], docs.schema)
    extra = some.unionByName(odd).selectExpr("*", "'x' AS score", "1 AS predicted", "'y' AS lang_pred", "2 AS n_grams", "3 AS typicality", "4 AS class_id_", "'z' AS uid", "5 AS _n", "'r' AS row")
    out = stage(spark, extra, FOLDER)
    if name != "packing":
        assert out.columns == extra.columns
        held = out.collect()
        assert 0 < len(held) <= extra.count() and all(r.score == "x" and r.uid == "z" and r._n == 5 for r in held)
        assert any(r.text == LONG for r in held) or name == "language"
    else:
        assert out.select("doc_id").distinct().count() == extra.select("doc_id").distinct().count()
    assert stage(spark, extra.limit(0), FOLDER).count() == 0
