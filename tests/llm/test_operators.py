"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import chat, cross_polytope, encoding, graph, jaccard, language, loglinear, packing, pieces, queries, rotation_codes, token_store, toxicity
from faultline.session import new_folder

FOLDER = "/root/testdata/sf0.001"
LONG = "word and word " * 20_000
TEXTS = [
    (1, "The cat sat on the mat, and the dog lay by the door."),
    (2, "The cat sat on the mat, and the dog lay by the door."),
    (2, "the CAT sat on the mat and the dog lay by the door today"),
    (None, "The cat sat on the mat, and the dog lay by the door."),
    (4, None), (5, ""), (6, "  \n "), (7, "one two"), (8, "One, two!"), (9, LONG), (10, LONG + "end"), (11, "it's 12 ½ İ Σας <|endoftext|> é\x1c日本"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that operators use as names of their own results."""
    rows = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    return rows.selectExpr("doc_id", "text", "'x' AS score", "1 AS kept", "'y' AS lang_pred", "2 AS n_links", "3 AS class_id", "4 AS predicted", "cast(null AS string) AS lang")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def token_ids(text, end):
    tokenizer = Tokenizer.from_file(encoding.vocabulary_path())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def place(row):
    return (row[0] is not None, row[0] or 0)


def test_token_store(spark, odd, none):
    path = new_folder(spark, "store")
    token_store.write_store(odd, path, block_bytes=200)
    got = sorted(token_store.read_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in TEXTS), key=lambda x: (x is not None, x or 0))
    wanted = collections.Counter((i, tuple(token_ids(t, 1))) for i, t in TEXTS)
    for row in got:
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(row.ids), crc(row.ids))
        start += row.n_tokens
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == wanted
    found = {r.doc_id: r.ids for r in token_store.lookup(spark, path, [9, 11]).collect()}
    assert found == {9: token_ids(LONG, 1), 11: token_ids(TEXTS[-1][1], 1)}
    path = new_folder(spark, "store")
    token_store.write_store(none, path)
    assert token_store.read_store(spark, path).count() == 0


def test_dictionary_is_trained_and_checked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = new_folder(spark, "store")
    token_store.write_store(docs, path, dictionary_bytes=4096)
    meta = spark.read.parquet(f"{path}/meta").first()
    assert len(meta.dictionary) > 1000
    assert {r.dictionary_hash for r in spark.read.parquet(f"{path}/blocks").collect()} == {meta.dictionary_hash}
    totals = token_store.read_store(spark, path).agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert totals[0] == totals[1]


def test_packing(odd, none):
    got = packing.pack(odd, longest=64).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in got)
    assert all(len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in got)
    order = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted((r.length for r in got), reverse=True)
    total = sum(len(token_ids(t, 2)) for _, t in TEXTS)
    assert sum(r.length for r in got) == total
    for doc_id, text in TEXTS[-3:]:
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist()
        assert ids == token_ids(text, 2) and {r.doc_tokens for r in mine} == {len(ids)}
    assert packing.binary_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and packing.binary_lengths(0, 4096) == []
    assert packing.pack(none).count() == 0


def test_language_is_naive_bayes(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, priors, logs, orders = language.learn(docs)
    rows = docs.select("text", "lang").collect()
    for lang, prior in zip(names, priors, strict=True):
        assert math.isclose(math.exp(prior), sum(r.lang == lang for r in rows) / len(rows))
    # The n-grams of a text, one by one: its letters in lower case, runs of anything else one space.
    text = "Ähm, So  So"
    column = __import__("pyarrow").array([text, "q"])
    got = sum(len(b[r == 0]) for _, _, r, b in language.ngrams(column, orders, 1 << 14))
    clean = " ähm so so "
    assert got == sum(len(clean) - n + 1 for n in orders)
    scored = language.predict(docs, (names, priors, logs, orders))
    assert scored.filter("lang = lang_pred").count() >= 0.97 * len(rows)
    assert scored.filter("score < 0 OR score > 1").count() == 0
    said = {r.text: r for r in language.predict(odd, (names, priors, logs, orders)).collect()}
    assert [said[t].lang_pred for t in (None, "", "  \n ")] == ["und"] * 3 and said[None].score == 0
    assert all(r.lang_pred == "und" for r in language.predict(odd, language.learn(odd)).collect())
    assert language.predict(none, language.learn(none)).count() == 0


def test_toxicity_on_held_out_rows(spark, odd, none):
    folder = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    counts = collections.Counter((r.toxic, r.predicted) for r in got.collect())
    assert counts[1, 1] >= 0.85 * (counts[1, 1] + counts[1, 0])
    assert counts[0, 0] >= 0.95 * (counts[0, 0] + counts[0, 1])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, labels)).count() == len(TEXTS)
    assert {r.score for r in toxicity.score(odd, toxicity.learn(odd, labels.filter("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


def test_negative_risk_is_turned_back():
    """With far too few unlabelled rows the corrected negative risk falls below zero; weights must stay finite."""
    weights, bias = toxicity.fit([np.array([1, 2])] * 50, [np.array([3])] * 10, 0.5, 16)
    assert np.isfinite(weights).all() and math.isfinite(bias)


def shingles(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def classes(items, similar):
    """(links, smallest member) of each item by comparing all pairs."""
    root, links = list(range(len(items))), [0] * len(items)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if similar(items[i], items[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return links, [find(i) for i in range(len(items))]


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard(spark, odd, block):
    got = jaccard.similarity_classes(odd, block=block).collect()
    assert len(got) == len(TEXTS) and set(got[0].asDict()) == set(odd.columns)
    sets = [shingles(t) for _, t in TEXTS]
    links, _ = classes(sets, lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_links) for r in got) == sorted(
        (i is None, i or 0, t or "", n) for (i, t), n in zip(TEXTS, links, strict=True)
    )
    kept = {(r.doc_id, r.text) for r in got if r.kept}
    assert (1, TEXTS[0][1]) in kept and (None, TEXTS[0][1]) not in kept and (7, "one two") in kept and (8, "One, two!") not in kept
    assert {(4, None), (5, ""), (6, "  \n ")} <= kept
    assert {r.class_id for r in got if r.text == TEXTS[0][1]} == {1}


def test_jaccard_of_a_hot_group(spark):
    """Near copies without a single centre, in many small blocks, against all pairs."""
    random = np.random.default_rng(5)
    base = [f"w{x}" for x in random.integers(0, 500, 120)]
    texts = []
    for i in range(70):
        own = list(base)
        for k in random.integers(0, 120, i % 4):
            own[k] = f"x{random.integers(0, 9)}"
        texts.append((i, " ".join(own)))
    rows = spark.createDataFrame(texts, SCHEMA)
    sets = [shingles(t) for _, t in texts]
    links, root = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = sorted(jaccard.similarity_classes(rows, block=8).collect())
    assert [(r.n_links, r.class_id) for r in got] == list(zip(links, root, strict=True))
    assert jaccard.bands_for(0.8, 0.9999, 128) == (24, 5)


def test_components(spark):
    random = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*pairs, (7, None)], "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[node] == min(seen)
    assert set(got) == set(near)


@pytest.fixture(scope="module")
def points(spark):
    random = np.random.default_rng(1)
    x = random.standard_normal((400, 20))
    x[200:260] = x[:1] + 0.1 * random.standard_normal((60, 20))
    x[300:310] = x[299]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 20), (402, [float("nan")] * 20), (403, [1.0, None]), (404, []), (None, x[0].tolist()), (405, [1.0, 2.0]), (5, x[7].tolist())]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(points, block):
    rows, frame = points
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))

    def similar(a, b):
        a, b = a[1], b[1]
        return usable(a) and usable(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9

    links, root = classes(rows, similar)
    got = collections.Counter(tuple(r) for r in rotation_codes.near_vectors(frame, block=block).collect())
    wanted = collections.Counter((i, n, rows[k][0], i == rows[k][0]) for (i, _), n, k in zip(rows, links, root, strict=True))
    assert got == wanted


def test_estimates_are_unbiased_and_bounded():
    random = np.random.default_rng(2)
    import pyarrow as pa

    x = random.standard_normal((300, 64))
    x[150:] = x[:150] + 0.3 * random.standard_normal((150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    code, factor, value, low, step, _ = rotation_codes.encode(x, 1, 8, 0)
    group = pa.table({"code": [c.tobytes() for c in code], "factor": factor, "value": [v.tobytes() for v in value], "low": low, "step": step})
    cosine = x @ x.T
    assert (rotation_codes.estimates(group, 4.5) >= cosine - 1e-6).mean() > 0.9999
    off = ~np.eye(300, dtype=bool)
    assert abs((rotation_codes.estimates(group, 0.0) - cosine)[off].mean()) < 0.06  # the smaller of both directions


def test_neighbours(spark, points):
    rows, frame = points
    got = cross_polytope.search(frame, F.col("id") % 20 == 0, k=5, block=64).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.score, r.vec_id))
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v) and len(v) == 20]
    hits = 0
    for i, q in [x for x in good if x[0] % 20 == 0]:
        true = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i)[:5]
        assert len(found[i]) == 5 and found[i] == sorted(found[i])
        hits += len({j for _, j in true} & {j for _, j in found[i]})
        for score, j in found[i]:
            assert any(j == k and math.isclose(score, float(np.sqrt(((v - q) ** 2).sum())), abs_tol=1e-12) for k, v in good)
    assert hits >= 0.9 * 5 * len(found)
    empty = frame.limit(0)
    assert cross_polytope.search(empty, F.col("id") % 2 == 0).count() == 0 and rotation_codes.near_vectors(empty).count() == 0


def test_pieces(spark, odd, none):
    encoder = pieces.PieceEncoder(encoding.vocabulary_path("piece_bpe_32k.model"), 1)
    more = [(20, "   a"), (21, "a  "), (22, "a▁b ▁"), (23, "tab\tand\nline  two  spaces"), (24, " "), (25, "🙂 \x00x <s> <0x41>")]
    frame = odd.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA))
    encoded = pieces.encode(frame)
    wanted = collections.Counter((i, tuple(encoder.judge.encode(t or ""))) for i, t in [*TEXTS, *more])
    rows = encoded.collect()
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == wanted
    assert all(r.parity and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    assert [r.doc_id for r in rows if not r.round_trip] == [22]  # the marker itself comes back as a space
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode(encoded).filter("doc_id <> 22 OR doc_id IS NULL").collect())
    assert back == collections.Counter((i, t or "") for i, t in [*TEXTS, *more] if i != 22)
    assert pieces.encode(none).count() == 0


def test_unigram_models_are_rebuilt(tmp_path):
    """A small unigram model file, written by hand."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    for name, score, kind in [("<unk>", 0, 2), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], ("▁", -2, 1), ("▁ab", -1, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -2.5, 1), ("c", -4, 1)]:
        model.pieces.add(piece=name, score=score, type=kind)
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    encoder = pieces.PieceEncoder(str(path), 1)
    for text in ["ab abc", "cab b", "aé c", "  ab"]:
        ids, same, back = encoder._segments(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert same.all() and back.all() and ids[0].tolist() == encoder.judge.encode(text)


def test_language_model(spark, odd, none):
    train = [(i, t) for i, t in TEXTS if i != 2]
    got = loglinear.score(odd, odd.filter("doc_id IS NULL OR doc_id <> 2"), vocabulary=6, frequent=10).collect()

    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]

    counts = collections.Counter(x for _, t in train for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(
        (len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for _, t in TEXTS
    )
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == wanted
    assert all(r.score < 0 for r in got)
    assert loglinear.score(none, none).count() == 0
    assert {r.base_score for r in loglinear.score(odd, none).collect()} == {0.0}


def test_language_model_beats_its_base_and_sums_to_one(spark):
    got = queries.op10_language_model(spark, "/root/testdata/sf0.01").filter("held_out")
    assert got.agg(F.sum("score") > F.sum("base_score")).first()[0]
    logs = loglinear.log_table(loglinear.fit(np.random.default_rng(0).integers(0, 9, (12, 12)).astype(float)))
    assert np.allclose((10**logs).sum(axis=1), 1)


def best_path(model, lines):
    e, n = model.emissions(lines), len(model.start)
    score, paths = model.start + e[0], [[i] for i in range(n)]
    for x in e[1:]:
        step = [max(range(n), key=lambda i: score[i] + model.step[i, j]) for j in range(n)]  # noqa: B023
        score, paths = np.array([score[step[j]] + model.step[step[j], j] + x[j] for j in range(n)]), [[*paths[step[j]], j] for j in range(n)]
    return paths[int(score.argmax())]


def test_chat_over_partitions(spark):
    """One long conversation over several partitions decodes as it does in one task."""
    random = np.random.default_rng(4)
    rows = []
    for i in range(300):
        role = ["user", "assistant"][i % 2]
        marker = {"user": "Q: ", "assistant": "A: "}[role] if random.random() < 0.7 else ""
        rows.append((1, i, marker + ("why so? " if i % 2 == 0 else "because.\n" * int(random.integers(1, 4))), role))
    rows += [(None, None, "Q: lone", "user"), (2, 0, None, "user"), (2, 0, "", "user"), (2, 1, "A: x", "assistant"), (2, 1, "A: x", "assistant")]
    frame = spark.createDataFrame(rows, "c long, t long, text string, role string").withColumn("part", F.lit(1))
    held = chat.placed(frame, "c", "t", "text", "role", ranges=6)
    assert held.filter("conv = 1").select("part").distinct().count() > 1
    model = chat.learn(held)
    out = sorted(chat.turns(held, model).filter("conv = 1").collect(), key=lambda r: (r.place, r.piece))
    lines = [x for r in rows if r[0] == 1 for x in r[2].split("\n")]
    states = best_path(model, lines)
    turns = [(model.roles[s // 3], i == 0 or s % 3 == 0 or s // 3 != states[i - 1] // 3) for i, s in enumerate(states)]
    assert sum(r.starts for r in out) == sum(r.ends for r in out) == sum(new for _, new in turns)
    assert [r.role for r in out if r.starts] == [role for role, new in turns if new]
    text = "\n".join(r.rendered for r in out)
    assert text.count("<|end|>") == text.count("<|user|>") + text.count("<|assistant|>")
    empty = chat.placed(frame.limit(0), "c", "t", "text", "role")
    assert chat.turns(empty, chat.learn(empty)).count() == 0


def test_chat_recovers_held_out_roles(spark):
    folder = "/root/testdata/sf0.1"
    true = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("true_role"))
    got = queries.op3_chat(spark, folder).filter("held_out").join(true, ["conv_id", "turn"])
    assert got.agg(F.avg((F.col("role") == F.col("true_role")).cast("int"))).first()[0] > 0.93
