"""What the review of round 2 found missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import chat, cross_polytope


@pytest.mark.parametrize("sent", [4096, 3])
def test_only_speaker_markers_are_taken_off(spark, monkeypatch, sent):
    """Content prefixes stay; speakers' names go, also those that are not among the markers sent to each worker."""
    monkeypatch.setattr(chat, "_SENT_MARKERS", sent, raising=False)
    rows, wanted = [], {}
    for conv in range(60):
        for turn in range(6):
            role = ["user", "assistant"][turn % 2]
            body = ["Why so?", "Because.", "Note: mind the gap?", "1) Open it.\nNote: slowly.\n2) Close it.\n1) Or not.", "And then?", "Done."][turn]
            name = [f"guest {conv // 3}", f"host {conv // 3}"][turn % 2]
            rows.append((conv, turn, f"{name}: {body}" if conv % 2 else body + "\n", role))
            wanted[conv, turn] = body
    frame = spark.createDataFrame(rows, "c long, t long, text string, role string")
    held = chat.placed(frame, "c", "t", "text", "role", ranges=4)
    out = chat.turns(held, chat.learn(held)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.conv, r.place, r.piece)):
        got[r.conv, r.place] = f"{got[r.conv, r.place]}\n{r.text}" if (r.conv, r.place) in got else r.text
    # A name of which a third of the conversations are bare is seen often enough.
    assert {k: v.strip("\n") for k, v in got.items()} == wanted


def test_rare_markers_decode_as_sent_ones(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    from faultline.llm import queries

    first = queries.op3_chat(spark, folder).orderBy("conv_id", "turn", "piece").collect()
    monkeypatch.setattr(chat, "_SENT_MARKERS", 3)
    assert queries.op3_chat(spark, folder).orderBy("conv_id", "turn", "piece").collect() == first


def test_every_query_finds_k_rows_if_there_are(spark):
    """Queries far from a hot group of copies, a small table of another dimension, and one the sample leaves out."""
    random = np.random.default_rng(6)
    rows = [(i, [1.0] * 16) for i in range(1000)]
    rows += [(2000 + i, random.standard_normal(16).tolist()) for i in range(20)]
    rows += [(3000 + i, random.standard_normal(40).tolist()) for i in range(6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = (F.col("id") < 400) | (F.col("id") >= 2000)
    got = cross_polytope.search(frame, asked, k=10, sample_rows=200, sample_queries=40).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = r.score
    points = {i: np.array(v) for i, v in rows}
    for q in [i for i, _ in rows if i < 400 or i >= 2000]:
        rest = sorted(float(np.sqrt(((v - points[q]) ** 2).sum())) for i, v in points.items() if i != q and len(v) == len(points[q]))
        assert sorted(found[q]) == list(range(1, min(10, len(rest)) + 1))
        if q >= 3000:
            assert np.allclose([found[q][k] for k in sorted(found[q])], rest[:10])
