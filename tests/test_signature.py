import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import signature as G
from tests import models

PIECES = [
    '"', "'", "0x", "0X1f", "0xg", "7", "42", "300", "10.0.0.1", "1.2.3.256", "9.8.7.6:5432", ":",
    "255.1.1.1x", "_", "a", "-", ".", " ", "\t", "\n", "\r", "\x0b", "\x0c", "é", "ß9", "",
    "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-4266141740001.2.3.4", "beef",
]
FRAME_PIECES = [
    "+", "0x", "+0x1f", "+0X", ":12", ":", " ", "\t", "main.go", "(0xc0de, 0x1)", "ab", "é", "9",
]


def texts(pieces, count, longest=12):
    rng = random.Random(7)
    return ["".join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(count)]


def run(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    found = rows.select("i", expression(F.col("v")).alias("t")).collect()
    return [row.t for row in sorted(found)]


def test_message_template_equals_model(spark):
    values = texts(PIECES, 20_000)
    found = run(spark, values, G.normalize_message)
    wrong = [(v, g) for v, g in zip(values, found) if g != models.message_template(v)]
    assert wrong[:3] == []


def test_frame_template_equals_model(spark):
    values = texts(FRAME_PIECES, 10_000, 8)
    found = run(spark, values, G.normalize_frame)
    wrong = [(v, g) for v, g in zip(values, found) if g != models.frame_template(v)]
    assert wrong[:3] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet="0x19af.:-'\" \n_zé", max_size=40), min_size=50, max_size=50))
def test_any_text(spark, values):
    assert run(spark, values, G.normalize_message) == [models.message_template(v) for v in values]


@pytest.mark.parametrize(
    ("message", "template"),
    [
        ("order 17 took 250ms", "order <n> took <n>ms"),
        ("cannot open \"a b.txt\" for 'joe'", "cannot open <str> for <str>"),
        ("peer 10.20.30.40:8080 gone", "peer <ip> gone"),
        ("at 0xDEADbeef  twice\n", "at <hex> twice"),
    ],
)
def test_message_examples(spark, message, template):
    assert run(spark, [message], G.normalize_message) == [template]


def hashes(spark, rows, depth=0):
    data = spark.createDataFrame(rows, "s string, m string, f array<string>")
    column = G.signature(G.template(F.col("s"), F.col("m"), F.col("f"), depth))
    return [row[0] for row in data.select(column).collect()]


def test_signature_ignores_run_specific_parts_only(spark):
    base = ("pay", "lost 5 of 'x'", ["a.run:a.go:10 +0x1d", "b.run:b.go:7"])
    same = ("pay", "lost 812 of 'yy'", ["a.run:a.go:99 +0x2f", "b.run:b.go:8"])
    other_message = ("pay", "kept 5 of 'x'", base[2])
    other_service = ("cart", *base[1:])
    first, second, third, fourth = hashes(spark, [base, same, other_message, other_service])
    assert first == second and len(first) == 32
    assert len({first, third, fourth}) == 3


def test_signature_depth(spark):
    short = ("s", "m", ["f1", "f2", "f3"])
    long = ("s", "m", ["f1", "f2", "other"])
    assert len(set(hashes(spark, [short, long], 2))) == 1
    assert len(set(hashes(spark, [short, long]))) == 2


def test_no_signature_without_service_and_message(spark):
    assert hashes(spark, [("", "", ["f"]), ("s", "", [])])[0] == ""
