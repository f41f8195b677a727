"""Rules of any number, exact quantiles and sequence reports against plain versions."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import diagnose as P
from faultline.operators import metrics as M
from faultline.operators import rules as L
from faultline.operators.quantiles import exact_quantile
from tests.test_dedup import START

RULES = "priority int, phrases array<string>, root_cause string, severity string, component string, commands array<string>"
EVENTS = "event_id string, signature string, service string, severity int, message string"


def first_rule(message, rules):
    met = [r for r in rules if any(p is not None and p.lower() in message.lower() for p in r[1] or ())] if message is not None else []
    return min(met, key=lambda r: (r[0] is None, r[0] or 0, r[2] or "", [p.lower() for p in r[1] if p is not None]), default=None)


@pytest.mark.parametrize("seed", range(3))
def test_first_of_many_rules(spark, seed):
    """Random phrases of all lengths, with repeats, against a search for every phrase."""
    rng = random.Random(seed)
    letters = "abc ÄÉ😀\n.*{}"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rules = [
        (rng.choice([None, *range(50)]), rng.choice([None, [], [word(rng.randint(1, 9)) for _ in range(rng.randint(1, 3))] + [None]]), f"c{i}", None, "x", [])
        for i in range(300)
    ]
    if seed == 2:
        rules.append((49, [""], "any", None, "x", []))
    messages = [word(rng.choice([0, 1, 3, 8, 40])) for _ in range(300)] + [None, "same", "same"]
    frame = spark.createDataFrame([(str(i), "s", "svc", 4, m) for i, m in enumerate(messages)], EVENTS)
    got = {r.event_id: r.root_cause for r in P.diagnose(frame, spark.createDataFrame(rules, RULES)).collect()}
    assert len(got) == len(messages)
    for i, message in enumerate(messages):
        rule = first_rule(message, rules)
        if rule:
            assert got[str(i)] == rule[2], (message, rule)
        else:
            assert message is None or got[str(i)].startswith("Unhandled")


def test_twenty_thousand_rules_in_one_join(spark):
    rules = spark.range(20_000).selectExpr(
        "cast(id AS int) AS priority", "array('code ' || id || ';', 'Zone-' || (id * 7) || ' ') AS phrases", "'rule ' || id || ' {service} {message}!' AS root_cause",
        "'' AS severity", "'' AS component", "array('look at {service}') AS commands",
    )
    events = spark.range(2_000).selectExpr(
        "'e' || id AS event_id", "'s' AS signature", "'svc' AS service", "4 AS severity", "'ERR code ' || (id * 11) || '; in zone-' || (id * 14 + 3) || repeat(' x', 500) AS message"
    )
    got = {int(r.event_id[1:]): r for r in P.diagnose(events, rules).collect()}
    for i in (0, 1, 500, 1818):
        assert got[i].root_cause.startswith(f"rule {i * 11} svc ERR code {i * 11}; in zone") and got[i].fix_commands == ["look at svc"]
    assert sum(r.root_cause.startswith("rule") for r in got.values()) > 1800
    # No message meets more than the phrases of its runs: phrases are filed under their rarest run.
    phrases = L.phrases_of(rules)
    assert phrases.count() == 40_000
    assert phrases.groupBy("run").count().agg(F.max("count")).first()[0] < 1000


def test_exact_quantile_of_any_group(spark):
    rng = random.Random(4)
    rows = [("hot", rng.randint(-50, 50)) for _ in range(4000)] + [("few", v) for v in (5, 1, 9, 7)] + [("one", 3), ("none", None), (None, 2)]
    frame = spark.createDataFrame(rows, "service string, v long").repartition(6)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {}
        for key in ("hot", "few", "one"):
            values = sorted(v for k, v in rows if k == key)
            want[key] = values[max(math.ceil(share * len(values)), 1) - 1]
        got = {r.service: r.q for r in exact_quantile(frame, "service", "v", share, "q").collect()}
        assert got == want
    assert exact_quantile(frame.limit(0), "service", "v", 0.5, "q").count() == 0


def test_lag_has_an_exact_median(spark):
    rows = [("a", i * 1000, 0) for i in range(1, 1001)] + [("b", 5, 0)]
    events = spark.createDataFrame(rows, "service string, r long, t long").select(
        "service", F.timestamp_micros("r").alias("received_at"), F.timestamp_micros("t").alias("timestamp")
    )
    got = {r.service: (r.events, r.min_lag_us, r.max_lag_us, r.total_lag_us, r.median_lag_us) for r in M.ingestion_lag(events).collect()}
    assert got == {"a": (1000, 1000, 1_000_000, 500_500_000, 500_000), "b": (1, 5, 5, 5, 5)}


@pytest.mark.parametrize("hot_rows", [10**9, 0])
def test_missing_numbers_whatever_the_order(spark, hot_rows):
    rng = random.Random(8)
    rows = [("s", n) for n in (1, 3, 2, 4)] + [("g", n) for n in (10, 5, 5, 7, 12)] + [(None, 3), ("", 1), ("null", None)]
    rows += [("big", n) for n in rng.sample(range(3000), 2000)]
    events = spark.createDataFrame([(s, START, n) for s, n in rows], "stream_id string, received_at timestamp, seq_no long")
    held = collections.defaultdict(list)
    for stream, number in rows:
        held[stream or ""] += [] if number is None else [number]
    want = set()
    for stream, numbers in held.items():
        numbers = sorted(set(numbers))
        want |= {(stream, a + 1, b - 1, b - a - 1) for a, b in zip(numbers, numbers[1:], strict=False) if b > a + 1}
    assert {tuple(r) for r in M.missing_ranges(events, hot_rows).collect()} == want
    assert not any(stream == "s" for stream, *_ in want)
    summary = {r.stream_id: r for r in M.sequence_summary(events, hot_rows).collect()}
    assert summary["g"].missing == 4 and summary["g"].repeated == 1 and summary["g"].events == 5
    assert summary["big"].missing == sum(n for s, _, _, n in want if s == "big")
    assert (summary["null"].events, summary["null"].missing, summary["null"].repeated) == (1, 0, 0)


def test_arrival_order_is_told_apart_from_loss(spark):
    times = [F.expr(f"timestamp '2024-01-01 00:00:0{i}'") for i in range(4)]
    numbers = [1, 3, 2, 4]
    events = spark.range(4).select(
        F.lit("s").alias("stream_id"), F.array(*times)[F.col("id").cast("int")].alias("received_at"), F.array(*map(F.lit, numbers))[F.col("id").cast("int")].cast("long").alias("seq_no")
    )
    row = M.sequence_summary(events).first()
    assert (row.missing, row.reordered, row.repeated) == (0, 1, 0) and M.missing_ranges(events).count() == 0
