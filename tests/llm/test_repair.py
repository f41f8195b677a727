"""Conversation repair against a plain search over all edits, also of conversations on several partitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from faultline.llm import queries, repair

WHITE = repair.SPACE
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, cost long, present string, fault string, audit string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) of the least repair, by trying every edit after every state."""
    marks = faults(rows)
    best = {"": (0, "", ())}

    def inserted(found):
        for _ in range(4):
            for state, (cost, audit, lines) in list(found.items()):
                to = NEXT[state]
                new = (cost + 2, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[to]))
                found[to] = min(found.get(to, new), new, key=lambda x: x[:2])
        return found

    for (role, text), mark in zip(rows, marks, strict=True):
        best, new = inserted(best), {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value, key=lambda x: x[:2])

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 3, audit + "D", lines))
            if mark not in (1, 2):
                cut = mark == 3
                first = role[:1]
                if first == NEXT[state] or first == "s" and state == "":
                    offer(first, (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                to = NEXT[state]
                offer(to, (cost + 2 + cut, audit + "R", (*lines, {"u": "user:", "a": "assistant:"}[to] + text)))
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain(rows):
    """Results by conversation of the damaged rows of (conv, turn, role, text)."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        mine += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in held.items():
        mine = [x for x in sorted(mine)]
        turns = [t for there, t, *_ in mine if there]
        pairs = [(r, t) for *_, r, t in mine]
        marks = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        cost, audit, lines = cheapest(pairs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest)
    return out


def run(spark, rows, partitions=4):
    frame = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(partitions)
    held = repair.placed(frame, "conv_id", "turn", "role", "text", frame["present"])
    return repair.conversations(repair.pieces(held))


def results(frame):
    found = frame.collect()
    assert len({r.conv for r in found}) == len(found)
    return {r.conv: tuple(r)[1:] for r in found}


def talk(rng, conv, turns):
    texts = ["Yes.", "No", "Why?", " ", "\n\t", "So it is!", "é日.", "x" * 70 + "a.", "x" * 70 + "b."]
    roles = ["user", "assistant", "system", "User", "tool", "", None, "u2", "a", "sys"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1, 1, 1]
    for turn in range(turns):
        text = rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice('.!?, ')}"
        role = rng.choices(roles, weights)[0] if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
        yield conv, None if rng.random() < 0.05 else turn + rng.randint(0, 1), role, None if rng.random() < 0.03 else text


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    rows = [row for conv in range(400) for row in talk(rng, None if conv == 7 else conv, rng.choice([1, 2, 3, 5, 9]))]
    assert results(run(spark, rows)) == plain(rows)


def test_conversation_on_several_partitions(spark, monkeypatch):
    """Most rows are of one conversation, which range partitioning cuts; its pieces are cut again."""
    rng = random.Random(5)
    rows = [*talk(rng, 1, 900), *talk(rng, 2, 3), *talk(rng, 3, 1)]
    monkeypatch.setattr(repair, "_CHUNK_ROWS", 50)
    frame = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = repair.placed(frame, "conv_id", "turn", "role", "text", frame["present"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = repair.pieces(held)
    assert found.filter("conv = 1").select("part").distinct().count() > 3
    assert results(repair.conversations(found)) == plain(rows)


def test_chain_of_shares(spark):
    """Cutting a conversation anywhere gives the path of the whole one."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 9, 300)
    whole = repair.least_paths(codes, np.array([0, 300]), [repair._ALONE])
    for cut in (1, 100, 299):
        after = np.minimum((repair.whole_matrix(codes[cut:]) + repair.END).min(axis=1), 1 << 40)
        one = repair.Share(after.tolist(), 0, True, False)
        first = repair.least_paths(codes[:cut], np.array([0, cut]), [one])
        two = repair.Share(repair.END.tolist(), int(first.ends[0][0]), False, True)
        second = repair.least_paths(codes[cut:], np.array([0, 300 - cut]), [two])
        assert [*first.letter, *second.letter] == whole.letter.tolist() and first.cost[0] == whole.cost[0]


def test_ranks_order_audits():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 9, 200)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = repair.least_paths(rng.integers(0, 9, offsets[-1]), offsets, [repair._ALONE] * 200)
    audits = ["".join(chr(c) for c in repair.LETTERS[found.letter[found.conv == i]]) for i in range(200)]
    order = sorted(set(audits))
    ranks = sorted(set(found.rank.tolist()))
    assert [ranks.index(r) for r in found.rank] == [order.index(a) for a in audits]


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert run_frame(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    rows = [(gone, 0, "user", "Hi."), (5000, 3, "user", "long " * 300_000), (5000, 4, "assistant", "Yes.")]
    got = results(run(spark, rows))
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", none) and got == plain(rows)
    odd = spark.createDataFrame([(1, 1, "user", "Why?", "k", 1, 2, "p", "f", "x"), (1, 2, "assistant", "So.", "k", 1, 2, "p", "f", "x")], SCHEMA)
    held = repair.placed(odd, "conv_id", "turn", "role", "text")
    assert repair.conversations(repair.pieces(held)).first().audit == "KK"


def run_frame(frame):
    rows = queries.damaged(frame)
    return repair.conversations(repair.pieces(repair.placed(rows, "conv_id", "turn", "role", "text", rows["present"])))


def test_query_equals_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_repair(spark, folder)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == plain(rows)
