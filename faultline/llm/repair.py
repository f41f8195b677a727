"""Conversation structure repair: the cheapest edits that turn the roles of a conversation into an optional system and pairs of turns.

Rows of a conversation are kept (cost 0; only where the role fits), given the role user or assistant (2), deleted (3; the only
edit of blank and duplicate rows), and empty turns are inserted (2); a truncated row that stays adds 1. Role initials must then read
``(s?(ua)+)?``. Of all cheapest repairs the one with the least audit, the string of the edits' initials, is taken.

Method. A node is a place between two rows and what has been written so far: E nothing, S a system turn, U a user turn that waits
for its answer, A whole pairs. Costs to go are suffix products of 4 x 4 (min, +) matrices, one matrix a row, found for all conversations
of a batch together by pointer doubling. An arc is optimal if its cost is what the cost to go falls by. The optimal-arc
nodes are then ranked by their least audits of 1, 2, 4, ... letters: the rank for 2n letters is that of the pair (rank for n
letters here, rank for n letters at the node n letters on). The arcs of a node bear different letters, so the least letters lead to
one node, to which the doubled pointer goes. The pointers of all lengths together mark the nodes of the least path.

Scale. Rows are sorted by ranges of (conversation, turn, ...), so a conversation of any size takes as many tasks as it needs. What
lies within one partition is repaired there. Of a conversation on several partitions each gives its matrix and then, with the costs to
go at its end, the state its least path ends in for each state it may start in; the driver chains these figures, at most
two a partition. Repeated texts are found by grouping hashes, not by windows. Only the digest of a conversation's text is one task's
work, for SHA-256 is sequential; it streams over pieces of bounded size.

Rules. Null conversations form one conversation; null turns come first; null role and text are one space. Rows of one turn go
by role, the first 64 characters and the hash of their text. Roles other than s..., u... and a... (also the empty one) cannot be
kept. A conversation without rows has cost 0, an empty audit and an empty text. Other columns do not matter.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.common import stored
from faultline.session import materialize

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
LETTERS = np.frombuffer(b".DIKR", np.uint8)
_FAR = 1 << 40
_E, _S, _U, _A = range(4)
#: The state after one more turn of the alternating roles, and after keeping a row by its role class (s, u, a, other).
_NEXT = np.array([_U, _U, _A, _U])
_KEEP = np.array([[_S, _U, -1, -1], [-1, _U, -1, -1], [-1, -1, _A, -1], [-1, _U, -1, -1]])
#: Pairs of role classes that may stand side by side.
_LEGAL = ((0, 1), (1, 2), (2, 1))
#: Codes of rows: 0 must go, else 1 + 2 * role class + truncated.
_CODES = 9
_BATCH, _CHUNK_ROWS, _CHUNK_BYTES = 1 << 15, 4096, 1 << 20


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of matrices (..., 4, 4)."""
    out = a[..., :, 0, None] + b[..., None, 0, :]
    for k in range(1, 4):
        np.minimum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return np.minimum(out, _FAR)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Matrices of insertions and of each row code, insertions before the row included."""
    inserts = np.full((4, 4), _FAR)
    inserts[range(4), range(4)] = 0
    inserts[range(4), _NEXT] = 2
    inserts = np.minimum(inserts, _product(inserts, inserts))
    rows = np.full((_CODES, 4, 4), _FAR)
    rows[:, range(4), range(4)] = 3
    for code in range(1, _CODES):
        kind, cut = divmod(code - 1, 2)
        for q in range(4):
            rows[code, q, _NEXT[q]] = min(rows[code, q, _NEXT[q]], 2 + cut)
            if _KEEP[q, kind] >= 0:
                rows[code, q, _KEEP[q, kind]] = min(rows[code, q, _KEEP[q, kind]], cut)
    return inserts, _product(inserts, rows)


_INSERTS, _ROWS = _tables()
#: Costs to go where no row is left.
END = np.minimum(_INSERTS[:, _E], _INSERTS[:, _A])


def whole_matrix(codes: np.ndarray) -> np.ndarray:
    """The product of the matrices of all rows, halving their number in each round."""
    held = _ROWS[codes] if len(codes) else np.where(np.eye(4, dtype=bool), 0, _FAR)[None]
    while len(held) > 1:
        even = len(held) & ~1
        held = np.concatenate([_product(held[0:even:2], held[1:even:2]), held[even:]])
    return held[0]


def costs_to_go(codes: np.ndarray, ends: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row the cost to go from each state before it. ``ends`` is the row past the end of the row's conversation, ``after``
    (one vector a row) the costs to go there."""
    held, to = _ROWS[codes], np.arange(1, len(codes) + 1)
    while True:
        on = np.flatnonzero(to < ends)
        if not len(on):
            break
        held[on], to[on] = _product(held[on], held[to[on]]), to[to[on]]
    return np.minimum((held + after[:, None, :]).min(axis=2), _FAR)


class Paths(NamedTuple):
    conv: np.ndarray  #: conversation of each arc on a path, in order
    row: np.ndarray  #: the row it edits, or before which it inserts
    letter: np.ndarray  #: 1 to 4 for D, I, K, R
    state: np.ndarray  #: state after it
    cost: np.ndarray  #: by conversation: cost to go at its start
    ends: np.ndarray  #: by conversation: end state from each of the four start states
    rank: np.ndarray  #: by conversation: rank of its audit among those of this call


def least_paths(codes: np.ndarray, offsets: np.ndarray, shares: list["Share"]) -> Paths:
    """The least cheapest path of each conversation (rows ``offsets[i]`` to ``offsets[i + 1]``) from its share's start state."""
    starts, after = np.array([s.start for s in shares]), np.array([s.after for s in shares])
    closed = np.array([s.closes for s in shares])
    sizes = np.diff(offsets)
    many, places = len(sizes), int(offsets[-1]) + len(sizes)
    conv = np.repeat(np.arange(many), sizes)
    place = np.arange(len(codes)) + conv
    last = offsets[1:] + np.arange(many)
    to_go = np.empty((places, 4), np.int64)
    to_go[last] = after
    to_go[place] = costs_to_go(codes, offsets[1:][conv], after[conv])
    letter = np.zeros((places, 4), np.int64)
    node = np.arange(places * 4).reshape(places, 4)
    target = node.copy()

    def take(which, at, cost, state, ok):
        """Letter ``which`` at the places ``at`` for nodes with an optimal arc of it and of no lesser letter."""
        step = at + (which != 2)
        best = ok & (letter[at] == 0) & (to_go[at] < _FAR)
        state = np.broadcast_to(state, best.shape)
        best &= cost + np.take_along_axis(to_go[step], np.maximum(state, 0), 1) == to_go[at]
        letter[at] = np.where(best, which, letter[at])
        target[at] = np.where(best, step[:, None] * 4 + state, target[at])

    stays, (kind, cut) = (codes > 0)[:, None], np.divmod(np.maximum(codes, 1) - 1, 2)
    may_insert = np.sort(np.concatenate([place, last[closed]]))
    kept = _KEEP.T[kind]
    take(1, place, 3, np.arange(4), np.ones((len(codes), 4), bool))
    take(2, may_insert, 2, _NEXT, np.ones((len(may_insert), 4), bool))
    take(3, place, cut[:, None], kept, stays & (kept >= 0))
    take(4, place, 2 + cut[:, None], _NEXT, stays & np.ones(4, bool))

    rank, pointer, letters = letter.ravel(), target.ravel(), letter.ravel()
    on_path = np.zeros(places * 4, bool)
    first = (offsets[:-1] + np.arange(many)) * 4
    on_path[first + starts] = True
    while True:
        marked = np.flatnonzero(on_path)
        on_path[pointer[marked]] = True
        if not letters[pointer].any():
            break
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
    ends = pointer[first[:, None] + np.arange(4)] & 3
    # Along a path the place never falls, and at one place insertions lower the cost to go.
    found = np.flatnonzero(on_path & (letters > 0))
    found = found[np.lexsort((-to_go.ravel()[found], found >> 2))]
    whose = np.searchsorted(last, found >> 2)
    cost = to_go.ravel()[first + starts]
    return Paths(whose, (found >> 2) - whose, letters[found], target.ravel()[found] & 3, cost, ends, rank[first + starts])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of adjacent equal keys, of about ``rows`` rows or one larger group."""
    held, new, needed = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        new += batch.num_rows
        if new < needed:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut)
        # A group that fills all that is held waits for as many rows again, so that no row is copied too often.
        held, new, needed = table.slice(cut).to_batches(), 0, max(rows, 0 if cut else table.num_rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def placed(conversations: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """Rows with their faults, sorted by ranges of conversation and order, stored partition by partition.

    Rows that are not ``present`` only tell that their conversation exists.
    """
    c = [F.col(f"`{x}`") for x in (conv, turn, role, text)]
    space = F.lit(" ")
    rows = conversations.select(
        c[0].alias("conv"),
        F.xxhash64(c[0].isNull(), c[0]).alias("key"),
        c[1].cast("long").alias("turn"),
        F.coalesce(c[2], space).alias("role"),
        F.coalesce(c[3], space).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    words = F.rtrim(F.col("text"), F.lit(SPACE))
    held = stored(
        rows.select(
            "*",
            F.monotonically_increasing_id().alias("id"),
            F.xxhash64("text").alias("h1"),
            F.xxhash64(F.lit(1), "text").alias("h2"),
            (words == "").alias("blank"),
            (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        ),
        "turns",
    )
    alike = ["key", "role", "h1", "h2"]
    said = held.filter("present").select("id", "turn", *alike)
    repeated = said.groupBy(*alike).agg(F.min(F.struct("turn", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = stored(repeated.select(*alike, F.col("first.id").alias("first")), "repeated")
    later = said.join(repeated, alike).filter("id <> first").select("id", F.lit(True).alias("later"))
    fault = F.when(F.col("blank"), 1).when(F.col("later"), 2).when(F.col("cut"), 3).otherwise(0)
    kind = F.coalesce(F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2), F.lit(3))
    flagged = held.join(later, "id", "left").select(
        "conv", "key", "present", "turn", "role", "text", "h1", "id", F.substring("text", 1, 64).alias("begin"),
        fault.cast("byte").alias("fault"), kind.cast("byte").alias("kind"),
    )
    order = ["key", "conv", "turn", "role", "begin", "h1", "id"]
    return materialize(flagged.repartitionByRange(*order).sortWithinPartitions(*order).drop("begin", "h1", "id"))


def _codes(rows: pa.Table) -> np.ndarray:
    fault, kind = rows.column("fault").to_numpy(), rows.column("kind").to_numpy().astype(np.int64)
    return np.where((fault == 1) | (fault == 2), 0, 1 + 2 * kind + (fault == 3))


class Share(NamedTuple):
    """What a task must know of a conversation that other partitions hold too."""

    after: list[int]  #: costs to go where its rows end
    start: int  #: state before its first row
    opens: bool  #: no earlier partition has rows of it
    closes: bool  #: no later one has


_ALONE = Share(END.tolist(), _E, True, True)


def _chained(held: DataFrame) -> dict[int, dict[int, Share]]:
    """The shares by partition and key."""
    small = held.select("key", "present", "fault", "kind")

    def edges(batches):
        """The matrices of the first and the last conversation of a partition."""
        part, first, last = TaskContext.get().partitionId(), None, None
        for rows in _whole_groups(batches, "key", _BATCH):
            cuts = _cuts(rows.column("key").to_numpy())
            if first is None:
                first = rows.slice(0, int(cuts[1]))
                last = rows.slice(int(cuts[-2])) if len(cuts) > 2 else None
            else:
                last = rows.slice(int(cuts[-2]))
        found = [share for share in (first, last) if share is not None]
        if found:
            yield pa.RecordBatch.from_pydict({
                "part": [part] * len(found),
                "place": list(range(len(found))),
                "key": [share.column("key")[0].as_py() for share in found],
                "matrix": [whole_matrix(_codes(share.filter(share.column("present")))).ravel().tolist() for share in found],
            })

    chains: list[list] = []
    for share in sorted(small.mapInArrow(edges, "part long, place long, key long, matrix array<long>").collect()):
        if chains and chains[-1][-1].key == share.key:
            chains[-1].append(share)
        else:
            chains.append([share])
    spans = [chain for chain in chains if len(chain) > 1]
    known: dict[int, dict[int, Share]] = {}
    for chain in spans:
        after = END
        for share in reversed(chain):
            known.setdefault(share.part, {})[share.key] = Share(after.tolist(), _E, share is chain[0], share is chain[-1])
            after = np.minimum((np.array(share.matrix).reshape(4, 4) + after).min(axis=1), _FAR)
    if not spans:
        return {}
    shared = held.sparkSession.sparkContext.broadcast(known)

    def ends(batches):
        """The state in which each share's least path ends, for each state it may start in."""
        part = TaskContext.get().partitionId()
        mine = shared.value.get(part, {})
        for rows in _whole_groups(batches, "key", _BATCH) if mine else ():
            keys = rows.column("key").to_numpy()
            for a, b in zip(_cuts(keys)[:-1], _cuts(keys)[1:], strict=True):
                if int(keys[a]) in mine:
                    share, mine_here = rows.slice(a, b - a), mine[int(keys[a])]
                    codes = _codes(share.filter(share.column("present")))
                    found = least_paths(codes, np.array([0, len(codes)]), [mine_here])
                    yield pa.RecordBatch.from_pydict({"part": [part], "key": [int(keys[a])], "ends": [found.ends[0].tolist()]})

    states = {(r.part, r.key): r.ends for r in small.mapInArrow(ends, "part long, key long, ends array<long>").collect()}
    for chain in spans:
        state = _E
        for share in chain:
            known[share.part][share.key] = known[share.part][share.key]._replace(start=state)
            state = states[share.part, share.key][state]
    return known


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_NOTHING = [0] * len(COUNTS) + [None, None, 0, None, None]


def pieces(held: DataFrame) -> DataFrame:
    """The repaired conversations of :func:`placed` rows, in pieces of bounded size in the order (part, piece).

    Columns: conv, key, part, piece, whole (the piece is all of its conversation), audit, repaired (``role:text`` lines; the first
    piece with text of a conversation has no line break before it), lines (number of them), the counts of ``COUNTS``, low and high turn,
    turns (distinct ones), first and last role class, for joining pieces.
    """
    shared = held.sparkSession.sparkContext.broadcast(_chained(held))
    conv = held.schema["conv"]
    schema = T.StructType([conv, *T._parse_datatype_string(
        "key long, part int, piece int, whole boolean, audit string, repaired string, lines long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, low long, high long, turns long, first_kind int, last_kind int"
    ).fields])
    arrow = to_arrow_schema(schema)

    def repaired(batches):
        part = TaskContext.get().partitionId()
        mine = shared.value.get(part, {})
        for rows in _whole_groups(batches, "key", _BATCH):
            out = {name: [] for name in schema.names}
            size = 0
            for row in _repair(rows, mine, part):
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
                size += len(row[6]) + len(row[5])
                if size > 8 * _CHUNK_BYTES:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                    out, size = {name: [] for name in schema.names}, 0
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return held.mapInArrow(repaired, schema)


def _repair(rows: pa.Table, mine: dict, part: int) -> Iterator[tuple]:
    keys = rows.column("key").to_numpy()
    cuts = _cuts(keys)
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    there = rows.column("present").to_numpy()
    here, whose = rows.filter(rows.column("present")), of[there]
    offsets = np.searchsorted(whose, np.arange(len(cuts)))
    codes = _codes(here)
    shares = [mine.get(int(keys[a]), _ALONE) for a in cuts[:-1]]
    paths = least_paths(codes, offsets, shares)
    conv_of, row_of, letters, states = paths[:4]
    bounds = np.searchsorted(conv_of, np.arange(len(cuts)))
    faults, kinds = here.column("fault").to_numpy(), here.column("kind").to_numpy()
    turn_null = here.column("turn").is_null().to_numpy()
    turns = here.column("turn").fill_null(0).to_numpy()
    bad = ~np.isin(kinds[:-1] * 4 + kinds[1:], [4 * x + y for x, y in _LEGAL])
    roles, texts = here.column("role").to_pylist(), here.column("text")
    convs = rows.column("conv").take(pa.array(cuts[:-1])).to_pylist()
    audits = LETTERS[letters].tobytes().decode("ascii")
    for i, conv in enumerate(convs):
        a, b = int(offsets[i]), int(offsets[i + 1])
        filled = turns[a:b][~turn_null[a:b]].tolist()
        distinct = sum(x != y for x, y in zip(filled, filled[1:], strict=False)) + 1
        info = [
            *(int((faults[a:b] == f).sum()) for f in (1, 2, 3)),
            int(bad[a : max(b - 1, a)].sum()),
            int(paths.cost[i]) if shares[i].opens else 0,
            *((filled[0], filled[-1], distinct) if filled else (None, None, 0)),
            *((int(kinds[a]), int(kinds[b - 1])) if b > a else (None, None)),
        ]
        piece, x, last = 0, int(bounds[i]), int(bounds[i + 1])
        while piece == 0 or x < last:
            lines, size, y = [], 0, x
            while y < last and len(lines) < _CHUNK_ROWS and size < _CHUNK_BYTES:
                kind = letters[y]
                if kind != 1:
                    role = ("user" if states[y] == _U else "assistant") if kind != 3 else roles[row_of[y]]
                    line = f"{role}:" if kind == 2 else f"{role}:{texts[int(row_of[y])].as_py()}"
                    lines.append(line)
                    size += len(line)
                y += 1
            whole = piece == 0 and y >= last and shares[i] is _ALONE
            yield (conv, int(keys[cuts[i]]), part, piece, whole, audits[x:y], "\n".join(lines), len(lines), *(info if piece == 0 else _NOTHING))
            piece, x = piece + 1, y


def conversations(found: DataFrame) -> DataFrame:
    """One row per conversation from its :func:`pieces`: conv, gaps, counts, cost, audit and the SHA-256 of its repaired text.

    Conversations of one piece are finished where they lie; the others are streamed piece by piece.
    """
    names = ["conv", "gaps", *COUNTS, "audit", "repaired_sha256"]
    digest = F.when(F.col("whole"), F.sha2("repaired", 256)).alias("repaired_sha256")
    text = F.when(~F.col("whole"), F.col("repaired")).alias("repaired")
    held = stored(found.select(*[c for c in found.columns if c != "repaired"], digest, text), "pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    done = held.filter("whole").select("conv", gaps, *COUNTS, "audit", "repaired_sha256")
    conv = found.schema["conv"]
    schema = T.StructType([conv, *(T.StructField(n, T.StringType() if n in names[-2:] else T.LongType()) for n in names[1:])])
    arrow = to_arrow_schema(schema)

    def joined(batches):
        """One conversation after the other; what is held of it grows by its audit alone."""
        at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if at is None or at["key"] != row["key"]:
                    if at:
                        yield _finished(at, arrow)
                    at = {"key": row["key"], "conv": row["conv"], "audit": [], "sha": hashlib.sha256(), "lines": 0, "low": None, "high": None, "turns": 0, "kind": None, **dict.fromkeys(COUNTS, 0)}
                at["audit"].append(row["audit"])
                for name in COUNTS:
                    at[name] += row[name]
                if row["lines"]:
                    at["sha"].update((b"\n" if at["lines"] else b"") + row["repaired"].encode())
                    at["lines"] += row["lines"]
                if row["low"] is not None:
                    at["turns"] += row["turns"] - (at["high"] == row["low"])
                    at["low"] = row["low"] if at["low"] is None else at["low"]
                    at["high"] = row["high"]
                if row["first_kind"] is not None:
                    at["illegal"] += at["kind"] is not None and (at["kind"], row["first_kind"]) not in _LEGAL
                    at["kind"] = row["last_kind"]
        if at:
            yield _finished(at, arrow)

    rest = held.filter("not whole").repartition("key").sortWithinPartitions("key", "part", "piece")
    return done.unionByName(rest.mapInArrow(joined, schema))


def _finished(at: dict, schema: pa.Schema) -> pa.RecordBatch:
    gaps = 0 if at["low"] is None else at["high"] - at["low"] + 1 - at["turns"]
    row = {**at, "gaps": gaps, "audit": "".join(at["audit"]), "repaired_sha256": at["sha"].hexdigest()}
    return pa.RecordBatch.from_pylist([{name: row[name] for name in schema.names}], schema=schema)
