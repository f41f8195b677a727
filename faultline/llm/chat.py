"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a table of parts (conversation, place, text); texts hold any number of lines, and turns may start anywhere. The
states of a line are (role, B) for the first line of a turn, (role, I) for a later one and (role, E) for a blank one. A line shows its
speaker marker ("User:", "[bot]", "Q."), its length, and how it ends. Start, transition and emission counts are sums over all
training lines with known roles; Viterbi decoding gives the likeliest states of a whole conversation.

Scale. Lines are sorted by ranges of (conversation, place), so a conversation of any size is spread over as many tasks as it needs.
What lies within one partition is decoded there. For a conversation on several partitions each gives the best score from
any state before it to any state at its end (a small matrix); the driver chains these matrices, of which there are at most two a
partition, and each partition then decodes its share between the chosen states. The result is the exact best path.

Markers. Every marker seen ``_LEAST`` times gets its own emission counts. The ``_SENT_MARKERS`` most frequent go to each worker, all
others are a table joined to the parts that show them. A marker is a speaker's if some role's first lines show it at least ``_LEAST``
times and more than four times as often as later lines do. It is taken off the first line of a turn only where its signs are the
style of the conversation: the signs of most of the speaker markers there, on at least half of its turns.

Output: one row per part and turn in it: role, whether the turn starts and ends here, its text without the marker, and ``rendered``:
``<|role|>``, a line break, the text and, where the turn ends, ``<|end|>``; the pieces of a turn joined by line breaks are the turn.

Rules. Null text is empty and empty parts give no row; other blank lines end with their turn and are not rendered. Parts with
the same place follow the hash of their text. Null conversations form one conversation, null places come first. Without
training lines there is one role, ``unknown``. More than ``most_roles`` roles raise an error. Other columns do not matter.
"""

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm.common import stored

_MARKER = re.compile(r"\s*[^\w\s]{0,4}\s*(\w[\w ]{0,23}?)\s*(?:[:>\])|]{1,2}|[*_]{2}:?)(?:[*_]{2})?(?:\s+|$)")
_LEAST, _SENT_MARKERS = 3, 4096
_LENGTHS, _ENDS = 16, 3
KINDS = ("B", "I", "E")


def marker_of(line: str) -> tuple[str, str, int]:
    """Marker with its signs in lower case ("" for none), the signs alone, and where it ends."""
    found = _MARKER.match(line)
    if not found:
        return "", "", 0
    before, after = line[: found.start(1)].strip(), line[found.end(1) : found.end()].strip()
    return before + found[1].lower() + after, f"{before} {after}", found.end()


def features(line: str) -> tuple[str, int, int]:
    """Marker in lower case ("" for none), length class, and ending: 0 sentence, 1 question, 2 other."""
    bare = line.rstrip()
    return (
        marker_of(line)[0],
        min(len(bare).bit_length(), _LENGTHS - 1),
        1 if bare.endswith("?") else 0 if bare.endswith((".", "!")) else 2,
    )


class Model:
    """Log-probabilities of starts, transitions and emissions over roles x KINDS, with add-one counts."""

    def __init__(self, roles: list[str], markers: list[str]):
        self.roles, self.markers = roles, {m: i for i, m in enumerate(markers)}
        n = len(roles) * len(KINDS)
        # The markers that are speakers', and a table (marker, logs, speaker) of those not in ``markers``.
        self.speakers: set[str] = set()
        self.rare: DataFrame | None = None
        self.start = np.ones(n)
        self.step = np.ones((n, n))
        # The last marker stands for all that were not learned.
        self.emit = [np.ones((n, k)) for k in (len(markers) + 1, _LENGTHS, _ENDS)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}

    def finish(self, rare: np.ndarray | float = 0.0) -> "Model":
        """Counts to logarithms; ``rare`` has the counts of the markers of the table by state."""
        self.start, self.step = np.log(self.start / self.start.sum()), np.log(self.step / self.step.sum(axis=1, keepdims=True))
        totals = [e.sum(axis=1, keepdims=True) for e in self.emit]
        totals[0] = totals[0] + np.reshape(rare, (-1, 1))
        self.emit = [np.log(e / t) for e, t in zip(self.emit, totals, strict=True)]
        blank = np.arange(len(self.start)) % len(KINDS) == KINDS.index("E")
        self.blank = np.where(blank, 0.0, -1e9), np.where(blank, -1e9, 0.0)
        return self

    def emissions(self, lines: list[str], rare: dict[str, tuple[np.ndarray, bool]] | None = None) -> np.ndarray:
        out = np.empty((len(lines), len(self.start)))
        for i, line in enumerate(lines):
            if not line.strip():
                out[i] = self.blank[0]
                continue
            marker, length, end = features(line)
            held = rare.get(marker) if rare else None
            shown = held[0] if held else self.emit[0][:, self.markers.get(marker, len(self.markers))]
            out[i] = shown + self.emit[1][:, length] + self.emit[2][:, end] + self.blank[1]
        return out

    def transfer(self, emissions: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines, and in the last row from a start, to each state of the last line."""
        best = None
        for e in emissions:
            best = np.vstack([self.step, self.start]) + e if best is None else (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def decode(self, emissions: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
        """The best states, after a given state (else at a start) and up to a given last state."""
        score = (self.start if before is None else self.step[before]) + emissions[0]
        back = np.zeros(emissions.shape, np.int64)
        for i in range(1, len(emissions)):
            all_ = score[:, None] + self.step
            back[i] = all_.argmax(axis=0)
            score = all_.max(axis=0) + emissions[i]
        states = np.empty(len(emissions), np.int64)
        states[-1] = score.argmax() if last is None else last
        for i in range(len(emissions) - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
        return states


def _lines(text: str | None) -> list[str]:
    return text.replace("\r\n", "\n").split("\n") if text else []


def placed(parts: DataFrame, conversation: str, place: str, text: str, role: str | None = None, ranges: int | None = None) -> DataFrame:
    """The parts in order, in ``ranges`` ranges if given: part (number of the sorted partition), pos, conv, place, text and role, written to the shared folder."""
    order = ["conv", "place", F.xxhash64("text")]
    role_column = F.col(role).cast("string") if role else F.lit(None).cast("string")
    source = parts.select(F.col(conversation).alias("conv"), F.col(place).alias("place"), F.col(text).alias("text"), role_column.alias("role"))
    rows = source.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    types = dict(source.dtypes)

    def number(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(pos, pos + batch.num_rows))]
            pos += batch.num_rows
            yield pa.RecordBatch.from_arrays([*own, *batch.columns], names=["part", "pos", "conv", "place", "text", "role"])

    schema = f"part int, pos long, conv {types['conv']}, place {types['place']}, text string, role string"
    return stored(rows.mapInArrow(number, schema), "transcripts")


def _segments(batches) -> Iterator[tuple[int, object, list[dict]]]:
    """(part, conversation, rows) in order, from rows sorted by (part, pos)."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (part, conv), some in groupby(rows, key=lambda r: (r["part"], r["conv"])):
        yield part, conv, list(some)


def _sorted(held: DataFrame) -> DataFrame:
    return held.repartition("part").sortWithinPartitions("part", "pos")


def learn(held: DataFrame, most_roles: int = 32) -> Model:
    """The model from all rows of ``held`` (:func:`placed`) with a role; a row is one turn."""
    known = held.filter(F.col("role").isNotNull())
    roles = sorted(r.role for r in known.select("role").distinct().limit(most_roles + 1).collect())
    if len(roles) > most_roles:
        raise ValueError(f"more than {most_roles} roles")

    def count(batches):
        sums: dict[tuple[str, str, str], int] = {}

        def add(*key):
            sums[key] = sums.get(key, 0) + 1

        ends = []
        for part, conv, rows in _segments(batches):
            last = None
            for row in rows:
                kinds = "B"
                for line in _lines(row["text"]):
                    state = f"{row['role']}\t{kinds if line.strip() else 'E'}"
                    if line.strip():
                        marker, length, end = features(line)
                        for kind, value in (("m", marker), ("l", length), ("e", end)):
                            add(kind, state, str(value))
                        kinds = "I"
                    if last is None:
                        ends.append((part, repr(conv), "first", state))
                    else:
                        add("t", last, state)
                    last = state
            if last is not None:
                ends.append((part, repr(conv), "last", last))
        # Only the ends of a partition's first and last conversation can continue elsewhere.
        for _, some in groupby(ends, key=lambda e: e[0]):
            some = list(some)
            for i, (part, conv, kind, state) in enumerate(some):
                if kind == "first" and i > 0:
                    add("s", state, "")
                elif i == 0 or i == len(some) - 1:
                    add(f"{kind}\t{part}\t{conv}", state, "")
        out = [(k, s, v, n) for (k, s, v), n in sums.items()]
        yield pa.RecordBatch.from_pydict({n: pa.array(x, t) for n, x, t in zip(("kind", "state", "value", "n"), zip(*out) if out else [[]] * 4, (pa.string(),) * 3 + (pa.int64(),))})

    counted = _sorted(known).mapInArrow(count, "kind string, state string, value string, n long")
    total = stored(counted.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")), "hmm_counts")
    marked = total.filter("kind = 'm'").withColumn("later", F.col("state").endswith("\tI"))
    first = F.coalesce(F.max(F.when(~F.col("later"), F.col("n"))), F.lit(0))
    later = F.coalesce(F.sum(F.when(F.col("later"), F.col("n"))), F.lit(0))
    kept = marked.groupBy("value").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("by_state"),
        ((F.col("value") != "") & (first >= _LEAST) & (first > 4 * later)).alias("speaker"),
    ).filter(F.col("n") >= _LEAST)
    kept = stored(kept, "markers")
    n_kept, order = kept.count(), [F.desc("n"), "value"]
    sent = kept.select("value", "speaker", "n").orderBy(*order).limit(_SENT_MARKERS).collect()
    model = Model(roles or ["unknown"], [r.value for r in sent])
    model.speakers = {r.value for r in sent if r.speaker}
    at = {f"{r}\t{k}": i * len(KINDS) + j for i, r in enumerate(model.roles) for j, k in enumerate(KINDS)}
    ends: dict[int, dict[str, tuple[str, int]]] = {}
    names = total.sparkSession.createDataFrame([(m,) for m in model.markers], "value string")
    known = kept.select("value").join(F.broadcast(names.withColumn("sent", F.lit(True))), "value", "left")
    class_ = F.when(F.col("kind") != "m", "").when(F.col("sent"), "sent").when(F.col("sent").isNull() & F.col("kept"), "rare").otherwise("other")
    small = total.join(known.withColumn("kept", F.lit(True)), "value", "left").withColumn("class", class_)
    value = F.when(F.col("class").isin("", "sent"), F.col("value"))
    small = small.withColumn("value", value).groupBy("kind", "state", "class", "value").agg(F.sum("n").alias("n"))
    rare = np.full(len(model.start), float(n_kept - len(sent)))
    for r in small.collect():  # roles x (sent markers + lengths + ends) rows, and at most two for each partition
        if r["class"] == "rare":
            rare[at[r.state]] += r.n
        elif r.kind == "s":
            model.start[at[r.state]] += r.n
        elif r.kind == "t":
            model.step[at[r.state], at[r.value]] += r.n
        elif r.kind in ("m", "l", "e"):
            k = "mle".index(r.kind)
            model.emit[k][at[r.state], model.markers.get(r.value, len(model.markers)) if k == 0 else int(r.value)] += r.n
        else:
            kind, part, conv = r.kind.split("\t", 2)
            ends.setdefault(int(part), {})[kind] = (conv, at[r.state])
    before = None
    for part in sorted(ends):
        if "first" in ends[part]:
            conv, state = ends[part]["first"]
            if before and before[0] == conv:
                model.step[before[1], state] += 1
            else:
                model.start[state] += 1
        before = ends[part].get("last", before)
    if n_kept > len(sent):
        totals = model.emit[0].sum(axis=1) + rare
        logs = [F.log((F.coalesce(F.col("by_state")[s], F.lit(0)) + 1) / float(totals[i])) for s, i in at.items()]
        model.rare = kept.join(F.broadcast(names), "value", "left_anti").select(F.col("value").alias("marker"), F.array(*logs).alias("logs"), "speaker")
    return model.finish(rare)


def _marked(held: DataFrame, model: Model) -> DataFrame:
    """``held`` with the entries of the marker table for the lines of each part."""
    if model.rare is None:
        return held.withColumn("rare", F.lit(None).cast("array<struct<marker: string, logs: array<double>, speaker: boolean>>"))
    shared = held.sparkSession.sparkContext.broadcast(model)

    def shown(batches):
        sent = shared.value.markers
        for batch in batches:
            out = [(r["part"], r["pos"], m) for r in batch.to_pylist() for m in {marker_of(x)[0] for x in _lines(r["text"])} if m not in sent]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int64(), pa.string()))], ["part", "pos", "marker"])

    found = held.select("part", "pos", "text").mapInArrow(shown, "part int, pos long, marker string").join(model.rare, "marker")
    entries = found.groupBy("part", "pos").agg(F.collect_list(F.struct("marker", "logs", "speaker")).alias("rare"))
    return stored(held.join(entries, ["part", "pos"], "left"), "marked")


def _rare(rows: list[dict]) -> dict[str, tuple[np.ndarray, bool]]:
    return {e["marker"]: (np.array(e["logs"]), e["speaker"]) for r in rows for e in r["rare"] or ()}


def _cut(rows: list[dict], states: np.ndarray, before: int | None, after: int | None):
    """(row, piece, role number, starts, ends, lines that are not blank) of the turns in a conversation's share."""
    at, n = 0, len(KINDS)
    for row in rows:
        some = _lines(row["text"])
        own = states[at : at + len(some)]
        at += len(some)
        # A turn starts at B, where the role changes, and with its conversation.
        earlier = np.concatenate([[-1 if before is None else before] if at == len(some) else states[at - len(some) - 1 : at - len(some)], own[:-1]])
        new = (own % n == 0) | (own // n != earlier // n)
        cuts = [0, *(i for i in range(1, len(some)) if new[i]), len(some)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            follows = own[b] if b < len(some) else states[at] if at < len(states) else after
            starts, ends = bool(new[a]), follows is None or follows % n == 0 or follows // n != own[b - 1] // n
            yield row, piece, own[a] // n, starts, bool(ends), [x for x in some[a:b] if x.strip()]


def _speaks(model: Model, marker: str, rare: dict[str, tuple[np.ndarray, bool]]) -> bool:
    return marker in model.speakers or (marker in rare and rare[marker][1])


def _tally(model: Model, cut, rare: dict[str, tuple[np.ndarray, bool]]) -> Counter:
    """Turns by the signs of their speaker marker; those without one under None."""
    found = Counter()
    for _, _, _, starts, _, kept in cut:
        if starts and kept:
            marker, signs, _ = marker_of(kept[0])
            found[signs if _speaks(model, marker, rare) else None] += 1
    return found


def _style(tally: Counter) -> str | None:
    """The signs of the speaker markers of a conversation."""
    signs = max((s for s in tally if s is not None), key=lambda s: (tally[s], s), default=None)
    return signs if signs is not None and 2 * tally[signs] >= tally.total() else None


def _decoded(model: Model, rows: list[dict], chained: tuple[int | None, int | None, int | None]):
    """The turns of a conversation's share, and the marker table's entries for it."""
    before, last, after = chained
    rare = _rare(rows)
    states = model.decode(model.emissions([x for r in rows for x in _lines(r["text"])], rare), before, last)
    return list(_cut(rows, states, before, after)), rare


def _chained(model: Model, held: DataFrame):
    """(state before, last state, state after) of each share of a conversation that lies on several partitions, and the styles of these conversations."""
    shares = held.filter("text != ''").groupBy("conv", "part").agg(F.lit(1).alias("one"))
    many = shares.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    wanted = held.join(F.broadcast(many), held["conv"].eqNullSafe(many["conv"]), "left_semi")  # at most one for each partition
    shared = held.sparkSession.sparkContext.broadcast(model)

    def matrices(batches):
        for part, conv, rows in _segments(batches):
            lines, rare = [x for r in rows for x in _lines(r["text"])], _rare(rows)
            # The first line by itself, so that its state is known to the share before.
            for k, some in enumerate((lines[:1], lines[1:])):
                if some:
                    m = shared.value.transfer(shared.value.emissions(some, rare))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "conv": [repr(conv)], "m": [m.tobytes()]})

    out, n = {}, len(model.start)
    rows = _sorted(wanted).mapInArrow(matrices, "part int, k int, conv string, m binary").collect()
    for conv, some in groupby(sorted(rows, key=lambda r: (r.conv, r.part, r.k)), key=lambda r: r.conv):
        chain = [(r.part, np.frombuffer(r.m).reshape(n + 1, n)) for r in some]
        score, back = chain[0][1][n], []
        for _, m in chain[1:]:
            all_ = score[:, None] + m[:n]
            back.append(all_.argmax(axis=0))
            score = all_.max(axis=0)
        states = [int(score.argmax())]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        states.reverse()  # at the end of each link of the chain
        for part, links in groupby(range(len(chain)), key=lambda i: chain[i][0]):
            links = list(links)
            before = states[links[0] - 1] if links[0] else None
            out[part, conv] = (before, states[links[-1]], states[links[-1] + 1] if links[-1] + 1 < len(chain) else None)
    if not out:
        return out, {}
    chained = held.sparkSession.sparkContext.broadcast(out)

    def tallies(batches):
        for part, conv, rows in _segments(batches):
            if rows := [r for r in rows if r["text"]]:
                found = _tally(shared.value, *_decoded(shared.value, rows, chained.value[part, repr(conv)]))
                yield pa.RecordBatch.from_pydict({"conv": [repr(conv)] * len(found), "signs": pa.array(list(found), pa.string()), "n": pa.array(found.values(), pa.int64())})

    styles: dict[str, Counter] = {}
    for r in _sorted(wanted).mapInArrow(tallies, "conv string, signs string, n long").groupBy("conv", "signs").agg(F.sum("n").alias("n")).collect():
        styles.setdefault(r.conv, Counter())[r.signs] = r.n
    return out, {conv: _style(tally) for conv, tally in styles.items()}


def turns(held: DataFrame, model: Model) -> DataFrame:
    """(conv, place, piece, role, starts, ends, text, rendered): the turns of all parts of ``held``."""
    context = held.sparkSession.sparkContext
    held = _marked(held.select("part", "pos", "conv", "place", "text"), model)
    shared = context.broadcast((model, *_chained(model, held)))
    types = dict(held.dtypes)
    keys = [to_arrow_type(held.schema[c].dataType) for c in ("conv", "place")]

    def render(batches):
        model, chained, styles = shared.value
        for part, conv, rows in _segments(batches):
            rows = [r for r in rows if r["text"]]
            if not rows:
                continue
            cut, rare = _decoded(model, rows, chained.get((part, repr(conv)), (None, None, None)))
            style = styles[repr(conv)] if repr(conv) in styles else _style(_tally(model, cut, rare))
            out = []
            for row, piece, role, starts, ends, kept in cut:
                if starts and kept:
                    marker, signs, end = marker_of(kept[0])
                    if signs == style and _speaks(model, marker, rare):
                        kept[0] = kept[0][end:]
                role, text = model.roles[role], "\n".join(kept)
                shown = (f"<|{role}|>\n" if starts else "") + text + ("\n<|end|>" if ends else "")
                out.append((conv, row["place"], piece, role, starts, ends, text, shown))
            names = ["conv", "place", "piece", "role", "starts", "ends", "text", "rendered"]
            kinds = [*keys, pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _sorted(held).mapInArrow(
        render, f"conv {types['conv']}, place {types['place']}, piece int, role string, starts boolean, ends boolean, text string, rendered string"
    )
