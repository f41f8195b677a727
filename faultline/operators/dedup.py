"""Deduplication of error signatures in windows anchored at the first occurrence.

The first event of a signature opens a window at its own time. Events less than the window
length after that are duplicates; the first one at or beyond it opens the next window.
"""

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import or_empty
from faultline.operators.columns import fresh_name
from faultline.session import materialize

DEFAULT_WINDOW_SECONDS = 300
# Signatures with more events than this are spread over many tasks.
HOT_ROWS = 2_000_000
# Hot signatures up to this count are sent to every task; it bounds the size of that table.
MAX_BROADCAST_KEYS = 100_000

RESULT = ("window_start", "is_novel", "window_count")


def window_micros(seconds: float) -> int:
    """Window length; the default for a length of zero or less."""
    return int((seconds if seconds > 0 else DEFAULT_WINDOW_SECONDS) * 1_000_000)


def kept_columns(events: DataFrame) -> list[str]:
    """The columns that stay; those with names of results are replaced by the results."""
    return [name for name in events.columns if name not in RESULT]


def dedup(
    events: DataFrame,
    window_seconds: float = DEFAULT_WINDOW_SECONDS,
    time: str = "received_at",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``window_start``, ``is_novel`` and ``window_count`` (the count up to this event).

    Needs ``signature``, ``stream_id``, ``seq_no`` and the ``time`` column; equal times go by
    stream and sequence number. Events without signature or time are always novel with count 1
    and have no window. Columns that already have the name of a result are replaced, all others are kept.
    ``events`` is read more than once: store it first when it is costly to compute.
    """
    width, hot_rows = window_micros(window_seconds), max(hot_rows, 1)
    columns = [F.col(f"`{name}`") for name in kept_columns(events)]
    at = fresh_name("micros")
    keyed = (
        events.select(*columns)
        .withColumn("signature", or_empty(F.col("signature")))
        .withColumn(at, F.unix_micros(F.col(time).cast("timestamp")))
    )
    placed = (F.col("signature") != "") & F.col(at).isNotNull()
    signed = keyed.filter(placed)
    unsigned = keyed.filter(~placed).select(
        *columns,
        F.lit(None).cast("timestamp").alias("window_start"),
        F.lit(True).alias("is_novel"),
        F.lit(1).cast("bigint").alias("window_count"),
    )
    hot = materialize(
        signed.groupBy("signature").count().filter(F.col("count") > hot_rows).select("signature")
    )
    hot_keys = hot.count()
    if hot_keys == 0:
        counted = _scan_windows(signed, at, width)
    else:
        few = F.broadcast(hot) if hot_keys <= MAX_BROADCAST_KEYS else hot
        counted = _scan_windows(signed.join(few, "signature", "left_anti"), at, width).unionByName(
            _spread_windows(signed.join(few, "signature", "left_semi"), at, width)
        )
    return counted.unionByName(unsigned).select(*columns, *RESULT)


def _result_schema(rows: DataFrame, at: str) -> T.StructType:
    return T.StructType([
        *[field for field in rows.schema.fields if field.name != at],
        T.StructField("window_start", T.TimestampType()),
        T.StructField("is_novel", T.BooleanType()),
        T.StructField("window_count", T.LongType()),
    ])


def _scan_windows(signed: DataFrame, at: str, width: int) -> DataFrame:
    """Windows of signatures that fit a task: one shuffle, one sort, one pass.

    The pass sees the rows of a partition ordered by signature and time and keeps only the open
    window between batches, so it needs no memory per group.
    """
    ordered = signed.repartition("signature").sortWithinPartitions(
        "signature", at, "stream_id", "seq_no"
    )
    schema = _result_schema(signed, at)
    return ordered.mapInArrow(lambda batches: _assign(batches, at, width, schema.names, {}), schema)


def _reached(starts, step):
    """Marks of the rows on the paths from ``starts`` along ``step`` (a row behind the last one ends a path).

    Pointers of 1, 2, 4, ... steps mark in turn, so the number of passes is the logarithm of the longest path.
    """
    import numpy as np

    marks = np.append(starts, False)
    pointer = np.append(step, len(step))
    while True:
        reached = pointer[np.flatnonzero(marks)]
        marks[reached] = True
        if (pointer == len(step)).all():
            return marks[:-1]
        pointer = pointer[pointer]


def _group_starts(keys):
    """Marks of the first rows of runs of equal values."""
    import numpy as np
    import pyarrow.compute as pc

    change = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return change


def _assign(batches, at: str, width: int, names: list[str], entries: dict) -> Iterator:
    """Rows ordered by signature and time with their windows.

    ``entries`` has (window start, count) of the windows that are open before the first row, by signature.
    """
    import numpy as np
    import pyarrow as pa

    open_key, open_start, open_count = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        keys = batch.column("signature")
        times = batch.column(at).to_numpy(zero_copy_only=False)
        change = _group_starts(keys)
        group_start = np.flatnonzero(change)
        group_end = np.append(group_start[1:], n)
        # One increasing axis for all groups; the gap keeps a step inside its group.
        spans = times[group_end - 1] - times[group_start] + width + 1
        base = np.concatenate(([0], np.cumsum(spans)[:-1]))
        group = np.cumsum(change) - 1
        axis = times - times[group_start][group] + base[group]
        # First row at or beyond the end of a window opened by this row; other groups begin anew.
        step = np.searchsorted(axis, axis + width, side="left")
        step = np.where(step < group_end[group], step, n)
        starts = change.copy()
        carried_start, carried_count = np.zeros(len(group_start), np.int64), np.zeros(len(group_start), np.int64)
        for g, row in enumerate(group_start.tolist()) if entries else [(0, 0)]:
            key = keys[row].as_py()
            held = (open_start, open_count) if key == open_key else entries.get(key)
            if held:
                carried_start[g], carried_count[g] = held
                first = row + int(np.searchsorted(times[row : group_end[g]], held[0] + width, side="left"))
                starts[row] = False
                if first < group_end[g]:
                    starts[first] = True
        novel = _reached(starts, step)
        opener = np.maximum.accumulate(np.where(novel, np.arange(n), -1))
        carried = opener < group_start[group]
        window = np.where(carried, carried_start[group], times[opener])
        count = np.where(carried, np.arange(n) - group_start[group] + 1 + carried_count[group], np.arange(n) - opener + 1)
        open_key, open_start, open_count = keys[n - 1].as_py(), int(window[-1]), int(count[-1])
        kept = [column for name, column in zip(batch.schema.names, batch.columns, strict=True) if name != at]
        start = pa.array(window).cast(pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays([*kept, start, pa.array(novel), pa.array(count)], names=names)


def slice_map(times, width: int):
    """How a slice of the times of one signature carries windows on: (ends, last, tail).

    ``times`` ascend. A window that is open before the slice ends at some time e; if ``ends[i]`` is the first of ``ends`` at or beyond e, the
    last window opened in the slice starts at ``last[i]`` and holds ``tail[i]`` of its events. Behind all ``ends`` the open
    window holds the whole slice. Neighbours that lead to the same last window are one entry.
    """
    import numpy as np

    distinct, first_row = np.unique(times, return_index=True)
    following = np.searchsorted(distinct, distinct + width, side="left")
    n = len(distinct)
    pointer = np.where(following < n, following, np.arange(n))
    while (pointer[pointer] != pointer).any():
        pointer = pointer[pointer]
    # The first window of the slice opens less than one window behind its first time, or at the first time beyond that.
    able = min(n, int(np.searchsorted(distinct, distinct[0] + width, side="left")) + 1)
    last = pointer[:able]
    kept = np.append(np.flatnonzero(last[1:] != last[:-1]), able - 1)
    return distinct[kept], distinct[last[kept]], len(times) - first_row[last[kept]]


def _spread_windows(signed: DataFrame, at: str, width: int) -> DataFrame:
    """Windows of signatures too frequent for one task: a parallel scan.

    Events are sorted by ranges of signature and time, a partition being a slice. Each slice gives the map from the window
    that is open where it begins to the one open where it ends. One step per slice then follows the maps from
    the first slice of a signature to its last, and with the window open at its beginning each slice is scanned on its own.
    """
    ordered = ["signature", at, "stream_id", "seq_no"]
    held = materialize(signed.repartitionByRange(*ordered).sortWithinPartitions(*ordered))

    def maps(batches):
        import numpy as np
        import pyarrow as pa

        part, key, parts = TaskContext.get().partitionId(), None, []

        def row():
            times = np.concatenate(parts)
            ends, last, tail = slice_map(times, width)
            return pa.RecordBatch.from_pydict({
                "signature": [key], "slice": [part], "size": [len(times)],
                "ends": [ends.astype("<i8").tobytes()], "last": [last.astype("<i8").tobytes()], "tail": [tail.astype("<i8").tobytes()],
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column("signature"), batch.column(at).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(_group_starts(keys)).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a].as_py() != key:
                    if parts:
                        yield row()
                    key, parts = keys[a].as_py(), []
                parts.append(times[a:b])
        if parts:
            yield row()

    def chained(batches):
        import numpy as np
        import pyarrow as pa

        key, start, count = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, part, size, *arrays = (column[i].as_py() for column in batch.columns)
                if name != key:
                    key, start, count = name, None, 0
                else:
                    yield pa.RecordBatch.from_pydict({"signature": [name], "slice": [part], "start": [start], "count": [count]})
                ends, last, tail = (np.frombuffer(data, "<i8") for data in arrays)
                entry = 0 if start is None else int(np.searchsorted(ends, start + width, side="left"))
                if entry < len(ends):
                    start, count = int(last[entry]), int(tail[entry])
                else:
                    count += size

    found = held.select("signature", at).mapInArrow(
        maps, "signature string, slice bigint, size bigint, ends binary, last binary, tail binary"
    )
    chain = found.repartition("signature").sortWithinPartitions("signature", "slice")
    # One row per partition and signature that goes on in it: as many as there are partitions and hot signatures.
    entries: dict[int, dict] = {}
    for row in chain.mapInArrow(chained, "signature string, slice bigint, start bigint, count bigint").collect():
        entries.setdefault(row.slice, {})[row.signature] = (row.start, row["count"])
    shared = held.sparkSession.sparkContext.broadcast(entries)
    schema = _result_schema(signed, at)
    names = schema.names

    def assigned(batches):
        return _assign(batches, at, width, names, shared.value.get(TaskContext.get().partitionId(), {}))

    return held.mapInArrow(assigned, schema)


def novel(deduped: DataFrame) -> DataFrame:
    """Only the events that go on to diagnosis."""
    return deduped.filter("is_novel")


def window_records(deduped: DataFrame, time: str = "received_at") -> DataFrame:
    """First seen, last seen and count per signature and window; events without time have none."""
    return (
        deduped.filter((F.col("signature") != "") & F.col("window_start").isNotNull())
        .groupBy("signature", "window_start")
        .agg(
            F.min(time).alias("first_seen"),
            F.max(time).alias("last_seen"),
            F.count("*").alias("count"),
        )
    )


def current_records(
    deduped: DataFrame, as_of: Column | None = None, time: str = "received_at"
) -> DataFrame:
    """The latest window record of every signature, seen from ``as_of`` when given."""
    seen = deduped if as_of is None else deduped.filter(F.col(time) <= as_of)
    records = window_records(seen, time)
    latest = F.max_by(F.struct("first_seen", "last_seen", "count"), "window_start")
    return records.groupBy("signature").agg(latest.alias("_r")).select("signature", "_r.*")


def tracked_records(
    deduped: DataFrame,
    as_of: Column,
    window_seconds: float = DEFAULT_WINDOW_SECONDS,
    time: str = "received_at",
) -> DataFrame:
    """Current records not evicted at ``as_of``: last seen less than one window length ago."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(
        F.col("last_seen").cast("timestamp")
    )
    return current_records(deduped, as_of, time).filter(age < window_micros(window_seconds))


def tracked_count(
    deduped: DataFrame,
    as_of: Column,
    window_seconds: float = DEFAULT_WINDOW_SECONDS,
    time: str = "received_at",
) -> DataFrame:
    """Number of tracked signatures at ``as_of``."""
    tracked = tracked_records(deduped, as_of, window_seconds, time)
    return tracked.agg(F.count("*").alias("tracked"))


def incidents(deduped: DataFrame) -> DataFrame:
    """Novel events with the full count of their window as ``dedup_count``.

    One aggregation per window instead of a join; events without signature or time stand alone.
    """
    event = [name for name in deduped.columns if name not in RESULT]
    single = (F.col("signature") == "") | F.col("window_start").isNull()
    signed = deduped.filter(~single)
    alone = deduped.filter(single).select(
        *event, F.lit(1).cast("bigint").alias("dedup_count")
    )
    opening = F.first(F.when(F.col("is_novel"), F.struct(*event)), ignorenulls=True)
    grouped = (
        signed.groupBy(F.col("signature").alias("_signature"), "window_start")
        .agg(opening.alias("_event"), F.count("*").alias("dedup_count"))
        .select("_event.*", "dedup_count")
    )
    return grouped.unionByName(alone)
