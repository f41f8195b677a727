"""Deduplication of a stream of signatures, with the open window kept between batches.

Signatures are dealt into buckets by their hash, and three steps make one query. The rows of each input task are packed by bucket into
chunks, in which signature and ordering columns (time, stream, number) stand apart from the rest. The keyed step sees only chunks: it
merges the ordering columns of a bucket, finds the windows of each signature by jumps over the sorted times and hands the rows on
unopened. The chunks are then dealt out again and unpacked. So the one task that a signature has by definition does little work per
event, and chunks, calls to the state store and timers go by buckets, however many signatures there are.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import or_empty
from faultline.operators.columns import fresh_name
from faultline.operators.dedup import DEFAULT_WINDOW_SECONDS, kept_columns, window_micros
from faultline.streaming.packing import from_bytes, to_bytes

_PACKED = "bucket int, place binary, rows binary"
_COUNTED = "rows binary, windows binary, counts binary"
#: State of a bucket: the last window of each of its signatures, as one packed table.
RECORDS = "records binary"
RECORD_STATE = "record"
_RECORD = ("signature", "first_seen", "last_seen", "count", "changed")
#: An input task packs this many rows or bytes at once.
_PACK_ROWS, _PACK_BYTES = 1 << 17, 1 << 24


def _ordered(table):
    """Order of rows by signature, time, stream and number; null first as in a sorted table."""
    import pyarrow.compute as pc

    keys = [(name, "ascending") for name in ("code", "micros", "stream_id", "seq_no")]
    return pc.sort_indices(table, sort_keys=keys, null_placement="at_start")


def windows_of(times, width: int, state):
    """Window start and running count of each sorted time, and the state after them.

    ``state`` is (first seen, last seen, count) of the open window or None. A time before the open window counts in it.
    """
    import numpy as np

    total = len(times)
    window, count = np.empty(total, np.int64), np.empty(total, np.int64)
    first, last, seen = state or (int(times[0]), int(times[0]), 0)
    at = 0
    while at < total:
        end = int(np.searchsorted(times, first + width, side="left"))
        if end > at:
            window[at:end] = first
            count[at:end] = np.arange(seen + 1, seen + 1 + end - at)
            seen += end - at
            last = max(last, int(times[end - 1]))
            at = end
        if at < total:
            first, last, seen = int(times[at]), int(times[at]), 0
    return window, count, (first, last, seen)


def _processor(width: int, ordered: bool, evict: bool, ttl_millis: int | None):
    """Processor; defined here so that workers get it by value."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Windows(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.record = handle.getValueState(RECORD_STATE, RECORDS)
            # Chunks that wait for the watermark: earliest time in them, ordering columns, rows.
            self.held = handle.getListState("held", "low bigint, place binary, rows binary") if ordered else None

        def handleInputRows(self, key, rows, timerValues):
            chunks = [(place, data) for frame in rows for place, data in zip(frame["place"], frame["rows"], strict=True)]
            if not ordered:
                now = timerValues.getCurrentProcessingTimeInMs() if ttl_millis else 0
                records = self._records()
                if ttl_millis:
                    records = {name: r for name, r in records.items() if r[3] + ttl_millis > now}
                yield self._count([(from_bytes(place), data) for place, data in chunks], records, now)
                self._keep(records)
                self._timer(self._due(records))
                return
            import pyarrow.compute as pc

            waiting = [(pc.min(from_bytes(place).column("micros")).as_py(), place, data) for place, data in chunks]
            self.held.appendList(waiting)
            self._timer(min(low for low, *_ in waiting) // 1000 + 1, later=False)

        def _records(self) -> dict:
            """(first seen, last seen, count, time of day of the last change) of the last window of each signature."""
            if not self.record.exists():
                return {}
            names, *values = (column.to_pylist() for column in from_bytes(self.record.get()[0]).columns)
            return dict(zip(names, zip(*values, strict=True), strict=True))

        def _keep(self, records: dict) -> None:
            import pyarrow as pa

            if not records:
                self.record.clear()
                return
            columns = [list(records), *([int(v) for v in column] for column in zip(*records.values(), strict=True))]
            types = [pa.string(), *[pa.int64()] * 4]
            self.record.update((to_bytes(pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_RECORD)),))

        def _count(self, chunks, records, now=0):
            """Windows and counts of the rows of ``chunks``; ``records`` get the last windows."""
            import numpy as np
            import pandas as pd
            import pyarrow as pa

            places = pa.concat_tables([place for place, _ in chunks])
            codes = places.column("signature").combine_chunks().dictionary_encode()
            order = _ordered(places.append_column("code", codes.indices)).to_numpy()
            times, names = places.column("micros").to_numpy()[order], codes.dictionary.to_pylist()
            ends = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(names) + 1)).tolist()
            starts, counts = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
            for name, a, b in zip(names, ends[:-1], ends[1:], strict=True):
                last = records.get(name)
                window, count, state = windows_of(times[a:b], width, last and last[:3])
                starts[order[a:b]], counts[order[a:b]] = window, count
                records[name] = (*state, now)
            cuts = np.cumsum([0, *(len(place) for place, _ in chunks)]).tolist()
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pd.DataFrame({
                "rows": [data for _, data in chunks],
                "windows": [starts[a:b].astype("<i8").tobytes() for a, b in parts],
                "counts": [counts[a:b].astype("<i8").tobytes() for a, b in parts],
            })

        def _due(self, records, waits=()):
            """When the first record goes: one window old by the clock of the stream, or unchanged for the time to live."""
            if ttl_millis:
                times = [r[3] + ttl_millis - 1 for r in records.values()]
            else:
                times = [-(-(r[1] + width) // 1000) for name, r in records.items() if name not in waits]
            return min(times, default=None)

        def _timer(self, due, later=True):
            """One timer a bucket. Unless ``later``, an earlier one stays."""
            if not (evict or ttl_millis):
                return
            timers = list(self.handle.listTimers())
            if timers == [due] or (timers and not later and min(timers) <= due):
                return
            for timer in timers:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pyarrow.compute as pc

            records = self._records()
            if ttl_millis:
                now = timerValues.getCurrentProcessingTimeInMs()
                records = {name: r for name, r in records.items() if r[3] + ttl_millis > now}
                self._keep(records)
                self._timer(self._due(records))
                return
            now = timerValues.getCurrentWatermarkInMs() * 1000
            held = [(low, from_bytes(place), place, data) for low, place, data in self.held.get()] if self.held is not None and self.held.exists() else []
            # The record of a signature with waiting events stays until they are counted.
            waited = {name for _, table, *_ in held for name in pc.unique(table.column("signature")).to_pylist()}
            records = {name: r for name, r in records.items() if name in waited or r[1] + width > now}
            due, waiting, waits = [], [], set()
            for low, table, place, data in held:
                if low > now:
                    waiting.append((low, place, data))
                    waits.update(pc.unique(table.column("signature")).to_pylist())
                    continue
                rows = from_bytes(data)
                ripe = pc.less_equal(table.column("micros"), now)
                due.append((table.filter(ripe), to_bytes(rows.filter(ripe))))
                rest = table.filter(pc.invert(ripe))
                if len(rest):
                    waiting.append((pc.min(rest.column("micros")).as_py(), to_bytes(rest), to_bytes(rows.filter(pc.invert(ripe)))))
                    waits.update(pc.unique(rest.column("signature")).to_pylist())
            if due:
                if waiting:
                    self.held.put(waiting)
                else:
                    self.held.clear()
                yield self._count(due, records)
            self._keep(records)
            dues = [low // 1000 + 1 for low, *_ in waiting] + [self._due(records, waits)]
            self._timer(min((x for x in dues if x is not None), default=None))

        def close(self):
            pass

    return Windows()


def dedup_stream(
    events: DataFrame,
    window_seconds: float = DEFAULT_WINDOW_SECONDS,
    time: str = "received_at",
    lateness_seconds: float | None = None,
    ordered: bool = False,
    ttl_seconds: float | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Streaming form of ``dedup``: same columns added, state per signature between batches. No event is ever dropped.

    Within a batch the events of a signature go by time; an event older than the open window counts as duplicate. Events
    without signature or time are novel and have no window.

    ``lateness_seconds`` gives the stream a clock, the greatest time so far less the lateness: a record is evicted when it has not been
    seen for one window of that clock. ``ordered`` also holds events back until the clock has passed them and then takes
    them in order, so that results equal those of the batch form whatever the order of arrival, for events that are not later than
    the lateness; later ones count as they arrive. Events of any signature move the clock.

    ``ttl_seconds`` evicts records by the time of day instead, that long after they were last changed. While the stream keeps up,
    a length of one window changes no result; after a longer stop an event may open a window it would have been in. Under
    a trigger that ends (``availableNow``) run such a query with :func:`faultline.streaming.ingest.run_to_table`.

    The state is kept in ``buckets`` of signatures, fixed for a checkpoint. A bucket's events of one batch, its waiting events and its records
    are in one task's memory at a time, and its records are written anew in each batch that has events of it.
    """
    if ordered and lateness_seconds is None:
        raise ValueError("ordered needs lateness_seconds")
    if ttl_seconds is not None and lateness_seconds is not None:
        raise ValueError("evict by ttl_seconds or by lateness_seconds, not by both")
    width = window_micros(window_seconds)
    columns = [F.col(f"`{name}`") for name in kept_columns(events)]
    micros, bucket = fresh_name("micros"), fresh_name("bucket")
    keyed = events.select(*columns).withColumn("signature", or_empty(F.col("signature")))
    if lateness_seconds is not None:
        keyed = keyed.withWatermark(time, f"{int(lateness_seconds * 1000)} milliseconds")
    placed = (F.col("signature") != "") & F.col(time).isNotNull()
    unsigned = keyed.filter(~placed).select(
        *columns,
        F.lit(None).cast("timestamp").alias("window_start"),
        F.lit(True).alias("is_novel"),
        F.lit(1).cast("bigint").alias("window_count"),
    )
    signed = keyed.filter(placed).select(
        *columns,
        F.unix_micros(F.col(time).cast("timestamp")).alias(micros),
        F.pmod(F.xxhash64("signature"), F.lit(buckets)).cast("int").alias(bucket),
    )

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def packed(held):
            table = pa.Table.from_batches(held)
            code = table.column(bucket).to_numpy()
            order = np.argsort(code, kind="stable")
            found, firsts = np.unique(code[order], return_index=True)
            cuts = [*firsts.tolist(), len(code)]
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            sorted_rows = table.take(pa.array(order)).combine_chunks()
            place = sorted_rows.select(["signature", micros, "stream_id", "seq_no"]).rename_columns(["signature", "micros", "stream_id", "seq_no"])
            rows = sorted_rows.drop_columns([micros, bucket])
            return pa.RecordBatch.from_arrays([
                pa.array(found, pa.int32()),
                pa.array([to_bytes(place.slice(a, b - a)) for a, b in parts], pa.binary()),
                pa.array([to_bytes(rows.slice(a, b - a)) for a, b in parts], pa.binary()),
            ], names=["bucket", "place", "rows"])

        held, rows, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= _PACK_ROWS or size >= _PACK_BYTES:
                yield packed(held)
                held, rows, size = [], 0, 0
        if held:
            yield packed(held)

    output = T.StructType([
        *keyed.select(*columns).schema.fields,
        T.StructField("window_start", T.TimestampType()),
        T.StructField("is_novel", T.BooleanType()),
        T.StructField("window_count", T.LongType()),
    ])

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data, starts, counts in zip(*([value.as_buffer() for value in column] for column in batch.columns), strict=True):
                count = np.frombuffer(counts, "<i8")
                added = [pa.array(np.frombuffer(starts, "<i8")).cast(pa.timestamp("us", "UTC")), pa.array(count == 1), pa.array(count)]
                for rows in from_bytes(data).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=output.names)

    evict = lateness_seconds is not None
    ttl = None if ttl_seconds is None else int(max(ttl_seconds * 1000, 1))
    counted = (
        signed.mapInArrow(pack, _PACKED)
        .groupBy("bucket")
        .transformWithStateInPandas(
            _processor(width, ordered, evict, ttl), _COUNTED, "Append", "EventTime" if evict else "ProcessingTime" if ttl else "None"
        )
    )
    spread = counted.repartition(F.xxhash64("rows")).mapInArrow(unpack, output)
    return spread.unionByName(unsigned)


def stream_records(spark: SparkSession, progress: str, operator: int = 0) -> DataFrame:
    """The current record of each signature of a ``dedup_stream`` query, read from its state below the ``progress`` folder.

    The state of the last finished batch is read as a table while the query goes on; nothing is kept twice.
    """
    state = (
        spark.read.format("statestore")
        .option("operatorId", operator)
        .option("stateVarName", RECORD_STATE)
        .load(progress)
    )

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                for records in from_bytes(data.as_buffer()).to_batches():
                    yield pa.RecordBatch.from_arrays(records.columns[:4], names=_RECORD[:4])

    records = state.select("value.records").mapInArrow(unpack, "signature string, first_seen bigint, last_seen bigint, count bigint")
    return records.select(
        "signature",
        F.timestamp_micros("first_seen").alias("first_seen"),
        F.timestamp_micros("last_seen").alias("last_seen"),
        "count",
    )


def stream_tracked_count(records: DataFrame, as_of: Column, window_seconds: float = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """Number of signatures among ``stream_records`` that are less than one window old at ``as_of``."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("last_seen")
    return records.filter(age < window_micros(window_seconds)).agg(F.count("*").alias("tracked"))
