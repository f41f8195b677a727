"""Framing of streams that go on over many files: numbers continue and a block may cross files.

Three steps make one query. Every input task frames what it has of a stream on its own: the lines of a file split in one batch are a
chunk, and its records are right but for its first block, which may go on from the chunk before, and its last one,
which may go on in the next. The keyed step stitches chunks: it keeps the last number and the open block of each stream
as state, joins a block that was cut and gives every chunk its first number. It is shown only how many records a chunk has and the
first and the last of them. The chunks themselves go past it, at the price of framing the lines twice, and meet their numbers in
tasks of their own. So a large stream is framed by many tasks, and its one task handles a row of bounded size per chunk.
"""

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultline import schemas as S
from faultline.functions.text import chomp, or_empty
from faultline.operators.framing import CONTINUATION, DEFAULT_MAX_LINE_BYTES, too_long
from faultline.operators.slices import SLICE
from faultline.sources.text import LINE_END

_EDGES = (
    "source string, stream_id string, file string, start bigint, pos bigint, lines boolean, hangs boolean, ends_open boolean,"
    " size bigint, left bigint, first string, first_received bigint, last string, last_received bigint"
)
_PACKED = "source string, stream_id string, file string, start bigint, pos bigint, records binary, letters binary"
#: Of a chunk (``file``, ``start`` and ``pos``), or of a stitched block, which has no file and comes with its ``records``.
_PLACED = (
    "source string, stream_id string, file string, start bigint, pos bigint, low bigint, high bigint, seq_no bigint,"
    " letter_no bigint, records binary"
)
#: State of a stream: numbers given so far and the block its last line left open.
STREAM = "last_seq bigint, last_letter bigint, is_open boolean, payload string, received_micros bigint"
STREAM_STATE = "stream"
#: Records and letters of :func:`frame_stream`.
FRAMED = T.StructType([*S.RAW_EVENT.fields, T.StructField("reason", T.StringType())])


def stream_lines(
    spark: SparkSession,
    path: str,
    source: str,
    stream_id: Column | None = None,
    received_at: Column | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files below a folder as line rows; the files of one folder are one stream unless ``stream_id`` says otherwise.

    Files are read in splits. Within a batch the files of a stream go by path, so their names must sort by time.
    """
    reader = spark.readStream.option("lineSep", LINE_END).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    file = F.col("_metadata.file_path")
    return reader.text(path).select(
        F.lit(source).alias("source"),
        (F.regexp_replace(file, "/[^/]*$", "") if stream_id is None else stream_id).alias("stream_id"),
        F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start")).alias(SLICE),
        F.col("value").alias("line"),
        (F.current_timestamp() if received_at is None else received_at).alias("received_at"),
    )


def _table(payloads: list, received: list):
    import pyarrow as pa

    return pa.table({"payload": pa.array(payloads, pa.string()), "received": pa.array(received, pa.int64())})


def _latest(received: list):
    """The greatest of some times, null if there is none."""
    return max((t for t in received if t is not None), default=None)


def _time(micros):
    """A time as it comes from pandas, where null may be a NaN."""
    return None if micros is None or micros != micros else int(micros)


def chunk_of(trace: bool, texts: list, has_text, continues, received: list):
    """The records of some lines in a row: (payloads, times, first one continues, last one is open)."""
    import numpy as np

    if not trace:
        at = np.flatnonzero(has_text).tolist()
        return [texts[i] for i in at], [received[i] for i in at], False, False
    before = np.concatenate(([False], has_text[:-1]))
    starts = np.flatnonzero(has_text & ~(continues & before))
    bounds = np.append(np.flatnonzero((has_text & ~(continues & before)) | ~has_text), len(texts))
    ends = bounds[np.searchsorted(bounds, starts, side="right")]
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    payloads = ["\n".join(texts[a:b]) for a, b in spans]
    hangs = len(texts) > 0 and bool(has_text[0] and continues[0])
    return payloads, [_latest(received[a:b]) for a, b in spans], hangs, len(texts) > 0 and bool(has_text[-1])


def _stitcher():
    """Processor of the chunks of a stream; defined here so that workers get it by value."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    from faultline.streaming.packing import to_bytes

    class Stitch(StatefulProcessor):
        def init(self, handle):
            self.stream = handle.getValueState(STREAM_STATE, STREAM)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            chunks = sorted((tuple(r)[1 + len(key) :] for frame in rows for r in frame.itertuples()), key=lambda chunk: chunk[:3])
            seq, letter, is_open, payload, received = self.stream.get() if self.stream.exists() else (0, 0, False, None, None)
            out = []

            def put(place, low, high, records=None):
                nonlocal seq
                out.append((*key, *place, low, high, seq + 1, letter + 1, records))
                seq += high - low

            for *place, lines, hangs, ends_open, size, left, first, first_received, last, last_received in chunks:
                low, high = 0, size
                if is_open and lines:
                    if hangs:
                        payload = f"{payload}\n{first}"
                        received = _latest([received, _time(first_received)])
                        low = 1
                    if not (hangs and high == 1 and ends_open):
                        put((None, 0, 0), 0, 1, to_bytes(_table([payload], [received])))
                        is_open, payload, received = False, None, None
                if ends_open and high > low:
                    high -= 1
                    is_open, payload, received = True, last, _time(last_received)
                if high > low or left:
                    put(place, low, high)
                    letter += left
            self.stream.update((seq, letter, is_open, payload, received))
            names = [part.split()[0] for part in _PLACED.split(", ")]
            yield pd.DataFrame(out, columns=names)

        def close(self):
            pass

    return Stitch()


def frame_stream(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """Line rows (``stream_lines``) as a stream of raw events with ``reason``: '' for records, else why a line was left out.

    Records are numbered from one, on and on; left-out lines have numbers of their own, negative. The last block of a
    stack-trace stream stays in the state until a line ends it, see ``open_blocks``. Rows without source or stream
    belong to the source or stream ''. A line cut in two by the end of its file stays two lines.
    """
    trace = F.col("source") == "stacktrace"
    bare = F.when(trace, chomp(F.col("line"))).otherwise(F.regexp_replace("line", r"\r\z", ""))
    marked = lines.select(
        or_empty(F.col("source")).alias("source"),
        or_empty(F.col("stream_id")).alias("stream_id"),
        F.col(SLICE)["file"].alias("file"),
        F.col(SLICE)["start"].alias("start"),
        "line",
        F.unix_micros("received_at").alias("received"),
    ).select(
        "*",
        or_empty(bare).alias("bare"),
        F.coalesce(F.rlike("line", F.lit(rf"\A{CONTINUATION}")), F.lit(False)).alias("continues"),
        F.coalesce(too_long(F.col("line"), max_line_bytes), F.lit(False)).alias("long"),
    )

    def chunks(batches):
        """(source, stream, file, start, pos), lines with text or not, chunk and left-out lines of each chunk of a task."""
        import numpy as np
        import pyarrow.compute as pc

        pos = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.ones(batch.num_rows, bool)
            change[1:] = False
            for name in ("source", "stream_id", "file", "start"):
                column = batch.column(name)
                other = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                change[1:] |= other.to_numpy(zero_copy_only=False).astype(bool)
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                long = part.column("long").to_numpy(zero_copy_only=False)
                kept = part.filter(pc.invert(part.column("long")))
                texts, received = kept.column("bare").to_pylist(), kept.column("received").to_pylist()
                has_text = np.array([text != "" for text in texts], bool)
                continues = kept.column("continues").to_numpy(zero_copy_only=False).astype(bool)
                place = {name: [part.column(name)[0].as_py()] for name in ("source", "stream_id", "file", "start")} | {"pos": [pos]}
                left = part.filter(part.column("long")) if long.any() else None
                yield place, len(texts) > 0, chunk_of(place["source"] == ["stacktrace"], texts, has_text, continues, received), left
                pos += 1

    schema = to_arrow_schema(T._parse_datatype_string(_EDGES))

    def edges(batches):
        import pyarrow as pa

        for place, lines, (payloads, times, hangs, ends_open), left in chunks(batches):
            ends = [payloads[0], times[0], payloads[-1], times[-1]] if payloads else [None] * 4
            values = [*place.values(), [lines], [hangs], [ends_open], [len(payloads)], [len(left) if left else 0], *([x] for x in ends)]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, values, strict=True)), schema=schema)

    def pack(batches):
        import pyarrow as pa

        from faultline.streaming.packing import to_bytes

        for place, _, (payloads, times, *_), left in chunks(batches):
            letters = left and to_bytes(_table(left.column("line").to_pylist(), left.column("received").to_pylist()))
            yield pa.RecordBatch.from_pydict({**place, "records": [to_bytes(_table(payloads, times))], "letters": pa.array([letters], pa.binary())})

    def unpack(batches):
        """Chunks and their places come in any order: what comes too early waits on disk."""
        import pyarrow as pa

        from faultline.streaming.packing import from_bytes

        def rows(source, stream, table, numbers, reason):
            n = len(table)
            return pa.RecordBatch.from_arrays([
                pa.array([source] * n, pa.string()), table.column("payload").combine_chunks(), pa.array([stream] * n, pa.string()),
                table.column("received").combine_chunks().cast(pa.timestamp("us", "UTC")), pa.array(numbers, pa.int64()), pa.array([reason] * n, pa.string()),
            ], names=FRAMED.names)

        def numbered(source, stream, low, high, seq_no, letter_no, records, letters):
            if high > low:
                table = from_bytes(records).slice(low, high - low)
                yield rows(source, stream, table, range(seq_no, seq_no + len(table)), "")
            if letters:
                table = from_bytes(letters)
                yield rows(source, stream, table, range(-letter_no, -letter_no - len(table), -1), S.LINE_TOO_LONG)

        places, waiting = {}, {}
        with tempfile.TemporaryFile() as held:
            for batch in batches:
                columns = [batch.column(name) for name in batch.schema.names]
                for i in range(batch.num_rows):
                    source, stream, *chunk, low, high, seq_no, letter_no, records, letters = (column[i].as_py() for column in columns)
                    chunk = (source, stream, *chunk)
                    if chunk[2] is None:
                        yield from numbered(source, stream, low, high, seq_no, letter_no, records, None)
                    elif seq_no is not None:
                        places[chunk] = (low, high, seq_no, letter_no)
                    elif chunk in places:
                        yield from numbered(source, stream, *places.pop(chunk), records, letters)
                    else:
                        waiting[chunk] = (held.tell(), len(records), len(letters or b""))
                        held.write(records + (letters or b""))
            for chunk, place in places.items():
                at, *sizes = waiting[chunk]
                held.seek(at)
                yield from numbered(*chunk[:2], *place, *(held.read(n) for n in sizes))

    stitched = (
        marked.mapInArrow(edges, _EDGES)
        .groupBy("source", "stream_id")
        .transformWithStateInPandas(_stitcher(), _PLACED, "Append", "None")
        .withColumn("letters", F.lit(None).cast("binary"))
    )
    packed = marked.mapInArrow(pack, _PACKED)
    unplaced = [F.lit(None).cast("bigint").alias(name) for name in ("low", "high", "seq_no", "letter_no")]
    packed = packed.select("source", "stream_id", "file", "start", "pos", *unplaced, "records", "letters")
    chunk = F.xxhash64("source", "stream_id", "file", "start", "pos")
    return stitched.union(packed).repartition(chunk).mapInArrow(unpack, FRAMED)


def open_blocks(spark: SparkSession, progress: str) -> DataFrame:
    """The blocks still open after the last batch, as raw events, read from the state below the ``progress`` folder: for
    streams that will not go on."""
    state = spark.read.format("statestore").option("stateVarName", STREAM_STATE).load(progress)
    return state.filter("value.is_open").select(
        F.col("key.source").alias("source"),
        F.col("value.payload").alias("payload"),
        F.col("key.stream_id").alias("stream_id"),
        F.timestamp_micros("value.received_micros").alias("received_at"),
        (F.col("value.last_seq") + 1).alias("seq_no"),
    )
