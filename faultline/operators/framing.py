"""Text streams to raw events: one record per line, or one per stack-trace block.

Two shapes of input are served. ``frame_text`` takes one row per stream with its whole text and
needs no shuffle. ``frame`` takes one row per line, so that a stream may be larger than a task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions import text as X
from faultline.operators.slices import (
    SLICE,
    running_total,
    sliced_by_position,
)

# Limits on the bytes of a line, its newline included.
DEFAULT_MAX_LINE_BYTES = 64 * 1024
SMALLEST_LIMIT = 4096

# A continuation line starts with a tab or four spaces, or its text starts with "at ".
_BLANKS = r"[\p{IsWhite_Space}&&[^\n]]*"
CONTINUATION = rf"(?:\t|    |{_BLANKS}at (?=[^\n]*[^\n\p{{IsWhite_Space}}]))"
# A block: a line with text, then continuation lines. Possessive, so that long blocks need no
# backtracking.
BLOCK = rf"\r*[^\r\n][^\n]*+(?:\n{CONTINUATION}[^\n]*+)*+"


def line_limit(max_line_bytes: int) -> int:
    """The limit in force: the default for no limit, and never below the smallest one."""
    return max(max_line_bytes if max_line_bytes > 0 else DEFAULT_MAX_LINE_BYTES, SMALLEST_LIMIT)


def too_long(line: Column, max_line_bytes: int) -> Column:
    """Line with its carriage return but without newline reaches the limit."""
    return F.octet_length(line) >= line_limit(max_line_bytes)


def _within_limit(text: Column, max_line_bytes: int, stop: bool) -> Column:
    """The text without long lines; with ``stop`` also without what follows the first one."""
    lines = X.lines(text)
    first = F.array_position(F.transform(lines, lambda x: too_long(x, max_line_bytes)), True)
    if stop:
        kept = F.slice(lines, F.lit(1), (first - 1).cast("int"))
    else:
        kept = F.filter(lines, lambda x: ~too_long(x, max_line_bytes))
    # A text below the limit has no long line; most streams skip the split.
    suspicious = too_long(text, max_line_bytes)
    return F.when(suspicious & (first > 0), F.array_join(kept, "\n")).otherwise(text)


def line_records(text: Column) -> Column:
    """Non-empty lines in order; one trailing carriage return per line is dropped."""
    lines = F.split(F.regexp_replace(text, r"\r\z", ""), r"\r?\n", -1)
    return F.filter(lines, lambda line: line != "")


def block_records(text: Column) -> Column:
    """Stack-trace blocks in order, line ends reduced to newlines."""
    blocks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))
    return F.transform(blocks, lambda block: F.regexp_replace(block, r"\r+(?=\n|\z)", ""))


def frame_text(
    streams: DataFrame,
    text: str = "text",
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    stop_at_long_line: bool = False,
) -> DataFrame:
    """One row per stream (``stream_id``, ``source``, ``received_at``, whole text) to raw events.

    Stack-trace streams use blocks, all others lines. Long lines are left out, see
    ``long_lines_of_text``; with ``stop_at_long_line`` the first ends its stream after the records
    before it. Works on streaming DataFrames too.
    """
    bounded = streams.withColumn(
        "_text", _within_limit(F.col(text), max_line_bytes, stop_at_long_line)
    )
    records = F.when(F.col("source") == "stacktrace", block_records(F.col("_text"))).otherwise(
        line_records(F.col("_text"))
    )
    return bounded.select(
        "source", "stream_id", "received_at", F.posexplode(records).alias("_pos", "payload")
    ).select(
        "source",
        "payload",
        "stream_id",
        "received_at",
        (F.col("_pos") + 1).cast("bigint").alias("seq_no"),
    )


def long_lines_of_text(
    streams: DataFrame,
    text: str = "text",
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    stop_at_long_line: bool = False,
) -> DataFrame:
    """Raw events of the lines that ``frame_text`` leaves out, for the dead letters: see ``long_lines``."""
    found = (
        streams.filter(too_long(F.col(text), max_line_bytes))
        .withColumn("_lines", X.lines(F.col(text)))
        .withColumn(
            "_first",
            F.array_position(F.transform("_lines", lambda x: too_long(x, max_line_bytes)), True),
        )
        .select("source", "stream_id", "received_at", "_first", F.posexplode("_lines").alias("_pos", "payload"))
    )
    long = too_long(F.col("payload"), max_line_bytes)
    behind = (F.col("_first") > 0) & (F.col("_pos") >= F.col("_first")) & (X.chomp(F.col("payload")) != "")
    return found.filter(long | behind if stop_at_long_line else long).select(
        "source",
        "payload",
        "stream_id",
        "received_at",
        (-F.col("_pos") - 1).cast("bigint").alias("seq_no"),
        F.when(long, S.LINE_TOO_LONG).otherwise(S.STREAM_STOPPED).alias("reason"),
    )


def _named(lines: DataFrame) -> DataFrame:
    """Line rows with slices; rows without stream or source belong to the stream or source ''."""
    lines = lines.withColumns({name: X.or_empty(F.col(name)) for name in ("stream_id", "source")})
    return lines if SLICE in lines.columns else sliced_by_position(lines, "line_no")


def _stops(lines: DataFrame, max_line_bytes: int) -> DataFrame:
    """Line rows with ``_end``, the place of the first long line of their stream, or null."""
    place = F.struct(SLICE, "line_no")
    ends = lines.filter(too_long(F.col("line"), max_line_bytes)).groupBy("stream_id").agg(F.min(place).alias("_end"))
    return lines.join(ends, "stream_id", "left")


def _bounded_lines(lines: DataFrame, max_line_bytes: int, stop: bool) -> DataFrame:
    """Line rows with slices, without long lines or with their streams cut."""
    lines = _named(lines)
    if not stop:
        return lines.filter(~F.coalesce(too_long(F.col("line"), max_line_bytes), F.lit(False)))
    before = F.col("_end").isNull() | (F.struct(SLICE, "line_no") < F.col("_end"))
    return _stops(lines, max_line_bytes).filter(before).drop("_end")


def long_lines(
    lines: DataFrame,
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    stop_at_long_line: bool = False,
) -> DataFrame:
    """Raw events of the lines that framing leaves out, for the dead letters.

    Numbers of records count records, so these have numbers of their own: the place of the line in its stream, from one,
    negative. No id of a record is the id of a letter. With ``stop_at_long_line`` the lines with text behind the first
    long one are given too, with a reason of their own, so that records and letters together hold the whole stream.
    """
    named = _named(lines)
    long = F.coalesce(too_long(F.col("line"), max_line_bytes), F.lit(False))
    if stop_at_long_line:
        behind = F.struct(SLICE, "line_no") > F.col("_end")
        named = _stops(named, max_line_bytes).filter(long | (behind & (X.chomp(F.col("line")) != "")))
    else:
        named = named.filter(long)
    return named.select(
        "source",
        F.col("line").alias("payload"),
        "stream_id",
        "received_at",
        (-F.col("line_no") - 1).cast("bigint").alias("seq_no"),
        F.when(long, S.LINE_TOO_LONG).otherwise(S.STREAM_STOPPED).alias("reason"),
    )


def frame_lines(
    lines: DataFrame,
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    stop_at_long_line: bool = False,
) -> DataFrame:
    """Line rows (``stream_id``, ``source``, ``line_no``, ``line``, ``received_at``) to records.

    Every non-empty line is one record, numbered per stream. A stream is numbered slice by
    slice, so its size does not matter.
    """
    kept = (
        _bounded_lines(lines, max_line_bytes, stop_at_long_line)
        .withColumn("payload", F.regexp_replace("line", r"\r\z", ""))
        .filter(F.col("payload") != "")
    )
    numbered = running_total(kept, ["stream_id"], ["line_no"], F.lit(1), "seq_no")
    return numbered.select("source", "payload", "stream_id", "received_at", "seq_no")


def frame_blocks(
    lines: DataFrame,
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    stop_at_long_line: bool = False,
) -> DataFrame:
    """Line rows of stack-trace streams to one record per block.

    A line opens a block when it has text and is no continuation of an open block; a block is
    open exactly when the line before had text. ``received_at`` is that of the last line. Blocks
    are built and numbered slice by slice; one row per slice is carried to the next ones, and a
    block cut by a slice end is put together again by its number.
    """
    in_slice = Window.partitionBy("stream_id", SLICE).orderBy("line_no")
    marked = (
        _bounded_lines(lines, max_line_bytes, stop_at_long_line)
        .withColumn("_bare", X.chomp(F.col("line")))
        .withColumn("_has_text", F.coalesce(F.col("_bare") != "", F.lit(False)))
        .withColumn("_open", F.lag("_has_text").over(in_slice))
    )
    # The first line of a slice counts as a start here; the carried values put that right.
    continues = F.rlike("line", F.lit(rf"\A{CONTINUATION}")) & F.col("_has_text")
    starts = F.col("_has_text") & ~(continues & F.coalesce("_open", F.lit(False)))
    numbered = marked.withColumns(
        {
            "_hangs": continues & F.col("_open").isNull(),
            "_inside": F.sum(starts.cast("bigint")).over(
                in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        }
    )
    slices = Window.partitionBy("stream_id").orderBy(SLICE)
    carried = (
        numbered.groupBy("stream_id", SLICE)
        .agg(
            F.max("_inside").alias("_starts"),
            F.max_by("_has_text", "line_no").alias("_ends_open"),
            F.bool_or("_hangs").alias("_hangs"),
        )
        .withColumn(
            "_goes_on",
            (F.col("_hangs") & F.lag("_ends_open", 1, False).over(slices)).cast("bigint"),
        )
        .select(
            "stream_id",
            SLICE,
            (
                F.sum(F.col("_starts") - F.col("_goes_on")).over(
                    slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                )
                - F.col("_starts")
            ).alias("_carried"),
        )
    )
    parts = F.sort_array(F.collect_list(F.struct("line_no", "_bare")))
    pieces = (
        numbered.filter("_has_text")
        .groupBy("source", "stream_id", SLICE, "_inside")
        .agg(
            F.array_join(F.transform(parts, lambda part: part["_bare"]), "\n").alias("_piece"),
            F.max("received_at").alias("received_at"),
        )
    )
    pieces = pieces.join(carried, ["stream_id", SLICE]).withColumn(
        "seq_no", F.col("_carried") + F.col("_inside")
    )
    parts = F.sort_array(F.collect_list(F.struct(SLICE, "_piece")))
    return (
        pieces.groupBy("source", "stream_id", "seq_no")
        .agg(
            F.array_join(F.transform(parts, lambda part: part["_piece"]), "\n").alias("payload"),
            F.max("received_at").alias("received_at"),
        )
        .select("source", "payload", "stream_id", "received_at", "seq_no")
    )


def frame(
    lines: DataFrame,
    max_line_bytes: int = DEFAULT_MAX_LINE_BYTES,
    stop_at_long_line: bool = False,
) -> DataFrame:
    """Line rows of any source: blocks for stack traces, lines for the others."""
    is_trace = F.col("source").eqNullSafe("stacktrace")
    options = (max_line_bytes, stop_at_long_line)
    return frame_blocks(lines.filter(is_trace), *options).unionByName(
        frame_lines(lines.filter(~is_trace), *options)
    )


def number_file_lines(
    lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES
) -> DataFrame:
    """Line framing of files read in place: sequence numbers without moving the lines.

    Rows of a file split are contiguous and in order, so an id given after dropping empty lines
    is dense inside the split; only one row per split is summed up across splits. Long lines are
    left out; ``long_file_lines`` gives them for the dead letters.
    """
    kept = (
        lines.filter(~F.coalesce(too_long(F.col("line"), max_line_bytes), F.lit(False)))
        .withColumn("payload", F.regexp_replace("line", r"\r\z", ""))
        .filter(F.col("payload") != "")
    )
    return _numbered_in_place(kept).select("source", "payload", "stream_id", "received_at", F.col("_place").alias("seq_no"))


def _numbered_in_place(kept: DataFrame) -> DataFrame:
    """Rows of file splits with ``_place``, their number in the stream from one."""
    kept = kept.withColumn("_id", F.monotonically_increasing_id())
    per_split = kept.groupBy("stream_id", SLICE).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows")
    )
    before = (
        Window.partitionBy("stream_id").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_split.select(
        "stream_id",
        SLICE,
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    placed = kept.join(offsets, ["stream_id", SLICE])
    return placed.withColumn("_place", F.col("_id") + F.col("_shift") + 1)


def long_file_lines(
    lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES, before: int = 0
) -> DataFrame:
    """Raw events of the long lines of files, for the dead letters.

    Only they are counted, not all lines: their number is minus their place among the long lines of the stream (and
    minus ``before``), so that no record has it. Numbers and lines come from one reading of the files.
    """
    long = lines.filter(too_long(F.col("line"), max_line_bytes))
    return _numbered_in_place(long).select(
        "source",
        F.col("line").alias("payload"),
        "stream_id",
        "received_at",
        (-F.col("_place") - F.lit(before)).cast("bigint").alias("seq_no"),
        F.lit(S.LINE_TOO_LONG).alias("reason"),
    )
