"""Sequence packing by power-of-two decomposition.

A document of n ids is cut into pieces of 4096 ids and, for the rest, one piece for each binary digit of its length,
longest first. Every piece is a sequence of its own: its length is a power of two, so it needs no padding, and no
sequence crosses documents. Sequences of one length form a bucket; ``sequence_id`` runs through the buckets from the
longest to the shortest, so a range of ids of one bucket is a batch of equal lengths.

Rules. Null text is empty and gives the end id only. Every row is packed, repeated rows and ids too (each row is a
document); rows with a null doc_id keep it. Only doc_id and text are read. An empty table gives no pieces.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import running_before, stored
from faultline.llm.encoding import encoder, vocabulary_path

_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, bucket int, shard int, in_shard long, ids binary"
)
_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())]
    + [("bucket", pa.int32()), ("shard", pa.int32()), ("in_shard", pa.int64()), ("ids", pa.binary())]
)


def binary_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the powers of two of the rest in falling order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, longest: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, doc_tokens, bucket (log2 of the
    length), sequence_id, offset (always 0) and ids (little-endian unsigned 32-bit integers).

    The pieces are written once and numbered from counts per part and bucket, so no row is moved for its number.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    vocabulary = vocabulary or vocabulary_path()
    end = np.array([end_id], "<u4")

    def pieces(batches):
        shard, used = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, ids, offsets in encoder(vocabulary).encode(batch.column("text")):
                out = []
                for i in range(last - first):
                    whole = np.concatenate([ids[offsets[i] : offsets[i + 1]], end])
                    at, n = 0, len(whole)
                    for length in binary_lengths(n, longest):
                        bucket = length.bit_length() - 1
                        piece = whole[at : at + length].tobytes()
                        out.append((doc_ids[first + i], at, length, n, bucket, shard, int(used[bucket]), piece))
                        used[bucket] += 1
                        at += length
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _TYPES)], _TYPES)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = stored(source.mapInArrow(pieces, _PIECES), "pieces")
    counts = held.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    first = running_before(counts.withColumn("place", F.struct(-F.col("bucket"), "shard")), "place", "n", "first_id")
    placed = held.join(F.broadcast(first.select("bucket", "shard", "first_id")), ["bucket", "shard"])
    return placed.select(
        "doc_id", "start", "length", "doc_tokens", "bucket",
        (F.col("first_id") + F.col("in_shard")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )
