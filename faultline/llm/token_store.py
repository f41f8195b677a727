"""Token ids as binary files: one zstandard frame per document under a shared dictionary.

Files. ``<path>/blocks`` holds the blocks in document order as Parquet, so that any store that Spark reaches will do and
lost tasks leave nothing behind. A block is one row: the frames of neighbouring documents one after the other (``payload``)
and the index to reach any of them (``doc_ids``, ``offsets``, ``sizes``, ``n_tokens``), its place (``shard``, ``block``,
``before``: ids of the shard before it) and ``dictionary_hash``. ``<path>/meta`` has one row: the dictionary, its SHA-256,
the bytes of an id and the end id. A short document is read by decompressing its own frame only (:func:`lookup`).

Rules. Null text is empty and gives the end id only. Documents stand in ascending doc_id order, null ids first; rows of
one doc_id by the hash of their text. Every row is kept, also repeated ones. Only doc_id and text are read, so other
columns do not matter. An empty table gives an empty store.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import running_before
from faultline.llm.encoding import encoder, vocabulary_path

_BLOCKS = (
    "shard int, block int, before long, n_ids long, dictionary_hash string, doc_ids array<long>, offsets array<int>,"
    " sizes array<int>, n_tokens array<long>, payload binary"
)
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _encoded(column: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each row with the end id."""
    end = np.array([end_id], np.uint32)
    for first, last, ids, offsets in encoder(path).encode(column):
        for i in range(last - first):
            yield np.concatenate([ids[offsets[i] : offsets[i + 1]], end])


def train_dictionary(
    docs: DataFrame, vocabulary: str, end_id: int, width: int, sample_bytes: int, size: int, piece: int, most_docs: int = 1 << 16
) -> bytes:
    """A dictionary from a bounded sample, drawn by the hashes of the ids until it has ``sample_bytes`` bytes of text.

    Of each document up to four pieces of ``piece`` bytes are taken, spread over its whole length; a document counts with what it can
    give at most, so short documents are many. Small tables give a smaller dictionary: an eighth of the sample. It is empty only
    where the sample has less than 2 KB or is too uniform for the trainer to find anything to share.
    """
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    rows = docs.select("uid", "doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("size")).filter("size > 0")
    uids, total = [], 0
    for row in rows.orderBy("h", "doc_id", "uid").limit(most_docs).select("uid", "size").collect():
        uids.append((row.uid,))
        total += min(row.size, 4 * piece)
        if total >= sample_bytes:
            break
    chosen = docs.join(F.broadcast(docs.sparkSession.createDataFrame(uids, "uid long")), "uid", "left_semi")

    def pieces(batches):
        for batch in batches:
            for one in _encoded(batch.column("text"), vocabulary, end_id):
                raw = one.astype(f"<u{width}").tobytes()
                starts = sorted({i * max(len(raw) - piece, 0) // 3 // width * width for i in range(4)})
                yield pa.RecordBatch.from_pydict({"piece": [raw[a : a + piece] for a in starts]})

    samples = [bytes(r.piece) for r in chosen.mapInArrow(pieces, "piece binary").orderBy("piece").collect()]
    size = min(size, sum(map(len, samples)) // 8)
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:  # too few or too alike for a dictionary of this size
            size //= 2
    return b""


def write_store(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 1,
    sample_bytes: int = 1 << 22,
    dictionary_bytes: int = 1 << 15,
    piece_bytes: int = 1024,
    block_bytes: int = 1 << 18,
    level: int = 3,
) -> None:
    """Encode ``docs`` (doc_id, text) and write the store; one shuffle by ranges of doc_id, no task over all rows."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    width = 2 if max(encoder(vocabulary).vocabulary_size, end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, vocabulary, end_id, width, sample_bytes, dictionary_bytes, piece_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    meta = spark.createDataFrame(
        [(digest, bytearray(dictionary), width, end_id)], "dictionary_hash string, dictionary binary, width int, end_id int"
    )
    meta.coalesce(1).write.parquet(f"{path}/meta")

    def blocks(batches):
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_dict_id=False)
        doc_ids, frames, counts, held = [], [], [], 0

        def block():
            sizes = np.array([len(x) for x in frames], np.int32)
            row = {
                "shard": shard, "block": number, "before": before, "n_ids": sum(counts), "dictionary_hash": digest,
                "doc_ids": doc_ids, "offsets": (np.cumsum(sizes) - sizes).tolist(), "sizes": sizes.tolist(),
                "n_tokens": counts, "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], _BLOCK_TYPE)

        for batch in batches:
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(), _encoded(batch.column("text"), vocabulary, end_id), strict=True
            ):
                frame = packer.compress(ids.astype(f"<u{width}").tobytes())
                if frames and held + len(frame) > block_bytes:
                    yield block()
                    number, before = number + 1, before + sum(counts)
                    doc_ids, frames, counts, held = [], [], [], 0
                doc_ids.append(doc_id)
                frames.append(frame)
                counts.append(len(ids))
                held += len(frame)
        if frames:
            yield block()

    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    written = ordered.mapInArrow(blocks, _BLOCKS)
    written.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")


_BLOCK_TYPE = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("dictionary_hash", pa.string())]
    + [("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))]
    + [("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def _meta(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/meta").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.dictionary_hash:
        raise ValueError("the dictionary does not match its hash")
    return dictionary, row.dictionary_hash, row.width


def _unpacker(dictionary: bytes, digest: str, width: int):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    opener = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(block: dict, i: int) -> np.ndarray:
        if block["dictionary_hash"] != digest:
            raise ValueError("a block was written with another dictionary")
        first = block["offsets"][i]
        frame = block["payload"][first : first + block["sizes"][i]]
        return np.frombuffer(opener.decompress(frame), f"<u{width}").astype("<u4")

    return ids


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), with ``with_ids`` also the ids."""
    meta = _meta(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = running_before(blocks.groupBy("shard").agg(F.sum("n_ids").alias("all_ids")), "shard", "all_ids", "shard_start")
    placed = blocks.join(F.broadcast(shards.select("shard", "shard_start")), "shard")

    def rows(batches):
        open_ids = _unpacker(*meta)
        for batch in batches:
            for at in range(batch.num_rows):
                block = {k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()}
                start, out = block["shard_start"] + block["before"], []
                for i, (doc_id, n) in enumerate(zip(block["doc_ids"], block["n_tokens"], strict=True)):
                    ids = open_ids(block, i)
                    if len(ids) != n:
                        raise ValueError("a frame does not hold the indexed number of ids")
                    out.append((doc_id, start, n, zlib.crc32(ids), *([ids] if with_ids else [])))
                    start += n
                names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
                types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types)], names)

    columns = ["shard_start", "before", "dictionary_hash", "doc_ids", "offsets", "sizes", "n_tokens", "payload"]
    return placed.select(*columns).mapInArrow(rows, _ROWS + (", ids array<long>" if with_ids else ""))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents; of their blocks only their own frames are decompressed."""
    meta, wanted = _meta(spark, path), frozenset(doc_ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    hit = blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in doc_ids])))

    def rows(batches):
        open_ids = _unpacker(*meta)
        for batch in batches:
            for block in batch.to_pylist():
                at = [i for i, x in enumerate(block["doc_ids"]) if x in wanted]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([block["doc_ids"][i] for i in at], pa.int64()), "ids": pa.array([open_ids(block, i) for i in at], pa.list_(pa.int64()))}
                )

    return hit.mapInArrow(rows, "doc_id long, ids array<long>")
