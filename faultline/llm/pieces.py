"""SentencePiece encoding and decoding with the tokenizers library.

The model file (a protobuf) is read directly: pieces with scores and kinds, model type, byte fallback, normalizer and white-space
rules. From these a tokenizer is rebuilt: the normalizer (its compiled character map, if any), the metaspace marker in place
of spaces and before the text, unigram scores or merges ranked by score, byte fallback, and the decoder.

Merges never cross from other characters to a marker if no piece does. A text's ids are then those of its segments (a run
of spaces with the characters up to the next space), and each distinct segment is encoded once per worker, in batches on
``threads`` threads. Each new segment is also encoded by the sentencepiece library and decoded again: ``parity`` tells whether all
segments of a text agree, ``round_trip`` whether all of them come back. Models with a normalizer that changes texts, and texts that hold the marker itself, are encoded whole.

Rules. Null text is empty and has no ids; every row is kept; other columns do not matter. Control pieces are never read from
texts. Models of other types, or with user-defined pieces, raise an error.
"""

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from faultline.llm.encoding import IdCache, vocabulary_path
from faultline.llm.textbatch import WINDOW, hash_words, row_slices, utf8, words

MARKER = "▁"
#: Kinds of pieces and model types, as the model file numbers them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_NOT_SPACE = np.arange(256) == 32


def protobuf(data: bytes):
    """(field number, value) of a message: integers, or bytes for anything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says. Field numbers are those of the public format."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(protobuf(file.read()))
        pieces = [dict(protobuf(v)) for k, v in parts if k == 1]
        trainer = dict(protobuf(next(v for k, v in parts if k == 2)))
        rules = dict(protobuf(next((v for k, v in parts if k == 3), b"")))
        self.pieces = [p[1].decode() for p in pieces]
        self.scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        self.type = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.character_map = rules.get(2, b"")
        self.prefix, self.trims, self.escapes = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if self.type not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds or not self.escapes:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")

    def merges(self) -> list[tuple[str, str]]:
        """For each piece, best score first, the pairs of pieces that make it."""
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        out = []
        for piece in sorted(ids, key=lambda p: (-self.scores[ids[p]], ids[p])):
            pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
            out += [x for x in pairs if x[0] in ids and x[1] in ids]
        return out

    def tokenizer(self) -> Tokenizer:
        unknown = self.kinds.index(UNKNOWN)
        if self.type == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=unknown, byte_fallback=self.byte_fallback)
        else:
            vocabulary = {p: i for i, p in enumerate(self.pieces)}
            model = models.BPE(vocabulary, self.merges(), unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.character_map)] if self.character_map else []
        if self.trims:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARKER)] * self.prefix + [normalizers.Replace(" ", MARKER)]
        out.normalizer = normalizers.Sequence(steps)
        if self.splits:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
        undo = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)] * self.prefix)
        return out

    @property
    def splits(self) -> bool:
        return not any(MARKER in p.lstrip(MARKER) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL)


class PieceEncoder:
    def __init__(self, path: str, threads: int, most_segments: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model, self.threads = Model(path), threads
        self.whole = self.model.tokenizer()
        self.parts = self.model.tokenizer()
        self.parts.normalizer = normalizers.Replace(" ", MARKER)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_segment = self.model.splits and self.model.prefix and not self.model.character_map and not self.model.trims
        self.cache = IdCache(most_segments)
        self.begins = np.array([p.startswith(MARKER) for p in self.model.pieces])
        self.agrees = self.returns = np.zeros(0, bool)

    def _whole(self, texts: list[str]):
        ids = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        # The library puts the marker before an empty text too, sentencepiece does not.
        ids = [x if t else x[:0] for x, t in zip(ids, texts, strict=True)]
        wanted = self.judge.encode(texts, num_threads=self.threads)
        same = np.array([np.array_equal(a, b) for a, b in zip(ids, wanted, strict=True)])
        return ids, same, np.array([a == b for a, b in zip(self.decode(ids), texts, strict=True)])

    def _wanted(self, shown: list[str]) -> list[list[int]]:
        """The ids of segments by sentencepiece, which puts the marker before each text itself (but an empty one)."""
        found = self.judge.encode([x[1:] for x in shown], num_threads=self.threads)
        return [y if x != " " else [self.judge.piece_to_id(MARKER)] for x, y in zip(shown, found, strict=True)]

    def _new(self, shown: list[str]):
        """Ids and counts, parity and round trip of segments, all plain or none. Plain ones, words after one space go to the library as joined texts, in
        whose ids each piece that begins with the marker begins a segment."""
        joined = ["".join(shown[a : a + 4096]) for a in range(0, len(shown), 4096)]
        plain = shown[0][:1] == " " and shown[0][1:2] not in ("", " ")
        found = [x.ids for x in self.parts.encode_batch_fast(joined if plain else shown, add_special_tokens=False)]
        ids, wanted = np.array([i for x in found for i in x], np.uint32), self._wanted(shown)
        size = np.array([len(x) for x in found], np.int64)
        if plain:
            size = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
            if len(size) != len(shown):
                raise ValueError("a segment has no piece that begins with the marker")
        same = np.ones(len(shown), bool)
        if [len(x) for x in wanted] != size.tolist() or [i for x in wanted for i in x] != ids.tolist():
            cuts = np.cumsum(size)[:-1]
            same = np.array([x.tolist() == y for x, y in zip(np.split(ids, cuts), wanted, strict=True)])
        texts = [x[1:] for x in (joined if plain else shown)]
        back = [x == y for x, y in zip(self.whole.decode_batch(found, skip_special_tokens=False), texts, strict=True)]
        if plain and not all(back):
            back = [x == y[1:] for x, y in zip(self.decode(np.split(ids, np.cumsum(size)[:-1])), shown, strict=True)]
        return ids, size, same, np.array(back) if len(back) == len(shown) else np.full(len(shown), all(back))

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids, parity and round trip of rows that do not hold the marker."""
        starts, ends = words(data, offsets, _NOT_SPACE)
        # A segment also has the spaces before its word; those at the end of a row, or the first one of a row, are
        # segments of their own or belong to the first word, with the marker that stands before the text.
        row_start = offsets[np.searchsorted(offsets, starts, "right") - 1]
        before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        begin = np.maximum(before, row_start)
        last = offsets[:-1].copy()
        place = np.searchsorted(ends, offsets[1:], "right") - 1
        has = (place >= 0) & (ends[np.maximum(place, 0)] > offsets[:-1]) if len(ends) else np.zeros(len(last), bool)
        last[has] = ends[place[has]]
        tail = np.flatnonzero(last < offsets[1:])
        begin, ends = np.concatenate([begin, last[tail]]), np.concatenate([ends, offsets[1:][tail]])
        order = np.argsort(begin, kind="stable")
        begin, ends = begin[order], ends[order]
        if not len(begin):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1), *np.ones((2, len(offsets) - 1), bool)
        first = np.isin(begin, offsets[:-1])
        keys = hash_words(data, begin, ends)
        keys[first] ^= np.uint64(0x9E3779B97F4A7C15)
        keys[keys == 0] = 1
        text = data.tobytes()

        def new(at: np.ndarray):
            names = [text[a:b].decode() for a, b in zip(begin[at].tolist(), ends[at].tolist(), strict=True)]
            shown = [" " + x if f else x for x, f in zip(names, first[at].tolist(), strict=True)]
            plain = np.array([x[0] == " " and x[1:2] not in ("", " ") for x in shown])
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            halves = [self._new([shown[i] for i in some]) for some in (np.flatnonzero(plain), np.flatnonzero(~plain)) if len(some)]
            ids, size, same, back = (np.concatenate(x) for x in zip(*halves, strict=True))
            # Nothing remains of the earlier ones if the cache was emptied for the new segments.
            self.agrees = np.concatenate([self.agrees[: self.cache.table.n], same])
            self.returns = np.concatenate([self.returns[: self.cache.table.n], back])
            return order, ids, size

        ids, to, at = self.cache.lookup(keys, new)
        cuts = np.concatenate([[0], to])[np.searchsorted(begin, offsets)]
        rows = np.searchsorted(begin, offsets)
        all_of = lambda good: np.diff(np.concatenate([[0], np.cumsum(~good[at])])[rows]) == 0
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], all_of(self.agrees), all_of(self.returns)

    def encode(self, column: pa.Array):
        """Yields (first row, past-the-end row, then ids, parity and round trip of each row) for runs of rows."""
        data, offsets = utf8(column)
        mark = MARKER.encode()
        for first, last in row_slices(offsets, 4 * WINDOW):
            part = offsets[first : last + 1] - offsets[first]
            bytes_ = data[offsets[first] : offsets[last]]
            text = bytes_.tobytes()
            if self.by_segment and mark not in text:
                yield first, last, *self._segments(bytes_, part)
                continue
            for i in range(last - first):
                one = text[part[i] : part[i + 1]]
                if self.by_segment and mark not in one:
                    found = self._segments(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
                else:
                    found = self._whole([one.decode()])
                yield first + i, first + i + 1, *found

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def piece_encoder(path: str, threads: int) -> PieceEncoder:
    return PieceEncoder(path, threads)


def encode(docs: DataFrame, path: str | None = None, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_crc32, round_trip (decoding gives the text
    back) and parity (sentencepiece gives the same ids) of every row of ``docs``."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches):
        for batch in batches:
            one = piece_encoder(path, threads)
            for first, last, ids, same, back in one.encode(batch.column("text")):
                part = batch.slice(first, last - first)
                raw = [x.astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": np.array([len(x) for x in ids], np.int64), "ids": pa.array(raw, pa.binary()),
                    "ids_crc32": np.array([zlib.crc32(x) for x in raw], np.int64), "round_trip": back, "parity": same,
                })

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_crc32 long, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, path: str | None = None, threads: int = 2) -> DataFrame:
    """(doc_id, text) of rows with ids as :func:`encode` returns them."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": piece_encoder(path, threads).decode(ids)})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
