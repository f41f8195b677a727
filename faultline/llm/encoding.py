"""Token ids of whole texts by the tokenizers library, one library call per batch of new words.

The tokenizer drops white space, never joins text across it and merges only within parts: runs of letters, single
digits, runs of other signs. A text's ids are therefore those of its parts, one after the other, and each distinct part
is encoded once per worker. Chunks with anything but plain letters, digits and signs are encoded whole instead.
"""

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from faultline.llm.textbatch import SPACE, WINDOW, hash_words, mixed, row_slices, utf8, words

_STEPS = {"NFC", "Replace", "Lowercase"}
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.array([_LETTER if c >= 128 or chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN for c in range(256)])
#: Bytes of chunks that are encoded whole: controls, apostrophes (contractions), "<" (added tokens), and what starts
#: characters outside of À to ɏ, where all but two are letters.
_WHOLE = np.array([c < 33 or c == 127 or chr(c) in "'<" or c == 0xC2 or c > 0xC9 for c in range(256)]) & ~SPACE
#: The signs × and ÷, and İ, which turns into two characters in lower case.
_ODD = [b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0"]
_WHOLE_SALT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class KeyTable:
    """A hash table from 64-bit keys to 0, 1, 2 ... in the order they are added, for whole arrays of keys."""

    def __init__(self, most: int):
        self.bits = max(most, 8).bit_length() + 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is not there. Keys are not 0."""
        out = np.full(len(keys), -1, np.int32)
        open_, slots = np.arange(len(keys)), self._slots(keys)
        while len(open_):
            held = self.keys[slots]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (held != 0)
            open_, slots = open_[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[free]
            self.values[slots[free]] = numbers[free]
            more = self.keys[slots] != keys
            keys, numbers, slots = keys[more], numbers[more], (slots[more] + 1) & ((1 << self.bits) - 1)


class IdCache:
    """The ids of up to ``most`` distinct parts, by 64-bit keys, for whole arrays of parts."""

    def __init__(self, most: int):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.table = KeyTable(self.most)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])
        self.table.add(keys)

    def lookup(self, keys: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, their counts, and the numbers of the parts in the cache.
        ``encode`` gets the places of new parts and returns (their order, their ids in that order, their counts)."""
        at = self.table.find(keys)
        for attempt in range(2):
            new = np.flatnonzero(at < 0)
            if not len(new):
                break
            fresh, one = np.unique(keys[new], return_index=True)
            if self.table.n + len(fresh) > self.most and self.table.n and not attempt:
                self._forget()
                at[:] = -1
                continue
            if len(fresh) > self.most:  # one very long text
                self.most = 2 * len(fresh)
                self._forget()
            order, ids, size = encode(new[one])
            self._learn(fresh[order], ids, size)
            at = self.table.find(keys)
        size = self.size[at]
        to = np.cumsum(size)
        ids = self.pool[np.arange(to[-1]) + np.repeat(self.first[at] - (to - size), size)]
        return ids, to, at


class Encoder:
    """Encodes batches of texts with one word-ending vocabulary; keeps the ids of up to ``most_parts`` parts."""

    def __init__(self, path: str, most_parts: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self._check()
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.ends_word = np.zeros(self.vocabulary_size, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True
        self.letters = _byte_letters()
        self.cache = IdCache(most_parts)

    def _check(self) -> None:
        """The short way holds for this kind of tokenizer only; others raise instead of giving other ids."""
        spec = json.loads(self.whole.to_str())
        steps = {x["type"] for x in spec["normalizer"]["normalizers"]}
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        kinds = spec["model"]["type"], split["type"], level["type"]
        if steps != _STEPS or kinds != ("BPE", "Split", "ByteLevel") or not self.suffix:
            raise ValueError("not a lower-casing byte-level vocabulary with word ends")
        if not split["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") or not split["invert"]:
            raise ValueError("the split must keep runs of letters, digits and runs of other signs")

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts and how many each part has; one library call."""
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        shown = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in map(str.lower, parts)]
        ids = np.array(self.parts.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        if len(cuts) != len(shown):
            raise ValueError("the vocabulary has parts without a word end")
        return ids, np.diff(cuts, prepend=0)

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray):
        """The ids of new parts, plain ones first: (order, ids, counts)."""
        text = data.tobytes()
        order = np.argsort(whole, kind="stable")
        names = [text[a:b].decode() for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]
        plain = len(names) - int(whole.sum())
        ids, size = self._ids(names[:plain])
        others = [x.ids for x in self.whole.encode_batch_fast(names[plain:], add_special_tokens=False)]
        size = np.concatenate([size, np.array([len(x) for x in others], np.int64)])
        return order, np.concatenate([ids, *(np.array(x, np.uint32) for x in others)]), size

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts, and which of them are chunks to be encoded whole."""
        starts, ends = words(data, offsets)
        odd = _WHOLE[data]
        text = data.tobytes()
        for sign in _ODD:
            at = text.find(sign)
            while at >= 0:
                odd[at] = True
                at = text.find(sign, at + 1)
        marked = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
        kinds = _CLASS[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        for a, b in zip(starts[marked].tolist(), ends[marked].tolist(), strict=True):
            cut[a:b] = False
        cut[starts] = True
        cut &= ~SPACE[data]
        begin = np.flatnonzero(cut)
        # A part ends where the next begins, but at the end of its chunk at the latest.
        last = np.ones(len(begin), bool)
        first = np.zeros(len(data), bool)
        first[starts] = True
        last[:-1] = first[begin[1:]]
        finish = np.append(begin[1:], len(data))
        finish[last] = ends
        whole = np.zeros(len(begin), bool)
        whole[np.searchsorted(begin, starts[marked])] = True
        return begin, finish, whole

    def _encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, whole = self._parts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys = hash_words(data, starts, ends, lower=True)
        if whole.any():  # case counts in added tokens
            keys[whole] = mixed(hash_words(data, starts[whole], ends[whole]) + _WHOLE_SALT)
        keys[keys == 0] = 1
        ids, to, _ = self.cache.lookup(keys, lambda new: self._new(data, starts[new], ends[new], whole[new]))
        before = np.concatenate([[0], to])
        return ids, before[np.searchsorted(starts, offsets, "left")]

    def encode(self, column: pa.Array):
        """Yields (first row, past-the-end row, ids, offsets of the rows in ids) for runs of rows."""
        data, offsets = utf8(column)
        for first, last in row_slices(offsets, 4 * WINDOW):
            part = offsets[first : last + 1]
            yield first, last, *self._encode_rows(data[part[0] : part[-1]], part - part[0])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)
