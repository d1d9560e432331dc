"""Whole-text encoding with public tokenizers, memoised by white-space chunk.

A byte-level BPE with the usual splitting pattern never lets a token cross the
boundary before a space that has a non-space on one of its sides, and the
word-end BPE drops white space. Encoding the chunks of a text one by one
therefore gives exactly the ids of the whole text; texts with other runs of
white space are encoded whole. Natural text repeats its chunks, so most of them
come out of a bounded table of the worker. The table is a set of arrays, keyed
by 64-bit chunk hashes: a batch of texts is cut, looked up and put together
without a Python object for each word. A hash only finds an entry: its bytes are
compared with the chunk's, and a chunk that merely shares the hash of another
one gets an entry of its own.
"""

from __future__ import annotations

import os
import re

import numpy as np

ENTRIES = 2_000_000
BATCH_CHARS = 1 << 20
_ODD_SPACES = re.compile(r"\s (?:\s|\Z)")
_NOT_SPACES = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer does not
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_encoders: dict[tuple[str, str], "ChunkEncoder"] = {}


def powers(n: int) -> list[np.ndarray]:
    """The radix to the power i, and its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 2 * BATCH_CHARS)
        for k, radix in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            steps = np.full(n, radix, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def chunk_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes (never 0) of the byte ranges."""
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def words_at(raw: bytes) -> np.ndarray:
    """The little-endian 8-byte number at every place of ``raw`` (which is padded)."""
    return np.ndarray((len(raw),), "<u8", raw + b"\0" * 8, strides=(1,)).copy()


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Chunks:
    """Byte ranges of a batch with what tells them apart: their length, first and last eight bytes, and the bytes."""

    def __init__(self, raw: bytes, begin: np.ndarray, end: np.ndarray):
        self.data = np.frombuffer(raw, np.uint8)
        self.begin, self.length = begin, end - begin
        word = words_at(raw)
        short = _MASKS[np.minimum(self.length, 8)]
        self.head = word[begin] & short
        self.tail = word[np.maximum(end - 8, begin)] & short

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.begin[which], self.length[which], self.head[which], self.tail[which]


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all ranges one after another."""
    end = np.cumsum(length)
    return np.repeat(begin - end + length, length) + np.arange(int(end[-1]) if len(end) else 0)


class Table:
    """Chunk to a run of ids: open addressing by hash, all operations on whole arrays."""

    #: fields of an entry; the bytes of a chunk and its ids are in pools
    FIELDS = {"hash": np.uint64, "begin": np.int64, "count": np.int32, "length": np.int32, "head": np.uint64, "tail": np.uint64, "bytes_at": np.int64}

    def __init__(self, entries: int):
        self.entries = entries
        self.mask = (1 << max(2 * entries - 1, 1).bit_length()) - 1
        self.clear(min(self.mask, (1 << 16) - 1))

    def clear(self, mask: int) -> None:
        self.now = mask
        self.keys = np.zeros(mask + 1, np.uint64)
        self.at = np.zeros(mask + 1, np.int32)
        self.size, self.used, self.held = 0, 0, 0
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.zeros(1024, kind))
        self.pool = np.zeros(4096, np.uint32)
        self.text = np.zeros(4096, np.uint8)  # bytes of the chunks longer than head and tail

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 for unknown hashes."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h & np.uint64(self.now)).astype(np.int64)
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + 1) & self.now
        return out

    def differ(self, number: np.ndarray, chunks: Chunks) -> np.ndarray:
        """Which chunks are not the ones that their entries were made from."""
        same = (self.length[number] == chunks.length) & (self.head[number] == chunks.head) & (self.tail[number] == chunks.tail)
        long = np.flatnonzero(same & (chunks.length > 16))
        if len(long):
            length = chunks.length[long]
            equal = self.text[spread(self.bytes_at[number[long]], length)] == chunks.data[spread(chunks.begin[long], length)]
            same[long] = np.logical_and.reduceat(equal, np.cumsum(length) - length)
        return np.flatnonzero(~same)

    def place(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h & np.uint64(self.now)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.at[slot[won]] = h[won], number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, number, slot = h[rest], number[rest], slot[rest]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & self.now, slot)

    def add(self, h: np.ndarray, parts: list[np.ndarray], chunks: Chunks, which: np.ndarray) -> np.ndarray:
        """New entries for the chunks ``which``; their numbers."""
        n, total = len(h), sum(map(len, parts))
        begin, length, head, tail = chunks.of(which)
        kept = np.where(length > 16, length, 0)
        more = int(kept.sum())
        while self.size + n > len(self.hash):
            for name in self.FIELDS:
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.held + more > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        count = np.array([len(p) for p in parts], np.int32)
        new = slice(self.size, self.size + n)
        self.hash[new], self.count[new], self.length[new], self.head[new], self.tail[new] = h, count, length, head, tail
        self.begin[new] = self.used + np.cumsum(count) - count
        self.bytes_at[new] = self.held + np.cumsum(kept) - kept
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(parts)
        if more:
            self.text[self.held : self.held + more] = chunks.data[spread(begin, kept)]
        self.size, self.used, self.held = self.size + n, self.used + total, self.held + more
        if 2 * self.size > self.now:
            while 2 * self.size > self.now:
                self.now = 2 * self.now + 1
            self.keys, self.at = np.zeros(self.now + 1, np.uint64), np.zeros(self.now + 1, np.int32)
            self.place(self.hash[: self.size], np.arange(self.size, dtype=np.int32))
        else:
            self.place(h, np.arange(new.start, new.stop, dtype=np.int32))
        return np.arange(new.start, new.stop, dtype=np.int32)

    def runs(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after another, and their counts."""
        count = self.count[number].astype(np.int64)
        return self.pool[spread(self.begin[number], count)], count


class ChunkEncoder:
    """Ids of texts, exactly as the tokenizer gives them for the whole text."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tok.no_truncation()
        self.kind = kind
        self.table = Table(ENTRIES)
        if kind == "byte":
            vocab = self.tok.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            for token, i in vocab.items():
                self.opens[i] = token.startswith("Ġ")
        else:
            self.mark = self.ids("|")

    @property
    def size(self) -> int:
        """Ids lie below this number."""
        return max(self.tok.get_vocab(with_added_tokens=True).values()) + 1

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def pieces(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk: one call for all, cut at marks; chunk by chunk where the marks do not add up."""
        if self.kind == "byte":
            ids = self.ids(" " + " ".join(chunks))
            cuts = np.flatnonzero(self.opens[ids])
            if all(chunks) and len(cuts) == len(chunks) and cuts[0] == 0:
                return np.split(ids, cuts[1:])
            return [self.ids(" " + k) for k in chunks]
        if len(self.mark) == 1:
            ids = self.ids(" | ".join(chunks))
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) == len(chunks) - 1:
                return [x[1:] if i else x for i, x in enumerate(np.split(ids, cuts))]
        return [self.ids(k) for k in chunks]

    def lookup(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of the chunks of ``raw``, which a space parts, opens and closes."""
        data = np.frombuffer(raw, np.uint8)
        space = np.flatnonzero(data == 32)
        begin, end = space[:-1] + 1, space[1:]
        h = chunk_hashes(data, begin, end)
        chunks = Chunks(raw, begin, end)
        number = self.table.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            if self.table.size + len(missing) > ENTRIES and self.table.size:
                self.table.clear((1 << 16) - 1)
                missing = np.arange(len(h))
            fresh, first = np.unique(h[missing], return_index=True)
            at = missing[first]
            texts = [raw[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist())]
            # the odd ones would spoil a common call
            odd = np.array([not k or (self.kind == "word" and "|" in k) for k in texts], bool)
            for pick in (np.flatnonzero(~odd), *([i] for i in np.flatnonzero(odd))):
                if len(pick):
                    self.table.add(fresh[pick], self.pieces([texts[i] for i in pick]), chunks, at[pick])
            number = self.table.find(h)
        other = self.table.differ(number, chunks)
        if len(other):  # they share the hash of another chunk
            parts = [self.pieces([raw[a:b].decode()])[0] for a, b in zip(begin[other].tolist(), end[other].tolist())]
            number[other] = self.table.add(h[other], parts, chunks, other)
        return self.table.runs(number)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        heads: dict[int, np.ndarray] = {}
        which, rests, held = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.kind == "byte":
                if _ODD_SPACES.search(text):
                    out[i] = self.ids(text)
                    continue
                first, parted, rest = text.partition(" ")
                if first:
                    heads[i] = self.ids(first)
                    out[i] = heads[i]
                if not parted:
                    continue
            else:
                if _NOT_SPACES.search(text):
                    out[i] = self.ids(text)
                    continue
                rest = " ".join(text.split())
                if not rest:
                    continue
            which.append(i)
            rests.append(rest)
            held += len(rest)
            if held >= BATCH_CHARS:
                self.join(which, rests, heads, out)
                which, rests, held = [], [], 0
        if which:
            self.join(which, rests, heads, out)
        return out

    def join(self, which: list[int], rests: list[str], heads: dict[int, np.ndarray], out: list[np.ndarray]) -> None:
        ids, count = self.lookup(b" " + " ".join(rests).encode() + b" ")
        chunks = np.array([r.count(" ") + 1 for r in rests])
        tokens = np.add.reduceat(count, np.cumsum(chunks) - chunks)
        end = np.cumsum(tokens)
        for i, a, b in zip(which, (end - tokens).tolist(), end.tolist()):
            out[i] = np.concatenate([heads[i], ids[a:b]]) if i in heads else ids[a:b]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0].astype("<u4").tobytes()


def encoder(path: str, kind: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; ``kind`` is ``byte`` or ``word``."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = ChunkEncoder(path, kind)
    return _encoders[path, kind]
