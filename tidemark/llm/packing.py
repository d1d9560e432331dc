"""Lexical retrieval packing: sharded BM25 neighbours fill token windows greedily.

Documents are encoded once and kept as packed ids. The document frequencies of
all token ids (bounded by the vocabulary) are counted over the whole corpus. A
document's sketch is the direction of its id counts (square roots) under
``DIMS`` random axes; the corpus's moments of the sketches, a matrix of fixed
size, give their leading directions, and the sides of these on which a document
lies, the first direction's highest, are its lexical key. Documents are
dealt by range of that key, ties by a hash of their place, so documents of like
words come to one shard and a key that very many share is cut like any
other range. A task cuts its range into shards of at most ``SHARD_TOKENS``
tokens and ``SHARD_DOCS`` documents (a longer document is a shard's last one)
and holds one shard at a time. Each shard builds an inverted index of all its
terms. A seed document opens a window; its unused neighbours, the best score of
all the seed's terms first, fill the window, and documents without a score come
when there are no others. A document cut at the window's end is the seed of the
next one. The tail of a shard is cut into sequences whose lengths are powers of
two, which need no padding.

Null texts count as empty (one end id); empty tables give no rows; repeated
rows and doc_ids are packed as they stand; long documents are cut over as many
windows as they need. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, staged
from .tokens import encoder

WINDOW = 2048
SHARD_DOCS = 2048
SHARD_TOKENS = 2_000_000
DIMS = 32
TOGETHER = 1 << 18  # ids that are sorted in one call
SEED = 11
K1, B = 1.2, 0.75


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def axes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMS), np.float32)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (kind 0): doc_id, packed ids, count, tie, sketch; rows (kind 1): a task's document frequencies by id and moments of the sketches."""
    size = max(encoder(tokenizer_path, "word").size, end_id + 1)
    kind_of = id_type(size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, along = encoder(tokenizer_path, "word"), axes(size)
        seen, moments = np.zeros(size, np.int64), np.zeros((DIMS + 1, DIMS + 1))
        names = ["kind", "doc_id", "ids", "n_tokens", "tie", "sketch"]
        for batch in batches:
            packed, sizes, sketches = [], [], []
            docs = [np.append(found, end_id) for found in enc.encode_many(batch.column(1).to_pylist())]
            for ids, (term, count) in zip(docs, term_counts(docs)):
                seen[term] += 1
                sketches.append(np.sqrt(count, dtype=np.float32) @ along[term] / np.float32(np.sqrt(len(ids))))
                packed.append(ids.astype(kind_of).tobytes())
                sizes.append(len(ids))
            one = np.ones((len(sketches), DIMS + 1))
            one[:, 1:] = sketches
            moments += one.T @ one
            columns = [pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sketches], pa.binary())], names)
        none, blob = pa.array([None], pa.int64()), lambda x: pa.array([x.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), none, blob(seen), pa.array([0], pa.int64()), none, blob(moments)], names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    return docs.mapInArrow(encode, "kind int, doc_id long, ids binary, n_tokens long, tie long, sketch binary")


def corpus_counts(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the tasks' document frequencies and moments: tables of fixed size, added up in a tree of tasks."""

    def total(pairs) -> tuple[np.ndarray, np.ndarray]:
        df, moments = np.zeros(1, np.int64), np.zeros((DIMS + 1, DIMS + 1))
        for ids, sketch in pairs:
            part = np.frombuffer(ids, np.int64)
            df = df + part if len(df) in (1, len(part)) else part
            moments = moments + np.frombuffer(sketch).reshape(DIMS + 1, DIMS + 1)
        return df, moments

    def add(batches):
        df, moments = total((i, m) for batch in batches for i, m in zip(*(c.to_pylist() for c in batch.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (df, moments)], ["ids", "sketch"])

    parts = encoded.filter("kind = 1").select("ids", "sketch")
    sums = parts.repartition(16).mapInArrow(add, "ids binary, sketch binary").collect()
    return total((bytes(r.ids), bytes(r.sketch)) for r in sums if len(r.ids) > 8)


def directions(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the sketches and their directions, the widest first."""
    n = max(moments[0, 0], 1.0)
    mean = moments[0, 1:] / n
    _, found = np.linalg.eigh(moments[1:, 1:] / n - np.outer(mean, mean))
    found = found[:, ::-1]
    lead = found[np.abs(found).argmax(0), np.arange(DIMS)]
    return mean, found * np.sign(lead)


def lexical_keys(sketches: np.ndarray, mean: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The sides of the directions on which the sketches lie, the first one highest."""
    return ((sketches - mean) @ along > 0) @ (1 << np.arange(DIMS - 1, -1, -1, dtype=np.int64))


def term_counts(docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different ids of each document and their counts; short documents are sorted together."""
    out, at = [], 0
    while at < len(docs):
        end, held = at + 1, len(docs[at])
        while end < len(docs) and held + len(docs[end]) <= TOGETHER:
            held += len(docs[end])
            end += 1
        if end == at + 1:
            out.append(np.unique(docs[at], return_counts=True))
        else:
            name = np.arange(end - at, dtype=np.uint64) << np.uint64(32)
            key = np.repeat(name, [len(x) for x in docs[at:end]]) | np.concatenate(docs[at:end]).astype(np.uint64)
            key.sort()
            first = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)[: len(key)]
            count, key = np.diff(np.append(first, len(key))), key[first]
            cuts = np.searchsorted(key, name[1:])
            out += zip(np.split((key & np.uint64(0xFFFFFFFF)).astype(docs[at].dtype), cuts), np.split(count, cuts))
        at = end
    return out


class ShardIndex:
    """BM25 over one shard: postings by token id with corpus-wide idf, thinned out as documents are used."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_len: float):
        self.terms, counts = (list(x) for x in zip(*term_counts(docs)))
        owner = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        length = np.array([len(ids) for ids in docs])
        term, tf = np.concatenate(self.terms), np.concatenate(counts)
        order = np.argsort(term, kind="stable")
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean_len)))[order]
        self.owner = owner[order]  # places in ``held``
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.held = np.arange(len(docs))  # documents that have postings
        self.unused = np.ones(len(docs), bool)
        self.next_seed = 0

    def thin(self) -> None:
        """Drop the postings of used documents once these are a quarter of those held."""
        stays = self.unused[self.held]
        if 4 * np.count_nonzero(stays) > 3 * len(stays):
            return
        kept = stays[self.owner]
        self.begin = np.append(0, np.cumsum(kept))[self.begin]
        self.owner, self.weight = (np.cumsum(stays) - 1)[self.owner[kept]], self.weight[kept]
        self.held = self.held[stays]

    def scores(self, k: int) -> np.ndarray:
        """BM25 scores of the documents held for the terms of document ``k``."""
        spans = [slice(a, b) for a, b in zip(self.begin[self.terms[k]].tolist(), self.begin[self.terms[k] + 1].tolist()) if a < b]
        if not spans:
            return np.zeros(len(self.held))
        owner, weight = np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans])
        return np.bincount(owner, weight, minlength=len(self.held))

    def neighbours(self, k: int) -> Iterator[int]:
        """Unused documents for seed ``k``: best score first (ties: the first one), then those without a score."""
        self.thin()
        score = self.scores(k)
        score[~self.unused[self.held]] = 0
        some = np.flatnonzero(score > 0)
        yield from self.held[some[np.argsort(-score[some], kind="stable")]].tolist()
        while True:
            while self.next_seed < len(self.unused) and not self.unused[self.next_seed]:
                self.next_seed += 1
            if self.next_seed == len(self.unused):
                return
            yield self.next_seed


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_len: float, window: int = WINDOW) -> list[tuple]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    if not docs:
        return []
    index, pieces, sequence, used, k, at = ShardIndex(docs, idf, mean_len), [], 0, 0, 0, 0
    index.unused[0] = False
    queue: Iterator[int] | None = None  # neighbours of the open window's seed
    while True:
        n = len(docs[k])
        take = min(window - used, n - at)
        pieces.append((k, at, take, sequence, used))
        at, used = at + take, used + take
        if used == window:
            sequence, used, queue = sequence + 1, 0, None
        if at < n:
            continue
        if queue is None:
            queue = index.neighbours(k)  # document k opened the window, or ended the one before
        after = next(queue, -1)
        if not used:
            queue = None
        if after < 0:
            break
        k, at = after, 0
        index.unused[k] = False
    if not used:
        return pieces
    tail = [p for p in pieces if p[3] == sequence]
    pieces = pieces[: len(pieces) - len(tail)]
    room = [1 << b for b in reversed(range(window.bit_length())) if used >> b & 1]
    size, filled = room.pop(0), 0
    for k, at, length, _, _ in tail:
        while length:
            take = min(size - filled, length)
            pieces.append((k, at, take, sequence, filled))
            at, length, filled = at + take, length - take, filled + take
            if filled == size:
                sequence, filled = sequence + 1, 0
                size = room.pop(0) if room else 0
    return pieces


def shards_of(batches: Iterator[pa.RecordBatch], shard_docs: int, shard_tokens: int, kind: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and ids of the shards of a stream (doc_id, ids)."""
    names, docs, held = [], [], 0
    for batch in batches:
        for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            names.append(doc_id)
            docs.append(np.frombuffer(packed.as_py(), kind))
            held += len(docs[-1])
            if held >= shard_tokens or len(docs) >= shard_docs:
                yield names, docs
                names, docs, held = [], [], 0
    if docs:
        yield names, docs


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_docs: int = SHARD_DOCS, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed, 2 bytes each where the vocabulary fits)."""
    arrow_rows(docs.sparkSession)
    encoded = staged(encode_documents(docs, tokenizer_path, end_id), "packed-ids")
    df, moments = corpus_counts(encoded)
    mean, along = directions(moments)
    kind = id_type(max(encoder(tokenizer_path, "word").size, end_id + 1))
    rows = encoded.filter("kind = 0").select("doc_id", "ids", "tie", "sketch")
    n, tokens = encoded.filter("kind = 0").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean_len = max(tokens / max(n, 1), 1.0)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = np.array([np.frombuffer(x.as_py(), np.float32) for x in batch.column(3)]).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lexical_keys(sketches, mean, along))], ["doc_id", "ids", "tie", "lexical"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequences = TaskContext.get().partitionId() << 32
        for names, ids in shards_of(batches, shard_docs, shard_tokens, kind):
            out, last = [[] for _ in range(8)], -1
            for k, start, length, sequence, offset in pack_shard(ids, idf, mean_len, window):
                piece = ids[k][start : start + length]
                row = (names[k], start, length, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[k]), sequences + sequence, offset, piece.tobytes())
                last = max(last, sequence)
                for column, x in zip(out, row):
                    column.append(x)
            sequences += last + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if j == 7 else pa.int64()) for j, c in enumerate(out)], PIECE_NAMES)

    keyed = staged(rows.mapInArrow(key, "doc_id long, ids binary, tie long, lexical long"), "lexical-keys")
    discard(encoded)
    dealt = keyed.repartitionByRange("lexical", "tie").sortWithinPartitions("lexical", "tie")
    return dealt.select("doc_id", "ids").mapInArrow(build, PIECE_SCHEMA)


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
