import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm import packing as K

from .helpers import edge, edge_rows, empty

WORD = str(P.path("word_bpe_49k.json"))


def check(rows, pieces, window=2048):
    tok = Tokenizer.from_file(WORD)
    want = sorted((i is not None, i or 0, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows)
    tokens = sum(len(x[2]) // 4 for x in want)
    assert sum(p.length for p in pieces) == tokens
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert by.get(p.sequence_id, 0) == p.offset
        by[p.sequence_id] = p.offset + p.length
        ids = np.frombuffer(bytes(p.ids), "<u2").astype("<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32
    assert all(n == window or (n < window and n & (n - 1) == 0) for n in by.values())
    if len({i for i, _ in rows}) == len(rows):
        docs = {}
        for p in sorted(pieces, key=lambda p: p.start):
            got = docs.setdefault(p.doc_id, b"")
            assert len(got) // 4 == p.start
            docs[p.doc_id] = got + np.frombuffer(bytes(p.ids), "<u2").astype("<u4").tobytes()
        assert sorted((i is not None, i or 0, x) for i, x in docs.items()) == want


def test_every_id_once(spark):
    rows = [(i, f"document {i} " + f"topic{i % 7} speaks of things " * (i % 90)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, K.pack(df, WORD, shard_docs=64).collect())
    check(rows, K.pack(df, WORD, window=256).collect(), 256)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(rows, K.pack(edge(spark), WORD).collect())
    assert K.pack(empty(spark), WORD).collect() == []


def topical(n=60, seed=1, longest=90):
    rng = np.random.default_rng(seed)
    docs = [np.concatenate([rng.integers(1000 * (k % 5) + 100, 1000 * (k % 5) + 150, 60 if longest == 60 else rng.integers(20, longest)), rng.integers(1, 60, 20)]) for k in range(n)]
    df = np.zeros(49_408)
    for d in docs:
        df[np.unique(d)] += 1
    return docs, np.log1p((n - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))


def test_neighbours_share_words():
    docs, idf, mean_len = topical(longest=60)
    pieces = K.pack_shard(docs, idf, mean_len, 512)
    order = list(dict.fromkeys(p[0] for p in pieces))
    assert sum(a % 5 == b % 5 for a, b in zip(order, order[1:])) >= 50


def brute_order(docs, idf, mean_len, window):
    """The documents in the order in which they are packed, by BM25 over all pairs."""

    def score(q, d):
        found = 0.0
        for t in set(q.tolist()):
            tf = docs[d].tolist().count(t)
            found += idf[t] * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * len(docs[d]) / mean_len))
        return found

    left, order, room, seed = set(range(1, len(docs))), [0], window, 0
    size = len(docs[0])
    while True:
        while size >= room:  # the document fills the window; what is left of it is the next one's seed
            size, room, seed = size - room, window, order[-1]
        if size:
            room -= size
        if not left:
            return order
        best = min(left, key=lambda d: (-round(score(docs[seed], d), 9), d))
        left.remove(best)
        order.append(best)
        if room == window:
            seed = best
        size = len(docs[best])


def test_windows_are_filled_by_their_seed():
    for seed in (1, 2, 3):
        docs, idf, mean_len = topical(40, seed)
        pieces = K.pack_shard(docs, idf, mean_len, 256)
        assert list(dict.fromkeys(p[0] for p in pieces)) == brute_order(docs, idf, mean_len, 256)


def test_used_documents_leave_the_index():
    docs, idf, mean_len = topical(80)
    index = K.ShardIndex(docs, idf, mean_len)
    full = index.scores(3)
    index.unused[10:] = False
    next(index.neighbours(3))
    assert index.held.tolist() == list(range(10)) and len(index.owner) == sum(len(np.unique(d)) for d in docs[:10])
    assert (index.scores(3) == full[:10]).all()
    index.unused[:] = False
    assert list(index.neighbours(3)) == [] and not len(index.owner)


def test_documents_are_counted_together(monkeypatch):
    docs, _, _ = topical(50)
    docs[7], docs[20] = docs[7][:0], np.arange(900) % 70
    for together in (1, 300, 1 << 18):
        monkeypatch.setattr(K, "TOGETHER", together)
        for d, (term, count) in zip(docs, K.term_counts(docs), strict=True):
            want = np.unique(d, return_counts=True)
            assert (term == want[0]).all() and (count == want[1]).all() and len(term) == len(want[0])


def test_related_documents_share_a_shard(spark):
    rows = [(i, " ".join(f"topic{i % 40}word{(i // 40 + j) % 9}" for j in range(60)) + f" plain text of document {i}") for i in range(800)]
    pieces = K.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), WORD, shard_docs=60, window=256).collect()
    check(rows, pieces, 256)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, set()).add(p.doc_id % 40)
    assert sum(len(x) for x in by.values()) / len(by) < 1.5


def test_repeated_rows_are_dealt(spark):
    rows = [(7, "the same words again and again " * 30)] * 400 + [(None, "no id")] * 50
    pieces = K.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD, shard_tokens=5000).collect()
    check(rows, pieces)
