import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import substring_dedup as D
from tidemark.llm.suffix_order import suffix_order

from .helpers import edge, edge_rows, empty


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(800):
        x = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))]
        assert suffix_order(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    assert suffix_order(np.zeros(5000, np.int64)).tolist() == list(range(4999, -1, -1))


def brute(docs):
    seen, out = {}, {}
    key = lambda i: 2**63 if i is None else i
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], 2**63), key(i))
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(i, []).append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def found(df):
    out = {}
    for r in D.dedup(df).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def test_random_documents(spark, monkeypatch):
    rng, texts = random.Random(5), []
    for _ in range(50):
        s = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 300)))
        if texts and rng.random() < 0.7:
            o = rng.choice(texts)
            a = rng.randint(0, max(0, len(o) - 1))
            s = s[:80] + o[a : a + rng.randint(40, 180)] + s[80:]
        texts.append("ab" * 90 + s if rng.random() < 0.1 else s)
    docs = [*enumerate(texts), (5, texts[9]), (5, texts[9]), (60, "\0" * 130 + "é" * 70), (61, "\0" * 99)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == brute(docs)
    monkeypatch.setattr(D, "HOT_HOLDERS", 1)  # the exact way for hot anchors
    monkeypatch.setattr(D, "BROADCAST_COPIES", 0)
    assert found(df) == brute(docs)


def test_edges(spark):
    assert found(edge(spark)) == brute([(r[0], r[1]) for r in edge_rows()])
    assert found(empty(spark)) == {}


def test_the_greatest_id_and_rows_without_one(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    ids = [2**63 - 1, None, None, 5, 5, 2**63 - 2, -7]
    rows = [(i, " ".join([word(), rng.choice(passage), word(), rng.choice(passage), rng.choice(passage)])) for i in ids * 4]
    rows += [(None, rows[0][1]), (5, rows[3][1]), (5, rows[3][1]), (None, "none " * 40), (None, "none " * 40)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    with pytest.raises(ValueError):
        D.shift_of(spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "doc_id long"))
