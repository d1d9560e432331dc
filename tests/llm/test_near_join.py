import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import components as C
from tidemark.llm import near_join as J

from .helpers import edge, edge_rows, empty


def sets(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    near = collections.defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]):
                near[i].add(j)
                near[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for j in near[todo.pop()] - part:
                    part.add(j)
                    todo.append(j)
            ids = [rows[k][0] for k in part if rows[k][0] is not None]
            for k in part:
                seen[k] = min(ids, default=None)
        out.append((rows[i][0], seen[i], len(near[i])))
    return sorted(out, key=repr)


def found(df, **k):
    return sorted((tuple(r) for r in J.join(df, **k).collect()), key=repr)


def test_edges(spark):
    assert found(edge(spark)) == brute([(r[0], r[1]) for r in edge_rows()])
    assert found(empty(spark)) == []


def test_groups_of_near_copies_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    rng, rows = random.Random(8), []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(90)]
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(90)] = f"e{rng.randint(0, 9999)}"
            if rng.random() < 0.3:
                text = text[: 90 - rng.randint(0, 18)]
            rows.append((len(rows) * 3, " ".join(text)))
    rows.append((1, rows[0][1]))
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_of_each_class(spark):
    df = edge(spark).withColumns({c: F.lit(5) for c in ("near_row_id", "near_row_t", "near_id", "near_t", "component", "t")})
    kept = J.one_of_each_class(df)
    assert kept.columns == df.columns and {r.near_row_id for r in kept.collect()} == {5}
    wordy = [r for r in kept.collect() if (r.text or "").strip()]
    classes = brute([(r[0], r[1]) for r in edge_rows() if (r[1] or "").strip()])
    assert len(wordy) == 7 and {r.doc_id for r in wordy} <= {c for _, c, _ in classes}
    assert sum(not (r.text or "").strip() for r in kept.collect()) == sum(not (r[1] or "").strip() for r in edge_rows())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60) if i % 7] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(30)] + [(None, 3), (5, 5)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_prefixes_are_shortened_until_the_recall():
    none = np.zeros(J.BINS + 1)
    sure = max(p for p in range(1, J.DEPTH + 1) if J.meeting(J.THRESHOLD, p) >= J.RECALL)
    assert J.next_depth(J.DEPTH, none, J.THRESHOLD) == sure  # with nothing found, a pair at the threshold decides
    near = none.copy()
    near[98] = 1e6
    assert J.next_depth(J.DEPTH, near, J.THRESHOLD) == J.DEPTH
    low = none.copy()
    low[80] = 1e6
    assert J.next_depth(J.DEPTH, low, J.THRESHOLD) == sure == J.next_depth(sure, low, J.THRESHOLD)


def test_pairs_are_verified_in_one_place():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 60)
    rows = []
    for k in range(40):
        s = base.copy()
        s[rng.integers(0, 60, 4)] = rng.integers(0, 1 << 40, 4)
        rows.append(np.unique(s).astype(np.uint64))
    sig = np.array([J.signature(s, J.TREES * J.DEPTH).reshape(J.TREES, J.DEPTH) for s in rows])
    key = lambda p: [np.array([hash(tuple(x[:p])) for x in one], np.int64).tobytes() for one in sig]
    times = np.zeros((40, 40), int)
    for p, before in ((8, None), (5, 8)):
        member = list(zip(range(40), map(len, rows), key(p), key(before) if before else [None] * 40))
        for tree in range(J.TREES):
            times += J.met(member, member, tree, True, 0.8)
    meets = np.array([[any((sig[i, t, :5] == sig[j, t, :5]).all() for t in range(J.TREES)) for j in range(40)] for i in range(40)])
    sizes = np.array([[5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) for b in rows] for a in rows])
    assert (times == np.triu(meets & sizes, 1)).all() and times.sum() > 100


def test_rows_without_an_id(spark):
    rng, rows = random.Random(2), []
    for g in range(300):
        base = [f"g{g}w{rng.randint(0, 999)}" for _ in range(40)]
        rows += [(None, " ".join(base)), (None, " ".join(base[:-1])), (None, " ".join(base))][: 1 + g % 3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_hubs_have_bounded_fans():
    links = J.forest(np.array([(0, k) for k in range(1, 5000)]))
    assert len(links) == 4999 and max(collections.Counter(i for i, _ in links).values()) <= J.FAN


def test_pipeline_keeps_one_row_of_each_class_whatever_the_ids(spark):
    import corpus_pipeline

    word = lambda g, n=40: " ".join(f"g{g}w{k}" for k in range(n))
    shared = [(5, word(g)) for g in range(6)]  # one id, unrelated texts
    rows = [*shared, (9, word(0)), (3, word(1) + " end"), (None, word(2)), (None, word(7)), (None, word(7)), (None, word(7) + " end"), (None, None), (4, " "), (4, " ")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = corpus_pipeline.keep_one_of_near(spark, df, "")
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    blank = [(None, None), (4, " "), (4, " ")]
    assert [r for r in kept if r[0] is not None and r[1] != " "] == sorted([(3, word(1) + " end"), *(r for r in shared if r[1] != word(1))], key=repr)
    assert len([r for r in kept if r[0] is None and r[1]]) == 1
    assert sorted((r for r in kept if not (r[1] or "").strip()), key=repr) == sorted(blank, key=repr)
