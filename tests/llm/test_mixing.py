import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M

from .helpers import edge, empty, label_table


def corpus():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        junk = rng.random() < 0.3
        pool = ["spam", "win", "cash", "now", "deal"] if junk else ["river", "stone", "cloud", "leaf", "road", "hill"]
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(5, 60)))))
        if i % 2:
            labels.append((i, int(not junk), 0))
    return docs, labels


def test_totals_meet_targets(spark):
    docs, labels = corpus()
    mixed = M.mix(spark.createDataFrame(docs, "doc_id long, text string"), label_table(spark, labels), {"clean": 0.8, "junk": 0.2}, 1.2).collect()
    p, n, r = np.array([x.mix_p for x in mixed]), np.array([x.mix_n for x in mixed]), np.array([x.mix_rate for x in mixed])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    total = (r[:, None] * n[:, None] * p).sum(0)
    assert np.allclose(total / n.sum() / 1.2, [0.8, 0.2], atol=2e-3)
    copies = np.array([x.mix_copies for x in mixed])
    assert (np.abs(copies - r) < 1).all()
    truth = {i: ("junk" if t.split()[0] in ("spam", "win", "cash", "now", "deal") else "clean") for i, t in docs}
    assert np.mean([x.mix_domain == truth[x.doc_id] for x in mixed]) > 0.99


def descent(n, p, weights, scale, domains, limit=10_000):
    """The same descent in NumPy over the same posteriors."""
    held = (n[:, None] * p).sum(0)
    w = np.where(held > 0, 1 / np.maximum(held, 1e-300), 0)
    target = scale * n.sum() * np.array([weights[d] for d in domains]) / sum(weights[d] for d in domains)
    step = 1 / (w * (n[:, None] * p * p).sum(0)).sum()
    r, y, t = np.ones(len(n)), np.ones(len(n)), 1.0
    for _ in range(limit):
        e = (y[:, None] * n[:, None] * p).sum(0) - target
        if np.abs(e).max() <= M.TOLERANCE * n.sum():
            break
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        new = np.maximum(0, y - p @ (step * w * e))
        r, y, t = new, new + (t - 1) / after * (new - r), after
    return r


def test_rates_against_numpy(spark):
    docs, labels = corpus()
    mixed = M.mix(spark.createDataFrame(docs, "doc_id long, text string"), label_table(spark, labels), {"clean": 0.97, "junk": 0.03}).collect()
    p, n = np.array([x.mix_p for x in mixed]), np.array([x.mix_n for x in mixed], float)
    want = descent(n, p, {"clean": 0.97, "junk": 0.03}, 1.0, ["clean", "junk"])
    assert np.allclose([x.mix_rate for x in mixed], want, atol=1e-6)


def test_edges(spark):
    labels = label_table(spark, [(1, 1, 0), (2, 0, 0), (6, 1, 1), (None, 1, 1), (3, None, None), (2, 1, 0)])
    for table in (labels, label_table(spark)):
        mixed = M.mix(edge(spark), table, {"clean": 1.0, "junk": 0.5, "all": 1.0})
        rows = mixed.collect()
        assert len(rows) == edge(spark).count()
        assert all(r.mix_rate == 1.0 for r in rows if not (r.text or "").split())
        assert M.apply_copies(mixed, edge(spark).columns).columns == edge(spark).columns
    assert M.mix(empty(spark), labels, {"clean": 1.0}).collect() == []


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(100, [0.6, 0.4])] * 5, "mix_n long, mix_p array<double>")
    with pytest.warns(UserWarning, match="misses its targets"):
        rounds = M.fit_rates(rows, ["a", "b"], {"a": 0.1, "b": 0.9})
    rate = rows.select(M.rate(rounds, 2).alias("r")).first().r
    # the nearest total to (0.1, 0.9), relative to what the domains hold
    assert len(rounds) >= 2 * M.STALL and 0.2 < rate < 2.5


def test_columns_of_any_name_pass(spark):
    names = ["mix_n", "MIX_P", "mix_copy", "mix_state", "own_0"]
    rows = spark.createDataFrame([(i, "some words here") for i in range(20)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    labels = label_table(spark, [(1, 1, 0), (2, 0, 0)])
    got = M.mixed_rows(rows, labels, {"clean": 0.5, "junk": 0.5})
    assert got.columns == rows.columns and all(r[c] == c for r in got.collect() for c in names)
    assert M.mix(rows, labels, {"clean": 1.0}).count() == 20
