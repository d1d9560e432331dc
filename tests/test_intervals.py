import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators import matching as M


def table(spark, rows):
    return spark.createDataFrame(rows, "fixture string, start_idx long, end_idx long")


def draw(rng, n, top=400):
    out = []
    for _ in range(n):
        s = rng.randint(0, top)
        out.append((rng.choice("ab"), s, s + rng.randint(1, 30)))
    return sorted(set(out))


def test_isolated_overlap_band(spark):
    rng = random.Random(2)
    for _ in range(4):
        rows, other = draw(rng, 25), draw(rng, 25)
        hit = lambda a, b: a[1] < b[2] and b[1] < a[2]
        want = {a for a in rows if not any(b is not a and hit(a, b) for b in rows)}
        assert {tuple(r) for r in I.isolated(table(spark, rows), tie=("fixture",)).collect()} == want
        pairs = I.iou(I.overlap_join(table(spark, rows), table(spark, other), ["fixture"], 16)).collect()
        assert {(r.fixture, r.l_start_idx, r.l_end_idx, r.r_start_idx, r.r_end_idx) for r in pairs} == {(a[0], *a[1:], *b[1:]) for a in rows for b in other if a[0] == b[0] and hit(a, b)}
        assert len(pairs) == len(set(pairs))
        a, b = table(spark, rows).selectExpr("start_idx x"), table(spark, other).selectExpr("start_idx y")
        assert sorted((r.x, r.y) for r in I.band_join(a, b, "x", "y", 7).collect()) == sorted((p[1], q[1]) for p in rows for q in other if abs(p[1] - q[1]) <= 7)


def test_merge_close(spark):
    rows = [("s", 0, 100, 1.0, 3.0, 0.6), ("s", 200, 300, 2.0, 4.0, 0.7), ("s", 900, 1000, 4.0, 1.0, 0.8), ("t", 120, 130, 9.0, 9.0, 0.9)]
    df = spark.createDataFrame(rows, "fixture string, start_idx long, end_idx long, volume double, peak double, mean double")
    got = sorted((r.fixture, r.start_idx, r.end_idx, r.volume, r.peak, r.mean) for r in I.merge_close(df, 300, ["fixture"]).collect())
    assert got == [("s", 0, 300, 3.0, 4.0, 0.6), ("s", 900, 1000, 4.0, 1.0, 0.8), ("t", 120, 130, 9.0, 9.0, 0.9)]
    assert I.merge_close(df, 100, ["fixture"]).count() == 4  # the gap is not strictly below
    assert I.merge_close(df, 0, ["fixture"]) is df


def test_mutual_best_equals_greedy(spark):
    rng = random.Random(6)
    cells = sorted({(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(60)})
    rows = [(a, b, rng.choice([0.5, 0.6, 0.7, 0.9])) for a, b in cells]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = I.mutual_best(spark.createDataFrame(rows, "l long, r long, s double"), ["l"], ["r"], "s")
    assert {(r.l, r.r) for r in got.collect()} == want


def test_mutual_best_of_a_long_chain(spark):
    rows = [(k // 2, (k + 1) // 2, 1 - k / 100) for k in range(15)]  # each pair shares a side with the next
    got = I.mutual_best(spark.createDataFrame(rows, "l long, r long, s double"), ["l"], ["r"], "s", max_rounds=3)
    assert sorted((r.l, r.r) for r in got.collect()) == [(k, k) for k in range(8)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 20, (n, m)).astype(float)
        cost[rng.random((n, m)) < 0.4] = np.inf
        best = (0, 0.0)
        for k in range(min(n, m), 0, -1):
            options = [sum(cost[i, j] for i, j in zip(rs, cs)) for rs in itertools.combinations(range(n), k) for cs in itertools.permutations(range(m), k)]
            finite = [c for c in options if np.isfinite(c)]
            if finite:
                best = (k, min(finite))
                break
        pairs = M.min_cost_assignment(cost)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) == best[0]
        assert abs(sum(cost[i, j] for i, j in pairs) - best[1]) < 1e-9
        every = M.repeated_assignment(cost)
        assert {i for i, _ in every} == {i for i in range(n) if np.isfinite(cost[i]).any()}


def test_diary_matching(spark):
    rng = random.Random(9)
    diary = [(i, rng.randint(0, 200_000), None, i % 11 == 0, "a" if i % 13 else None) for i in range(120)]
    events = [(1000 + j, rng.randint(0, 200_000), 40) for j in range(150)]
    d = spark.createDataFrame(diary, "entry long, start_idx long, duration_s long, excluded boolean, fixture string")
    e = spark.createDataFrame(events, "candidate long, start_idx long, duration_s long")
    usable = [x for x in diary if not x[3] and x[4]]
    reachable = {x[0] for x in usable if any(abs(x[1] - c[1]) <= 900 for c in events)}
    near = M.match_diary(d, e, 900, 0.5, "nearest").collect()
    assert {r.entry for r in near} == reachable
    assert all(abs(r.offset_s) == min(abs(x[1] - c[1]) for c in events) for r in near for x in usable if x[0] == r.entry)
    best = M.match_diary(d, e, 900, 0.5).collect()
    assert {r.entry for r in best} == reachable and len(best) == len(reachable)
    cost = np.array([[abs(x[1] - c[1]) if abs(x[1] - c[1]) <= 900 else np.inf for c in events] for x in usable], float)
    first = M.min_cost_assignment(cost)
    assert len({r.candidate for r in best}) >= len(first)


def test_banded_assignments_are_optimal(monkeypatch):
    rng = np.random.default_rng(12)
    for k in range(300):
        monkeypatch.setattr(M, "BLOCK", 1 + k % 4)
        n, m, tolerance = (int(x) for x in rng.integers(1, 12, 3))
        x, y = (np.sort(rng.integers(0, 30, size)) for size in (n, m))
        durations = np.where(rng.random(n) < (0, 0.6)[k % 2], rng.integers(0, 9, n), np.nan)
        lengths = rng.integers(0, 9, m).astype(float)
        off = np.abs(x[:, None] - y[None, :]).astype(float)
        price = off + np.nan_to_num(np.minimum(np.abs(lengths[None, :] - durations[:, None]) / np.maximum(durations[:, None], 1), 4) * 0.5 * 0.25)
        cost = np.where(off <= tolerance, price, np.inf)
        first = M.min_cost_assignment(cost)
        got = M.assign_part(x, y, durations, lengths, tolerance, 0.5)
        assert sorted(i for i, _ in got) == np.flatnonzero(np.isfinite(cost).any(1)).tolist()
        own = got[: len(first)]
        assert len({i for i, _ in own}) == len({j for _, j in own}) == len(first)
        assert abs(sum(cost[p] for p in own) - sum(cost[p] for p in first)) < 1e-9


def test_one_long_part_is_assigned_in_bounded_memory(spark):
    n = 60_000  # a matrix of this part would hold 29 GB
    rows = spark.range(n).select((F.col("id") * 4).alias("start_idx"), F.col("id"))
    diary = rows.select(F.col("id").alias("entry"), (F.col("start_idx") + 1).alias("start_idx"), F.lit(None).cast("long").alias("duration_s"), F.lit(False).alias("excluded"), F.lit("a").alias("fixture"))
    found = M.match_diary(diary, rows.select(F.col("id").alias("candidate"), "start_idx", F.lit(60).cast("long").alias("duration_s")), 30, 0.5)
    assert found.agg(F.count("*"), F.count_distinct("candidate"), F.sum("cost"), F.count_if("shared_candidate")).first() == (n, n, n, 0)
