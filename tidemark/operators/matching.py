"""Diary entries matched to observed events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import band_join

PENALTY_CAP, PENALTY_SCALE = 4.0, 0.25  # a known duration only breaks ties
BLOCK = 1024


def candidate_costs(diary: DataFrame, events: DataFrame, tolerance: int, duration_weight: float) -> DataFrame:
    """Admissible (entry, candidate) cells with their cost.

    ``diary(entry, start_idx, duration_s)`` (duration null where unknown),
    ``events(candidate, start_idx, duration_s)``; instants in seconds.
    """
    left = diary.select("entry", F.col("start_idx").alias("d_start"), F.col("duration_s").alias("d_dur"))
    right = events.select("candidate", F.col("start_idx").alias("e_start"), F.col("duration_s").alias("e_dur"))
    return priced(band_join(left, right, "d_start", "e_start", tolerance), duration_weight)


def priced(cells: DataFrame, duration_weight: float) -> DataFrame:
    relative = F.abs(F.col("e_dur") - F.col("d_dur")) / F.greatest("d_dur", F.lit(1))
    penalty = F.when(F.col("d_dur").isNotNull(), F.least(relative, F.lit(PENALTY_CAP)) * duration_weight * PENALTY_SCALE).otherwise(F.lit(0.0))
    return cells.withColumn("offset_s", F.col("d_start") - F.col("e_start")).withColumn("cost", F.abs("offset_s") + penalty)


def nearest(cells: DataFrame) -> DataFrame:
    """Each entry with its cheapest candidate (the lowest one of ties); candidates may serve several entries."""
    order = Window.partitionBy("entry").orderBy("cost", "candidate")
    return cells.withColumn("mt_n", F.row_number().over(order)).filter("mt_n = 1").drop("mt_n")


def min_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of least total cost by shortest augmenting paths over potentials.

    Infinite cells are inadmissible; as many admissible cells as possible are
    used, which a large finite price for the others ensures.
    """
    finite = np.isfinite(cost)
    if not finite.any():
        return []
    n, m = cost.shape
    big = (cost[finite].max() + 1) * (min(n, m) + 1)
    c = np.where(finite, cost, big)
    flip = n > m
    if flip:
        c, n, m = c.T, m, n
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = i, -1, 0.0
        while True:
            slack = base + c[row] - u[row] - v
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], col
            open_ = np.where(done, np.inf, reach)
            col = int(open_.argmin())
            base = open_[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[i] += base
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                u[row_of[j]] += base - reach[j]
            v[j] -= base - reach[j]
        while col >= 0:
            before = via[col]
            row_of[col] = i if before < 0 else row_of[before]
            col = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    pairs = [(j, i) for i, j in pairs] if flip else pairs
    return sorted((i, j) for i, j in pairs if finite[i, j])


def repeated_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rounds of assignment, each using a candidate once, until no admissible cell has an unmatched row."""
    cost = cost.copy()
    found: list[tuple[int, int]] = []
    while np.isfinite(cost).any():
        pairs = min_cost_assignment(cost)
        found += pairs
        cost[[i for i, _ in pairs]] = np.inf
    return found


def line_assignment(x: np.ndarray, y: np.ndarray, tolerance: int) -> list[tuple[int, int]]:
    """Index pairs of ascending instants: as many within ``tolerance`` as possible, at the least sum of distances.

    Two crossing pairs may be exchanged at no cost, so the best assignment
    keeps the order: a row's values over the prefixes of ``y`` that it reaches
    follow from those of the row before. Only every ``BLOCK``-th row is kept; the
    way back computes a block's rows again.
    """
    if len(x) > len(y):
        return sorted((i, j) for j, i in line_assignment(y, x, tolerance))
    low, high = np.searchsorted(y, x - tolerance), np.searchsorted(y, x + tolerance, "right")
    gain = (tolerance + 1) * (len(x) + 1)  # a pair more outweighs all distances

    def row(i: int, at: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = low[i], high[i]
        base = np.full(b - a + 1, before[-1])
        if at + len(before) > a:
            base[: at + len(before) - a] = before[a - at :]
        take = base[:-1] + (np.abs(y[a:b] - x[i]) - gain)
        taken = take < base[1:]
        np.minimum(base[1:], take, out=base[1:])
        return np.minimum.accumulate(base), taken

    kept, at, values = [], 0, np.zeros(1, np.int64)
    for i in range(len(x)):
        if i % BLOCK == 0:
            kept.append((at, values))
        at, values = low[i], row(i, at, values)[0]
    found, j = [], len(y)
    for k in reversed(range(len(kept))):
        at, values = kept[k]
        rows = []
        for i in range(k * BLOCK, min(len(x), (k + 1) * BLOCK)):
            values, taken = row(i, at, values)
            at = low[i]
            rows.append((i, values, taken))
        for i, values, taken in reversed(rows):
            j = min(j, high[i])
            first = int((values <= values[j - low[i]]).argmax())
            if first and taken[first - 1]:
                j = low[i] + first - 1
                found.append((i, int(j)))
    return found[::-1]


def band_assignment(cost, low: np.ndarray, high: np.ndarray, m: int, price: float) -> list[tuple[int, int]]:
    """Index pairs of least total cost, a row without a pair at ``price``; row i may take columns low[i] to high[i] at ``cost(i)``.

    Shortest augmenting paths over potentials, as in :func:`min_cost_assignment`,
    within the columns that the rows of a path reach; no matrix is held.
    """
    n = len(low)
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
    for i in range(n):
        row, col, base, left, right = i, -1, 0.0, low[i], high[i]
        stop, stop_col = np.inf, -1  # the cheapest row of the path to go without a pair
        while True:
            a, b = low[row], high[row]
            left, right = min(left, a), max(right, b)
            slack = base + cost(row) - u[row] - v[a:b]
            better = ~done[a:b] & (slack < reach[a:b])
            reach[a:b][better], via[a:b][better] = slack[better], col
            if base + price - u[row] < stop:
                stop, stop_col = base + price - u[row], col
            open_ = np.where(done[left:right], np.inf, reach[left:right])
            if not len(open_) or open_.min() >= stop:
                base, col = stop, stop_col
                break
            col = left + int(open_.argmin())
            base = reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[i] += base
        for j in left + np.flatnonzero(done[left:right]):
            if row_of[j] >= 0:
                u[row_of[j]] += base - reach[j]
            v[j] -= base - reach[j]
        while col >= 0:
            before = via[col]
            row_of[col] = i if before < 0 else row_of[before]
            col = before
        reach[left:right], via[left:right], done[left:right] = np.inf, -1, False
    return sorted((int(r), j) for j, r in enumerate(row_of) if r >= 0)


def assign_part(x: np.ndarray, y: np.ndarray, durations: np.ndarray, lengths: np.ndarray, tolerance: int, duration_weight: float) -> list[tuple[int, int]]:
    """Rounds of assignment of entries at ``x`` to candidates at ``y`` (ascending), each using a candidate once, until no entry with a candidate is left."""
    low, high = np.searchsorted(y, x - tolerance), np.searchsorted(y, x + tolerance, "right")
    known = np.isfinite(durations)
    found, open_ = [], np.flatnonzero(high > low)
    while len(open_):
        if known[open_].any():

            def cost(k: int) -> np.ndarray:
                i = open_[k]  # noqa: B023
                off = np.abs(y[low[i] : high[i]] - x[i]).astype(float)
                if known[i]:
                    relative = np.abs(lengths[low[i] : high[i]] - durations[i]) / max(durations[i], 1)
                    off += np.fmin(relative, PENALTY_CAP) * duration_weight * PENALTY_SCALE
                return off

            price = (tolerance + abs(duration_weight) + 2.0) * (len(open_) + 1)
            pairs = band_assignment(cost, low[open_], high[open_], len(y), price)
        else:
            pairs = line_assignment(x[open_], y, tolerance)
        found += [(int(open_[k]), j) for k, j in pairs]
        open_ = np.delete(open_, [k for k, _ in pairs])
    return found


def within_reach(points: DataFrame, others: DataFrame, tolerance: int) -> DataFrame:
    """The rows of ``points(at)`` with one of ``others(at)`` within ``tolerance``: of a block of that width its ends are enough."""
    width = max(tolerance, 1)
    block = F.floor(F.col("at") / width)
    ends = others.groupBy(block.alias("wr_b")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    spread = F.array(*(F.struct((F.col("wr_b") + k).alias("wr_b"), F.col(c).alias("wr_at")) for k, c in ((0, "low"), (1, "high"), (-1, "low"))))
    probes = ends.select(F.explode(spread).alias("p")).select("p.*")
    return points.withColumn("wr_b", block).join(probes, "wr_b").filter(F.abs(F.col("at") - F.col("wr_at")) <= tolerance).select("at").distinct()


def assign(diary: DataFrame, events: DataFrame, tolerance: int, duration_weight: float) -> DataFrame:
    """Every entry with an admissible candidate, matched by repeated assignment: entry, candidate, offset_s, cost.

    Entries and candidates whose starts lie more than ``tolerance`` from all
    others form independent problems; each is solved by itself, in memory in
    proportion to its rows. Its pairs are never listed.
    """
    ds, es = (df.filter("start_idx IS NOT NULL").select(F.col("start_idx").alias("at")).distinct() for df in (diary, events))
    points = within_reach(ds, es, tolerance).unionByName(within_reach(es, ds, tolerance)).distinct()
    order = Window.partitionBy("as_day").orderBy("at")
    # chains are cut where a gap exceeds the tolerance; days are joined through the first point after midnight
    day = F.floor(F.col("at") / 86400)
    dated = points.withColumn("as_day", day)
    ends = dated.groupBy("as_day").agg(F.max("at").alias("as_end"))
    prior = ends.withColumn("as_before", F.lag("as_end").over(Window.orderBy("as_day"))).drop("as_end")  # one row a day
    gap = F.col("at") - F.coalesce(F.lag("at").over(order), F.col("as_before"))
    starts = dated.join(prior, "as_day").withColumn("as_new", F.when(gap.isNull() | (gap > tolerance), F.col("at")))
    last = F.last("as_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tail = starts.groupBy("as_day").agg(F.max("as_new").alias("as_tail"))
    carry = tail.withColumn("as_carry", F.last("as_tail", ignorenulls=True).over(Window.orderBy("as_day").rowsBetween(Window.unboundedPreceding, -1))).drop("as_tail")
    named = starts.withColumn("as_in", last).join(carry, "as_day").select("at", F.coalesce("as_in", "as_carry").alias("component"))
    side = lambda df, c, is_entry: df.select(F.col(c).alias("id"), F.col("start_idx").cast("long").alias("at"), F.col("duration_s").cast("double").alias("dur"), F.lit(is_entry).alias("is_entry"))
    rows = side(diary, "entry", True).unionByName(side(events, "candidate", False)).join(named, "at")

    def solve(part: pa.Table) -> pa.Table:
        part = part.sort_by([("at", "ascending"), ("id", "ascending")])
        of = np.asarray(part["is_entry"].to_numpy(), bool)
        at, dur = part["at"].to_numpy(), part["dur"].to_numpy()
        e, c = np.flatnonzero(of), np.flatnonzero(~of)
        found = np.array(assign_part(at[e], at[c], dur[e], dur[c], tolerance, duration_weight), np.int64).reshape(-1, 2)
        e, c = part.take(pa.array(e[found[:, 0]])), part.take(pa.array(c[found[:, 1]]))
        names = ["entry", "d_start", "d_dur", "candidate", "e_start", "e_dur"]
        return pa.table([x[k] for x in (e, c) for k in ("id", "at", "dur")], names)

    chosen = rows.groupBy("component").applyInArrow(solve, "entry long, d_start long, d_dur double, candidate long, e_start long, e_dur double")
    return priced(chosen, duration_weight)


def match_diary(diary: DataFrame, events: DataFrame, tolerance: int, duration_weight: float, strategy: str = "assign") -> DataFrame:
    """entry, candidate, offset_s, cost, shared_candidate. ``diary`` rows that are excluded or lack a fixture take no part."""
    usable = diary.filter("NOT excluded AND fixture IS NOT NULL")
    if strategy == "nearest":
        found = nearest(candidate_costs(usable, events, tolerance, duration_weight))
    else:
        found = assign(usable, events, tolerance, duration_weight)
    shared = F.count("*").over(Window.partitionBy("candidate")) > 1
    return found.select("entry", "candidate", "offset_s", "cost").withColumn("shared_candidate", shared)


def match_report(diary: DataFrame, matched: DataFrame) -> DataFrame:
    """fixture, n_rows, n_matched, match_rate, median_offset over the usable entries."""
    usable = diary.filter("NOT excluded AND fixture IS NOT NULL")
    joined = usable.join(matched.select("entry", "offset_s"), "entry", "left")
    return joined.groupBy("fixture").agg(
        F.count("*").alias("n_rows"),
        F.count("offset_s").alias("n_matched"),
        (F.count("offset_s") / F.count("*")).alias("match_rate"),
        F.median("offset_s").alias("median_offset"),
    )


def orphans(events: DataFrame, matched: DataFrame) -> DataFrame:
    return events.join(matched.select("candidate").distinct(), "candidate", "left_anti")


def unknown_codes(diary: DataFrame) -> DataFrame:
    """Counts of page/symbol codes that name no fixture."""
    return diary.filter("fixture IS NULL AND NOT excluded").groupBy("page", "symbol").agg(F.count("*").alias("n"))
