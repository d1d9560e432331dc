"""Interval joins as equi-joins: overlap, isolation, band and best-match forms."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def isolated(events: DataFrame, start: str = "start_idx", end: str = "end_idx", tie: tuple[str, ...] = ()) -> DataFrame:
    """Events that overlap no other row, by running extremes instead of a self-join.

    The running maximum is taken within blocks of the start and carried over
    blocks, so no task sees all events.
    """
    block = 1 << 14
    order = [start, end, *tie]
    blocked = events.withColumn("iso_b", F.floor(F.col(start) / block))
    inside = Window.partitionBy("iso_b").orderBy(*order)
    edges = blocked.groupBy("iso_b").agg(F.max(end).alias("iso_max"), F.min(start).alias("iso_min"))
    over = Window.orderBy("iso_b")  # one row a block
    edges = edges.select(
        "iso_b",
        F.max("iso_max").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("iso_before"),
        F.lead("iso_min").over(over).alias("iso_after"),
    )
    ahead = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    joined = blocked.withColumn("iso_prev", ahead).withColumn("iso_next", F.lead(start).over(inside)).join(edges, "iso_b")
    free_left = F.coalesce(F.greatest("iso_prev", "iso_before") <= F.col(start), F.lit(True))
    free_right = F.coalesce(F.coalesce("iso_next", "iso_after") >= F.col(end), F.lit(True))
    return joined.filter(free_left & free_right).select(events.columns)


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: int = 4096) -> DataFrame:
    """Pairs of half-open intervals (``start_idx``, ``end_idx``) that share samples, within ``key``.

    Both sides are spread over blocks of ``width``; a pair is made only in the
    block that holds the start of its intersection, hence once.
    """
    spread = lambda df: df.withColumn("ov_b", F.explode(F.sequence(F.floor(F.col("start_idx") / width), F.floor((F.col("end_idx") - 1) / width))))
    rename = lambda df, p: df.select(*(F.col(c).alias(c if c in key or c == "ov_b" else f"{p}_{c}") for c in df.columns))
    a, b = rename(spread(left), "l"), rename(spread(right), "r")
    low, high = F.greatest("l_start_idx", "r_start_idx"), F.least("l_end_idx", "r_end_idx")
    pairs = a.join(b, [*key, "ov_b"]).filter((low < high) & (F.floor(low / width) == F.col("ov_b"))).drop("ov_b")
    return pairs.withColumn("inter", high - low)


def iou(pairs: DataFrame) -> DataFrame:
    union = (F.col("l_end_idx") - F.col("l_start_idx")) + (F.col("r_end_idx") - F.col("r_start_idx")) - F.col("inter")
    return pairs.withColumn("iou", F.col("inter") / union)


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tolerance: int, key: list[str] | None = None) -> DataFrame:
    """Pairs whose instants differ by at most ``tolerance``: bins of that size, neighbours probed."""
    key = key or []
    a = left.withColumn("bj_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(left_at) / tolerance) + d)))
    b = right.withColumn("bj_b", F.floor(F.col(right_at) / tolerance))
    return a.join(b, [*key, "bj_b"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= tolerance).drop("bj_b")


def merge_close(events: DataFrame, min_gap: float | Column, key: list[str]) -> DataFrame:
    """Events of a key merged where the gap to the one before is strictly below ``min_gap``.

    The end is that of the last one by start; volumes add up, peaks are the
    greatest; other columns are those of the first.
    """
    if not isinstance(min_gap, Column) and min_gap <= 0:
        return events
    order = Window.partitionBy(*key).orderBy("start_idx", "end_idx")
    gap = F.col("start_idx") - F.lag("end_idx").over(order)
    limit = min_gap if isinstance(min_gap, Column) else F.lit(min_gap)
    numbered = events.withColumn("mc_g", F.sum(F.when(gap.isNull() | (gap >= limit), 1).otherwise(0)).over(order))
    at = F.struct("start_idx", "end_idx")
    rules = {"start_idx": F.min("start_idx"), "end_idx": F.max_by("end_idx", at), "volume": F.sum("volume"), "peak": F.max("peak")}
    columns = [(rules[c] if c in rules else F.min_by(c, at)).alias(c) for c in events.columns if c not in key]
    return numbered.groupBy(*key, "mc_g").agg(*columns, F.count("*").alias("n_merged")).drop("mc_g")


def mutual_best(pairs: DataFrame, left: list[str], right: list[str], score: str, max_rounds: int = 200) -> DataFrame:
    """One-to-one greedy matching by descending score under the total order (score, left, right).

    Pairs that are best for both of their sides are kept, their sides leave,
    and the rest is matched again; equal to taking pairs one by one. The ranked pairs
    of each round are tables in the shared folder, so plans stay
    short; most inputs need a round or two. Rounds go on until no pair is left;
    after every ``max_rounds`` of them the pairs found so far become one table.
    """
    order = [F.desc(score), *left, *right]
    a = F.row_number().over(Window.partitionBy(*left).orderBy(*order))
    b = F.row_number().over(Window.partitionBy(*right).orderBy(*order))
    kept, rest = [], pairs
    while True:
        ranked = staged(rest.withColumn("mb_a", a).withColumn("mb_b", b), "ranked-pairs")
        best = ranked.filter("mb_a = 1 AND mb_b = 1").drop("mb_a", "mb_b")
        if len(kept) and best.isEmpty():
            raise ValueError("pairs repeat a left and right side")
        kept.append(best)
        out = ranked.filter("mb_a > 1 OR mb_b > 1").drop("mb_a", "mb_b")
        if out.isEmpty():
            break
        rest = out.join(best.select(*left), left, "left_anti").join(best.select(*right), right, "left_anti").select(pairs.columns)
        if rest.isEmpty():
            break
        if len(kept) >= max_rounds:
            kept = [staged(functools.reduce(DataFrame.unionByName, kept), "matched-pairs")]
    found = kept[0]
    for part in kept[1:]:
        found = found.unionByName(part)
    return found
