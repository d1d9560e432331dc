"""Model windows, day partitions and tiling of a trace."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import day_of


def assign_windows(samples: DataFrame, length: int, stride: int) -> DataFrame:
    """Each sample once for every window (``start``) of ``length`` that holds it; starts are 0, stride, ..."""
    low = F.greatest(F.ceil((F.col("idx") - (length - 1)) / stride), F.lit(0))
    high = F.floor(F.col("idx") / stride)
    return samples.filter(high >= low).withColumn("start", F.explode(F.sequence(low * stride, high * stride, F.lit(stride).cast("long"))))


def make_windows(samples: DataFrame, length: int, stride: int, days: DataFrame | None = None, active_floor: float | None = None, arrays: bool = True) -> DataFrame:
    """Full windows: start, ts, (x, valid arrays), any_active, first_day, last_day.

    With ``days`` a window's first and last sample lie in one permitted day;
    with ``active_floor`` at least one sample's ``label`` exceeds it.
    """
    at = F.struct("idx", "flow", "valid")
    columns = [F.count("*").alias("n"), F.min("ts").alias("ts"), F.min(day_of("ts")).alias("first_day"), F.max(day_of("ts")).alias("last_day")]
    if active_floor is not None:
        columns.append(F.bool_or(F.col("label") > active_floor).alias("any_active"))
    if arrays:
        columns.append(F.array_sort(F.collect_list(at)).alias("w"))  # at most ``length`` samples
    found = assign_windows(samples, length, stride).groupBy("start").agg(*columns).filter(F.col("n") == length).drop("n")
    if arrays:
        found = found.withColumn("x", F.col("w.flow")).withColumn("valid", F.col("w.valid")).drop("w")
    if days is not None:
        found = found.filter("first_day = last_day").join(days.select(F.col("day").alias("first_day")), "first_day", "left_semi")
    return found.filter("any_active") if active_floor is not None else found


def event_counts(windows: DataFrame, labels: DataFrame, length: int, stride: int, floor: float) -> DataFrame:
    """fixture, n_windows in which it appears."""
    spread = assign_windows(labels.filter(F.col("flow") > floor).select("fixture", "idx"), length, stride)
    return spread.join(windows.select("start"), "start", "left_semi").select("fixture", "start").distinct().groupBy("fixture").agg(F.count("*").alias("n_windows"))


def part_sizes(n: int, test_fraction: float, val_fraction: float, min_test: int, min_val: int) -> tuple[int, int]:
    """Numbers of test and validation days of ``n``: fractions (half to even) with minima, or quarter and fifth where these would leave no day to train on."""
    test, val = max(round(n * test_fraction), min_test), max(round(n * val_fraction), min_val)
    if test + val < n:
        return test, val
    test, val = max(n // 4, 1), max(n // 5, 1)
    return test, val if test + val < n else max(n - test - 1, 0)


def partition_days(days: list, test_fraction: float, val_fraction: float, min_test: int, min_val: int, seed: int, stratify: bool = True) -> dict[str, list]:
    """Days by part (train, val, test) without overlap; weekdays and weekends are drawn in proportion."""
    days = sorted(set(days))
    if not days:
        raise ValueError("there are no labelled days")
    rng = np.random.default_rng(seed)
    n_test, n_val = part_sizes(len(days), test_fraction, val_fraction, min_test, min_val)

    def take(pool: list, n: int) -> list:
        if not stratify:
            return sorted(rng.permutation(np.array(pool, dtype=object))[:n].tolist())
        weekend = [d for d in pool if d.weekday() >= 5]
        week = [d for d in pool if d.weekday() < 5]
        k = min(round(n * len(weekend) / max(len(pool), 1)), len(weekend))
        k = min(max(k, n - len(week)), len(weekend))
        pick = lambda part, m: [part[i] for i in rng.permutation(len(part))[:m]]
        return sorted(pick(weekend, k) + pick(week, n - k))

    test = take(days, n_test)
    rest = [d for d in days if d not in set(test)]
    val = take(rest, n_val)
    held = {*test, *val}
    return {"train": [d for d in days if d not in held], "val": val, "test": test}


def split_days(days: list, test_fraction: float = 0.2, val_fraction: float = 0.15, seed: int = 0) -> dict[str, list]:
    """The plain split of a trace without a configuration: truncated fractions, one day at least, each day type rounded by itself."""
    days = sorted(set(days))
    rng = np.random.default_rng(seed)
    kinds = [[d for d in days if d.weekday() < 5], [d for d in days if d.weekday() >= 5]]
    share = len(kinds[1]) / max(len(days), 1)
    held: dict[str, set] = {}
    for part, fraction in (("test", test_fraction), ("val", val_fraction)):
        n = max(int(len(days) * fraction), 1)
        held[part] = set()
        for kind, want in zip(kinds, (round(n * (1 - share)), round(n * share))):
            pool = [d for d in kind if d not in held["test"]]
            held[part] |= {pool[i] for i in rng.permutation(len(pool))[:want]}
    return {"train": [d for d in days if d not in held["test"] | held["val"]], "val": sorted(held["val"]), "test": sorted(held["test"])}


def partition_table(spark: SparkSession, parts: dict[str, list]) -> DataFrame:
    """day, part."""
    return spark.createDataFrame([(day, part) for part, days in parts.items() for day in days], "day date, part string")


def partition_summary(table: DataFrame) -> DataFrame:
    """part, n_days, n_weekend, first, last."""
    return table.groupBy("part").agg(
        F.count("*").alias("n_days"), F.count_if(F.weekday("day") >= 5).alias("n_weekend"), F.min("day").alias("first"), F.max("day").alias("last")
    )


def build_partitions(samples: DataFrame, table: DataFrame, length: int, stride: int, active_floor: float | None = None, arrays: bool = True) -> DataFrame:
    """Windows with ``part``: each lies in one day, and with it in one part, so that no sample serves two parts."""
    made = make_windows(samples, length, stride, table.select("day").distinct(), active_floor, arrays)
    return made.join(table.select(F.col("day").alias("first_day"), "part"), "first_day")


def window_summary(windows: DataFrame) -> DataFrame:
    """n_windows, n_active, first, last, n_days of windows (``any_active`` where they have it)."""
    active = F.count_if("any_active") if "any_active" in windows.columns else F.lit(None).cast("long")
    return windows.agg(
        F.count("*").alias("n_windows"), active.alias("n_active"), F.min("start").alias("first"), F.max("start").alias("last"), F.count_distinct("first_day").alias("n_days")
    )


def thin_support(counts: DataFrame, fixtures: DataFrame, least: int = 3) -> DataFrame:
    """fixture, n_windows of the fixtures that appear in fewer than ``least`` held-out windows; their scores mean little."""
    found = fixtures.select("fixture").join(counts, "fixture", "left").select("fixture", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))
    return found.filter(F.col("n_windows") < least)


def slice_bounds(length: int, stride: int, emit: str) -> tuple[int, int]:
    """First and last (exclusive) position of a window's own slice."""
    if stride > length:
        raise ValueError("the stride exceeds the window")
    starts = {"center": (length - stride) // 2, "tail": length - stride, "last": length - stride, "head": 0, "first": 0}
    if emit not in starts:
        raise ValueError(f"unknown slice {emit!r}")
    return starts[emit], starts[emit] + stride


def tile_owner(samples: DataFrame, n: int, length: int, stride: int, emit: str = "center") -> DataFrame:
    """``samples`` with owner (start of the window whose slice gives the sample; null: uncovered) and its position there."""
    low, _ = slice_bounds(length, stride, emit)
    owner = F.floor((F.col("idx") - low) / stride) * stride
    fits = (owner >= 0) & (owner + length <= n)
    return samples.withColumn("owner", F.when(fits, owner)).withColumn("position", F.when(fits, F.col("idx") - owner))
