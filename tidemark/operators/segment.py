"""Gaps and islands: hysteresis, runs, bridging, plateaus and event statistics.

Long ordered windows are cut by day: the trigger's state at midnight is carried
by one row a day, and runs cut at midnight touch, so bridging joins them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import day_of, half_even_samples

PLATEAU_FROM, PLATEAU_TO = 0.30, 0.85


def hysteresis(samples: DataFrame, on: Column | float, off: Column | float, key: list[str], value: str = "flow") -> DataFrame:
    """``samples`` with ``active``: on above ``on``, off below ``off`` (both strict), else as before; off at first."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    if not isinstance(on, Column) and not isinstance(off, Column) and off > on:
        raise ValueError("the off threshold lies above the on threshold")
    x = F.col(value)
    state = F.when(x > lit(on), 1).when(x < lit(off), 0)
    marked = samples.withColumn("hys_state", state).withColumn("hys_day", day_of("ts"))
    by_day = Window.partitionBy(*key, "hys_day").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("hys_day").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.filter("hys_state IS NOT NULL").groupBy(*key, "hys_day").agg(F.max_by("hys_state", "idx").alias("hys_last"))
    days = marked.select(*key, "hys_day").distinct().join(ends, [*key, "hys_day"], "left")
    carried = days.withColumn("hys_carry", F.last("hys_last", ignorenulls=True).over(before)).drop("hys_last")
    joined = marked.join(carried, [*key, "hys_day"])
    inside = F.last("hys_state", ignorenulls=True).over(by_day)
    return joined.withColumn("active", F.coalesce(inside, F.col("hys_carry"), F.lit(0)) == 1).drop("hys_state", "hys_day", "hys_carry")


def runs(samples: DataFrame, key: list[str], mask: str = "active") -> DataFrame:
    """key, start_idx, end_idx (exclusive) of maximal runs of true samples, cut at midnight."""
    true = samples.filter(F.col(mask)).withColumn("run_day", day_of("ts"))
    place = F.row_number().over(Window.partitionBy(*key, "run_day").orderBy("idx"))
    return (
        true.withColumn("run_of", F.col("idx") - place)
        .groupBy(*key, "run_day", "run_of")
        .agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"))
        .drop("run_day", "run_of")
    )


def bridge(found: DataFrame, max_gap: int | Column, key: list[str]) -> DataFrame:
    """Runs merged over gaps of at most ``max_gap`` samples; ``n_runs`` counts the parts."""
    order = Window.partitionBy(*key).orderBy("start_idx")
    gap = F.col("start_idx") - F.lag("end_idx").over(order)
    limit = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    opens = F.when(gap.isNull() | (gap > limit), 1).otherwise(0)
    # parts cut at midnight (gap 0) are one run
    counts = F.when(gap.isNull() | (gap > 0), 1).otherwise(0)
    numbered = found.withColumn("br_counts", counts).withColumn("br_opens", opens).withColumn("br_group", F.sum("br_opens").over(order))
    merged = numbered.groupBy(*key, "br_group").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.sum("br_counts").alias("n_runs"))
    return merged.drop("br_group")


def samples_of(events: DataFrame, samples: DataFrame, key: list[str], inclusive: bool = False) -> DataFrame:
    """Samples inside each event: an equi-join on key and block of samples, then the range."""
    block = 4096
    last = F.col("end_idx") if inclusive else F.col("end_idx") - 1
    spread = events.withColumn("so_block", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor(last / block))))
    parts = samples.select(*key, "idx", F.col("flow").alias("s_flow"), F.floor(F.col("idx") / block).alias("so_block"))
    upper = F.col("idx") <= F.col("end_idx") if inclusive else F.col("idx") < F.col("end_idx")
    return spread.join(parts, [*key, "so_block"]).filter((F.col("idx") >= F.col("start_idx")) & upper).drop("so_block")


def plateau(inside: DataFrame, event_key: list[str]) -> DataFrame:
    """event key, plateau: the median of the samples from 30 % to 85 % of the event; null below 6 samples (3 in the slice)."""
    order = Window.partitionBy(*event_key).orderBy("idx")
    ranked = inside.withColumn("pl_i", F.row_number().over(order) - 1).withColumn("pl_n", F.count("*").over(Window.partitionBy(*event_key)))
    low = F.floor(F.col("pl_n") * F.lit(PLATEAU_FROM))
    high = F.greatest(F.floor(F.col("pl_n") * F.lit(PLATEAU_TO)), low + 1)
    kept = (F.col("pl_n") >= 6) & (F.col("pl_i") >= low) & (F.col("pl_i") < high)
    found = ranked.groupBy(*event_key).agg(F.median(F.when(kept, F.col("s_flow"))).alias("pl_m"), F.count_if(kept).alias("pl_k"))
    return found.select(*event_key, F.when(F.col("pl_k") >= 3, F.col("pl_m")).alias("plateau"))


def segment(
    samples: DataFrame,
    on: Column | float,
    off: Column | float,
    min_samples: int | Column,
    max_gap: int | Column,
    key: list[str],
    use_valid: bool = True,
    split_at_gaps: bool = False,
) -> DataFrame:
    """key, start_idx, end_idx, n_runs of events of at least max(min, 1) samples.

    Bridging follows masking, so an event may span a short dropout;
    ``split_at_gaps`` turns that off by bridging nothing.
    """
    marked = hysteresis(samples, on, off, key)
    if use_valid:
        marked = marked.withColumn("active", F.col("active") & F.col("valid"))
    least = min_samples if isinstance(min_samples, Column) else F.lit(min_samples)
    joined = bridge(runs(marked, key), F.lit(0) if split_at_gaps else max_gap, key)
    return joined.filter(F.col("end_idx") - F.col("start_idx") >= F.greatest(least, F.lit(1)))


def event_stats(events: DataFrame, samples: DataFrame, key: list[str], period_s: float) -> DataFrame:
    """``events`` with n, mean, peak, plateau and volume of the clipped samples."""
    clipped = samples.withColumn("flow", F.greatest("flow", F.lit(0.0)))
    inside = samples_of(events, clipped, key)
    ident = [*key, "start_idx", "end_idx"]
    basic = inside.groupBy(*ident).agg(
        F.count("*").alias("n"), F.avg("s_flow").alias("mean"), F.max("s_flow").alias("peak"), (F.sum("s_flow") * period_s / 60).alias("volume")
    )
    return events.join(basic, ident, "left").join(plateau(inside, ident), ident, "left")


def samples_for(seconds: float, period_s: float) -> int:
    return half_even_samples(seconds, period_s)
