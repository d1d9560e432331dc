"""Long label matrices: built from matched events, read from files, summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import day_of
from .segment import samples_of


def build_labels(trace: DataFrame, events: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """fixture, idx, ts, flow: the total flow dealt to the fixtures that occupy a sample, by their rates.

    Without rates every weight is 1. A sample counts once however many events of a fixture hold it.
    """
    inside = samples_of(events.select("fixture", "start_idx", "end_idx"), trace, []).select("fixture", "idx", "s_flow").distinct()
    if rates is not None:
        inside = inside.join(F.broadcast(rates.select("fixture", "rate")), "fixture", "left")
        weight = F.coalesce("rate", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    shared = inside.withColumn("lb_w", weight).withColumn("lb_t", F.sum("lb_w").over(Window.partitionBy("idx")))
    flow = F.greatest("s_flow", F.lit(0.0)) * F.col("lb_w") / F.col("lb_t")
    return shared.select("fixture", "idx", flow.alias("flow")).join(trace.select("idx", "ts"), "idx")


def widen(labels: DataFrame, fixtures: list[str]) -> DataFrame:
    """One column a configured fixture; absent ones are 0."""
    return labels.groupBy("idx", "ts").pivot("fixture", fixtures).agg(F.sum("flow")).fillna(0.0, fixtures)


def lengthen(wide: DataFrame, fixtures: list[str]) -> DataFrame:
    found = [f for f in fixtures if f in wide.columns]
    if not found:
        raise ValueError("the label matrix has no column of a configured fixture")
    return wide.unpivot(["idx", "ts"], found, "fixture", "flow")


def active_days(labels: DataFrame, floor: float) -> DataFrame:
    return labels.filter(F.col("flow") > floor).select(day_of("ts").alias("day")).distinct()


def active_mask(labels: DataFrame, floor: float = 0.05) -> DataFrame:
    return labels.groupBy("idx", "ts").agg(F.bool_or(F.col("flow") > floor).alias("active"))


def summary(labels: DataFrame, floor: float, period_s: float = 1.0) -> DataFrame:
    return labels.groupBy("fixture").agg(
        F.count("*").alias("samples"), F.count_if(F.col("flow") > floor).alias("active"), (F.sum("flow") * period_s / 60).alias("volume")
    )


def concurrency(labels: DataFrame, floor: float) -> DataFrame:
    """n_active, samples, share among samples with an active fixture."""
    per = labels.filter(F.col("flow") > floor).groupBy("ts").agg(F.count_distinct("fixture").alias("n_active"))
    counts = per.groupBy("n_active").agg(F.count("*").alias("samples"))
    return counts.withColumn("share", F.col("samples") / F.sum("samples").over(Window.partitionBy()))


def agreement(labels: DataFrame, trace: DataFrame) -> DataFrame:
    """Mean absolute gap and median ratio of the trace to the summed labels."""
    total = labels.groupBy("ts").agg(F.sum("flow").alias("t"))
    both = trace.filter("valid").join(total, "ts")
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("flow") - F.col("t"))).alias("mean_gap"), F.median(F.when(F.col("t") > 0, F.col("flow") / F.col("t"))).alias("median_ratio"))
