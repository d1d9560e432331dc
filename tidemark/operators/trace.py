"""Regular traces: conditioning, volumes and summaries.

A trace is ``idx BIGINT, ts TIMESTAMP_NTZ, flow DOUBLE, valid BOOLEAN`` and may
carry a ``fixture`` key (long label matrices do).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import day_of, deadband, epoch_seconds, from_seconds, shift_hours


def merge_readings(readings: DataFrame, values: list[str], source: str | None = None) -> DataFrame:
    """One row per timestamp: means that skip nulls; with ``source``, the mean of each source's means."""
    means = [F.avg(v).alias(v) for v in values]
    if source:
        readings = readings.groupBy(source, "ts").agg(*means)
    return readings.groupBy("ts").agg(*means)


def shift_timezone(readings: DataFrame, hours: float) -> DataFrame:
    return readings.withColumn("ts", shift_hours("ts", hours))


def regularise(readings: DataFrame, period_s: int, fixtures: list[str] | None = None) -> DataFrame:
    """``readings(ts, flow)`` on the grid from the first to the last reading, anchored at the first.

    Readings off the grid are dropped; missing samples are 0 and invalid. With
    ``fixtures`` (a configured list) each of them gets the whole grid.
    """
    spark = readings.sparkSession
    key = ["fixture"] if fixtures is not None else []
    known = readings.filter("ts IS NOT NULL AND flow IS NOT NULL").select(*key, epoch_seconds("ts").alias("sec"), "flow")
    first, last = known.agg(F.min("sec"), F.max("sec")).first()
    if first is None:
        grid = spark.range(0)
        first = 0
    else:
        grid = spark.range(0, (last - first) // period_s + 1)
    grid = grid.select(F.col("id").alias("idx"), (F.col("id") * period_s + F.lit(first)).alias("sec"))
    if fixtures is not None:
        grid = grid.select(F.explode(F.array(*map(F.lit, fixtures))).alias("fixture"), "idx", "sec")
    on_grid = known.groupBy(*key, "sec").agg(F.avg("flow").alias("flow"))
    joined = grid.join(on_grid, [*key, "sec"], "left")
    return joined.select(*key, "idx", from_seconds("sec").alias("ts"), F.coalesce("flow", F.lit(0.0)).alias("flow"), F.col("flow").isNotNull().alias("valid"))


def deadbanded(trace: DataFrame, floor: float) -> DataFrame:
    return trace.withColumn("flow", deadband(F.col("flow"), floor))


def volume(trace: DataFrame, period_s: float, floor: float) -> DataFrame:
    """Gallons over valid samples."""
    return trace.agg((F.coalesce(F.sum(F.when(F.col("valid"), deadband(F.col("flow"), floor))), F.lit(0.0)) * period_s / 60).alias("volume"))


def summary(trace: DataFrame, period_s: float, floor: float) -> DataFrame:
    flow = deadband(F.col("flow"), floor)
    return trace.agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count("*").alias("samples"),
        F.count_if("valid").alias("observed"),
        F.count_if(~F.col("valid")).alias("missing"),
        F.count_distinct(day_of("ts")).alias("days"),
        (F.coalesce(F.sum(F.when(F.col("valid"), flow)), F.lit(0.0)) * period_s / 60).alias("volume"),
        F.max(F.when(F.col("valid"), flow)).alias("peak"),
    ).withColumn("missing_frac", F.when(F.col("samples") > 0, F.col("missing") / F.col("samples")).otherwise(F.lit(0.0)))


def local_days(trace: DataFrame) -> DataFrame:
    return trace.select(day_of("ts").alias("day")).distinct()


def one_day(trace: DataFrame, day: str) -> DataFrame:
    """Half-open slice of a day; the bounds reach the scan."""
    return trace.filter(f"ts >= timestamp_ntz'{day} 00:00:00' AND ts < timestamp_ntz'{day} 00:00:00' + INTERVAL 1 DAY")
