"""Column functions on time, samples and recursive filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(ts: str) -> Column:
    """Whole seconds of a zone-free timestamp."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {ts})")


def from_seconds(seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {seconds}, {EPOCH})")


def deadband(flow: Column, floor: float) -> Column:
    """Below the noise floor (strictly, by magnitude) zero; negative flow zero."""
    return F.when(F.abs(flow) < floor, F.lit(0.0)).otherwise(F.greatest(flow, F.lit(0.0)))


def shift_hours(ts: str, hours: float) -> Column:
    return F.expr(f"timestampadd(SECOND, {round(hours * 3600)}, {ts})") if hours else F.col(ts)


def half_even_samples(seconds: float, period: float) -> int:
    """A duration in samples, halves to even."""
    return round(seconds / period)


def day_of(ts: str) -> Column:
    return F.col(ts).cast("date")


def hours_of_day(ts: str, with_seconds: bool = True) -> Column:
    hours = F.hour(ts) + F.minute(ts) / F.lit(60.0)
    return hours + F.second(ts).cast("int") / F.lit(3600.0) if with_seconds else hours


def day_type(ts: str) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def one_pole(samples: Column, alpha: float) -> Column:
    """First-order recursive low pass over an ordered array, started at its first value."""
    start = F.struct(F.get(samples, F.lit(0)).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        y = acc["y"] + F.lit(alpha) * (x - acc["y"])
        return F.struct(y.alias("y"), F.concat(acc["out"], F.array(y)).alias("out"))

    return F.aggregate(samples, start, step)["out"]
