"""A synthetic household: events drawn on the driver, samples made on the executors.

The event list is small (a few hundred a day) and comes from a seeded NumPy
generator; the flows, the meter's response and its noise are made per day.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WARM_UP = 600  # seconds of the day before that settle the meter's response


@dataclass(frozen=True)
class Use:
    """How a fixture is used: uses a day, rate, length range, usual hours with spread, fills of an appliance cycle."""

    code: str
    per_day: float
    rate: float
    shortest: float
    longest: float
    hours: tuple[float, ...] = (8.0, 19.0)
    spread: float = 2.0
    fills: int = 1
    fill_gap: float = 420.0


@dataclass(frozen=True)
class Spec:
    start: datetime = datetime(2024, 3, 4)
    days: int = 3
    seed: int = 7
    uses: tuple[Use, ...] = field(
        default_factory=lambda: (
            Use("Ad_S", 1.2, 1.9, 240, 600, (7.0,)),
            Use("Kid_S", 0.8, 2.1, 240, 700, (20.0,)),
            Use("Ad_T", 6, 2.6, 35, 60),
            Use("Kid_T", 4, 3.1, 35, 60),
            Use("Ad_F", 9, 0.9, 4, 45),
            Use("Kitch_F", 12, 1.2, 4, 90, (8.0, 12.5, 18.5)),
            Use("Dish_W", 0.7, 1.5, 70, 110, (20.0,), 1.0, 4),
            Use("Wash_M", 0.5, 3.6, 60, 150, (10.0,), 2.0, 3),
        )
    )
    stages: int = 4
    tau_s: float = 1.5
    noise: float = 0.02
    superposition: float = 0.9
    dropout_per_day: float = 4.0
    dropout_s: int = 20
    period_s: int = 1


def draw_events(spec: Spec) -> pd.DataFrame:
    """fixture, start_idx, end_idx, rate, cycle of all uses that end within the record."""
    rng = np.random.default_rng(spec.seed)
    last, rows, cycle = spec.days * 86_400, [], 0
    for day in range(spec.days):
        for use in spec.uses:
            for _ in range(rng.poisson(use.per_day)):
                hour = float(np.clip(rng.normal(rng.choice(use.hours), use.spread), 0, 23.99))
                at, cycle = day * 86_400 + int(hour * 3600), cycle + 1
                for _ in range(use.fills):
                    length = int(round(np.exp(rng.uniform(np.log(use.shortest), np.log(use.longest)))))
                    if at + length < last:
                        rows.append((use.code, at, at + length, use.rate * rng.uniform(0.96, 1.04), cycle))
                    at += length + int(use.fill_gap * rng.uniform(0.7, 1.3))
    return pd.DataFrame(rows, columns=["fixture", "start_idx", "end_idx", "rate", "cycle"]).sort_values(["start_idx", "fixture"], ignore_index=True)


def one_pole(x: np.ndarray, tau: float, stages: int, period: float = 1.0) -> np.ndarray:
    """Cascaded first-order responses, each started at the first value; none for tau <= 0 or without stages."""
    if tau <= 0 or stages < 1 or not len(x):
        return x.astype(float)
    keep, y = float(np.exp(-period / tau)), x.astype(float)
    for _ in range(stages):
        out, last = np.empty_like(y), y[0]
        for i, v in enumerate(y):
            last = keep * last + (1 - keep) * v
            out[i] = last
        y = out
    return y


def flows(spark: SparkSession, spec: Spec, events: pd.DataFrame | None = None) -> DataFrame:
    """idx, ts, truth by fixture as a map, flow (the meter's), valid: one task makes one day."""
    found = draw_events(spec) if events is None else events
    shared = spark.sparkContext.broadcast((spec, found))  # a household's event list

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spec, events = shared.value
        for pdf in batches:
            for day in pdf["day"]:
                low = max(day * 86_400 - WARM_UP, 0)
                high = (day + 1) * 86_400
                n = high - low
                truth: dict[str, np.ndarray] = {}
                mine = events[(events.start_idx < high) & (events.end_idx > low)]
                for e in mine.itertuples():
                    truth.setdefault(e.fixture, np.zeros(n))[max(e.start_idx - low, 0) : e.end_idx - low] += e.rate
                total = sum(truth.values(), np.zeros(n))
                if truth:
                    busy = sum((v > 0).astype(int) for v in truth.values())
                    total = np.where(busy > 1, total * spec.superposition, total)
                rng = np.random.default_rng([spec.seed, int(day)])
                meter = one_pole(total, spec.tau_s, spec.stages, spec.period_s) + rng.normal(0, spec.noise, n)
                valid = np.ones(n, bool)
                for s in rng.integers(0, n, rng.poisson(spec.dropout_per_day)):
                    valid[s : s + int(rng.integers(1, spec.dropout_s + 1))] = False
                own = slice(day * 86_400 - low, n)
                idx = np.arange(day * 86_400, high)
                codes = list(truth)
                maps = [{c: float(truth[c][i]) for c in codes if truth[c][i] > 0} for i in range(own.start, n)]
                yield pd.DataFrame({"idx": idx, "flow": np.where(valid, meter, 0.0)[own], "valid": valid[own], "truth": maps})

    days = spark.range(0, spec.days, 1, spec.days).withColumnRenamed("id", "day")
    made = days.mapInPandas(make, "idx long, flow double, valid boolean, truth map<string,double>")
    start = spec.start.strftime("%Y-%m-%d %H:%M:%S")
    return made.withColumn("ts", F.expr(f"timestampadd(SECOND, idx, timestamp_ntz'{start}')"))


def truth_long(made: DataFrame) -> DataFrame:
    return made.select("idx", "ts", F.explode("truth").alias("fixture", "flow"))


def write_diary(events: pd.DataFrame, spec: Spec, miss: float = 0.05, jitter_s: float = 20.0, resolution_s: int = 60) -> pd.DataFrame:
    """What a household would note: fills of a cycle as one entry, some missed, times rounded; sorted by start."""
    rng = np.random.default_rng(spec.seed + 1)
    grouped = events.groupby(["fixture", "cycle"], as_index=False).agg(start_idx=("start_idx", "min"), end_idx=("end_idx", "max"))
    rows = []
    for e in grouped.sort_values(["start_idx", "fixture"]).itertuples():
        if rng.random() < miss:
            continue
        rounded = lambda s: round((s + rng.normal(0, jitter_s)) / resolution_s) * resolution_s
        start, end = rounded(e.start_idx), rounded(e.end_idx)
        if end < start or e.end_idx - e.start_idx < resolution_s:
            end = start + (resolution_s if rng.random() < 0.35 else 0)
        stamp = lambda s: (spec.start + timedelta(seconds=int(s)))
        clock = lambda t: t.strftime("%I:%M:%S %p").lstrip("0")
        rows.append((e.fixture, stamp(start).strftime("%Y-%m-%d"), clock(stamp(start)), clock(stamp(end)), int(e.start_idx)))
    return pd.DataFrame(rows, columns=["fixture", "date", "start_time", "end_time", "true_start_idx"])
