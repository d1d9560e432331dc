"""Fixture rates, thresholds and their separability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from .intervals import isolated
from .segment import plateau, samples_of

RISK_GAP = 0.08


def fixture_table(spark: SparkSession, config: Config) -> DataFrame:
    rows = [
        (i, f.code, f.label or f.code, f.category, f.rate, f.page, f.symbol, f.min_duration_s, f.bridge_gap_s, f.on_frac, f.off_frac)
        for i, f in enumerate(config.fixtures)
    ]
    schema = "ord int, fixture string, label string, category string, rate double, page string, symbol string, min_s double, bridge_s double, on_frac double, off_frac double"
    return spark.createDataFrame(rows, schema)


def fit_rates(events: DataFrame, samples: DataFrame, fixtures: DataFrame, min_events: int = 3) -> DataFrame:
    """fixture, rate, n_isolated, iqr, note from plateaus of events that overlap no other one.

    ``events`` has fixture, start_idx, end_idx; ``samples`` the total flow.
    Plateaus take the sample at the exclusive end along. Fixtures with fewer
    than ``min_events`` plateaus keep their configured rate.
    """
    alone = isolated(events, tie=("fixture",))
    inside = samples_of(alone.select("fixture", "start_idx", "end_idx"), samples, [], inclusive=True)
    found = plateau(inside, ["fixture", "start_idx", "end_idx"]).filter("plateau > 0")
    fit = found.groupBy("fixture").agg(
        F.count("*").alias("n_isolated"), F.median("plateau").alias("median"), (F.percentile("plateau", 0.75) - F.percentile("plateau", 0.25)).alias("spread")
    )
    joined = fixtures.select("fixture", F.col("rate").alias("configured")).join(fit, "fixture", "left")
    enough = F.coalesce(F.col("n_isolated") >= min_events, F.lit(False))
    return joined.select(
        "fixture",
        F.when(enough, F.col("median")).otherwise(F.col("configured")).alias("rate"),
        F.coalesce("n_isolated", F.lit(0)).cast("long").alias("n_isolated"),
        F.when(enough, F.col("spread")).alias("iqr"),
        F.when(enough, "fitted").otherwise("configured").alias("note"),
    )


def separability(rates: DataFrame, min_ratio: float = RISK_GAP) -> DataFrame:
    """Relative rate gaps of all unordered fixture pairs; a fixture list is configuration-sized. Below two rates: no rows."""
    known = rates.filter("rate IS NOT NULL").select("fixture", "rate")
    listed = known.agg(F.array_sort(F.collect_list(F.struct("fixture", "rate"))).alias("all"))
    pairs = listed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter("a.fixture < b.fixture")
    gap = F.abs(F.col("a.rate") - F.col("b.rate")) / F.greatest("a.rate", "b.rate")
    return pairs.select(F.col("a.fixture").alias("first"), F.col("b.fixture").alias("second"), gap.alias("gap"), (gap < min_ratio).alias("at_risk"))


def thresholds(rates: DataFrame, fixtures: DataFrame, on_frac: float, off_frac: float, period_s: float) -> DataFrame:
    """fixture, on, off, min_samples, max_gap of the fixtures that have a rate."""
    local = rates.select("fixture", "rate").join(fixtures.drop("rate"), "fixture").filter("rate IS NOT NULL")
    return local.select(
        "fixture",
        (F.col("rate") * F.coalesce("on_frac", F.lit(on_frac))).alias("on"),
        (F.col("rate") * F.coalesce("off_frac", F.lit(off_frac))).alias("off"),
        F.bround(F.col("min_s") / period_s, 0).cast("int").alias("min_samples"),
        F.bround(F.col("bridge_s") / period_s, 0).cast("int").alias("max_gap"),
    )


def rate_report(fitted: DataFrame) -> DataFrame:
    """The fitted rates as shown: rounded to three places."""
    return fitted.select("fixture", F.round("rate", 3).alias("rate"), "n_isolated", F.round("iqr", 3).alias("iqr"), "note")


def fixture_class(code):
    """Column: the class that a fixture code tells by its suffix or name."""
    appliance = code.isin("Dish_W", "Wash_M")
    return F.when(code.endswith("_S"), "shower").when(code.endswith("_T"), "toilet").when(appliance, "appliance").otherwise("faucet")
