"""The event stream as a multi-fixture trace: type = fixture, time bucket = sample, value sum (in hundredths) = flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Fixture
from ..functions.signal import epoch_seconds, from_seconds
from ..operators.segment import event_stats, segment

WIDTH = 600
ON, OFF, GAP, LEAST = 5000.0, 2500.0, 2, 2
ON_B, OFF_B = 8000.0, 4000.0
CLASSES = {"click": "browse", "view": "browse", "purchase": "commit", "signup": "commit", "error": "fault"}
CONFIG = Config(
    fixtures=tuple(
        Fixture(code, code.title(), CLASSES[code], rate, code[:2], code[-1].upper(), 1200.0, 1200.0)
        for code, rate in (("click", 8000.0), ("error", 7000.0), ("purchase", 8400.0), ("signup", 9000.0), ("view", 8100.0))
    ),
    period_s=WIDTH,
    noise_floor=2500.0,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """fixture, idx, ts, flow, valid on one grid for all fixtures; sums of whole hundredths are exact in any order."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("fixture"), F.floor(epoch_seconds("ts") / width).alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents")
    )
    sums = raw.groupBy("fixture", "k").agg(F.sum("cents").cast("double").alias("flow"))
    first, last = raw.agg(F.min("k"), F.max("k")).first()
    first, last = (0, -1) if first is None else (first, last)
    grid = spark.range(0, last - first + 1).select(
        F.explode(F.array(*map(F.lit, CONFIG.codes))).alias("fixture"), F.col("id").alias("idx"), (F.col("id") + first).alias("k")
    )
    joined = grid.join(sums, ["fixture", "k"], "left").withColumn("sec", F.col("k") * width)
    return joined.select("fixture", "idx", from_seconds("sec").alias("ts"), F.coalesce("flow", F.lit(0.0)).alias("flow"), F.col("flow").isNotNull().alias("valid"))


def first_second(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> int:
    found = table(spark, sf_dir, "events").agg(F.min(F.floor(epoch_seconds("ts") / width)) * width).first()[0]
    return found or 0


def total(rows: DataFrame) -> DataFrame:
    """The summed trace: idx, ts, flow, valid (any fixture)."""
    return rows.groupBy("idx", "ts").agg(F.sum("flow").alias("flow"), F.bool_or("valid").alias("valid"))


def events(rows: DataFrame, on: float = ON, off: float = OFF, stats: bool = False, width: int = WIDTH) -> DataFrame:
    found = segment(rows, on, off, LEAST, GAP, ["fixture"])
    return event_stats(found, rows, ["fixture"], width) if stats else found


def predicted(rows: DataFrame, on: float = ON, off: float = OFF) -> DataFrame:
    """Flows inside the events of a threshold setting, 0 elsewhere: one side of a scoring query."""
    from ..operators.segment import samples_of

    inside = samples_of(events(rows, on, off).select("fixture", "start_idx", "end_idx"), rows, ["fixture"]).select("fixture", "idx", F.lit(True).alias("inside"))
    joined = rows.join(inside, ["fixture", "idx"], "left")
    return joined.select("fixture", "idx", "ts", F.when(F.col("inside"), F.col("flow")).otherwise(F.lit(0.0)).alias("flow"), "valid")
