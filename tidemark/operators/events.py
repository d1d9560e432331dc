"""Events from predicted flows: assembly, enrichment, threshold search, scoring matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import day_of, day_type, from_seconds, hours_of_day
from .intervals import iou, mutual_best, overlap_join
from .segment import event_stats, samples_of, segment

FRACTIONS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def enrich(events: DataFrame, first_second: int, period_s: int, with_seconds: bool = True) -> DataFrame:
    """Calendar columns of an event: start, end, date, time_of_day_h, day_type, duration_s, duration_min."""
    named = events.withColumn("ev_s", F.col("start_idx") * period_s + F.lit(first_second)).withColumn("ev_e", F.col("end_idx") * period_s + F.lit(first_second))
    named = named.withColumn("start", from_seconds("ev_s")).withColumn("end", from_seconds("ev_e")).drop("ev_s", "ev_e")
    length = (F.col("end_idx") - F.col("start_idx")) * period_s
    return named.withColumns(
        {
            "date": day_of("start"),
            "time_of_day_h": hours_of_day("start", with_seconds),
            "day_type": day_type("start"),
            "duration_s": length,
            "duration_min": length / F.lit(60.0),
        }
    )


def share_of_measured(events: DataFrame, total: DataFrame, period_s: float) -> DataFrame:
    """``events`` with share_of_measured: volume over the clipped total of the event's slice, its end included; null where that is not positive."""
    clipped = total.withColumn("flow", F.greatest("flow", F.lit(0.0)))
    ident = [c for c in ("fixture", "start_idx", "end_idx") if c in events.columns]
    held = samples_of(events.select(*ident), clipped, [], inclusive=True).groupBy(*ident).agg((F.sum("s_flow") * period_s / 60).alias("sm_total"))
    joined = events.join(held, ident, "left")
    return joined.withColumn("share_of_measured", F.when(F.col("sm_total") > 0, F.col("volume") / F.col("sm_total"))).drop("sm_total")


def assemble(predictions: DataFrame, limits: DataFrame, period_s: float, total: DataFrame | None = None) -> DataFrame:
    """Events of each fixture that has thresholds: segmentation, statistics and share of the measured flow."""
    from pyspark.sql.functions import broadcast

    ready = predictions.join(broadcast(limits), "fixture")  # as many rows as configured fixtures
    found = segment(ready, F.col("on"), F.col("off"), 1, F.lit(0), ["fixture"], use_valid="valid" in predictions.columns)
    # durations differ by fixture: bridge again under the fixture's own gap, then drop what is short
    from .segment import bridge

    joined = bridge(found.drop("n_runs").join(broadcast(limits.select("fixture", "max_gap", "min_samples")), "fixture"), F.col("max_gap"), ["fixture"])
    kept = joined.join(broadcast(limits.select("fixture", "min_samples")), "fixture").filter(F.col("end_idx") - F.col("start_idx") >= F.greatest("min_samples", F.lit(1)))
    events = event_stats(kept.drop("min_samples"), predictions, ["fixture"], period_s)
    return share_of_measured(events, total, period_s) if total is not None else events


def stagnation(events: DataFrame, period_s: float) -> DataFrame:
    """fixture, start_idx, hours since the end of the fixture's event before; first events fall out."""
    order = Window.partitionBy("fixture").orderBy("start_idx", "end_idx")
    hours = (F.col("start_idx") - F.lag("end_idx").over(order)) * F.lit(period_s) / F.lit(3600.0)
    return events.select("fixture", "start_idx", hours.alias("hours")).filter("hours IS NOT NULL")


def match_pairs(pred: DataFrame, lab: DataFrame, min_iou: float = 0.5, key: tuple[str, ...] = ("fixture",)) -> DataFrame:
    """One-to-one pairs with iou >= min_iou, greedy by descending iou."""
    pairs = iou(overlap_join(pred, lab, list(key))).filter(F.col("iou") >= min_iou)
    return mutual_best(pairs, [*key, "l_start_idx", *(["l_fixture"] if not key else [])], [*key, "r_start_idx", *(["r_fixture"] if not key else [])], "iou")


def match_counts(pred: DataFrame, lab: DataFrame, pairs: DataFrame) -> DataFrame:
    """fixture, tp, fp, fn, n_labelled."""
    tp = pairs.groupBy("fixture").agg(F.count("*").alias("tp"), F.median("iou").alias("median_iou"))
    p = pred.groupBy("fixture").agg(F.count("*").alias("n_pred"))
    n = lab.groupBy("fixture").agg(F.count("*").alias("n_labelled"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = n.join(p, "fixture", "full").join(tp, "fixture", "left")
    return joined.select(
        "fixture", zero("tp").alias("tp"), (zero("n_pred") - zero("tp")).alias("fp"), (zero("n_labelled") - zero("tp")).alias("fn"), zero("n_labelled").alias("n_labelled"), "median_iou"
    )


def search_thresholds(predictions: DataFrame, labelled: DataFrame, rates: DataFrame, off_ratio: float, min_samples: int, max_gap: int, fractions=FRACTIONS, min_iou: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(search table, best) over all fixtures and fractions in one plan; the first of equal scores wins."""
    grid = predictions.join(F.broadcast(rates.select("fixture", "rate")), "fixture").withColumn("frac", F.explode(F.array(*map(F.lit, fractions))))
    found = segment(grid, F.col("rate") * F.col("frac"), F.col("rate") * F.col("frac") * off_ratio, min_samples, max_gap, ["fixture", "frac"], use_valid="valid" in predictions.columns)
    truth = labelled.select("fixture", "start_idx", "end_idx").withColumn("frac", F.explode(F.array(*map(F.lit, fractions))))
    pairs = match_pairs(found.select("fixture", "frac", "start_idx", "end_idx"), truth, min_iou, ("fixture", "frac"))
    tp = pairs.groupBy("fixture", "frac").agg(F.count("*").alias("tp"))
    n = found.groupBy("fixture", "frac").agg(F.count("*").alias("n_pred"))
    t = truth.groupBy("fixture", "frac").agg(F.count("*").alias("n_labelled"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    table = t.join(n, ["fixture", "frac"], "left").join(tp, ["fixture", "frac"], "left").select("fixture", "frac", zero("tp"), zero("n_pred"), "n_labelled")
    table = table.withColumn("f1", 2 * F.col("tp") / (F.col("n_pred") + F.col("n_labelled")))
    best = table.withColumn("st_n", F.row_number().over(Window.partitionBy("fixture").orderBy(F.desc("f1"), "frac"))).filter("st_n = 1").drop("st_n")
    return table, best


def with_fallback(best: DataFrame, rates: DataFrame, configured: float) -> DataFrame:
    """fixture, rate, on, frac, f1, note of every fixture with a rate; those without labelled events keep their configured fraction."""
    own = F.coalesce(F.col("on_frac"), F.lit(configured)) if "on_frac" in rates.columns else F.lit(configured)
    joined = rates.filter("rate IS NOT NULL").select("fixture", "rate", own.alias("own")).join(best.select("fixture", "frac", "f1"), "fixture", "left")
    note = F.when(F.col("frac").isNull(), "no labelled events: configured fraction").otherwise("")
    frac = F.coalesce("frac", "own")
    return joined.select("fixture", "rate", (F.col("rate") * frac).alias("on"), frac.alias("frac"), "f1", note.alias("note"))


def threshold_report(fitted: DataFrame) -> DataFrame:
    """The fitted thresholds as shown: rounded to three places."""
    return fitted.select("fixture", *(F.round(c, 3).alias(c) for c in ("rate", "on", "frac", "f1")), "note")


def event_frame(events: DataFrame) -> DataFrame:
    """Events with the columns and types of an event table, by start, then fixture; columns that are missing are null."""
    kinds = {"fixture": "string", "start_idx": "long", "end_idx": "long", "duration_s": "double", "mean": "double", "peak": "double", "plateau": "double", "volume": "double"}
    columns = [(F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return events.select(*columns).orderBy("start_idx", "fixture")
