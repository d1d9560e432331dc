"""Scores of predicted against labelled events, volumes and samples; LaTeX export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import day_of
from .events import match_counts, match_pairs


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall (null where undefined) and f1 (then 0)."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.coalesce(F.when(p + r > 0, 2 * p * r / (p + r)), F.lit(0.0))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def event_metrics(pred: DataFrame, lab: DataFrame, min_iou: float = 0.5) -> DataFrame:
    return with_scores(match_counts(pred, lab, match_pairs(pred, lab, min_iou, ("fixture",))))


def detection_counts(pred: DataFrame, lab: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """tp, fp, fn with fixtures ignored."""
    one = lambda df: df.select(F.lit("any").alias("fixture"), F.col("fixture").alias("of"), "start_idx", "end_idx")
    return with_scores(match_counts(one(pred), one(lab), match_detection(one(pred), one(lab), min_iou))).drop("fixture")


def match_detection(pred: DataFrame, lab: DataFrame, min_iou: float) -> DataFrame:
    from .intervals import iou, mutual_best, overlap_join

    pairs = iou(overlap_join(pred, lab, ["fixture"])).filter(F.col("iou") >= min_iou)
    return mutual_best(pairs, ["l_start_idx", "l_of"], ["r_start_idx", "r_of"], "iou")


def class_metrics(pred: DataFrame, lab: DataFrame, classes: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Scores after relabelling to categories and matching anew (events of a class may overlap)."""
    relabel = lambda df: df.join(F.broadcast(classes), "fixture", "left").select(F.coalesce("category", F.lit("other")).alias("fixture"), F.col("fixture").alias("of"), "start_idx", "end_idx")
    from .intervals import iou, mutual_best, overlap_join

    p, t = relabel(pred), relabel(lab)
    pairs = iou(overlap_join(p, t, ["fixture"])).filter(F.col("iou") >= min_iou)
    best = mutual_best(pairs, ["fixture", "l_start_idx", "l_of"], ["fixture", "r_start_idx", "r_of"], "iou")
    return with_scores(match_counts(p, t, best)).withColumnRenamed("fixture", "category")


def volume_metrics(pred: DataFrame, lab: DataFrame, period_s: float, days: DataFrame | None = None) -> DataFrame:
    """fixture, mae, bias, n_days of daily volumes; ``pred`` and ``lab`` are long flows (fixture, ts, flow)."""
    both = pred.select("fixture", "ts", F.col("flow").alias("p")).join(lab.select("fixture", "ts", F.col("flow").alias("t")), ["fixture", "ts"])
    daily = both.groupBy("fixture", day_of("ts").alias("day")).agg((F.sum("p") * period_s / 60).alias("p"), (F.sum("t") * period_s / 60).alias("t"))
    if days is not None:
        daily = daily.join(days.select("day"), "day", "left_semi")
    return daily.groupBy("fixture").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), F.avg(F.col("p") - F.col("t")).alias("bias"), F.count("*").alias("n_days"))


def sample_metrics(pred: DataFrame, lab: DataFrame, floor: float, valid: DataFrame | None = None) -> DataFrame:
    """fixture, mae where any fixture flows, mae_active where this one does, n of the latter."""
    both = pred.select("fixture", "ts", F.col("flow").alias("p")).join(lab.select("fixture", "ts", F.col("flow").alias("t")), ["fixture", "ts"])
    if valid is not None:
        both = both.join(valid.filter("valid").select("ts"), "ts", "left_semi")
    total = F.sum("t").over(Window.partitionBy("ts"))
    busy = both.withColumn("sm_total", total).filter(F.col("sm_total") > floor)
    error = F.abs(F.col("p") - F.col("t"))
    active = F.col("t") > floor
    return busy.groupBy("fixture").agg(F.avg(error).alias("mae"), F.avg(F.when(active, error)).alias("mae_active"), F.count_if(active).alias("n_active"))


def confusion(pred: DataFrame, lab: DataFrame, fixtures: DataFrame, floor: float) -> DataFrame:
    """true, predicted, share: samples with exactly one active label against the greatest prediction (ties and zeros: first in order)."""
    both = pred.select("fixture", "ts", F.col("flow").alias("p")).join(lab.select("fixture", "ts", F.col("flow").alias("t")), ["fixture", "ts"])
    both = both.join(F.broadcast(fixtures.select("fixture", "ord")), "fixture")
    at = both.groupBy("ts").agg(
        F.count_if(F.col("t") > floor).alias("n"),
        F.max(F.when(F.col("t") > floor, F.col("fixture"))).alias("true"),
        F.max_by("fixture", F.struct("p", (-F.col("ord")).alias("o"))).alias("predicted"),
    ).filter("n = 1")
    counts = at.groupBy("true", "predicted").agg(F.count("*").alias("n"))
    listed = fixtures.agg(F.collect_list("fixture").alias("all")).select(F.explode("all").alias("true"), "all").select("true", F.explode("all").alias("predicted"))
    full = listed.join(counts, ["true", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("true"))
    return full.withColumn("cf_t", total).select("true", "predicted", F.when(F.col("cf_t") > 0, F.col("n") / F.col("cf_t")).otherwise(F.lit(0.0)).alias("share"))


@dataclass
class Evaluation:
    """Tables of one evaluation; :meth:`save` writes them as CSV folders."""

    per_fixture: DataFrame
    by_class: DataFrame
    detection: DataFrame
    confusion: DataFrame

    def save(self, folder: str) -> None:
        for name in ("per_fixture", "by_class", "detection", "confusion"):
            getattr(self, name).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

    def report(self) -> str:
        rows = self.per_fixture.orderBy("fixture").collect()
        return "\n".join(f"{r.fixture:<12} tp {r.tp:>5} fp {r.fp:>5} fn {r.fn:>5} f1 {r.f1:.3f}" for r in rows)


def evaluate(pred_events, lab_events, pred_flow, lab_flow, fixtures: DataFrame, period_s: float, floor: float, days=None, valid=None, min_iou: float = 0.5, min_events: int = 3, restrict_all: bool = False) -> Evaluation:
    """All scores. ``days`` limits events and volumes, and samples too with ``restrict_all``."""
    if days is not None:
        keep = lambda df, c: df.join(days.select(F.col("day").alias(c)), c, "left_semi")
        pred_events, lab_events = keep(pred_events, "date"), keep(lab_events, "date")
        if restrict_all:
            slim = lambda df: df.withColumn("ed", day_of("ts")).join(days.select(F.col("day").alias("ed")), "ed", "left_semi").drop("ed")
            pred_flow, lab_flow = slim(pred_flow), slim(lab_flow)
    cols = ["fixture", "start_idx", "end_idx"]
    p, t = pred_events.select(*cols), lab_events.select(*cols)
    per = event_metrics(p, t, min_iou)
    per = per.join(volume_metrics(pred_flow, lab_flow, period_s, days).withColumnRenamed("mae", "volume_mae").withColumnRenamed("bias", "volume_bias"), "fixture", "full")
    per = per.join(sample_metrics(pred_flow, lab_flow, floor, valid), "fixture", "full")
    per = per.withColumn("sufficient_support", F.coalesce(F.col("n_labelled") >= min_events, F.lit(False)))
    named = per.join(F.broadcast(fixtures.select("fixture", "label", "category")), "fixture", "left").withColumn("category", F.coalesce("category", F.lit("other")))
    return Evaluation(named, class_metrics(p, t, fixtures.select("fixture", "category"), min_iou), detection_counts(p, t, min_iou), confusion(pred_flow, lab_flow, fixtures, floor))


_LATEX = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def escape_latex(text: str) -> str:
    return str(text).translate(_LATEX)


def latex_table(rows: list[dict], caption: str, label: str, category_order: tuple[str, ...] = (), classes: list[dict] | None = None, order: tuple[str, ...] | None = None) -> str:
    """A table of per-fixture scores by category, or by fixture code in ``order``, with a block of ``classes`` below; missing values are dashes, thin support has a dagger."""
    rank = {c: i for i, c in enumerate(category_order)}
    named = lambda r: str(r.get("label") or r["fixture"])
    if order is None:
        ordered = sorted(rows, key=lambda r: (rank.get(r.get("category"), len(rank)), named(r)))
    else:
        place = {c: i for i, c in enumerate(order)}
        ordered = sorted(rows, key=lambda r: (place.get(r["fixture"], len(place)), named(r)))
    number = lambda x: "---" if x is None else f"{x:.2f}"

    def line(name: str, r: dict) -> str:
        return " & ".join([name, str(r.get("n_labelled") or 0), number(r.get("precision")), number(r.get("recall")), number(r.get("f1")), number(r.get("volume_mae"))]) + r" \\"

    body = [line(escape_latex(named(r)) + ("" if r.get("sufficient_support", True) else r"$^\dagger$"), r) for r in ordered]
    if classes:
        body.append(r"\midrule")
        body += [line(rf"\textit{{{escape_latex(r['category'])}}}", r) for r in sorted(classes, key=lambda r: (rank.get(r["category"], len(rank)), r["category"]))]
    head = [r"\begin{table}", r"\centering", rf"\caption{{{escape_latex(caption)}}}", rf"\label{{{label}}}", r"\begin{tabular}{lrrrrr}", r"\toprule", r"Fixture & $n$ & P & R & F1 & Vol. MAE \\", r"\midrule"]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
