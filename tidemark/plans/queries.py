"""One query per operator group over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signal import day_of, day_type, epoch_seconds, one_pole
from ..operators import allocate, intervals, labels, matching, metrics, rates, segment, trace, windows
from ..operators import events as ev
from ..sources.readers import resolve_diary, stamp
from . import adaptor as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = ["fixture"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register ``f``; its result shows dates as text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    QUERIES[f.__name__] = run
    return f


def ident(df: DataFrame) -> DataFrame:
    return df.select("fixture", "start_idx", "end_idx")


@query
def regularise(spark, d):
    return ad.samples(spark, d)


@query
def regularise_users(spark, d):
    """Readings on a minute grid from the first one: what lies off the grid falls out."""
    raw = ad.table(spark, d, "events").select("ts", F.round(F.col("value") * 100).alias("flow"))
    return trace.regularise(raw, 60).groupBy(day_of("ts").alias("day")).agg(F.count("*").alias("samples"), F.count_if("valid").alias("observed"), F.sum("flow").alias("flow"))


@query
def deadband(spark, d):
    return trace.deadbanded(ad.samples(spark, d), 2500.0).groupBy("fixture").agg(F.sum("flow").alias("flow"), F.count_if(F.col("flow") > 0).alias("above"))


@query
def trace_volume(spark, d):
    return trace.volume(ad.total(ad.samples(spark, d)), ad.WIDTH, 2500.0)


@query
def trace_summary(spark, d):
    return trace.summary(ad.total(ad.samples(spark, d)), ad.WIDTH, 2500.0)


@query
def null_skipping_merge(spark, d):
    raw = ad.table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "user_id", F.round(F.col("value") * 100).alias("c"))
    rows = raw.select("ts", F.when(F.col("user_id") % 2 == 0, F.col("c")).alias("even"), F.when(F.col("user_id") % 2 == 1, F.col("c")).alias("odd"))
    return trace.merge_readings(rows, ["even", "odd"])


@query
def mean_of_means(spark, d):
    rows = ad.table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 2).alias("source"), F.round(F.col("value") * 100).alias("flow"))
    return trace.merge_readings(rows, ["flow"], "source")


@query
def tz_shift_days(spark, d):
    shifted = trace.shift_timezone(ad.table(spark, d, "events").select("ts"), -5)
    return shifted.groupBy(day_of("ts").alias("day")).agg(F.count("*").alias("n"))


@query
def one_day(spark, d):
    return trace.one_day(ad.samples(spark, d), "2024-01-10").groupBy("fixture").agg(F.count("*").alias("n"), F.sum("flow").alias("flow"))


@query
def local_days(spark, d):
    return trace.local_days(ad.samples(spark, d))


@query
def hysteresis(spark, d):
    return segment.hysteresis(ad.samples(spark, d), ad.ON, ad.OFF, KEY).select("fixture", "idx", "active")


@query
def runs(spark, d):
    marked = segment.hysteresis(ad.samples(spark, d), ad.ON, ad.OFF, KEY).withColumn("active", F.col("active") & F.col("valid"))
    return ident(segment.bridge(segment.runs(marked, KEY), 0, KEY))


@query
def bridge(spark, d):
    marked = segment.hysteresis(ad.samples(spark, d), ad.ON, ad.OFF, KEY).withColumn("active", F.col("active") & F.col("valid"))
    return segment.bridge(segment.runs(marked, KEY), ad.GAP, KEY).select("fixture", "start_idx", "end_idx", "n_runs")


@query
def segment_events(spark, d):
    return ad.events(ad.samples(spark, d), stats=True).select("fixture", "start_idx", "end_idx", "n_runs", "n", "mean", "peak", "volume")


@query
def segment_total(spark, d):
    """Absolute thresholds on the dead-banded total."""
    rows = trace.deadbanded(ad.total(ad.samples(spark, d)).withColumn("fixture", F.lit("all")), 2500.0)
    return segment.segment(rows, 20000.0, 10000.0, 2, 1, KEY).select("start_idx", "end_idx")


@query
def events_from_matrix(spark, d):
    """Events of a label matrix: on at the floor, off at half of it, validity ignored."""
    rows = ad.predicted(ad.samples(spark, d))
    return ident(segment.segment(rows, 5000.0, 2500.0, 2, 2, KEY, use_valid=False))


@query
def plateau(spark, d):
    rows = ad.samples(spark, d)
    found = ident(ad.events(rows))
    return segment.plateau(segment.samples_of(found, rows, KEY), [*KEY, "start_idx", "end_idx"])


@query
def event_enrich(spark, d):
    found = ev.enrich(ident(ad.events(ad.samples(spark, d))), ad.first_second(spark, d), ad.WIDTH)
    return found.select("fixture", "start_idx", "start", "end", F.col("date").cast("string").alias("date"), "time_of_day_h", "day_type", "duration_s", "duration_min")


@query
def isolated_events(spark, d):
    return ident(intervals.isolated(ident(ad.events(ad.samples(spark, d))), tie=("fixture",)))


@query
def fit_rates(spark, d):
    rows = ad.samples(spark, d)
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    return rates.fit_rates(ident(ad.events(rows)), trace.deadbanded(ad.total(rows), 2500.0), fixtures, 3)


@query
def separability(spark, d):
    return rates.separability(rates.fixture_table(spark, ad.CONFIG))


@query
def thresholds(spark, d):
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    return rates.thresholds(fixtures.select("fixture", "rate"), fixtures, 0.5, 0.25, ad.WIDTH)


@query
def assemble_events(spark, d):
    rows = ad.samples(spark, d)
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    limits = rates.thresholds(fixtures.select("fixture", "rate"), fixtures, 0.5, 0.25, ad.WIDTH)
    return ev.assemble(rows, limits, ad.WIDTH).select("fixture", "start_idx", "end_idx", "n", "peak", "volume")


@query
def merge_close(spark, d):
    found = ad.events(ad.samples(spark, d), stats=True).select("fixture", "start_idx", "end_idx", "volume", "peak", "mean")
    return intervals.merge_close(found, 6, KEY)


@query
def stagnation(spark, d):
    return ev.stagnation(ident(ad.events(ad.samples(spark, d))), ad.WIDTH)


@query
def stagnation_summary(spark, d):
    found = ev.stagnation(ident(ad.events(ad.samples(spark, d))), ad.WIDTH)
    return found.groupBy("fixture").agg(F.count("*").alias("n"), F.median("hours").alias("median_h"), (F.count_if(F.col("hours") < 1) / F.count("*")).alias("below_1h"))


@query
def share_of_measured(spark, d):
    rows = ad.samples(spark, d)
    return ev.share_of_measured(ad.events(rows, stats=True), ad.total(rows), ad.WIDTH).select("fixture", "start_idx", "end_idx", "share_of_measured")


def two_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = ad.samples(spark, d)
    return ident(ad.events(rows)), ident(ad.events(rows, ad.ON_B, ad.OFF_B))


@query
def iou_pairs(spark, d):
    a, b = two_sides(spark, d)
    return intervals.iou(intervals.overlap_join(a, b, KEY))


@query
def match_counts(spark, d):
    a, b = two_sides(spark, d)
    return ev.match_counts(a, b, ev.match_pairs(a, b, 0.6)).drop("median_iou")


@query
def event_metrics(spark, d):
    a, b = two_sides(spark, d)
    return metrics.event_metrics(a, b, 0.6)


@query
def detection_only(spark, d):
    a, b = two_sides(spark, d)
    return metrics.detection_counts(a, b, 0.5).drop("median_iou")


@query
def class_metrics(spark, d):
    a, b = two_sides(spark, d)
    return metrics.class_metrics(a, b, rates.fixture_table(spark, ad.CONFIG).select("fixture", "category"), 0.5)


@query
def threshold_search(spark, d):
    rows = ad.samples(spark, d)
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    found, _ = ev.search_thresholds(rows, ident(ad.events(rows, ad.ON_B, ad.OFF_B)), fixtures, 0.5, 2, 2, (0.5, 0.75, 1.0, 1.25), 0.6)
    return found


@query
def threshold_best(spark, d):
    rows = ad.samples(spark, d)
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    return ev.search_thresholds(rows, ident(ad.events(rows, ad.ON_B, ad.OFF_B)), fixtures, 0.5, 2, 2, (0.5, 0.75, 1.0, 1.25), 0.6)[1].select("fixture", "frac", "f1")


def two_flows(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = ad.samples(spark, d)
    return ad.predicted(rows), ad.predicted(rows, ad.ON_B, ad.OFF_B)


@query
def daily_volume(spark, d):
    flows = ad.predicted(ad.samples(spark, d))
    return flows.groupBy("fixture", day_of("ts").alias("day")).agg((F.sum("flow") * ad.WIDTH / 60).alias("volume"))


@query
def volume_by_fixture(spark, d):
    return labels.summary(ad.predicted(ad.samples(spark, d)), 2500.0, ad.WIDTH)


@query
def volume_mae(spark, d):
    return metrics.volume_metrics(*two_flows(spark, d), ad.WIDTH)


@query
def sample_mae(spark, d):
    return metrics.sample_metrics(*two_flows(spark, d), 2500.0)


@query
def confusion(spark, d):
    return metrics.confusion(*two_flows(spark, d), rates.fixture_table(spark, ad.CONFIG), 2500.0)


@query
def concurrency(spark, d):
    return labels.concurrency(ad.predicted(ad.samples(spark, d)), 2500.0)


@query
def active_mask(spark, d):
    return labels.active_mask(ad.predicted(ad.samples(spark, d)), 2500.0).groupBy("active").agg(F.count("*").alias("n"))


@query
def labelled_days(spark, d):
    return labels.active_days(ad.predicted(ad.samples(spark, d)), 12000.0)


@query
def proportional_labels(spark, d):
    rows = ad.samples(spark, d)
    built = labels.build_labels(ad.total(rows), ident(ad.events(rows)), rates.fixture_table(spark, ad.CONFIG))
    return built.select("fixture", "idx", "flow")


@query
def label_pivot(spark, d):
    return labels.widen(ad.predicted(ad.samples(spark, d)), ad.CONFIG.codes).drop("ts")


@query
def window_counts(spark, d):
    rows = ad.total(ad.samples(spark, d)).withColumn("label", F.col("flow"))
    found = windows.make_windows(rows, 12, 3, trace.local_days(rows), None, arrays=False)
    return found.groupBy("first_day").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


@query
def window_activity(spark, d):
    rows = ad.total(ad.samples(spark, d)).withColumn("label", F.col("flow"))
    return windows.make_windows(rows, 12, 3, None, 30000.0, arrays=False).select("start", "ts", "any_active")


@query
def window_arrays(spark, d):
    rows = ad.total(ad.samples(spark, d))
    found = windows.make_windows(rows, 12, 6)
    return found.select("start", F.element_at("x", 1).alias("x_first"), F.element_at("x", -1).alias("x_last"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("x_sum"), F.size(F.filter("valid", lambda v: v)).alias("n_valid"))


@query
def window_event_counts(spark, d):
    rows = ad.samples(spark, d)
    made = windows.make_windows(ad.total(rows), 12, 3, arrays=False)
    return windows.event_counts(made, ad.predicted(rows), 12, 3, 2500.0)


@query
def tile_owner(spark, d):
    rows = ad.total(ad.samples(spark, d))
    owned = windows.tile_owner(rows.select("idx"), rows.count(), 60, 15)
    return owned.select("idx", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("owner", "position")))


@query
def partition_sizes(spark, d):
    days = trace.local_days(ad.samples(spark, d)).select(F.col("day"), day_type("day").alias("day_type"))
    return days.groupBy("day_type").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first"))


@query
def partition_days(spark, d):
    days = [r.day for r in trace.local_days(ad.samples(spark, d)).collect()]
    parts = windows.partition_days(days, 0.2, 0.15, 3, 2, ad.CONFIG.seed)
    return spark.createDataFrame([(x, part) for part, xs in parts.items() for x in xs], "day date, part string")


@query
def part_sizes(spark, d):
    """Sizes of the parts of 1 to 60 days, for two settings."""
    rows = [(n, f, *windows.part_sizes(n, f, f - 0.05, 3, 2)) for n in range(1, 61) for f in (0.2, 0.35)]
    return spark.createDataFrame(rows, "n int, fraction double, n_test int, n_val int")


def parts_by_date(days: DataFrame) -> DataFrame:
    part = F.when(F.dayofmonth("day") <= 18, "train").when(F.dayofmonth("day") <= 22, "val").when(F.dayofmonth("day") <= 26, "test")
    return days.select("day", part.alias("part")).filter("part IS NOT NULL")


@query
def partition_windows(spark, d):
    rows = ad.total(ad.samples(spark, d))
    made = windows.build_partitions(rows, parts_by_date(trace.local_days(rows)), 12, 3, arrays=False)
    return made.groupBy("part", "first_day").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


@query
def partition_table(spark, d):
    return windows.partition_summary(parts_by_date(trace.local_days(ad.samples(spark, d)))).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query
def window_totals(spark, d):
    rows = ad.total(ad.samples(spark, d)).withColumn("label", F.col("flow"))
    return windows.window_summary(windows.make_windows(rows, 12, 3, None, 30000.0, arrays=False))


@query
def window_thin_support(spark, d):
    rows = ad.samples(spark, d)
    made = windows.make_windows(ad.total(rows), 12, 3, arrays=False)
    counts = windows.event_counts(made, ad.predicted(rows), 12, 3, 2500.0)
    return windows.thin_support(counts, rates.fixture_table(spark, ad.CONFIG), 1000)


@query
def threshold_report(spark, d):
    """Fitted thresholds, one fixture without labelled events."""
    rows = ad.samples(spark, d)
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    truth = ident(ad.events(rows, ad.ON_B, ad.OFF_B)).filter("fixture <> 'view'")
    best = ev.search_thresholds(rows, truth, fixtures, 0.5, 2, 2, (0.5, 0.75, 1.0, 1.25), 0.6)[1]
    return ev.threshold_report(ev.with_fallback(best, fixtures, 0.5))


@query
def rate_report(spark, d):
    rows = ad.samples(spark, d)
    fixtures = rates.fixture_table(spark, ad.CONFIG)
    return rates.rate_report(rates.fit_rates(ident(ad.events(rows)), trace.deadbanded(ad.total(rows), 2500.0), fixtures, 3))


@query
def plain_rates(spark, d):
    return allocate.plain_rates(ad.samples(spark, d), 2500.0)


@query
def reconciliation(spark, d):
    rows = ad.samples(spark, d)
    found = allocate.reconcile(ad.predicted(rows), ad.total(rows), 2500.0)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query
def rate_allocation(spark, d):
    """Conservation of the rate rule: shares of a sample sum to one."""
    rows = ad.total(ad.samples(spark, d))
    found = allocate.rate_shares(rows, rates.fixture_table(spark, ad.CONFIG), 2000.0, 2500.0)
    return found.groupBy("idx").agg(F.sum("share").alias("s"), F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("samples"), F.count_if(F.abs(F.col("s") - 1) < 1e-9).alias("whole"))


@query
def lstm_alloc(spark, d):
    config = allocate.ModelConfig(n_fixtures=5, hidden=8, layers=1)
    rows = ad.total(ad.samples(spark, d)).withColumn("flow", F.col("flow") / 10000)
    made = windows.make_windows(rows, 60, 15)
    low, high = windows.slice_bounds(60, 15, "center")
    return allocate.predict_windows(made, allocate.random_weights(config), config, ad.CONFIG.codes, low, high)


def entries(spark, d) -> tuple[DataFrame, DataFrame]:
    raw = ad.table(spark, d, "events").withColumn("sec", epoch_seconds("ts"))
    diary = raw.filter("event_type = 'signup'").select(
        F.col("event_id").alias("entry"), (F.floor(F.col("sec") / 60) * 60).alias("start_idx"), F.lit(None).cast("long").alias("duration_s"), (F.col("user_id") % 10 == 0).alias("excluded"), (F.col("user_id") % 3).cast("string").alias("fixture")
    )
    events = raw.filter("event_type = 'purchase'").select(F.col("event_id").alias("candidate"), F.col("sec").alias("start_idx"), F.lit(60).cast("long").alias("duration_s"))
    return diary, events


@query
def nearest_match(spark, d):
    return matching.match_diary(*entries(spark, d), 300, 0.5, "nearest").select("entry", "candidate", "offset_s", "shared_candidate")


@query
def hungarian_match(spark, d):
    return matching.match_diary(*entries(spark, d), 300, 0.5).select("entry", "candidate", "offset_s", "shared_candidate")


@query
def match_report(spark, d):
    diary, events = entries(spark, d)
    return matching.match_report(diary, matching.match_diary(diary, events, 300, 0.5, "nearest"))


@query
def orphan_candidates(spark, d):
    diary, events = entries(spark, d)
    return matching.orphans(events, matching.match_diary(diary, events, 300, 0.5, "nearest")).select("candidate")


@query
def diary_parse(spark, d):
    raw = ad.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.ltrim(F.date_format("ts", "hh:mm:ss a"), F.lit("0")).alias("start_time"))
    return raw.select("event_id", stamp(F.concat_ws(" ", "date", "start_time"), "yyyy-MM-dd h:mm:ss a").alias("start"))


@query
def diary_lookup(spark, d):
    raw = ad.table(spark, d, "events").select(
        F.substring("event_type", 1, 2).alias("page"), F.when(F.col("user_id") % 7 == 0, "X").otherwise(F.upper(F.substring("event_type", -1, 1))).alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_datetime")
    )
    return resolve_diary(raw, ad.CONFIG).groupBy("fixture", "page", "symbol").agg(F.count("*").alias("n"))


@query
def unknown_codes(spark, d):
    raw = ad.table(spark, d, "events").select(F.substring("event_type", 1, 2).alias("page"), F.when(F.col("user_id") % 7 == 0, "X").otherwise(F.upper(F.substring("event_type", -1, 1))).alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_datetime"))
    return matching.unknown_codes(resolve_diary(raw, ad.CONFIG))


@query
def iir_response(spark, d):
    """The filter's last value over each fixture's day."""
    rows = ad.samples(spark, d).withColumn("day", day_of("ts"))
    held = rows.groupBy("fixture", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "flow"))), lambda s: s["flow"]).alias("x"))  # a day's samples
    return held.select("fixture", "day", F.element_at(one_pole(F.col("x"), 0.5), -1).alias("y"))


@query
def latex_table(spark, d):
    a, b = two_sides(spark, d)
    rows = [r.asDict() for r in metrics.event_metrics(a, b, 0.6).collect()]
    text = metrics.latex_table(rows, "Scores by fixture", "tab:scores")
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")
