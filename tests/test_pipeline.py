import numpy as np
import pandas as pd
import pytest
from datetime import date, datetime, timedelta
from pyspark.sql import functions as F

from tidemark import simulate as X
from tidemark.config import Config, Fixture, from_mapping
from tidemark.operators import allocate, events, labels, metrics, rates, trace, windows
from tidemark.operators.segment import segment
from tidemark.plans import oracle, queries
from tidemark.sources import readers, writers

SPEC = X.Spec(days=2, seed=5)
CONFIG = Config(fixtures=tuple(Fixture(u.code, rate=u.rate) for u in SPEC.uses))


@pytest.fixture(scope="module")
def house(spark):
    made = X.flows(spark, SPEC).cache()
    found = X.draw_events(SPEC)
    return made, found


def test_generator(spark, house):
    made, found = house
    assert made.count() == 2 * 86_400 and (found.end_idx > found.start_idx).all()
    assert X.draw_events(SPEC).equals(found)
    idle = made.filter("valid AND size(truth) = 0").agg(F.avg("flow").alias("m"), F.stddev("flow").alias("s")).first()
    assert abs(idle.m) < 0.05 and 0.01 < idle.s < 0.3
    y = X.one_pole(np.r_[np.zeros(5), np.ones(60)], 1.5, 4)
    assert 5 <= int((y > 0.95).argmax()) - 5 <= 20 and X.one_pole(np.ones(3), 0, 4).tolist() == [1, 1, 1]


def test_trace_round_trip(spark, house, tmp_path):
    made, _ = house
    writers.write_paired(made.select("idx", "ts", "flow", "valid"), f"{tmp_path}/trace")
    config = Config(fixtures=CONFIG.fixtures)
    back = readers.read_trace_dir(spark, f"{tmp_path}/trace/*", config, "*.txt")
    want = made.agg(F.count_if("valid").alias("v"), F.sum(F.when(F.col("valid"), F.col("flow"))).alias("s")).first()
    got = back.agg(F.count_if("valid").alias("v"), F.sum("flow").alias("s")).first()
    assert got.v == want.v and abs(got.s - want.s) < 15
    share = back.agg((F.count_if(~F.col("valid")) / F.count("*")).alias("x")).first().x
    assert 0 < share < 0.05
    with pytest.raises(FileNotFoundError):
        readers.read_trace_dir(spark, str(tmp_path), config, "*.none")
    with pytest.raises(ValueError):
        readers.read_trace(spark, [], config)


def test_labels_conserve_and_score(spark, house):
    made, found = house
    trace_df = made.select("idx", "ts", "flow", "valid")
    ev = spark.createDataFrame(found[["fixture", "start_idx", "end_idx"]])
    built = labels.build_labels(trace_df, ev, rates.fixture_table(spark, CONFIG)).cache()
    gap = built.groupBy("idx").agg(F.sum("flow").alias("t")).join(trace_df, "idx").agg(F.max(F.abs(F.col("t") - F.greatest("flow", F.lit(0.0)))).alias("g")).first().g
    assert gap < 1e-9
    truth = X.truth_long(made).withColumn("valid", F.lit(True))
    own = segment(truth, 0.1, 0.05, 3, 5, ["fixture"], use_valid=False)
    scores = metrics.event_metrics(own, ev, 0.5)
    total = scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).first()
    assert 2 * total.tp / (2 * total.tp + total.fp + total.fn) > 0.85
    loose = metrics.detection_counts(own, ev, 0.5).first()
    assert loose.tp >= total.tp
    built.unpersist()


def test_evaluate_and_latex(spark, house, tmp_path):
    made, found = house
    flows = X.truth_long(made)
    ev = events.enrich(spark.createDataFrame(found[["fixture", "start_idx", "end_idx"]]), 0, 1)
    result = metrics.evaluate(ev, ev, flows, flows, rates.fixture_table(spark, CONFIG), 1, 0.05)
    rows = result.per_fixture.collect()
    assert all(r.f1 == 1 and r.volume_mae == 0 and r.mae == 0 for r in rows)
    assert result.detection.first().f1 == 1 and {r.share for r in result.confusion.collect()} <= {0.0, 1.0}
    result.save(str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/per_fixture").count() == len(rows)
    text = metrics.latex_table([{"fixture": "a_b", "f1": None, "sufficient_support": False}], "100 % of $", "t")
    assert r"a\_b$^\dagger$" in text and "---" in text and r"100 \% of \$" in text and "f1" not in text


def test_diary_reading(spark, tmp_path):
    pd.DataFrame({"page": ["K", "K", "Z", "X"], "symbol": ["F", "D", "Q", "S"], "date": ["2024-03-04"] * 4, "start_time": ["7:05:00 AM", "11:59:00 PM", "8:00:00 AM", "bad"], "end_time": ["7:06:00 AM", "12:01:00 AM", "", ""]}).to_csv(f"{tmp_path}/d.csv", index=False)
    config = Config(fixtures=(Fixture("Kitch_F", page="K", symbol="F"),), excluded=(Fixture("Dish", page="K", symbol="D"),))
    rows = {r.symbol: r for r in readers.read_diary(spark, f"{tmp_path}/d.csv", config).collect()}
    assert set(rows) == {"F", "D", "Q"}
    assert rows["F"].duration_s == 60 and rows["F"].fixture == "Kitch_F"
    assert rows["D"].excluded and not rows["D"].duration_known  # noted past midnight
    assert rows["Q"].fixture is None


def test_label_matrix(spark, tmp_path):
    t0 = datetime(2024, 3, 4)
    pd.DataFrame({"Unnamed: 0": [0, 1, 2], "Date": ["2024-03-04"] * 3, "Time": ["00:00:01", "00:00:01", "00:00:03"], "Flow": [1, 1, 1], "a": [1.5, 9.0, "x"], "Ad_B": [1, 1, 1]}).to_csv(f"{tmp_path}/l.csv", index=False)
    tr = spark.createDataFrame([(i, t0 + timedelta(seconds=i), 0.0, True) for i in range(5)], "idx long, ts timestamp_ntz, flow double, valid boolean")
    config = Config(fixtures=(Fixture("a"), Fixture("b")))
    rows = {(r.fixture, r.idx): r.flow for r in readers.read_label_matrix(spark, [f"{tmp_path}/l.csv"], tr, config).collect()}
    assert len(rows) == 10 and rows["a", 1] == 1.5 and sum(rows.values()) == 1.5
    with pytest.raises(ValueError):
        readers.read_label_matrix(spark, [f"{tmp_path}/l.csv"], tr, Config(fixtures=(Fixture("zz"),)))


def test_regularise_and_deadband(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(t0, 1.0), (t0 + timedelta(seconds=2), -3.0), (t0 + timedelta(seconds=4), 0.01), (t0 + timedelta(seconds=5), 7.0), (None, 4.0), (t0 + timedelta(seconds=6), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, flow double")
    got = [(r.idx, r.flow, r.valid) for r in trace.regularise(df, 2).orderBy("idx").collect()]
    assert got == [(0, 1.0, True), (1, -3.0, True), (2, 0.01, True)]
    assert [r.flow for r in trace.deadbanded(trace.regularise(df, 2), 0.05).orderBy("idx").collect()] == [1.0, 0.0, 0.0]
    assert trace.regularise(df.limit(0), 2).collect() == []


def test_windows_and_tiles(spark):
    t0 = datetime(2024, 1, 1, 23, 59, 30)
    df = spark.createDataFrame([(i, t0 + timedelta(seconds=i), float(i), True, float(i > 50)) for i in range(100)], "idx long, ts timestamp_ntz, flow double, valid boolean, label double")
    made = windows.make_windows(df, 20, 5).collect()
    assert sorted(r.start for r in made) == list(range(0, 81, 5))
    assert all(r.x == [float(r.start + j) for j in range(20)] for r in made)
    days = trace.local_days(df)
    inside = windows.make_windows(df, 20, 5, days, 0.5, arrays=False).collect()
    assert {r.start for r in inside} == {s for s in range(0, 81, 5) if s >= 30 and s + 19 > 50}
    low, high = windows.slice_bounds(20, 5, "center")
    owner = {r.idx: r.owner for r in windows.tile_owner(df, 100, 20, 5).collect()}
    for i in range(100):
        want = [s for s in range(0, 81, 5) if s + low <= i < s + high]
        assert owner[i] == (want[0] if want else None)
    with pytest.raises(ValueError):
        windows.slice_bounds(5, 20, "center")
    with pytest.raises(ValueError):
        windows.slice_bounds(20, 5, "middle")


def test_part_sizes_of_short_campaigns():
    got = [windows.part_sizes(n, 0.2, 0.15, 3, 2) for n in range(1, 11)]
    assert got == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 1), (3, 2), (3, 2), (3, 2), (3, 2), (3, 2)]


def test_windows_of_parts_share_no_sample(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=10 * i), float(i % 7), True) for i in range(6 * 144)]
    df = spark.createDataFrame(rows, "idx long, ts timestamp_ntz, flow double, valid boolean")
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(6)]
    parts = windows.partition_days(days, 0.2, 0.15, 1, 1, 3)
    table = windows.partition_table(spark, parts)
    made = windows.build_partitions(df, table, 12, 5, arrays=False).collect()
    held = {}
    for r in made:
        for i in range(r.start, r.start + 12):
            held.setdefault(i, set()).add(r.part)
            assert (start + timedelta(minutes=10 * i)).date() in parts[r.part]
    assert {p for ps in held.values() for p in ps} == {p for p, ds in parts.items() if ds} and all(len(ps) == 1 for ps in held.values())
    found = {r.part: r.n_days for r in windows.partition_summary(table).collect()}
    assert found == {p: len(ds) for p, ds in parts.items() if ds}


def test_plain_split():
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(28)]
    parts = windows.split_days(days)
    assert sorted(d for ds in parts.values() for d in ds) == days
    assert (len(parts["test"]), len(parts["val"])) == (5, 4) and sum(d.weekday() >= 5 for d in parts["test"]) == 1
    assert windows.split_days(days) == parts


def test_predicted_trace_is_whole(spark):
    rng = np.random.default_rng(2)
    flow = rng.uniform(0, 3, 100)
    flow[20:60] = 0.0
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + timedelta(seconds=i), float(x), True) for i, x in enumerate(flow)], "idx long, ts timestamp_ntz, flow double, valid boolean")
    config = allocate.ModelConfig(n_fixtures=2, hidden=4, layers=1)
    w, names = allocate.random_weights(config), ["a", "b"]
    low, high = windows.slice_bounds(20, 5, "center")
    for skip in (True, False):
        found = allocate.predict_trace(df, w, config, names, 20, 5, skip_idle=skip)
        got = {(r.idx, r.fixture): r for r in found.collect()}
        assert len(got) == 200
        for s in range(0, 81, 5):
            idle = skip and not (flow[s : s + 20] > 0.05).any()
            want = allocate.forward(flow[None, s : s + 20], w, config)["flow"][0]
            for i in range(s + low, s + high):
                for k, f in enumerate(names):
                    assert got[i, f].covered and abs(got[i, f].flow - (0.0 if idle else want[i - s, k])) < 1e-9
        assert not any(got[i, "a"].covered or got[i, "a"].flow for i in [*range(low), *range(80 + high, 100)])
    summary = allocate.prediction_summary(found, df, 1.0).first()
    assert summary.samples == 100 and summary.covered == 80 + high - low
    share = {i: got[i, "a"].unattributed for i in range(100)}
    assert abs(summary.unattributed - sum(share[i] * flow[i] for i in range(100)) / 60) < 1e-9
    assert abs(summary.predicted - sum(r.flow for r in got.values()) / 60) < 1e-9


def test_thresholds_without_labels_keep_the_configured_fraction(spark):
    rates_ = spark.createDataFrame([("a", 2.0, None), ("b", 4.0, 0.3), ("c", None, None)], "fixture string, rate double, on_frac double")
    best = spark.createDataFrame([("a", 0.7, 0.9)], "fixture string, frac double, f1 double")
    got = {r.fixture: tuple(r)[1:] for r in events.threshold_report(events.with_fallback(best, rates_, 0.5)).collect()}
    assert got == {"a": (2.0, 1.4, 0.7, 0.9, ""), "b": (4.0, 1.2, 0.3, None, "no labelled events: configured fraction")}
    frame = events.event_frame(spark.createDataFrame([("b", 5, 9), ("a", 5, 6), ("c", 1, 2)], "fixture string, start_idx int, end_idx int"))
    assert [r.fixture for r in frame.collect()] == ["c", "a", "b"] and dict(frame.dtypes)["start_idx"] == "bigint" and frame.first().plateau is None


def test_classes_and_order_in_latex(spark):
    rows = [{"fixture": "x_1", "category": "p", "f1": 0.5, "n_labelled": 2, "sufficient_support": False}, {"fixture": "y", "category": "q"}]
    text = metrics.latex_table(rows, "c", "l", ("p", "q"), [{"category": "q", "f1": 1.0, "n_labelled": 3}], ("y", "x_1"))
    lines = text.splitlines()
    assert lines.index(r"y & 0 & --- & --- & --- & --- \\") < lines.index(r"x\_1$^\dagger$ & 2 & --- & --- & 0.50 & --- \\") < lines.index(r"\textit{q} & 3 & --- & --- & 1.00 & --- \\")
    codes = spark.createDataFrame([("Ad_S",), ("Kid_T",), ("Dish_W",), ("Kitch_r",)], "c string")
    assert [r[0] for r in codes.select(rates.fixture_class(F.col("c"))).collect()] == ["shower", "toilet", "appliance", "faucet"]


@pytest.mark.parametrize("n", [4, 10, 30, 42, 60])
def test_partitions_do_not_leak(n):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(n)]
    parts = windows.partition_days(days, 0.2, 0.15, 3, 2, 7)
    flat = [d for xs in parts.values() for d in xs]
    assert sorted(flat) == days and parts["train"]
    assert parts == windows.partition_days(days, 0.2, 0.15, 3, 2, 7)
    if n >= 30:
        assert any(d.weekday() >= 5 for d in parts["test"])
    with pytest.raises(ValueError):
        windows.partition_days([], 0.2, 0.15, 3, 2, 7)


def test_network_contract(tmp_path):
    config = allocate.ModelConfig(n_fixtures=3, hidden=6, layers=2)
    w = allocate.random_weights(config)
    x = np.abs(np.random.default_rng(0).normal(size=(4, 30)))
    out = allocate.forward(x, w, config)
    assert np.allclose(out["shares"].sum(2), 1) and (out["flow"] >= 0).all()
    assert np.allclose(out["flow"].sum(2) + out["shares"][:, :, -1] * x, x)
    assert (allocate.forward(x * 0, w, config)["flow"] == 0).all()
    allocate.save_weights(f"{tmp_path}/w.npz", w, config, {"epoch": 3})
    again, cfg, meta = allocate.load_weights(f"{tmp_path}/w.npz")
    assert cfg == config and meta == {"epoch": 3} and np.array_equal(allocate.forward(x, again, cfg)["flow"], out["flow"])
    one_way = allocate.ModelConfig(n_fixtures=2, hidden=4, layers=1, bidirectional=False)
    w1 = allocate.random_weights(one_way)
    y = x.copy()
    y[:, 20:] = 9
    assert np.allclose(allocate.forward(x, w1, one_way)["shares"][:, :20], allocate.forward(y, w1, one_way)["shares"][:, :20])
    total, valid = np.full((1, 3), 2.0), np.ones((1, 3), bool)
    flow = np.full((1, 3, 1), 2.0)
    assert allocate.loss(flow, flow, np.full((1, 3, 1), 0.9), np.zeros((1, 3)), total, valid) < allocate.loss(flow * 0, flow, np.full((1, 3, 1), 0.1), np.ones((1, 3)), total, valid)
    assert allocate.loss(flow, flow, flow, flow[:, :, 0], total * 0, valid) == 0


def test_config_mapping():
    c = from_mapping({"period_s": 2, "fixtures": [{"code": "a", "rate": 1.0}], "columns": ["timestamp", "flow_gpm"], "unused": 1})
    assert c.period_s == 2 and c.codes == ["a"] and c.extra == {"unused": 1}


def test_streaming_segmenter(spark, tmp_path):
    from tidemark.streaming.segmenter import stream_events

    xs = [0, 3, 3, 3, 0, 3, 3, 0, 0, 0, 0, 3, 3, 3, 0, 0, 0, 0, 0]
    for part, (a, b) in enumerate(((0, 6), (6, 13), (13, 19))):
        spark.createDataFrame([("a", i, float(xs[i])) for i in range(a, b)], "fixture string, idx long, flow double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")
    source = f"{tmp_path}/in"
    import os
    import shutil

    os.makedirs(source)
    stream = spark.readStream.schema("fixture string, idx long, flow double").parquet(source)
    q = stream_events(stream, 1.0, 0.5, 2, 2).writeStream.format("memory").queryName("segments").outputMode("append").start()
    try:
        for part in range(3):
            for f in os.listdir(f"{tmp_path}/in{part}"):
                if f.endswith(".parquet"):
                    shutil.copy(f"{tmp_path}/in{part}/{f}", f"{source}/{part}-{f}")
            q.processAllAvailable()
    finally:
        q.stop()
    rows = sorted((r.start_idx, r.end_idx, r.volume) for r in spark.sql("SELECT * FROM segments").collect())
    assert rows == [(1, 7, 15.0), (11, 14, 9.0)]


@pytest.mark.parametrize("name", ["segment_events", "match_counts", "confusion", "hungarian_match", "lstm_alloc"])
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_oracle_names_known_queries():
    assert set(oracle.ORACLE) <= set(queries.QUERIES)


def test_shares_of_totals_far_from_all_rates(spark):
    rows = spark.createDataFrame([(0, 5e6), (1, 9.0), (2, 1e300)], "idx long, flow double").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    found = allocate.rate_shares(rows, spark.createDataFrame([("a", 8.0), ("b", 10.0), ("c", 12.0)], "fixture string, rate double"), 1.0)
    got = {(r.idx, r.fixture): r.share for r in found.collect()}
    assert all(abs(sum(got[i, f] for f in "abc") - 1) < 1e-9 for i in (0, 1, 2))
    assert got[0, "c"] > got[0, "b"] > got[0, "a"] and abs(got[1, "a"] - got[1, "b"]) < 1e-12
