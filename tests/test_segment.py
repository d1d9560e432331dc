import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import segment as G

KEY = ["fixture"]
T0 = datetime(2024, 5, 1, 23, 50)


def frame(spark, series, valid=None, period=60):
    rows = [(k, i, T0 + timedelta(seconds=period * i), float(x), valid[k][i] if valid else True) for k, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "fixture string, idx long, ts timestamp_ntz, flow double, valid boolean")


def trigger(xs, on, off):
    out, state = [], False
    for x in xs:
        state = True if x > on else False if x < off else state
        out.append(state)
    return out


def islands(mask, gap, least):
    runs, i = [], 0
    while i < len(mask):
        if mask[i]:
            j = i
            while j < len(mask) and mask[j]:
                j += 1
            if runs and i - runs[-1][1] <= gap:
                runs[-1][1] = j
            else:
                runs.append([i, j])
            i = j
        i += 1
    return [tuple(r) for r in runs if r[1] - r[0] >= max(least, 1)]


def test_trigger_and_events_against_loops(spark):
    rng = random.Random(4)
    series = {f"f{k}": [rng.choice([0, 0.1, 0.3, 0.6, 0.9]) for _ in range(rng.randint(1, 90))] for k in range(30)}
    valid = {k: [rng.random() > 0.1 for _ in xs] for k, xs in series.items()}
    df = frame(spark, series, valid)
    rows = G.hysteresis(df, 0.5, 0.25, KEY).collect()
    for k, xs in series.items():
        assert [r.active for r in sorted((r for r in rows if r.fixture == k), key=lambda r: r.idx)] == trigger(xs, 0.5, 0.25)
    got = {(r.fixture, r.start_idx, r.end_idx) for r in G.segment(df, 0.5, 0.25, 2, 3, KEY).collect()}
    want = {(k, a, b) for k, xs in series.items() for a, b in islands([x and v for x, v in zip(trigger(xs, 0.5, 0.25), valid[k])], 3, 2)}
    assert got == want


def test_inverted_thresholds(spark):
    with pytest.raises(ValueError):
        G.hysteresis(frame(spark, {"a": [1]}), 0.2, 0.5, KEY)


def test_known_events(spark):
    df = frame(spark, {"a": [0] * 10 + [3.0] * 60 + [0] * 10})
    e = G.event_stats(G.segment(df, 0.5, 0.25, 5, 2, KEY), df, KEY, 1).collect()
    assert [(r.start_idx, r.end_idx, r.volume, r.plateau) for r in e] == [(10, 70, 3.0, 3.0)]
    pause = frame(spark, {"a": [2.0] * 30 + [0] * 8 + [2.0] * 30})
    assert G.segment(pause, 0.5, 0.25, 5, 15, KEY).count() == 1
    assert G.segment(pause, 0.5, 0.25, 5, 2, KEY).count() == 2
    holes = {"a": [not 25 <= i <= 34 for i in range(60)]}
    drop = frame(spark, {"a": [3.0] * 60}, holes)
    assert G.segment(drop, 0.5, 0.25, 3, 0, KEY).count() == 2
    assert G.segment(drop, 0.5, 0.25, 3, 10, KEY).count() == 1
    assert G.segment(drop, 0.5, 0.25, 3, 10, KEY, split_at_gaps=True).count() == 2


def test_plateau_limits(spark):
    for n, want in ((5, None), (6, 2.0), (40, 2.0)):
        df = frame(spark, {"a": [2.0] * n})
        ev = spark.createDataFrame([("a", 0, n)], "fixture string, start_idx long, end_idx long")
        assert G.plateau(G.samples_of(ev, df, KEY), [*KEY, "start_idx", "end_idx"]).first().plateau == want


def test_empty(spark):
    df = frame(spark, {"a": [0.0]}).limit(0)
    assert G.segment(df, 0.5, 0.25, 1, 0, KEY).collect() == []
