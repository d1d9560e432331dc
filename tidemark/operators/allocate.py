"""Allocation of a total flow among fixtures: non-negative shares that sum to one.

An allocator gives, for each position of a window, the shares of the fixtures
and of the unattributed rest; flows are shares of the total. Implemented are a
rate-proximity rule in SQL and the forward pass of a recurrent network whose
weights come from an ``.npz`` file. Training a network is not part of this
package: no deep-learning library is at hand, and the rule reproduces the
contract (shares, conservation), not a trained network's accuracy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    n_fixtures: int = 14
    hidden: int = 128
    layers: int = 2
    bidirectional: bool = True
    dropout: float = 0.15
    lr: float = 1e-3
    batch_size: int = 64
    epochs: int = 100
    patience: int = 12
    seed: int = 20240606
    input_scale: float = 5.0

    @property
    def n_channels(self) -> int:
        return self.n_fixtures + 1


def rate_shares(samples: DataFrame, rates: DataFrame, softness: float = 1.0, floor: float = 0.05) -> DataFrame:
    """fixture, idx, ts, share, flow: a softmax of minus the distance of the total from each fixture's rate.

    Idle samples (magnitude at most ``floor``) get zero flow.
    """
    spread = samples.join(F.broadcast(rates.filter("rate IS NOT NULL").select("fixture", "rate")))  # configured fixtures
    # distances beyond the nearest rate's: its weight is 1, so the sum never vanishes, however far the total lies from all rates
    beyond = F.abs(F.col("flow") - F.col("rate"))
    nearest = spread.withColumn("al_d", beyond - F.min(beyond).over(Window.partitionBy("idx")))
    weighted = nearest.withColumn("al_w", F.exp(-F.col("al_d") / F.lit(softness)))
    share = F.col("al_w") / F.sum("al_w").over(Window.partitionBy("idx"))
    idle = F.abs(F.col("flow")) <= floor
    return weighted.withColumn("share", share).select(
        "fixture", "idx", "ts", "share", F.when(idle, F.lit(0.0)).otherwise(F.col("share") * F.greatest("flow", F.lit(0.0))).alias("flow")
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _run_layer(x: np.ndarray, w: dict, prefix: str, reverse: bool) -> np.ndarray:
    wi, wh, b = w[f"{prefix}.wi"], w[f"{prefix}.wh"], w[f"{prefix}.b"]
    n, steps, _ = x.shape
    size = wh.shape[1]
    h, c, out = np.zeros((n, size)), np.zeros((n, size)), np.zeros((n, steps, size))
    for t in reversed(range(steps)) if reverse else range(steps):
        i, f, g, o = np.split(x[:, t] @ wi.T + h @ wh.T + b, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out


def forward(x: np.ndarray, w: dict, config: ModelConfig) -> dict[str, np.ndarray]:
    """shares (n, T, F+1), flow (n, T, F), activation (n, T, F) of windows ``x`` (n, T)."""
    y = x[:, :, None] / config.input_scale
    for layer in range(config.layers):
        sides = [_run_layer(y, w, f"lstm{layer}.fwd", False)]
        if config.bidirectional:
            sides.append(_run_layer(y, w, f"lstm{layer}.bwd", True))
        y = np.concatenate(sides, axis=2)
    y = (y - y.mean(2, keepdims=True)) / np.sqrt(y.var(2, keepdims=True) + 1e-5) * w["norm.w"] + w["norm.b"]
    z = y @ w["alloc.w"].T + w["alloc.b"]
    e = np.exp(z - z.max(2, keepdims=True))
    shares = e / e.sum(2, keepdims=True)
    return {"shares": shares, "flow": shares[:, :, :-1] * x[:, :, None], "activation": _sigmoid(y @ w["act.w"].T + w["act.b"])}


def random_weights(config: ModelConfig) -> dict[str, np.ndarray]:
    """Orthogonal recurrent and scaled uniform input weights, forget bias 1, from the configured seed."""
    rng = np.random.default_rng(config.seed)
    sides, w, width = 2 if config.bidirectional else 1, {}, 1
    uniform = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    for layer in range(config.layers):
        for side in ("fwd", "bwd")[:sides]:
            p = f"lstm{layer}.{side}"
            w[f"{p}.wi"] = uniform(4 * config.hidden, width)
            w[f"{p}.wh"] = np.concatenate([np.linalg.qr(rng.normal(size=(config.hidden,) * 2))[0] for _ in range(4)])
            w[f"{p}.b"] = np.concatenate([np.zeros(config.hidden), np.ones(config.hidden), np.zeros(2 * config.hidden)])
        width = sides * config.hidden
    w |= {"norm.w": np.ones(width), "norm.b": np.zeros(width)}
    w |= {"alloc.w": uniform(config.n_channels, width), "alloc.b": np.zeros(config.n_channels)}
    return w | {"act.w": uniform(config.n_fixtures, width), "act.b": np.zeros(config.n_fixtures)}


def predict_windows(windows: DataFrame, weights: dict, config: ModelConfig, fixtures: list[str], low: int, high: int) -> DataFrame:
    """idx, fixture, flow, activation, unattributed of the own slice of each window (``start``, ``x``)."""
    shared = windows.sparkSession.sparkContext.broadcast((weights, config))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, cfg = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            out = forward(np.stack(pdf["x"].to_numpy()), w, cfg)
            n, steps, k = len(pdf), high - low, len(fixtures)
            idx = (pdf["start"].to_numpy()[:, None] + np.arange(low, high)[None, :]).ravel()
            yield pd.DataFrame(
                {
                    "idx": np.repeat(idx, k),
                    "fixture": np.tile(fixtures, n * steps),
                    "flow": out["flow"][:, low:high].ravel(),
                    "activation": out["activation"][:, low:high].ravel(),
                    "unattributed": np.repeat(out["shares"][:, low:high, -1].ravel(), k),
                }
            )

    return windows.select("start", "x").mapInPandas(score, "idx long, fixture string, flow double, activation double, unattributed double")


def predict_trace(trace: DataFrame, weights: dict, config: ModelConfig, fixtures: list[str], length: int, stride: int, emit: str = "center", floor: float = 0.05, skip_idle: bool = True) -> DataFrame:
    """idx, fixture, flow, activation, unattributed, covered for every sample of ``trace`` (idx, ts, flow, valid) and every fixture.

    A sample's values come from the window whose own slice holds it. Windows that
    never exceed ``floor`` in magnitude are not evaluated: their samples are
    covered, with zero flow. Samples that no slice holds are zero and not covered.
    Windows are tiled over the whole trace.
    """
    from .windows import make_windows, slice_bounds, tile_owner

    n = trace.count()
    low, high = slice_bounds(length, stride, emit)
    made = make_windows(trace, length, stride)
    idle = ~F.exists("x", lambda v: F.abs(v) > floor)
    busy = made.filter(~idle) if skip_idle else made
    found = predict_windows(busy, weights, config, fixtures, low, high)
    owned = tile_owner(trace.select("idx"), n, length, stride, emit).select("idx", F.col("owner").isNotNull().alias("covered"))
    every = owned.withColumn("fixture", F.explode(F.array(*map(F.lit, fixtures))))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return every.join(found, ["idx", "fixture"], "left").select("idx", "fixture", zero("flow"), zero("activation"), zero("unattributed"), "covered")


def prediction_summary(predictions: DataFrame, trace: DataFrame, period_s: float) -> DataFrame:
    """samples, covered, predicted and unattributed volume, and the latter's share of both; ``unattributed`` is a share of the total flow."""
    at = predictions.groupBy("idx").agg(F.sum("flow").alias("flow"), F.bool_or("covered").alias("covered"), F.max("unattributed").alias("share"))
    rest = at.join(trace.select("idx", F.greatest("flow", F.lit(0.0)).alias("total")), "idx")
    sums = rest.agg(
        F.count("*").alias("samples"), F.count_if("covered").alias("covered"), (F.sum("flow") * period_s / 60).alias("predicted"), (F.sum(F.col("share") * F.col("total")) * period_s / 60).alias("unattributed")
    )
    both = F.col("predicted") + F.col("unattributed")
    return sums.withColumn("unattributed_frac", F.when(both > 0, F.col("unattributed") / both).otherwise(F.lit(0.0)))


def plain_rates(labels: DataFrame, floor: float = 0.05, least: float = 0.1) -> DataFrame:
    """fixture, rate of a labelled trace without a diary: the median flow where it flows, ``least`` at least, or 1."""
    flowing = F.when(F.col("flow") > floor, F.col("flow"))
    return labels.groupBy("fixture").agg(F.coalesce(F.greatest(F.median(flowing), F.lit(least)), F.lit(1.0)).alias("rate"))


def loss(pred_flow, true_flow, activation, unattributed, total, valid, floor=0.05, beta=0.25, pos_weight=4.0, w_act=0.2, w_un=0.05) -> float:
    """Smooth absolute error of active samples, weighted activation entropy and a charge on the unattributed share."""
    mask = (total > floor) & valid
    if not mask.any():
        return 0.0
    d = np.abs(pred_flow - true_flow)[mask]
    smooth = np.where(d < beta, 0.5 * d**2 / beta, d - 0.5 * beta).mean()
    y = (true_flow > floor)[mask]
    p = np.clip(activation[mask], 1e-7, 1 - 1e-7)
    bce = -(pos_weight * y * np.log(p) + ~y * np.log(1 - p)).mean()
    return float(smooth + w_act * bce + w_un * unattributed[mask].mean())


def save_weights(path: str, weights: dict, config: ModelConfig, metadata: dict | None = None) -> None:
    np.savez(path, config=json.dumps(asdict(config)), metadata=json.dumps(metadata or {}), **weights)


def load_weights(path: str) -> tuple[dict, ModelConfig, dict]:
    with np.load(path, allow_pickle=False) as f:
        weights = {k: f[k] for k in f.files if k not in ("config", "metadata")}
        return weights, ModelConfig(**json.loads(str(f["config"]))), json.loads(str(f["metadata"]))


def reconcile(predictions: DataFrame, trace: DataFrame, floor: float = 0.05) -> DataFrame:
    """Distribution of summed predictions over the measured flow where that exceeds ``floor``."""
    total = predictions.groupBy("idx").agg(F.sum("flow").alias("p"))
    ratio = trace.select("idx", F.col("flow").alias("m")).join(total, "idx").filter(F.col("m") > floor).select((F.col("p") / F.col("m")).alias("r"))
    q = lambda p: F.percentile("r", p)
    return ratio.agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("r").alias("max"))
