"""Streaming segmentation: the trigger's state and the open event live between batches.

An extension beyond batch work: each key's samples must arrive in order of
``idx`` across batches (within a batch they are sorted here); closed events
come out in append mode. A key's event stays open until a gap above ``gap``
samples ends it, so a shorter pause never splits it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "active boolean, start long, last long, volume double, peak double"
OUT = "fixture string, start_idx long, end_idx long, volume double, peak double"


def stream_events(samples: DataFrame, on: float, off: float, gap: int, least: int) -> DataFrame:
    """``samples(fixture, idx, flow)`` as a stream to closed events."""
    if off > on:
        raise ValueError("the off threshold lies above the on threshold")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, start, last, volume, peak = state.get if state.exists else (False, -1, -1, 0.0, 0.0)
        closed = []
        rows = pd.concat(list(batches)).sort_values("idx")
        for idx, flow in zip(rows["idx"], rows["flow"]):
            active = True if flow > on else False if flow < off else active
            if start >= 0 and idx - last - 1 > gap:
                if last + 1 - start >= max(least, 1):
                    closed.append((key[0], start, last + 1, volume, peak))
                start = -1
            if active:
                if start < 0:
                    start, volume, peak = int(idx), 0.0, 0.0
                last, volume, peak = int(idx), volume + max(float(flow), 0.0), max(peak, float(flow))
        state.update((bool(active), int(start), int(last), float(volume), float(peak)))
        if closed:
            yield pd.DataFrame(closed, columns=["fixture", "start_idx", "end_idx", "volume", "peak"])

    return samples.groupBy("fixture").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
