"""Site configuration as frozen dataclasses; small, parsed once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Fixture:
    code: str
    label: str = ""
    category: str = "other"
    rate: float | None = None
    page: str | None = None
    symbol: str | None = None
    min_duration_s: float = 5.0
    bridge_gap_s: float = 10.0
    on_frac: float | None = None  # None: the shared fraction holds
    off_frac: float | None = None


@dataclass(frozen=True)
class Config:
    fixtures: tuple[Fixture, ...] = ()
    excluded: tuple[Fixture, ...] = ()
    period_s: int = 1
    noise_floor: float = 0.05
    tz_shift_hours: float = 0.0
    layout: str = "paired_rows"
    has_header: bool | None = None
    columns: tuple[str, ...] = ("timestamp", "temperature_f", "pressure", "flow_gpm", "cumulative_gal")
    flow_column: str = "flow_gpm"
    time_format: str = "yyyy-MM-dd h:mm:ss a"
    on_frac: float = 0.5
    off_frac: float = 0.25
    aggregate_on: float = 0.2
    aggregate_off: float = 0.1
    aggregate_min_s: float = 3.0
    aggregate_bridge_s: float = 5.0
    match_tolerance_s: int = 90
    duration_weight: float = 0.5
    window_s: int = 60
    stride_s: int = 15
    emit: str = "center"
    test_fraction: float = 0.2
    val_fraction: float = 0.15
    min_test_days: int = 3
    min_val_days: int = 2
    stratify: bool = True
    seed: int = 20240606
    min_test_events: int = 3
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def fixture(self, code: str) -> Fixture:
        return next(f for f in self.fixtures if f.code == code)

    @property
    def codes(self) -> list[str]:
        return [f.code for f in self.fixtures]


def from_mapping(raw: dict) -> Config:
    """A configuration from a nested mapping (as a YAML file gives); unknown keys are kept in ``extra``."""
    known = set(Config.__dataclass_fields__)
    flat = {k: v for k, v in raw.items() if k in known and k not in ("fixtures", "excluded")}
    if "columns" in flat:
        flat["columns"] = tuple(flat["columns"])
    make = lambda rows: tuple(Fixture(**r) for r in rows)
    return Config(fixtures=make(raw.get("fixtures", ())), excluded=make(raw.get("excluded", ())), extra={k: v for k, v in raw.items() if k not in known}, **flat)
