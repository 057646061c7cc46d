"""All parameters, as frozen groups; nothing else in the library holds a threshold."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

Dialect = Literal["offline", "inference", "service"]


@dataclass(frozen=True)
class Sampling:
    hertz: float = 400.0
    window_seconds: float = 15.0
    finger_threshold: float = 50_000.0
    least: int = 50  # samples below which a window is not processed

    @property
    def window(self) -> int:
        return int(self.hertz * self.window_seconds)


@dataclass(frozen=True)
class Filters:
    despike: int = 3
    invert: bool = True
    lowpass_hz: float = 16.0
    highpass_hz: float = 0.5
    order: int = 4
    smooth: tuple[int, int] | None = None  # Savitzky-Golay window and degree; the optional step is off
    normalise: Literal["minmax", "zscore"] = "minmax"


@dataclass(frozen=True)
class Beats:
    target_length: int = 220
    min_beats: int = 8
    peak_distance: float = 0.40
    peak_prominence: float = 0.20
    peak_prominence_floor: float = 0.015
    valley_distance: float = 0.35
    valley_prominence: float = 0.10
    valley_prominence_floor: float = 0.010
    foot_to_peak: tuple[float, float] = (0.08, 0.50)
    valley_to_foot: float = 0.20
    foot_height: float = 0.20
    foot_velocity: float = 0.5
    edge: float = 0.10
    duration: tuple[float, float] = (0.35, 1.50)
    median_tolerance: float = 1.35
    main_peak: tuple[float, float] = (0.02, 0.30)
    start_margin: float = 0.10
    end_margin: float = 0.01


#: Fixed limits of the five signal-quality metrics, inclusive.
SQI_LIMITS = {"skewness": (0.0, 2.5), "kurtosis": (1.5, 7.0), "perfusion": (0.1, 10.0), "snr_db": (5.0, 25.0), "zcr_hz": (1.0, 4.0)}

#: Fixed edges of the reference value's ranges, and their names.
BIN_EDGES = (0.0, 70.0, 100.0, 125.0, 180.0, 999.0)
BIN_NAMES = ("Hypoglycemic", "Normal", "Pre-diabetic", "Diabetic", "Hyperglycemic")


@dataclass(frozen=True)
class Boosting:
    trees: int = 75
    depth: int = 2
    rate: float = 0.03
    rows: float = 0.8
    columns: float = 0.7
    alpha: float = 0.5
    ridge: float = 5.0
    min_weight: float = 5.0
    gamma: float = 0.3
    seed: int = 42
    folds: int = 5
    high_value: float = 130.0
    high_weight: float = 2.0


@dataclass(frozen=True)
class Settings:
    sampling: Sampling = field(default_factory=Sampling)
    filters: Filters = field(default_factory=Filters)
    beats: Beats = field(default_factory=Beats)
    boosting: Boosting = field(default_factory=Boosting)
    iqr_factor: float = 1.5
    dialect: Dialect = "offline"
    sqi_gate: bool = False
    min_beats_service: int = 3
    floor_service: float = 40.0

    @property
    def beats_needed(self) -> int:
        return self.min_beats_service if self.dialect == "service" else self.beats.min_beats
