"""Roles and thresholds. Operators take these instead of fixed column names."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Surface:
    """Columns of one measured side of a coil."""

    name: str
    online: str
    online_min: str
    online_max: str
    truth: str
    setpoint: str
    currents: tuple[str, ...] = ()

    def col(self, what: str) -> str:
        return f"{self.name.lower()}_{what}"


@dataclass(frozen=True)
class Spec:
    """Column roles of a calibration table."""

    key: str
    time: str
    grade: str
    speed: str
    width_mm: str
    thickness: str
    surfaces: tuple[Surface, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class CleaningRules:
    """Thresholds of the row rules (fixed values of the published method)."""

    min_speed: float = 20.0
    max_range_abs: float = 0.5
    max_range_ratio: float = 0.4
    mad_factor: float = 3.0
    mad_scale: float = 1.4826022185056018  # makes the MAD of a normal sample estimate its deviation
    steady_speed: float = 80.0
    sigma_factor: float = 3.5


@dataclass(frozen=True)
class ModelParams:
    """Training parameters of a correction model (defaults of the published method)."""

    damping: float = 0.0
    pos_boost: float = 1.0
    alpha_smoothing: float = 0.7
    learning_rate: float = 0.05
    max_iter: int = 200
    max_depth: int = 4


# Text that stands for a missing number (fixed values).
NULL_TOKENS = ("—", "–", "-", "－", "/", "nan", "NaN", "None", "")
EPSILON = 1e-5
