"""Parameters of training, splitting and alerting. Plain values, set on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


# The published training settings.
@dataclass(frozen=True)
class BoosterConfig:
    trees: int = 500
    max_depth: int = 5
    learning_rate: float = 0.05
    row_sample: float = 0.8
    column_sample: float = 0.8
    min_rows_per_leaf: int = 5
    l1: float = 0.1
    l2: float = 2.0
    seed: int = 42


@dataclass(frozen=True)
class PreprocessingConfig:
    min_category_count: int = 20


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.65
    calibration: float = 0.10
    validation: float = 0.10


@dataclass(frozen=True)
class AlertConfig:
    rate: float = 0.005
    report_rates: tuple[float, ...] = (0.001, 0.005, 0.01)


@dataclass(frozen=True)
class TrainingConfig:
    booster: BoosterConfig = field(default_factory=BoosterConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    alert: AlertConfig = field(default_factory=AlertConfig)


def training_config(fast: bool = False) -> TrainingConfig:
    """The production settings, or with ``fast`` the same ones with ten trees."""
    config = TrainingConfig()
    return replace(config, booster=replace(config.booster, trees=10)) if fast else config
