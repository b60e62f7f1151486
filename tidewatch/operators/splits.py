"""Chronological splits and backtest windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schema as S
from tidewatch.config import SplitConfig
from tidewatch.functions.columns import micros
from tidewatch.plans.ordering import ROW, exact_rows, order_statistics
from tidewatch.session import stored

SPLIT = "split"
_US = "__us"


def _instants(df: DataFrame) -> DataFrame:
    return df.select(micros(F.col(S.TIMESTAMP)).alias(_US))


def distinct_instants(df: DataFrame) -> DataFrame:
    return df.select(F.col(S.TIMESTAMP)).distinct()


def nth_instants(df: DataFrame, positions: Sequence[int], count: int) -> list[int]:
    """Microseconds of the distinct timestamps at 0-based positions."""
    found = order_statistics(_instants(df), {_US: [p + 1 for p in positions]}, count, distinct=True)
    return [found[_US][p + 1][0] for p in positions]


def count_instants(df: DataFrame) -> int:
    return _instants(df).distinct().count()


def temporal_boundaries(df: DataFrame, config: SplitConfig = SplitConfig()) -> list[int]:
    """First microsecond of the calibration, validation and test periods.

    Periods are shares of the distinct timestamps, so equal timestamps never
    straddle a boundary. The sums of fractions are kept as written: their
    floating-point value decides the index.
    """
    if min(config.train, config.calibration, config.validation) <= 0:
        raise ValueError(f"split fractions at or below 0: {config}")
    if config.train + config.calibration + config.validation >= 1:
        raise ValueError(f"split fractions that add up to 1 or more: {config}")
    df = stored(df.select(S.TIMESTAMP), "instants")
    count = count_instants(df)
    first = max(1, int(count * config.train))
    second = max(first + 1, int(count * (config.train + config.calibration)))
    third = max(second + 1, int(count * (config.train + config.calibration + config.validation)))
    if third >= count:
        raise ValueError(f"{count} distinct timestamps can't fill four periods")
    return nth_instants(df, [first, second, third], count)


def split_label(boundaries: Sequence[int]) -> Column:
    us = micros(F.col(S.TIMESTAMP))
    first, second, third = boundaries
    return (
        F.when(us < first, "train")
        .when(us < second, "calibration")
        .when(us < third, "validation")
        .otherwise("test")
    )


def temporal_split(df: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Append the period name of each row."""
    return df.withColumn(SPLIT, split_label(temporal_boundaries(df, config)))


def chronological_split(
    df: DataFrame, tie_break: Sequence[str], train: float = 0.70, validation: float = 0.15
) -> DataFrame:
    """Three parts by row position in (timestamp, tie-break) order; ties may straddle."""
    timed = df.withColumn(_US, micros(F.col(S.TIMESTAMP)))
    order = [(_US, False), *[(c, False) for c in tie_break]]
    # An empty part has no cut; neither part has rows in an empty table.
    timed, cuts = exact_rows(timed, order, lambda rows: [e for e in (int(rows * train), int(rows * (train + validation))) if e > 0])
    inside = [F.lit(False)] * (2 - len(cuts)) + [cut.inside() for cut in cuts]
    label = F.when(inside[0], "train").when(inside[1], "validation").otherwise("test")
    return timed.withColumn(SPLIT, label).drop(_US, ROW)


def between(start: int | None, end: int | None) -> Column:
    """Half-open range start <= timestamp < end over microseconds; None is open."""
    ts = F.col(S.TIMESTAMP).cast("timestamp")
    kept = F.lit(True)
    if start is not None:
        kept = kept & (ts >= F.timestamp_micros(F.lit(start)))
    if end is not None:
        kept = kept & (ts < F.timestamp_micros(F.lit(end)))
    return kept


def window_boundaries(
    df: DataFrame, block_count: int = 14, window_count: int = 4
) -> list[tuple[int, int, int | None]]:
    """Expanding windows as (train end, calibration end, test end or None for the last).

    The distinct timestamps are cut into nearly equal blocks, the longer ones
    first; window w trains on 4 + 2w blocks, calibrates on two and tests on two.
    """
    df = stored(df.select(S.TIMESTAMP), "instants")
    count = count_instants(df)
    if count < block_count:
        raise ValueError(f"{count} timestamps found where {block_count} unique ones are the least")
    size, longer = divmod(count, block_count)

    def block_start(block: int) -> int:
        return block * size + min(block, longer)

    plans = []
    for window in range(window_count):
        train_end = 4 + 2 * window
        if train_end + 4 > block_count:
            continue
        plans.append([train_end, train_end + 2, train_end + 4])
    needed = sorted({block_start(b) for plan in plans for b in plan if b < block_count})
    times = dict(zip(needed, nth_instants(df, needed, count), strict=True))
    return [
        (
            times[block_start(a)],
            times[block_start(b)],
            times[block_start(c)] if c < block_count else None,
        )
        for a, b, c in plans
    ]


def window_frames(
    df: DataFrame, boundaries: tuple[int, int, int | None]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    train_end, calibration_end, test_end = boundaries
    return (
        df.where(between(None, train_end)),
        df.where(between(train_end, calibration_end)),
        df.where(between(calibration_end, test_end)),
    )


def split_statistics(df: DataFrame, by: str = SPLIT, target: str = S.TARGET) -> DataFrame:
    """Rows, positives, prevalence and time span of each period."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(target).cast("long")).alias("positives"),
        F.avg(F.col(target).cast("double")).alias("prevalence"),
        F.min(S.TIMESTAMP).alias("first_timestamp"),
        F.max(S.TIMESTAMP).alias("last_timestamp"),
    )


def has_both_classes(df: DataFrame, target: str = S.TARGET) -> bool:
    span = df.agg(F.min(target).alias("low"), F.max(target).alias("high")).first()
    return span["low"] is not None and span["low"] != span["high"]


def two_class_groups(df: DataFrame, by: str, target: str = S.TARGET) -> DataFrame:
    """Groups that hold both classes, with their row and positive counts."""
    return (
        df.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col(target).cast("long")).alias("positives"),
            F.min(target).alias("low"),
            F.max(target).alias("high"),
        )
        .where(F.col("low") != F.col("high"))
        .drop("low", "high")
    )
