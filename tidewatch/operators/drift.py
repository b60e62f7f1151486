"""Shift of scores and features against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.plans.ordering import lookup, quantiles, with_piece

FLOOR = 1e-8


def _present(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def baseline_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """mean, std, min and max per feature from one pass; absent features are skipped."""
    names = [c for c in features if c in df.columns]
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(_present(c)).alias("mean"),
            F.stddev_samp(_present(c)).alias("std"),
            F.min(_present(c)).alias("min"),
            F.max(_present(c)).alias("max"),
        ).alias(c)
        for c in names
    ]
    wide = df.agg(*cells)
    return wide.select(F.explode(F.array(*[F.col(f"`{c}`") for c in names])).alias("cell")).select("cell.*")


def daily_moments(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``by``, ``feature``, ``n``, ``mean``, ``apart`` (squared deviations from the mean), ``min``, ``max``: one row per group and feature.

    These rows are kept instead of the data: merged, they give the statistics of any set of groups without reading it again.
    """
    names = [c for c in features if c in df.columns]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _present(c).alias("value")) for c in names]))
    return (
        df.select(*by, cells.alias("cell"))
        .groupBy(*by, "cell.feature")
        .agg(
            F.count("cell.value").alias("n"),
            F.avg("cell.value").alias("mean"),
            (F.var_pop("cell.value") * F.count("cell.value")).alias("apart"),
            F.min("cell.value").alias("min"),
            F.max("cell.value").alias("max"),
        )
    )


def merged_statistics(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean, std, min and max per feature (and ``by``) from rows of ``daily_moments``, merged pair by pair.

    Two groups of n and m values with means a and b have (a n + b m) / (n + m) as their mean, and their squared deviations
    are those of each plus (a - b)^2 n m / (n + m), in which nothing cancels. Groups without a value add nothing.
    """
    parts = moments.where("n > 0").groupBy(*by, "feature").agg(
        # Sorted, so that the last digits don't depend on the order of arrival.
        F.sort_array(F.collect_list(F.struct("mean", "n", "apart"))).alias("parts"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )

    def pair(left: Column, right: Column) -> Column:
        n = left["n"] + right["n"]
        gap = right["mean"] - left["mean"]
        share = right["n"].cast("double") / n
        return F.struct(
            (left["mean"] + gap * share).alias("mean"),
            n.alias("n"),
            (left["apart"] + right["apart"] + gap * gap * left["n"] * share).alias("apart"),
        )

    zero = F.struct(F.lit(0.0).alias("mean"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("apart"))
    whole = parts.withColumn("whole", F.aggregate("parts", zero, pair))
    everything = moments.select(*by, "feature").distinct()
    found = whole.select(
        *by,
        "feature",
        F.col("whole.mean").alias("mean"),
        F.when(F.col("whole.n") > 1, F.sqrt(F.col("whole.apart") / (F.col("whole.n") - 1))).alias("std"),
        "min",
        "max",
    )
    return lookup(everything, found, [*by, "feature"])


def drift_by(moments: DataFrame, baseline: DataFrame, by: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """``feature_drift`` of every group of stored moments against one baseline, in one pass over the moments."""
    return _compared(merged_statistics(moments, by), baseline, by, threshold)


def feature_drift(
    df: DataFrame, baseline: DataFrame, features: Sequence[str], threshold: float = 0.1
) -> DataFrame:
    """Relative change of mean and deviation; features without a baseline are skipped."""
    return _compared(baseline_statistics(df, features), baseline, [], threshold)


def _compared(current: DataFrame, baseline: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    current = current.select(*by, "feature", F.col("mean").alias("current_mean"), F.col("std").alias("current_std"))
    before = baseline.select(
        "feature", F.col("mean").alias("baseline_mean"), F.col("std").alias("baseline_std")
    )

    def change(now: str, then: str, scale: Column) -> Column:
        return F.abs(F.col(now) - F.col(then)) / F.greatest(scale, F.lit(FLOOR))

    mean_change = change("current_mean", "baseline_mean", F.abs(F.col("baseline_mean")))
    std_change = change("current_std", "baseline_std", F.col("baseline_std"))
    return current.join(before, "feature").select(
        *by,
        "feature",
        "baseline_mean",
        "current_mean",
        (mean_change * 100).alias("mean_change_pct"),
        "baseline_std",
        "current_std",
        (std_change * 100).alias("std_change_pct"),
        F.coalesce((mean_change > threshold) | (std_change > threshold), F.lit(False)).alias("drift_detected"),
    )


def prediction_drift(
    df: DataFrame,
    baseline_quantiles: Sequence[float],
    score: str = "score",
    threshold_std: float = 2.0,
) -> DataFrame:
    """Median shift and spread ratio of scores against a stored quantile list.

    The baseline median and population deviation are those of the list itself.
    """
    base_median = float(np.median(baseline_quantiles))
    base_std = float(np.std(baseline_quantiles))
    median = quantiles(df, {score: [0.5]})[score][0]
    current = df.agg(F.stddev_pop(_present(score)).alias("current_std"))
    shift = F.abs(F.lit(median) - F.lit(base_median))
    spread = F.col("current_std") / F.lit(max(base_std, FLOOR))
    moved = shift > F.lit(threshold_std * base_std)
    widened = (spread > 2.0) | (spread < 0.5)
    return current.select(
        F.lit(base_median).alias("baseline_median"),
        F.lit(median).alias("current_median"),
        shift.alias("median_shift"),
        F.lit(base_std).alias("baseline_std"),
        "current_std",
        spread.alias("std_ratio"),
        moved.alias("median_drift_detected"),
        widened.alias("variance_drift_detected"),
        (moved | widened).alias("drift_detected"),
    )


#: Size of a score sketch, and the normalised rank error it has with 99 % confidence (stated by the sketch's authors as 2.296 / k^0.9021).
SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """Largest difference between the rank a sketch's quantile has and the rank asked for, with 99 % confidence."""
    return 2.296 / k**0.9021


def score_sketches(df: DataFrame, by: Sequence[str], score: str = "score", k: int = SKETCH_K) -> DataFrame:
    """``by``, ``n`` and a mergeable quantile sketch of the scores of each group; null and NaN left out."""
    present = df.select(*by, _present(score).alias("value")).where(F.col("value").isNotNull())
    return present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged_sketch(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """``by``, ``n`` and the sketch of all scores whose sketches are merged; its error is that of one sketch."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float], sketch: str = "sketch") -> DataFrame:
    """Appends ``quantiles``, one for each share; every one has a rank within ``rank_error`` of its share."""
    wanted = F.array(*[F.lit(float(q)) for q in shares])
    return sketches.withColumn("quantiles", F.kll_sketch_get_quantile_double(sketch, wanted))


def rank_errors(df: DataFrame, score: str, values: Sequence[float], shares: Sequence[float], n: int) -> list[float]:
    """How far the exact rank of each value is from its share: 0 if the rows equal to it span the share. One counting pass."""
    steps = sorted(set(values))
    placed = with_piece(df.select(_present(score).alias("value")).where(F.col("value").isNotNull()), "value", steps, "piece")
    start = F.element_at(F.array(F.lit(None).cast("double"), *map(F.lit, steps)), F.col("piece") + 1)
    counted = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == start).alias("at"))
    rows = {r["piece"]: r for r in counted.collect()}
    below, upto, before = {}, {}, rows[0]["n"] if 0 in rows else 0
    for k, step in enumerate(steps, start=1):
        r = rows.get(k)
        below[step], upto[step] = before, before + (r["at"] if r else 0)
        before += r["n"] if r else 0
    return [max(0.0, below[v] / n - q, q - upto[v] / n) for v, q in zip(values, shares, strict=True)]
