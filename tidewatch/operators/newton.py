"""Logistic curves by Newton steps: every step is one aggregate over the rows.

Gradient, curvature and loss are sums over rows, so a step moves a few numbers to the driver whatever the table's size,
and the steps don't depend on how it is partitioned beyond the last digits of the sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MAX_STEPS = 100


def logistic(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    weight: Column | None = None,
    ridge: float = 0.0,
    mean: bool = False,
    tolerance: float = 1e-12,
) -> tuple[list[float], float]:
    """Coefficients and intercept that minimise the weighted log loss plus half ``ridge`` times the squared coefficients.

    ``mean`` divides the loss by the sum of weights first. A step that doesn't lower the loss is halved. Rows with a null or
    NaN in any column are left out.
    """
    y = F.col(target).cast("double")
    w = F.lit(1.0) if weight is None else weight
    xs = [F.col(c).cast("double") for c in columns] + [F.lit(1.0)]
    size = len(xs)
    whole = df
    for c in columns:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    penalty = np.array([ridge] * len(columns) + [0.0])

    def at(params: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        margin = F.lit(float(params[-1]))
        for p, x in zip(params[:-1], xs, strict=False):
            margin = margin + F.lit(float(p)) * x
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        loss = F.greatest(margin, F.lit(0.0)) - y * margin + F.log1p(F.exp(-F.abs(margin)))
        rows = whole.select(w.alias("w"), (q - y).alias("e"), (q * (1 - q)).alias("s"), loss.alias("l"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
        product = lambda i: F.col("w") * F.col(f"x{i}")
        sums = [F.sum(F.col("w") * F.col("l")).alias("loss"), F.sum("w").alias("weight")]
        sums += [F.sum(product(i) * F.col("e")).alias(f"g{i}") for i in range(size)]
        sums += [F.sum(product(i) * F.col(f"x{j}") * F.col("s")).alias(f"h{i}_{j}") for i in range(size) for j in range(i, size)]
        r = rows.agg(*sums).first()
        if not r["weight"]:
            raise ValueError(f"no rows to fit a logistic curve of {target} to")
        scale = r["weight"] if mean else 1.0
        gradient = np.array([r[f"g{i}"] for i in range(size)]) / scale + penalty * params
        curvature = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) / scale + np.diag(penalty)
        return r["loss"] / scale + float(penalty @ params**2) / 2, gradient, curvature

    params = np.zeros(size)
    loss, gradient, curvature = at(params)
    for _ in range(MAX_STEPS):
        # A column that is constant has no curvature of its own; the least step is taken then.
        step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(params).max()):
            break
        tried = at(params - step)
        while not tried[0] <= loss + 1e-12 * abs(loss) and np.abs(step).max() > tolerance:
            step = step / 2
            tried = at(params - step)
        params = params - step
        loss, gradient, curvature = tried
    return [float(p) for p in params[:-1]], float(params[-1])
