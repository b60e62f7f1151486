"""Classifiers and the probability calibrator."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schema as S
from tidewatch.config import BoosterConfig, TrainingConfig
from tidewatch.functions.columns import logit, unfused
from tidewatch.operators import blocks, boosting
from tidewatch.operators.newton import logistic
from tidewatch.operators.preprocessing import FEATURES, fit_preprocessor, vector_width
from tidewatch.session import discard, materialize, shared_folder

#: Numbers of encoded rows in one partition. A task of the trees reads about 15 bytes for each from what they cache, and
#: some times that where a lost executor makes it repeat earlier trees.
CELLS_PER_TASK = 1 << 22
WEIGHT = "__class_weight"
RAW_SCORE = "raw_probability"


def class_counts(df: DataFrame, target: str = S.TARGET) -> tuple[int, int]:
    """(negatives, positives)"""
    r = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("p")
    ).first()
    return r["n"] - r["p"], r["p"]


def positive_weight(df: DataFrame, target: str = S.TARGET) -> float:
    """Negatives per positive; with no positives, the number of negatives."""
    negatives, positives = class_counts(df, target)
    return negatives / max(positives, 1)


def booster(config: BoosterConfig) -> GBTClassifier:
    """Boosted trees on log loss.

    The leaf penalties ``l1``/``l2`` have no counterpart in Spark's trees, and
    columns are sampled per node rather than per tree.
    """
    return GBTClassifier(
        featuresCol=FEATURES,
        labelCol=S.TARGET,
        weightCol=WEIGHT,
        maxIter=config.trees,
        maxDepth=config.max_depth,
        stepSize=config.learning_rate,
        subsamplingRate=config.row_sample,
        featureSubsetStrategy=str(config.column_sample),
        minInstancesPerNode=config.min_rows_per_leaf,
        maxMemoryInMB=1024,
        checkpointInterval=10,
        seed=config.seed,
    )


def _labelled(df: DataFrame, positive: float, negative: float = 1.0) -> DataFrame:
    weight = F.when(F.col(S.TARGET) == 1, F.lit(positive)).otherwise(F.lit(negative))
    return df.withColumn(WEIGHT, weight).withColumn(S.TARGET, F.col(S.TARGET).cast("double"))


def fit_booster(
    train: DataFrame,
    features: Sequence[str] = tuple(S.MODEL_FEATURES),
    config: TrainingConfig = TrainingConfig(),
    known: dict[str, float] | None = None,
) -> PipelineModel:
    """Preprocessing and boosted trees, fitted on ``train``; ``known`` medians aren't looked for again."""
    return boosted(*weighted_training(train, features, config, known)[:2], config)


def weighted_training(
    train: DataFrame,
    features: Sequence[str] = tuple(S.MODEL_FEATURES),
    config: TrainingConfig = TrainingConfig(),
    known: dict[str, float] | None = None,
) -> tuple[PipelineModel, DataFrame, int]:
    """The fitted preprocessing, the encoded training rows with the booster's weights, made as they are read, and their number."""
    shared_folder(train.sparkSession)
    narrow = train.select(*features, S.TARGET)
    prepared = fit_preprocessor(narrow, features, config.preprocessing, known)
    negatives, positives = class_counts(narrow)
    weighted = _labelled(narrow, negatives / max(positives, 1))
    return prepared, prepared.transform(weighted).select(FEATURES, S.TARGET, WEIGHT), negatives + positives


def encoded_training(
    train: DataFrame,
    features: Sequence[str] = tuple(S.MODEL_FEATURES),
    config: TrainingConfig = TrainingConfig(),
    known: dict[str, float] | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """``weighted_training`` for a caller that reads the vectors themselves many times.

    Where a task can't hold them all they are cut into partitions of at most ``CELLS_PER_TASK`` numbers and kept on disk; the caller
    unpersists them. The fits here don't need it: they read blocks.
    """
    prepared, encoded, rows = weighted_training(train, features, config, known)
    return prepared, in_bounded_parts(encoded, rows, vector_width(prepared))


def in_bounded_parts(encoded: DataFrame, rows: int, width: int, cells: int | None = None) -> DataFrame:
    """Encoded rows as they are if a task can hold them all, else in enough partitions, kept on disk so that no pass shuffles them again."""
    parts = math.ceil(rows * width / (cells or CELLS_PER_TASK))
    if parts <= 1:
        return encoded
    return encoded.repartition(parts).persist(StorageLevel.DISK_ONLY)


def boosted(prepared: PipelineModel, encoded: DataFrame, config: TrainingConfig) -> PipelineModel:
    """Boosted trees on encoded training rows, behind their preprocessing."""
    layout = blocks.layout_of(prepared)
    held = blocks.stored_blocks(encoded, S.TARGET, WEIGHT, layout)
    try:
        return boosted_blocks(prepared, held, config)
    finally:
        discard(held)


def boosted_blocks(prepared: PipelineModel, held: DataFrame, config: TrainingConfig) -> PipelineModel:
    """The same on stored blocks of them."""
    layout = blocks.layout_of(prepared)
    return PipelineModel([*prepared.stages, boosting.fit(held.sparkSession, booster(config.booster), held, layout)])


def fit_baseline(train: DataFrame, prepared: Sequence, encoded: DataFrame | None = None) -> PipelineModel:
    """Logistic regression on scaled, uncentred features with balanced classes.

    ``prepared`` are the fitted preprocessing stages to reuse, ``encoded`` the training rows they made, if the caller has them.
    """
    negatives, positives = class_counts(train)
    rows = negatives + positives
    source = PipelineModel(list(prepared)).transform(train) if encoded is None else encoded
    weighted = _labelled(source, rows / (2 * max(positives, 1)), rows / (2 * max(negatives, 1)))
    encoded = weighted.select(FEATURES, S.TARGET, WEIGHT)
    scaler = StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=False, withStd=True)
    regression = LogisticRegression(
        featuresCol="scaled",
        labelCol=S.TARGET,
        weightCol=WEIGHT,
        regParam=1e-4,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-3,
    )
    fitted = Pipeline(stages=[scaler, regression]).fit(encoded)
    return PipelineModel([*prepared, *fitted.stages])


def newton_baseline(df: DataFrame, columns: Sequence[str], target: str = S.TARGET) -> dict[str, float]:
    """The baseline on a few numeric columns, solved by Newton steps: coefficients of the scaled columns, and ``intercept``.

    The same problem as ``fit_baseline``: columns divided by their deviation, balanced classes, the mean weighted loss and a ridge of
    1e-4. Every step is one aggregate with a number for each pair of columns, so it is meant for tens of
    columns; encoded categories go the other way.
    """
    negatives, positives = class_counts(df, target)
    rows = negatives + positives
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    scaled = df.select(*[(F.col(c) / F.lit(spread[c] or 1.0)).alias(c) for c in columns], target)
    weight = F.when(F.col(target) == 1, F.lit(rows / (2 * max(positives, 1)))).otherwise(F.lit(rows / (2 * max(negatives, 1))))
    slopes, intercept = logistic(materialize(scaled, "baseline-points"), columns, target, weight, ridge=1e-4, mean=True)
    return dict(zip(columns, slopes, strict=True)) | {"intercept": intercept}


def raw_scores(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` plus the model's probability of the positive class."""
    return model.transform(df).select(*keep, unfused(vector_to_array("probability")[1]).alias(RAW_SCORE))


@dataclass(frozen=True)
class Calibrator:
    """Platt scaling: a logistic curve over the logit of the raw probability."""

    slope: float
    intercept: float

    def apply(self, probability: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * logit(probability) + F.lit(self.intercept))))


def fit_calibrator(scored: DataFrame, score: str = RAW_SCORE, target: str = S.TARGET) -> Calibrator:
    """Fit on held-out scores, with a unit ridge penalty on the slope."""
    negatives, positives = class_counts(scored, target)
    if not negatives or not positives:
        raise ValueError("a calibration curve can't be fitted without both target classes")
    # Read once; the steps read the two numbers of each row from here.
    points = materialize(scored.select(logit(F.col(score)).alias("x"), F.col(target).cast("int").alias("y")), "calibration-points")
    slope, intercept = logistic(points, ["x"], "y", ridge=1.0)
    return Calibrator(slope[0], intercept)
