"""Training and the studies around it, end to end."""

from __future__ import annotations

import platform
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from importlib.metadata import version

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import schema as S
from tidewatch.config import AlertConfig, TrainingConfig
from tidewatch.functions.columns import SCORE_CLIP, clip
from tidewatch.operators import accounts, alerts, metrics, splits
from tidewatch.operators.models import (
    RAW_SCORE,
    boosted,
    fit_baseline,
    fit_booster,
    fit_calibrator,
    raw_scores,
    weighted_training,
)
from tidewatch.operators.preprocessing import FEATURES, medians
from tidewatch.plans.ordering import ROW, quantiles
from tidewatch.session import materialize
from tidewatch.sources.artifacts import RiskModel

SCORE = "score"
#: Encoded training numbers of fits that run at the same time. The trees cache about five bytes for each.
CELLS_AT_ONCE = 1 << 30
_BASELINE_SCORE = "__baseline_probability"


def _stored_scores(model, df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    """Score once and keep the table: every metric reads it several times."""
    return materialize(raw_scores(model, df, keep), name)


def _scores_of_both(model: PipelineModel, baseline: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the stored raw scores of two models with the same preprocessing: rows are read and encoded once for both."""
    shared = len(model.stages) - 1
    encoded = PipelineModel(model.stages[:shared]).transform(df).select(*keep, FEATURES)
    scored = raw_scores(PipelineModel(baseline.stages[shared:]), encoded, [*keep, FEATURES]).withColumnRenamed(RAW_SCORE, _BASELINE_SCORE)
    return materialize(raw_scores(PipelineModel(model.stages[shared:]), scored, [*keep, _BASELINE_SCORE]), "held-out-scores")


def fit_and_score(
    train: DataFrame,
    calibration: DataFrame,
    test: DataFrame,
    tie_break: Sequence[str],
    features: Sequence[str],
    config: TrainingConfig,
    extra: Sequence[str] = (),
    known: dict[str, float] | None = None,
) -> DataFrame:
    """Fit, calibrate, and return the stored calibrated score table of the test rows; ``known`` are the training medians, if at hand."""
    model = fit_booster(train, features, config, known)
    calibrator = fit_calibrator(_stored_scores(model, calibration, [S.TARGET], "calibration-scores"))
    keep = [*dict.fromkeys([*tie_break, S.TARGET, *extra])]
    scored = _stored_scores(model, test, keep, "test-scores")
    return scored.withColumn(SCORE, calibrator.apply(F.col(RAW_SCORE)))


def _headline(scored: DataFrame, tie_break: Sequence[str], rate: float) -> dict:
    """Areas over clipped scores; alerts by the scores as they are, since clipping can make ties."""
    clipped = metrics.clipped_scores(scored.select(SCORE, S.TARGET), SCORE)
    areas = metrics.ranking_areas(metrics.score_steps(clipped, SCORE)).first()
    at = alerts.at_alert_rate(scored, [rate], tie_break, SCORE).first()
    return {
        "pr_auc": areas["pr_auc"],
        "roc_auc": areas["roc_auc"],
        "precision": at["precision"],
        "recall": at["recall"],
        "lift": at["lift"],
    }


def _waves(cells: Sequence[int], together: int) -> list[range]:
    """Fits in their order, at most ``together`` at a time and with no more than ``CELLS_AT_ONCE`` cells, unless one alone has more."""
    starts, held = [], 0
    for i, n in enumerate(cells):
        if not starts or i - starts[-1] >= max(1, together) or held + n > CELLS_AT_ONCE:
            starts.append(i)
            held = 0
        held += n
    return [range(a, b) for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)]


def at_once(spark: SparkSession, tasks: Sequence[Callable[[], object]], together: int, cells: Sequence[int] | None = None) -> list:
    """Results of independent studies, some of them fitted at the same time: a small fit leaves most of a cluster idle.

    ``cells`` are the encoded numbers of each fit. Large ones go one after the other: each fills the cluster, and what several of them
    cache at once wouldn't stay in memory from pass to pass.
    """
    found = []
    with ThreadPoolExecutor(max(1, together)) as pool:
        for wave in _waves([0] * len(tasks) if cells is None else cells, together):
            waiting = [pool.submit(inheritable_thread_target(spark)(tasks[i])) for i in wave]
            found += [w.result() for w in waiting]
    return [f for f in found if f is not None]


def _encoded_width(df: DataFrame, features: Sequence[str]) -> int:
    """About how many places an encoded row has at most; the exact number needs the dictionary of each fit."""
    categorical = [c for c in features if c in S.CATEGORICAL_FEATURES]
    slots = df.agg(*[F.approx_count_distinct(c) for c in categorical]).first() if categorical else ()
    return len(features) - len(categorical) + sum(slots)


def _tallied(parts: dict[str, Column], rate: float) -> list[Column]:
    """Rows and positives of each part, whether it holds both classes, and the alert budget of the test part."""
    y = F.col(S.TARGET).cast("long")
    out = []
    for name, inside in parts.items():
        rows, positives = F.count(F.when(inside, 1)), F.coalesce(F.sum(F.when(inside, y)), F.lit(0))
        out += [rows.alias(f"{name}_rows"), positives.alias(f"{name}_positives")]
        if name == "test":
            out.append(F.when(rows > 0, F.greatest(F.lit(1), F.ceil(rows.cast("double") * F.lit(rate)))).otherwise(0).alias("alerts"))
    return out


PLAN = ("train_rows", "train_positives", "calibration_rows", "calibration_positives", "test_rows", "test_positives", "alerts")


def backtest_plan(df: DataFrame, rate: float = AlertConfig().rate) -> DataFrame:
    """What each window of the backtest holds, in one pass: rows, positives, alerts, and whether every part has both classes."""
    windows = splits.window_boundaries(df)
    cells = []
    for number, (train, calibration, test) in enumerate(windows, start=1):
        parts = {"train": splits.between(None, train), "calibration": splits.between(train, calibration), "test": splits.between(calibration, test)}
        cells.append(F.struct(F.lit(f"W{number}").alias("window"), *_tallied(parts, rate)).alias(f"w{number}"))
    wide = df.agg(*cells)
    tall = wide.select(F.explode(F.array(*wide.columns)).alias("w")).select("w.*")
    return tall.withColumn("usable", _both_classes("train", "calibration", "test"))


def _both_classes(*parts: str) -> Column:
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.col(f"{p}_positives") > 0) & (F.col(f"{p}_positives") < F.col(f"{p}_rows"))
    return whole


def walk_forward(
    df: DataFrame, tie_break: Sequence[str], config: TrainingConfig = TrainingConfig(), together: int = 4
) -> DataFrame:
    """Expanding-window backtest; windows with a one-class part are skipped, up to ``together`` of the others are fitted at once.

    ``df`` should be a stored feature table: each window reads its time range.
    """
    usable = {r["window"]: r["train_rows"] for r in backtest_plan(df, config.alert.rate).where("usable").collect()}

    def fitted(name: str, bounds: tuple[int, int, int | None]) -> tuple:
        train, calibration, test = splits.window_frames(df, bounds)
        scored = fit_and_score(train, calibration, test, tie_break, S.MODEL_FEATURES, config)
        r = _headline(scored, tie_break, config.alert.rate)
        return (name, r["pr_auc"], r["recall"], r["precision"], r["lift"])

    named = [(f"W{number}", bounds) for number, bounds in enumerate(splits.window_boundaries(df), start=1)]
    named = [each for each in named if each[0] in usable]
    width = _encoded_width(df, S.MODEL_FEATURES)
    results = at_once(df.sparkSession, [partial(fitted, *each) for each in named], together, [usable[name] * width for name, _ in named])
    return df.sparkSession.createDataFrame(
        results,
        "window string, pr_auc double, `recall_at_0.5%` double, "
        "`precision_at_0.5%` double, `lift_at_0.5%` double",
    )


def ablation_plan(df: DataFrame, config: TrainingConfig = TrainingConfig()) -> DataFrame:
    """What each model of the ablation is given: its feature sets, and the rows, positives and alerts all of them share."""
    label = splits.split_label(splits.temporal_boundaries(df, config.split))
    counts = df.agg(*_tallied({name: label == name for name in ("train", "calibration", "test")}, config.alert.rate)).first()
    shared = tuple(counts[c] for c in PLAN)
    sets = [
        (name, sum(f in S.NUMERIC_FEATURES for f in features), sum(f in S.CATEGORICAL_FEATURES for f in features), *shared)
        for name, features in S.ABLATION_FEATURE_SETS.items()
    ]
    return df.sparkSession.createDataFrame(sets, "model string, numbers int, categories int, " + ", ".join(f"{c} long" for c in PLAN))


def feature_ablation(
    df: DataFrame, tie_break: Sequence[str], config: TrainingConfig = TrainingConfig(), together: int = 4
) -> DataFrame:
    """The same model over the four feature sets, up to ``together`` of them fitted at once."""
    parts = splits.temporal_split(df, config.split)
    train, calibration, test = (
        parts.where(F.col(splits.SPLIT) == name) for name in ("train", "calibration", "test")
    )

    # All sets are fitted on the same rows, so their medians are the same.
    known = medians(train, S.NUMERIC_FEATURES)

    def fitted(name: str, features: Sequence[str]) -> tuple:
        scored = fit_and_score(train, calibration, test, tie_break, features, config, known=known)
        r = _headline(scored, tie_break, config.alert.rate)
        return (name, r["pr_auc"], r["recall"])

    rows, slots = train.count(), _encoded_width(train, S.CATEGORICAL_FEATURES)
    cells = [rows * (slots + sum(f in S.NUMERIC_FEATURES for f in features)) for features in S.ABLATION_FEATURE_SETS.values()]
    results = at_once(df.sparkSession, [partial(fitted, *each) for each in S.ABLATION_FEATURE_SETS.items()], together, cells)
    return df.sparkSession.createDataFrame(results, "model string, pr_auc double, `recall_at_0.5%` double")


def unseen_entities(
    scored: DataFrame,
    train: DataFrame,
    tie_break: Sequence[str],
    rate: float = 0.005,
    threshold: float | None = None,
) -> DataFrame:
    """Test metrics for all rows, for known parties, and where one was never seen in training.

    Each subgroup gets its own top-K. ``threshold`` adds what the production cut
    does to it. Subgroups with one class keep their counts and no metrics.
    """
    flagged = accounts.flag_unseen(scored, accounts.known_accounts(train))
    grouped = accounts.subgroups(flagged.select(SCORE, S.TARGET, *tie_break, "both_seen")).drop("both_seen")
    grouped = materialize(grouped.withColumn(ROW, F.monotonically_increasing_id()), "subgroup-scores")
    by = ["subgroup"]
    counts = materialize(
        grouped.groupBy(*by).agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum(F.col(S.TARGET).cast("long")).alias("positives"),
            F.avg(F.col(S.TARGET).cast("double")).alias("prevalence"),
            (F.min(S.TARGET) != F.max(S.TARGET)).alias("both_classes"),
        ),
        "subgroup-counts",
    )
    rows = counts.agg(F.sum("transactions")).first()[0] or 0
    # Areas over clipped scores; alerts by the scores as they are, since clipping can make ties.
    clipped = grouped.withColumn(SCORE, clip(F.col(SCORE), SCORE_CLIP))
    areas = metrics.ranking_areas(metrics.score_steps(clipped, SCORE, by=by, rows=rows), by).select(*by, "pr_auc", "roc_auc")
    at = alerts.at_alert_rate_by(grouped, by, [rate], tie_break, SCORE, rows=rows).select(
        *by, *[F.col(c).alias(f"{c}_at_alert_rate") for c in ("precision", "recall", "lift")]
    )
    names = scored.sparkSession.createDataFrame([(n,) for n in accounts.SUBGROUPS], "subgroup string")
    found = names.join(counts, "subgroup", "left").fillna(0, ["transactions", "positives"])
    found = found.join(areas, "subgroup", "left").join(at, "subgroup", "left")
    report = found.select(
        "subgroup", "transactions", "positives", "prevalence", *[F.when(F.col("both_classes"), F.col(c)).alias(c) for c in (*areas.columns[1:], *at.columns[1:])]
    )
    if threshold is None:
        return report
    fixed = alerts.at_threshold(grouped, threshold, SCORE, by=["subgroup"])
    renamed = [F.col(c).alias(f"fixed_{c}") for c in fixed.columns if c != "subgroup"]
    return report.join(fixed.select("subgroup", *renamed), "subgroup", "left")


def train_risk_model(
    df: DataFrame, tie_break: Sequence[str], config: TrainingConfig = TrainingConfig()
) -> tuple[RiskModel, dict[str, DataFrame]]:
    """Split, fit, calibrate, choose the threshold, evaluate; the model and its report tables.

    ``df`` should be a stored feature table.
    """
    parts = splits.temporal_split(df, config.split)
    train = parts.where(F.col(splits.SPLIT) == "train")
    spans = {r[splits.SPLIT]: r for r in splits.split_statistics(parts).collect()}
    prepared, encoded, _ = weighted_training(train, S.MODEL_FEATURES, config)
    model = boosted(prepared, encoded, config)
    baseline = fit_baseline(train, model.stages[:-1], encoded)
    columns = [*dict.fromkeys([*tie_break, S.TARGET, splits.SPLIT, *([S.TYPOLOGY] if S.TYPOLOGY in df.columns else [])])]
    held = _scores_of_both(model, baseline, parts.where(F.col(splits.SPLIT) != "train"), columns)
    calibration, validation, test = (held.where(F.col(splits.SPLIT) == n) for n in ("calibration", "validation", "test"))
    calibrator = fit_calibrator(calibration)
    rate = config.alert.rate

    def calibrated(curve, part: DataFrame) -> DataFrame:
        return part.withColumn(SCORE, curve.apply(F.col(RAW_SCORE)))

    checked, tested = calibrated(calibrator, validation), calibrated(calibrator, test)
    of_baseline = lambda part: part.withColumn(RAW_SCORE, F.col(_BASELINE_SCORE))

    def alert_score() -> tuple:
        _, cuts = alerts.alert_cuts(checked, [rate], tie_break, SCORE)
        return (alerts.alert_threshold(cuts[0]),)

    def score_grid() -> tuple:
        return (quantiles(checked, {SCORE: [float(q) for q in np.linspace(0, 1, 1001)]})[SCORE],)

    def evaluated() -> tuple:
        return (metrics.evaluate(tested, tie_break, SCORE, rates=config.alert.report_rates),)

    def baseline_evaluated() -> tuple:
        baseline_tested = calibrated(fit_calibrator(of_baseline(calibration)), of_baseline(test))
        return (metrics.evaluate(baseline_tested, tie_break, SCORE, rates=config.alert.report_rates),)

    def reliability() -> tuple:
        return (metrics.reliability(checked, score=SCORE),)

    def typology() -> tuple | None:
        return (alerts.typology_recall(alerts.mark_alerts(tested, rate, tie_break, SCORE)),) if S.TYPOLOGY in df.columns else None

    # The reports read the stored scores, need nothing of each other and are many small jobs.
    (threshold,), (grid,), (headline,), (baseline_headline,), (curve,), *recalls = at_once(
        df.sparkSession, [alert_score, score_grid, evaluated, baseline_evaluated, reliability, typology], 6
    )
    reports = {
        "test_metrics": headline,
        "baseline_test_metrics": baseline_headline,
        "calibration": metrics.compare_scores(checked, [RAW_SCORE, SCORE]),
        "reliability": curve,
        "split_statistics": splits.split_statistics(parts),
    }
    if recalls:
        reports["typology"] = recalls[0][0]

    details = {
        "test_metrics": headline.first().asDict(),
        "baseline_test_metrics": baseline_headline.first().asDict(),
        "training_start": spans["train"]["first_timestamp"].isoformat(),
        "training_end": spans["train"]["last_timestamp"].isoformat(),
        "test_start": spans["test"]["first_timestamp"].isoformat(),
        "test_end": spans["test"]["last_timestamp"].isoformat(),
        "training_prevalence": spans["train"]["prevalence"],
        "validation_prevalence": spans["validation"]["prevalence"],
        "test_prevalence": spans["test"]["prevalence"],
        "model_parameters": config.booster.__dict__,
        "package_versions": {"python": platform.python_version(), "pyspark": version("pyspark")},
    }
    fitted = RiskModel(
        pipeline=model,
        calibrator=calibrator,
        features=list(S.MODEL_FEATURES),
        decision_threshold=threshold,
        alert_rate=rate,
        quantiles=[float(q) for q in grid],
        details=details,
    )
    return fitted, reports
