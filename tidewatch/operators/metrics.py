"""Score quality: ranking areas, proper scores, curves and reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidewatch import schema as S
from tidewatch.config import AlertConfig
from tidewatch.functions.columns import SCORE_CLIP, clip, ratio
from tidewatch.operators.alerts import budget
from tidewatch.plans.grouped import first_rows
from tidewatch.plans.ordering import ROW, ROWS_PER_PIECE, cut_points, next_along, pieces_for, quantiles, running_before
from tidewatch.session import materialize, stored

#: A whole table is a single group of this column.
ALL = "__all"


def clipped_scores(df: DataFrame, score: str = "score", target: str = S.TARGET) -> DataFrame:
    """Scores away from 0 and 1; fails unless both classes are present."""
    _both_classes(df.agg(F.min(target).alias("low"), F.max(target).alias("high")).first(), target)
    return df.withColumn(score, clip(F.col(score), SCORE_CLIP))


def _both_classes(span: Row, target: str) -> None:
    if span["low"] == span["high"]:
        raise ValueError(f"column {target} holds {span['low']} alone, not both target classes")


def score_steps(
    df: DataFrame,
    score: str = "score",
    target: str = S.TARGET,
    by: Sequence[str] = (),
    rows: int | None = None,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """One row per distinct score, from high to low, with counts at and above it.

    ``pos``/``n`` are at the score, ``pos_above``/``n_above`` strictly above. ``rows``
    (counted if not given) decides into how many pieces the order is cut. Several passes read the scores, so the columns
    they need are stored once.
    """
    df = stored(df.select(*dict.fromkeys([*by, score, target])), "scores")
    rows = df.count() if rows is None else rows
    steps = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum((F.col(target) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    cuts = cut_points(df, score, pieces_for(rows, rows_per_piece))
    return running_before(
        steps, list(by), "score", {"pos_above": "pos", "n_above": "n"}, cuts=cuts, descending=True
    )


def ranking_areas(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, ROC area with half credit for ties, and the trapezoid PR area."""
    return steps.groupBy(*by).agg(*_area_sums()).select(*by, *_areas())


def _area_sums() -> list[Column]:
    pos, n = F.col("pos"), F.col("n")
    hits, taken = F.col("pos_above") + pos, F.col("n_above") + n
    neg, neg_above = n - pos, F.col("n_above") - F.col("pos_above")
    precision = hits / taken
    precision_above = F.when(F.col("n_above") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("pos_above"), F.col("n_above"))
    )
    return [
        F.sum(pos).alias("positives"),
        F.sum(neg).alias("negatives"),
        F.sum(pos * precision).alias("weighted_precision"),
        F.sum(pos.cast("double") * (neg_above + neg * F.lit(0.5))).alias("outranked"),
        F.sum(pos * (precision + precision_above) / 2).alias("trapezoids"),
    ]


def _areas() -> list[Column]:
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return [
        F.try_divide("weighted_precision", "positives").alias("pr_auc"),
        (F.lit(1.0) - F.try_divide(F.col("outranked"), pairs)).alias("roc_auc"),
        F.try_divide("trapezoids", "positives").alias("pr_trapezoid_area"),
    ]


def proper_scores(
    df: DataFrame, score: str = "score", target: str = S.TARGET, by: Sequence[str] = ()
) -> DataFrame:
    """Brier score and log loss."""
    return df.groupBy(*by).agg(*_proper(F.col(score), F.col(target).cast("double")))


def _proper(p: Column, y: Column) -> tuple[Column, Column]:
    return (
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
    )


def metric_names(rate: float) -> str:
    return f"alert_{rate:.3%}"


def evaluate(
    df: DataFrame,
    tie_break: Sequence[str],
    score: str = "score",
    target: str = S.TARGET,
    rates: Sequence[float] = AlertConfig().report_rates,
) -> DataFrame:
    """All headline figures as one row.

    The columns it needs are stored once; one aggregate gives counts and proper scores, and one table of
    score steps both the areas and the cuts of all rates.
    """
    p, y = F.col(score), F.col(target).cast("double")
    narrow = df.select(score, target, *tie_break).withColumn(score, clip(F.col(score), SCORE_CLIP))
    stored = materialize(narrow.withColumn(ROW, F.monotonically_increasing_id()), "evaluated")
    seen = stored.agg(F.min(target).alias("low"), F.max(target).alias("high"), F.count(F.lit(1)).alias("rows"), *_proper(p, y)).first()
    _both_classes(seen, target)
    rows = seen["rows"]
    steps = materialize(score_steps(stored, score, target, rows=rows), "evaluated-steps")
    sizes = [budget(rows, rate) for rate in rates]
    step = F.struct("score", "n", "pos", "n_above", "pos_above")
    at = [F.max(F.when((F.col("n_above") < k) & (F.col("n_above") + F.col("n") >= k), step)).alias(f"at_{i}") for i, k in enumerate(sizes)]
    found = steps.agg(*_area_sums(), *at).select("positives", *_areas(), *[f"at_{i}" for i in range(len(sizes))]).first()
    cuts = [found[f"at_{i}"] for i in range(len(sizes))]
    hits = _hits(stored, list(zip(sizes, cuts, strict=True)), tie_break, score, target)
    figures = {c: found[c] for c in ("pr_auc", "roc_auc")} | {c: seen[c] for c in ("brier_score", "log_loss")}
    for rate, size, tp in zip(rates, sizes, hits, strict=True):
        precision, base = tp / size, found["positives"] / rows
        figures |= {f"{metric_names(rate)}_{m}": v for m, v in (("precision", precision), ("recall", tp / found["positives"]), ("lift", precision / base))}
    return df.sparkSession.createDataFrame([tuple(figures.values())], ", ".join(f"`{c}` double" for c in figures))


def _hits(stored: DataFrame, cuts: list[tuple[int, Row]], tie_break: Sequence[str], score: str, target: str) -> list[int]:
    """Positives among the first rows of each cut: those above its score, and among the rows that share it the first in tie-break order."""
    shared = {(c["score"], size - c["n_above"]): c["n"] for size, c in cuts if size - c["n_above"] < c["n"]}
    tied: dict = {}
    event = (F.col(target) == 1).cast("long")
    few = [key for key, n in shared.items() if n <= ROWS_PER_PIECE]
    if few:
        window = Window.partitionBy(score).orderBy(*[F.col(c).asc_nulls_last() for c in tie_break], ROW)
        placed = stored.where(F.col(score).isin([v for v, _ in few])).withColumn("place", F.row_number().over(window))
        sums = placed.agg(*[F.sum(F.when((F.col(score) == v) & (F.col("place") <= left), event)).alias(f"hits_{i}") for i, (v, left) in enumerate(few)])
        tied = dict(zip(few, sums.first(), strict=True))
    for value, left in shared.keys() - tied.keys():
        equal = stored.where(F.col(score) == value).withColumn(ALL, F.lit(0))
        wanted = stored.sparkSession.createDataFrame([(0, left)], f"{ALL} int, rank long")
        order = [*[(c, False) for c in tie_break], (ROW, False)]
        tied[value, left] = first_rows(equal, [ALL], wanted, order, event, shared[value, left]).first()["tally"]
    return [c["pos_above"] + (tied[c["score"], size - c["n_above"]] if size - c["n_above"] < c["n"] else c["pos"]) for size, c in cuts]


def roc_points(steps: DataFrame, corners: bool = True, rows_per_piece: int | None = None) -> DataFrame:
    """(false positive rate, true positive rate) at each distinct score, plus the origin.

    With ``corners`` the points between which the curve goes straight on are left out: a score is dropped if the next lower one
    adds as many rows of each class as it does itself. The highest and the lowest score always stay. The
    comparison runs piece by piece, and the first score of a piece is handed to the end of the one before.
    """
    totals = steps.agg(
        F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.max("score").alias("highest"), F.count(F.lit(1)).alias("steps")
    ).first()
    points = steps
    if corners:
        cuts = cut_points(steps, "score", pieces_for(totals["steps"], rows_per_piece))
        points = next_along(steps, "score", {"next_pos": "pos", "next_n": "n"}, cuts, descending=True)
        straight = (F.col("next_pos") == F.col("pos")) & (F.col("next_n") == F.col("n")) & (F.col("score") != F.lit(totals["highest"]))
        points = points.where(~F.coalesce(straight, F.lit(False)))
    counted = points.select(
        F.col("score").alias("threshold"),
        (F.col("n_above") + F.col("n") - F.col("pos_above") - F.col("pos")).alias("fp"),
        (F.col("pos_above") + F.col("pos")).alias("tp"),
    )
    origin = steps.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, fp long, tp long")
    return counted.unionByName(origin).select(
        "threshold", ratio(F.col("fp"), F.lit(totals["q"])).alias("fpr"), ratio(F.col("tp"), F.lit(totals["p"])).alias("tpr")
    )


def pr_points(steps: DataFrame) -> DataFrame:
    """(recall, precision) at each distinct score, plus the end point (0, 1)."""
    totals = steps.agg(F.sum("pos").alias("p"))
    counted = steps.select(
        F.col("score").alias("threshold"),
        (F.col("n_above") + F.col("n")).alias("taken"),
        (F.col("pos_above") + F.col("pos")).alias("tp"),
    )
    points = _over_totals(counted, totals).select(
        "threshold",
        ratio(F.col("tp"), F.col("p")).alias("recall"),
        ratio(F.col("tp"), F.col("taken")).alias("precision"),
    )
    end = totals.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.unionByName(end)


def _over_totals(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the totals, a single row, to every row."""
    return counted.withColumns({c: F.lit(v) for c, v in totals.first().asDict().items()})


def reliability(
    df: DataFrame, bins: int = 10, score: str = "score", target: str = S.TARGET
) -> DataFrame:
    """Observed frequency and mean score per quantile bin; empty bins don't appear."""
    df = stored(df.select(score, target), "reliability-scores")
    edges = quantiles(df, {score: [i / bins for i in range(bins + 1)]})[score]
    inner = [e for e in edges[1:-1] if e is not None]
    bin_number = sum(((F.col(score) > F.lit(e)).cast("int") for e in inner), F.lit(0))
    return (
        df.withColumn("bin", bin_number)
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.col(target).cast("double")).alias("observed"),
            F.avg(F.col(score)).alias("predicted"),
        )
    )


def compare_scores(
    df: DataFrame, scores: Sequence[str], target: str = S.TARGET
) -> DataFrame:
    """Brier score and log loss of several score columns, one row each."""
    p = F.col("score")
    stacked = df.select(
        F.col(target).cast("double").alias("y"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("variant"), clip(F.col(s), SCORE_CLIP).alias("score"))
                    for s in scores
                ]
            )
        ).alias("cell"),
    ).select("y", "cell.*")
    return stacked.groupBy("variant").agg(
        F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier_score"),
        F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"),
    )
