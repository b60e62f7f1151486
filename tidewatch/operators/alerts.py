"""Alert selection under a fixed review budget, and what it catches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schema as S
from tidewatch.functions.columns import ratio
from tidewatch.plans.grouped import first_rows
from tidewatch.plans.ordering import ROW, Cut, exact_rows

IS_ALERT = "is_alert"


def budget(rows: int, rate: float) -> int:
    """Number of alerts a rate allows; the float product decides, as published."""
    if rows <= 0:
        raise ValueError(f"an empty table has no alerts to take (alert_rate {rate})")
    if not 0 < rate <= 1:
        raise ValueError(f"alert_rate {rate} is outside (0, 1]")
    return max(1, math.ceil(rows * rate))


def alert_cuts(
    df: DataFrame,
    rates: Sequence[float],
    tie_break: Sequence[str],
    score: str = "score",
    rows: int | None = None,
    rows_per_piece: int | None = None,
) -> tuple[DataFrame, list[Cut]]:
    """The table, and for each rate the cut that holds exactly the budgeted rows of highest score.

    Ties are taken in tie-break order, null and NaN last at each level; rows that tie entirely are
    told apart by a row number, which the returned table then has. Finding a cut moves no rows, so a score
    shared by much of the table costs nothing extra.
    """
    order = [(score, True), *[(c, False) for c in tie_break]]
    return exact_rows(df, order, lambda n: [budget(n, rate) for rate in rates], rows, rows_per_piece)


def mark_alerts(
    df: DataFrame, rate: float, tie_break: Sequence[str], score: str = "score"
) -> DataFrame:
    """Append ``is_alert``: 1 for exactly the budgeted number of highest scores."""
    df, cuts = alert_cuts(df, [rate], tie_break, score)
    return df.withColumn(IS_ALERT, cuts[0].inside().cast("int")).drop(ROW)


def alert_threshold(cut: Cut) -> float | None:
    """The lowest score among the alerts; none if rows without a score are among them."""
    return None if cut.values[0] is None else float(cut.values[0])


def confusion(predicted: Column, target: Column) -> dict[str, Column]:
    """True and false positives and false negatives, as aggregates of one pass."""
    hit, event = F.coalesce(predicted, F.lit(False)), target == 1

    def tally(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))

    return {
        "tp": tally(hit & event),
        "fp": tally(hit & ~event),
        "fn": tally(~hit & event),
        "alerts": tally(hit),
        "rows": F.count(F.lit(1)),
        "positives": tally(event),
    }


def _rates(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    base = ratio(F.col("positives"), F.col("rows"))
    return counts.select(
        *keep,
        "alert_rate",
        "threshold",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(precision, base).alias("lift"),
        "alerts",
    )


def at_alert_rate(
    df: DataFrame,
    rates: Sequence[float],
    tie_break: Sequence[str],
    score: str = "score",
    target: str = S.TARGET,
    rows: int | None = None,
) -> DataFrame:
    """Precision, recall and lift of the top scores, one row per rate."""
    df, cuts = alert_cuts(df, rates, tie_break, score, rows)
    wide = df.agg(
        *[
            F.struct(
                F.lit(float(rate)).alias("alert_rate"),
                F.lit(alert_threshold(cut)).cast("double").alias("threshold"),
                *[c.alias(n) for n, c in confusion(cut.inside(), F.col(target)).items()],
            ).alias(f"at_{i}")
            for i, (rate, cut) in enumerate(zip(rates, cuts, strict=True))
        ]
    )
    stacked = wide.select(F.explode(F.array(*[f"at_{i}" for i in range(len(rates))])).alias("at"))
    return _rates(stacked.select("at.*"))


def at_alert_rate_by(
    df: DataFrame,
    by: Sequence[str],
    rates: Sequence[float],
    tie_break: Sequence[str],
    score: str = "score",
    target: str = S.TARGET,
    rows: int | None = None,
    rows_per_piece: int | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """The same figures for every group at once: ``by`` and one row per rate, each group with a budget of its own.

    ``df`` is a stored table whose column ``__row`` tells rows apart that tie on everything else. ``steps`` are its
    ``score_steps`` by group, if the caller has them. No group is looked at by itself, so the
    number of jobs doesn't grow with the number of groups.
    """
    if any(not 0 < rate <= 1 for rate in rates):
        raise ValueError(f"alert rates {rates} aren't all in (0, 1]")
    rows = df.count() if rows is None else rows
    event = F.col(target) == 1
    shares = F.explode(F.array(*[F.lit(float(rate)) for rate in rates]))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(event.cast("long")), F.lit(0)).alias("positives"))
    wanted = totals.select("*", shares.alias("alert_rate")).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("rows").cast("double") * F.col("alert_rate")))
    )
    order = [(score, True), *[(c, False) for c in tie_break], (ROW, False)]
    if steps is not None:
        steps = steps.select(
            *by, F.col("score").alias(score), F.col("pos").alias("tally"), "n", F.col("pos_above").alias("tally_before"), F.col("n_above").alias("n_before")
        )
    found = first_rows(df, by, wanted, order, event, rows, rows_per_piece, steps)
    counted = found.select(
        *by,
        "alert_rate",
        F.col("first").cast("double").alias("threshold"),
        F.col("tally").alias("tp"),
        (F.col("inside") - F.col("tally")).alias("fp"),
        (F.col("positives") - F.col("tally")).alias("fn"),
        F.col("inside").alias("alerts"),
        "rows",
        "positives",
    )
    return _rates(counted, by)


def at_threshold(
    df: DataFrame,
    threshold: float,
    score: str = "score",
    target: str = S.TARGET,
    by: Sequence[str] = (),
) -> DataFrame:
    """The same figures for a fixed cut decided elsewhere."""
    tallies = confusion(F.col(score) >= F.lit(float(threshold)), F.col(target))
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in tallies.items()])
    return _rates(
        counts.where(F.col("rows") > 0).withColumns(
            {
                "threshold": F.lit(float(threshold)),
                "alert_rate": ratio(F.col("alerts"), F.col("rows")),
            }
        ),
        keep=by,
    )


def decision_cost(
    df: DataFrame,
    threshold: float,
    miss_cost: float = 100.0,
    false_alarm_cost: float = 1.0,
    score: str = "score",
    target: str = S.TARGET,
) -> DataFrame:
    tallies = confusion(F.col(score) >= F.lit(float(threshold)), F.col(target))
    return df.agg(
        (F.lit(miss_cost) * tallies["fn"] + F.lit(false_alarm_cost) * tallies["fp"]).alias("expected_cost")
    )


def typology_recall(
    df: DataFrame, typology: str = S.TYPOLOGY, target: str = S.TARGET, alert: str = IS_ALERT
) -> DataFrame:
    """Per typology (null is one), how many of its positives the global alerts hold."""
    event = F.col(target) == 1
    counts = df.groupBy(F.col(typology).alias("typology")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(event.cast("long")).alias("positives"),
        F.sum((event & (F.col(alert) == 1)).cast("long")).alias("caught"),
    )
    return counts.select(
        "typology", "transactions", "positives", ratio(F.col("caught"), F.col("positives")).alias("recall")
    )


def ranked_typologies(recalls: DataFrame) -> DataFrame:
    """Typologies with positives, best recall first."""
    return recalls.where(F.col("positives") > 0).orderBy(F.desc("recall"), F.asc("typology"))
