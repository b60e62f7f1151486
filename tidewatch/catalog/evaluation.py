"""Splits, alerts, metrics and account studies."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import schema as S
from tidewatch.catalog.base import KEY_SQL, KEYS, TIE_SQL, TXN_SQL, query, rounded
from tidewatch.functions import columns as C
from tidewatch.operators import accounts, alerts, metrics, splits
from tidewatch.operators.scoring import with_percentile
from tidewatch.plans import fixture
from tidewatch.plans.ordering import quantiles
from tidewatch.session import materialize, shared_folder
from tidewatch.sources import reports


def _txn(spark: SparkSession, folder: str) -> DataFrame:
    return fixture.transactions(spark, folder)


def _scored(spark: SparkSession, folder: str, score: str) -> DataFrame:
    return _txn(spark, folder).select(*KEYS, S.TARGET, F.col(score).alias("score"))


# --- splits ----------------------------------------------------------------

CUTS_SQL = f"""{TXN_SQL}, moments AS (
    SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) - 1 AS i, COUNT(*) OVER () AS n
    FROM (SELECT DISTINCT ts FROM txn)
), cuts AS (
    SELECT MAX(ts) FILTER (i = GREATEST(1, CAST(floor(n * 0.65::DOUBLE) AS BIGINT))) AS c1,
           MAX(ts) FILTER (i = CAST(floor(n * (0.65::DOUBLE + 0.10::DOUBLE)) AS BIGINT)) AS c2,
           MAX(ts) FILTER (i = CAST(floor(n * (0.65::DOUBLE + 0.10::DOUBLE + 0.10::DOUBLE)) AS BIGINT)) AS c3
    FROM moments
), split AS (
    SELECT txn.*, CASE WHEN ts < c1 THEN 'train' WHEN ts < c2 THEN 'calibration'
                       WHEN ts < c3 THEN 'validation' ELSE 'test' END AS split
    FROM txn, cuts
)"""


@query("temporal_split", f"{CUTS_SQL} SELECT {KEY_SQL}, split FROM split")
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.temporal_split(_txn(spark, folder)).select(*KEYS, "split")


@query(
    "split_statistics",
    f"""{CUTS_SQL} SELECT split, COUNT(*) AS rows, CAST(SUM(y) AS BIGINT) AS positives,
        ROUND(AVG(y), 9) AS prevalence, MIN(ts) AS first_timestamp, MAX(ts) AS last_timestamp
        FROM split GROUP BY split""",
)
def split_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = splits.split_statistics(splits.temporal_split(_txn(spark, folder)))
    return found.withColumn("prevalence", F.round("prevalence", 9))


@query(
    "chronological_split",
    f"""{TXN_SQL}, placed AS (
        SELECT *, ROW_NUMBER() OVER (ORDER BY ts, {TIE_SQL}) - 1 AS i, COUNT(*) OVER () AS n FROM txn
    )
    SELECT {KEY_SQL}, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train'
                           WHEN i < floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'validation'
                           ELSE 'test' END AS split
    FROM placed""",
)
def chronological_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.chronological_split(_txn(spark, folder), KEYS).select(*KEYS, "split")


WINDOWS_SQL = f"""{TXN_SQL}, moments AS (
    SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) - 1 AS i, COUNT(*) OVER () AS n
    FROM (SELECT DISTINCT ts FROM txn)
), starts AS (
    SELECT b, ts FROM moments, range(0, 14) AS blocks(b) WHERE i = b * (n // 14) + LEAST(b, n % 14)
), windows AS (
    SELECT w + 1 AS number, t.ts AS train_end, c.ts AS calibration_end, e.ts AS test_end
    FROM range(0, 4) AS ws(w)
    JOIN starts t ON t.b = 4 + 2 * w JOIN starts c ON c.b = 6 + 2 * w LEFT JOIN starts e ON e.b = 8 + 2 * w
)"""


@query(
    "window_boundaries",
    f"{WINDOWS_SQL} SELECT CAST(number AS BIGINT) AS number, train_end, calibration_end, test_end FROM windows",
)
def window_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    bounds = splits.window_boundaries(_txn(spark, folder))
    table = spark.createDataFrame(
        [(i, *b) for i, b in enumerate(bounds, start=1)], "number long, a long, b long, c long"
    )
    return table.select(
        "number",
        F.timestamp_micros("a").alias("train_end"),
        F.timestamp_micros("b").alias("calibration_end"),
        F.timestamp_micros("c").alias("test_end"),
    )


@query(
    "window_frames",
    f"""{WINDOWS_SQL}
    SELECT CAST(number AS BIGINT) AS number,
           COUNT(*) FILTER (ts < train_end) AS train_rows,
           COUNT(*) FILTER (ts >= train_end AND ts < calibration_end) AS calibration_rows,
           COUNT(*) FILTER (ts >= calibration_end AND (test_end IS NULL OR ts < test_end)) AS test_rows
    FROM txn, windows GROUP BY number""",
)
def window_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of every window's train, calibration and test range."""
    txn = _txn(spark, folder)
    tallies = [
        F.struct(
            F.lit(i).cast("long").alias("number"),
            F.count(F.when(splits.between(None, a), 1)).alias("train_rows"),
            F.count(F.when(splits.between(a, b), 1)).alias("calibration_rows"),
            F.count(F.when(splits.between(b, c), 1)).alias("test_rows"),
        ).alias(f"w{i}")
        for i, (a, b, c) in enumerate(splits.window_boundaries(txn), start=1)
    ]
    wide = txn.agg(*tallies)
    return wide.select(F.explode(F.array(*wide.columns)).alias("w")).select("w.*")


@query(
    "two_class_groups",
    f"""{TXN_SQL} SELECT receiver, COUNT(*) AS rows, CAST(SUM(y) AS BIGINT) AS positives
    FROM txn GROUP BY receiver HAVING MIN(y) <> MAX(y)""",
)
def two_class_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = splits.two_class_groups(_txn(spark, folder), S.RECEIVER)
    return found.withColumnRenamed(S.RECEIVER, "receiver")


@query("distinct_timestamps", f"{TXN_SQL} SELECT DISTINCT ts FROM txn")
def distinct_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return splits.distinct_instants(_txn(spark, folder)).withColumnRenamed(S.TIMESTAMP, "ts")


# --- alerts ----------------------------------------------------------------

_RANKED_SQL = f"""{TXN_SQL}, ranked AS (
    SELECT *, ROW_NUMBER() OVER (ORDER BY {{score}} DESC, {TIE_SQL}) AS place, COUNT(*) OVER () AS n FROM txn
)"""


def _alert_case(rate: float) -> str:
    return f"place <= GREATEST(1, ceil(n * {rate}::DOUBLE))"


@query(
    "alerts_duplicate_rows",
    f"""{TXN_SQL}, twice AS (SELECT * FROM txn UNION ALL SELECT * FROM txn), ranked AS (
        SELECT *, ROW_NUMBER() OVER (ORDER BY tied_score DESC, l_linenumber) AS place, COUNT(*) OVER () AS n FROM twice
    )
    SELECT tied_score AS score, l_linenumber, COUNT(*) AS rows, COUNT(*) FILTER ({_alert_case(0.05)}) AS alerts
    FROM ranked GROUP BY ALL""",
)
def alerts_duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly the budgeted rows, though every row is there twice and the tie-break repeats."""
    txn = _scored(spark, folder, "tied_score")
    marked = alerts.mark_alerts(txn.unionByName(txn), 0.05, ["l_linenumber"])
    return marked.groupBy("score", "l_linenumber").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_alert").cast("long")).alias("alerts")
    )


@query(
    "alerts_null_score",
    f"""{TXN_SQL}, spoilt AS (
        SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN tied_score END AS score,
               CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey END AS tie FROM txn
    ), ranked AS (
        SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, tie NULLS LAST, {TIE_SQL}) AS place,
               COUNT(*) OVER () AS n FROM spoilt
    )
    SELECT {KEY_SQL}, CAST({_alert_case(0.7)} AS INTEGER) AS is_alert FROM ranked""",
)
def alerts_null_score(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a score come last, and so do those without a tie-break among equals."""
    spoilt = _scored(spark, folder, "tied_score").withColumns(
        {
            "score": F.when(F.col("l_linenumber") % 2 == 0, F.col("score")),
            "tie": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey")),
        }
    )
    return alerts.mark_alerts(spoilt, 0.7, ["tie", *KEYS]).select(*KEYS, "is_alert")


def _register_alerts(score: str) -> None:
    @query(
        f"alerts_{score}",
        f"""{_RANKED_SQL.format(score=score)}
        SELECT {KEY_SQL}, CAST({_alert_case(0.005)} AS INTEGER) AS is_alert FROM ranked""",
    )
    def marked(spark: SparkSession, folder: str) -> DataFrame:
        return alerts.mark_alerts(_scored(spark, folder, score), 0.005, KEYS).select(*KEYS, "is_alert")

    per_rate = " UNION ALL ".join(
        f"""SELECT {rate}::DOUBLE AS alert_rate, MIN({score}) FILTER (hit) AS threshold,
            COUNT(*) FILTER (hit AND y = 1) AS tp, COUNT(*) FILTER (hit) AS alerts,
            SUM(y) AS positives, COUNT(*) AS n
            FROM (SELECT *, {_alert_case(rate)} AS hit FROM ranked)"""
        for rate in (0.001, 0.005, 0.01)
    )

    @query(
        f"metrics_at_alert_rate_{score}",
        f"""{_RANKED_SQL.format(score=score)}, tallies AS ({per_rate})
        SELECT alert_rate, ROUND(threshold, 9) AS threshold, ROUND(tp / alerts, 9) AS "precision",
               ROUND(tp / positives, 9) AS recall, ROUND((tp / alerts) / (positives / n), 6) AS lift,
               alerts
        FROM tallies""",
    )
    def at_rates(spark: SparkSession, folder: str) -> DataFrame:
        found = alerts.at_alert_rate(_scored(spark, folder, score), (0.001, 0.005, 0.01), KEYS)
        return found.select(
            "alert_rate",
            rounded("threshold", 9),
            rounded("precision", 9),
            rounded("recall", 9),
            rounded("lift", 6),
            "alerts",
        )

    @query(
        f"ranking_areas_{score}",
        f"""{TXN_SQL}, steps AS (SELECT {score} AS s, SUM(y) AS pos, COUNT(*) AS n FROM txn GROUP BY 1),
        run AS (SELECT s, pos, n, n - pos AS neg, SUM(pos) OVER w AS tp, SUM(n) OVER w AS k,
                       SUM(pos) OVER () AS p, SUM(n - pos) OVER () AS q,
                       SUM(n - pos) OVER w AS fp
                FROM steps WINDOW w AS (ORDER BY s DESC)),
        drawn AS (SELECT *, COALESCE(LAG(CAST(tp AS DOUBLE) / k) OVER (ORDER BY s DESC), 1) AS above FROM run)
        SELECT ROUND(SUM(CAST(pos AS DOUBLE) * tp / k) / MAX(p), 9) AS pr_auc,
               ROUND(SUM(CAST(pos AS DOUBLE) * ((q - fp) + 0.5 * neg)) / (MAX(p) * CAST(MAX(q) AS DOUBLE)), 9)
                   AS roc_auc,
               ROUND(SUM(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / k + above) / 2) / MAX(p), 9)
                   AS pr_trapezoid_area
        FROM drawn""",
    )
    def areas(spark: SparkSession, folder: str) -> DataFrame:
        found = metrics.ranking_areas(metrics.score_steps(_scored(spark, folder, score)))
        return found.select(*[rounded(c, 9) for c in found.columns])

    @query(
        f"roc_points_{score}",
        f"""{TXN_SQL}, steps AS (SELECT {score} AS s, SUM(y) AS pos, COUNT(*) AS n FROM txn GROUP BY 1),
        run AS (SELECT s, SUM(pos) OVER w AS tp, SUM(n - pos) OVER w AS fp,
                       SUM(pos) OVER () AS p, SUM(n - pos) OVER () AS q,
                       s < MAX(s) OVER () AND LEAD(pos) OVER w = pos AND LEAD(n) OVER w = n AS straight
                FROM steps WINDOW w AS (ORDER BY s DESC))
        SELECT ROUND(s, 9) AS threshold, ROUND(fp / q, 9) AS fpr, ROUND(tp / p, 9) AS tpr FROM run
        WHERE straight IS NOT TRUE
        UNION ALL SELECT 'inf'::DOUBLE, 0, 0""",
    )
    def roc(spark: SparkSession, folder: str) -> DataFrame:
        points = metrics.roc_points(metrics.score_steps(_scored(spark, folder, score)))
        return points.select(
            F.when(F.col("threshold") < F.lit(float("inf")), F.round("threshold", 9))
            .otherwise(F.col("threshold"))
            .alias("threshold"),
            rounded("fpr", 9),
            rounded("tpr", 9),
        )

    @query(
        f"pr_points_{score}",
        f"""{TXN_SQL}, steps AS (SELECT {score} AS s, SUM(y) AS pos, COUNT(*) AS n FROM txn GROUP BY 1),
        run AS (SELECT s, SUM(pos) OVER w AS tp, SUM(n) OVER w AS k, SUM(pos) OVER () AS p
                FROM steps WINDOW w AS (ORDER BY s DESC))
        SELECT ROUND(s, 9) AS threshold, ROUND(tp / p, 9) AS recall, ROUND(tp / k, 9) AS "precision" FROM run
        UNION ALL SELECT NULL, 0, 1""",
    )
    def pr(spark: SparkSession, folder: str) -> DataFrame:
        points = metrics.pr_points(metrics.score_steps(_scored(spark, folder, score)))
        return points.select(*[rounded(c, 9) for c in ("threshold", "recall", "precision")])


for _score in ("tied_score", "fine_score"):
    _register_alerts(_score)


@query(
    "metrics_at_threshold",
    f"""{TXN_SQL}, t AS (
        SELECT COUNT(*) FILTER (tied_score >= 0.09 AND y = 1) AS tp, COUNT(*) FILTER (tied_score >= 0.09) AS alerts,
               SUM(y) AS positives, COUNT(*) AS n FROM txn)
    SELECT 0.09::DOUBLE AS threshold, ROUND(tp / alerts, 9) AS "precision", ROUND(tp / positives, 9) AS recall,
           ROUND((tp / alerts) / (positives / n), 6) AS lift, ROUND(alerts / n, 9) AS alert_rate, alerts FROM t""",
)
def metrics_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    found = alerts.at_threshold(_scored(spark, folder, "tied_score"), 0.09)
    digits = {"precision": 9, "recall": 9, "lift": 6, "alert_rate": 9}
    return found.select("threshold", *[rounded(c, d) for c, d in digits.items()], "alerts")


@query(
    "expected_decision_cost",
    f"""{TXN_SQL} SELECT CAST(100 * COUNT(*) FILTER (fine_score < 0.6 AND y = 1)
            + COUNT(*) FILTER (fine_score >= 0.6 AND y = 0) AS DOUBLE) AS expected_cost FROM txn""",
)
def expected_decision_cost(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.decision_cost(_scored(spark, folder, "fine_score"), 0.6)


_TYPOLOGY_SQL = f"""{_RANKED_SQL.format(score="tied_score")}, recalls AS (
    SELECT CASE WHEN tied_score < 0.02 THEN 'small discount' ELSE NULLIF(typology, 'RF') END AS typology,
           COUNT(*) AS transactions, CAST(SUM(y) AS BIGINT) AS positives,
           CASE WHEN SUM(y) = 0 THEN 0 ELSE ROUND(COUNT(*) FILTER ({_alert_case(0.005)} AND y = 1) / SUM(y), 9) END
               AS recall
    FROM ranked GROUP BY 1
)"""


def _typologies(spark: SparkSession, folder: str) -> DataFrame:
    """One typology is made null, which must stay a group; small discounts are one without positives."""
    named = F.when(F.col("tied_score") < 0.02, "small discount").otherwise(F.nullif(F.col(S.TYPOLOGY), F.lit("RF")))
    txn = _txn(spark, folder).withColumn(S.TYPOLOGY, named)
    marked = alerts.mark_alerts(txn, 0.005, KEYS, "tied_score")
    return alerts.typology_recall(marked).withColumn("recall", F.round("recall", 9))


@query("typology_recall", f"{_TYPOLOGY_SQL} SELECT * FROM recalls")
def typology_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _typologies(spark, folder)


@query("ranked_typologies", f"{_TYPOLOGY_SQL} SELECT * FROM recalls WHERE positives > 0")
def ranked_typologies(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.ranked_typologies(_typologies(spark, folder))


@query(
    "typology_report",
    f"""{_TYPOLOGY_SQL} SELECT typology, transactions, positives, recall AS "recall_at_0.5%" FROM recalls
        """,
)
def typology_report(spark: SparkSession, folder: str) -> DataFrame:
    """The typology table written as CSV and read back with its types."""
    place = f"{shared_folder(spark)}/reports-{uuid4().hex}"
    reports.write_csv(_typologies(spark, folder).withColumnRenamed("recall", "recall_at_0.5%"), f"{place}/typology_results")
    return reports.read_report(spark, "typology", place, f"{place}/published")


@query(
    "report_sources",
    f"""{WINDOWS_SQL}, counted AS (
        SELECT concat('W', number) AS name, COUNT(*) FILTER (ts < train_end) AS a FROM txn, windows GROUP BY number
    ), typed AS (SELECT payment_type, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS p FROM txn GROUP BY payment_type)
    SELECT 'walk_forward' AS kind, 'published' AS place, name, CAST(a AS DOUBLE) AS value FROM counted
    UNION ALL SELECT 'typology', 'fresh', payment_type, CAST(n + p AS DOUBLE) FROM typed""",
)
def report_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All three kinds of result files: one in the fresh folder and in the published one, one in the latter alone, one in neither."""
    txn = _txn(spark, folder)
    place = f"{shared_folder(spark)}/reports-{uuid4().hex}"
    typed = txn.groupBy(F.col("Payment_type").alias("typology")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum(F.col(S.TARGET).cast("long")).alias("positives"), F.lit(0.5).alias("recall_at_0.5%")
    )
    reports.write_csv(typed, f"{place}/fresh/typology_results")
    reports.write_csv(typed.withColumn("positives", F.lit(-1)), f"{place}/published/typology_results")
    zero = [F.lit(0.0).alias(c) for c in ("recall_at_0.5%", "precision_at_0.5%", "lift_at_0.5%")]
    counted = studies_plan(txn).select("window", F.col("train_rows").cast("double").alias("pr_auc"), *zero)
    reports.write_csv(counted, f"{place}/published/walk_forward_results")
    found = {kind: reports.read_report(spark, kind, f"{place}/fresh", f"{place}/published") for kind in reports.REPORT_SCHEMAS}
    named = [
        found["walk_forward"].select(F.lit("walk_forward").alias("kind"), F.lit("published").alias("place"), F.col("window").alias("name"), F.col("pr_auc").alias("value")),
        found["typology"].select(F.lit("typology"), F.lit("fresh"), "typology", (F.col("transactions") + F.col("positives")).cast("double")),
        found["ablation"].select(F.lit("ablation"), F.lit("nowhere"), "model", "pr_auc"),
    ]
    return named[0].union(named[1]).union(named[2])


def studies_plan(txn: DataFrame) -> DataFrame:
    from tidewatch.plans.studies import backtest_plan

    return backtest_plan(txn)


@query(
    "split_report",
    f"""{CUTS_SQL} SELECT split, COUNT(*) AS rows, CAST(SUM(y) AS BIGINT) AS positives,
        ROUND(AVG(y), 9) AS prevalence FROM split GROUP BY split""",
)
def split_report(spark: SparkSession, folder: str) -> DataFrame:
    """Split statistics written as JSON and read back with their types."""
    place = f"{shared_folder(spark)}/reports-{uuid4().hex}/splits"
    found = splits.split_statistics(splits.temporal_split(_txn(spark, folder)))
    kept = found.select("split", "rows", "positives", F.round("prevalence", 9).alias("prevalence"))
    reports.write_json(kept, place)
    return spark.read.schema(kept.schema).json(place)


# --- scores ----------------------------------------------------------------


@query(
    "proper_scores",
    f"""{TXN_SQL}, c AS (SELECT y, LEAST(GREATEST(tied_score, 1e-8), 1 - 1e-8) AS p FROM txn)
    SELECT ROUND(AVG((p - y) * (p - y)), 9) AS brier_score,
           ROUND(AVG(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss FROM c""",
)
def proper_scores(spark: SparkSession, folder: str) -> DataFrame:
    clipped = metrics.clipped_scores(_scored(spark, folder, "tied_score"))
    found = metrics.proper_scores(clipped)
    return found.select(rounded("brier_score", 9), rounded("log_loss", 9))


@query(
    "compare_scores",
    f"""{TXN_SQL}, c AS (
        SELECT y, 'tied_score' AS variant, LEAST(GREATEST(tied_score, 1e-8), 1 - 1e-8) AS p FROM txn
        UNION ALL SELECT y, 'fine_score', LEAST(GREATEST(fine_score, 1e-8), 1 - 1e-8) FROM txn)
    SELECT variant, ROUND(AVG((p - y) * (p - y)), 9) AS brier_score,
           ROUND(AVG(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss FROM c GROUP BY variant""",
)
def compare_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Before and after figures of two score columns."""
    found = metrics.compare_scores(_txn(spark, folder), ["tied_score", "fine_score"])
    return found.select("variant", rounded("brier_score", 9), rounded("log_loss", 9))


def _bundle_sql(score: str) -> str:
    def part(rate: float) -> str:
        name = metrics.metric_names(rate)
        tp = f"COUNT(*) FILTER ({_alert_case(rate)} AND y = 1)"
        k = f"COUNT(*) FILTER ({_alert_case(rate)})"
        return (
            f'ROUND({tp} / {k}, 9) AS "{name}_precision", ROUND({tp} / SUM(y), 9) AS "{name}_recall", '
            f'ROUND(({tp} / {k}) / AVG(y), 6) AS "{name}_lift"'
        )

    return f"""{_RANKED_SQL.format(score=score)}, steps AS (
        SELECT LEAST(GREATEST({score}, 1e-8), 1 - 1e-8) AS s, SUM(y) AS pos, COUNT(*) AS n FROM txn GROUP BY 1
    ), run AS (
        SELECT *, SUM(pos) OVER w AS tp, SUM(n) OVER w AS k, SUM(n - pos) OVER w AS fp,
               SUM(pos) OVER () AS p, SUM(n - pos) OVER () AS q FROM steps WINDOW w AS (ORDER BY s DESC)
    ), areas AS (
        SELECT ROUND(SUM(CAST(pos AS DOUBLE) * tp / k) / MAX(p), 9) AS pr_auc,
               ROUND(SUM(CAST(pos AS DOUBLE) * ((q - fp) + 0.5 * (n - pos))) / (MAX(p) * CAST(MAX(q) AS DOUBLE)), 9)
                   AS roc_auc FROM run
    ), proper AS (
        SELECT ROUND(AVG((p - y) * (p - y)), 9) AS brier_score,
               ROUND(AVG(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss
        FROM (SELECT y, LEAST(GREATEST({score}, 1e-8), 1 - 1e-8) AS p FROM txn)
    ), budgets AS (SELECT {", ".join(part(r) for r in (0.001, 0.005, 0.01))} FROM ranked)
    SELECT * FROM areas, proper, budgets"""


@query("evaluation_bundle", _bundle_sql("fine_score"))
def evaluation_bundle(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.evaluate(_scored(spark, folder, "fine_score"), KEYS)
    return found.select(
        *[F.round(F.col(f"`{c}`"), 6 if c.endswith("_lift") else 9).alias(c) for c in found.columns]
    )


@query(
    "reliability_curve",
    f"""{TXN_SQL}, edges AS (
        SELECT unnest(quantile_cont(fine_score, [i / 10.0 FOR i IN range(1, 10)])) AS e FROM txn
    ), binned AS (
        SELECT y, fine_score AS p, (SELECT list(e) FROM edges) AS es FROM txn
    )
    SELECT CAST(len(list_filter(es, lambda e: e < p)) AS INTEGER) AS bin, COUNT(*) AS rows,
           ROUND(AVG(y), 9) AS observed, ROUND(AVG(p), 9) AS predicted
    FROM binned GROUP BY 1""",
)
def reliability_curve(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.reliability(_scored(spark, folder, "fine_score"))
    return found.select("bin", "rows", rounded("observed", 9), rounded("predicted", 9))


@query(
    "score_quantiles",
    f"""{TXN_SQL}, q AS (
        SELECT quantile_cont(fine_score, [i / 1000.0 FOR i IN range(0, 1001)]) AS v FROM txn
    )
    SELECT CAST(i AS BIGINT) AS i, ROUND(v[i + 1], 9) AS quantile FROM q, range(0, 1001) AS r(i)""",
)
def score_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """The 1,001 stored quantiles of a score, exact."""
    grid = quantiles(_scored(spark, folder, "fine_score"), {"score": [i / 1000.0 for i in range(1001)]})
    table = spark.createDataFrame(list(enumerate(grid["score"])), "i long, quantile double")
    return table.select("i", rounded("quantile", 9))


@query(
    "score_percentiles",
    f"""{TXN_SQL}, q AS (
        SELECT quantile_disc(tied_score, [i / 100.0 FOR i IN range(0, 101)]) AS v FROM txn
    )
    SELECT tied_score AS score, ROUND(MAX(len(list_filter(v, lambda x: x < tied_score)) * 100.0 / 101), 9)
               AS percentile, COUNT(*) AS rows
    FROM txn, q GROUP BY tied_score""",
)
def score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile of every score in a stored list with many repeats."""
    scored = materialize(_scored(spark, folder, "tied_score").select("score"), "percentile-scores")
    grid = quantiles(scored, {"score": [i / 100.0 for i in range(101)]})["score"]
    placed = with_percentile(scored, grid, "score", "percentile")
    return placed.groupBy("score").agg(
        F.round(F.max("percentile"), 9).alias("percentile"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "score_logits",
    f"""{TXN_SQL}, c AS (SELECT *, LEAST(GREATEST(tied_score, 1e-6), 1 - 1e-6) AS p FROM txn)
    SELECT {KEY_SQL}, ROUND(ln(p / (1 - p)), 9) AS score_logit FROM c""",
)
def score_logits(spark: SparkSession, folder: str) -> DataFrame:
    df = _scored(spark, folder, "tied_score")
    return df.select(*KEYS, F.round(C.logit(F.col("score")), 9).alias("score_logit"))


# --- accounts --------------------------------------------------------------

def _unseen_sql(held_out: str | None) -> str:
    known = "split = 'train'" + (f" AND paid_in <> '{held_out}'" if held_out else "")
    return f"""{CUTS_SQL}, seen AS (
    SELECT DISTINCT account FROM (
        SELECT sender AS account FROM split WHERE {known}
        UNION SELECT receiver FROM split WHERE {known})
), flagged AS (
    SELECT split.*, sender IN (SELECT account FROM seen) AS sender_seen,
           receiver IN (SELECT account FROM seen) AS receiver_seen
    FROM split WHERE split = 'test'
)"""


def _train_and_test(spark: SparkSession, folder: str, held_out: str | None) -> tuple[DataFrame, DataFrame]:
    """The split; ``held_out`` names a payment region whose payments aren't trained on."""
    parts = splits.temporal_split(_txn(spark, folder)).withColumn("score", F.col("fine_score"))
    train = parts.where(F.col("split") == "train")
    if held_out:
        train = train.where(F.col(S.PAID_IN) != held_out)
    return train, parts.where(F.col("split") == "test")


_SUBGROUP_SQL = f""", grouped AS (
        SELECT *, 'standard_out_of_time' AS subgroup FROM flagged
        UNION ALL SELECT *, CASE WHEN sender_seen AND receiver_seen THEN 'both_parties_seen'
                                 ELSE 'unseen_entity' END FROM flagged
    ), ranked AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY subgroup ORDER BY fine_score DESC, {TIE_SQL}) AS place,
               COUNT(*) OVER (PARTITION BY subgroup) AS n FROM grouped
    ), steps AS (
        SELECT subgroup, fine_score AS s, SUM(y) AS pos, COUNT(*) AS n FROM grouped GROUP BY 1, 2
    ), run AS (
        SELECT *, SUM(pos) OVER w AS tp, SUM(n) OVER w AS k, SUM(n - pos) OVER w AS fp,
               SUM(n - pos) OVER (PARTITION BY subgroup) AS q
        FROM steps WINDOW w AS (PARTITION BY subgroup ORDER BY s DESC)
    ), areas AS (
        SELECT subgroup, SUM(CAST(pos AS DOUBLE) * tp / k) / SUM(pos) AS pr_auc,
               SUM(CAST(pos AS DOUBLE) * ((q - fp) + 0.5 * (n - pos))) / (SUM(pos) * CAST(MAX(q) AS DOUBLE)) AS roc_auc
        FROM run GROUP BY subgroup
    ), budgets AS (
        SELECT subgroup, COUNT(*) AS transactions, CAST(SUM(y) AS BIGINT) AS positives, AVG(y) AS prevalence,
               COUNT(*) FILTER ({_alert_case(0.005)} AND y = 1) AS tp, COUNT(*) FILTER ({_alert_case(0.005)}) AS k,
               COUNT(*) FILTER (fine_score >= 0.6 AND y = 1) AS ftp, COUNT(*) FILTER (fine_score >= 0.6) AS fk
        FROM ranked GROUP BY subgroup
    )
    SELECT subgroup, COALESCE(transactions, 0) AS transactions, COALESCE(positives, 0) AS positives,
           ROUND(prevalence, 9) AS prevalence,
           CASE WHEN positives > 0 THEN ROUND(pr_auc, 9) END AS pr_auc,
           CASE WHEN positives > 0 THEN ROUND(roc_auc, 9) END AS roc_auc,
           CASE WHEN positives > 0 THEN ROUND(tp / k, 9) END AS precision_at_alert_rate,
           CASE WHEN positives > 0 THEN ROUND(tp / positives, 9) END AS recall_at_alert_rate,
           CASE WHEN positives > 0 THEN ROUND(tp / k / prevalence, 6) END AS lift_at_alert_rate,
           CASE WHEN transactions > 0 THEN 0.6::DOUBLE END AS fixed_threshold, ROUND(ftp / fk, 9) AS fixed_precision,
           CASE WHEN positives > 0 THEN ROUND(ftp / positives, 9) WHEN positives = 0 THEN 0 END AS fixed_recall,
           CASE WHEN positives > 0 THEN ROUND(ftp / fk / prevalence, 6) WHEN positives = 0 THEN 0 END AS fixed_lift,
           ROUND(fk / transactions, 9) AS fixed_alert_rate, fk AS fixed_alerts
    FROM (VALUES ('standard_out_of_time'), ('both_parties_seen'), ('unseen_entity')) names(subgroup)
    LEFT JOIN budgets USING (subgroup) LEFT JOIN areas USING (subgroup)"""


def _register_unseen(suffix: str, held_out: str | None) -> None:
    """Over all training rows, and as a study of parties never seen with one region held out."""
    base = _unseen_sql(held_out)

    @query(f"known_accounts{suffix}", f"{base} SELECT account FROM seen")
    def known_accounts(spark: SparkSession, folder: str) -> DataFrame:
        return accounts.known_accounts(_train_and_test(spark, folder, held_out)[0])

    @query(
        f"unseen_flags{suffix}",
        f"""{base} SELECT {KEY_SQL}, sender_seen, receiver_seen, sender_seen AND receiver_seen AS both_seen,
        NOT (sender_seen AND receiver_seen) AS unseen_entity FROM flagged""",
    )
    def unseen_flags(spark: SparkSession, folder: str) -> DataFrame:
        train, test = _train_and_test(spark, folder, held_out)
        flagged = accounts.flag_unseen(test, accounts.known_accounts(train))
        return flagged.select(*KEYS, "sender_seen", "receiver_seen", "both_seen", "unseen_entity")

    @query(
        f"unseen_flags_filtered{suffix}",
        f"""{base} SELECT {KEY_SQL}, sender_seen, receiver_seen, sender_seen AND receiver_seen AS both_seen,
        NOT (sender_seen AND receiver_seen) AS unseen_entity FROM flagged""",
    )
    def unseen_flags_filtered(spark: SparkSession, folder: str) -> DataFrame:
        """The same flags with a Bloom filter in front of the join."""
        train, test = _train_and_test(spark, folder, held_out)
        flagged = accounts.flag_unseen_filtered(materialize(test, "test-rows"), accounts.known_accounts(train))
        return flagged.select(*KEYS, "sender_seen", "receiver_seen", "both_seen", "unseen_entity")

    @query(f"unseen_subgroups{suffix}", base + _SUBGROUP_SQL)
    def unseen_subgroups(spark: SparkSession, folder: str) -> DataFrame:
        from tidewatch.plans.studies import unseen_entities

        train, test = _train_and_test(spark, folder, held_out)
        found = unseen_entities(test, train, KEYS, threshold=0.6)
        exact = ("subgroup", "transactions", "positives", "fixed_threshold", "fixed_alerts")
        return found.select(
            *[F.col(c) if c in exact else F.round(c, 6 if "lift" in c else 9).alias(c) for c in found.columns]
        )


_register_unseen("", None)
_register_unseen("_region_held_out", "ASIA")
