"""Preprocessing statistics, models, studies and scoring."""

from __future__ import annotations

import math
from functools import partial
from uuid import uuid4

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch import schema as S
from tidewatch.catalog.base import KEY_SQL, KEYS, TXN_SQL, query, rounded
from tidewatch.catalog.data import BROKEN_SQL, contract_rows
from tidewatch.catalog.evaluation import CUTS_SQL as _CUTS_SQL, WINDOWS_SQL
from tidewatch.config import PreprocessingConfig, training_config
from tidewatch.operators import attribution, drift, models, preprocessing, splits
from tidewatch.operators.scoring import score, score_requests
from tidewatch.plans import fixture, studies
from tidewatch.plans.features import build_features
from tidewatch.session import materialize, shared_folder
from tidewatch.sources.artifacts import RiskModel
from tidewatch.streaming import scoring as streams

FULL = training_config()
#: Batches in which ``stream_batch_figures`` takes its rows.
STREAM_BATCHES = 4


# Where this session keeps the feature table and the model of a test folder.
_FEATURES: dict[tuple[str, str], str] = {}
_MODELS: dict[tuple[str, str], str] = {}
_LOADED: dict[str, RiskModel] = {}


def features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table of the test transactions, built once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FEATURES:
        path = f"{shared_folder(spark)}/feature-table-{uuid4().hex}"
        # The scores among the test columns are no part of the feature table; both exchanges would carry them.
        rows = fixture.transactions(spark, folder).drop("tied_score", "fine_score")
        build_features(rows, KEYS).write.option("compression", "zstd").parquet(path)
        _FEATURES[key] = path
    return spark.read.parquet(_FEATURES[key])


def trained_at(spark: SparkSession, folder: str) -> str:
    """Where the model of the test transactions lies, with all its trees and its reports; trained once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MODELS:
        model, reports = studies.train_risk_model(features(spark, folder), KEYS, FULL)
        path = f"{shared_folder(spark)}/model-{uuid4().hex}"
        model.save(spark, path)
        writes = [partial(report.write.parquet, f"{path}/reports/{name}") for name, report in reports.items()]
        studies.at_once(spark, writes, len(writes))
        _MODELS[key] = path
    return _MODELS[key]


def trained(spark: SparkSession, folder: str) -> tuple[RiskModel, str]:
    """That model and its folder."""
    path = trained_at(spark, folder)
    if path not in _LOADED:
        _LOADED[path] = RiskModel.load(spark, path)
    return _LOADED[path], path


@query(
    "imputation_medians",
    f"""{TXN_SQL} SELECT 'Amount' AS feature, ROUND(quantile_cont(amount, 0.5), 6) AS median FROM txn
        UNION ALL SELECT 'log_amount', ROUND(quantile_cont(ln(1 + amount), 0.5), 6) FROM txn""",
)
def imputation_medians(spark: SparkSession, folder: str) -> DataFrame:
    txn = fixture.transactions(spark, folder).withColumn("log_amount", F.log1p("Amount"))
    found = preprocessing.medians(txn, ["Amount", "log_amount"])
    return spark.createDataFrame(list(found.items()), "feature string, median double").select(
        "feature", rounded("median")
    )


_CATEGORY_COLUMNS = {
    "Payment_type": "payment_type",
    "Payment_currency": "paid_in",
    "Sender_bank_location": "sender_place",
}


@query(
    "category_counts",
    f"{TXN_SQL}"
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", {s} AS category, COUNT(*) AS n FROM txn GROUP BY {s}"
        for c, s in _CATEGORY_COLUMNS.items()
    ),
)
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return preprocessing.category_counts(fixture.transactions(spark, folder), list(_CATEGORY_COLUMNS))


@query(
    "category_statistics",
    f"""{TXN_SQL}, c AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {s} AS category, COUNT(*) AS n FROM txn GROUP BY {s}"
        for c, s in _CATEGORY_COLUMNS.items()
    )
    + """), typical AS (SELECT AVG(n) AS m FROM c WHERE "column" = 'Sender_bank_location')
    SELECT "column", arg_min(category, (-n, category)) AS mode,
           COALESCE(string_agg(category, ',' ORDER BY category) FILTER (n >= ceil(m)), '') AS frequent,
           COALESCE(string_agg(category, ',' ORDER BY category) FILTER (n < ceil(m)), '') AS rare
    FROM c, typical GROUP BY "column\"""",
)
def category_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Mode, kept and pooled categories, with the cut at the average size of a bank location."""
    txn = fixture.transactions(spark, folder)
    sizes = txn.groupBy("Sender_bank_location").count()
    limit = math.ceil(sizes.agg(F.avg("count")).first()[0])
    dictionary, codes = preprocessing.fit_dictionary(txn, list(_CATEGORY_COLUMNS), PreprocessingConfig(min_category_count=limit))
    modes = spark.createDataFrame([(c, k.mode) for c, k in codes.items()], "column string, mode string")
    names = lambda kept: F.array_join(F.sort_array(F.collect_list(F.when(F.col("kept") == kept, F.col("category")))), ",")
    lists = dictionary.groupBy("column").agg(names(True).alias("frequent"), names(False).alias("rare"))
    return modes.join(lists, "column")


@query(
    "class_weight",
    f"""{TXN_SQL} SELECT ROUND((COUNT(*) - SUM(y)) / GREATEST(SUM(y), 1), 9) AS positive_weight FROM txn""",
)
def class_weight(spark: SparkSession, folder: str) -> DataFrame:
    weight = models.positive_weight(fixture.transactions(spark, folder))
    return spark.createDataFrame([(weight,)], "positive_weight double").select(rounded("positive_weight", 9))


_ENCODED = {**_CATEGORY_COLUMNS, "Received_currency": "received_in", "Receiver_bank_location": "receiver_place"}
_COUNTS_SQL = " UNION ALL ".join(f"SELECT {i} AS place, {c} AS category, COUNT(*) AS n FROM train GROUP BY {c}" for i, c in enumerate(_ENCODED.values()))


@query(
    "encoded_features",
    f"""{_CUTS_SQL}, spoilt AS (
        SELECT *, CASE WHEN l_linenumber <> 2 THEN payment_type END AS kind,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE amount END AS known FROM split
    ), train AS (
        SELECT * REPLACE (kind AS payment_type) FROM spoilt WHERE split = 'train' AND receiver_place <> 'PERU'
    ), counted AS ({_COUNTS_SQL}), modes AS (
        SELECT place, arg_min(category, (-n, category)) FILTER (category IS NOT NULL) AS mode,
               COALESCE(SUM(n) FILTER (category IS NULL), 0) AS missing FROM counted GROUP BY place
    ), filled AS (
        SELECT place, category, n + CASE WHEN category = mode THEN missing ELSE 0 END AS n
        FROM counted JOIN modes USING (place) WHERE category IS NOT NULL
    ), limits AS (
        SELECT CAST(AVG(n) AS BIGINT) AS least FROM filled WHERE place = 2
    ), coded AS (
        SELECT place, category, n >= least AS kept,
               CASE WHEN n >= least THEN row_number() OVER (PARTITION BY place, n >= least ORDER BY category) - 1
                    ELSE COUNT(*) FILTER (n >= least) OVER (PARTITION BY place) END AS slot
        FROM filled, limits
    ), widths AS (
        SELECT place, COUNT(*) FILTER (kept) + CAST(bool_or(NOT kept) AS INT) AS width FROM coded GROUP BY place
    ), starts AS (
        SELECT place, CAST(1 + COALESCE(SUM(width) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM widths
    ), middle AS (SELECT quantile_cont(known, 0.5) AS m FROM train)
    SELECT {KEY_SQL}, split, ROUND(COALESCE(known, m), 6) AS amount, """
    + ", ".join(f"s{i}.start + c{i}.slot AS slot_{i}" for i in range(len(_ENCODED)))
    + " FROM spoilt, middle "
    + " ".join(
        f"JOIN starts s{i} ON s{i}.place = {i} JOIN modes m{i} ON m{i}.place = {i} "
        f"LEFT JOIN coded c{i} ON c{i}.place = {i} AND c{i}.category = COALESCE({'kind' if c == 'payment_type' else c}, m{i}.mode)"
        for i, c in enumerate(_ENCODED.values())
    ),
)
def encoded_features(spark: SparkSession, folder: str) -> DataFrame:
    """The amount and the place of each category's one in the vector; null where training never saw the category.

    One payment type in some is missing, and a country is left out of training.
    """
    # Splitting and fitting read the rows several times, the joins behind them are done once.
    kept = fixture.transactions(spark, folder).select(*KEYS, S.TIMESTAMP, S.AMOUNT, *_ENCODED)
    parts = splits.temporal_split(materialize(kept, "rows-to-encode")).withColumns(
        {
            "Payment_type": F.when(F.col("l_linenumber") != 2, F.col("Payment_type")),
            S.AMOUNT: F.when(F.col("l_linenumber") != 3, F.col(S.AMOUNT)),
        }
    )
    train = parts.where((F.col("split") == "train") & (F.col("Receiver_bank_location") != "PERU"))
    least = round(train.groupBy("Sender_bank_location").count().agg(F.avg("count")).first()[0])
    columns = list(_ENCODED)
    fitted = preprocessing.fit_preprocessor(train, [S.AMOUNT, *columns], PreprocessingConfig(min_category_count=least))
    widths = fitted.stages[1].getOrDefault("slots")
    value = vector_to_array(preprocessing.FEATURES)
    encoded = fitted.transform(parts).withColumn("values", value)
    start, slots = 1, []
    for i, width in enumerate(widths):
        at = F.array_position(F.slice("values", start + 1, width), 1.0) + (start - 1)
        slots.append(F.when(F.array_contains(F.slice("values", start + 1, width), 1.0), at).alias(f"slot_{i}"))
        start += width
    return encoded.select(*KEYS, "split", F.round(F.get("values", F.lit(0)), 6).alias("amount"), *slots)


@query("encoded_feature_table")
def encoded_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """Imputed, pooled and one-hot encoded vectors of the whole feature table."""
    parts = splits.temporal_split(features(spark, folder))
    fitted = preprocessing.fit_preprocessor(parts.where(F.col("split") == "train"))
    encoded = fitted.transform(parts)
    return encoded.select(*KEYS, "split", F.col(preprocessing.FEATURES).cast("string").alias("features"))


# --- curves by Newton steps ------------------------------------------------

_STEPS = 25


def _newton_sql(points: str, n: int, ridge: str, scale: str) -> str:
    """Newton steps as CTEs over ``points`` (x0.., y, w); n slopes and an intercept, solved by elimination in a list."""
    size = n + 1
    xs = [f"x{i}" for i in range(n)] + ["1"]
    parts = [f"start AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(size))})", f"s0 AS (SELECT * FROM start)"]
    for k in range(_STEPS):
        margin = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
        sums = ", ".join(
            [f"SUM(w * (q - y) * {x}) / {scale} AS g{i}" for i, x in enumerate(xs)]
            + [f"SUM(w * q * (1 - q) * {xs[i]} * {xs[j]}) / {scale} AS h{i}{j}" for i in range(size) for j in range(i, size)]
        )
        g = [f"(g{i} + {ridge} * b{i})" if i < n else f"g{i}" for i in range(size)]
        h = [[f"(h{min(i, j)}{max(i, j)}{f' + {ridge}' if i == j < n else ''})" for j in range(size)] for i in range(size)]
        parts.append(
            f"t{k} AS (SELECT {sums}, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(size))} "
            f"FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS q FROM {points}, s{k}))"
        )
        if size == 2:
            det = f"({h[0][0]} * {h[1][1]} - {h[0][1]} * {h[0][1]})"
            moved = [f"({h[1][1]} * {g[0]} - {h[0][1]} * {g[1]}) / {det}", f"({h[0][0]} * {g[1]} - {h[0][1]} * {g[0]}) / {det}"]
        else:
            minor = lambda a, b, c, d: f"({a} * {d} - {b} * {c})"
            det3 = lambda m: (
                f"({m[0][0]} * {minor(m[1][1], m[1][2], m[2][1], m[2][2])} - {m[0][1]} * {minor(m[1][0], m[1][2], m[2][0], m[2][2])} "
                f"+ {m[0][2]} * {minor(m[1][0], m[1][1], m[2][0], m[2][1])})"
            )
            swapped = lambda j: [[g[r] if c == j else h[r][c] for c in range(3)] for r in range(3)]
            moved = [f"{det3(swapped(j))} / {det3(h)}" for j in range(3)]
        parts.append(f"s{k + 1} AS (SELECT {', '.join(f'b{i} - {m} AS b{i}' for i, m in enumerate(moved))} FROM t{k})")
    return ", ".join(parts)


_CALIBRATION_SQL = f"""{TXN_SQL}, points AS (
    SELECT *, ln(p / (1 - p)) AS x0, 1 AS w FROM (SELECT *, LEAST(GREATEST(fine_score, 1e-6), 1 - 1e-6) AS p FROM txn)
), {_newton_sql('points', 1, '1', '1')}"""


@query("calibration_fit", f"{_CALIBRATION_SQL} SELECT ROUND(b0, 6) AS slope, ROUND(b1, 6) AS intercept FROM s{_STEPS}")
def calibration_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Slope and intercept of the calibration curve of a score."""
    curve = models.fit_calibrator(fixture.transactions(spark, folder), "fine_score")
    return spark.createDataFrame([(curve.slope, curve.intercept)], "slope double, intercept double").select(rounded("slope"), rounded("intercept"))


@query(
    "calibrated_scores",
    f"""{_CALIBRATION_SQL} SELECT {KEY_SQL}, ROUND(1 / (1 + exp(-(b0 * x0 + b1))), 9) AS probability FROM points, s{_STEPS}""",
)
def calibrated_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every score through its calibration curve."""
    txn = fixture.transactions(spark, folder)
    curve = models.fit_calibrator(txn, "fine_score")
    return txn.select(*KEYS, F.round(curve.apply(F.col("fine_score")), 9).alias("probability"))


@query(
    "baseline_fit",
    f"""{TXN_SQL}, raw AS (
        SELECT ln(1 + amount) AS a, CAST(sender_place <> receiver_place AS DOUBLE) AS c, y FROM txn
    ), spread AS (
        SELECT STDDEV_SAMP(a) AS sa, STDDEV_SAMP(c) AS sc, COUNT(*) AS n, SUM(y) AS p FROM raw
    ), points AS (
        SELECT a / sa AS x0, c / sc AS x1, y, CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS w FROM raw, spread
    ), {_newton_sql('points', 2, '1e-4', 'SUM(w)')}
    SELECT ROUND(b0, 6) AS log_amount, ROUND(b1, 6) AS cross_border, ROUND(b2, 6) AS intercept FROM s{_STEPS}""",
)
def baseline_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The logistic baseline on two scaled features with balanced classes, by Newton steps."""
    txn = fixture.transactions(spark, folder).select(
        F.log1p(S.AMOUNT).alias("log_amount"),
        (F.col("Sender_bank_location") != F.col("Receiver_bank_location")).cast("double").alias("cross_border"),
        S.TARGET,
    )
    fitted = models.newton_baseline(txn, ["log_amount", "cross_border"])
    return spark.createDataFrame([tuple(fitted.values())], ", ".join(f"{c} double" for c in fitted)).select(*[rounded(c) for c in fitted])


def _report(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.parquet(f"{trained_at(spark, folder)}/reports/{name}")

    return run


for _name in ("test_metrics", "baseline_test_metrics", "calibration", "typology", "reliability"):
    query(f"trained_model_{_name}")(_report(_name))


@query("trained_model_metadata")
def trained_model_metadata(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = trained(spark, folder)
    return model.metadata(spark)


@query("batch_scores")
def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = trained(spark, folder)
    return score_requests(_inputs(spark, folder), model, KEYS)[0]


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).select(*KEYS, *S.MODEL_FEATURES)


@query(
    "score_contract",
    f"""WITH checked AS ({BROKEN_SQL})
    SELECT 'scored' AS reason, COUNT(*) AS n FROM checked WHERE broken = ''
    UNION ALL
    SELECT reason, COUNT(*) AS n FROM (SELECT unnest(string_split(broken, ',')) AS reason FROM checked WHERE broken <> '')
    GROUP BY reason""",
)
def score_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Rows scored, and rows set aside for each reason."""
    model, _ = trained(spark, folder)
    scored, aside = score_requests(contract_rows(spark, folder), model, KEYS)
    proper = scored.where(F.col("risk_probability").between(0, 1))
    return (
        proper.agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("scored").alias("reason"), "n")
        .unionByName(aside.select(F.explode("violations").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
    )


@query(
    "batch_and_stream_scores",
    "SELECT COUNT(*) AS rows, COUNT(*) AS scored, CAST(0 AS BIGINT) AS different FROM lineitem",
)
def batch_and_stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the table, rows with a score, and rows whose batch and stream scores differ."""
    batch, stream = batch_scores(spark, folder), stream_scores(spark, folder)
    names = ["risk_probability", "requires_review", "risk_percentile"]
    other = stream.select(*KEYS, F.struct(*names).alias("streamed"))
    both = batch.select(*KEYS, F.struct(*names).alias("batched")).join(other, KEYS, "full")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.col("batched.risk_probability")).alias("scored"),
        F.count_if(~F.col("batched").eqNullSafe(F.col("streamed"))).alias("different"),
    )


@query("stream_scores")
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table scored as a stream of files, run to its end."""
    model, _ = trained(spark, folder)
    source = features(spark, folder)
    rows = streams.feature_stream(spark, _FEATURES[(spark.sparkContext.applicationId, folder)], source.schema)
    rows = rows.select(*KEYS, *S.MODEL_FEATURES)
    output = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    for started in streams.start_all(rows, model, KEYS, output, f"{output}/checkpoint"):
        started.awaitTermination()
    return spark.read.parquet(f"{output}/scores")


@query("model_importances")
def model_importances(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = trained(spark, folder)
    return attribution.model_importances(spark, model.pipeline)


@query("importance_totals", "SELECT 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS negative FROM (SELECT COUNT(*) FROM lineitem)")
def importance_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of the importances of any model: they add up to 1, come in order and aren't negative."""
    model, _ = trained(spark, folder)
    found = attribution.model_importances(spark, model.pipeline, top=None)
    placed = found.coalesce(1).withColumn("place", F.monotonically_increasing_id())
    before = F.lag("importance").over(Window.partitionBy(F.lit(0)).orderBy("place"))
    return placed.withColumn("before", before).agg(
        F.round(F.sum("importance"), 9).alias("total"),
        F.count_if(F.col("importance") > F.col("before")).alias("out_of_order"),
        F.count_if(F.col("importance") < 0).alias("negative"),
    )


def preprocessing_only(model: RiskModel):
    from pyspark.ml import PipelineModel

    return PipelineModel(model.pipeline.stages[:-1])


def _explainer(spark: SparkSession, folder: str, model: RiskModel) -> attribution.PathExplainer:
    train = splits.temporal_split(features(spark, folder)).where(F.col("split") == "train")
    return attribution.PathExplainer.of(spark, model.pipeline, preprocessing_only(model).transform(train))


@query("attribution_summary")
def attribution_summary(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = trained(spark, folder)
    explainer, rows = _explainer(spark, folder, model), features(spark, folder)
    return attribution.attribution_summary(explainer.totals(preprocessing_only(model).transform(rows)), explainer.names, rows.count())


@query("alert_attributions")
def alert_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """Every contribution to the margins of the transactions under review."""
    model, _ = trained(spark, folder)
    scored = score(features(spark, folder), model, [*KEYS, *S.MODEL_FEATURES]).where("requires_review")
    attributed = _explainer(spark, folder, model).attribute(preprocessing_only(model).transform(scored), KEYS)
    return attribution.explain_rows(attributed, KEYS)


@query("attribution_totals", "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS apart FROM lineitem")
def attribution_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, and those whose contributions and the model's mean don't add up to the model's own margin."""
    model, _ = trained(spark, folder)
    explainer = _explainer(spark, folder, model)
    margin = 2 * vector_to_array("rawPrediction")[1]
    encoded = preprocessing_only(model).transform(features(spark, folder))
    own = explainer.model.transform(encoded).withColumn("margin", margin)
    summed, _ = explainer.contributions(own, [*KEYS, "margin"], presence=False)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    apart = F.abs(total + explainer.base - F.col("margin")) > 1e-6
    return summed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(apart).alias("apart"))


@query("walk_forward_backtest")
def walk_forward_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return studies.walk_forward(features(spark, folder), KEYS, FULL)


@query("feature_ablation")
def feature_ablation(spark: SparkSession, folder: str) -> DataFrame:
    return studies.feature_ablation(features(spark, folder), KEYS, FULL)


@query("unseen_entity_study")
def unseen_entity_study(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated test scores by whether both parties were seen in training."""
    model, _ = trained(spark, folder)
    parts = splits.temporal_split(features(spark, folder))
    test = parts.where(F.col("split") == "test")
    scored = score(test, model, [*KEYS, S.TARGET, S.SENDER, S.RECEIVER]).withColumn(
        studies.SCORE, F.col("risk_probability")
    )
    return studies.unseen_entities(
        materialize(scored, "study-scores"),
        parts.where(F.col("split") == "train"),
        KEYS,
        threshold=model.decision_threshold,
    )


_Y = "CAST(COALESCE(SUM(y) FILTER ({0}), 0) AS BIGINT)"


def _part_sql(name: str, inside: str, alerts: bool = False) -> str:
    out = f"COUNT(*) FILTER ({inside}) AS {name}_rows, {_Y.format(inside)} AS {name}_positives"
    return out + f", CAST(GREATEST(1, ceil(COUNT(*) FILTER ({inside}) * 0.005::DOUBLE)) AS BIGINT) AS alerts" if alerts else out


@query(
    "backtest_plan",
    f"""{WINDOWS_SQL}, held AS (
        SELECT concat('W', number) AS window, {_part_sql('train', 'ts < train_end')},
               {_part_sql('calibration', 'ts >= train_end AND ts < calibration_end')},
               {_part_sql('test', 'ts >= calibration_end AND (test_end IS NULL OR ts < test_end)', True)}
        FROM txn, windows GROUP BY number
    )
    SELECT *, train_positives BETWEEN 1 AND train_rows - 1 AND calibration_positives BETWEEN 1 AND calibration_rows - 1
              AND test_positives BETWEEN 1 AND test_rows - 1 AS usable FROM held""",
)
def backtest_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, positives and alerts of the windows the backtest fits."""
    return studies.backtest_plan(fixture.transactions(spark, folder))


_ABLATION_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS model, {sum(f in S.NUMERIC_FEATURES for f in fs)} AS numbers, {sum(f in S.CATEGORICAL_FEATURES for f in fs)} AS categories, * FROM held"
    for name, fs in S.ABLATION_FEATURE_SETS.items()
)


@query(
    "ablation_plan",
    f"""{_CUTS_SQL}, held AS (
        SELECT {_part_sql('train', "split = 'train'")}, {_part_sql('calibration', "split = 'calibration'")},
               {_part_sql('test', "split = 'test'", True)} FROM split
    ) {_ABLATION_SQL}""",
)
def ablation_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Feature sets, rows, positives and alerts of the models the ablation fits."""
    return studies.ablation_plan(fixture.transactions(spark, folder))


@query(
    "trained_model_spans",
    f"""{_CUTS_SQL}, held AS (SELECT split, MIN(ts) AS first, MAX(ts) AS last, ROUND(AVG(y), 9) AS prevalence FROM split GROUP BY split)
    SELECT '2.1.0' AS model_version, {len(S.MODEL_FEATURES)} AS features, 0.005::DOUBLE AS alert_rate, 1001 AS quantiles,
           strftime(tr.first, '%Y-%m-%dT%H:%M:%S') AS training_start, strftime(tr.last, '%Y-%m-%dT%H:%M:%S') AS training_end,
           strftime(te.first, '%Y-%m-%dT%H:%M:%S') AS test_start, strftime(te.last, '%Y-%m-%dT%H:%M:%S') AS test_end,
           tr.prevalence AS training_prevalence, va.prevalence AS validation_prevalence, te.prevalence AS test_prevalence
    FROM held tr, held va, held te WHERE tr.split = 'train' AND va.split = 'validation' AND te.split = 'test'""",
)
def trained_model_spans(spark: SparkSession, folder: str) -> DataFrame:
    """What the saved model says of itself and its data."""
    model, _ = trained(spark, folder)
    details = F.from_json("details", "map<string,string>")
    text = [details[c].alias(c) for c in ("training_start", "training_end", "test_start", "test_end")]
    shares = [F.round(details[c].cast("double"), 9).alias(c) for c in ("training_prevalence", "validation_prevalence", "test_prevalence")]
    return model.metadata(spark).select("model_version", F.size("features").alias("features"), "alert_rate", F.size("quantiles").alias("quantiles"), *text, *shares)


@query(
    "stream_batch_figures",
    f"""WITH checked AS ({BROKEN_SQL})
    SELECT COUNT(*) AS rows, COUNT(*) FILTER (broken <> '') AS aside, COUNT(*) FILTER (broken = '') AS scored, TRUE AS same_statistics FROM checked""",
)
def stream_batch_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of a stream's batches, observed while they are scored and merged, against those of the batch run."""
    model, _ = trained(spark, folder)
    place = f"{shared_folder(spark)}/observed-{uuid4().hex}"
    arriving = contract_rows(spark, folder)
    files = streams.files_per_batch(arriving.count(), STREAM_BATCHES)
    arriving.repartition(STREAM_BATCHES * files).write.parquet(f"{place}/in")
    source = spark.read.parquet(f"{place}/in")
    rows = streams.feature_stream(spark, f"{place}/in", source.schema, files_per_trigger=files)
    started = streams.start_scoring(streams.observed(rows, model, KEYS), f"{place}/out", f"{place}/checkpoint")
    started.awaitTermination()
    batches = streams.batch_figures(started)
    merged = drift.merged_statistics(batches.withColumn("feature", F.lit("risk_probability")))
    scored = score_requests(source, model, KEYS)[0]
    whole = drift.baseline_statistics(scored, ["risk_probability"])
    near = lambda c: F.abs(F.col(f"m.{c}") - F.col(f"w.{c}")) < 1e-9
    same = merged.alias("m").join(whole.alias("w"), "feature").select((near("mean") & near("std") & near("min") & near("max")).alias("same_statistics"))
    totals = batches.agg(F.sum("rows").alias("rows"), F.sum("aside").alias("aside"), F.sum("n").alias("scored")).first()
    return same.select(*[F.lit(totals[c]).alias(c) for c in ("rows", "aside", "scored")], "same_statistics")
