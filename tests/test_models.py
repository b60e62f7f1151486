"""Preprocessing, models, calibration, attribution, scoring and streaming."""

import datetime as dt
import random
import re
import time
from dataclasses import replace
from functools import partial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.config import PreprocessingConfig, training_config
from tidewatch.operators import attribution, models, preprocessing
from tidewatch.operators.scoring import score, score_requests
from tidewatch.plans import studies
from tidewatch.sources.artifacts import RiskModel
from tidewatch.streaming import scoring as streams

FAST = training_config(fast=True)
TINY = replace(FAST, booster=replace(FAST.booster, trees=2))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    pick = random.Random(4)
    rows = []
    for i in range(900):
        y = int(pick.random() < 0.3)
        values = {c: pick.random() for c in S.NUMERIC_FEATURES}
        values["Amount"] = 100 * (pick.random() + y)
        values["log_amount"] = float(np.log1p(values["Amount"]))
        values |= {c: float(pick.random() < 0.5) for c in S.FLAG_FEATURES}
        values |= {c: float(pick.randrange(5)) for c in S.NUMERIC_FEATURES if "_txn_count" in c or "degree" in c}
        values["pair_transaction_count"] = float(pick.randrange(5))
        values["seconds_since_sender_txn"] = float(pick.randrange(-1, 900))
        cats = {c: pick.choice(["x", "y", "z"]) for c in S.CATEGORICAL_FEATURES}
        at = dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)
        who = (f"s{pick.randrange(40)}", f"r{pick.randrange(40) + (40 if i > 800 else 0)}")
        rows.append((i, *values.values(), *cats.values(), at, y, pick.choice(["a", "b", None]), *who))
    names = ["id", *S.NUMERIC_FEATURES, *S.CATEGORICAL_FEATURES, "timestamp", S.TARGET, S.TYPOLOGY, S.SENDER, S.RECEIVER]
    path = str(tmp_path_factory.mktemp("table") / "t")
    spark.createDataFrame(rows, names).withColumn("id", F.col("id").cast("int")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def trained(spark, table):
    return studies.train_risk_model(table, ["id"], FAST)


def test_imputation_and_pooling(spark):
    rows = [(1.0, "a")] * 30 + [(3.0, "b")] * 25 + [(None, "rare")] * 3 + [(float("nan"), None)] * 2
    train = spark.createDataFrame(rows, "Amount double, Payment_type string")
    features = ["Amount", "Payment_type"]
    dictionary, codes = preprocessing.fit_dictionary(train, ["Payment_type"])
    assert codes["Payment_type"] == preprocessing.ColumnCodes("a", 2, 1)
    assert {(r["category"], r["n"], r["kept"], r["slot"]) for r in dictionary.collect()} == {("a", 32, True, 0), ("b", 25, True, 1), ("rare", 3, False, 2)}
    fitted = preprocessing.fit_preprocessor(train, features)
    probes = spark.createDataFrame(
        [(None, "a"), (9.0, "b"), (9.0, "rare"), (9.0, "never seen"), (float("nan"), None)], train.schema
    )
    encoded = fitted.transform(probes)
    found = [list(r[0]) for r in encoded.select(vector_to_array("features")).collect()]
    assert found == [[1, 1, 0, 0], [9, 0, 1, 0], [9, 0, 0, 1], [9, 0, 0, 0], [1, 1, 0, 0]]
    names = {r["slot"]: r["feature"] for r in preprocessing.slot_names(spark, fitted).collect()}
    assert names == {0: "Amount", 1: "Payment_type=a", 2: "Payment_type=b", 3: "Payment_type=__pooled"}


def test_mode_takes_the_smallest_on_ties(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c'\\",)], "Payment_type string")
    _, codes = preprocessing.fit_dictionary(train, ["Payment_type"], PreprocessingConfig(1))
    assert codes["Payment_type"] == preprocessing.ColumnCodes("a", 3, 0)
    fitted = preprocessing.fit_preprocessor(train, ["Payment_type"], PreprocessingConfig(2))
    assert fitted.transform(train).count() == 5


def test_a_million_categories(spark):
    """Numbered in pieces along the names; the driver gets a few numbers for each column."""
    many = spark.range(1_000_000).selectExpr("concat('c', id) AS Payment_type")
    train = many.unionByName(many.where("Payment_type < 'c2'")).unionByName(spark.createDataFrame([("a",)] * 30 + [(None,)] * 5, "Payment_type string"))
    dictionary, codes = preprocessing.fit_dictionary(train, ["Payment_type"], PreprocessingConfig(2), rows_per_piece=20_000)
    twice = sorted(f"c{i}" for i in range(1_000_000) if f"c{i}" < "c2")
    assert codes["Payment_type"] == preprocessing.ColumnCodes("a", len(twice) + 1, 1_000_000 - len(twice))
    probes = dictionary.where(F.col("category").isin("a", twice[0], twice[777], twice[-1], "c5"))
    assert {r["category"]: r["slot"] for r in probes.collect()} == {
        "a": 0, twice[0]: 1, twice[777]: 778, twice[-1]: len(twice), "c5": len(twice) + 1
    }
    assert dictionary.where("kept").agg(F.count_distinct("slot")).first()[0] == len(twice) + 1
    fitted = preprocessing.fit_preprocessor(train, ["Payment_type"])
    probes = spark.createDataFrame([("a",), ("c999999",), ("never",)], "Payment_type string")
    found = [list(r[0]) for r in fitted.transform(probes).select(vector_to_array("features")).collect()]
    assert found == [[1, 0], [0, 1], [0, 0]]


def test_medians_are_those_of_numpy(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None), (11.0, None)], "a double, b double")
    assert preprocessing.medians(df, ["a", "b"]) == {"a": 6.0, "b": 0.0}


def test_calibrator_solves_the_penalised_problem(spark):
    pick = np.random.default_rng(3)
    p = pick.uniform(0.02, 0.98, 500)
    y = (pick.uniform(size=500) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "raw_probability double, Is_laundering int")
    fitted = models.fit_calibrator(df)
    x = np.log(p / (1 - p))
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        gradient = np.array([((q - y) * x).sum() + w[0], (q - y).sum()])
        s = q * (1 - q)
        hessian = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum()]])
        w -= np.linalg.solve(hessian, gradient)
    assert (fitted.slope, fitted.intercept) == (pytest.approx(w[0], abs=1e-5), pytest.approx(w[1], abs=1e-5))
    with pytest.raises(ValueError, match="both target classes"):
        models.fit_calibrator(df.where("Is_laundering = 1"))


def test_class_weight(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "Is_laundering int")
    assert models.positive_weight(df) == 3
    assert models.positive_weight(df.where("Is_laundering = 0")) == 3


def test_training_reports(trained):
    model, reports = trained
    assert set(reports) == {
        "test_metrics", "baseline_test_metrics", "calibration", "reliability", "split_statistics", "typology",
    }
    # Amount separates the classes well, so both models must rank far above chance.
    assert model.details["test_metrics"]["roc_auc"] > 0.9
    assert model.details["baseline_test_metrics"]["roc_auc"] > 0.8
    assert len(model.quantiles) == 1001 and model.quantiles == sorted(model.quantiles)
    assert sum(r["transactions"] for r in reports["typology"].collect()) == 135


def test_saved_model_scores_the_same(spark, table, trained, tmp_path):
    model, _ = trained
    model.save(spark, str(tmp_path / "m"))
    loaded = RiskModel.load(spark, str(tmp_path / "m"))
    assert loaded.details["training_prevalence"] == model.details["training_prevalence"]
    a = score(table, model, ["id"]).orderBy("id").collect()
    b = score(table, loaded, ["id"]).orderBy("id").collect()
    assert a == b
    for r in a:
        assert 0 <= r["risk_probability"] <= 1
        assert r["requires_review"] == (r["risk_probability"] >= model.decision_threshold)
        assert r["risk_percentile"] == pytest.approx(np.searchsorted(model.quantiles, r["risk_probability"]) * 100 / 1001)


def test_stream_scores_what_the_batch_scores(spark, table, trained, tmp_path):
    model, _ = trained
    folder = str(tmp_path / "in")
    broken = table.limit(10).withColumn("id", F.col("id") + 10_000).withColumn("Amount", F.lit(-1.0))
    table.unionByName(broken).repartition(3).write.parquet(folder)
    rows = streams.feature_stream(spark, folder, table.schema, files_per_trigger=1)
    query = streams.start_scoring(
        streams.score_stream(rows, model, ["id"]), str(tmp_path / "out"), str(tmp_path / "check")
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert got == score(table, model, ["id"]).orderBy("id").collect()
    again = streams.rejected_stream(spark.read.parquet(folder), ["id"])
    assert again.count() == 10


def test_generated_scoring_methods_are_short_enough_to_be_compiled(spark, table, trained, capsys):
    """HotSpot interprets a method of more than 8,000 bytes for good, which took most of the time of scoring."""
    model, _ = trained
    keys = ["id", *(f"key_{i}" for i in range(4))]
    rows = table.withColumns({k: F.col("id").cast("string") for k in keys[1:]}).select(*keys, *S.MODEL_FEATURES)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for scored in (score(rows, model, keys), *score_requests(rows, model, keys)):
            scored.explain(mode="codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) <= 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_contributions_add_up_to_the_margin(spark, table, trained):
    model, _ = trained
    encoded = PipelineModel(model.pipeline.stages[:-1]).transform(table)
    explainer = attribution.PathExplainer.of(spark, model.pipeline, encoded)
    attributed = explainer.attribute(encoded, ["id"])
    sums = {r["id"]: r["s"] + explainer.base for r in attributed.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    margins = model.pipeline.transform(table).select("id", (2 * vector_to_array("rawPrediction")[1]).alias("m")).collect()
    for r in margins:
        # Spark's raw prediction is half the log-odds margin of its own probability.
        assert sums[r["id"]] == pytest.approx(r["m"], abs=1e-9)
    # The weights of the leaves are those of the rows, so the base is the mean margin.
    assert explainer.base == pytest.approx(np.mean([r["m"] for r in margins]), abs=1e-9)
    summary = attribution.attribution_summary(attributed, explainer.names, table.count()).collect()
    assert summary[0]["feature"] in ("Amount", "log_amount")
    assert len(summary) == explainer.names.count()
    one = attribution.explain_rows(attributed.where("id = 5"), ["id"]).orderBy("place").collect()
    assert sum(r["contribution"] for r in one) + explainer.base == pytest.approx(sums[5])
    assert [r["abs_contribution"] for r in one] == sorted((r["abs_contribution"] for r in one), reverse=True)
    top = attribution.model_importances(spark, model.pipeline).collect()
    assert len(top) == 15 and top[0]["importance"] == max(r["importance"] for r in top)
    whole = attribution.model_importances(spark, model.pipeline, top=None)
    assert whole.agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_path_changes_by_walking_the_trees(spark):
    """Two features, each row's way down written out by hand."""
    rows = [(float(a), float(b), int(a > 2) * 2 + int(b > 1) + int(a > 2 and b > 1)) for a in range(5) for b in range(4)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([(a, b, int(y > 1)) for a, b, y in rows], "a double, b double, label int")
    )
    model = GBTClassifier(maxIter=3, maxDepth=3, minInstancesPerNode=1, seed=1).fit(df)
    paths = attribution.leaf_paths(spark, model).collect()
    for number, tree in enumerate(model.trees):
        mine = [r for r in paths if r["tree"] == number]
        assert len({r["leaf"] for r in mine}) == (tree.numNodes + 1) // 2
        assert max(r["depth"] for r in mine) == tree.depth
    names = spark.createDataFrame([(0, "a"), (1, "b")], "slot long, feature string")
    model.setLeafCol("__leaves")
    leaves = {tuple(r["features"].toArray()): r["__leaves"].toArray().astype(int) for r in model.transform(df).collect()}
    values = {(r["tree"], r["leaf"]): r["value"] for r in paths}
    under = {}
    for x, found in leaves.items():
        for t, leaf in enumerate(found):
            for r in paths:
                if (r["tree"], r["leaf"]) == (t, leaf):
                    under.setdefault((t, r["node"]), []).append(values[t, leaf])
    mean = {k: np.mean(v) for k, v in under.items()}
    want = {}
    for x, found in leaves.items():
        for t, leaf in enumerate(found):
            way = sorted((r for r in paths if (r["tree"], r["leaf"]) == (t, leaf)), key=lambda r: r["depth"])
            for here, there in zip(way, way[1:]):
                want[x, here["feature"]] = want.get((x, here["feature"]), 0) + mean[t, there["node"]] - mean[t, here["node"]]
    pipeline = PipelineModel([model])
    weighed = attribution.PathExplainer.of(spark, pipeline, df, names)
    got = {((r["a"], r["b"]), "ab".index(r["feature"])): r["contribution"] for r in weighed.attribute(df, ["a", "b"]).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_studies_return_the_published_columns(spark, table, trained):
    model, _ = trained
    ablation = studies.feature_ablation(table, ["id"], TINY)
    assert [r["model"] for r in ablation.collect()] == list(S.ABLATION_FEATURE_SETS)
    assert ablation.columns == ["model", "pr_auc", "recall_at_0.5%"]
    walked = studies.walk_forward(table, ["id"], TINY).collect()
    assert [r["window"] for r in walked] == ["W1", "W2", "W3", "W4"]
    assert all(0 <= r["pr_auc"] <= 1 for r in walked)
    test = table.where("id >= 700").withColumn("score", F.col("Amount") / 200)
    found = {
        r["subgroup"]: r
        for r in studies.unseen_entities(test, table.where("id < 600"), ["id"], threshold=0.5).collect()
    }
    assert found["standard_out_of_time"]["transactions"] == 200
    assert found["unseen_entity"]["transactions"] >= 99
    lonely = studies.unseen_entities(test.where("id < 0"), table, ["id"]).collect()
    assert {(r["subgroup"], r["transactions"], r["pr_auc"]) for r in lonely} == {
        (n, 0, None) for n in ("standard_out_of_time", "both_parties_seen", "unseen_entity")
    }
    assert (
        found["both_parties_seen"]["transactions"] + found["unseen_entity"]["transactions"] == 200
    )


def test_training_rows_are_cut_into_bounded_parts(spark, table, monkeypatch):
    prepared, whole = models.encoded_training(table, S.MODEL_FEATURES, TINY)
    width = preprocessing.vector_width(prepared)
    assert width == whole.first()["features"].size
    monkeypatch.setattr(models, "CELLS_PER_TASK", 100 * width)
    again, cut = models.encoded_training(table, S.MODEL_FEATURES, TINY)
    sizes = cut.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 9 and max(sizes) <= 200 and sum(sizes) == 900
    # What the trees are told of each place of the vector survives.
    assert cut.schema["features"].metadata == whole.schema["features"].metadata
    key = lambda df: sorted((str(r["features"]), r["Is_laundering"]) for r in df.collect())
    assert key(cut) == key(whole)
    fitted = models.fit_baseline(table, prepared.stages).stages[-1]
    reused = models.fit_baseline(table, prepared.stages, cut).stages[-1]
    assert reused.coefficients.toArray() == pytest.approx(fitted.coefficients.toArray(), abs=1e-6)


def test_known_medians_are_not_looked_for(spark, table, monkeypatch):
    known = preprocessing.medians(table, S.NUMERIC_FEATURES)
    own = preprocessing.fit_preprocessor(table).stages[0].getStatement()
    monkeypatch.setattr(preprocessing, "medians", None)
    assert preprocessing.fit_preprocessor(table, known=known).stages[0].getStatement() == own


def test_bounded_parts_are_shuffled_once(spark, table, monkeypatch):
    monkeypatch.setattr(models, "CELLS_PER_TASK", 1000)
    _, cut = models.encoded_training(table, S.MODEL_FEATURES, TINY)
    assert cut.storageLevel.useDisk and not cut.storageLevel.useMemory
    cut.unpersist()
    assert not cut.storageLevel.useDisk


def test_both_models_score_the_rows_in_one_pass(spark, table, monkeypatch):
    prepared, encoded = models.encoded_training(table, S.MODEL_FEATURES, TINY)
    model = models.boosted(prepared, encoded, TINY)
    baseline = models.fit_baseline(table, prepared.stages, encoded)
    stored = []
    keep = studies.materialize
    monkeypatch.setattr(studies, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    both = {r["id"]: r for r in studies._scores_of_both(model, baseline, table.where("id < 200"), ["id"]).collect()}
    assert len(stored) == 1 and len(both) == 200
    for fitted, name in ((model, models.RAW_SCORE), (baseline, studies._BASELINE_SCORE)):
        for r in models.raw_scores(fitted, table.where("id < 200"), ["id"]).collect():
            assert both[r["id"]][name] == r[models.RAW_SCORE]


def test_large_fits_run_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(studies, "CELLS_AT_ONCE", 100)
    assert [list(w) for w in studies._waves([40, 60, 80, 300, 10], 4)] == [[0, 1], [2], [3], [4]]
    assert [list(w) for w in studies._waves([1] * 5, 2)] == [[0, 1], [2, 3], [4]]
    running, most = [0], [0]

    def fit(i):
        running[0] += 1
        most[0] = max(most[0], running[0])
        time.sleep(0.05)
        running[0] -= 1
        return None if i == 1 else (i,)

    assert studies.at_once(spark, [partial(fit, i) for i in range(4)], 4, [70, 70, 70, 70]) == [(0,), (2,), (3,)]
    assert most == [1]


def test_the_encoded_width_is_that_of_the_fitted_vector(table):
    prepared, _ = models.encoded_training(table, S.MODEL_FEATURES, TINY)
    assert studies._encoded_width(table, S.MODEL_FEATURES) == preprocessing.vector_width(prepared)


def test_large_streams_take_more_files_a_batch_and_not_more_batches():
    assert [streams.files_per_batch(n, 4) for n in (0, 600_000, 1_000_000, 1_000_001, 36_000_000)] == [1, 1, 1, 2, 36]
