"""The whole experiment as one driver function: features, model, studies and their report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import schema as S
from tidewatch.config import TrainingConfig
from tidewatch.operators import accounts, splits
from tidewatch.operators.scoring import score
from tidewatch.plans import studies
from tidewatch.plans.features import build_feature_table
from tidewatch.session import materialize
from tidewatch.sources import reports
from tidewatch.sources.artifacts import RiskModel
from tidewatch.sources.transactions import dropped_rows


def train_and_report(
    spark: SparkSession, features: DataFrame, out: str, tie_break: Sequence[str], config: TrainingConfig
) -> RiskModel:
    """Train, save the model to ``out/model``, and write the metrics and the tables that go with it."""
    model, tables = studies.train_risk_model(features, tie_break, config)
    model.save(spark, f"{out}/model")
    for name in ("test_metrics", "baseline_test_metrics", "calibration", "reliability", "split_statistics"):
        reports.write_json(tables[name], f"{out}/{name}")
    if "typology" in tables:
        reports.write_csv(tables["typology"].withColumnRenamed("recall", "recall_at_0.5%"), f"{out}/typology_results")
    return model


def study_unseen_accounts(
    features: DataFrame, model: RiskModel, out: str, tie_break: Sequence[str], config: TrainingConfig
) -> None:
    """Test figures by whether both parties were trained on, with the number of accounts that were."""
    parts = splits.temporal_split(features, config.split)
    train, test = (parts.where(F.col(splits.SPLIT) == name) for name in ("train", "test"))
    scored = score(test, model, [*tie_break, S.TARGET, S.SENDER, S.RECEIVER])
    scored = materialize(scored.withColumn(studies.SCORE, F.col("risk_probability")), "unseen-scores")
    found = studies.unseen_entities(scored, train, tie_break, config.alert.rate, model.decision_threshold)
    known = accounts.known_accounts(train).count()
    reports.write_json(found.withColumn("training_accounts", F.lit(known)), f"{out}/unseen_entity_results")


def run_experiments(
    spark: SparkSession, transactions: str, out: str, tie_break: Sequence[str], config: TrainingConfig = TrainingConfig()
) -> RiskModel:
    """From a raw transaction file to every report, each stage from what the one before stored in ``out``."""
    reports.write_json(dropped_rows(spark, transactions), f"{out}/dropped_rows")
    build_feature_table(spark, transactions, f"{out}/features", tie_break=tie_break)
    features = spark.read.parquet(f"{out}/features")
    model = train_and_report(spark, features, out, tie_break, config)
    reports.write_csv(studies.feature_ablation(features, tie_break, config), f"{out}/ablation_results")
    reports.write_csv(studies.walk_forward(features, tie_break, config), f"{out}/walk_forward_results")
    study_unseen_accounts(features, model, out, tie_break, config)
    return model
