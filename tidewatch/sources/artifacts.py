"""The trained model with all that scoring and reporting need, on shared storage."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.models import Calibrator
from tidewatch.operators.preprocessing import DictionaryEncoder

# Fixed value: the published version of the model layout.
MODEL_VERSION = "2.1.0"

_SCHEMA = (
    "model_version string, features array<string>, slope double, intercept double, "
    "decision_threshold double, alert_rate double, quantiles array<double>, details string"
)


@dataclass
class RiskModel:
    pipeline: PipelineModel
    calibrator: Calibrator
    features: list[str]
    decision_threshold: float
    alert_rate: float
    quantiles: list[float]
    details: dict = field(default_factory=dict)
    version: str = MODEL_VERSION

    def metadata(self, spark: SparkSession) -> DataFrame:
        row = (
            self.version,
            self.features,
            self.calibrator.slope,
            self.calibrator.intercept,
            self.decision_threshold,
            self.alert_rate,
            self.quantiles,
            json.dumps(self.details, default=str),
        )
        return spark.createDataFrame([row], _SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        for stage in self._encoders():
            stage.dictionary(spark).write.mode("overwrite").parquet(f"{path}/dictionary")
        self.metadata(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    def _encoders(self) -> list[DictionaryEncoder]:
        return [s for s in self.pipeline.stages if isinstance(s, DictionaryEncoder)]

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        row = spark.read.schema(_SCHEMA).parquet(f"{path}/metadata").first()
        model = RiskModel(
            pipeline=PipelineModel.load(f"{path}/pipeline"),
            calibrator=Calibrator(row["slope"], row["intercept"]),
            features=list(row["features"]),
            decision_threshold=row["decision_threshold"],
            alert_rate=row["alert_rate"],
            quantiles=list(row["quantiles"]),
            details=json.loads(row["details"]),
            version=row["model_version"],
        )
        # The dictionary is wherever the model is now.
        for stage in model._encoders():
            stage.set(stage.folder, f"{path}/dictionary")
        return model
