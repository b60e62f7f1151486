"""Small result tables as CSV and JSON, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


# The columns of the published result files.
REPORT_SCHEMAS = {
    "ablation": "model string, pr_auc double, `recall_at_0.5%` double",
    "typology": "typology string, transactions long, positives long, `recall_at_0.5%` double",
    "walk_forward": (
        "window string, pr_auc double, `recall_at_0.5%` double, "
        "`precision_at_0.5%` double, `lift_at_0.5%` double"
    ),
}


def write_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file with a header; for result tables only, which have a few rows."""
    report.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_report(spark: SparkSession, kind: str, fresh: str, published: str) -> DataFrame:
    """A typed result table from the fresh folder, else the published one, else empty."""
    schema = T.StructType.fromDDL(REPORT_SCHEMAS[kind])
    for folder in (fresh, published):
        for name in (f"{folder}/{kind}_results", f"{folder}/{kind}_results.csv"):
            if _exists(spark, name):
                return spark.read.schema(schema).option("header", True).csv(name)
    return spark.createDataFrame([], schema)
