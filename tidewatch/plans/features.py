"""From transactions to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.history import add_history
from tidewatch.operators.row_features import add_row_features
from tidewatch.session import materialize
from tidewatch.sources.transactions import read_transactions, write_features


def build_features(transactions: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """History first, on the narrow table; the row features need no shuffle and come last."""
    return add_row_features(add_history(transactions, tie_break))


def build_feature_table(spark: SparkSession, csv_path: str, output: str, tie_break: Sequence[str]) -> None:
    """Raw CSV to the partitioned feature table; the text is parsed once."""
    transactions = materialize(read_transactions(spark, csv_path), "transactions")
    write_features(build_features(transactions, tie_break), output)
