"""A query of each kind against its SQL; ``oracle_check.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences

SAMPLED = [
    "row_features",
    "history_features",
    "sender_counterparty_hhi_full",
    "event_history",
    "temporal_split",
    "chronological_split",
    "window_frames",
    "alerts_tied_score",
    "evaluation_bundle",
    "reliability_curve",
    "score_percentiles",
    "typology_recall",
    "unseen_subgroups",
    "quality_issues",
    "row_contract",
    "prediction_drift",
    "csv_scan",
]


@pytest.mark.parametrize("name", SAMPLED)
def test_query_agrees_with_sql(spark, small, name):
    assert differences(spark, small, connect(small), name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sender", "busy_transactions", "mismatches", "largest_count_24h", "largest_sum_24h"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 60
