"""Row features, splits and windows on hand-made frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.config import SplitConfig, training_config
from tidewatch.functions import columns as C
from tidewatch.operators import accounts, splits
from tidewatch.operators.row_features import add_row_features, exposure, guarded_inputs, model_inputs

BASE = "timestamp timestamp, Sender_account string, Receiver_account string, Amount double, Payment_currency string, Received_currency string, Sender_bank_location string, Receiver_bank_location string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), BASE)


def test_row_features_of_one_transaction(spark):
    sunday = dt.datetime(2025, 12, 28, 23, 30)
    row = add_row_features(rows(spark, (sunday, "007", "r", 3000.0, "USD", "EUR", "US", "US"))).first()
    assert row["log_amount"] == pytest.approx(math.log1p(3000))
    assert row["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 23 / 24))
    assert row["dow_cos"] == pytest.approx(math.cos(2 * math.pi * 6 / 7))
    assert row["month_sin"] == pytest.approx(0, abs=1e-12)
    assert (row["is_weekend"], row["is_night"]) == (1, 1)
    assert (row["currency_mismatch"], row["cross_border"], row["is_round_amount"]) == (1, 0, 1)
    assert row["Sender_account"] == "007"


def test_zero_amount_is_finite_and_round(spark):
    row = add_row_features(rows(spark, (dt.datetime(2026, 1, 5), "a", "b", 0.0, "U", "U", "X", "X"))).first()
    assert row["log_amount"] == 0
    assert row["is_round_amount"] == 1


@pytest.mark.parametrize(
    ("amount", "is_round"), [(999.9999999999, 0), (1000.00000000001, 1), (2500.0, 0), (-1000.0, 1)]
)
def test_round_amounts_use_a_floored_remainder(spark, amount, is_round):
    row = spark.createDataFrame([(amount,)], "v double").select(C.is_round(F.col("v"))).first()
    assert row[0] == is_round


def test_two_nulls_agree_and_a_null_differs_from_a_value(spark):
    df = spark.createDataFrame([(None, None), (None, "x"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(C.differs(F.col("a"), F.col("b"))).collect()] == [0, 1, 0]


@pytest.mark.parametrize(("hour", "night"), [(6, 1), (7, 0), (21, 0), (22, 1)])
def test_night_hours_are_inclusive(spark, hour, night):
    at = dt.datetime(2026, 1, 5, hour)
    assert add_row_features(rows(spark, (at, "a", "b", 1.0, "U", "U", "X", "X"))).first()["is_night"] == night


def test_model_inputs_refuse_identifiers_and_name_gaps(spark):
    full = spark.createDataFrame([tuple(0.0 for _ in S.MODEL_FEATURES)], S.MODEL_FEATURES)
    assert guarded_inputs(full).columns == S.MODEL_FEATURES
    assert model_inputs(full.withColumn("extra", F.lit(1))).columns == S.MODEL_FEATURES
    with pytest.raises(ValueError, match="Sender_account"):
        guarded_inputs(full.withColumn(S.SENDER, F.lit("a")))
    with pytest.raises(ValueError, match="Amount"):
        guarded_inputs(full.drop("Amount"))
    assert not set(S.FORBIDDEN_INPUTS) & set(S.MODEL_FEATURES)
    assert (len(S.NUMERIC_FEATURES), len(S.CATEGORICAL_FEATURES)) == (27, 5)


def test_exposure(spark):
    df = spark.createDataFrame([(200.0, 0.25)], "Amount double, risk_probability double")
    assert exposure(df).first()["risk_weighted_exposure"] == 50


def timed(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, timestamp timestamp")


def days(*offsets):
    return [dt.datetime(2026, 1, 1) + dt.timedelta(days=d) for d in offsets]


def test_temporal_split_keeps_equal_timestamps_together(spark):
    df = timed(spark, days(0, 1, 2, 3, 4, 5, 5, 6, 7, 8))
    found = {r["id"]: r["split"] for r in splits.temporal_split(df, SplitConfig(0.5, 0.2, 0.1)).collect()}
    assert found[5] == found[6]
    order = ["train", "calibration", "validation", "test"]
    ranks = [order.index(found[i]) for i in range(10)]
    assert ranks == sorted(ranks)
    # Nine distinct days: the cuts lie at the 4th, 6th and 7th (counting from 0).
    assert [found[i] for i in range(10)].count("train") == 4
    assert set(found.values()) == set(order)


@pytest.mark.parametrize(
    "config", [SplitConfig(0.0, 0.1, 0.1), SplitConfig(0.6, 0.3, 0.1), SplitConfig(0.8, 0.1, 0.1)]
)
def test_temporal_split_rejects_bad_fractions(spark, config):
    with pytest.raises(ValueError, match="split fractions|distinct timestamps"):
        splits.temporal_split(timed(spark, days(0, 1, 2)), config)


def test_chronological_split_is_by_row_position(spark):
    df = timed(spark, days(*range(10)))
    found = splits.chronological_split(df, ["id"], 0.6, 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found} == {"train": 6, "validation": 2, "test": 2}
    tied = timed(spark, days(*([0] * 10)))
    found = {r["id"]: r["split"] for r in splits.chronological_split(tied, ["id"], 0.6, 0.2).collect()}
    assert [found[i] for i in range(10)] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2


@pytest.mark.parametrize("count", [14, 15, 27, 200])
def test_windows_expand_and_match_array_split(spark, count):
    times = [dt.datetime(2026, 1, 1) + dt.timedelta(hours=h) for h in range(count)]
    found = splits.window_boundaries(timed(spark, times))
    starts = [b[0] for b in np.array_split(np.arange(count), 14)]
    us = [int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) for t in times]
    assert len(found) == 4
    for w, (train_end, calibration_end, test_end) in enumerate(found):
        assert train_end == us[starts[4 + 2 * w]]
        assert calibration_end == us[starts[6 + 2 * w]]
        assert test_end == (us[starts[8 + 2 * w]] if w < 3 else None)


def test_windows_need_enough_timestamps(spark):
    with pytest.raises(ValueError, match="14 unique"):
        splits.window_boundaries(timed(spark, days(*range(13))))


def test_time_filters_reach_the_files(spark, tmp_path):
    timed(spark, days(*range(5))).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(splits.between(1_767_312_000_000_000, None))
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan


def test_unseen_accounts(spark):
    train = spark.createDataFrame([("a", "b"), ("a", "c")], "Sender_account string, Receiver_account string")
    test = spark.createDataFrame([("a", "c"), ("b", "z"), ("y", "a")], train.schema)
    known = accounts.known_accounts(train)
    assert {r[0] for r in known.collect()} == {"a", "b", "c"}
    flagged = {r[0]: r for r in accounts.flag_unseen(test, known).collect()}
    assert flagged["a"]["both_seen"] and not flagged["a"]["unseen_entity"]
    assert flagged["b"]["sender_seen"] and not flagged["b"]["receiver_seen"] and flagged["b"]["unseen_entity"]
    assert accounts.subgroups(accounts.flag_unseen(test, known)).count() == 6


def test_default_settings():
    slow, fast = training_config(), training_config(fast=True)
    assert (slow.booster.trees, fast.booster.trees) == (500, 10)
    assert (slow.booster.max_depth, slow.booster.learning_rate) == (5, 0.05)
    assert slow.split == SplitConfig(0.65, 0.10, 0.10)
    assert slow.alert.report_rates == (0.001, 0.005, 0.01)
    assert slow.booster is not fast.booster
