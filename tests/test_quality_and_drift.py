"""Feature table checks, the row contract and drift."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import drift, quality


def feature_rows(spark, count=60, seed=0):
    pick = random.Random(seed)
    rows = [
        (
            i,
            *[pick.random() for _ in S.NUMERIC_FEATURES],
            *["x" for _ in S.CATEGORICAL_FEATURES],
            dt.datetime(2026, 1, 1) + dt.timedelta(hours=i),
            i % 2,
        )
        for i in range(count)
    ]
    names = ["seq", *S.MODEL_FEATURES, "timestamp", S.TARGET]
    return spark.createDataFrame(rows, names)


def issues(df, **options):
    return {(r["check"], r["column"]) for r in quality.find_issues(df, **options).collect()}


def test_a_good_table_has_no_issues(spark):
    df = feature_rows(spark)
    assert issues(df, sequence="seq") == set()
    assert quality.is_clean(df, sequence="seq")
    assert quality.require_features(df)


def test_each_check_fires(spark):
    df = feature_rows(spark)
    assert ("missing_feature", "log_amount") in issues(df.drop("log_amount"))
    assert ("target_not_found", S.TARGET) in issues(df.drop(S.TARGET))
    assert ("timestamp_not_found", "timestamp") in issues(df.drop("timestamp"))
    holes = df.withColumn("Amount", F.when(F.col("seq") > 6, F.col("Amount")).otherwise(float("nan")))
    assert ("null_fraction", "Amount") in issues(holes)
    assert ("null_fraction", "Amount") not in issues(holes, null_limit=0.5)
    assert ("fewer_than_two_classes", S.TARGET) in issues(df.withColumn(S.TARGET, F.lit(0)))
    endless = df.withColumn("log_amount", F.when(F.col("seq") == 3, float("inf")).otherwise(F.col("log_amount")))
    assert ("infinite_values", "log_amount") in issues(endless)
    skipped = df.withColumn(
        "sender_amount_sum_24h", F.when(F.col("seq") == 3, float("inf")).otherwise(F.lit(1.0))
    )
    assert issues(skipped) == set()
    late = df.withColumn("timestamp", F.when(F.col("seq") == 9, F.lit(dt.datetime(2025, 1, 1))).otherwise(F.col("timestamp")))
    assert ("not_chronological", "timestamp") in issues(late, sequence="seq")


def test_warnings_do_not_make_a_table_dirty(spark):
    df = feature_rows(spark, 100)
    spiky = df.withColumn("log_amount", F.when(F.col("seq") % 10 == 0, 1e6).otherwise(F.col("log_amount")))
    assert ("extreme_outliers", "log_amount") in issues(spiky)
    assert quality.is_clean(spiky)


def test_only_absent_columns_are_fatal(spark):
    df = feature_rows(spark)
    with pytest.raises(ValueError, match="log_amount"):
        quality.require_features(df.drop("log_amount"))
    assert quality.require_features(df.withColumn(S.TARGET, F.lit(0)))


@pytest.mark.parametrize("per_piece", [None, 5])
def test_out_of_order_for_any_pieces(spark, per_piece):
    times = [0, 1, 2, 9, 3, 4, 9, 9, 8, 10, 11, 12]
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "seq int, timestamp timestamp")
    assert quality.out_of_order(df, "seq", per_piece).first()[0] == 3


def contract_row(spark, **changes):
    values = {c: 0.0 for c in S.NUMERIC_FEATURES} | {c: "x" for c in S.CATEGORICAL_FEATURES} | changes
    columns = [F.lit(v).cast("string" if c in S.CATEGORICAL_FEATURES else "double").alias(c) for c, v in values.items()]
    return spark.range(1).select(*columns)


@pytest.mark.parametrize(
    ("column", "value"),
    [
        ("Amount", -0.01),
        ("Amount", None),
        ("Amount", float("nan")),
        ("hour_sin", 1.01),
        ("dow_cos", -1.01),
        ("is_night", 2.0),
        ("is_weekend", 0.5),
        ("sender_txn_count_24h", -1.0),
        ("receiver_amount_sum_24h", -5.0),
        ("sender_counterparty_hhi", 1.5),
        ("sender_amount_zscore", None),
        ("Payment_type", None),
    ],
)
def test_contract_rejects(spark, column, value):
    checked = quality.check_rows(contract_row(spark, **{column: value}))
    assert checked.first()["violations"] == [column]
    assert (quality.accepted(checked).count(), quality.quarantined(checked).count()) == (0, 1)


def test_contract_accepts_and_allows_missing_moments(spark):
    good = contract_row(
        spark, sender_amount_mean_30d=None, sender_amount_std_30d=None, seconds_since_sender_txn=-1.0
    )
    assert quality.accepted(quality.check_rows(good)).count() == 1


def test_contract_lists_all_that_is_broken(spark):
    bad = contract_row(spark, Amount=-1.0, hour_sin=None, is_night=float("nan"), Payment_type=None)
    checked = quality.check_rows(contract_row(spark).unionByName(bad))
    assert sorted(r["violations"] for r in checked.collect()) == [[], ["Amount", "hour_sin", "is_night", "Payment_type"]]
    assert dict(checked.dtypes)["violations"] == "array<string>"


def test_contract_fails_on_unknown_or_missing_columns(spark):
    with pytest.raises(ValueError, match="surprise"):
        quality.check_rows(contract_row(spark).withColumn("surprise", F.lit(1)))
    with pytest.raises(ValueError, match="log_amount"):
        quality.check_rows(contract_row(spark).drop("log_amount"))
    assert quality.check_rows(contract_row(spark).withColumn("id", F.lit(1)), ["id"]).count() == 1


def test_baseline_and_feature_drift(spark):
    base = spark.createDataFrame([(float(v), 1.0) for v in range(10)], "a double, b double")
    moved = base.select((F.col("a") * 2).alias("a"), "b", F.lit(1.0).alias("c"))
    stats = drift.baseline_statistics(base, ["a", "b", "absent"])
    by_name = {r["feature"]: r for r in stats.collect()}
    assert set(by_name) == {"a", "b"}
    assert by_name["a"]["std"] == pytest.approx(np.std(range(10), ddof=1))
    assert (by_name["a"]["min"], by_name["a"]["max"]) == (0, 9)
    found = {r["feature"]: r for r in drift.feature_drift(moved, stats, ["a", "b", "c"]).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"]["mean_change_pct"] == pytest.approx(100)
    assert found["a"]["drift_detected"] and not found["b"]["drift_detected"]


def test_prediction_drift(spark):
    pick = np.random.default_rng(0)
    base, wide = pick.normal(0.5, 0.05, 400), pick.normal(0.5, 0.2, 300)
    grid = list(np.quantile(base, np.linspace(0, 1, 101)))

    def run(values):
        return drift.prediction_drift(spark.createDataFrame([(float(v),) for v in values], "score double"), grid).first()

    same, spread, shifted = run(base), run(wide), run(base + 0.4)
    assert not same["drift_detected"]
    assert spread["variance_drift_detected"] and not spread["median_drift_detected"]
    assert shifted["median_drift_detected"] and not shifted["variance_drift_detected"]
    assert spread["current_std"] == pytest.approx(np.std(wide))
    assert spread["current_median"] == pytest.approx(np.median(wide))
    assert same["baseline_std"] == pytest.approx(np.std(grid))
