"""Moments, sketches, account filters and Newton steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import accounts, drift
from tidewatch.operators.newton import logistic


def test_merged_moments_are_those_of_all_rows(spark):
    """Far from zero, where sums of squares would cancel; with nulls, NaN, single rows and groups without a value."""
    pick = np.random.default_rng(1)
    data = [(int(d), float(1e9 + x)) for d, x in zip(pick.integers(0, 12, 500), pick.normal(size=500))]
    data += [(20, 1e9), (21, None), (21, float("nan")), (None, 1e9 + 1)]
    df = spark.createDataFrame(data, "day int, v double").withColumn("w", F.col("day"))
    moments = drift.daily_moments(df, ["v", "w", "absent"], ["day"])
    found = {r["feature"]: r for r in drift.merged_statistics(moments).collect()}
    held = [v for _, v in data if v is not None and v == v]
    assert set(found) == {"v", "w"}
    assert found["v"]["mean"] == pytest.approx(np.mean(held), rel=1e-14)
    assert found["v"]["std"] == pytest.approx(np.std(held, ddof=1), rel=1e-7)
    assert (found["v"]["min"], found["v"]["max"]) == (min(held), max(held))
    alone = {r["day"]: r for r in drift.merged_statistics(moments, ["day"]).where("feature = 'v'").collect()}
    assert alone[20]["std"] is None and alone[20]["mean"] == 1e9
    assert alone[21]["mean"] is None and alone[None]["mean"] == 1e9 + 1
    assert drift.merged_statistics(moments.limit(0)).count() == 0


def test_merged_sketches_keep_their_rank_error(spark):
    values = np.random.default_rng(3).uniform(size=60_000) ** 3
    df = spark.createDataFrame([(k % 40, float(v)) for k, v in enumerate(values)] + [(1, None), (2, float("nan"))], "day int, score double")
    for k in (256, 4096):
        daily = drift.score_sketches(df, ["day"], k=k)
        shares = [i / 50 for i in range(51)]
        merged = drift.sketch_quantiles(drift.merged_sketch(daily, k=k), shares).first()
        assert merged["n"] == len(values)
        errors = drift.rank_errors(df, "score", merged["quantiles"], shares, len(values))
        exact = [abs((values < q).mean() - s) for q, s in zip(merged["quantiles"], shares)]
        assert max(errors) <= drift.rank_error(k) and max(errors) <= max(exact) + 1e-9


def test_filter_lets_all_members_pass_and_few_others(spark):
    known = spark.range(0, 60_000, 3).select(F.concat(F.lit("acc"), "id").alias("account")).unionByName(spark.createDataFrame([(None,)], "account string"))
    filtered = accounts.account_filter(known)
    probes = spark.range(60_000).select("id", F.concat(F.lit("acc"), "id").alias(S.SENDER))
    marked = accounts.may_hold(probes, filtered, S.SENDER, "pass").groupBy((F.col("id") % 3 == 0).alias("member")).agg(F.avg(F.col("pass").cast("int")).alias("share"))
    share = {r["member"]: r["share"] for r in marked.collect()}
    assert share[True] == 1.0 and share[False] < 0.05
    # A full filter lets everything pass; the join still decides.
    crowded = accounts.account_filter(known, most_blocks=1)
    assert accounts.may_hold(probes, crowded, S.SENDER, "pass").where("pass").count() == 60_000


def test_filtered_flags_are_the_joined_ones(spark):
    known = spark.createDataFrame([("a",), ("b",), (None,)], "account string")
    rows = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", None), ("z", "z"), (None, "b")], f"{S.SENDER} string, {S.RECEIVER} string")
    want = sorted(map(str, accounts.flag_unseen(rows, known).collect()))
    for blocks in (1, 1 << 17):
        assert sorted(map(str, accounts.flag_unseen_filtered(rows, known, blocks).collect())) == want
    none = known.limit(0)
    assert accounts.flag_unseen_filtered(rows, none).where("unseen_entity").count() == 5


def test_newton_steps_solve_the_problem(spark):
    pick = np.random.default_rng(7)
    x = pick.normal(size=(800, 2)) * [3.0, 0.2]
    y = (pick.uniform(size=800) < 1 / (1 + np.exp(4 - x[:, 0] + 2 * x[:, 1]))).astype(int)
    w = pick.uniform(0.5, 2, 800)
    df = spark.createDataFrame([(float(a), float(b), int(t), float(v)) for (a, b), t, v in zip(x, y, w)], "a double, b double, y int, w double")
    spoilt = df.unionByName(spark.createDataFrame([(None, 1.0, 1, 1.0), (float("nan"), 1.0, 0, 1.0)], df.schema))
    slopes, intercept = logistic(spoilt, ["a", "b"], "y", F.col("w"), ridge=0.3)
    q = 1 / (1 + np.exp(-(x @ slopes + intercept)))
    assert (w * (q - y)) @ x + 0.3 * np.array(slopes) == pytest.approx([0, 0], abs=1e-6)
    assert (w * (q - y)).sum() == pytest.approx(0, abs=1e-6)
    slopes, intercept = logistic(df, ["a", "b"], "y", F.col("w"), ridge=0.3 / w.sum(), mean=True)
    assert 1 / (1 + np.exp(-(x @ slopes + intercept))) == pytest.approx(q, abs=1e-7)


def test_newton_steps_on_awkward_tables(spark):
    rare = spark.createDataFrame([(float(k), int(k == 999)) for k in range(1000)], "x double, y int")
    slopes, intercept = logistic(rare, ["x"], "y", ridge=1.0)
    assert math.isfinite(slopes[0]) and math.isfinite(intercept) and slopes[0] > 0
    constant = spark.createDataFrame([(2.0, k % 4 == 0) for k in range(40)], "x double, y boolean").withColumn("y", F.col("y").cast("int"))
    slopes, intercept = logistic(constant, ["x"], "y", ridge=1e-6)
    assert 1 / (1 + math.exp(-(2 * slopes[0] + intercept))) == pytest.approx(0.25, abs=1e-4)
    with pytest.raises(ValueError, match="no rows"):
        logistic(constant.limit(0), ["x"], "y")
