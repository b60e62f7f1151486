"""Alert selection, metrics and curves on hand-made scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import alerts, metrics
from tidewatch.operators.scoring import with_percentile
from tidewatch.plans.grouped import grouped_quantiles

SCHEMA = "id int, score double, Is_laundering int, Laundering_type string"


def scored(spark, pairs, kinds=None):
    kinds = kinds or ["t"] * len(pairs)
    return spark.createDataFrame([(i, p, y, k) for i, ((p, y), k) in enumerate(zip(pairs, kinds))], SCHEMA)


SMALL = [(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)]


def test_alerts_break_ties_in_order(spark):
    marked = alerts.mark_alerts(scored(spark, SMALL), 0.5, ["id"])
    assert [r["is_alert"] for r in marked.orderBy("id").collect()] == [1, 1, 0, 0]


@pytest.mark.parametrize("rate", [0, -0.1, 1.01])
def test_alert_rate_must_be_a_share(rate):
    with pytest.raises(ValueError, match="alert_rate"):
        alerts.budget(10, rate)


def test_alert_budget_rounds_up_and_is_never_zero():
    assert alerts.budget(1, 0.005) == 1
    assert alerts.budget(201, 0.005) == 2
    with pytest.raises(ValueError, match="empty"):
        alerts.budget(0, 0.5)


def test_alert_count_is_exact_when_everything_ties(spark):
    df = scored(spark, [(0.3, i % 2) for i in range(1000)])
    marked = alerts.mark_alerts(df, 0.017, ["id"]).where("is_alert = 1").collect()
    assert sorted(r["id"] for r in marked) == list(range(17))


def test_average_precision_and_trapezoid_differ(spark):
    found = metrics.ranking_areas(metrics.score_steps(scored(spark, SMALL))).first()
    assert found["pr_auc"] == pytest.approx(5 / 6)
    assert found["pr_trapezoid_area"] == pytest.approx(11 / 12)
    assert found["roc_auc"] == pytest.approx(0.875)


def _numpy_areas(pairs):
    p, y = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    levels = sorted(set(p), reverse=True)
    ap, last = 0.0, 0.0
    for s in levels:
        tp, k = y[p >= s].sum(), (p >= s).sum()
        ap += (tp / y.sum() - last) * tp / k
        last = tp / y.sum()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    return ap, auc


@pytest.mark.parametrize("per_piece", [None, 15])
def test_areas_match_definitions_for_any_pieces(spark, per_piece):
    pick = random.Random(1)
    pairs = [(round(pick.random(), 2) if pick.random() < 0.6 else 0.5, int(pick.random() < 0.3)) for _ in range(200)]
    steps = metrics.score_steps(scored(spark, pairs), rows=200, rows_per_piece=per_piece)
    found = metrics.ranking_areas(steps).first()
    ap, auc = _numpy_areas(pairs)
    assert found["pr_auc"] == pytest.approx(ap)
    assert found["roc_auc"] == pytest.approx(auc)


def test_evaluation_bundle(spark):
    pick = random.Random(2)
    pairs = [(pick.random(), int(pick.random() < 0.2)) for _ in range(400)]
    found = metrics.evaluate(scored(spark, pairs), ["id"]).first().asDict()
    p, y = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    ap, auc = _numpy_areas(pairs)
    assert found["pr_auc"] == pytest.approx(ap)
    assert found["roc_auc"] == pytest.approx(auc)
    assert found["brier_score"] == pytest.approx(np.mean((p - y) ** 2))
    assert found["log_loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    top = np.argsort(-p, kind="stable")[:4]
    assert found["alert_1.000%_precision"] == pytest.approx(y[top].mean())
    assert found["alert_1.000%_recall"] == pytest.approx(y[top].sum() / y.sum())
    assert found["alert_1.000%_lift"] == pytest.approx(y[top].mean() / y.mean())
    assert set(found) >= {f"alert_{r}_{m}" for r in ("0.100%", "0.500%", "1.000%") for m in ("precision", "recall", "lift")}


def test_evaluation_needs_both_classes(spark):
    with pytest.raises(ValueError, match="both target classes"):
        metrics.evaluate(scored(spark, [(0.1, 0), (0.2, 0)]), ["id"])


def test_fixed_threshold_and_cost(spark):
    found = alerts.at_threshold(scored(spark, SMALL), 0.5).first()
    assert (found["alerts"], found["alert_rate"]) == (3, 0.75)
    assert found["precision"] == pytest.approx(2 / 3)
    assert (found["recall"], found["lift"]) == (1.0, pytest.approx(4 / 3))
    none = alerts.at_threshold(scored(spark, SMALL), 0.95).first()
    assert (none["precision"], none["recall"], none["alerts"]) == (0, 0, 0)
    assert alerts.decision_cost(scored(spark, SMALL), 0.6).first()[0] == 100
    assert alerts.at_threshold(scored(spark, SMALL).where("id < 0"), 0.5).count() == 0


def test_typology_recall_keeps_the_null_group(spark):
    df = scored(spark, [(0.9, 1), (0.8, 1), (0.2, 1), (0.1, 0)], ["a", None, "a", "b"])
    marked = alerts.mark_alerts(df, 0.5, ["id"])
    found = {r["typology"]: r for r in alerts.typology_recall(marked).collect()}
    assert (found["a"]["recall"], found[None]["recall"], found["b"]["recall"]) == (0.5, 1.0, 0.0)
    ranked = [r["typology"] for r in alerts.ranked_typologies(alerts.typology_recall(marked)).collect()]
    assert ranked == [None, "a"]


def test_curves_start_and_end_where_they_should(spark):
    steps = metrics.score_steps(scored(spark, SMALL))
    roc = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(steps).collect())
    assert roc == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
    pr = {(round(r["recall"], 6), round(r["precision"], 6)) for r in metrics.pr_points(steps).collect()}
    assert pr == {(0.5, 1.0), (1.0, 0.666667), (1.0, 0.5), (0.0, 1.0)}


@pytest.mark.parametrize("rows_per_piece", [None, 40])
def test_roc_corners_are_where_the_second_difference_is(spark, rows_per_piece):
    """Kept points against the counts' second differences, over few distinct scores and many, in one piece and in several."""
    pick = np.random.default_rng(5)
    for digits in (1, 2, 6):
        pairs = [(round(float(p), digits), int(q < p / 3)) for p, q in pick.uniform(size=(400, 2))]
        values = sorted({p for p, _ in pairs}, reverse=True)
        n = [sum(p == v for p, _ in pairs) for v in values]
        pos = [sum(y for p, y in pairs if p == v) for v in values]
        tps, fps = np.cumsum(pos), np.cumsum(n) - np.cumsum(pos)
        bent = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True]
        want = {(v, fps[i] / fps[-1], tps[i] / tps[-1]) for i, v in enumerate(values) if bent[i]} | {(float("inf"), 0.0, 0.0)}
        steps = metrics.score_steps(scored(spark, pairs))
        got = sorted(tuple(r) for r in metrics.roc_points(steps, rows_per_piece=rows_per_piece).collect())
        assert got == [pytest.approx(p) for p in sorted(want)]
        assert metrics.roc_points(steps, corners=False).count() == len(values) + 1


@pytest.mark.parametrize("rows_per_piece", [None, 30])
def test_alert_rates_of_all_groups_at_once(spark, rows_per_piece):
    """Groups of all sizes with repeated, null and NaN scores and ties on every column, against sorting each group."""
    pick = random.Random(9)
    data = []
    for group, size in (("a", 300), ("b", 1), (None, 90), ("c", 40)):
        for k in range(size):
            score = pick.choice([None, float("nan"), 0.1, 0.5, 0.5, round(pick.random(), 2)])
            data.append((group, score, pick.choice([None, k % 7, k % 7]), int(pick.random() < 0.3), len(data)))
    df = spark.createDataFrame(data, "g string, score double, tie int, Is_laundering int, __row long")
    rates = (0.01, 0.2, 0.7, 1.0)
    got = alerts.at_alert_rate_by(df, ["g"], rates, ["tie"], rows_per_piece=rows_per_piece).collect()
    assert len(got) == 4 * len(rates)
    missing = lambda x: x is None or x != x
    for r in got:
        mine = [d for d in data if d[0] == r["g"]]
        mine.sort(key=lambda d: (missing(d[1]), 0 if missing(d[1]) else -d[1], d[2] is None, d[2] or 0, d[4]))
        k = max(1, math.ceil(len(mine) * r["alert_rate"]))
        tp, positives = sum(d[3] for d in mine[:k]), sum(d[3] for d in mine)
        assert r["alerts"] == k
        assert r["precision"] == pytest.approx(tp / k)
        assert r["recall"] == pytest.approx(tp / positives if positives else 0)
        last = mine[k - 1][1]
        assert r["threshold"] == (None if missing(last) else last)


@pytest.mark.parametrize("rows_per_piece", [None, 25])
def test_quantiles_of_all_groups(spark, rows_per_piece):
    pick = random.Random(2)
    data = [(pick.choice(["x", "y", None]), pick.choice([None, float("nan"), pick.gauss(0, 1), 0.5]), pick.randrange(4)) for _ in range(500)]
    data.append(("empty", None, None))
    df = spark.createDataFrame(data, "g string, v double, w int")
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], {"v": shares, "w": [0.5]}, rows_per_piece).collect()}
    assert set(got) == {"x", "y", None, "empty"} and got["empty"]["v"] is None
    for g in ("x", "y", None):
        held = [v for a, v, _ in data if a == g and v is not None and v == v]
        assert got[g]["v"] == pytest.approx(list(np.quantile(held, shares)))
        assert got[g]["w"] == pytest.approx([np.median([w for a, _, w in data if a == g])])


def _jobs(spark, work):
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_grow_neither_with_rates_nor_with_groups(spark, tmp_path):
    pick = np.random.default_rng(6)
    data = [(k % 60, float(round(p, 2)), int(p > 0.9), k) for k, p in enumerate(pick.uniform(size=3000))]
    spark.createDataFrame(data, "g int, score double, Is_laundering int, __row long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    few = _jobs(spark, lambda: metrics.evaluate(df.drop("__row"), ["g"], rates=(0.01,)).collect())
    many = _jobs(spark, lambda: metrics.evaluate(df.drop("__row"), ["g"], rates=(0.001, 0.01, 0.05, 0.2)).collect())
    assert many <= few < 15
    two = _jobs(spark, lambda: alerts.at_alert_rate_by(df.where("g < 2"), ["g"], [0.1], ["g"]).collect())
    all_ = _jobs(spark, lambda: alerts.at_alert_rate_by(df, ["g"], [0.1], ["g"]).collect())
    assert max(two, all_) < 25


def test_reliability_drops_empty_bins(spark):
    pairs = [(0.1, 0)] * 50 + [(0.9, 1)] * 50
    found = {r["bin"]: r for r in metrics.reliability(scored(spark, pairs)).collect()}
    assert sum(r["rows"] for r in found.values()) == 100
    assert {(r["observed"], round(r["predicted"], 6)) for r in found.values()} == {(0.0, 0.1), (1.0, 0.9)}


def test_percentile_counts_values_strictly_below(spark):
    grid = [0.1, 0.2, 0.2, 0.2, 0.7]
    probes = [0.05, 0.1, 0.15, 0.2, 0.5, 0.7, 0.9]
    df = spark.createDataFrame([(p,) for p in [*probes, None]], "risk_probability double")
    found = {r[0]: r[1] for r in with_percentile(df, grid).collect()}
    for p in probes:
        assert found[p] == pytest.approx(np.searchsorted(grid, p) * 100 / 5)
    assert found[None] is None
    assert with_percentile(df, []).where("risk_percentile is not null").count() == 0


def test_logit_is_clipped(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    low, mid, high = (r[0] for r in df.select(C.logit(F.col("p"))).collect())
    assert low == pytest.approx(-13.8155, abs=1e-3)
    assert mid == 0
    assert high == pytest.approx(-low)


def test_steps_read_stored_scores(spark):
    scores = spark.createDataFrame([(i, i / 10, i % 2) for i in range(8)], "id int, score double, Is_laundering int")
    steps = metrics.score_steps(scores.join(spark.range(8).withColumnRenamed("id", "other"), F.col("id") == F.col("other")))
    assert "Join" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n_above"] for r in steps.orderBy("score").collect()] == [7 - i for i in range(8)]
