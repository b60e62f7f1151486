"""Exact order work must not depend on how it is cut into pieces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import ordering
from tidewatch.plans.ordering import (
    cut_points,
    leading_rows,
    order_statistics,
    quantiles,
    running_before,
)


def _values(count=500, seed=3):
    pick = random.Random(seed)
    # A third of the rows share one value.
    return [0.25 if pick.random() < 0.34 else round(pick.gauss(0, 1), 2) for _ in range(count)]


@pytest.mark.parametrize("per_piece", [None, 40])
def test_quantiles_interpolate_like_numpy(spark, per_piece):
    values = _values()
    df = spark.createDataFrame([(v, -v * 3) for v in values], "a double, b double")
    holes = spark.createDataFrame([(None, float("nan"))] * 5, "a double, b double")
    shares = [i / 1000 for i in range(1001)]
    found = quantiles(df.union(holes), {"a": shares, "b": [0.25, 0.5, 0.75]}, rows_per_piece=per_piece)
    assert found["a"] == pytest.approx(np.quantile(values, shares))
    assert found["b"] == pytest.approx(np.quantile([-v * 3 for v in values], [0.25, 0.5, 0.75]))


@pytest.mark.parametrize("per_piece", [None, 40])
def test_infinite_values_have_ranks_but_no_cuts(spark, per_piece):
    values = [-math.inf] * 80 + sorted(_values()) + [math.inf] * 120
    df = spark.createDataFrame([(v,) for v in values], "a double")
    ranks = [1, 80, 81, 300, 580, 581, 700]
    found = order_statistics(df, {"a": ranks}, len(values), rows_per_piece=per_piece)["a"]
    assert [found[k][0] for k in ranks] == [values[k - 1] for k in ranks]


def test_few_ranks_are_found_in_narrow_brackets(spark, monkeypatch):
    values = [0.25] * 4000 + [float(i % 5000) for i in range(9000)] + [math.inf] * 900
    df = spark.createDataFrame([(v, -v) for v in values] + [(None, float("nan"))] * 7, "a double, b double").repartition(5)
    ranks = {"a": [1, 4001, 6950, 6951, 13900], "b": [900, 901, 7000]}
    seen = []
    cut = ordering.cut_tables
    monkeypatch.setattr(ordering, "cut_tables", lambda *a: seen.append(a) or cut(*a))
    near = ordering._brackets(df, ranks, 14)
    found = order_statistics(df, ranks, len(values), rows_per_piece=1000)
    assert not seen
    for c, ordered in (("a", sorted(values)), ("b", sorted(-v for v in values))):
        for k in ranks[c]:
            v, before, n = found[c][k]
            assert (v, before, n) == (ordered[k - 1], ordered.index(v), ordered.count(v))
        wide = sum(any(low <= v <= high for low, high, _ in near[c]) for v in ordered if math.isfinite(v) and v != 0.25 and v != -0.25)
        assert wide < 0.2 * len(ordered)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [None], "b": [1.0]}


@pytest.mark.parametrize("per_piece", [None, 30])
@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_order_statistics(spark, per_piece, distinct, descending):
    values = _values(300)
    pool = sorted(set(values) if distinct else values, reverse=descending)
    ranks = [1, 2, 17, len(pool) // 2, len(pool)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = order_statistics(df, {"v": ranks}, 300, distinct, descending, per_piece)["v"]
    assert {k: found[k][0] for k in ranks} == {k: pool[k - 1] for k in ranks}
    for value, before, n in found.values():
        assert pool[before] == value
        assert pool[before + n - 1] == value


@pytest.mark.parametrize("per_piece", [None, 20])
@pytest.mark.parametrize("size", [1, 7, 100, 101, 169, 200])
def test_leading_rows_are_exact_under_ties(spark, per_piece, size):
    pick = random.Random(11)
    rows = [(pick.choice([0.1, 0.5, 0.5, 0.9]), pick.choice("abc"), i) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, name string, id int")
    order = [("score", True), ("name", False), ("id", False)]
    cut = leading_rows(df, order, [size], 200, per_piece)[0]
    want = {r[2] for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:size]}
    assert {r["id"] for r in df.where(cut.inside()).collect()} == want
    assert cut.size == size


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_and_without_pieces(spark, descending):
    pick = random.Random(5)
    rows = [(k, t, pick.randrange(10)) for k in ("x", None) for t in pick.sample(range(1000), 80)]
    df = spark.createDataFrame(rows, "k string, t long, n long")
    plain = running_before(df, ["k"], "t", {"total": "n"}, {"seen": "t"}, descending=descending)
    cuts = cut_points(df, "t", 9)
    assert len(cuts) > 4
    pieced = running_before(df, ["k"], "t", {"total": "n"}, {"seen": "t"}, cuts, descending)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, pieced.collect()), key=key)
    for k, t, _, total, _ in map(tuple, pieced.collect()):
        ahead = [r[2] for r in rows if r[0] == k and (r[1] > t if descending else r[1] < t)]
        assert total == sum(ahead)


def test_text_is_cut_in_its_own_order(spark):
    names = ["", "a", "ab", "abcdefg", "abcdefh", "b", "é", "z", "zz"] * 3
    df = spark.createDataFrame([(n,) for n in names], "v string")
    ranks = list(range(1, len(names) + 1))
    found = order_statistics(df, {"v": ranks}, len(names), rows_per_piece=4)["v"]
    assert [found[k][0] for k in ranks] == sorted(names, key=lambda n: n.encode())


def test_pieces_bound_the_work(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    cuts = cut_points(df, "v", 10)
    assert len(cuts) == 9
    assert all(math.isclose(c, (i + 1) * 1000, rel_tol=0.05) for i, c in enumerate(cuts))


def test_pieces_are_cut_again_past_one_pass(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PIECES_PER_PASS", 4)
    rng = random.Random(4)
    rows = [(rng.random() ** 3, f"ACC-00{rng.randrange(10**6):07d}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "x double, t string")
    cuts = ordering.cut_tables(df, ["x", "t"], 60)
    for column, values in (("x", [r[0] for r in rows]), ("t", [r[1] for r in rows])):
        assert len(cuts[column]) > 30
        sizes = [0] * (len(cuts[column]) + 1)
        for v in values:
            sizes[sum(c <= v for c in cuts[column])] += 1
        assert max(sizes) < 400  # texts with the same first letters don't fall into one piece
    order = [("t", False)]
    size, want = 1234, sorted(r[1] for r in rows)[:1234]
    cut = leading_rows(df, order, [size], 3000, rows_per_piece=50)[0]
    assert sorted(r["t"] for r in df.where(cut.inside()).collect())[:1234] == want


def test_exactly_k_of_repeated_rows_and_nulls_last(spark):
    rows = [(0.9, 1), (0.5, 1), (0.5, 1), (0.1, 1), (None, 1), (float("nan"), None)]
    df = spark.createDataFrame(rows, "s double, t int")
    for k in range(1, 7):
        held, cuts = ordering.exact_rows(df, [("s", True), ("t", False)], [k], 6)
        inside = [r["s"] for r in held.where(cuts[0].inside()).collect()]
        assert len(inside) == k
        assert sorted((x for x in inside if x is not None and x == x), reverse=True) == [0.9, 0.5, 0.5, 0.1][: min(k, 4)]


def test_brackets_of_one_value_need_no_second_look(spark, monkeypatch):
    values = [-0.0] * 3000 + [2.5] * 6000
    df = spark.createDataFrame([(v, 1.0) for v in values] + [(None, float("nan"))] * 9, "a double, b double").repartition(3)
    expected = order_statistics(df, {"a": [1, 4500], "b": [7]}, len(values))
    monkeypatch.setattr(ordering, "running_before", None)
    found = order_statistics(df, {"a": [1, 4500], "b": [7]}, len(values), rows_per_piece=1000)
    assert found == expected == {"a": {1: (0.0, 0, 3000), 4500: (2.5, 3000, 6000)}, "b": {7: (1.0, 0, 9000)}}
    assert math.copysign(1, found["a"][1][0]) == math.copysign(1, expected["a"][1][0])
