"""Account history: hand-made frames, brute force, and the heavy-account path."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest

from tidewatch import schema as S
from tidewatch.operators import history as H

COLUMNS = "id int, timestamp timestamp, Sender_account string, Receiver_account string, Amount double, Payment_currency string, Received_currency string"
NOON = dt.datetime(2026, 3, 1, 12, 0, 0)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def collected(df):
    return {r["id"]: r for r in df.collect()}


def test_rows_of_the_same_instant_do_not_see_each_other(spark):
    df = frame(
        spark,
        [
            (NOON, "p", "x", 10.0, "USD", "USD"),
            (NOON, "p", "y", 20.0, "USD", "USD"),
            (NOON + dt.timedelta(minutes=1), "p", "x", 30.0, "USD", "USD"),
        ],
    )
    rows = collected(H.add_history(df, ["id"]))
    assert [rows[i]["sender_txn_count_24h"] for i in range(3)] == [0, 0, 2]
    assert rows[2]["pair_transaction_count"] == 1
    assert rows[2]["sender_out_degree"] == 2
    assert [rows[i]["seconds_since_sender_txn"] for i in range(3)] == [-1, 0, 60]


def test_history_is_kept_per_currency(spark):
    df = frame(
        spark,
        [
            (NOON, "p", "x", 10.0, "USD", "USD"),
            (NOON + dt.timedelta(hours=1), "p", "x", 99.0, "EUR", "EUR"),
        ],
    )
    last = collected(H.add_history(df, ["id"]))[1]
    assert last["sender_amount_sum_24h"] == 0
    assert last["sender_amount_mean_30d"] == 0
    assert last["sender_counterparty_hhi"] == 0
    assert last["sender_txn_count_lifetime"] == 1


def test_first_transaction_has_no_nulls(spark):
    row = H.add_history(frame(spark, [(NOON, "p", "x", 10.0, "USD", "USD")]), ["id"]).first()
    assert all(row[c] is not None for c in S.HISTORY_FEATURES)
    assert row["seconds_since_sender_txn"] == -1


def test_frame_bounds_are_inclusive_at_the_far_end(spark):
    day = dt.timedelta(days=1)
    tick = dt.timedelta(microseconds=1)
    df = frame(
        spark,
        [
            (NOON, "p", "x", 1.0, "USD", "USD"),
            (NOON + day, "p", "x", 2.0, "USD", "USD"),
            (NOON + day + tick, "p", "x", 4.0, "USD", "USD"),
        ],
    )
    for heavy in (1_000, 1):
        rows = collected(H.add_history(df, ["id"], rows_per_key=heavy))
        assert [rows[i]["sender_amount_sum_24h"] for i in range(3)] == [0.0, 1.0, 2.0]


def test_seconds_count_boundaries_not_elapsed_time(spark):
    start = dt.datetime(2026, 3, 1, 0, 0, 0, 900_000)
    df = frame(
        spark,
        [
            (start, "p", "x", 1.0, "USD", "USD"),
            (start + dt.timedelta(seconds=1, microseconds=200_000), "p", "x", 1.0, "USD", "USD"),
        ],
    )
    assert collected(H.add_history(df, ["id"]))[1]["seconds_since_sender_txn"] == 2


def test_equal_amounts_have_no_deviation(spark):
    rows = [(NOON + dt.timedelta(hours=i), "p", "x", 1234.57, "USD", "USD") for i in range(40)]
    rows.append((NOON + dt.timedelta(hours=41), "p", "x", 9.99, "USD", "USD"))
    found = collected(H.add_history(frame(spark, rows), ["id"]))
    assert all(r["sender_amount_std_30d"] == 0 for r in found.values())
    assert found[40]["sender_amount_zscore"] == 0


def _random_rows(count, seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(count):
        at = NOON + dt.timedelta(hours=pick.randrange(0, 24 * 70))
        sender = pick.choice(["hot", "hot", "hot", "b", "c", None])
        receiver = pick.choice(["hot", "r", "s", "t", "u", None])
        money = pick.choice(["USD", "EUR", None])
        rows.append((at, sender, receiver, round(pick.uniform(0, 5000), 2), money, pick.choice(["USD", "EUR"])))
    return rows


def _brute(rows):
    """The definitions, row by row."""
    day, month = dt.timedelta(days=1), dt.timedelta(days=30)
    out = []
    for i, (at, s, r, amount, pc, rc) in enumerate(rows):
        past = [x for x in rows if x[0] < at]
        own = [x for x in past if x[1] == s]
        purse = [x for x in own if x[4] == pc]
        recent = [x[3] for x in purse if x[0] >= at - day]
        month_amounts = [x[3] for x in purse if x[0] >= at - month]
        into = [x for x in past if x[2] == r]
        into_recent = [x[3] for x in into if x[5] == rc and x[0] >= at - day]
        held, held_now = {}, {}
        for x in purse:
            held[x[2]] = held.get(x[2], 0) + x[3]
        for x in rows:
            if x[0] == at and x[1] == s and x[4] == pc:
                held_now[x[2]] = held.get(x[2], 0)
        mean = np.mean(month_amounts) if month_amounts else 0.0
        std = np.std(month_amounts, ddof=1) if len(month_amounts) > 1 else 0.0

        def share(values, s=s, pc=pc):
            total = sum(values)
            if s is None or pc is None or total == 0:
                return 0.0
            return sum(v * v for v in values) / total**2

        tied = sorted(j for j, x in enumerate(rows) if x[0] == at and x[1] == s)
        before = max((x[0] for x in own), default=None)
        gap = 0 if tied[0] != i else (-1 if before is None else int((at - before).total_seconds()))
        out.append(
            {
                "sender_txn_count_24h": len(recent),
                "sender_amount_sum_24h": sum(recent),
                "sender_amount_mean_30d": mean,
                "sender_amount_std_30d": std,
                "sender_amount_zscore": (amount - mean) / std if std else 0.0,
                "receiver_txn_count_24h": len(into_recent),
                "receiver_amount_sum_24h": sum(into_recent),
                "seconds_since_sender_txn": gap,
                "sender_txn_count_lifetime": len(own),
                "receiver_txn_count_lifetime": len(into),
                "sender_out_degree": len({x[2] for x in own} - {None}),
                "receiver_in_degree": len({x[1] for x in into} - {None}),
                "pair_transaction_count": sum(x[2] == r for x in own),
                "sender_counterparty_hhi": share(held_now.values()),
                "sender_counterparty_hhi_full": share(held.values()),
            }
        )
    return out


@pytest.mark.parametrize(
    ("rows_per_key", "rows_per_piece"), [(10_000, None), (60, 25), (1, 7)], ids=["ordinary", "mixed", "heavy"]
)
def test_brute_force_with_ties_nulls_and_a_hot_account(spark, rows_per_key, rows_per_piece):
    rows = _random_rows(240, seed=7)
    df = frame(spark, rows).repartition(3)
    found = collected(
        H.add_history(
            df, ["id"], rows_per_key=rows_per_key, rows_per_piece=rows_per_piece, full_hhi=True
        )
    )
    assert len(found) == len(rows)
    for i, want in enumerate(_brute(rows)):
        for name, value in want.items():
            assert found[i][name] == pytest.approx(value, abs=1e-7, rel=1e-9), (i, name)


def test_only_accounts_above_the_limit_are_heavy(spark):
    df = frame(spark, [(NOON, s, "x", 1.0, "USD", "USD") for s in ["a"] * 5 + ["b"] * 3 + [None] * 6])
    heavy = H.heavy_accounts(df, [S.SENDER, S.RECEIVER], rows_per_key=4)
    assert {r[0] for r in heavy[S.SENDER].collect()} == {"a", None}
    assert {r[0] for r in heavy[S.RECEIVER].collect()} == {"x"}
    assert H.heavy_accounts(df, [S.SENDER], rows_per_key=10) == {}


def test_ordinary_accounts_take_two_shuffles(spark, small):
    from tidewatch.plans import fixture

    stored = fixture.transactions(spark, small).limit(500)
    plain = spark.createDataFrame(stored.collect(), stored.schema)
    plan = H.add_history(plain, fixture.TIE_BREAK)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("factor", [1.0, 1e-7, 1e9])
@pytest.mark.parametrize("rows_per_key", [10_000, 1])
def test_amounts_keep_their_digits_at_any_scale(spark, factor, rows_per_key):
    rows = [(NOON + dt.timedelta(minutes=k), "p", "x", cents / 100 * factor, "USD", "USD") for k, cents in enumerate([200, 200, 1234567])]
    rows = [(a, b, c, float(f"{x:.10g}"), *rest) for a, b, c, x, *rest in rows]
    seen = collected(H.add_history(frame(spark, rows), ["id"], rows_per_key=rows_per_key))
    assert seen[1]["sender_amount_sum_24h"] == pytest.approx(2 * factor, rel=1e-12)
    assert seen[2]["sender_amount_sum_24h"] == pytest.approx(4 * factor, rel=1e-12)
    assert seen[2]["sender_amount_std_30d"] == 0.0


def test_amounts_with_too_many_digits_fail_loudly(spark):
    df = frame(spark, [(NOON, "p", "x", 0.00002, "USD", "USD"), (NOON, "p", "x", 1e15, "USD", "USD")])
    with pytest.raises(ValueError, match="digits"):
        H.add_history(df, ["id"])


@pytest.mark.parametrize("rows_per_key", [10_000, 1])
def test_one_of_several_equal_rows_carries_the_gap(spark, rows_per_key):
    later = NOON + dt.timedelta(minutes=1)
    rows = [(NOON, "p", "x", 1.0, "USD", "USD"), (later, "p", "x", 1.0, "USD", "USD"), (later, "p", "x", 1.0, "USD", "USD")]
    df = frame(spark, rows).withColumn("same", H.F.lit(1))
    seen = H.add_history(df, ["same"], rows_per_key=rows_per_key).collect()
    assert sorted(r["seconds_since_sender_txn"] for r in seen) == [-1, 0, 60]


def test_more_rows_than_the_sessions_partitions_should_sort(spark, monkeypatch):
    pick = random.Random(8)
    payments = [
        (NOON + dt.timedelta(hours=pick.randrange(2000)), f"s{pick.randrange(9)}", f"r{pick.randrange(9)}", float(pick.randrange(1, 99)), "USD", "USD")
        for _ in range(300)
    ]
    df = frame(spark, payments)
    want = collected(H.add_history(df, ["id"]))
    monkeypatch.setattr(H, "ROWS_PER_SORT", 20)
    cut = H.add_history(df, ["id"])
    assert cut.rdd.getNumPartitions() == 15
    assert collected(cut) == want


def test_totals_are_the_same_as_longs_and_as_decimals(spark, monkeypatch):
    pick = random.Random(8)
    rows = [
        (NOON + dt.timedelta(hours=pick.randrange(900)), pick.choice(["p", "q", None]), pick.choice("xyz"), pick.choice([0.1, 7.25, 1e6, None]), "USD", "EUR")
        for _ in range(200)
    ]
    df = frame(spark, rows)
    sides = [S.SENDER, S.RECEIVER]
    # Squared amounts in cents fit a long here, and no longer with a large amount beside a small one.
    assert H._measured(df, sides, H.ROWS_PER_KEY, True)[3]
    assert not H._measured(frame(spark, [*rows, (NOON, "p", "x", 1e11, "USD", "EUR")]), sides, H.ROWS_PER_KEY, True)[3]
    longs = collected(H.add_history(df, ["id"]))
    monkeypatch.setattr(H, "NARROW", 0)
    assert longs == collected(H.add_history(df, ["id"]))


def test_decimals_told_by_arithmetic_are_those_written_out(spark):
    pick = random.Random(7)
    amounts = [0.01, 0.1, 0.29, 1.005, 8.7, 70.0, 1200.0, 1e11 + 0.25, 99999999999.99, 123.456, 1e-5, 4.35, -17.25, -300.0, 9e15, 3.0]
    amounts += [pick.randrange(1, 10 ** pick.randrange(1, 13)) / 10 ** pick.randrange(0, 5) for _ in range(400)]
    df = spark.createDataFrame([(float(a),) for a in [*amounts, float("inf"), float("nan"), 0.0]] + [(None,)], "Amount double")
    found = df.groupBy("Amount").agg(*H._amount_extent()).collect()
    for r in found:
        a = r["Amount"]
        if a is None or a != a or a in (0.0, float("inf")):
            assert (r["largest"], r["decimals"], r["exact"]) == (None, None, None)
        else:
            assert (r["largest"], r["decimals"], r["exact"]) == (abs(a), -Decimal(repr(abs(a))).normalize().as_tuple().exponent, True)


def test_common_amounts_are_not_written_out(spark, monkeypatch):
    """The digits of amounts in cents are told without the text of the number, which would refuse this translation."""
    monkeypatch.setattr(H.F, "translate", lambda *_: H.F.raise_error(H.F.lit("written out")).cast("string"))
    df = spark.createDataFrame([(19.99,), (0.5,), (7.0,)], "Amount double")
    assert H.unit_scale(df) == 2
