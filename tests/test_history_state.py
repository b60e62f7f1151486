"""History of appended rows from stored state, against the history of all rows at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import history as H
from tidewatch.operators.history_state import HistoryState, append_history

SCHEMA = (
    "id int, timestamp timestamp, Sender_account string, Receiver_account string, Amount double, "
    "Payment_currency string, Received_currency string"
)


def rows(seed, n, start, days, decimals=2):
    pick, first = random.Random(seed), dt.datetime(2026, 1, 1) + dt.timedelta(days=start)
    out = []
    for k in range(n):
        at = first + dt.timedelta(hours=pick.randrange(24 * days))
        who = [pick.choice(["a", "b", "c", None, f"s{pick.randrange(30)}"]) for _ in range(2)]
        paid = pick.choice([round(pick.uniform(1, 900), decimals), 5.0, None])
        out.append((seed * 10_000 + k, at, *who, paid, pick.choice(["USD", "EUR", None]), pick.choice(["USD", "EUR"])))
    return out


def features(df):
    return {r["id"]: tuple(r[c] for c in S.HISTORY_FEATURES) for r in df.select("id", *S.HISTORY_FEATURES).collect()}


def same(got, want):
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9), key


def test_appended_batches_equal_one_build(spark, tmp_path):
    """Batches of one day, of sixty days, and after a gap; the third has finer amounts than those before."""
    batches = [rows(1, 150, 0, 60), rows(2, 60, 60, 1), rows(3, 80, 61, 10, decimals=3), rows(4, 80, 130, 20)]
    everything = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = features(H.add_history(everything, ["id"]))
    got, state = {}, None
    for k, batch in enumerate(batches):
        found, state = append_history(spark.createDataFrame(batch, SCHEMA), ["id"], state, str(tmp_path / f"state-{k}"))
        got |= features(found)
        state = HistoryState.load(spark, state.folder)
    same(got, want)
    # The tail holds the last thirty days and no more, the totals all rows.
    tail = state.table(spark, "tail")
    assert tail.agg(F.min("__us")).first()[0] > state.upto - H.DAYS_30
    assert state.table(spark, "pairs").agg(F.sum("n")).first()[0] == sum(map(len, batches))
    assert state.scale == 3


def test_rows_that_overlap_the_state_are_refused(spark):
    _, state = append_history(spark.createDataFrame(rows(1, 20, 0, 2), SCHEMA), ["id"])
    with pytest.raises(ValueError, match="already holds"):
        append_history(spark.createDataFrame(rows(2, 20, 1, 2), SCHEMA), ["id"], state)
    lost = spark.createDataFrame([(1, None, "a", "b", 1.0, "USD", "USD")], SCHEMA)
    with pytest.raises(ValueError, match="no timestamp"):
        append_history(lost, ["id"], state)


def test_an_empty_batch_changes_nothing(spark):
    data = rows(1, 40, 0, 5)
    _, state = append_history(spark.createDataFrame(data, SCHEMA), ["id"])
    none, after = append_history(spark.createDataFrame([], SCHEMA), ["id"], state)
    assert none.count() == 0 and (after.upto, after.scale) == (state.upto, state.scale)
    later = rows(2, 40, 6, 5)
    found, _ = append_history(spark.createDataFrame(later, SCHEMA), ["id"], after)
    want = features(H.add_history(spark.createDataFrame(data + later, SCHEMA), ["id"]))
    same(features(found), {k: v for k, v in want.items() if k >= 20_000})


def test_an_empty_start(spark):
    none, state = append_history(spark.createDataFrame([], SCHEMA), ["id"])
    assert none.count() == 0 and state.upto is None
    data = rows(1, 30, 0, 5)
    found, _ = append_history(spark.createDataFrame(data, SCHEMA), ["id"], state)
    same(features(found), features(H.add_history(spark.createDataFrame(data, SCHEMA), ["id"])))
