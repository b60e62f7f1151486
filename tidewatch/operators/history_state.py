"""History of appended days from stored state.

After a build, the past is five tables: totals of each account, of each pair and of each pair in a currency, the rows of
the last thirty days, and one row that says up to when they hold. The history of new rows needs the state of their own accounts
and nothing else: moving frames run over the stored tail and the new rows, everything older is a total.
Appending merges the new totals in; the work follows the new rows and the state, not the past.

Amounts are whole numbers of the unit that holds all amounts so far. A day that needs more decimals moves the
stored totals to the finer unit first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import schema as S
from tidewatch.functions.columns import micros
from tidewatch.operators.history import (
    DAY_24H,
    DAYS_30,
    _SQUARES,
    _TOTAL,
    _UNITS,
    _concentration,
    _frame_sum,
    clean_history,
    from_units,
    in_units,
    moments,
    unit_scale,
)
from tidewatch.plans.ordering import lookup
from tidewatch.session import shared_folder, stored

_US, _X, _FRESH = "__us", "__x", "__fresh"
#: The keys of each table; ``which`` tells payers from payees.
KEYS = {
    "accounts": ["which", "account"],
    "pairs": [S.SENDER, S.RECEIVER],
    "flows": [S.SENDER, S.PAID_IN, S.RECEIVER],
}
TAIL = [_US, S.SENDER, S.RECEIVER, S.PAID_IN, S.RECEIVED_IN, _X]


@dataclass(frozen=True)
class HistoryState:
    """Where the tables of a state lie, and up to when (microseconds) and in which unit they hold."""

    folder: str
    upto: int | None
    scale: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> HistoryState:
        row = spark.read.parquet(f"{folder}/state").first()
        return HistoryState(folder, row["upto"], row["scale"])


def _keyed(df: DataFrame, scale: int) -> DataFrame:
    return df.withColumns({_US: micros(F.col(S.TIMESTAMP)), _X: in_units(scale)})


def _summed(rows: DataFrame, name: str) -> DataFrame:
    """The rows' own contribution to a table of totals."""
    if name == "pairs":
        return rows.groupBy(*KEYS[name]).agg(F.count(F.lit(1)).alias("n"))
    if name == "flows":
        return rows.groupBy(*KEYS[name]).agg(F.coalesce(F.sum(_X), F.lit(0)).cast(_TOTAL).alias("units"))
    sides = [F.struct(F.lit(w).alias("which"), F.col(c).cast("string").alias("account")) for w, c in (("payer", S.SENDER), ("payee", S.RECEIVER))]
    return (
        rows.select(F.explode(F.array(*sides)).alias("side"), _US)
        .groupBy("side.which", "side.account")
        .agg(F.count(F.lit(1)).alias("lifetime"), F.max(_US).alias("last"))
    )


def _degrees(pairs: DataFrame) -> DataFrame:
    """Distinct counterparties of each account among some pairs, by side; a missing counterparty is none."""
    sides = [
        F.struct(F.lit(w).alias("which"), F.col(c).cast("string").alias("account"), F.col(o).isNotNull().cast("long").alias("new"))
        for w, c, o in (("payer", S.SENDER, S.RECEIVER), ("payee", S.RECEIVER, S.SENDER))
    ]
    return pairs.select(F.explode(F.array(*sides)).alias("side")).groupBy("side.which", "side.account").agg(F.sum("side.new").alias("degree"))


def _empty(rows: DataFrame, name: str) -> DataFrame:
    if name == "accounts":
        return lookup(_summed(rows, name), _degrees(rows), KEYS[name]).limit(0)
    return _summed(rows, name).limit(0)


def _stored(spark: SparkSession, state: HistoryState | None, rows: DataFrame, name: str, scale: int) -> DataFrame:
    if state is None:
        return _empty(rows, name)
    table = state.table(spark, name)
    finer = scale - state.scale
    if finer and name == "flows":
        return table.withColumn("units", (F.col("units") * F.lit(10**finer).cast("decimal(20,0)")).cast(_TOTAL))
    return table


def _tail(spark: SparkSession, state: HistoryState | None, rows: DataFrame, scale: int) -> DataFrame:
    if state is None:
        return rows.select(*TAIL).limit(0)
    table = state.table(spark, "tail")
    finer = scale - state.scale
    return table.withColumn(_X, (F.col(_X) * F.lit(10**finer).cast("decimal(14,0)")).cast(_UNITS)) if finer else table


def _frames(rows: DataFrame, new: DataFrame, tail: DataFrame, account: str, currency: str) -> DataFrame:
    """Moving counts and sums of ``rows``, which are the new rows with more columns, over them and the tail of their accounts.

    The rows are left partitioned by account, so further windows of the account need no exchange.
    """
    old = lookup(tail, new.select(account).distinct(), [account], "left_semi").select(account, currency, _US, _X)
    rows = rows.withColumn(_FRESH, F.lit(True)).unionByName(old.withColumn(_FRESH, F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition(F.col(account))
    start = Window.unboundedPreceding
    purse = Window.partitionBy(account, currency).orderBy(_US)
    before, day, month = (purse.rangeBetween(start, end) for end in (-1, -DAY_24H - 1, -DAYS_30 - 1))
    x = F.col(_X)
    return rows.withColumns(
        {
            "h_count_24h": F.count(F.lit(1)).over(before) - F.count(F.lit(1)).over(day),
            "h_sum_24h": _frame_sum(x, _TOTAL, before, day),
            "h_count_30d": F.count(_X).over(before) - F.count(_X).over(month),
            "h_sum_30d": _frame_sum(x, _TOTAL, before, month),
            "h_squares_30d": _frame_sum(x * x, _SQUARES, before, month),
        }
    ).where(_FRESH).drop(_FRESH)


def _with_account(rows: DataFrame, account: str, accounts: DataFrame, which: str) -> DataFrame:
    """What the state holds of each row's account."""
    own = accounts.where(F.col("which") == which).select(
        F.col("account").cast(rows.schema[account].dataType).alias(account), F.col("lifetime").alias("__lifetime"), F.col("degree").alias("__degree"), F.col("last").alias("__last")
    )
    return lookup(rows, own, [account])


def _totals(rows: DataFrame, account: str, other: str, fresh: Column) -> DataFrame:
    """Lifetime counts and distinct counterparties: those of the state and of earlier new rows."""
    life = Window.partitionBy(account).orderBy(_US).rangeBetween(Window.unboundedPreceding, -1)
    pair = Window.partitionBy(account, other).orderBy(_US)
    first = fresh & F.lag(_US).over(pair).isNull() & F.col(other).isNotNull()
    known = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.withColumn("__first", first.cast("long")).withColumns(
        {
            "h_lifetime": known("__lifetime") + F.count(F.lit(1)).over(life),
            "h_degree": known("__degree") + F.coalesce(F.sum("__first").over(life), F.lit(0).cast("long")),
        }
    ).drop("__first", "__lifetime", "__degree")


#: The features in the order they are appended.
_APPENDED = [
    "pair_transaction_count",
    "sender_counterparty_hhi",
    "seconds_since_sender_txn",
    "sender_txn_count_lifetime",
    "sender_out_degree",
    "receiver_txn_count_lifetime",
    "receiver_in_degree",
    "sender_txn_count_24h",
    "sender_amount_sum_24h",
    "sender_amount_mean_30d",
    "sender_amount_std_30d",
    "sender_amount_zscore",
    "receiver_txn_count_24h",
    "receiver_amount_sum_24h",
]


def _history(new: DataFrame, spark: SparkSession, state: HistoryState | None, tie_break: Sequence[str], scale: int) -> DataFrame:
    """The state of a row's account and pairs is looked up first; then all windows of a side share one exchange by account."""
    pairs, flows, accounts = (_stored(spark, state, new, name, scale) for name in ("pairs", "flows", "accounts"))
    tail = _tail(spark, state, new, scale)
    start = Window.unboundedPreceding
    frames = ["h_count_24h", "h_sum_24h", "h_count_30d", "h_sum_30d", "h_squares_30d"]
    rows = lookup(new, pairs.select(*KEYS["pairs"], F.col("n").alias("__pairs")), KEYS["pairs"])
    rows = lookup(rows, flows.select(*KEYS["flows"], F.col("units").alias("__held_units")), KEYS["flows"])
    rows = _frames(_with_account(rows, S.SENDER, accounts, "payer"), new, tail, S.SENDER, S.PAID_IN)
    mean, deviation = moments(F.col("h_count_30d"), F.col("h_sum_30d"), F.col("h_squares_30d"), scale)
    rows = rows.withColumns(
        {
            "sender_txn_count_24h": F.col("h_count_24h"),
            "sender_amount_sum_24h": from_units(F.col("h_sum_24h"), scale),
            "sender_amount_mean_30d": mean,
            "sender_amount_std_30d": deviation,
        }
    ).drop(*frames)
    spread = F.col("sender_amount_std_30d")
    score = (F.col(S.AMOUNT) - F.col("sender_amount_mean_30d")) / spread
    rows = rows.withColumn("sender_amount_zscore", F.when(spread.isNull() | (spread == 0), F.lit(0.0)).otherwise(score))

    flow = Window.partitionBy(*KEYS["flows"]).orderBy(_US)
    pair = Window.partitionBy(S.SENDER, S.RECEIVER).orderBy(_US)
    last_seen = F.lag(_US).over(flow)
    earlier = F.coalesce(F.sum(_X).over(flow.rangeBetween(start, -1)), F.lit(0))
    rows = rows.withColumns(
        {
            "__prior": (earlier + F.coalesce(F.col("__held_units"), F.lit(0))).cast("double"),
            "__lead": last_seen.isNull() | (last_seen < F.col(_US)),
            "pair_transaction_count": F.coalesce(F.col("__pairs"), F.lit(0)) + F.count(F.lit(1)).over(pair.rangeBetween(start, -1)),
        }
    )
    # One row stands for all payments to a counterparty at one instant.
    moment = Window.partitionBy(S.SENDER, S.PAID_IN, _US)
    held = F.when(F.col("__lead"), F.col("__prior")).otherwise(0.0)
    known = F.col(S.SENDER).isNotNull() & F.col(S.PAID_IN).isNotNull()
    rows = rows.withColumn("sender_counterparty_hhi", _concentration(known, F.sum(held).over(moment), F.sum(held * held).over(moment)))

    unseen = F.col("__pairs").isNull()
    rows = _totals(rows, S.SENDER, S.RECEIVER, unseen)
    turn = Window.partitionBy(S.SENDER).orderBy(_US, *tie_break)
    previous = F.coalesce(F.lag(_US).over(turn), F.col("__last"))
    gap = F.unix_seconds(F.timestamp_micros(_US)) - F.unix_seconds(F.timestamp_micros("__previous"))
    rows = rows.withColumn("__previous", previous).withColumns(
        {
            "seconds_since_sender_txn": F.coalesce(gap, F.lit(-1).cast("long")),
            "sender_txn_count_lifetime": F.col("h_lifetime"),
            "sender_out_degree": F.col("h_degree"),
        }
    ).drop("h_lifetime", "h_degree", "__last", "__previous", "__prior", "__lead", "__held_units")

    rows = _frames(_with_account(rows, S.RECEIVER, accounts, "payee"), new, tail, S.RECEIVER, S.RECEIVED_IN)
    rows = _totals(rows, S.RECEIVER, S.SENDER, unseen).withColumns(
        {
            "receiver_txn_count_24h": F.col("h_count_24h"),
            "receiver_amount_sum_24h": from_units(F.col("h_sum_24h"), scale),
            "receiver_txn_count_lifetime": F.col("h_lifetime"),
            "receiver_in_degree": F.col("h_degree"),
        }
    )
    return clean_history(rows.select(*[c for c in new.columns if c not in (_US, _X)], *_APPENDED))


def _merged(new: DataFrame, spark: SparkSession, state: HistoryState | None, scale: int, upto: int | None, folder: str) -> None:
    """Write the state after ``new`` to ``folder``."""
    pairs = _stored(spark, state, new, "pairs", scale)
    fresh = _summed(new, "pairs")
    unseen = lookup(fresh, pairs.drop("n"), KEYS["pairs"], "left_anti")
    accounts = _stored(spark, state, new, "accounts", scale)
    added = lookup(_summed(new, "accounts"), _degrees(unseen), KEYS["accounts"])
    both = accounts.unionByName(added)
    both.groupBy(*KEYS["accounts"]).agg(
        F.sum("lifetime").alias("lifetime"), F.max("last").alias("last"), F.coalesce(F.sum("degree"), F.lit(0).cast("long")).alias("degree")
    ).write.parquet(f"{folder}/accounts")
    pairs.unionByName(fresh).groupBy(*KEYS["pairs"]).agg(F.sum("n").alias("n")).write.parquet(f"{folder}/pairs")
    flows = _stored(spark, state, new, "flows", scale).unionByName(_summed(new, "flows"))
    flows.groupBy(*KEYS["flows"]).agg(F.sum("units").cast(_TOTAL).alias("units")).write.parquet(f"{folder}/flows")
    tail = _tail(spark, state, new, scale).unionByName(new.select(*TAIL))
    kept = tail if upto is None else tail.where(F.col(_US) > upto - DAYS_30)
    kept.write.parquet(f"{folder}/tail")
    spark.createDataFrame([(upto, scale)], "upto long, scale int").coalesce(1).write.parquet(f"{folder}/state")


def append_history(
    df: DataFrame,
    tie_break: Sequence[str],
    state: HistoryState | None = None,
    folder: str | None = None,
    amount_scale: int | None = None,
) -> tuple[DataFrame, HistoryState]:
    """New rows with the 14 history features, and the state after them, stored in ``folder``.

    Without a state the rows are the first ones. All of them must lie after everything the state holds, since what
    happens at one instant doesn't see each other. Rows without a timestamp can't be placed and are refused. An empty
    table changes nothing but the folder.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/history-state-{uuid4().hex}"
    df = stored(df, "appended-rows")
    span = df.agg(F.min(micros(F.col(S.TIMESTAMP))).alias("first"), F.max(micros(F.col(S.TIMESTAMP))).alias("last"), F.count_if(F.col(S.TIMESTAMP).isNull()).alias("lost")).first()
    if span["lost"]:
        raise ValueError(f"{span['lost']} rows have no timestamp")
    if state and state.upto is not None and span["first"] is not None and span["first"] <= state.upto:
        raise ValueError(f"rows start at {span['first']}, but the state already holds everything up to {state.upto}")
    scale = unit_scale(df) if amount_scale is None else amount_scale
    scale = max(scale, state.scale) if state and state.upto is not None else scale
    upto = span["last"] if span["last"] is not None else (state.upto if state else None)
    new = _keyed(df, scale)
    _merged(new, spark, state, scale, upto, folder)
    return _history(new, spark, state, tie_break, scale), HistoryState(folder, upto, scale)
