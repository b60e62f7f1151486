"""Point-in-time account history: what was known strictly before each transaction.

Two ways to the same values:

* Ordinary accounts: one shuffle by account, then built-in windows. Every frame
  grows from the start of the account (a moving 24 h frame is the difference of
  two growing frames), so the work is linear however dense the account is.
* Heavy accounts - more rows than one task should hold - are first combined to
  one row per account, counterparty, currency and instant, and the running
  totals over instants are taken piece by piece in time (``running_before``).
  Rows then look their instant up with an equi-join.

Amounts are summed as whole numbers of a unit, the largest power of ten that
all of them are multiples of: nothing is rounded, differences of running totals stay
exact, and results don't depend on how the data is partitioned or on its scale.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidewatch import schema as S
from tidewatch.functions.columns import finite_or_zero, micros
from tidewatch.plans.ordering import cut_points, lookup, pieces_for, running_before, with_piece
from tidewatch.session import materialize, stored

DAY_24H = 86_400_000_000
DAYS_30 = 30 * DAY_24H
ROWS_PER_KEY = 5_000_000
#: Rows a task of ordinary accounts should sort.
ROWS_PER_SORT = 250_000
MAX_HEAVY_KEYS = 100_000
#: Sums of squares below this are kept as longs.
NARROW = 2.0**62
#: Digits an amount may have in units: squares of that many, summed over a billion rows, are exact.
AMOUNT_DIGITS = 14

_US, _X, _TIE, _ROW, _PIECE = "__us", "__x", "__tie", "__row", "__piece"
#: An instant before all others, far enough from the end of the range for a frame to end before it.
_OPENING = -(1 << 62)
_UNITS = f"decimal({AMOUNT_DIGITS},0)"
_TOTAL, _SQUARES = "decimal(30,0)", "decimal(37,0)"


@dataclass(frozen=True)
class Side:
    """Whose history is taken, in which currency, against which counterparty, and whether its concentration is wanted."""

    account: str
    currency: str
    other: str
    concentrated: bool


PAYER = Side(S.SENDER, S.PAID_IN, S.RECEIVER, True)
PAYEE = Side(S.RECEIVER, S.RECEIVED_IN, S.SENDER, False)

# Internal outputs of one side.
_OUT = [
    "h_count_24h",
    "h_sum_24h",
    "h_count_30d",
    "h_sum_30d",
    "h_squares_30d",
    "h_lifetime",
    "h_degree",
    "h_pair_count",
    "h_previous",
    "h_first_in_tie",
    "h_hhi",
    "h_hhi_full",
]


def add_history(
    df: DataFrame,
    tie_break: Sequence[str],
    rows_per_key: int = ROWS_PER_KEY,
    rows_per_piece: int | None = None,
    amount_scale: int | None = None,
    full_hhi: bool = False,
) -> DataFrame:
    """Append the 14 behavioral and network features.

    ``tie_break`` orders rows of one instant, and with the timestamp must tell
    rows apart; it only decides which of them carries the gap since the
    previous payment. ``full_hhi`` also appends the concentration over all
    counterparties of the past, not just those paid at this instant.
    ``amount_scale`` is the number of decimals of the amounts, negative for multiples of
    a power of ten; if it isn't given, one pass over the amounts finds it.
    """
    df = stored(df, "history-input")
    found, heavy, rows, narrow = _measured(df, [S.SENDER, S.RECEIVER], rows_per_key, amount_scale is None)
    amount_scale = found if amount_scale is None else amount_scale
    given = df.columns
    # Receivers first: what they add is less than what senders add, and the second exchange carries it.
    df = add_receiver_history(df, heavy, rows_per_piece, amount_scale, rows, narrow)
    received = [c for c in df.columns if c not in given]
    df = add_sender_history(df, tie_break, heavy, rows_per_piece, amount_scale, full_hhi, rows, narrow)
    sent = [c for c in df.columns if c not in given and c not in received]
    return clean_history(df.select(*given, *sent, *received))


def unit_scale(df: DataFrame) -> int:
    """The fewest decimals (negative: trailing zeros) that hold every amount exactly.

    Fails if the largest amount then has more digits than exact squares allow.
    """
    return _scale_of(df.agg(*_amount_extent()).first())


def _amount_extent() -> list[Column]:
    """Largest amount, most decimals, and whether the decimals hold all amounts, as aggregates.

    Arithmetic tells the decimals of an amount of up to two that a double holds in 13 digits; only others are written out.
    """
    amount = _finite_amount()
    amount = F.when(F.abs(amount).between(0.0, 1e19) & (amount != 0), F.abs(amount))
    written = amount.cast("decimal(38,18)")
    digits = F.translate(written.cast("string"), ".", "")
    counted = 18 - (F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))))
    plain = (amount < 1e11) & (F.rint(amount * 100.0) / 100.0 == amount)
    tenths, whole, round_ = F.rint(amount * 10.0) / 10.0 == amount, F.rint(amount) == amount, F.rint(amount / 10.0) * 10.0 == amount
    decimals = F.when(plain & ~tenths, 2).when(plain & ~whole, 1).when(plain & ~round_, 0).otherwise(counted)
    exact = F.when(plain, True).otherwise(written.cast("double") == amount)
    return [F.max(amount).alias("largest"), F.max(decimals).alias("decimals"), F.bool_and(exact).alias("exact")]


def _scale_of(found: Row) -> int:
    if found["largest"] is None:
        return 0
    scale = found["decimals"]
    if not found["exact"] or found["largest"] * 10.0**scale >= 10.0**AMOUNT_DIGITS:
        raise ValueError(
            f"column {S.AMOUNT} has amounts up to {found['largest']} that need more than {AMOUNT_DIGITS} digits together; "
            "round them, or pass amount_scale to have them rounded"
        )
    return scale


def _finite_amount() -> Column:
    amount = F.col(S.AMOUNT).cast("double")
    return F.when(~F.isnan(amount) & (F.abs(amount) < float("inf")), amount)


def in_units(scale: int) -> Column:
    """The amount as a whole number of units; null if it isn't finite."""
    finite = _finite_amount()
    return F.round(finite * 10.0**scale if scale >= 0 else finite / 10.0**-scale, 0).cast(_UNITS)


def from_units(value: Column, scale: int) -> Column:
    value = value.cast("double")
    return value / 10.0**scale if scale >= 0 else value * 10.0**-scale


def clean_history(df: DataFrame) -> DataFrame:
    """Infinities and missing values of the history features become 0."""
    names = [c for c in [*S.HISTORY_FEATURES, "sender_counterparty_hhi_full"] if c in df.columns]
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in names})


def add_sender_history(
    df: DataFrame,
    tie_break: Sequence[str],
    heavy: dict[str, DataFrame] | None = None,
    rows_per_piece: int | None = None,
    amount_scale: int | None = None,
    full_hhi: bool = False,
    rows: int | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Sender features as the frames give them: mean and deviation are null without history.

    ``heavy`` is what ``heavy_accounts`` found, ``rows`` the number of rows, if the caller has them, and ``narrow`` whether a long
    holds the squared amounts of any ordinary account.
    """
    df, heavy, amount_scale, rows, narrow = _prepared(df, S.SENDER, heavy, amount_scale, rows, narrow)
    seen = _side_history(df, PAYER, tie_break, heavy.get(S.SENDER), rows_per_piece, amount_scale, full_hhi, rows, narrow)
    mean, deviation = moments(F.col("h_count_30d"), F.col("h_sum_30d"), F.col("h_squares_30d"), amount_scale)
    gap = F.unix_seconds(F.timestamp_micros(_US)) - F.unix_seconds(F.timestamp_micros("h_previous"))
    seen = seen.withColumns(
        {
            "sender_txn_count_24h": F.col("h_count_24h"),
            "sender_amount_sum_24h": from_units(F.col("h_sum_24h"), amount_scale),
            "sender_amount_mean_30d": mean,
            "sender_amount_std_30d": deviation,
            "seconds_since_sender_txn": F.when(~F.col("h_first_in_tie"), F.lit(0).cast("long")).otherwise(
                F.coalesce(gap, F.lit(-1).cast("long"))
            ),
            "sender_txn_count_lifetime": F.col("h_lifetime"),
            "sender_out_degree": F.col("h_degree"),
            "pair_transaction_count": F.col("h_pair_count"),
            "sender_counterparty_hhi": F.col("h_hhi"),
        }
        | ({"sender_counterparty_hhi_full": F.col("h_hhi_full")} if full_hhi else {})
    )
    spread = F.col("sender_amount_std_30d")
    return seen.withColumn(
        "sender_amount_zscore",
        F.when(spread.isNull() | (spread == 0), F.lit(0.0)).otherwise(
            (F.col(S.AMOUNT) - F.col("sender_amount_mean_30d")) / spread
        ),
    ).drop(_US, _X, _TIE, _ROW, *_OUT)


def add_receiver_history(
    df: DataFrame,
    heavy: dict[str, DataFrame] | None = None,
    rows_per_piece: int | None = None,
    amount_scale: int | None = None,
    rows: int | None = None,
    narrow: bool = False,
) -> DataFrame:
    df, heavy, amount_scale, rows, narrow = _prepared(df, S.RECEIVER, heavy, amount_scale, rows, narrow)
    seen = _side_history(df, PAYEE, [], heavy.get(S.RECEIVER), rows_per_piece, amount_scale, rows=rows, narrow=narrow)
    return seen.withColumns(
        {
            "receiver_txn_count_24h": F.col("h_count_24h"),
            "receiver_amount_sum_24h": from_units(F.col("h_sum_24h"), amount_scale),
            "receiver_txn_count_lifetime": F.col("h_lifetime"),
            "receiver_in_degree": F.col("h_degree"),
        }
    ).drop(_US, _X, _TIE, _ROW, *_OUT)


def _prepared(
    df: DataFrame, account: str, heavy: dict[str, DataFrame] | None, amount_scale: int | None, rows: int | None, narrow: bool
) -> tuple[DataFrame, dict[str, DataFrame], int, int | None, bool]:
    """The input, stored if anything has to be found out about it first, with its heavy accounts, its unit, its rows and whether sums are narrow."""
    if heavy is not None and amount_scale is not None:
        return df, heavy, amount_scale, rows, narrow
    df = stored(df, "history-input")
    scale, found, counted, fits = _measured(df, [account], ROWS_PER_KEY, amount_scale is None)
    # Accounts that the caller calls ordinary may have more rows than those found so here.
    return df, found if heavy is None else heavy, scale if amount_scale is None else amount_scale, counted, fits and heavy is None


def moments(n: Column, total: Column, squares: Column, scale: int) -> tuple[Column, Column]:
    """Mean and sample deviation from exact sums of units; equal amounts give exactly 0.

    The squares are re-centred on the mean rounded to a whole unit while still
    exact, so nothing cancels once they become doubles.
    """
    mean = F.try_divide(from_units(total, scale), n.cast("double"))
    centre = F.round(F.try_divide(total.cast("double"), n.cast("double"))).cast("decimal(18,0)")
    off_centre = (total - n * centre).cast("decimal(18,0)")
    shifted = (total + off_centre).cast("decimal(19,0)")
    about_centre = squares.cast("decimal(37,0)") - (centre * shifted).cast("decimal(37,0)")
    about_mean = about_centre.cast("double") - off_centre.cast("double") * off_centre.cast("double") / n
    deviation = F.when(n > 1, F.sqrt(F.greatest(about_mean, F.lit(0.0)) / (n - 1)))
    return mean, from_units(deviation, scale)


def heavy_accounts(
    df: DataFrame, accounts: Sequence[str], rows_per_key: int = ROWS_PER_KEY
) -> dict[str, DataFrame]:
    """Per account column, the accounts with more rows than one task should hold.

    One pass counts all columns with map-side combine. The limit rises with the
    table so that at most MAX_HEAVY_KEYS accounts of a column can exceed it;
    that bound is what allows broadcasting them. Columns without any are absent.
    """
    return _measured(df, accounts, rows_per_key, False)[1]


def _measured(
    df: DataFrame, accounts: Sequence[str], rows_per_key: int, amounts: bool
) -> tuple[int | None, dict[str, DataFrame], int, bool]:
    """The unit of the amounts, if wanted, the heavy accounts, the number of rows, and whether a long is known to hold the squared
    amounts of any other account in units, from one pass over the rows."""
    # Every row is a cell of each column; its amount goes with the first of them.
    amount = [F.when(F.lit(i == 0), F.col(S.AMOUNT)).alias(S.AMOUNT) for i in range(len(accounts))] if amounts else [None] * len(accounts)
    cells = [
        F.struct(F.lit(c).alias("which"), F.col(c).cast("string").alias("account"), *([a] if amounts else []))
        for c, a in zip(accounts, amount, strict=True)
    ]
    extent = _amount_extent() if amounts else []
    counts = (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .groupBy("which", "account")
        .agg(F.count(F.lit(1)).alias("n"), *extent)
    )
    counts = materialize(counts, "account-counts")
    merged = [F.max("largest").alias("largest"), F.max("decimals").alias("decimals"), F.bool_and("exact").alias("exact")] if amounts else []
    tops = counts.groupBy("which").agg(F.max("n").alias("most"), F.sum("n").alias("rows"), *merged).collect()
    held = next((top for top in tops if top["which"] == accounts[0]), None)
    scale = _scale_of(held) if amounts and held else 0 if amounts else None
    found, ordinary = {}, 0
    for top in tops:
        limit = max(rows_per_key, top["rows"] // MAX_HEAVY_KEYS)
        ordinary = max(ordinary, min(top["most"], limit))
        if top["most"] > limit:
            keys = counts.where((F.col("which") == top["which"]) & (F.col("n") > limit))
            rows = [(r["account"],) for r in keys.select("account").collect()]
            column = top["which"]
            table = df.sparkSession.createDataFrame(rows, f"`{column}` string")
            found[column] = table.select(F.col(column).cast(df.schema[column].dataType).alias(column))
    largest = (held["largest"] or 0.0) * 10.0**scale + 1 if amounts and held else math.inf
    return scale, found, max((top["rows"] for top in tops), default=0), ordinary * largest**2 < NARROW


def _side_history(
    df: DataFrame,
    side: Side,
    tie_break: Sequence[str],
    heavy: DataFrame | None,
    rows_per_piece: int | None,
    scale: int,
    full_hhi: bool = False,
    rows: int | None = None,
    narrow: bool = False,
) -> DataFrame:
    if heavy is None:
        return _by_account(df, side, tie_break, rows, narrow, scale)
    keyed = _with_units(df, scale)
    # Both branches and every lookup below read this table, so it is computed once; row numbers
    # tell rows apart that repeat entirely.
    keyed = materialize(keyed.withColumn(_ROW, F.monotonically_increasing_id()), "history-rows")
    ordinary = lookup(keyed, F.broadcast(heavy), [side.account], "left_anti")
    crowded = lookup(keyed, F.broadcast(heavy), [side.account], "left_semi")
    cuts = cut_points(crowded, _US, pieces_for(crowded.count(), rows_per_piece))
    return _by_account(ordinary, side, tie_break, rows, narrow).unionByName(_by_instant(crowded, side, tie_break, cuts, full_hhi))


def pair_history(
    df: DataFrame,
    heavy: dict[str, DataFrame] | None = None,
    rows_per_piece: int | None = None,
    amount_scale: int | None = None,
) -> DataFrame:
    """Value a sender pays a counterparty at an instant, and what that summed to before."""
    amount_scale = unit_scale(df) if amount_scale is None else amount_scale
    heavy = heavy_accounts(df, [S.SENDER]) if heavy is None else heavy
    keys = [S.SENDER, S.PAID_IN, S.RECEIVER]
    pairs = (
        df.withColumn(_US, micros(F.col(S.TIMESTAMP)))
        .groupBy(*keys, _US)
        .agg(F.sum(in_units(amount_scale)).alias("pair_amount"))
    )
    cuts: list[float] = []
    if heavy:
        pairs = materialize(pairs, "pair-history")
        cuts = cut_points(pairs, _US, pieces_for(pairs.count(), rows_per_piece))
    seen = running_before(pairs, keys, _US, {"historical_pair_amount": "pair_amount"}, cuts=cuts)
    return seen.select(
        *keys,
        F.timestamp_micros(_US).alias(S.TIMESTAMP),
        from_units(F.col("pair_amount"), amount_scale).alias("pair_amount"),
        from_units(F.col("historical_pair_amount"), amount_scale).alias("historical_pair_amount"),
    )


def _with_units(df: DataFrame, scale: int) -> DataFrame:
    return df.withColumns({_US: micros(F.col(S.TIMESTAMP)), _X: in_units(scale)})


def _by_account(
    df: DataFrame, side: Side, tie_break: Sequence[str], rows: int | None = None, narrow: bool = False, scale: int | None = None
) -> DataFrame:
    """All windows of one side over a single shuffle by account.

    Instants and units that the rows don't have yet are worked out behind the shuffle, which needn't carry them.

    Running totals are decimals, or longs if the totals of an account are known to be ``narrow``: the same whole numbers, summed faster.

    A task sorts its rows several times, so where the session's partitions would
    hold more than ``ROWS_PER_SORT`` of the ``rows`` there are more of them.

    Partition keys that contain the account need no further exchange, and the
    windows are ordered so that each sort serves as many of them as it can.
    """
    account, currency, other = side.account, side.currency, side.other
    start = Window.unboundedPreceding
    parts = math.ceil((rows or 0) / ROWS_PER_SORT)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(parts, F.col(account)) if parts > usual else df.repartition(F.col(account))
    if _US not in df.columns:
        df = _with_units(df, scale)

    units = F.col(_X).cast("long") if narrow else F.col(_X)
    total_type, squares_type = ("long", "long") if narrow else (_TOTAL, _SQUARES)
    flow = Window.partitionBy(account, currency, other).orderBy(_US)
    prior = F.coalesce(F.sum(units).over(flow.rangeBetween(start, -1)), F.lit(0)).cast("double")
    through = F.coalesce(F.sum(units).over(flow.rangeBetween(start, 0)), F.lit(0)).cast("double")
    last_seen = F.lag(_US).over(flow)
    df = df.withColumns(
        {"__prior": prior, "__through": through, "__lead": last_seen.isNull() | (last_seen < F.col(_US))}
    )
    # One row stands for all payments to a counterparty at one instant.
    df = df.withColumns(
        {
            "__held": F.when(F.col("__lead"), F.col("__prior")).otherwise(0.0),
            "__held_next": F.when(F.col("__lead"), F.col("__through")).otherwise(0.0),
        }
    )

    pair = Window.partitionBy(account, other).orderBy(_US)
    df = df.withColumns(
        {
            "h_pair_count": F.count(F.lit(1)).over(pair.rangeBetween(start, -1)),
            "__new_pair": (F.lag(_US).over(pair).isNull() & F.col(other).isNotNull()).cast("long"),
        }
    )

    if tie_break:
        turn = Window.partitionBy(account).orderBy(_US, *tie_break)
        previous = F.lag(_US).over(turn)
        df = df.withColumn("h_previous", previous)
    else:
        df = df.withColumn("h_previous", F.lit(None).cast("long"))
    life = Window.partitionBy(account).orderBy(_US).rangeBetween(start, -1)
    df = df.withColumns(
        {
            "h_first_in_tie": F.lit(True),
            "h_lifetime": F.count(F.lit(1)).over(life),
            "h_degree": F.coalesce(F.sum("__new_pair").over(life), F.lit(0).cast("long")),
        }
    )

    purse = Window.partitionBy(account, currency).orderBy(_US)
    before, before_24h, before_30d = (
        purse.rangeBetween(start, -1),
        purse.rangeBetween(start, -DAY_24H - 1),
        purse.rangeBetween(start, -DAYS_30 - 1),
    )
    moment = Window.partitionBy(account, currency, _US)
    square = units * units
    held, held_next = F.col("__held"), F.col("__held_next")
    df = df.withColumns(
        {
            "h_count_24h": F.count(F.lit(1)).over(before) - F.count(F.lit(1)).over(before_24h),
            "h_sum_24h": _frame_sum(units, total_type, before, before_24h).cast(_TOTAL),
            "h_count_30d": F.count(_X).over(before) - F.count(_X).over(before_30d),
            "h_sum_30d": _frame_sum(units, total_type, before, before_30d).cast(_TOTAL),
            "h_squares_30d": _frame_sum(square, squares_type, before, before_30d).cast(_SQUARES),
            "__s1": F.sum(held_next - held).over(before),
            "__s2": F.sum(held_next * held_next - held * held).over(before),
            "__m1": F.sum(held).over(moment),
            "__m2": F.sum(held * held).over(moment),
        }
    )
    known = F.col(account).isNotNull() & F.col(currency).isNotNull()
    return df.withColumns(
        {
            "h_hhi": _concentration(known, F.col("__m1"), F.col("__m2")),
            "h_hhi_full": _concentration(known, F.col("__s1"), F.col("__s2")),
        }
    ).drop(
        "__prior", "__through", "__lead", "__held", "__held_next", "__new_pair",
        "__s1", "__s2", "__m1", "__m2",
    )


def _frame_sum(value: Column, dtype: str, all_before: Window, too_old: Window) -> Column:
    """Sum over a moving frame as the difference of two growing ones; exact on decimals."""

    def grown(window: Window) -> Column:
        return F.coalesce(F.sum(value).over(window).cast(dtype), F.lit(0).cast(dtype))

    return (grown(all_before) - grown(too_old)).cast(dtype)


def _concentration(known: Column, total: Column, squares: Column) -> Column:
    share = F.try_divide(squares, total * total)
    return F.when(known, F.coalesce(share, F.lit(0.0))).otherwise(0.0)


def _by_instant(df: DataFrame, side: Side, tie_break: Sequence[str], cuts: list[float], full_hhi: bool = False) -> DataFrame:
    """The same history for heavy accounts, over instants instead of rows.

    Instants are cut into pieces of time. What earlier pieces hold of a counterparty, an account or a currency enters a piece as an
    opening row before all others, and what leaves a moving frame as a row of its own, so each (account, piece) is
    one sorted stretch in which every running total is a growing window, and all of them share one shuffle. No step groups by
    the account alone.
    """
    account, currency, other = side.account, side.currency, side.other
    tie = F.struct(*tie_break, _ROW)
    x = F.coalesce(F.col(_X), F.lit(0).cast(_UNITS))
    flows = df.groupBy(account, currency, other, _US).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(_X).alias("n_x"),
        F.sum(x).cast(_TOTAL).alias("x"),
        F.sum(x * x).cast(_SQUARES).alias("xx"),
        F.min(tie).alias(_TIE),
    )
    flows = with_piece(materialize(flows, "history-flows"), _US, cuts, _PIECE)
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)

    pairs = flows.groupBy(account, other, _PIECE).agg(F.sum("n").alias("n"), F.max(_US).alias("last"))
    pairs = pairs.withColumn("before", F.sum("n").over(earlier(account, other)))
    pairs = materialize(pairs, "history-pairs")
    new = F.sum((F.col("before").isNull() & F.col(other).isNotNull()).cast("long")).alias("new")
    lives = pairs.groupBy(account, _PIECE).agg(F.sum("n").alias("n"), new, F.max("last").alias("last"))
    moves = _arrivals_and_departures(
        flows.groupBy(account, currency, _US).agg(
            F.sum("n").alias("n"), F.sum("n_x").alias("n_x"), F.sum("x").cast(_TOTAL).alias("x"), F.sum("xx").cast(_SQUARES).alias("xx")
        )
    )
    moves = with_piece(moves, _US, cuts, _PIECE)
    purses = moves.groupBy(account, currency, _PIECE).agg(*[F.sum(c).cast(t).alias(c) for c, t in _MOVES.items()])

    def opening(totals: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
        """What earlier pieces of the keys hold, as rows before all others of a piece."""
        return totals.select(*keys, _PIECE, F.lit(_OPENING).alias(_US), *[c.alias(n) for n, c in values.items()])

    since = earlier(account)
    openings = [
        opening(pairs.where("before is not null"), [account, other], {"n_pair": F.col("before")}),
        opening(
            lives,
            [account],
            {"n_life": F.sum("n").over(since), "new": F.sum("new").over(since), "last": F.max("last").over(since)},
        ),
        opening(purses, [account, currency], {c: F.sum(c).over(earlier(account, currency)).cast(t) for c, t in _MOVES.items()}),
        moves,
    ]
    if side.concentrated:
        paid = flows.groupBy(account, currency, other, _PIECE).agg(F.sum("x").cast(_TOTAL).alias("x"))
        openings.append(opening(paid, [account, currency, other], {"x_flow": F.sum("x").over(earlier(account, currency, other)).cast(_TOTAL)}))
    stretch = flows.select(
        account, currency, other, _US, _PIECE, _TIE, F.lit(True).alias("row"), F.col("n").alias("n_pair"), F.col("n").alias("n_life"), F.col(_US).alias("last"), F.col("x").alias("x_flow")
    )
    for rows in openings:
        stretch = stretch.unionByName(rows, allowMissingColumns=True)

    stretch = stretch.repartition(F.col(account), F.col(_PIECE))
    grown = lambda *keys: Window.partitionBy(*keys, _PIECE).orderBy(_US).rangeBetween(Window.unboundedPreceding, -1)
    total = lambda c, window, dtype="long": F.coalesce(F.sum(c).over(window), F.lit(0)).cast(dtype)
    here = F.col("row").isNotNull()
    life, purse = grown(account), grown(account, currency)
    once = F.row_number().over(Window.partitionBy(account, other, _PIECE, _US, "row").orderBy(currency)) == 1
    stretch = stretch.withColumn("h_pair_count", total("n_pair", grown(account, other))).withColumn(
        "fresh", F.when(here, (once & (F.col("h_pair_count") == 0) & F.col(other).isNotNull()).cast("long")).otherwise(F.col("new"))
    )
    stretch = stretch.withColumns(
        {
            "h_lifetime": total("n_life", life),
            "h_degree": total("fresh", life),
            "h_previous": F.max("last").over(life),
            _TIE: F.min(_TIE).over(Window.partitionBy(account, _PIECE, _US)),
            "h_count_24h": total("n_24h", purse),
            "h_sum_24h": total("x_24h", purse, _TOTAL),
            "h_count_30d": total("n_30d", purse),
            "h_sum_30d": total("x_30d", purse, _TOTAL),
            "h_squares_30d": total("xx_30d", purse, _SQUARES),
        }
    )
    known = F.col(account).isNotNull() & F.col(currency).isNotNull()
    if side.concentrated:
        held = F.when(here, total("x_flow", grown(account, currency, other), _TOTAL).cast("double"))
        moment = Window.partitionBy(account, currency, _PIECE, _US)
        stretch = stretch.withColumn("held", held).withColumn("h_hhi", _concentration(known, F.sum("held").over(moment), F.sum(F.col("held") * F.col("held")).over(moment)))
    else:
        stretch = stretch.withColumns({"held": F.lit(0.0), "h_hhi": F.lit(0.0)})
    kept = [account, currency, other, _US, _TIE, *[c for c in _OUT if c not in ("h_first_in_tie", "h_hhi_full")]]
    history = stretch.where(here).select(*kept, "held", F.col("x_flow").cast("double").alias("now"))
    if full_hhi:
        history = materialize(history, "history-instants")
        held, now = F.col("held"), F.col("now")
        sums = history.groupBy(account, currency, _US).agg(F.sum(now).alias("s1"), F.sum(2 * held * now + now * now).alias("s2"))
        past = running_before(sums, [account, currency], _US, {"__s1": "s1", "__s2": "s2"}, cuts=cuts)
        whole = past.select(account, currency, _US, _concentration(known, F.col("__s1"), F.col("__s2")).alias("h_hhi_full"))
        history = lookup(history, whole, [account, currency, _US])
    else:
        history = history.withColumn("h_hhi_full", F.lit(0.0))
    rows = lookup(df, history.drop("held", "now"), [account, currency, other, _US])
    first = tie.eqNullSafe(F.col(_TIE)) if tie_break else F.lit(True)
    return rows.withColumn("h_first_in_tie", first).drop(_TIE)


#: What enters and leaves the moving frames.
_MOVES = {"n_24h": "long", "x_24h": _TOTAL, "n_30d": "long", "x_30d": _TOTAL, "xx_30d": _SQUARES}


def _arrivals_and_departures(instants: DataFrame) -> DataFrame:
    """Each instant enters its frames at its time and leaves them when it is too old.

    The moving frame at t is then the running total of everything before t.
    """

    def change(at: int, day: int, month: int) -> Column:
        values = {"n_24h": ("n", day), "x_24h": ("x", day), "n_30d": ("n_x", month), "x_30d": ("x", month), "xx_30d": ("xx", month)}
        return F.struct(
            (F.col(_US) + F.lit(at)).alias("at"),
            *[(F.col(c) * sign).cast(_MOVES[name]).alias(name) for name, (c, sign) in values.items()],
        )

    moves = F.explode(F.array(change(0, 1, 1), change(DAY_24H, -1, 0), change(DAYS_30, 0, -1)))
    keys = [c for c in instants.columns if c not in (_US, "n", "n_x", "x", "xx")]
    return instants.select(*keys, moves.alias("move")).select(*keys, F.col("move.at").alias(_US), *[f"move.{c}" for c in _MOVES])
