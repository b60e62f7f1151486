"""Ordered work over whole tables without a single-task window.

A running total, a rank or an exact quantile needs a global order, and
``Window.orderBy`` without a partition would put every row in one task. These
helpers cut the order into pieces at approximate quantiles, do the ordered
work inside each piece, and add what the earlier pieces sum to. The cut points
only balance the work: the results are exact for any cut points.

The tables they run on are value tables (one row per distinct key and order
value), so a value shared by a third of the rows is combined on the map side
before anything is shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewatch.session import materialize, stored

ROWS_PER_PIECE = 2_000_000
#: Pieces of one pass of cuts; more are found by cutting each of these again.
PIECES_PER_PASS = 1024
#: Texts sampled for each piece.
TEXTS_PER_PIECE = 32
#: Ranks of a column that are looked for in brackets of their own.
FEW_RANKS = 16
_PIECE = "__piece"
_PLACE = "__place"
ROW = "__row"


def pieces_for(rows: int, rows_per_piece: int | None = None) -> int:
    return max(1, math.ceil(rows / (rows_per_piece or ROWS_PER_PIECE)))


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join on ``keys`` where a null key matches a null key; keeps the left keys once."""
    renamed = right.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        *[F.col(c).alias(c) for c in right.columns if c not in keys],
    )
    matched = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    )
    return left.join(renamed, matched, how).drop(*[f"__key_{k}" for k in keys])


def place(df: DataFrame, column: str) -> Column:
    """A double that never decreases along the column's own order.

    Numbers and times map to themselves. It is only used to choose a piece, so
    values sharing a place are fine. Text has no place; it is cut at texts.
    """
    dtype = df.schema[column].dataType
    value = F.col(column)
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("double")
    return value.cast("double")


def cut_points(df: DataFrame, column: str, pieces: int) -> list[float]:
    """At most ``pieces - 1`` balancing cut points, from one mergeable sketch pass."""
    return cut_tables(df, [column], pieces)[column]


def cut_tables(df: DataFrame, columns: Sequence[str], pieces: int) -> dict[str, list]:
    """Cut points of several columns, one pass for each thousandfold of pieces."""
    if pieces <= 1:
        return {c: [] for c in columns}
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    cuts: dict[str, list] = {c: _text_cuts(df, c, pieces) for c in texts}
    numbers = [c for c in columns if c not in texts]
    first = min(pieces, PIECES_PER_PASS)
    found = df.agg(*[_sketch(df, c, first).alias(f"__{i}") for i, c in enumerate(numbers)]).first() if numbers else None
    for i, c in enumerate(numbers):
        cuts[c] = _clean(found[f"__{i}"])
        if pieces > first:
            # Each piece is cut again by the same sketch; a piece is a group, and sketches merge before the shuffle.
            inner = with_piece(df.select(c), c, cuts[c]).groupBy(_PIECE).agg(_sketch(df, c, math.ceil(pieces / first)).alias("inner"))
            cuts[c] = _clean([*cuts[c], *(v for r in inner.collect() for v in r["inner"] or [])])
    return cuts


def _sketch(df: DataFrame, column: str, pieces: int) -> Column:
    shares = [i / pieces for i in range(1, pieces)] or [0.5]
    return F.percentile_approx(place(df, column), shares, max(1_000, 10 * pieces))


def _clean(values: Sequence[float] | None) -> list[float]:
    """Finite cuts in order; infinite values lie in the first and the last piece without a cut of their own."""
    return sorted({v for v in values or [] if v is not None and math.isfinite(v)})


def _text_cuts(df: DataFrame, column: str, pieces: int) -> list[str]:
    """Whole texts that cut the order, from a sample of distinct texts whose size follows the number of pieces."""
    texts = df.select(column).where(F.col(column).isNotNull())
    n = texts.agg(F.approx_count_distinct(column)).first()[0]
    kept = TEXTS_PER_PIECE * pieces / max(n, 1)
    drawn = texts.where(F.shiftrightunsigned(F.xxhash64(column), 11) < kept * float(1 << 53))
    sample = sorted((r[0] for r in drawn.distinct().collect()), key=lambda t: t.encode("utf-8"))
    return sorted({sample[i * len(sample) // pieces] for i in range(1, pieces)}, key=lambda t: t.encode("utf-8")) if sample else []


def text_piece(value: Column, cuts: Sequence[str]) -> Column:
    """Number of cuts at or below a text, by bisection; 0 for null."""
    held = F.array(*map(F.lit, cuts))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: at + F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) <= value), step).otherwise(0),
    )
    return F.coalesce(found, F.lit(0))


def with_piece(df: DataFrame, column: str, cuts: list[float], name: str = _PIECE) -> DataFrame:
    """Number the piece of each row by binary search in the cut points."""
    return with_pieces(df, {column: cuts}, {column: name})


def with_pieces(df: DataFrame, cuts: dict[str, list[float]], names: dict[str, str]) -> DataFrame:
    texts = {c: points for c, points in cuts.items() if points and isinstance(df.schema[c].dataType, T.StringType)}
    if texts:
        df = df.withColumns({names[c]: text_piece(F.col(c), points) for c, points in texts.items()})
        cuts = {c: points for c, points in cuts.items() if c not in texts}
    placed = {f"{_PLACE}_{i}": place(df, c) for i, c in enumerate(cuts) if cuts[c]}
    whole = {names[c]: F.lit(0) for c in cuts if not cuts[c]}
    df = df.withColumns(whole) if whole else df
    if not placed:
        return df
    cut = {names[c]: [-math.inf, *points, math.inf] for c, points in cuts.items() if points}
    bucket = Bucketizer(
        splitsArray=list(cut.values()),
        inputCols=list(placed),
        outputCols=list(cut),
        handleInvalid="keep",
    )
    numbered = bucket.transform(df.withColumns(placed))
    return numbered.withColumns({n: F.col(n).cast("int") for n in cut}).drop(*placed)


def running_before(
    table: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    latest: dict[str, str] | None = None,
    cuts: list[float] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Append exclusive running totals to a table with one row per (keys, order).

    ``sums`` maps output to summed column, ``latest`` maps output to a column
    whose running extreme is wanted (maximum, or minimum if descending). Rows
    are ordered by ``order`` within ``keys``; a row never sees itself. Sums
    start at 0, extremes at null.

    With cut points the ordered work is done per (keys, piece), and a table of
    piece totals - at most one row per key and piece - carries earlier pieces
    over, so no key has to fit in one task.
    """
    latest = latest or {}
    extreme = F.min if descending else F.max

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    def exclusive(partition: Sequence[str], by: str) -> Window:
        window = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
        return window.orderBy(direction(by)).rowsBetween(Window.unboundedPreceding, -1)

    if not cuts:
        inside = exclusive(keys, order)
        return table.withColumns(
            {o: F.coalesce(F.sum(c).over(inside), _zero(table, c)) for o, c in sums.items()}
            | {o: extreme(c).over(inside) for o, c in latest.items()}
        )

    table = with_piece(table, order, cuts)
    group = [*keys, _PIECE]
    totals = table.groupBy(*group).agg(
        *[F.sum(c).alias(o) for o, c in sums.items()],
        *[extreme(c).alias(o) for o, c in latest.items()],
    )
    earlier = exclusive(keys, _PIECE)
    carried = totals.select(
        *group,
        *[F.sum(o).over(earlier).alias(f"__carry_{o}") for o in sums],
        *[extreme(o).over(earlier).alias(f"__carry_{o}") for o in latest],
    )
    inside = exclusive(group, order)
    local = table.withColumns(
        {f"__in_{o}": F.sum(c).over(inside) for o, c in sums.items()}
        | {f"__in_{o}": extreme(c).over(inside) for o, c in latest.items()}
    )
    pick = F.least if descending else F.greatest
    joined = lookup(local, carried, group)
    return joined.select(
        *[c for c in table.columns if c != _PIECE],
        *[
            (_addend(joined, f"__in_{o}") + _addend(joined, f"__carry_{o}")).alias(o)
            for o in sums
        ],
        *[pick(F.col(f"__in_{o}"), F.col(f"__carry_{o}")).alias(o) for o in latest],
    )


def next_along(
    table: DataFrame, order: str, columns: dict[str, str], cuts: list[float] | None = None, descending: bool = False
) -> DataFrame:
    """Append what the next row along ``order`` has in some columns, null at the end; ``order`` is distinct in ``table``.

    With cut points the rows of a piece are looked at in a task of their own, and a table of each piece's first row
    serves the last row of the piece before.
    """

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    held = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
    if not cuts:
        window = Window.partitionBy(F.lit(0)).orderBy(direction(order))
        found = table.withColumn("__next", F.lead(held).over(window))
    else:
        pieced = with_piece(table, order, cuts)
        pick = F.max_by if descending else F.min_by
        firsts = pieced.groupBy(_PIECE).agg(pick(held, F.col(order)).alias("__first"))
        across = Window.partitionBy(F.lit(0)).orderBy(direction(_PIECE))
        after = firsts.select(_PIECE, F.lead("__first").over(across).alias("__after"))
        inside = Window.partitionBy(_PIECE).orderBy(direction(order))
        found = lookup(pieced.withColumn("__in", F.lead(held).over(inside)), after, [_PIECE])
        found = found.withColumn("__next", F.coalesce("__in", "__after")).drop(_PIECE, "__in", "__after")
    return found.select(*table.columns, *[F.col(f"__next.{o}").alias(o) for o in columns])


def _addend(df: DataFrame, column: str) -> Column:
    """Null as 0, and decimals one digit below the maximum so that adding keeps the scale."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.DecimalType):
        dtype = T.DecimalType(min(dtype.precision, 37), dtype.scale)
    return F.coalesce(F.col(column).cast(dtype), F.lit(0).cast(dtype))


def _zero(table: DataFrame, column: str) -> Column:
    return F.lit(0).cast(table.schema[column].dataType)


def order_statistics(
    df: DataFrame,
    ranks: dict[str, Iterable[int]],
    rows: int,
    distinct: bool = False,
    descending: bool = False,
    rows_per_piece: int | None = None,
) -> dict[str, dict[int, tuple[object, int, int]]]:
    """Exact values at 1-based ranks of each named column.

    Returns ``{column: {rank: (value, rows before the value, rows of the value)}}``;
    with ``distinct`` every value counts once. Nulls and NaN are left out, and
    all named columns must share one type. ``rows`` sizes the pieces.

    One piece is a single counting job. Otherwise cut points come from a
    sketch, exact piece counts say which pieces hold the ranks, and only the
    values of those pieces are counted one by one. For a few ranks a column the pieces are
    narrow brackets around them, so that rows outside are counted without being taken apart, and a bracket of a single value
    needs nothing more than its count. The driver sees piece counts
    and the requested values, never the data.
    """
    columns = [c for c in ranks if list(ranks[c])]
    wanted = {c: sorted(set(ranks[c])) for c in columns}
    if not columns:
        return {c: {} for c in ranks}

    pieces = pieces_for(rows, rows_per_piece)
    piece_names = {c: f"__piece_{i}" for i, c in enumerate(columns)}
    few = not distinct and not descending and max(len(ks) for ks in wanted.values()) <= FEW_RANKS
    near = _brackets(df, wanted, pieces) if pieces > 1 and few else None
    result: dict[str, dict[int, tuple[object, int, int]]] = {c: {} for c in ranks}
    if near is None:
        pieced = with_pieces(df.select(*columns), cut_tables(df, columns, pieces), piece_names)
    else:
        for c in columns:
            result[c] = _of_one_value(df, c, wanted[c], near[c])
            wanted[c] = [k for k in wanted[c] if k not in result[c]]
            near[c] = [b for b in near[c] if any(b.holds(k) for k in wanted[c])]
        columns = [c for c in columns if wanted[c]]
        if not columns:
            return result
        # Few rows lie in any bracket; only these are taken apart.
        pieced = df.select(*columns).withColumns({piece_names[c]: _bracket_of(df, c, [(b.low, b.high) for b in near[c]]) for c in columns})
        pieced = pieced.where(F.coalesce(*[F.col(piece_names[c]) for c in columns]).isNotNull())

    def cells(wanted_pieces: dict[int, list[int]] | None) -> DataFrame:
        """(which, piece, value) of every column, or only of the wanted pieces."""
        found = []
        for i, column in enumerate(columns):
            piece, value = F.col(piece_names[column]), F.col(column)
            kept = value.isNotNull()
            if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
                kept = kept & ~F.isnan(value)
            if wanted_pieces is not None:
                kept = kept & piece.isin(wanted_pieces.get(i, []))
            cell = F.struct(F.lit(i).alias("which"), piece.alias("piece"), value.alias("value"))
            found.append(F.when(kept, cell))
        return pieced.select(F.explode(F.array(*found)).alias("cell")).where(F.col("cell").isNotNull()).select("cell.*")

    offsets: dict[tuple[int, int], int] = {}
    longed = cells(None) if near is None else cells({i: list(range(len(near[c]))) for i, c in enumerate(columns)})
    if near is not None:
        offsets = {(i, p): before for i, c in enumerate(columns) for p, (_, _, before) in enumerate(near[c])}
    elif pieces > 1:
        counted = F.count_distinct("value") if distinct else F.count(F.lit(1))
        found = longed.groupBy("which", "piece").agg(counted.alias("n")).collect()
        keep: dict[int, list[int]] = {}
        for i, column in enumerate(columns):
            start = 0
            mine = sorted((r for r in found if r["which"] == i), key=lambda r: r["piece"])
            for r in reversed(mine) if descending else mine:
                if any(start < k <= start + r["n"] for k in wanted[column]):
                    keep.setdefault(i, []).append(r["piece"])
                    offsets[(i, r["piece"])] = start
                start += r["n"]
        longed = cells(keep)

    counts = longed.groupBy("which", "piece", "value").agg(
        (F.lit(1) if distinct else F.count(F.lit(1))).cast("long").alias("n")
    )
    ranked = running_before(counts, ["which", "piece"], "value", {"before": "n"}, descending=descending)
    if offsets:
        starts = df.sparkSession.createDataFrame(
            [(i, p, start) for (i, p), start in offsets.items()], "which int, piece int, start long"
        )
        # At most one row for each requested rank.
        ranked = ranked.join(F.broadcast(starts), ["which", "piece"]).withColumn(
            "before", F.col("before") + F.col("start")
        )
    ranked = ranked.withColumn("through", F.col("before") + F.col("n"))
    hits = F.lit(False)
    for i, column in enumerate(columns):
        ranked, holds = _holds_rank(ranked, wanted[column], i)
        hits = hits | ((F.col("which") == i) & holds)
    for r in ranked.where(hits).select("which", "value", "before", "n").collect():
        column = columns[r["which"]]
        inside = wanted[column]
        for k in inside[bisect_right(inside, r["before"]) : bisect_right(inside, r["before"] + r["n"])]:
            result[column][k] = (r["value"], r["before"], r["n"])
    return result


@dataclass(frozen=True)
class Bracket:
    """Values from ``low`` to ``high``, both included, with the rows below it and the rows up to its end."""

    low: float
    high: float
    before: int
    through: int

    def __iter__(self) -> Iterator[float]:
        return iter((self.low, self.high, self.before))

    def holds(self, rank: int) -> bool:
        return self.before < rank <= self.through


def _brackets(df: DataFrame, wanted: dict[str, list[int]], pieces: int) -> dict[str, list[Bracket]] | None:
    """Per column narrow brackets around its ranks, from a sketch and one exact count.

    None if a column is text, or if the count shows a rank outside its bracket.
    """
    if any(isinstance(df.schema[c].dataType, T.StringType) for c in wanted):
        return None
    placed = {c: F.when(~F.isnan(place(df, c)), place(df, c)) for c in wanted}
    there = df.agg(*[F.count(v).alias(f"__{i}") for i, v in enumerate(placed.values())]).first()
    accuracy = max(1_000, 10 * pieces)
    shares = {}
    for (c, ks), n in zip(wanted.items(), there, strict=True):
        # Three times the error a sketch may have on either side; brackets that meet are one.
        ends = [(max(0.0, k / max(n, 1) - 3 / accuracy), min(1.0, k / max(n, 1) + 3 / accuracy)) for k in ks]
        merged = [ends[0]]
        for low, high in ends[1:]:
            merged[-1:] = [(merged[-1][0], high)] if low <= merged[-1][1] else [merged[-1], (low, high)]
        shares[c] = merged
    sketches = [F.percentile_approx(v, [s for e in shares[c] for s in e], accuracy).alias(f"__{i}") for i, (c, v) in enumerate(placed.items())]
    found = df.agg(*sketches).first()
    bounds: dict[str, list[tuple[float, float]]] = {}
    for i, c in enumerate(wanted):
        ends = found[f"__{i}"]
        if not ends:
            return None
        joined: list[tuple[float, float]] = []
        for low, high in zip(ends[::2], ends[1::2], strict=True):
            # The sketch's ends of the order are the column's, values shared by two brackets belong to one.
            joined[-1:] = [(joined[-1][0], high)] if joined and low <= joined[-1][1] else [*joined[-1:], (low, high)]
        bounds[c] = joined
    counts = []
    for i, (c, v) in enumerate(placed.items()):
        for p, (low, high) in enumerate(bounds[c]):
            counts += [F.count(F.when(v < F.lit(low), 1)).alias(f"b{i}_{p}"), F.count(F.when(v <= F.lit(high), 1)).alias(f"t{i}_{p}")]
    r = df.agg(*counts).first()
    for i, (c, ks) in enumerate(wanted.items()):
        spans = [(r[f"b{i}_{p}"], r[f"t{i}_{p}"]) for p in range(len(bounds[c]))]
        if not all(any(before < k <= through for before, through in spans) for k in ks):
            return None
    return {c: [Bracket(low, high, r[f"b{i}_{p}"], r[f"t{i}_{p}"]) for p, (low, high) in enumerate(bounds[c])] for i, c in enumerate(wanted)}


def _of_one_value(
    df: DataFrame, column: str, ranks: Sequence[int], brackets: Sequence[Bracket]
) -> dict[int, tuple[object, int, int]]:
    """Ranks in brackets that hold a single value: the exact count has already told it and its rows."""
    if not isinstance(df.schema[column].dataType, T.DoubleType):
        return {}
    # Adding 0 turns -0.0, which is the same value, into 0.0.
    return {k: (b.low + 0.0, b.before, b.through - b.before) for k in ranks for b in brackets if b.low == b.high and b.holds(k)}


def _bracket_of(df: DataFrame, column: str, bounds: Sequence[tuple[float, float]]) -> Column:
    """Number of the bracket a value lies in, null outside."""
    value, found = place(df, column), F.lit(None).cast("int")
    for p, (low, high) in enumerate(bounds):
        found = F.when((value >= F.lit(low)) & (value <= F.lit(high)), F.lit(p)).otherwise(found)
    return found


def _holds_rank(ranked: DataFrame, ranks: Sequence[int], i: int) -> tuple[DataFrame, Column]:
    """Whether (before, through] holds one of the sorted ranks."""
    if len(ranks) <= 16:
        table = F.array(*[F.lit(k).cast("long") for k in ranks])
        return ranked, F.exists(table, lambda k: (k > F.col("before")) & (k <= F.col("through")))
    bounds = [float(k) for k in ranks]
    ranked = with_piece(ranked, "before", bounds, f"__low_{i}")
    ranked = with_piece(ranked, "through", bounds, f"__high_{i}")
    return ranked, F.col(f"__high_{i}") > F.col(f"__low_{i}")


def quantiles(
    df: DataFrame,
    shares: dict[str, Sequence[float]],
    rows_per_piece: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between neighbours; nulls and NaN left out."""
    columns = list(shares)
    # Several passes look for the ranks.
    doubled = stored(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "quantile-values")
    present = doubled.agg(
        *[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]
    ).first()
    positions = {c: [(present[c] - 1) * q for q in shares[c]] for c in columns if present[c]}
    ranks = {
        c: {math.floor(p) + 1 for p in ps} | {math.ceil(p) + 1 for p in ps}
        for c, ps in positions.items()
    }
    found = order_statistics(doubled, ranks, max(present), rows_per_piece=rows_per_piece)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if c not in positions:
            out[c] = [None] * len(shares[c])
            continue
        values = []
        for p in positions[c]:
            low, high = found[c][math.floor(p) + 1][0], found[c][math.ceil(p) + 1][0]
            values.append(low if low == high else low + (high - low) * (p - math.floor(p)))
        out[c] = values
    return out


class Cut:
    """The first ``size`` rows of a total order, as a row predicate.

    ``values`` holds one bound per order column that was needed. A row is in if
    it comes before the bounds, or equals all of them.
    """

    def __init__(self, order: Sequence[tuple[str, bool]], values: Sequence[object], size: int):
        self.order, self.values, self.size = list(order)[: len(values)], list(values), size

    def inside(self) -> Column:
        predicate = F.lit(True)
        for (name, descending), value in reversed(list(zip(self.order, self.values, strict=True))):
            here, held = F.col(name), _held(name)
            if value is None:
                predicate = held | predicate
                continue
            bound = F.lit(value)
            nearer = here > bound if descending else here < bound
            predicate = held & (nearer | ((here == bound) & predicate))
        return F.coalesce(predicate, F.lit(False))


def _held(column: str) -> Column:
    """Whether a value takes part in the order; null and NaN come after all that do."""
    value = F.col(column)
    return value.isNotNull() & F.coalesce(~(value.cast("string") == "NaN"), F.lit(False))


def leading_rows(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sizes: Sequence[int],
    rows: int,
    rows_per_piece: int | None = None,
) -> list[Cut]:
    """Cuts holding the first k rows for each k, by (column, descending) order, null and NaN last.

    Works down the order columns: find the value at the rank, and only if that
    value is shared by more rows than are still wanted look at the next column
    among the sharing rows. No row is moved; the caller filters with the cut. If
    rows tie on every column the whole last group is inside, and the cut's size says so.
    """
    first, descending = order[0]
    reach = {k: min(k, rows) for k in sizes}
    there = df.agg(F.count(F.when(_held(first), 1))).first()[0]
    inner = [k for k in reach.values() if k <= there]
    found = order_statistics(df, {first: inner}, rows, descending=descending, rows_per_piece=rows_per_piece)[first]
    cuts = []
    for k in sizes:
        value, before, count = found[reach[k]] if reach[k] <= there else (None, there, rows - there)
        left = reach[k] - before
        if left == count or len(order) == 1:
            cuts.append(Cut(order, [value], before + count))
            continue
        tied = df.where(~_held(first) if value is None else _held(first) & (F.col(first) == F.lit(value)))
        few = count <= (rows_per_piece or ROWS_PER_PIECE)
        deeper = _tied_cut(tied, order[1:], left) if few else leading_rows(tied, order[1:], [left], count, rows_per_piece)[0]
        cuts.append(Cut(order, [value, *deeper.values], before + deeper.size))
    return cuts


def _tied_cut(tied: DataFrame, order: Sequence[tuple[str, bool]], size: int) -> Cut:
    """The cut of a table that a task can hold, over all its columns at once."""
    names = [c for c, _ in order]
    values = tied.select(*[F.when(_held(c), F.col(c)).alias(c) for c in names]).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(F.lit(0)).orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order])
    upto = F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    r = values.withColumn("__upto", upto).where((F.col("__upto") >= size) & (F.col("__upto") - F.col("__n") < size)).first()
    return Cut(order, [r[c] for c in names], r["__upto"])


def exact_rows(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sizes: Sequence[int] | Callable[[int], Sequence[int]],
    rows: int | None = None,
    rows_per_piece: int | None = None,
) -> tuple[DataFrame, list[Cut]]:
    """The table and cuts that hold exactly the first k of its rows for each k.

    ``sizes`` may be a function of the number of rows, which is counted if it isn't given.
    Where a cut would fall among rows that tie on every column, the table is stored with row
    numbers and these break the tie; it then has the further column ``__row``.
    """
    # Finding cuts takes some passes, so what the order needs is stored once.
    narrow = stored(df.select(*dict.fromkeys(c for c, _ in order)), "ordered-rows")
    rows = narrow.count() if rows is None else rows
    sizes = sizes(rows) if callable(sizes) else sizes
    cuts = leading_rows(narrow, order, sizes, rows, rows_per_piece)
    if all(cut.size == min(k, rows) for cut, k in zip(cuts, sizes, strict=True)):
        return df, cuts
    numbered = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered-rows")
    return numbered, leading_rows(numbered, [*order, (ROW, False)], sizes, rows, rows_per_piece)
