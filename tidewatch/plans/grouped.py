"""Ranks, cuts and quantiles of every group at once.

A value table (one row per group and value) is combined on the map side, cut into pieces along the value, and a
histogram by group and piece carries the counts of earlier pieces over. Every group's rank is then found by one equi-join with
its own running counts: the number of passes depends neither on the number of groups nor on their sizes, and
no group has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewatch.plans.ordering import ROWS_PER_PIECE, cut_points, lookup, pieces_for, running_before
from tidewatch.session import materialize


def value_steps(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: dict[str, Column],
    rows: int,
    descending: bool = False,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """``by``, ``value``, the sums at the value, and ``<sum>_before``: the same over all earlier values of the group."""
    values = df.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    cuts = cut_points(df, value, pieces_for(rows, rows_per_piece))
    return running_before(values, by, value, {f"{n}_before": n for n in sums}, cuts=cuts, descending=descending)


def at_rank(steps: DataFrame, wanted: DataFrame, by: Sequence[str], rank: str = "rank", count: str = "n") -> DataFrame:
    """For each row of ``wanted`` (``by``, ``rank`` and more), the step of its group that holds the rank."""
    before, here = F.col(f"{count}_before"), F.col(count)
    return lookup(wanted, steps, by, "inner").where((before < F.col(rank)) & (F.col(rank) <= before + here))


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], shares: dict[str, Sequence[float]], rows_per_piece: int | None = None
) -> DataFrame:
    """Exact quantiles of each column in each group, with linear interpolation: ``by`` and an array per column.

    Nulls and NaN are left out; a group without a value of a column has a null array for it. A null group is a group.
    """
    rows = df.count()
    out = df.select(*by).distinct()
    for column, wanted in shares.items():
        value = F.col(column).cast("double")
        held = df.select(*by, value.alias("value")).where(value.isNotNull() & ~F.isnan(value))
        steps = materialize(value_steps(held, by, "value", {"n": F.lit(1)}, rows, rows_per_piece=rows_per_piece), "quantile-steps")
        position = (F.col("total") - 1) * F.col("share")
        asked = (
            steps.groupBy(*by)
            .agg(F.sum("n").alias("total"))
            .select(*by, "total", F.posexplode(F.array(*[F.lit(float(q)) for q in wanted])).alias("place", "share"))
            .select(*by, "place", position.alias("position"))
            .select(*by, "place", "position", F.explode(F.array(F.floor("position"), F.ceil("position"))).alias("rank"))
            .withColumn("rank", F.col("rank") + 1)
        )
        found = at_rank(steps, asked.distinct(), by)
        low, high, part = F.min("value"), F.max("value"), F.max("position") - F.floor(F.max("position"))
        each = found.groupBy(*by, "place").agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias("quantile"))
        arrays = each.groupBy(*by).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "quantile"))), lambda q: q["quantile"]).alias(column)
        )
        out = lookup(out, arrays, by)
    return out


def first_rows(
    df: DataFrame,
    by: Sequence[str],
    wanted: DataFrame,
    order: Sequence[tuple[str, bool]],
    tally: Column,
    rows: int,
    rows_per_piece: int | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """For each row of ``wanted`` (``by``, ``rank``, and columns that tell its rows apart), a tally over the first ``rank`` rows.

    Adds ``first``, the value of the first order column at the rank, ``inside``, the number of rows counted, and ``tally``, the sum
    of ``tally`` over them. Rows are taken in the given (column, descending) order, null and NaN last. At the rank's value of one
    column, only the rows that share it go on to the next column; once no group has more of
    them than a task should hold they are ranked at once. ``steps`` are those of the first column, if the caller has them.
    """
    names = [c for c in wanted.columns if c not in by and c != "rank"]
    column, descending = order[0]
    clean = F.col(column)
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        clean = F.when(~F.isnan(column), clean)
    df = df.withColumns({column: clean, "__tally": tally.cast("long")})
    # Missing values come last: descending they do so by themselves, ascending they are a step of their own.
    if steps is not None:
        pass
    elif not descending:
        df = df.withColumn("__missing", F.col(column).isNull().cast("int"))
        present = df.where("__missing = 0")
        steps = value_steps(present, by, column, {"tally": F.col("__tally"), "n": F.lit(1)}, rows, rows_per_piece=rows_per_piece)
        last = df.where("__missing = 1").groupBy(*by).agg(F.sum("__tally").alias("tally"), F.sum(F.lit(1)).alias("n"))
        before = steps.groupBy(*by).agg(F.sum("tally").alias("tally_before"), F.sum("n").alias("n_before"))
        ended = lookup(last, before, by).select(
            *by, F.lit(None).cast(df.schema[column].dataType).alias(column), "tally", "n", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tally_before", "n_before")]
        )
        steps = steps.unionByName(ended)
    else:
        steps = value_steps(df, by, column, {"tally": F.col("__tally"), "n": F.lit(1)}, rows, True, rows_per_piece)
    cut = materialize(at_rank(steps, wanted, by).withColumnRenamed(column, "first"), "grouped-cuts")
    cut = cut.withColumn("left", F.col("rank") - F.col("n_before"))
    whole = F.col("left") == F.col("n")
    if len(order) == 1:
        whole = F.lit(True)
    done = cut.where(whole).select(*by, *names, "rank", "first", (F.col("n_before") + F.col("n")).alias("inside"), (F.col("tally_before") + F.col("tally")).alias("tally"))
    tied = cut.where(~whole)
    largest = tied.orderBy(F.desc("n")).select("n").first()
    if largest is None:
        return done
    largest = largest[0]
    keys = [*by, *names]
    reached = tied.select(*by, *names, F.col("first"), F.col("left").alias("__left"))
    equal = reached.withColumnRenamed("first", column)
    there = lookup(df, equal, [*by, column], "inner")
    rest = order[1:]
    if largest <= (rows_per_piece or ROWS_PER_PIECE):
        window = Window.partitionBy(*keys).orderBy(*[_placed(df, c, d) for c, d in rest])
        found = there.withColumn("__place", F.row_number().over(window)).where("__place <= __left").groupBy(*keys).agg(F.count(F.lit(1)).alias("__inside"), F.sum("__tally").alias("__more"))
    else:
        aims = tied.select(*keys, F.col("left").alias("rank"))
        deeper = first_rows(materialize(there.drop("__left", "__missing"), "grouped-ties"), keys, aims, rest, F.col("__tally"), rows, rows_per_piece)
        found = deeper.select(*keys, F.col("inside").alias("__inside"), F.col("tally").alias("__more"))
    counted = lookup(tied, found, keys).select(
        *by, *names, "rank", "first", (F.col("n_before") + F.col("__inside")).alias("inside"), (F.col("tally_before") + F.col("__more")).alias("tally")
    )
    return done.unionByName(counted)


def _placed(df: DataFrame, column: str, descending: bool) -> Column:
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        value = F.when(~F.isnan(column), value)
    return value.desc_nulls_last() if descending else value.asc_nulls_last()
