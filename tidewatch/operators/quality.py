"""Checks of a feature table, and the row contract of the scorer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch import schema as S
from tidewatch.functions.columns import is_missing
from tidewatch.plans.ordering import cut_points, pieces_for, quantiles, running_before

ISSUE, WARNING = "issue", "warning"
NULL_LIMIT = 0.05
OUTLIER_SPAN = 10.0
OUTLIER_LIMIT = 0.05
PREVALENCE_RANGE = (0.0001, 0.9999)
_SCHEMA = "check string, column string, severity string, value double"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def ranged_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose range is checked: not the target, not the account histories."""
    return [
        c for c in numeric_columns(df) if c != S.TARGET and not c.startswith(("sender_", "receiver_"))
    ]


def _tall(wide: DataFrame, names: Sequence[str], label: str = "column") -> DataFrame:
    """One row per named column of a one-row aggregate, value as a double."""
    cells = [F.struct(F.lit(n).alias(label), F.col(f"`{n}`").cast("double").alias("value")) for n in names]
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def missing_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(check, column) for absent features, target and timestamp; a look at the schema only."""
    absent = [("missing_feature", c) for c in S.MODEL_FEATURES if c not in df.columns]
    absent += [("target_not_found", S.TARGET)] if S.TARGET not in df.columns else []
    absent += [("timestamp_not_found", S.TIMESTAMP)] if S.TIMESTAMP not in df.columns else []
    return absent


def null_fractions(df: DataFrame) -> DataFrame:
    """Share of null or NaN values of every column, in one pass."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.avg(is_missing(c, types[c]).cast("double")).alias(c) for c in df.columns])
    return _tall(wide, df.columns)


def infinite_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = ranged_columns(df) if columns is None else list(columns)
    infinite = {c: F.abs(F.col(c).cast("double")) == F.lit(float("inf")) for c in columns}
    wide = df.agg(*[F.count(F.when(test, 1)).alias(c) for c, test in infinite.items()])
    return _tall(wide, columns)


def outlier_fractions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of rows far outside the quartiles; columns without spread are left out."""
    columns = ranged_columns(df) if columns is None else list(columns)
    quartiles = quantiles(df, {c: [0.25, 0.75] for c in columns})
    bounds = {}
    for c, (low, high) in quartiles.items():
        if low is not None and high > low:
            reach = OUTLIER_SPAN * (high - low)
            bounds[c] = (low - reach, high + reach)
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, value double")
    outside = {
        c: F.coalesce(
            ~F.isnan(F.col(c).cast("double")) & ((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))), F.lit(False)
        )
        for c, (lo, hi) in bounds.items()
    }
    wide = df.agg(*[F.avg(test.cast("double")).alias(c) for c, test in outside.items()])
    return _tall(wide, list(bounds))


def out_of_order(df: DataFrame, sequence: str, rows_per_piece: int | None = None) -> DataFrame:
    """Number of sequence values that hold a timestamp earlier than one before them.

    A DataFrame has no row order, so the order to check is an explicit column.
    """
    steps = df.groupBy(sequence).agg(F.min(S.TIMESTAMP).alias("earliest"), F.max(S.TIMESTAMP).alias("latest"))
    cuts = cut_points(df, sequence, pieces_for(df.count(), rows_per_piece))
    seen = running_before(steps, [], sequence, {}, latest={"so_far": "latest"}, cuts=cuts)
    late = (F.col("earliest") < F.col("so_far")) | (F.col("earliest") < F.col("latest"))
    return seen.agg(F.count(F.when(late, 1)).alias("out_of_order"))


def target_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min(S.TARGET).alias("low"),
        F.max(S.TARGET).alias("high"),
        F.avg(F.col(S.TARGET).cast("double")).alias("prevalence"),
    )


def find_issues(
    df: DataFrame, null_limit: float = NULL_LIMIT, sequence: str | None = None
) -> DataFrame:
    """Every issue and warning as a row of (check, column, severity, value)."""
    absent = [(check, column, ISSUE, None) for check, column in missing_columns(df)]
    parts = [df.sparkSession.createDataFrame(absent, _SCHEMA)]

    def report(found: DataFrame, check: str, severity: str, when: Column) -> None:
        parts.append(
            found.where(when).select(
                F.lit(check).alias("check"), "column", F.lit(severity).alias("severity"), "value"
            )
        )

    report(null_fractions(df), "null_fraction", ISSUE, F.col("value") > null_limit)
    if sequence and S.TIMESTAMP in df.columns:
        late = _tall(out_of_order(df, sequence), ["out_of_order"])
        report(late.withColumn("column", F.lit(S.TIMESTAMP)), "not_chronological", ISSUE, F.col("value") > 0)
    if S.TARGET in df.columns:
        target = target_summary(df)
        few = target.select(
            F.lit(S.TARGET).alias("column"),
            F.col("prevalence").alias("value"),
            (F.col("low").isNull() | (F.col("low") == F.col("high"))).alias("single"),
        )
        report(few, "fewer_than_two_classes", ISSUE, F.col("single"))
        low, high = PREVALENCE_RANGE
        report(few, "extreme_prevalence", WARNING, (F.col("value") < low) | (F.col("value") > high))
    ranged = ranged_columns(df)
    if ranged:
        report(infinite_counts(df, ranged), "infinite_values", ISSUE, F.col("value") > 0)
        report(outlier_fractions(df, ranged), "extreme_outliers", WARNING, F.col("value") > OUTLIER_LIMIT)
    return reduce(DataFrame.unionByName, parts)


def is_clean(df: DataFrame, null_limit: float = NULL_LIMIT, sequence: str | None = None) -> bool:
    """True if nothing but warnings was found."""
    return find_issues(df, null_limit, sequence).where(F.col("severity") == ISSUE).isEmpty()


def require_features(df: DataFrame) -> bool:
    """Fail if columns are absent, else accept.

    Absent columns always come first among the issues and only they are fatal, so
    a look at the schema decides; ``find_issues`` reports the rest.
    """
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"critical validation failure: {absent}")
    return True


# The bounds of the scorer's input record, as (lower, upper).
ROW_BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "Amount": (0, None),
    "hour_sin": (-1, 1),
    "hour_cos": (-1, 1),
    "dow_sin": (-1, 1),
    "dow_cos": (-1, 1),
    "month_sin": (-1, 1),
    "month_cos": (-1, 1),
    "is_weekend": (0, 1),
    "is_night": (0, 1),
    "currency_mismatch": (0, 1),
    "cross_border": (0, 1),
    "is_round_amount": (0, 1),
    "sender_txn_count_24h": (0, None),
    "sender_amount_sum_24h": (0, None),
    "receiver_txn_count_24h": (0, None),
    "receiver_amount_sum_24h": (0, None),
    "sender_txn_count_lifetime": (0, None),
    "receiver_txn_count_lifetime": (0, None),
    "sender_out_degree": (0, None),
    "receiver_in_degree": (0, None),
    "pair_transaction_count": (0, None),
    "sender_counterparty_hhi": (0, 1),
}
WHOLE_NUMBERS = [
    *S.FLAG_FEATURES,
    "sender_txn_count_24h",
    "receiver_txn_count_24h",
    "seconds_since_sender_txn",
    "sender_txn_count_lifetime",
    "receiver_txn_count_lifetime",
    "sender_out_degree",
    "receiver_in_degree",
    "pair_transaction_count",
]
NULLABLE = ["sender_amount_mean_30d", "sender_amount_std_30d"]


def check_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Append ``violations``: the columns of the row that break the input contract.

    Missing or unknown columns break it for every row and fail at once;
    ``keep`` names columns that travel along without being inputs. The list is put together, which is done without generated code, only
    for rows that break something.
    """
    missing = sorted(set(S.MODEL_FEATURES) - set(df.columns))
    unknown = sorted(set(df.columns) - set(S.MODEL_FEATURES) - set(keep))
    if missing or unknown:
        raise ValueError(f"missing columns {missing}, unknown columns {unknown}")
    broken, tested = [], []
    for name in S.MODEL_FEATURES:
        value = F.col(name)
        tests = []
        if name not in NULLABLE:
            tests.append(value.isNull())
        low, high = ROW_BOUNDS.get(name, (None, None))
        if low is not None:
            # NaN sorts above every number, so it needs its own test.
            tests += [value < F.lit(low), F.isnan(value.cast("double"))]
        if high is not None:
            tests.append(value > F.lit(high))
        if name in WHOLE_NUMBERS:
            tests.append(value.cast("double") != F.floor(value.cast("double")))
        if tests:
            bad = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
            broken.append(F.when(bad, F.lit(name)))
            tested.append(bad)
    listed = F.when(reduce(lambda a, b: a | b, tested), F.array_compact(F.array(*broken)))
    return df.withColumn("violations", listed.otherwise(F.array().cast("array<string>")))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)
