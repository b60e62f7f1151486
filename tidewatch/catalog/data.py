"""Scans, sinks, row features, cleaning, quality and drift."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import schema as S
from tidewatch.catalog.base import KEY_SQL, KEYS, TXN_SQL, query, rounded
from tidewatch.functions import columns as C
from tidewatch.operators import drift, quality
from tidewatch.operators.row_features import add_row_features, exposure
from tidewatch.plans import fixture
from tidewatch.session import materialize, shared_folder
from tidewatch.sources import transactions as source

_SUMMARY_SQL = f"""{TXN_SQL}
    SELECT payment_type, COUNT(*) AS n, CAST(SUM(money) AS DOUBLE) AS total,
           CAST(SUM(y) AS BIGINT) AS positives, COUNT(DISTINCT sender) AS senders,
           MIN(ts) AS first_ts, MAX(ts) AS last_ts
    FROM txn GROUP BY payment_type"""


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("Payment_type").alias("payment_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(S.AMOUNT).cast("decimal(18,2)")).cast("double").alias("total"),
        F.sum(F.col(S.TARGET).cast("long")).alias("positives"),
        F.count_distinct(S.SENDER).alias("senders"),
        F.min(S.TIMESTAMP).alias("first_ts"),
        F.max(S.TIMESTAMP).alias("last_ts"),
    )


@query("csv_scan", _SUMMARY_SQL)
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Write the raw twelve columns as CSV, read them back typed, and summarise."""
    txn = fixture.transactions(spark, folder)
    raw = txn.withColumns(
        {
            "Date": F.date_format(S.TIMESTAMP, "yyyy-MM-dd"),
            "Time": F.date_format(S.TIMESTAMP, "HH:mm:ss"),
        }
    ).select(*reversed(S.RAW_COLUMNS))
    path = f"{shared_folder(spark)}/csv-{uuid4().hex}"
    raw.write.option("header", True).csv(path)
    return _summary(source.read_transactions(spark, path))


@query("parquet_scan", _SUMMARY_SQL)
def parquet_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Write the partitioned feature table, read it back, and summarise."""
    path = f"{shared_folder(spark)}/features-{uuid4().hex}"
    source.write_features(add_row_features(fixture.transactions(spark, folder)), path)
    return _summary(source.read_features(spark, path))


_HOUR, _DOW, _MONTH = "hour(ts)", "(isodow(ts) - 1)", "month(ts)"


def _wave(fn: str, value: str, period: int) -> str:
    return f"ROUND({fn}(2 * pi() * {value} / {period}), 9)"


ROW_FEATURE_SQL = f"""ROUND(ln(1 + amount), 9) AS log_amount,
           {_wave("sin", _HOUR, 24)} AS hour_sin, {_wave("cos", _HOUR, 24)} AS hour_cos,
           {_wave("sin", _DOW, 7)} AS dow_sin, {_wave("cos", _DOW, 7)} AS dow_cos,
           {_wave("sin", _MONTH, 12)} AS month_sin, {_wave("cos", _MONTH, 12)} AS month_cos,
           CAST({_DOW} >= 5 AS INTEGER) AS is_weekend,
           CAST({_HOUR} >= 22 OR {_HOUR} <= 6 AS INTEGER) AS is_night,
           CAST(paid_in IS DISTINCT FROM received_in AS INTEGER) AS currency_mismatch,
           CAST(sender_place IS DISTINCT FROM receiver_place AS INTEGER) AS cross_border,
           CAST(amount - 1000 * floor(amount / 1000) <= 1e-8 AS INTEGER) AS is_round_amount"""


@query("row_features", f"{TXN_SQL} SELECT {KEY_SQL}, {ROW_FEATURE_SQL} FROM txn")
def row_features(spark: SparkSession, folder: str) -> DataFrame:
    df = add_row_features(fixture.transactions(spark, folder))
    waves = ["log_amount", *S.CYCLIC_FEATURES]
    return df.select(*KEYS, *[rounded(c, 9) for c in waves], *S.FLAG_FEATURES)


@query(
    "event_row_features",
    f"""SELECT event_id, ROUND(ln(1 + value), 9) AS log_amount,
           {_wave("sin", _HOUR, 24)} AS hour_sin, {_wave("cos", _HOUR, 24)} AS hour_cos,
           CAST({_DOW} >= 5 AS INTEGER) AS is_weekend,
           CAST({_HOUR} >= 22 OR {_HOUR} <= 6 AS INTEGER) AS is_night
    FROM events""",
)
def event_row_features(spark: SparkSession, folder: str) -> DataFrame:
    """Hours and nights, which the day-grain view doesn't have."""
    ev = fixture.event_transactions(spark, folder).withColumns(
        {c: F.lit(None).cast("string") for c in ("Sender_bank_location", "Receiver_bank_location")}
    )
    df = add_row_features(ev)
    waves = ["log_amount", "hour_sin", "hour_cos"]
    return df.select("event_id", *[rounded(c, 9) for c in waves], "is_weekend", "is_night")


@query(
    "risk_weighted_exposure",
    f"""{TXN_SQL}
    SELECT typology, ROUND(CAST(SUM(CAST(amount * tied_score AS DECIMAL(38, 6))) AS DOUBLE), 2) AS exposure
    FROM txn GROUP BY typology""",
)
def risk_weighted_exposure(spark: SparkSession, folder: str) -> DataFrame:
    df = exposure(fixture.transactions(spark, folder), "tied_score")
    total = F.sum(F.col("risk_weighted_exposure").cast("decimal(28,6)")).cast("double")
    return df.groupBy(F.col(S.TYPOLOGY).alias("typology")).agg(F.round(total, 2).alias("exposure"))


@query(
    "cleaned_values",
    """SELECT event_id, CASE WHEN log10_value IS NULL OR isinf(log10_value) OR isnan(log10_value)
                             THEN 0 ELSE ROUND(log10_value, 9) END AS cleaned
    FROM (SELECT event_id, CASE WHEN value > 10 THEN log10(value) WHEN value > 5 THEN 'inf'::DOUBLE
                                WHEN value > 2 THEN 'nan'::DOUBLE END AS log10_value FROM events)""",
)
def cleaned_values(spark: SparkSession, folder: str) -> DataFrame:
    """Infinities, NaN and nulls become 0."""
    value = F.col("value")
    spoilt = (
        F.when(value > 10, F.log10(value))
        .when(value > 5, F.lit(float("inf")))
        .when(value > 2, F.lit(float("nan")))
    )
    return fixture.table(spark, folder, "events").select(
        "event_id", F.round(C.finite_or_zero(spoilt), 9).alias("cleaned")
    )


@query(
    "complete_rows",
    f"""{TXN_SQL}
    SELECT payment_type, COUNT(*) AS kept FROM txn
    WHERE l_linenumber <> 2 AND l_linenumber <> 3 GROUP BY payment_type""",
)
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows without a readable time or without an amount are dropped; other ways to write a time aren't."""
    txn = fixture.transactions(spark, folder)
    line = F.col("l_linenumber")
    raw = txn.withColumns(
        {
            "Date": F.when(line == 4, F.date_format(S.TIMESTAMP, "yyyy/MM/dd")).otherwise(F.date_format(S.TIMESTAMP, "yyyy-MM-dd")),
            "Time": F.when(line == 2, "noon")
            .when(line == 4, F.date_format(S.TIMESTAMP, "HH:mm"))
            .when(line == 5, F.date_format(S.TIMESTAMP, "HH:mm:ss.SSS"))
            .otherwise(F.date_format(S.TIMESTAMP, "HH:mm:ss")),
            S.AMOUNT: F.when(line != 3, F.col(S.AMOUNT)),
        }
    ).select(*S.RAW_COLUMNS)
    path = f"{shared_folder(spark)}/csv-{uuid4().hex}"
    raw.write.option("header", True).csv(path)
    kept = source.read_transactions(spark, path)
    return kept.groupBy(F.col("Payment_type").alias("payment_type")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "round_amounts",
    f"""{TXN_SQL}, coarse AS (
        SELECT * REPLACE (CASE WHEN l_linenumber % 2 = 0 THEN ROUND(amount, -3) ELSE amount END AS amount) FROM txn
    )
    SELECT {KEY_SQL}, CAST(amount - 1000 * floor(amount / 1000) <= 1e-8 AS INTEGER) AS is_round_amount FROM coarse""",
)
def round_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every other amount is a multiple of 1,000."""
    txn = fixture.transactions(spark, folder)
    coarse = F.when(F.col("l_linenumber") % 2 == 0, F.round(S.AMOUNT, -3)).otherwise(F.col(S.AMOUNT))
    return add_row_features(txn.withColumn(S.AMOUNT, coarse)).select(*KEYS, "is_round_amount")


# --- quality ---------------------------------------------------------------


def _with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events with some values missing, infinite or extreme."""
    ev = fixture.table(spark, folder, "events")
    v = F.col("value")
    return ev.select(
        "event_id",
        "user_id",
        "event_type",
        F.when(v >= 3, v).alias("holey"),
        F.when(v >= 1, v).otherwise(float("nan")).alias("hollow"),
        F.when(v > 60, float("inf")).otherwise(v).alias("endless"),
        F.when(v > 20, v * 1000).otherwise(v).alias("spiky"),
    )


_GAPS_SQL = """WITH gaps AS (
    SELECT event_id, user_id, event_type, CASE WHEN value >= 3 THEN value END AS holey,
           CASE WHEN value >= 1 THEN value END AS hollow,
           CASE WHEN value > 60 THEN 'inf'::DOUBLE ELSE value END AS endless,
           CASE WHEN value > 20 THEN value * 1000 ELSE value END AS spiky
    FROM events
)"""


@query(
    "null_fractions",
    _GAPS_SQL
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", ROUND(AVG(CAST({c} IS NULL AS INTEGER)), 9) AS value FROM gaps"
        for c in ("event_id", "user_id", "event_type", "holey", "hollow", "endless", "spiky")
    ),
)
def null_fractions(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_fractions(_with_gaps(spark, folder)).select("column", rounded("value", 9))


@query(
    "infinite_counts",
    _GAPS_SQL
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", CAST(COUNT(*) FILTER (isinf({c})) AS DOUBLE) AS value FROM gaps"
        for c in ("holey", "hollow", "endless", "spiky")
    ),
)
def infinite_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.infinite_counts(_with_gaps(spark, folder), ["holey", "hollow", "endless", "spiky"])


@query(
    "outlier_fractions",
    _GAPS_SQL
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", ROUND(AVG(CAST(COALESCE({c} < lo OR {c} > hi, FALSE) AS INTEGER)), 9) AS value
        FROM gaps, (SELECT q1 - 10 * (q3 - q1) AS lo, q3 + 10 * (q3 - q1) AS hi
                    FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM gaps))"""
        for c in ("user_id", "holey", "hollow", "spiky")
    ),
)
def outlier_fractions(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.outlier_fractions(_with_gaps(spark, folder), ["user_id", "holey", "hollow", "spiky"])
    return found.select("column", rounded("value", 9))


@query(
    "chronology",
    f"""{TXN_SQL}, steps AS (
        SELECT l_orderkey, MIN(ts) AS earliest, MAX(ts) AS latest FROM txn GROUP BY l_orderkey
    ), seen AS (
        SELECT *, MAX(latest) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far
        FROM steps
    )
    SELECT COUNT(*) FILTER (earliest < so_far OR earliest < latest) AS out_of_order FROM seen""",
)
def chronology(spark: SparkSession, folder: str) -> DataFrame:
    """Is the order of the order keys a chronological one?"""
    return quality.out_of_order(fixture.transactions(spark, folder), "l_orderkey", rows_per_piece=10_000)


@query(
    "target_summary",
    f"{TXN_SQL} SELECT MIN(y) AS low, MAX(y) AS high, ROUND(AVG(y), 9) AS prevalence FROM txn",
)
def target_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.target_summary(fixture.transactions(spark, folder))
    return found.select("low", "high", rounded("prevalence", 9))


def contract_rows(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Line items read as scorer input, with values that break the contract in places."""
    li = fixture.table(spark, folder, "lineitem")
    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    values: dict = {c: F.lit(0.0) for c in S.NUMERIC_FEATURES} | {c: F.lit("x") for c in S.CATEGORICAL_FEATURES}
    values |= {
        "Amount": F.col("l_extendedprice") - 2000,
        "hour_sin": tax * 20 - F.lit(0.2),
        "is_weekend": (quantity - 1) / 2,
        "sender_amount_mean_30d": F.when(quantity > 40, quantity),
        "sender_txn_count_24h": F.when(quantity < 48, quantity),
        "sender_counterparty_hhi": F.col("l_discount") * 11,
        "Payment_type": F.when(quantity != 7, F.col("l_returnflag")),
    }
    return li.select(*KEYS, *extra, *[v.alias(c) for c, v in values.items()])


# Names of the columns that break the contract, in order.
BROKEN_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              concat_ws(',', CASE WHEN l_extendedprice - 2000 < 0 THEN 'Amount' END,
                  CASE WHEN l_tax * 20 - 0.2 < -1 OR l_tax * 20 - 0.2 > 1 THEN 'hour_sin' END,
                  CASE WHEN l_quantity > 3 OR l_quantity = 2 THEN 'is_weekend' END,
                  CASE WHEN l_quantity >= 48 THEN 'sender_txn_count_24h' END,
                  CASE WHEN l_discount * 11 > 1 THEN 'sender_counterparty_hhi' END,
                  CASE WHEN l_quantity = 7 THEN 'Payment_type' END) AS broken
       FROM lineitem"""


@query("row_contract", BROKEN_SQL)
def row_contract(spark: SparkSession, folder: str) -> DataFrame:
    checked = quality.check_rows(contract_rows(spark, folder), KEYS)
    return checked.select(*KEYS, F.concat_ws(",", "violations").alias("broken"))


@query(
    "row_contract_split",
    """SELECT l_returnflag AS flag, CAST(COUNT(*) FILTER (ok) AS BIGINT) AS good,
              CAST(COUNT(*) FILTER (NOT ok) AS BIGINT) AS quarantine
       FROM (SELECT l_returnflag, l_extendedprice >= 2000 AND l_tax * 20 - 0.2 <= 1
                    AND l_quantity IN (1, 3) AND l_discount * 11 <= 1 AS ok FROM lineitem)
       GROUP BY l_returnflag""",
)
def row_contract_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that honour the contract and rows set aside, for each flag."""
    checked = quality.check_rows(contract_rows(spark, folder, "l_returnflag"), [*KEYS, "l_returnflag"])
    sides = (
        quality.accepted(checked).select("l_returnflag", F.lit(1).alias("ok"))
        .unionByName(quality.quarantined(checked).select("l_returnflag", F.lit(0).alias("ok")))
    )
    return sides.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.sum(F.col("ok").cast("long")).alias("good"), F.sum((1 - F.col("ok")).cast("long")).alias("quarantine")
    )


@query(
    "quality_issues",
    _GAPS_SQL
    + """ SELECT 'null_fraction' AS "check", 'holey' AS "column", 'issue' AS severity,
            ROUND(AVG(CAST(holey IS NULL AS INTEGER)), 9) AS value FROM gaps
            HAVING AVG(CAST(holey IS NULL AS INTEGER)) > 0.05
       UNION ALL SELECT 'null_fraction', 'hollow', 'issue', ROUND(AVG(CAST(hollow IS NULL AS INTEGER)), 9) FROM gaps
            HAVING AVG(CAST(hollow IS NULL AS INTEGER)) > 0.05
       UNION ALL SELECT 'infinite_values', 'endless', 'issue', CAST(COUNT(*) FILTER (isinf(endless)) AS DOUBLE) FROM gaps
            HAVING COUNT(*) FILTER (isinf(endless)) > 0
       UNION ALL SELECT 'extreme_outliers', 'spiky', 'warning', ROUND(AVG(CAST(spiky > hi AS INTEGER)), 9)
            FROM gaps, (SELECT quantile_cont(spiky, 0.75)
                               + 10 * (quantile_cont(spiky, 0.75) - quantile_cont(spiky, 0.25)) AS hi FROM gaps)
            HAVING AVG(CAST(spiky > hi AS INTEGER)) > 0.05
       UNION ALL SELECT 'extreme_outliers', 'endless', 'warning', ROUND(AVG(CAST(endless > hi AS INTEGER)), 9)
            FROM gaps, (SELECT quantile_cont(endless, 0.75)
                               + 10 * (quantile_cont(endless, 0.75) - quantile_cont(endless, 0.25)) AS hi FROM gaps)
            HAVING AVG(CAST(endless > hi AS INTEGER)) > 0.05
       UNION ALL SELECT 'missing_feature', f, 'issue', NULL FROM (VALUES """
    + ", ".join(f"('{c}')" for c in S.MODEL_FEATURES)
    + """) AS v(f)
       UNION ALL SELECT 'target_not_found', 'Is_laundering', 'issue', NULL
       UNION ALL SELECT 'timestamp_not_found', 'timestamp', 'issue', NULL""",
)
def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.find_issues(_with_gaps(spark, folder))
    return found.select("check", "column", "severity", rounded("value", 9))


def _spoilt_features(spark: SparkSession, folder: str, target: Column) -> DataFrame:
    """A table with every model input, the target and the time, with every kind of fault that isn't an absent column."""
    line, amount = F.col("l_linenumber"), F.col(S.AMOUNT)
    values: dict = {c: F.lit(0.0) for c in S.NUMERIC_FEATURES}
    values |= {
        S.AMOUNT: F.when(line != 2, amount),
        "log_amount": F.when(line == 4, F.lit(float("inf"))).otherwise(F.log1p(amount)),
        "hour_sin": F.when(line == 5, F.lit(1000.0)).otherwise(amount / 1e6),
        "sender_amount_std_30d": F.when(line == 3, F.lit(float("nan"))).otherwise(amount),
    }
    txn = fixture.transactions(spark, folder)
    kept = txn.withColumn("y", target.cast("int")).select("l_orderkey", S.TIMESTAMP, F.col("y").alias(S.TARGET), *S.CATEGORICAL_FEATURES, *[v.alias(c) for c, v in values.items()])
    return materialize(kept, "spoilt-features")


def _fault_sql(target: str) -> str:
    share = "ROUND(AVG(CAST({0} AS INTEGER)), 9)"

    def outliers(column: str, value: str) -> str:
        return f"""UNION ALL SELECT 'extreme_outliers', '{column}', 'warning', {share.format(f"{value} > hi")}
            FROM spoilt, (SELECT quantile_cont({value}, 0.75) + 10 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS hi FROM spoilt)
            HAVING AVG(CAST({value} > hi AS INTEGER)) > 0.05 """

    return f"""{TXN_SQL}, spoilt AS (
        SELECT *, {target} AS t, CASE WHEN l_linenumber = 4 THEN 'inf'::DOUBLE ELSE ln(1 + amount) END AS la,
               CASE WHEN l_linenumber = 5 THEN 1000.0 ELSE amount / 1e6 END AS hs FROM txn
    ), steps AS (
        SELECT l_orderkey, MIN(ts) AS earliest, MAX(ts) AS latest FROM txn GROUP BY l_orderkey
    ), seen AS (
        SELECT *, MAX(latest) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM steps
    )
    SELECT 'null_fraction' AS "check", 'Amount' AS "column", 'issue' AS severity, {share.format('l_linenumber = 2')} AS value FROM spoilt
        HAVING AVG(CAST(l_linenumber = 2 AS INTEGER)) > 0.05
    UNION ALL SELECT 'null_fraction', 'sender_amount_std_30d', 'issue', {share.format('l_linenumber = 3')} FROM spoilt
        HAVING AVG(CAST(l_linenumber = 3 AS INTEGER)) > 0.05
    UNION ALL SELECT 'infinite_values', 'log_amount', 'issue', CAST(COUNT(*) FILTER (isinf(la)) AS DOUBLE) FROM spoilt HAVING COUNT(*) FILTER (isinf(la)) > 0
    UNION ALL SELECT 'not_chronological', 'timestamp', 'issue', CAST(COUNT(*) FILTER (earliest < so_far OR earliest < latest) AS DOUBLE) FROM seen
        HAVING COUNT(*) FILTER (earliest < so_far OR earliest < latest) > 0
    UNION ALL SELECT 'fewer_than_two_classes', 'Is_laundering', 'issue', ROUND(AVG(t), 9) FROM spoilt HAVING MIN(t) = MAX(t)
    UNION ALL SELECT 'extreme_prevalence', 'Is_laundering', 'warning', ROUND(AVG(t), 9) FROM spoilt HAVING AVG(t) < 0.0001 OR AVG(t) > 0.9999
    {outliers('log_amount', 'la')} {outliers('hour_sin', 'hs')}"""


@query("feature_table_issues", _fault_sql("CAST(l_orderkey % 30000 = 7 AS INTEGER)"))
def feature_table_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Every kind of issue and warning that rows can cause; the rare target brings a warning where the table is large enough."""
    found = quality.find_issues(_spoilt_features(spark, folder, F.col("l_orderkey") % 30000 == 7), sequence="l_orderkey")
    return found.select("check", "column", "severity", rounded("value", 9))


@query("feature_table_issues_one_class", _fault_sql("1"))
def feature_table_issues_one_class(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a target of one class: an issue, and a prevalence to warn of."""
    found = quality.find_issues(_spoilt_features(spark, folder, F.lit(1)), sequence="l_orderkey")
    return found.select("check", "column", "severity", rounded("value", 9))


@query("missing_raw_columns", "SELECT c AS missing, COUNT(*) AS rows FROM lineitem, (VALUES ('Amount'), ('Payment_type')) names(c) GROUP BY c")
def missing_raw_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files without two of their columns: the columns the refusal names, and the rows that weren't read."""
    txn = fixture.transactions(spark, folder)
    path = f"{shared_folder(spark)}/short-csv-{uuid4().hex}"
    left = [c for c in S.RAW_COLUMNS if c not in ("Amount", "Payment_type", "Date", "Time")]
    txn.select(*left, F.date_format(S.TIMESTAMP, "yyyy-MM-dd").alias("Date"), F.lit("00:00:00").alias("Time")).write.option("header", True).csv(path)
    rows = spark.read.option("header", True).csv(path).count()
    try:
        source.read_transactions(spark, path)
        names = []
    except ValueError as refusal:
        names = [c for c in S.RAW_COLUMNS if c in str(refusal).rpartition(" named ")[2].split(", ")]
    return spark.createDataFrame([(c, rows) for c in names], "missing string, rows long")


@query(
    "feature_file_order",
    f"{TXN_SQL} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS out_of_order, COUNT(DISTINCT strftime(ts, '%Y-%m')) AS months FROM txn",
)
def feature_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the stored feature table, those that come before an earlier one in their file, and its months."""
    path = f"{shared_folder(spark)}/features-{uuid4().hex}"
    source.write_features(add_row_features(fixture.transactions(spark, folder)), path)
    rows = source.read_features(spark, path).select(
        S.TIMESTAMP, "event_month", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")
    )
    before = F.lag(S.TIMESTAMP).over(Window.partitionBy("file").orderBy("place"))
    return rows.withColumn("before", before).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(S.TIMESTAMP) < F.col("before")).alias("out_of_order"), F.count_distinct("event_month").alias("months")
    )


# --- drift -----------------------------------------------------------------


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    ev = fixture.table(spark, folder, "events").withColumn("doubled", F.col("value") * 2 + F.col("user_id"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


_STATS = """AVG({c}) AS m, STDDEV_SAMP({c}) AS s, MIN({c}) AS lo, MAX({c}) AS hi"""
_HALF_SQL = "WITH ev AS (SELECT *, value * 2 + user_id AS doubled FROM events)"


@query(
    "baseline_statistics",
    _HALF_SQL
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS feature, ROUND(m, 6) AS mean, ROUND(s, 6) AS std, CAST(lo AS DOUBLE) AS min,
             CAST(hi AS DOUBLE) AS max FROM (SELECT {_STATS.format(c=c)} FROM ev WHERE ts < '2024-01-16')"""
        for c in ("value", "doubled", "user_id")
    ),
)
def baseline_statistics(spark: SparkSession, folder: str) -> DataFrame:
    before, _ = _halves(spark, folder)
    stats = drift.baseline_statistics(before, ["value", "doubled", "user_id", "absent"])
    return stats.select("feature", rounded("mean"), rounded("std"), "min", "max")


@query(
    "feature_drift",
    _HALF_SQL
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS feature, ROUND(b.m, 6) AS baseline_mean, ROUND(n.m, 6) AS current_mean,
             ROUND(ABS(n.m - b.m) / GREATEST(ABS(b.m), 1e-8) * 100, 6) AS mean_change_pct,
             ROUND(b.s, 6) AS baseline_std, ROUND(n.s, 6) AS current_std,
             ROUND(ABS(n.s - b.s) / GREATEST(b.s, 1e-8) * 100, 6) AS std_change_pct,
             ABS(n.m - b.m) / GREATEST(ABS(b.m), 1e-8) > 0.1 OR ABS(n.s - b.s) / GREATEST(b.s, 1e-8) > 0.1
                 AS drift_detected
             FROM (SELECT {_STATS.format(c=c)} FROM ev WHERE ts < '2024-01-16') b,
                  (SELECT {_STATS.format(c=c)} FROM ev WHERE ts >= '2024-01-16') n"""
        for c in ("value", "doubled")
    ),
)
def feature_drift(spark: SparkSession, folder: str) -> DataFrame:
    before, after = _halves(spark, folder)
    found = drift.feature_drift(
        after, drift.baseline_statistics(before, ["value", "doubled"]), ["value", "doubled", "user_id"]
    )
    numbers = [c for c in found.columns if c not in ("feature", "drift_detected")]
    return found.select("feature", *[rounded(c) for c in numbers], "drift_detected")


@query(
    "prediction_drift",
    """WITH grid AS (SELECT unnest(quantile_cont(fine, [i / 100.0 FOR i IN range(0, 101)])) AS q
                     FROM (SELECT value / (value + 50) AS fine FROM events WHERE ts < '2024-01-16')),
       base AS (SELECT quantile_cont(q, 0.5) AS m, STDDEV_POP(q) AS s FROM grid),
       cur AS (SELECT quantile_cont(fine, 0.5) AS m, STDDEV_POP(fine) AS s
               FROM (SELECT value / (value + 50) AS fine FROM events WHERE ts >= '2024-01-16'))
       SELECT ROUND(base.m, 6) AS baseline_median, ROUND(cur.m, 6) AS current_median,
              ROUND(ABS(cur.m - base.m), 6) AS median_shift, ROUND(base.s, 6) AS baseline_std,
              ROUND(cur.s, 6) AS current_std, ROUND(cur.s / base.s, 6) AS std_ratio,
              ABS(cur.m - base.m) > 2 * base.s AS median_drift_detected,
              cur.s / base.s > 2 OR cur.s / base.s < 0.5 AS variance_drift_detected,
              ABS(cur.m - base.m) > 2 * base.s OR cur.s / base.s > 2 OR cur.s / base.s < 0.5 AS drift_detected
       FROM base, cur""",
)
def prediction_drift(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.plans.ordering import quantiles

    before, after = (
        half.withColumn("score", F.col("value") / (F.col("value") + 50)) for half in _halves(spark, folder)
    )
    grid = quantiles(before, {"score": [i / 100.0 for i in range(101)]})["score"]
    found = drift.prediction_drift(after, grid)
    flags = [c for c in found.columns if c.endswith("_detected")]
    return found.select(*[rounded(c) for c in found.columns if c not in flags], *flags)


_WEEKS_SQL = f"{_HALF_SQL}, weeks AS (SELECT *, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS BIGINT) AS week FROM ev)"


def _weekly_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Stored moments of every day, with the week the day is in."""
    ev = fixture.table(spark, folder, "events").withColumn("doubled", F.col("value") * 2 + F.col("user_id"))
    daily = materialize(drift.daily_moments(ev.withColumn("day", F.to_date("ts")), ["value", "doubled"], ["day"]), "daily-moments")
    return daily.withColumn("week", F.expr("datediff(day, DATE'2024-01-01') div 7"))


@query(
    "statistics_of_merged_days",
    _WEEKS_SQL
    + " UNION ALL ".join(
        f""" SELECT week, '{c}' AS feature, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
             CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max FROM weeks GROUP BY week"""
        for c in ("value", "doubled")
    ),
)
def statistics_of_merged_days(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of weeks, merged from the moments of days."""
    found = drift.merged_statistics(_weekly_moments(spark, folder), ["week"])
    return found.select("week", "feature", rounded("mean"), rounded("std"), "min", "max")


@query(
    "feature_drift_by_week",
    _WEEKS_SQL
    + " UNION ALL ".join(
        f""" SELECT week, '{c}' AS feature, ROUND(b.m, 6) AS baseline_mean, ROUND(n.m, 6) AS current_mean,
             ROUND(ABS(n.m - b.m) / GREATEST(ABS(b.m), 1e-8) * 100, 6) AS mean_change_pct,
             ROUND(b.s, 6) AS baseline_std, ROUND(n.s, 6) AS current_std,
             ROUND(ABS(n.s - b.s) / GREATEST(b.s, 1e-8) * 100, 6) AS std_change_pct,
             COALESCE(ABS(n.m - b.m) / GREATEST(ABS(b.m), 1e-8) > 0.01 OR ABS(n.s - b.s) / GREATEST(b.s, 1e-8) > 0.01, FALSE)
                 AS drift_detected
             FROM (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM weeks WHERE week < 2) b,
                  (SELECT week, AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM weeks WHERE week >= 2 GROUP BY week) n"""
        for c in ("value", "doubled")
    ),
)
def feature_drift_by_week(spark: SparkSession, folder: str) -> DataFrame:
    """Every later week against the first two, all from stored moments."""
    moments = _weekly_moments(spark, folder)
    baseline = drift.merged_statistics(moments.where("week < 2"))
    found = drift.drift_by(moments.where("week >= 2"), baseline, ["week"], threshold=0.01)
    numbers = [c for c in found.columns if c not in ("week", "feature", "drift_detected")]
    return found.select("week", "feature", *[rounded(c) for c in numbers], "drift_detected")


@query(
    "merged_score_sketches",
    f"""SELECT COUNT(DISTINCT CAST(ts AS DATE)) AS days, COUNT(*) AS n, CAST(101 AS BIGINT) AS quantiles,
        ROUND({drift.rank_error()}, 9) AS stated_error, TRUE AS within FROM events""",
)
def merged_score_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of days merged into one: whether all its quantiles have ranks within the stated error."""
    ev = fixture.table(spark, folder, "events").select(F.to_date("ts").alias("day"), (F.col("value") / (F.col("value") + 50)).alias("score"))
    daily = materialize(drift.score_sketches(ev, ["day"]), "daily-sketches")
    shares = [i / 100.0 for i in range(101)]
    merged = drift.sketch_quantiles(drift.merged_sketch(daily), shares).first()
    days = daily.count()
    largest = max(drift.rank_errors(ev, "score", merged["quantiles"], shares, merged["n"]))
    found = [(days, merged["n"], len(shares), round(drift.rank_error(), 9), largest <= drift.rank_error())]
    return spark.createDataFrame(found, "days long, n long, quantiles long, stated_error double, within boolean")
