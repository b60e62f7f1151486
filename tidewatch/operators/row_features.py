"""Features of a transaction that need nothing but the transaction itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch import schema as S
from tidewatch.functions import columns as C


def add_row_features(df: DataFrame) -> DataFrame:
    """Append the 12 row-level features. One projection: no shuffle, rows are kept."""
    ts = F.col(S.TIMESTAMP).cast("timestamp")
    hour, weekday, month = F.hour(ts), F.weekday(ts), F.month(ts)
    hour_sin, hour_cos = C.cyclic(hour, 24)
    dow_sin, dow_cos = C.cyclic(weekday, 7)
    month_sin, month_cos = C.cyclic(month, 12)
    return df.withColumns(
        {
            "log_amount": F.log1p(S.AMOUNT),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "is_weekend": (weekday >= 5).cast("int"),
            "is_night": ((hour >= 22) | (hour <= 6)).cast("int"),
            "currency_mismatch": C.differs(F.col(S.PAID_IN), F.col(S.RECEIVED_IN)),
            "cross_border": C.differs(F.col("Sender_bank_location"), F.col("Receiver_bank_location")),
            "is_round_amount": C.is_round(F.col(S.AMOUNT)),
        }
    )


def exposure(df: DataFrame, probability: str = "risk_probability") -> DataFrame:
    """Append Amount x probability."""
    return df.withColumn("risk_weighted_exposure", F.col(S.AMOUNT) * F.col(probability))


def model_inputs(df: DataFrame, features: list[str] = S.MODEL_FEATURES) -> DataFrame:
    """The ordered feature projection of a fitted model's input."""
    return df.select(*features)


def guarded_inputs(df: DataFrame, features: list[str] = S.MODEL_FEATURES) -> DataFrame:
    """As ``model_inputs``, refusing identifiers and labels and naming what is missing."""
    forbidden = sorted(set(df.columns) & set(S.FORBIDDEN_INPUTS))
    if forbidden:
        raise ValueError(f"can't learn from columns that name or label a row: {forbidden}")
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"the table has no column for {missing}")
    return df.select(*features)
