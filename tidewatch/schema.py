"""Column names, feature lists and Spark types of the transaction data model."""

from pyspark.sql import types as T

# The names the raw transaction files, the feature tables and the
# saved models agree on.
RAW_COLUMNS = [
    "Time",
    "Date",
    "Sender_account",
    "Receiver_account",
    "Amount",
    "Payment_currency",
    "Received_currency",
    "Sender_bank_location",
    "Receiver_bank_location",
    "Payment_type",
    "Is_laundering",
    "Laundering_type",
]
SENDER, RECEIVER, AMOUNT = "Sender_account", "Receiver_account", "Amount"
PAID_IN, RECEIVED_IN = "Payment_currency", "Received_currency"
TIMESTAMP, TARGET, TYPOLOGY = "timestamp", "Is_laundering", "Laundering_type"

CYCLIC_FEATURES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
FLAG_FEATURES = ["is_weekend", "is_night", "currency_mismatch", "cross_border", "is_round_amount"]
BASE_FEATURES = [AMOUNT, "log_amount", *CYCLIC_FEATURES, *FLAG_FEATURES]
BEHAVIORAL_FEATURES = [
    "sender_txn_count_24h",
    "sender_amount_sum_24h",
    "sender_amount_mean_30d",
    "sender_amount_std_30d",
    "sender_amount_zscore",
    "receiver_txn_count_24h",
    "receiver_amount_sum_24h",
    "seconds_since_sender_txn",
]
NETWORK_FEATURES = [
    "sender_txn_count_lifetime",
    "receiver_txn_count_lifetime",
    "sender_out_degree",
    "receiver_in_degree",
    "pair_transaction_count",
    "sender_counterparty_hhi",
]
CATEGORICAL_FEATURES = [
    "Payment_type",
    PAID_IN,
    RECEIVED_IN,
    "Sender_bank_location",
    "Receiver_bank_location",
]
NUMERIC_FEATURES = BASE_FEATURES + BEHAVIORAL_FEATURES + NETWORK_FEATURES
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
HISTORY_FEATURES = BEHAVIORAL_FEATURES + NETWORK_FEATURES

# The four ablation sets. Every one includes the categorical columns.
ABLATION_FEATURE_SETS = {
    "Base": BASE_FEATURES + CATEGORICAL_FEATURES,
    "+ Behavioral": BASE_FEATURES + BEHAVIORAL_FEATURES + CATEGORICAL_FEATURES,
    "+ Network": BASE_FEATURES + NETWORK_FEATURES + CATEGORICAL_FEATURES,
    "All": MODEL_FEATURES,
}

# Columns that identify a party or leak the label, never model inputs.
FORBIDDEN_INPUTS = [SENDER, RECEIVER, TARGET, TYPOLOGY]

# Text that stands for a missing value in the raw files (pandas' public default list).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

RAW_TYPES = {
    AMOUNT: T.DoubleType(),
    TARGET: T.ByteType(),
}
