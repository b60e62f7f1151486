"""Transaction views over the star-schema and event tables used as test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.session import prepare

TIE_BREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per line item: the customer pays the supplier on the order date.

    The dimension tables carry no broadcast hint; Spark broadcasts them while
    their size stays under ``spark.sql.autoBroadcastJoinThreshold``. Payers are joined
    to orders first: once they are too many to broadcast, orders are shuffled for them and not the lines.
    """
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    payer_place = places.select(
        F.col("n_nationkey").alias("payer_nation"),
        F.col("n_name").alias("Sender_bank_location"),
        F.col("r_name").alias("Payment_currency"),
    )
    payee_place = places.select(
        F.col("n_nationkey").alias("payee_nation"),
        F.col("n_name").alias("Receiver_bank_location"),
        F.col("r_name").alias("Received_currency"),
    )
    payers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("payer_nation"))
    payees = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("payee_nation"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, folder, "lineitem")
    paid = orders.join(payers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(paid, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(payees, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(payer_place, "payer_nation")
        .join(payee_place, "payee_nation")
        .select(
            *TIE_BREAK,
            F.col("o_orderdate").cast("timestamp").alias("timestamp"),
            F.col("o_custkey").cast("string").alias("Sender_account"),
            F.col("l_suppkey").cast("string").alias("Receiver_account"),
            F.col("l_extendedprice").alias("Amount"),
            "Payment_currency",
            "Received_currency",
            "Sender_bank_location",
            "Receiver_bank_location",
            F.col("o_orderpriority").alias("Payment_type"),
            ((F.col("l_discount") >= 0.10) & (F.col("l_tax") >= 0.08)).cast("int").alias("Is_laundering"),
            F.concat("l_returnflag", "l_linestatus").alias("Laundering_type"),
            F.col("l_discount").alias("tied_score"),
            (F.col("l_extendedprice") / (F.col("l_extendedprice") + 50000.0)).alias("fine_score"),
        )
    )


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream read as payments from a user to a page key, currency = event type."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("Sender_account"),
        F.get_json_object("props", "$.k").alias("Receiver_account"),
        F.col("value").alias("Amount"),
        F.col("event_type").alias("Payment_currency"),
        F.col("event_type").alias("Received_currency"),
    )
