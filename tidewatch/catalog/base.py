"""Registry of queries, and the SQL view they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.plans.fixture import TIE_BREAK

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEYS = TIE_BREAK
KEY_SQL = ", ".join(TIE_BREAK)

# The transaction view of ``plans.fixture.transactions`` as SQL.
TXN_SQL = """
WITH txn AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CAST(o_orderdate AS TIMESTAMP) AS ts,
           CAST(o_custkey AS VARCHAR) AS sender,
           CAST(l_suppkey AS VARCHAR) AS receiver,
           l_extendedprice AS amount,
           CAST(l_extendedprice AS DECIMAL(18, 2)) AS money,
           sr.r_name AS paid_in, rr.r_name AS received_in,
           sn.n_name AS sender_place, rn.n_name AS receiver_place,
           o_orderpriority AS payment_type,
           CAST(l_discount >= 0.10 AND l_tax >= 0.08 AS INTEGER) AS y,
           concat(l_returnflag, l_linestatus) AS typology,
           l_discount AS tied_score,
           l_extendedprice / (l_extendedprice + 50000.0) AS fine_score
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation sn ON c_nationkey = sn.n_nationkey
    JOIN region sr ON sn.n_regionkey = sr.r_regionkey
    JOIN nation rn ON s_nationkey = rn.n_nationkey
    JOIN region rr ON rn.n_regionkey = rr.r_regionkey
)"""

EVENT_SQL = """
WITH ev AS (
    SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS VARCHAR) AS sender,
           json_extract_string(props, '$.k') AS receiver, value AS amount,
           CAST(value AS DECIMAL(18, 2)) AS money, event_type AS paid_in
    FROM events
)"""

# Total order of rows within one timestamp.
TIE_SQL = KEY_SQL


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL it must agree with if there is one."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(name: str, digits: int = 6, alias: str | None = None) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(alias or name)
