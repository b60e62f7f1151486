"""Sharding by sampled splitters.

Records are ordered by a key, here a hash of the text, so equal texts are neighbours. A sample
in proportion to size gives splitters at equal parts of the bytes; records are counted exactly
in the ranges between them, and a range that holds too much is divided again: by key if it has
several keys, by record if it is one hot key. Whole small ranges are then dealt to shards in key
order by their running bytes, which are exact, so shards differ by about a part in a hundred
wherever no single record is larger than that.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.base import query, table
from tidewatch.session import materialize

SHARDS = 16
#: Ranges for each shard at least, and sampled keys for each range. All ranges together are a quarter of the square root of
#: the number of records or more, so the records of a range grow with the root only.
RANGES = 64
SAMPLED = 8
SPREAD = 1 << 62


def unit(column: Column, salt: int) -> Column:
    """A reproducible number in [0, 1) for each value."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(salt)), 11) / float(1 << 53)


def splitters(records: DataFrame, total: int, ranges: int, sampled: int) -> list[int]:
    """Keys that cut the records into about ``ranges`` parts of equal size.

    A record is drawn with a probability in proportion to its size; one larger than the sampling
    step stands for as many draws as it holds steps. A key that fills whole parts gets a part of
    its own.
    """
    step = max(1.0, total / (ranges * sampled))
    drawn = records.where(unit(F.struct("row", "key"), 1) < F.col("size") / step).withColumn(
        "draws", F.greatest(F.lit(1), F.floor(F.col("size") / step))
    )
    by_key = drawn.groupBy("key").agg(F.sum("draws").alias("draws"))
    upto = F.sum("draws").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    everything = F.sum("draws").over(W.partitionBy())
    marks = by_key.select(
        "key",
        F.floor((upto - F.col("draws")) * ranges / everything).alias("before"),
        F.floor(upto * ranges / everything).alias("after"),
    ).where("after > before")
    cuts = set()
    for key, before, after in marks.collect():  # at most one row for each range
        cuts.add(key)
        if after > before + 1:
            cuts.add(key + 1)
    return sorted(cuts)


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by bisection."""
    if not cuts:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: at + F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) <= key), step).otherwise(0),
    )


def shards(
    docs: DataFrame,
    n_shards: int = SHARDS,
    ranges: int | None = None,
    sampled: int = SAMPLED,
    text: Column | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row.

    A null text has size 1 (as an empty one) and checksum 0; a null id is an id like any other.
    Equal texts share a shard unless a range of them is too large for its part. Repeated rows
    are separate records with slots of their own; slots follow key, id and size, and rows equal in
    all of these are interchangeable. An empty table gives no rows. Other columns aren't read.
    """
    text = F.col("text") if text is None else text
    body = F.coalesce(text, F.lit(""))
    records = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("row"),
        ),
        "shard-records",
    )
    total, rows = records.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    parts = n_shards * max(RANGES, math.isqrt(rows) // (4 * n_shards)) if ranges is None else n_shards * ranges
    cuts = splitters(records, total, parts, sampled)
    placed = records.withColumn("range", range_of(F.col("key"), cuts))
    # Overfull ranges are divided, by key where they have several keys and by row where they have one.
    held = placed.groupBy("range").agg(F.sum("size").alias("held"), F.min("key").alias("low"), F.max("key").alias("high"))
    fair = max(1.0, total / parts)
    held = held.withColumn("pieces", F.when(F.col("held") > 2 * fair, F.ceil(F.col("held") / fair)).otherwise(1))
    # At most a row for each range, 80,000 for 1e11 records, so a hot range's records needn't be brought together.
    held = F.broadcast(materialize(held, "shard-ranges"))
    by_key = (F.col("key").cast("double") - F.col("low").cast("double")) / (
        F.col("high").cast("double") - F.col("low").cast("double")
    )
    share = F.when(F.col("high") > F.col("low"), by_key).otherwise(unit(F.col("row"), 2))
    divided = placed.join(held, "range").withColumn(
        "piece", F.least(F.floor(F.col("pieces") * F.when(F.col("pieces") > 1, share).otherwise(0.0)), F.col("pieces") - 1)
    )
    totals = divided.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    totals = materialize(totals, "shard-pieces")
    in_order = W.orderBy("range", "piece").rowsBetween(W.unboundedPreceding, 0)  # a few rows for each range
    middle = F.sum("bytes").over(in_order) - F.col("bytes") / 2
    dealt = totals.withColumn("shard", F.least(F.floor(middle * n_shards / float(max(total, 1))), F.lit(n_shards - 1)).cast("int"))
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("range", "piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")
    dealt = dealt.select("range", "piece", "shard", before.alias("before"))
    within = W.partitionBy("range", "piece").orderBy("key", "doc_id", "size", "row")
    return divided.join(dealt, ["range", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.row_number().over(within) - 1 + F.col("before")).cast("long").alias("slot")
    )


@query("op2_sharding")
def sharding_query(spark: SparkSession, folder: str) -> DataFrame:
    return shards(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
