"""Best-fit packing into sequences of several permitted lengths.

Items are dealt by hash to groups of bounded total size, and each group is packed by one task:
largest first, each item into the fullest open bin that holds it. If none does, a bin is opened
whose length costs least for each token it is expected to hold, given what is still to be
packed. At the end each bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.base import n_words, query, table

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence of length n: n + ATTENTION * n * n + START.
ATTENTION = 1 / 65536
START = 16.0
#: Total size of a group, at about which one task packs.
GROUP_SIZE = 1 << 20


def cost(length: int, attention: float = ATTENTION, start: float = START) -> float:
    return length + attention * length * length + start


def pack(sizes: np.ndarray, lengths: tuple[int, ...], price=cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset in the bin, and each bin's final length. No item is larger than the last length."""
    order = np.argsort(-sizes, kind="stable")
    left = int(sizes.sum())
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), by room
    for i in order:
        size = int(sizes[i])
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            # What a bin will hold: all of it while enough is left, else what is left.
            room = min((n for n in lengths if n >= size), key=lambda n: (price(n) / max(1, min(n, left)), n))
            b = len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        left -= size
        if room > size:
            insort(open_bins, (room - size, b))
    held = np.asarray(used, np.int64)
    final = np.asarray(lengths, np.int64)[np.searchsorted(lengths, held)] if len(held) else held
    return bin_of, offset, final


def packed(
    docs: DataFrame,
    size: Column,
    lengths: tuple[int, ...] = LENGTHS,
    attention: float = ATTENTION,
    start: float = START,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """``doc_id, size, part, part_start, part_size, bin, length, offset``: where each part of each document lies.

    A document larger than the longest length is cut into parts of that length and a rest; every
    other one is one part. A bin is named by its group and a number. A document without size
    (null or empty text) is one part of size 0 and takes no room, but has a bin. A null id is an id
    like any other; repeated rows are separate items; an empty table gives no rows. Only the id and
    what ``size`` names are read.
    """
    lengths = tuple(sorted(set(lengths)))
    longest = lengths[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    # A row counts as one at least, so that rows without size are spread as well.
    total = sized.agg(F.sum(F.greatest("size", F.lit(1)))).first()[0] or 0
    groups = max(1, total // group_size)
    # Parts of one document are dealt apart, and so are repeated rows, by where they stand in their task.
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size - 1) div {longest}"))))).select(
        F.pmod(F.xxhash64("doc_id", "part", F.monotonically_increasing_id()), F.lit(groups)).alias("group"),
        "doc_id",
        "size",
        F.col("part").cast("int").alias("part"),
        (F.col("part") * longest).cast("long").alias("part_start"),
        F.least(F.lit(longest), F.col("size") - F.col("part") * longest).cast("long").alias("part_size"),
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part_size", "doc_id", "part"], ascending=[False, True, True], ignore_index=True)
        bin_of, offset, final = pack(pdf["part_size"].to_numpy(), lengths, lambda n: cost(n, attention, start))
        pdf["bin"] = pdf["group"].astype(str) + "-" + pd.Series(bin_of, dtype="int64").astype(str)
        pdf["length"], pdf["offset"] = final[bin_of], offset
        return pdf.drop(columns="group")

    return parts.groupBy("group").applyInPandas(
        one, "doc_id long, size long, part int, part_start long, part_size long, bin string, length long, offset long"
    )


@query("op10_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), n_words(F.col("text")))
