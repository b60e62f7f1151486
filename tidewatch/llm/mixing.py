"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the schedule is the point ``frac(i / golden ratio)``, kept exact as a 31-bit
integer. The sources' shares cut the unit interval; the cut a point falls in names the slot's
source, and the slot's rank among that source's slots names the block it takes. A source's
documents, shuffled by a digest, form one stream of words that is repeated up to three times
and cut into blocks of equal words. So every stretch of the schedule holds each source in its
share, to within a few blocks.

Running sums and ranks are formed in pieces of about half the square root of the row count
and joined by a table of piece totals, so a source with most of the rows is spread over many
tasks. Only tables with a row per source pass through one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.base import n_words, query, table
from tidewatch.session import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
MAX_BLOCK = 2048
#: Slots a source has on average at least, if it has the words.
SLOTS_PER_SOURCE = 1024
#: Fixed value: 2**31 divided by the golden ratio, made odd, so multiples visit all 2**31 points.
GOLDEN = 1327217885
POINTS = 1 << 31
CELL_BITS = 20
CHUNK = 1 << 12


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Targets of sources: ``source, source_size, n_rows, sid, target, lo, hi``.

    Sources in code-point order, null last, carry ``weights`` in turn and share the total size;
    no target exceeds ``repeats`` times its source's size, and what is above is shared again by
    weight. ``lo`` and ``hi`` bound the source's part of the 31-bit unit interval.
    """
    scale = math.lcm(*weights)
    everything = W.partitionBy()
    by_level = W.orderBy("level").rangeBetween(W.unboundedPreceding, 0)
    named = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("level", F.expr(f"cap * ({scale} div weight)"))
        .withColumn("total", F.sum("source_size").over(everything))
    )
    # A source is filled to its cap if raising all sources to its level takes no more than there is.
    filled = named.withColumn(
        "capped",
        F.sum("cap").over(by_level) * scale
        + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(by_level))
        <= F.col("total") * scale,
    )
    rest = F.when(~F.col("capped"), F.col("weight"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).cast(
        "double"
    ) / F.sum(rest).over(everything)
    aimed = filled.withColumn(
        "target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    ).withColumn("aim", F.floor("target"))
    upto = F.coalesce(F.sum("aim").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    all_aims = F.sum("aim").over(everything)

    def point(words: Column) -> Column:
        return F.coalesce(F.floor(F.try_divide(words.cast("double") * float(POINTS), all_aims)), F.lit(0))

    return aimed.select(
        "source", "source_size", "n_rows", "sid", "target", point(upto - F.col("aim")).alias("lo"), point(upto).alias("hi")
    )


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """Slots of the mixture: ``slot, sid, rank``; rank counts the source's slots from 0."""
    spark = sources.sparkSession
    cells = sources.where("hi > lo").select(
        "sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell")
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") % POINTS * GOLDEN % POINTS).alias("point"), F.expr(f"id div {CHUNK}").alias("chunk")
    )
    placed = (
        points.withColumn("cell", F.shiftright("point", CELL_BITS))
        .join(cells, "cell")
        .where("point >= lo and point < hi")
        .select("slot", "sid", "chunk")
    )
    counts = placed.groupBy("sid", "chunk").count()
    earlier = counts.select(
        "sid",
        "chunk",
        (F.sum("count").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("earlier"),
    )
    return placed.join(earlier, ["sid", "chunk"]).select(
        "slot",
        "sid",
        (F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1 + F.col("earlier")).alias("rank"),
    )


def stream_order(keep: tuple[str, ...]) -> list[str]:
    """The order of a source's stream; columns that tell rows apart take the place of the size."""
    return ["digest", "doc_id", *(keep or ["size"])]


def streams(sizes: DataFrame, sources: DataFrame, rows: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents in their source's shuffled stream: adds ``sid, piece, place, start`` and the source's columns.

    ``start`` is the number of words before the document; ``(sid, piece, place)`` tells rows apart.
    """
    per_piece = max(64, math.isqrt(rows) // 2)
    # A row without an id is shuffled by its place in the stored table.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(" "), F.col("mix_row").cast("string")))
    digest = F.md5(name.cast("binary"))
    keyed = (
        sizes.withColumn("digest", digest)
        .join(sources.withColumnRenamed("source", "from"), F.col("source").eqNullSafe(F.col("from")))
        .drop("from")
        .withColumn("head", F.conv(F.substring("digest", 1, 7), 16, 10).cast("long"))
        .withColumn("piece", F.expr(f"(head * (1 + n_rows div {per_piece})) div {1 << 28}"))
    )
    totals = keyed.groupBy("sid", "piece").agg(F.sum("size").alias("words"))
    before = totals.select(
        "sid",
        "piece",
        (F.sum("words").over(W.partitionBy("sid").orderBy("piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("before"),
    )
    within = W.partitionBy("sid", "piece").orderBy(*stream_order(keep))
    return keyed.join(before, ["sid", "piece"]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "sid",
        "piece",
        "digest",
        *keep,
        F.row_number().over(within).alias("place"),
        (F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + F.col("before")).alias("start"),
    )


def prepared(docs: DataFrame, size: Column, weights: tuple[int, ...], repeats: int, keep: tuple[str, ...]):
    """The streams, the sources with the blocks their slots take, the schedule, and the words of a block."""
    columns = [F.col("doc_id"), F.col("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *map(F.col, keep)]
    sizes = materialize(docs.select(*columns).withColumn("mix_row", F.monotonically_increasing_id()), "mix-sizes")
    sources = materialize(shares(sizes, weights, repeats), "mix-sources")
    total, rows, n = sources.agg(F.sum("source_size"), F.sum("n_rows"), F.count(F.lit(1))).first()
    total, rows = total or 0, rows or 0
    block = max(1, min(MAX_BLOCK, total // max(1, n * SLOTS_PER_SOURCE)))
    slots = materialize(schedule(sources, total // block), "mix-schedule")
    filled = materialize(slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n_blocks")), "mix-blocks")
    return streams(sizes, sources, rows, keep), sources, filled, slots, block


def passes(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``source, passes, last``: how often the mix takes a source's whole stream, and the last row of which it takes half or more once again.

    ``last`` holds that row's columns of ``stream_order`` (null if there is none), so whoever has a row knows by itself how often
    the mix takes it. ``keep`` must tell rows apart. Nulls and empty tables as in ``mixture``; rows without words are never taken.
    """
    placed, sources, filled, _, block = prepared(docs, size, weights, repeats, keep)
    words = F.least(F.coalesce(F.col("n_blocks"), F.lit(0)) * block, F.col("source_size") * repeats)
    each = sources.join(filled, "sid", "left").select(
        "sid",
        "source",
        words.alias("words"),
        "source_size",
    )
    # A source without words has nothing to pass through.
    each = each.select(
        "sid", "source", F.expr("if(source_size = 0, 0, words div greatest(source_size, 1))").alias("passes"), F.expr("words % greatest(source_size, 1)").alias("rest")
    )
    each = materialize(each, "mix-takes")
    order = F.struct(*stream_order(keep))
    half = placed.join(each.select("sid", "rest"), "sid").where((F.col("size") > 0) & (2 * (F.col("rest") - F.col("start")) >= F.col("size")))
    lasts = half.groupBy("sid").agg(F.max(order).alias("last"))
    return materialize(each.join(lasts, "sid", "left").select("source", "passes", "last"), "mix-passes")


def mixture(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, keep: tuple[str, ...] = ()):
    """The mix as segments, one row for each part of a document that a slot takes.

    ``doc_id, source, size, source_size, target, sid, piece, place, slot, offset, words`` and the
    columns named in ``keep``; ``offset`` and ``words`` say which words of the document the slot takes.
    A document that no slot takes has one row with null slot and 0 words. A null source is a
    source of its own (the last), a null size counts as 0, rows without an id are shuffled by their place in the
    stored table; repeated rows are separate rows of the stream, very long texts are cut into as many parts as it takes; an
    empty table gives an empty mix. Columns of ``docs`` other than the id, the source and those in ``keep`` aren't read.
    """
    placed, _, filled, slots, block = prepared(docs, size, weights, repeats, keep)
    first = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    parts = (
        placed.join(filled, "sid", "left")
        .withColumn("pass", first)
        .withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("from", F.expr(f"at div {block}"))
        .withColumn("to", F.least(F.expr(f"(at + size - 1) div {block}"), F.coalesce("n_blocks", F.lit(0)) - 1))
        .withColumn("rank", F.explode_outer(F.when((F.col("size") > 0) & (F.col("from") <= F.col("to")), F.sequence("from", "to"))))
        .where("rank is not null or pass = 0")
    )
    low, high = F.greatest("at", F.col("rank") * block), F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block)
    return parts.join(slots, ["sid", "rank"], "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "sid",
        "piece",
        "place",
        *keep,
        "slot",
        (low - F.col("at")).alias("offset"),
        F.when(F.col("slot").isNotNull(), high - low).otherwise(0).alias("words"),
    )


def taken(segments: DataFrame, *keep: str) -> DataFrame:
    """Words the mix takes of each document, repeats counted."""
    rows = ["sid", "piece", "place", "doc_id", "source", "size", "source_size", "target", *keep]
    return segments.groupBy(*rows).agg(F.sum("words").alias("taken")).drop("sid", "piece", "place")


ORACLE = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), named AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) AS sid
    FROM sized GROUP BY source
), levels AS (
    SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight, 3 * source_size AS cap,
           3 * source_size * (10 // [5, 2, 1][(sid - 1) % 3 + 1]) AS level, CAST(sum(source_size) OVER () AS BIGINT) AS total
    FROM named
), filled AS (
    SELECT a.source, a.sid, a.source_size, a.weight, a.cap, a.total,
           sum(least(b.cap * 10, a.level * b.weight)) <= any_value(a.total) * 10 AS capped
    FROM levels a CROSS JOIN levels b GROUP BY a.source, a.sid, a.source_size, a.weight, a.cap, a.total
), rest AS (
    SELECT CAST(any_value(total) - COALESCE(sum(cap) FILTER (capped), 0) AS DOUBLE)
           / CAST(sum(weight) FILTER (NOT capped) AS DOUBLE) AS share, any_value(total) AS total, count(*) AS n
    FROM filled
), aimed AS (
    SELECT source, sid, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target,
           greatest(1, least({MAX_BLOCK}, rest.total // (n * {SLOTS_PER_SOURCE}))) AS block, rest.total
    FROM filled CROSS JOIN rest
), cuts AS (
    SELECT a.sid, any_value(a.block) AS block, any_value(a.total) AS total,
           floor(CAST(COALESCE(sum(floor(b.target)) FILTER (b.sid < a.sid), 0) AS DOUBLE) * {POINTS}.0 / sum(floor(b.target))) AS lo,
           floor(CAST(sum(floor(b.target)) FILTER (b.sid <= a.sid) AS DOUBLE) * {POINTS}.0 / sum(floor(b.target))) AS hi
    FROM aimed a CROSS JOIN aimed b GROUP BY a.sid
), points AS (
    SELECT i, (i % {POINTS}) * {GOLDEN} % {POINTS} AS point
    FROM (SELECT unnest(range(CAST(any_value(total // block) AS BIGINT))) AS i FROM cuts)
), filled_blocks AS (
    SELECT sid, count(*) * any_value(block) AS words FROM points JOIN cuts ON point >= lo AND point < hi GROUP BY sid
), placed AS (
    SELECT doc_id, s.source, size, source_size, target, sid,
           CAST(sum(size) OVER (PARTITION BY sid ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
    FROM sized s JOIN aimed ON s.source IS NOT DISTINCT FROM aimed.source
)
SELECT doc_id, size, source_size, target,
       CAST((SELECT sum(greatest(0, least(start + e * source_size + size, COALESCE(words, 0)) - (start + e * source_size)))
        FROM range(3) r(e)) AS BIGINT) AS taken
FROM placed LEFT JOIN filled_blocks USING (sid)
"""


@query("op1_mixing", ORACLE)
def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return taken(mixture(docs, n_words(F.col("text")))).select("doc_id", "size", "source_size", "target", "taken")
