"""Near-duplicate groups by SuperMinHash.

A text's shingles each permute the signature's slots by themselves; the step at which a slot is reached and a random
fraction make the slot's value, and the smallest value stays. Because steps are ordered, all
elements are taken a step at a time, and a text is finished as soon as no slot is empty: long texts need two or three
steps. Bands of slots propose pairs, full sets confirm them, and union-find makes groups.

Sets that are equal are one class from the start. In a band's bucket every class is compared with one pivot, the class
with the most neighbours, never with all others. Classes that share a pivot but weren't
joined are compared by what sets them apart from it: two sets of the wanted likeness must share most of their
differences from any third one, so only classes that share one of their rarest differences are
compared. No pair above the likeness that meets in any bucket is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.arrays import ODD, Words, mix, shingles
from tidewatch.llm.base import map_texts, query, table
from tidewatch.llm.components import components
from tidewatch.session import materialize

SHINGLE, PERCENT = 5, 80
#: A pair of the wanted likeness may fail to meet in any bucket with this probability at most.
MISS = 1e-7
MAX_SLOTS = 256
#: Elements whose permutations a task holds at a time.
ELEMENTS = 1 << 16
EMPTY = np.iinfo(np.int64).max
#: Classes by size of difference are this share of the pivot's size wide.
STEP = 1 / 32


def layout(percent: int, miss: float = MISS, most: int = MAX_SLOTS) -> tuple[int, int]:
    """Slots of a band and number of bands: the longest bands that meet ``miss`` within ``most`` slots."""
    likeness = min(percent / 100, 1 - 1e-9)
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(likeness**rows)))
        if rows * bands <= most:
            return rows, bands
    raise ValueError(f"{most} slots are too few for a likeness of {percent} percent to be missed with a probability of {miss} at most")


def signatures(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash values of each set, a row each; a value is its step times 2**32 plus a random part. Empty sets stay ``EMPTY``."""
    out = np.full((len(bounds) - 1, slots), EMPTY, np.int64)
    start = 0
    while start < len(out):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + ELEMENTS, side="right")) - 1)
        owner = np.repeat(np.arange(stop - start), np.diff(bounds[start : stop + 1]))
        # One long text is taken a part at a time; a later part ends as soon as its step can't lower any slot.
        for at in range(0, len(owner), ELEMENTS):
            _fill(elements[bounds[start] + at : min(bounds[start] + at + ELEMENTS, bounds[stop])], owner[at : at + ELEMENTS], out[start:stop])
        start = stop
    return out


def _fill(elements: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    slots = values.shape[1]
    order = np.tile(np.arange(slots, dtype=np.uint8), len(elements))
    base = np.arange(len(elements)) * slots
    flat = values.reshape(-1)
    for step in range(slots):
        with np.errstate(over="ignore"):
            drawn = mix(elements + np.uint64(step + 1) * ODD)
        at = base + step + ((drawn >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        slot = order[at]
        order[at] = order[base + step]
        np.minimum.at(flat, owner * slots + slot, (drawn & np.uint64(0xFFFFFFFF)).astype(np.int64) + (step << 32))
        # A slot that holds a value of this step or an earlier one can't get a smaller one later.
        going = (values.max(axis=1) >> 32 > step)[owner]
        if not going.any():
            return
        if not going.all():
            elements, owner, base = elements[going], owner[going], base[going]


def band_keys(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * ODD, (len(values), bands))
        for k in range(rows):
            key = mix(key ^ values[:, k : rows * bands : rows].astype(np.uint64))
    return key.view(np.int64)


def prints(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, high, low, n, keys``: a 128-bit hash of the shingle set, its size and its band keys."""
    rows, bands = layout(percent)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1))
            items, bounds = shingles(words.hashes(), words.first, size)
            keys = band_keys(signatures(items, bounds, rows * bands), rows, bands)
            halves = []
            with np.errstate(over="ignore"):
                for salt in (ODD, ~ODD):
                    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(items ^ salt), dtype=np.uint64)))
                    halves.append((upto[bounds[1:]] - upto[bounds[:-1]]).view(np.int64))
            width = np.arange(len(keys) + 1, dtype=np.int32) * bands
            lists = pa.ListArray.from_arrays(pa.array(width), pa.array(keys.reshape(-1)))
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, halves), pa.array(np.diff(bounds)), lists], ["doc_id", "high", "low", "n", "keys"])

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(texts, make, "doc_id long, high long, low long, n long, keys array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, items, n``: the whole shingle sets of the documents in ``nodes``."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1))
            items, bounds = shingles(words.hashes(), words.first, size)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(items.view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(bounds))], ["node", "items", "n"])

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return map_texts(texts.join(nodes, "node", "left_semi").select("node", "text"), make, "node long, items array<long>, n long")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with both sets: ``a, b, one, two, n_one, n_two``."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("one"), F.col("n").alias("n_one"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("two"), F.col("n").alias("n_two"))
    return pairs.join(one, "a").join(two, "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = F.size(F.array_intersect("one", "two"))
    near = (F.least("n_one", "n_two") * 100 >= F.greatest("n_one", "n_two") * percent) & (
        both * 100 >= (F.col("n_one") + F.col("n_two") - both) * percent
    )
    return compared(pairs, sets).where(near).select("a", "b")


def by_differences(pairs: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs still to compare among the classes compared with one pivot (``b`` of ``pairs``).

    For sets x, y and a pivot p, the difference of x and y is that of their differences from p. Where it is to
    be at most ``share`` of both sizes, the differences of x and y from p have ``(dx + dy - share * (nx + ny)) / 2``
    elements in common or more, and one at least if x or y isn't like p. So the
    two meet in one of the rarest so many elements of each.
    """
    share = (100 - percent) / (100 + percent)
    named = pairs.join(groups.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    open_pivots = materialize(
        named.groupBy("b").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("b"), "open-pivots"
    )
    left = compared(named.join(open_pivots, "b"), sets).select(
        F.col("b").alias("p"),
        F.col("a").alias("x"),
        "component",
        F.col("n_one").alias("n"),
        F.col("n_two").alias("np"),
        F.concat(F.array_except("one", "two"), F.array_except("two", "one")).alias("apart"),
    )
    items = materialize(left.withColumn("d", F.size("apart")).withColumn("e", F.explode("apart")).drop("apart"), "differences")
    often = materialize(items.groupBy("p", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "difference-counts")
    shared = items.join(often, ["p", "e"])
    each = W.partitionBy("p", "x")
    # Elements of no other class come first in the order of rarity; they take ranks, but meet nothing.
    ranked = shared.withColumn("rank", F.col("d") - F.count(F.lit(1)).over(each) + F.row_number().over(each.orderBy("f", "e")))
    width = F.greatest(F.lit(1.0), F.col("np") * STEP)
    reach = F.col("n") * (1 + 100 / percent) * share
    kinds = (
        ranked.withColumn("width", width)
        .withColumn("reach", reach)
        .withColumn("kind", F.floor(F.col("d") / F.col("width")))
        .withColumn(
            "other", F.explode(F.sequence(F.floor(F.greatest(F.lit(0.0), F.col("d") - F.col("reach")) / F.col("width")), F.floor((F.col("d") + F.col("reach")) / F.col("width"))))
        )
        .withColumn("common", F.greatest(F.lit(1), F.ceil((F.col("d") + F.col("other") * F.col("width") - F.col("reach")) / 2 - 1e-9)))
        .where("rank <= d - common + 1")
        .select("p", "e", "kind", "other", "x", "n", "component")
    )
    kinds = materialize(kinds, "rare-differences")
    again = kinds.select("p", "e", F.col("kind").alias("other"), F.col("other").alias("kind"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("component").alias("apart"))
    return (
        kinds.join(again, ["p", "e", "kind", "other"])
        .where((F.col("x") < F.col("y")) & (F.col("component") != F.col("apart")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent))
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Texts whose sets of ``shingle``-word shingles have a likeness of ``percent`` or more are linked, and
    ``component_id`` is the smallest id reachable. A text with fewer words has its whole sequence as its only shingle;
    one without words, or a null one, has an empty set and is linked with nothing. Rows that share an id
    are one document: a link of one is a link of all. A row with a null id belongs to the component of the
    texts its set equals; if none of them has an id, its component is null and it is kept. An empty
    table gives no rows. Other columns aren't read.
    """
    found = materialize(prints(docs, shingle, percent), "near-prints")
    classes = materialize(
        found.where("n > 0").groupBy("high", "low", "n").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "near-classes"
    )
    bands = classes.where("node is not null").select("node", F.explode("keys").alias("key"))
    crowds = materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "near-crowds")
    met = materialize(bands.join(crowds, "key"), "near-met")
    weight = materialize(met.groupBy("node").agg(F.sum("crowd").alias("weight")), "near-weights")
    pivots = materialize(
        met.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", F.negative("node").alias("node"))).alias("pivot")).select("key", F.negative("pivot.node").alias("b")),
        "near-pivots",
    )
    pairs = materialize(met.join(pivots, "key").where("node != b").select(F.col("node").alias("a"), "b").distinct(), "near-pairs")
    sets = materialize(sets_of(docs, materialize(weight.select("node"), "near-nodes"), shingle), "near-sets")
    # An id whose rows have several sets is one document: what its rows are in is linked through it.
    kind = F.struct("high", "low", "n")
    several = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(kind).alias("one"), F.max(kind).alias("two")).where("one != two").select("doc_id")
    several = materialize(several, "near-several")
    held = materialize(found.join(several, "doc_id").join(classes.drop("keys"), ["high", "low", "n"]).select("doc_id", "node"), "near-held")
    least = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    tied = held.join(least, "doc_id").select(F.col("node").alias("a"), "b").where("a != b").distinct()
    links = materialize(confirmed(pairs, sets, percent).unionByName(tied), "near-links")
    groups = materialize(components(links), "near-groups")
    more = materialize(confirmed(materialize(by_differences(pairs, groups, sets, percent), "near-more-pairs"), sets, percent), "near-more")
    if more.head(1):
        groups = materialize(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "near-groups")
    named = classes.select("high", "low", "n", "node").join(groups, "node", "left").select("high", "low", "n", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "near-components")
    rows = found.select("doc_id", "high", "low", "n").join(named, ["high", "low", "n"], "left")
    # A row without words is in its id's component, if the id has other rows.
    whole = least.join(groups, F.col("b") == F.col("node"), "left").select("doc_id", F.coalesce("component", "b").alias("whole"))
    rows = rows.join(materialize(whole, "near-whole"), "doc_id", "left")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.coalesce("whole", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


@query("op7_near_dedup")
def near_duplicates_query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)
