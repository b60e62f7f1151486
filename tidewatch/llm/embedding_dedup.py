"""Near duplicates among vectors by Euclidean p-stable hashing.

Normalised vectors are projected on random directions, and each projection is cut into intervals; a few intervals together
are a bucket of one table, and tables are as many as keep the chance that a pair at the wanted cosine meets nowhere below
``miss``. The number of projections grows with the logarithm of the number of vectors, so a vector meets
few unlike ones. What meets is compared exactly, in double precision.

Hot groups aren't compared pair by pair. Equal vectors are one class. Classes that share a crowded bucket are drawn into balls:
whatever lies within half the wanted angle of a ball's centre is linked with all of the ball, by the
triangle inequality, and is counted without a comparison. Balls whose centres meet are merged into the largest. Only what
meets across balls is compared, in packs of members with nearly equal distance from their centre, and again only
where the distances don't decide. A bucket that holds many balls or single classes is hashed again, by more tables with more
projections.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.arrays import ODD, mix
from tidewatch.llm.base import by_length, query, table
from tidewatch.llm.components import components
from tidewatch.session import materialize

COSINE = 0.95
#: Chance that a pair of exactly the wanted cosine meets in no table.
MISS = 1e-3
#: Intervals are so many times as wide as the distance of such a pair.
WIDTH = 4.0
#: Unrelated vectors a vector may expect to meet in one table.
MATES = 1 / 32
#: Members of a pack; units of a bucket beyond which it is hashed again, so often at most, with so many projections.
PACK, CROWD, AGAIN, MORE = 256, 512, 3, 8
#: Classes that make a bucket worth a ball.
BALL = 8
SEED = 20_111
#: Sums of unit vectors are exact whole numbers of this fraction.
UNIT = 1 << 32
SLACK = 1e-9


def meets(distance: float, width: float) -> float:
    """Chance that two points at a distance share an interval of one projection on a normal direction."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * -math.expm1(-r * r / 2)


def layout(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, float]:
    """Projections of a table, number of tables, and width of an interval, for ``n`` vectors."""
    near = math.sqrt(2 - 2 * min(cosine, 1 - 1e-6))
    width = WIDTH * near
    apart = meets(math.sqrt(2), width)
    projections = max(1, math.ceil(math.log(max(1, n) / MATES) / -math.log(apart)))
    return projections, tables(projections, width, near, miss), width


def tables(projections: int, width: float, near: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(meets(near, width) ** projections)))


def buckets(units: np.ndarray, projections: int, n_tables: int, width: float, round_: int) -> np.ndarray:
    """Bucket keys of unit vectors (a row each), one of each table."""
    dim = units.shape[1]
    rng = np.random.default_rng([SEED, dim, round_])
    out = np.empty((len(units), n_tables), np.int64)
    # One table at a time, so that memory doesn't follow their number.
    for t in range(n_tables):
        cells = np.floor((units @ rng.standard_normal((dim, projections)) + rng.uniform(0, width, projections)) / width).astype(np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.full(len(units), np.uint64(t + 1) * ODD + np.uint64(dim))
            for k in range(projections):
                key = mix(key ^ cells[:, k]) + np.uint64(k)
        out[:, t] = key.view(np.int64)
    return out


def vectors(binaries: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    found = binaries.to_pylist()
    return np.frombuffer(b"".join(found), np.float64).reshape(len(found), -1)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = np.diff(np.asarray(batch.column("values").offsets))
        for width in np.unique(widths):
            part = batch.take(pa.array(np.flatnonzero(widths == width)))
            values = np.asarray(part.column("values").flatten(), np.float64).reshape(-1, width)
            values = values / np.abs(values).max(axis=1, keepdims=True)
            values /= np.sqrt((values * values).sum(axis=1, keepdims=True))
            kept = [c for c in part.schema.names if c != "values"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([v.tobytes() for v in values], pa.binary())], [*kept, "vector"])


def _hashed(projections: int, n_tables: int, width: float, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "vector"):
                for at in range(0, part.num_rows, 1024):
                    few = part.slice(at, 1024)
                    keys = buckets(vectors(few.column("vector")), projections, n_tables, width, round_)
                    ends = np.arange(len(keys) + 1, dtype=np.int32) * n_tables
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([few.column("node"), lists], ["node", "keys"])

    return run


def hashed(rows: DataFrame, projections: int, n_tables: int, width: float, round_: int = 0) -> DataFrame:
    """``node, keys`` of rows ``node, vector``."""
    return rows.select("node", "vector").mapInArrow(_hashed(projections, n_tables, width, round_), "node long, keys array<long>")


def _sums(finish: bool):
    """Sum vectors by key: whole numbers, so the order of rows and tasks doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def given() -> pa.RecordBatch:
            sums = [s.tobytes() for s, _ in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(sums, pa.binary()), pa.array([n for _, n in held.values()], pa.int64())], ["key", "sums", "n"])

        for batch in batches:
            for key, value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole = np.frombuffer(value, np.int64) if finish else np.rint(np.frombuffer(value) * UNIT).astype(np.int64)
                if key not in held and len(held) >= 1024:
                    # Sorted rows are done with all earlier keys; unsorted ones are summed again later.
                    yield given()
                    held = {}
                old, many = held.get(key, (0, 0))
                held[key] = (old + whole, many + n)
        if held:
            yield given()

    return run


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [np.frombuffer(s, np.int64).astype(np.float64) for s in batch.column("sums").to_pylist()]
        norms = [math.sqrt(s @ s) for s in sums]
        out = [(s / n).tobytes() if n else None for s, n in zip(sums, norms, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary()), batch.column("n")], ["ball", "centre", "n"])


def centres(members: DataFrame) -> DataFrame:
    """``ball, centre, n``: the mean direction of the vectors of each ball (``ball, vector``)."""
    schema = "key long, sums binary, n long"
    parts = members.select("ball", "vector", F.lit(1).cast("long").alias("n")).mapInArrow(_sums(False), schema)
    whole = parts.repartition("key").sortWithinPartitions("key").mapInArrow(_sums(True), schema)
    return whole.mapInArrow(_centres, "ball long, centre binary, n long").where("centre is not null")


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``angle`` between ``vector`` and ``centre`` in their place."""
    for batch in batches:
        out = [_angle(v, c) for v, c in zip(batch.column("vector").to_pylist(), batch.column("centre").to_pylist(), strict=True)]
        kept = [c for c in batch.schema.names if c not in ("vector", "centre")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], [*kept, "angle"])


def inside(members: DataFrame, balls: DataFrame, angle: float) -> DataFrame:
    """``node, ball, angle`` of members (``node, ball, vector``) within half the angle of their ball's centre."""
    met = members.join(balls.select("ball", "centre"), "ball").select("node", "ball", "vector", "centre")
    return met.mapInArrow(_angles, "node long, ball long, angle double").where(F.col("angle") <= angle / 2 - SLACK)


def balls(met: DataFrame, classes: DataFrame, angle: float, shape: tuple[int, int, float]) -> tuple[DataFrame, DataFrame]:
    """Members of balls ``node, ball, angle`` and the balls ``ball, centre, n``.

    A class goes for its most crowded bucket, and stays if it lies near the centre of all that went there. Then
    each ball's members try the largest ball whose centre meets theirs.
    """
    crowded = met.where(F.col("crowd") >= BALL)
    choice = crowded.groupBy("node").agg(F.max(F.struct("crowd", F.col("key").alias("ball"))).alias("best")).select("node", F.col("best.ball").alias("ball"))
    members = materialize(choice.join(classes.select("node", "vector"), "node"), "ball-members")
    first = materialize(centres(members).where(F.col("n") >= BALL), "ball-centres")
    within = materialize(inside(members, first, angle), "ball-within")
    counted = materialize(first.drop("n").join(within.groupBy("ball").agg(F.count(F.lit(1)).alias("n")), "ball"), "ball-counts")
    keys = hashed(counted.select(F.col("ball").alias("node"), F.col("centre").alias("vector")), *shape)
    keyed = materialize(keys.select(F.col("node").alias("ball"), F.explode("keys").alias("key")).join(counted.select("ball", "n"), "ball"), "ball-keys")
    pivots = keyed.groupBy("key").agg(F.max(F.struct("n", "ball")).alias("pivot"))
    into = keyed.join(pivots, "key").groupBy("ball").agg(F.max("pivot").alias("into")).select("ball", F.col("into.ball").alias("into"))
    moved = members.join(into.where("ball != into"), "ball").select("node", F.col("into").alias("ball"), "vector")
    moved = materialize(inside(moved, counted, angle), "ball-moved")
    stays = within.join(moved.select("node"), "node", "left_anti")
    placed = materialize(stays.unionByName(moved), "ball-placed")
    some = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(counted.drop("n").join(some, "ball"), "ball-held")
    return placed.join(held.select("ball"), "ball"), held


def meetings(met: DataFrame, units: DataFrame, classes: DataFrame, shape: tuple[int, int, float], near: float, miss: float) -> DataFrame:
    """Distinct pairs ``a, b`` of units with members in one bucket.

    A bucket of more than ``CROWD`` units is divided by tables of its own, which together keep the chance of a miss.
    """
    rows = materialize(met.select("key", "node").join(units.select("node", "unit"), "node"), "unit-rows")
    found = None
    for again in range(AGAIN + 1):
        each = materialize(rows.select("key", "unit").distinct(), "unit-keys")
        counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("units")).where("units > 1")
        counts = materialize(counts, "unit-counts")
        small = counts if again == AGAIN else counts.where(F.col("units") <= CROWD)
        there = each.join(small.select("key"), "key")
        pairs = there.select("key", F.col("unit").alias("a")).join(there.select("key", F.col("unit").alias("b")), "key").where("a < b").select("a", "b").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        large = counts.where(F.col("units") > CROWD).select("key")
        if again == AGAIN or not large.head(1):
            break
        found = materialize(found, "unit-pairs")
        rows = materialize(rows.join(large, "key"), "unit-crowds")
        n_tables = tables(MORE, shape[2], near, miss)
        there = rows.select("node").distinct().join(classes.select("node", "vector"), "node")
        keys = hashed(there, MORE, n_tables, shape[2], again + 1)
        # More tables of another round belong to the bucket they divide.
        rows = rows.join(keys, "node").select(F.explode("keys").alias("more"), "key", "node", "unit").select(F.xxhash64("key", "more").alias("key"), "node", "unit")
        rows = materialize(rows, "unit-rows")
    return materialize(found.distinct(), "unit-meetings")


def _against(cosine: float, angle: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of units that are linked whole, or open. Two single classes are compared exactly."""
        for batch in batches:
            ones, twos = (batch.column(c).to_pylist() for c in ("one", "two"))
            dots = np.array([np.frombuffer(x) @ np.frombuffer(y) if len(x) == len(y) else -2.0 for x, y in zip(ones, twos, strict=True)])
            spread = np.asarray(batch.column("spread"))
            apart = np.array([_angle(x, y) if s >= 0 and len(x) == len(y) else math.pi for x, y, s in zip(ones, twos, spread, strict=True)])
            whole = np.where(spread < 0, dots >= cosine, apart + spread <= angle - SLACK)
            keep = whole | ((spread >= 0) & (apart - spread <= angle + SLACK))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart), pa.array(whole)], ["a", "b", "apart", "whole"])
            yield out.filter(pa.array(keep))

    return run


def _angle(x: bytes, y: bytes) -> float:
    """The angle of two unit vectors by their distance, which is exact for small angles too."""
    apart = np.frombuffer(x) - np.frombuffer(y)
    return 2 * math.asin(min(1.0, math.sqrt(apart @ apart) / 2))


def packs(units: DataFrame) -> DataFrame:
    """Members of units in steps of their angle, ``PACK`` at most to a row: ``unit, pack, lo, hi, weight, members``.

    A ball has as many steps as half packs; a step that holds more members than a pack is divided.
    """
    steps = F.greatest(F.lit(1), F.expr(f"n div {PACK // 2}"))
    at = F.coalesce(F.floor(F.try_divide(F.col("angle"), F.col("widest")) * steps), F.lit(0))
    rows = units.withColumn("step", F.least(steps - 1, at).cast("long"))
    within = W.partitionBy("unit", "step").orderBy("node")
    rows = rows.withColumn("part", F.floor((F.row_number().over(within) - 1) / PACK))
    return rows.groupBy("unit", "step", "part").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("copies").alias("weight"), F.collect_list(F.struct("node", "copies", "vector")).alias("members")
    ).select("unit", F.xxhash64("unit", "step", "part").alias("pack"), "lo", "hi", "weight", "members")


def _compared(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For members of two packs: how much weight of the other pack each is linked with."""
        for batch in batches:
            for a, b, ones, twos in zip(*(batch.column(c) for c in ("a", "b", "ones", "twos")), strict=True):
                ones, twos = ones.as_py(), twos.as_py()
                x, y = (np.frombuffer(b"".join(m["vector"] for m in side)).reshape(len(side), -1) for side in (ones, twos))
                near = x @ y.T >= cosine
                if not near.any():
                    continue
                out: list = []
                for side, other, hits in ((ones, twos, near), (twos, ones, near.T)):
                    sums = hits @ np.array([m["copies"] for m in other], np.int64)
                    out += [(a.as_py(), b.as_py(), m["node"], int(n)) for m, n in zip(side, sums, strict=True) if n]
                kinds = [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "b", "node", "links"])

    return run


def links_of(pairs: DataFrame, units: DataFrame, info: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Linked pairs of units ``a, b``, and ``node, links``: the weight a member is linked with in other units.

    ``units`` are ``node, unit, angle, copies, n, widest, vector``, ``info`` is ``unit, centre, widest, n, weight``.
    """
    angle = math.acos(cosine)
    one = info.select(F.col("unit").alias("a"), F.col("centre").alias("one"), F.col("widest").alias("wide_one"), F.col("n").alias("n_one"))
    two = info.select(F.col("unit").alias("b"), F.col("centre").alias("two"), F.col("widest").alias("wide_two"), F.col("n").alias("n_two"))
    # A negative spread marks two single classes.
    spread = F.when((F.col("n_one") == 1) & (F.col("n_two") == 1), -1.0).otherwise(F.col("wide_one") + F.col("wide_two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two", spread.alias("spread"))
    met = materialize(both.mapInArrow(_against(cosine, angle), "a long, b long, apart double, whole boolean"), "unit-met")
    weights = info.select("unit", "weight")
    sides = lambda df, key: df.select(F.col("a").alias("unit"), F.col("b").alias("other"), *key).unionByName(df.select(F.col("b").alias("unit"), F.col("a").alias("other"), *key))
    whole = sides(met.where("whole"), []).join(weights.withColumnRenamed("unit", "other"), "other").groupBy("unit").agg(F.sum("weight").alias("links"))
    counted = units.select("node", "unit").join(whole, "unit").select("node", "links")
    linked = met.where("whole").select("a", "b")
    rest = met.where("not whole").select("a", "b", "apart")
    if not rest.head(1):
        return linked, counted
    packed = packs(units.join(sides(rest, []).select("unit").distinct(), "unit", "left_semi"))
    packed = materialize(packed, "vector-packs")
    meta = packed.select("unit", "pack", "lo", "hi")
    pack = lambda df, u, tag: df.select(F.col("unit").alias(u), *(F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != "unit"))
    both = rest.join(pack(meta, "a", "one"), "a").join(pack(meta, "b", "two"), "b")
    all_linked = F.col("apart") + F.col("hi_one") + F.col("hi_two") <= angle - SLACK
    # No member of one pack can be nearer to one of the other than their distances from the centres allow.
    gap = F.greatest(F.col("apart") - F.col("hi_one") - F.col("hi_two"), F.col("lo_one") - F.col("apart") - F.col("hi_two"), F.col("lo_two") - F.col("apart") - F.col("hi_one"))
    both = materialize(both.where(gap <= angle + SLACK).select("a", "b", "pack_one", "pack_two", all_linked.alias("whole")), "pack-pairs")
    some = both.where("whole")
    loads = packed.select(F.col("pack").alias("other"), "weight")
    ends = lambda x, y: some.select(F.col(f"pack_{x}").alias("pack"), F.col(f"pack_{y}").alias("other"))
    by_pack = ends("one", "two").unionByName(ends("two", "one")).join(loads, "other").groupBy("pack").agg(F.sum("weight").alias("links"))
    in_packs = packed.join(by_pack, "pack").select(F.explode("members").alias("m"), "links").select("m.node", "links")
    held = packed.select("pack", "members")
    load = lambda tag, name: held.select(F.col("pack").alias(f"pack_{tag}"), F.col("members").alias(name))
    open_ = both.where("not whole").join(load("one", "ones"), "pack_one").join(load("two", "twos"), "pack_two").select("a", "b", "ones", "twos")
    exact = materialize(open_.mapInArrow(_compared(cosine), "a long, b long, node long, links long"), "vector-links")
    linked = linked.unionByName(some.select("a", "b").distinct()).unionByName(exact.select("a", "b").distinct())
    return linked, counted.unionByName(in_packs).unionByName(exact.select("node", "links"))


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (``vec_id, embedding``).

    Vectors with a cosine of ``cosine`` or more are linked; ``n_links`` counts the other rows a row is linked with,
    ``component_id`` is the smallest id reachable by links. A null or zero vector, one with null or non-finite
    components, and an empty one are linked with nothing, and vectors of different lengths aren't either. Equal vectors are
    linked with each other. Rows that share an id are vectors of their own. A null id is counted among the links of
    others; its component is null if none of its rows has an id, and it is kept then. A pair at exactly the
    wanted cosine goes unseen with a chance of ``miss``, nearer pairs with far less; what is linked is
    never below the cosine. An empty table gives no rows. Other columns aren't read.
    """
    values = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("values"))
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("values", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("values", F.when(sound, F.col("values")))
    ends = [F.when(F.col("values").isNotNull(), F.xxhash64(F.lit(k), F.col("values"))).alias(c) for k, c in enumerate(("high", "low"))]
    rows = materialize(rows.select("vec_id", "values", *ends), "vector-rows")
    classes = rows.where("values is not null").groupBy("high", "low").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"))
    classes = classes.mapInArrow(_normalised, "high long, low long, least long, copies long, vector binary")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    near = math.sqrt(2 - 2 * min(cosine, 1 - 1e-6))
    shape = layout(classes.count(), cosine, miss)
    keys = materialize(hashed(classes, *shape).select("node", F.explode("keys").alias("key")), "vector-keys")
    crowds = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "vector-crowds")
    met = materialize(keys.join(crowds, "key"), "vector-met")
    placed, held = balls(met, classes, math.acos(cosine), shape)
    named = placed.groupBy("ball").agg(F.min("node").alias("unit"))
    singles = met.select("node").distinct().join(placed.select("node"), "node", "left_anti")
    units = placed.join(named, "ball").select("node", "unit", "angle").unionByName(singles.select("node", F.col("node").alias("unit"), F.lit(0.0).alias("angle")))
    units = units.join(classes.select("node", "copies", "least", "vector"), "node")
    units = materialize(units, "vector-units")
    totals = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest"), F.sum("copies").alias("weight"))
    middles = held.join(named, "ball").select("unit", "centre").unionByName(singles.select(F.col("node").alias("unit")).join(classes.select(F.col("node").alias("unit"), F.col("vector").alias("centre")), "unit"))
    info = materialize(totals.join(middles, "unit"), "vector-info")
    pairs = meetings(met, units, classes, shape, near, miss)
    linked, more = links_of(pairs, units.join(totals.select("unit", "n", "widest"), "unit"), info, cosine)
    linked, more = materialize(linked, "linked-units"), materialize(more, "more-links")
    groups = components(linked)
    named = units.join(groups.withColumnRenamed("node", "unit"), "unit", "left").select("node", "unit", "least", F.coalesce("component", "unit").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    degrees = units.select("node", "unit").join(totals.select("unit", "weight"), "unit").select("node", F.col("weight").alias("links")).unionByName(more.select("node", "links"))
    degrees = degrees.groupBy("node").agg((F.sum("links") - 1).alias("n_links"))
    known = named.join(least, "component").join(degrees, "node").select("node", "component_id", "n_links")
    named = classes.drop("vector").join(known, "node", "left")
    lone = F.col("node").isNotNull() & F.col("n_links").isNull()
    named = materialize(
        named.select("high", "low", F.when(lone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.col("copies") - 1).alias("n_links")), "vector-named"
    )
    out = rows.select("vec_id", "high", "low").join(named, ["high", "low"], "left")
    component = F.when(F.col("high").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


ORACLE = f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.vector, b.vector) >= {COSINE}
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degrees AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""


@query("op11_embedding_dedup", ORACLE)
def near_vectors_query(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
