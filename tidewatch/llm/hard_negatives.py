"""Hard-negative mining over blocks along a Hilbert curve, chosen by zone maps.

Rows are ordered by label and by their vector's place on a Hilbert curve through all dimensions, and stored as Parquet
in blocks of neighbours, each with the least and greatest value of every dimension and of the label. What an
anchor searches is a set of score windows: first all scores that may be among its best positives, known to be no
less than the fifth best in its own block; then, for each positive, the scores a hard negative may have. By interval arithmetic a
block's zone map bounds every score in it, and only blocks whose bounds meet a window are compared; a window that has its
rows raises its lower end to the last of them.

Blocks are read in groups of bounded size. Anchors of one group travel together; a pair of groups whose bounds,
box against box, meet no window is left out before anything is moved. A task holds one group of blocks and lets
anchors stream past it, so memory follows the group's size and not the number of rows or anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.base import by_length, query, table
from tidewatch.session import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A hard negative's score is below its positive's by one part in so many at most, and never above it.
SPARED = 5
BLOCK, GROUP = 512, 64
#: Anchors compared at once.
ANCHORS = 256
BITS = 2
#: Quartiles of the standard normal law: a component's cell along the curve.
CUTS = np.array([-0.6745, 0.0, 0.6745])
#: Scaled components stay below this, so that a score of up to 16,384 of them is a 64-bit integer.
LARGEST = 1 << 24
TOP = 1 << 62
EXACT = 1 << 53


def curve(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places of grid cells (a row each, values below ``2**bits``) on the Hilbert curve, as bytes that sort in its order."""
    axes = cells.astype(np.int64).T.copy()
    n, top = len(axes), 1 << (bits - 1)
    q = top
    while q > 1:
        for axis in axes:
            high = (axis & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & (q - 1))
            axes[0] ^= np.where(high, q - 1, swap)
            if axis is not axes[0]:
                axis ^= swap
        q >>= 1
    for k in range(1, n):
        axes[k] ^= axes[k - 1]
    turn = np.zeros(axes.shape[1], np.int64)
    q = top
    while q > 1:
        turn ^= np.where((axes[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    axes ^= turn
    planes = np.stack([(axes >> b) & 1 for b in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        widths = np.diff(np.asarray(lists.offsets))
        for dim in np.unique(widths):
            at = np.flatnonzero(widths == dim)
            part = batch.take(pa.array(at))
            values = np.asarray(part.column(2).flatten(), np.float64).reshape(len(at), dim)
            norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
            spread = np.divide(values * np.sqrt(max(1, dim)), norms, out=np.zeros_like(values), where=norms > 0)
            keys = curve(np.searchsorted(CUTS, spread)) if dim else [b""] * len(at)
            scaled = np.floor(values * SCALE).astype(np.int32)
            out = [part.column(0), part.column(1), pa.array(np.full(len(at), dim, np.int32)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in scaled], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "dim", "place", "vector"])


def keyed(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: ``vec_id, label, dim, place, vector, row``; ``vector`` holds 32-bit integers, ``row`` tells rows apart."""
    values = F.col("embedding").cast("array<double>")
    sound = F.forall("values", lambda x: x.isNotNull() & (F.abs(x) < LARGEST / SCALE))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), values.alias("values"))
    rows = rows.where("vec_id is not null and label is not null and values is not null").where(sound)
    rows = rows.mapInArrow(_keyed, "vec_id long, label int, dim int, place binary, vector binary")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "hard-keys")


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int32).reshape(len(vectors), dim) if dim else np.zeros((len(vectors), 0), np.int32)


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows."""
    if not one.size or not two.size:
        return np.zeros((len(one), len(two)), np.int64)
    if int(np.abs(one).max()) * int(np.abs(two).max()) * one.shape[1] < EXACT:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    return one.astype(np.int64) @ two.astype(np.int64).T


def _cutter(every: int, block: int, group: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut a sorted range into blocks and groups; an anchor gets the fifth best positive score in its own block."""
        part = TaskContext.get().partitionId() << 32
        number, groups, in_group, width = 0, 0, 0, None

        def cut_off(held: pa.Table) -> pa.RecordBatch:
            nonlocal number, groups, in_group, width
            dim = held["dim"][0].as_py()
            if in_group == group or dim != width:
                groups, in_group, width = groups + 1, 0, dim
            ids, labels = np.asarray(held["vec_id"]), np.asarray(held["label"])
            vectors = matrix(held["vector"].combine_chunks(), dim)
            seeds: list = [None] * len(ids)
            for k in np.flatnonzero(ids % every == 0):
                same = labels == labels[k]
                same[k] = False
                found = products(vectors[k : k + 1], vectors[same])[0]
                if len(found) >= POSITIVES:
                    seeds[k] = int(np.partition(found, len(found) - POSITIVES)[len(found) - POSITIVES])
            n = len(ids)
            out = [pa.array(np.full(n, part + groups)), pa.array(np.full(n, part + number)), *(held[c].combine_chunks() for c in ("row", "vec_id", "label", "dim", "vector")), pa.array(seeds, pa.int64())]
            number, in_group = number + 1, in_group + 1
            return pa.RecordBatch.from_arrays(out, ["group", "block", "row", "vec_id", "label", "dim", "vector", "seed"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                dims = np.asarray(held["dim"])
                run = int(np.argmax(dims != dims[0])) or len(dims)
                if run < block and run == len(dims):
                    break
                yield cut_off(held.slice(0, min(run, block)))
                held = held.slice(min(run, block))
        if held is not None and held.num_rows:
            yield cut_off(held)

    return cut


def stored(rows: DataFrame, every: int, block: int, group: int) -> DataFrame:
    """Blocks in Parquet, a row per vector: ``group, block, row, vec_id, label, dim, vector, seed``."""
    order = ["dim", "label", "place", "row"]
    schema = "group long, block long, row long, vec_id long, label int, dim int, vector binary, seed long"
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cutter(every, block, group), schema), "hard-blocks")


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = np.asarray(batch.column(1))
        edges = np.flatnonzero(np.diff(blocks)) + 1
        out = []
        for start, stop in zip([0, *edges], [*edges, len(blocks)], strict=True):
            part = batch.slice(start, stop - start)
            dim, labels = part.column(3)[0].as_py(), np.asarray(part.column(2))
            values = matrix(part.column(4), dim)
            out.append((part.column(0)[0].as_py(), int(blocks[start]), dim, int(labels.min()), int(labels.max()), values.min(axis=0).tobytes(), values.max(axis=0).tobytes()))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["group", "block", "dim", "label_lo", "label_hi", "lo", "hi"])


ZONE = "group long, block long, dim int, label_lo int, label_hi int, lo binary, hi binary"


def box(rows: pd.DataFrame) -> tuple[bytes, bytes]:
    lows, highs = (np.stack([np.frombuffer(v, np.int32) for v in rows[c]]) for c in ("lo", "hi"))
    return lows.min(axis=0).tobytes(), highs.max(axis=0).tobytes()


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    lo, hi = box(rows)
    first = rows.iloc[0]
    return pd.DataFrame([(first["group"], first["block"], first["dim"], rows["label_lo"].min(), rows["label_hi"].max(), lo, hi)], columns=["group", "block", "dim", "label_lo", "label_hi", "lo", "hi"])


def zone_maps(blocks: DataFrame) -> DataFrame:
    """The zone map of each block: ``group, block, dim, label_lo, label_hi, lo, hi``."""
    parts = blocks.select("group", "block", "label", "dim", "vector").mapInArrow(_zones, ZONE)
    return materialize(parts.groupBy("group", "block").applyInPandas(_merged, ZONE), "hard-zones")


def group_zones(zones: DataFrame) -> DataFrame:
    """The same of each group: ``group, dim, label_lo, label_hi, lo, hi``."""
    return materialize(zones.groupBy("group").applyInPandas(_merged, ZONE).drop("block"), "hard-groups")


def _chunk(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack([np.frombuffer(v, np.int32) for v in rows["vector"]])
    first = rows.iloc[0]
    low = min(min(x) for x in rows["lows"])
    high = max(max(x) for x in rows["highs"])
    out = (first["chunk"], first["dim"], rows["label"].min(), rows["label"].max(), low, high, vectors.min(axis=0).tobytes(), vectors.max(axis=0).tobytes())
    return pd.DataFrame([out], columns=["chunk", "dim", "first_label", "last_label", "low", "high", "least", "most"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of an anchors' box and a group's box whose scores may meet the anchors' windows."""
    for batch in (part for whole in batches for part in by_length(whole, "lo")):
        a_lo, a_hi, b_lo, b_hi = (np.stack([np.frombuffer(v, np.int32).astype(np.float64) for v in batch.column(c).to_pylist()]) for c in ("least", "most", "lo", "hi"))
        corners = [a_lo * b_lo, a_lo * b_hi, a_hi * b_lo, a_hi * b_hi]
        upper = np.maximum.reduce(corners).sum(axis=1)
        lower = np.minimum.reduce(corners).sum(axis=1)
        slack = 1 + (np.abs(upper) + np.abs(lower)) * 1e-9
        meet = (upper + slack >= np.asarray(batch.column("low"), np.float64)) & (lower - slack <= np.asarray(batch.column("high"), np.float64))
        yield batch.select(["chunk", "group"]).filter(pa.array(meet))


def pairs(anchors: DataFrame, groups: DataFrame, same: bool) -> DataFrame:
    """``chunk, group``: which groups of blocks the anchors of a chunk must read. Anchors are the stated queries."""
    chunk = "chunk long, dim int, first_label int, last_label int, low long, high long, least binary, most binary"
    chunks = materialize(anchors.groupBy("chunk").applyInPandas(_chunk, chunk), "hard-chunks")
    # Groups lie on pages of about 64, and every chunk is held against every page.
    pages = groups.count() // 64 + 1
    groups = groups.withColumn("page", F.pmod(F.xxhash64("group"), F.lit(pages)))
    each = chunks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)).cast("array<bigint>"))).withColumnRenamed("dim", "anchor_dim")
    overlap = (F.col("first_label") <= F.col("label_hi")) & (F.col("label_lo") <= F.col("last_label"))
    alone = (F.col("first_label") == F.col("label_lo")) & (F.col("first_label") == F.col("label_hi")) & (F.col("last_label") == F.col("first_label"))
    met = each.join(groups, "page").where((F.col("anchor_dim") == F.col("dim")) & (overlap if same else ~alone))
    return materialize(met.select("chunk", "group", "low", "high", "least", "most", "lo", "hi").mapInArrow(_meeting, "chunk long, group long"), "hard-pairs")


class Group:
    """The blocks of one group: their rows by id, and their zone maps."""

    def __init__(self, tables: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(tables)
        self.dim = rows["dim"][0].as_py()
        blocks = np.asarray(rows["block"])
        order = np.lexsort((np.asarray(rows["row"]), np.asarray(rows["vec_id"]), blocks))
        edges = np.flatnonzero(np.diff(blocks[order])) + 1
        self.ids, self.labels, self.rows = (np.asarray(rows[c])[order] for c in ("vec_id", "label", "row"))
        vectors = matrix(rows["vector"].combine_chunks(), self.dim)[order]
        self.parts = np.split(vectors, edges)
        self.starts = np.array([0, *edges])
        self.lo = np.stack([p.min(axis=0) for p in self.parts]).astype(np.float64)
        self.hi = np.stack([p.max(axis=0) for p in self.parts]).astype(np.float64)

    def search(self, anchors: pa.Table, same: bool, most: int) -> list[np.ndarray]:
        """The first ``most`` rows of each window of each anchor: anchor, window, row in the group and score."""
        vectors = matrix(anchors["vector"].combine_chunks(), self.dim)
        labels, own = np.asarray(anchors["label"]), np.asarray(anchors["row"])
        counts = np.array([len(x) for x in anchors["lows"].to_pylist()])
        lows, highs = (np.full((len(counts), counts.max()), fill) for fill in (TOP, -TOP))
        for k, (low, high) in enumerate(zip(anchors["lows"].to_pylist(), anchors["highs"].to_pylist(), strict=True)):
            lows[k, : counts[k]], highs[k, : counts[k]] = low, high
        width = lows.shape[1]
        over, under = np.maximum(vectors, 0).astype(np.float64), np.minimum(vectors, 0).astype(np.float64)
        upper = over @ self.hi.T + under @ self.lo.T
        lower = over @ self.lo.T + under @ self.hi.T
        slack = 1 + (np.abs(upper) + np.abs(lower)) * 1e-9
        upper, lower = upper + slack, lower - slack
        found = [np.empty(0, np.int64) for _ in range(4)]
        # Blocks that may hold the highest scores come first, so that windows fill early.
        for b in np.argsort(-upper.max(axis=0)):
            near = (upper[:, b, None] >= lows) & (lower[:, b, None] <= highs) & (lows <= highs)
            who = np.flatnonzero(near.any(axis=1))
            if not len(who):
                continue
            part, start = self.parts[b], self.starts[b]
            scores = products(vectors[who], part)
            alike = labels[who][:, None] == self.labels[None, start : start + len(part)]
            if same:
                alike &= own[who][:, None] != self.rows[None, start : start + len(part)]
            fit = (alike if same else ~alike) & (scores >= lows[who].min(axis=1)[:, None]) & (scores <= highs[who].max(axis=1)[:, None])
            at, row = np.nonzero(fit)
            if not len(at):
                continue
            hit, anchor = scores[at, row], who[at]
            inside = (hit[:, None] >= lows[anchor]) & (hit[:, None] <= highs[anchor])
            k, window = np.nonzero(inside)
            found = [np.concatenate(x) for x in zip(found, (anchor[k], window, row[k] + start, hit[k]), strict=True)]
            found, lows = self.best(found, lows, most, width)
        return found

    def best(self, found: list[np.ndarray], lows: np.ndarray, most: int, width: int):
        anchor, window, row, score = found
        order = np.lexsort((self.rows[row], self.ids[row], -score, anchor * width + window))
        slot = (anchor * width + window)[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(slot)) + 1)) if len(slot) else np.empty(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate((first, [len(slot)]))))
        order = order[rank < most]
        full = order[rank[rank < most] == most - 1]
        lows = lows.copy()
        # A later row may tie with the last one and have a smaller id.
        lows[anchor[full], window[full]] = np.maximum(lows[anchor[full], window[full]], score[full])
        return [x[order] for x in found], lows


def _searcher(same: bool, most: int):
    names = ["anchor_row", "window", "vec_id", "row", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, anchors, group, waiting = None, [], [], None, 0

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal group, held, anchors, waiting
            if anchors and (held or group):
                group = group or Group(held)
                held = []
                asked = pa.Table.from_batches(anchors)
                anchor, window, row, score = group.search(asked, same, most)
                if len(anchor):
                    out = [np.asarray(asked["row"])[anchor], window, group.ids[row], group.rows[row], score]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
            anchors, waiting = [], 0

        for batch in batches:
            groups, asks = np.asarray(batch.column("group")), np.asarray(batch.column("asks"))
            edges = np.flatnonzero((np.diff(groups) != 0) | (np.diff(asks) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, len(groups)], strict=True):
                if groups[start] != now:
                    yield from answered()
                    now, held, group = groups[start], [], None
                part = batch.slice(start, stop - start)
                if not asks[start]:
                    held.append(part)
                    continue
                for at in range(0, part.num_rows, ANCHORS):
                    few = part.slice(at, min(ANCHORS, part.num_rows - at))
                    if waiting + few.num_rows > ANCHORS:
                        yield from answered()
                    anchors.append(few)
                    waiting += few.num_rows
        yield from answered()

    return run


def searched(blocks: DataFrame, anchors: DataFrame, groups: DataFrame, same: bool, most: int) -> DataFrame:
    """``anchor_row, window, vec_id, row, score``: the first rows of each window. ``same`` takes rows of the anchor's label, else the others.

    ``anchors`` are ``chunk, row, label, dim, vector, lows, highs``, with one window at least each.
    """
    sent = pairs(anchors, groups, same)
    needed = sent.select("group").distinct()
    nothing = F.lit(None).cast("array<bigint>")
    read = blocks.join(needed, "group", "left_semi").select("group", F.lit(0).alias("asks"), "block", "row", "vec_id", "label", "dim", "vector", nothing.alias("lows"), nothing.alias("highs"))
    asked = anchors.join(sent, "chunk").select(
        "group", F.lit(1).alias("asks"), F.col("chunk").alias("block"), "row", F.lit(0).cast("long").alias("vec_id"), "label", "dim", "vector", "lows", "highs"
    )
    both = read.unionByName(asked).repartition("group").sortWithinPartitions("group", "asks", "block", "row")
    found = both.mapInArrow(_searcher(same, most), "anchor_row long, window long, vec_id long, row long, score long")
    order = W.partitionBy("anchor_row", "window").orderBy(F.col("score").desc(), "vec_id", "row")
    return materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most), "hard-found")


def hard_negatives(embeddings: DataFrame, every: int = 100, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows whose id is divisible by ``every``.

    Components are multiplied by 256 and rounded down. An anchor's positives are its first five other rows of its
    label, by score and then by smaller id; a positive's negatives the first five rows of other labels that score from
    80 to 100 percent of it. A positive with a score below 0 has none.

    Rows without id, label or vector, with a null or non-finite component or one of 65,536 or more take no part. Vectors
    of different lengths aren't compared; empty ones score 0. Rows that share an id are rows of their own: each
    anchor among them has its own lists, and of rows equal in score and id any may come first. An
    empty table gives no rows. Other columns aren't read.
    """
    blocks = stored(keyed(embeddings.select("vec_id", "label", "embedding")), every, block, group)
    groups = group_zones(zone_maps(blocks))
    anchors = blocks.where(F.col("vec_id") % every == 0)
    asking = anchors.select(F.col("group").alias("chunk"), "row", "label", "dim", "vector", F.array(F.coalesce("seed", F.lit(-TOP))).alias("lows"), F.array(F.lit(TOP)).alias("highs"))
    positives = searched(blocks, materialize(asking, "hard-anchors"), groups, True, POSITIVES)
    asking = positives.where("score >= 0").groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("aims"))
    windows = anchors.join(asking, F.col("row") == F.col("anchor_row")).select(
        F.col("group").alias("chunk"),
        "row",
        "label",
        "dim",
        "vector",
        # The least whole score of at least four fifths of the positive's, and the positive's own.
        F.expr(f"transform(aims, p -> p.score - p.score div {SPARED})").alias("lows"),
        F.transform("aims", lambda p: p["score"]).alias("highs"),
    )
    negatives = searched(blocks, materialize(windows, "hard-windows"), groups, False, NEGATIVES)
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    aims = positives.select("anchor_row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        negatives.select("anchor_row", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(aims, ["anchor_row", "window"])
        .join(names, "anchor_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


ORACLE = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.vector, b.vector) AS BIGINT) AS score
    FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT alike
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""


@query("op12_hard_negatives", ORACLE)
def hard_negatives_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))
