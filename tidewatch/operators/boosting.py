"""Gradient-boosted trees, fitted on binned rows.

The trees are those of Spark's ``GBTClassifier`` (log loss, variance gain, thresholds at weighted quantiles, leaves of mean
residuals, rows sampled by tree and columns by node) and come back as its model. What differs is the work: a row is a byte for each number and a slot for each category, of two siblings only
the smaller one is counted, and a table of one block is fitted by a single task. Larger tables take a job for each level of a tree.
"""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.blocks import ROWS_PER_BLOCK, Layout, merged, one_each, opened, smallest
from tidewatch.session import materialize, shared_folder

#: Trees between two stored copies of the margins, which cut their lineage.
TREES_PER_COPY = 50
#: Partitions whose sums the driver adds up itself.
PARTS_AT_DRIVER = 64
#: Columns share codes of up to so many bits: the sums of a code then stay in a core's own cache.
CODE_BITS = 11
#: Positives are counted in these units beside negatives, so that one sum holds both exactly.
_POSITIVE = float(1 << 26)
#: Gains below this share of the residuals' squares are rounding.
_ROUNDING = 1e-13

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    rate: float
    row_sample: float
    column_sample: float
    least_rows: int
    bins: int
    seed: int

    @staticmethod
    def of(estimator: GBTClassifier) -> Settings:
        return Settings(
            estimator.getMaxIter(),
            estimator.getMaxDepth(),
            estimator.getStepSize(),
            estimator.getSubsamplingRate(),
            1.0 if estimator.getFeatureSubsetStrategy() == "all" else float(estimator.getFeatureSubsetStrategy()),
            estimator.getMinInstancesPerNode(),
            estimator.getMaxBins(),
            estimator.getSeed(),
        )


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of a column: between all values if they are few, else at even steps of weight."""
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2.0
    stride, cuts = weights.sum() / bins, []
    ends = np.cumsum(weights)
    target = stride
    for i in range(1, len(values)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            cuts.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(cuts[: bins - 1])


def packing(sizes: Sequence[int]) -> list[list[tuple[int, int, int]]]:
    """Columns that share a code, each as ``column, shift, bits``: first fit, the widest first.

    Rows are counted by the whole code, and the columns' own counts are sums of those.
    """
    held: list[tuple[int, list]] = []
    for column in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
        bits = (sizes[column] - 1).bit_length()
        at = next((i for i, (used, _) in enumerate(held) if used + bits <= CODE_BITS), None)
        if at is None:
            held.append((bits, [(column, 0, bits)]))
        else:
            used, members = held[at]
            held[at] = (used + bits, [*members, (column, used, bits)])
    return [members for _, members in held]


def binned(block: dict, cuts: list[np.ndarray], packs: list) -> dict:
    """A block's rows by the bins their numbers fall in and the slots of their categories, as packed codes."""
    columns = []
    for (values, codes), at in zip(block["columns"], cuts, strict=True):
        found = np.searchsorted(at, codes if values is None else values, side="left")
        columns.append(found if values is None else found[codes])
    columns += block["slots"]
    codes = []
    for members in packs:
        code = np.zeros(len(block["y"]), np.int64)
        for column, shift, _ in members:
            code |= columns[column].astype(np.int64) << shift
        codes.append(smallest(code, 1 << sum(bits for *_, bits in members)))
    return {"name": block["name"], "y": block["y"], "codes": codes}


# A tree is a list of levels, a level a list of nodes: None for a leaf, or (kind, column, cut, left child's place in the next level, its
# place among the codes). Kind 0: a number goes left up to bin ``cut``; 1: a row with slot ``cut`` goes right; 2: it goes left.


def _halves(rows: dict, node: tuple, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind, _, cut, _, (code, shift, bits) = node
    value = (rows["codes"][code][at] >> shift) & ((1 << bits) - 1)
    found = value <= cut if kind == 0 else (value == cut) == (kind == 2)
    return at[found], at[~found]


def advanced(rows: dict, margin: np.ndarray, levels: list, leaves: list, rate: float) -> np.ndarray:
    """Margins after one more tree; ``leaves`` are the values of the nodes, level by level."""
    margin = margin.copy()
    held = [np.arange(len(margin))]
    for level, worth in zip(levels, leaves, strict=True):
        following = []
        for node, mine, value in zip(level, held, worth, strict=True):
            if node:
                following += _halves(rows, node, mine)
            else:
                margin[mine] += np.float32(rate * value)
        held = following
    return margin


def residuals(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted on: the labels as 1 and -1 at first, then the log loss's falling slope."""
    sign = np.where(y, 1.0, -1.0)
    return sign if margin is None else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


@dataclass(frozen=True)
class Histogram:
    """Where each column's bins lie in the row of sums of a node, and which columns share a code."""

    sizes: tuple[int, ...]
    numbers: int
    packs: list
    ends: np.ndarray

    def place(self, column: int) -> tuple[int, int, int]:
        return next((i, shift, bits) for i, members in enumerate(self.packs) for c, shift, bits in members if c == column)

    def counted(self, rows: dict, margin: np.ndarray | None, weights: tuple, levels: list, wanted: list[int], s: Settings, tree: int) -> np.ndarray:
        """``node, sum, bin``: negatives, positives and weighted residuals of the wanted nodes; the last bin is the sum of squares."""
        now = rows.get("now")
        if now and now[:2] == (tree, len(levels) - 1):
            *_, slope, both, weighed, held = now
            held = _below(rows, levels[-1], held)
        else:
            draw = np.random.default_rng([s.seed, tree, *rows["name"]])
            held = [np.flatnonzero(draw.random(len(rows["y"])) < s.row_sample) if s.row_sample < 1 else np.arange(len(rows["y"]))]
            y = rows["y"]
            slope, both = residuals(y, margin), np.where(y, _POSITIVE, 1.0)
            weighed = np.where(y, weights[1], weights[0]) * slope
            for level in levels:
                held = _below(rows, level, held)
        # While a task keeps its rows, the next level goes on from here.
        rows["now"] = (tree, len(levels), slope, both, weighed, held)
        out = np.zeros((len(wanted), 3, self.ends[-1] + 1))
        for place, node in enumerate(wanted):
            mine = held[node]
            units, pull = both[mine], weighed[mine]
            for code, members in zip(rows["codes"], self.packs, strict=True):
                here, width = code[mine].astype(np.intp), 1 << sum(bits for *_, bits in members)
                count = np.bincount(here, weights=units, minlength=width)
                positives = np.floor(count / _POSITIVE)
                sums = np.stack([count - positives * _POSITIVE, positives, np.bincount(here, weights=pull, minlength=width)])
                for column, shift, bits in members:
                    own = sums.reshape(3, -1, 1 << bits, 1 << shift).sum(axis=(1, 3))
                    out[place, :, self.ends[column] : self.ends[column + 1]] = own[:, : self.sizes[column]]
            out[place, 2, -1] = pull @ slope[mine]
        return out


def histogram(sizes: Sequence[int], numbers: int) -> Histogram:
    return Histogram(tuple(sizes), numbers, packing(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _below(rows: dict, level: list, held: list[np.ndarray]) -> list[np.ndarray]:
    """Row numbers of each node of the level after one."""
    return [half for node, mine in zip(level, held, strict=True) if node for half in _halves(rows, node, mine)]


def _best(hist: Histogram, sums: np.ndarray, weights: tuple, allowed: np.ndarray, s: Settings) -> list[tuple[float, tuple | None, np.ndarray]]:
    """Of each node: gain, split without its child's place, and ``rows, weight, residuals, squares``."""
    ends = hist.ends
    count = sums[:, 0] + sums[:, 1]
    weigh = sums[:, 0] * weights[0] + sums[:, 1] * weights[1]
    pull = sums[:, 2]
    whole = [v[:, : ends[1]].sum(axis=1) for v in (count, weigh, pull)]
    rows, weight, total = (v[:, None] for v in whole)
    squares = np.maximum(pull[:, -1], 0.0)

    def score(n: np.ndarray, w: np.ndarray, r: np.ndarray, may: np.ndarray) -> np.ndarray:
        other_w, other_r = weight - w, total - r
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (r * r / w + other_r * other_r / other_w - total * total / weight) / weight
        fits = may & (n >= s.least_rows) & (rows - n >= s.least_rows) & (w > 0) & (other_w > 0)
        return np.where(fits, gain, -np.inf)

    gains, wide = [], 0
    if hist.numbers:
        wide = max(hist.sizes[: hist.numbers])
        place = ends[: hist.numbers, None] + np.arange(wide)[None, :]
        last = ends[1 : hist.numbers + 1, None]
        inside = place < last
        place = np.where(inside, place, 0)
        left = [np.cumsum(np.where(inside, v[:, place], 0.0), axis=2).reshape(len(sums), -1) for v in (count, weigh, pull)]
        may = ((place < last - 1) & inside)[None] & allowed[:, : hist.numbers, None]
        gains.append(score(*left, may.reshape(len(sums), -1)))
    slots = [(c, slot) for c in range(hist.numbers, len(hist.sizes)) for slot in range(hist.sizes[c] - 1)]
    if slots:
        at = np.array([ends[c] + slot for c, slot in slots])
        gains.append(score(count[:, at], weigh[:, at], pull[:, at], allowed[:, hist.numbers :]))
    gain = np.concatenate(gains, axis=1)
    tops = np.argmax(gain, axis=1)
    out = []
    for i, top in enumerate(tops):
        stats = np.array([*(float(v[i]) for v in whole), squares[i]])
        n, w, r, rr = stats
        best = gain[i, top]
        if not n or (rr - r * r / w) / w < np.finfo(float).eps or not best > _ROUNDING * rr / w:
            out.append((0.0, None, stats))
        elif top < hist.numbers * wide:
            out.append((float(best), (0, int(top) // wide, int(top) % wide), stats))
        else:
            c, slot = slots[top - hist.numbers * wide]
            mine_w, mine_r = weigh[i, ends[c] + slot], pull[i, ends[c] + slot]
            # As in Spark, the side with the lower mean goes left.
            out.append((float(best), (2 if mine_r / mine_w < (r - mine_r) / (w - mine_w) else 1, c - hist.numbers, slot), stats))
    return out


def _sides(hist: Histogram, sums: np.ndarray, split: tuple, weights: tuple) -> list[np.ndarray]:
    """``rows, weight, residuals, squares`` of both children; squares aren't known before a child is counted."""
    kind, column, cut = split
    ends, out = hist.ends, []
    c = column if kind == 0 else hist.numbers + column
    inside = slice(ends[c], ends[c] + cut + 1) if kind == 0 else slice(ends[c] + cut, ends[c] + cut + 1)
    mine, whole = sums[:, inside].sum(axis=1), sums[:, ends[c] : ends[c + 1]].sum(axis=1)
    for half in (mine, whole - mine) if kind != 1 else (whole - mine, mine):
        out.append(np.array([half[0] + half[1], half[0] * weights[0] + half[1] * weights[1], half[2], math.nan]))
    return out


Counter = Callable[[int, list, list[int]], np.ndarray]


def grown(hist: Histogram, weights: tuple, width: int, s: Settings, tree: int, count: Counter) -> tuple[list, list, list]:
    """Levels, leaf values and node figures (``gain, rows, weight, residuals, squares``) of one tree."""
    draw = np.random.default_rng([s.seed, tree])
    taken = math.ceil(s.column_sample * width)
    levels, values, figures = [], [], []
    pending, sums = [None], list(count(tree, [], [0]))
    while True:
        level, worth, about, following, stats_below = [], [], [], [], []
        counted = [mine for mine in sums if mine is not None]
        allowed = np.ones((len(counted), width), bool)
        if taken < width:
            allowed[:] = False
            for mask in allowed:
                mask[draw.choice(width, taken, replace=False)] = True
        best = iter(_best(hist, np.stack(counted), weights, allowed, s) if counted else ())
        for known, mine in zip(pending, sums, strict=True):
            if mine is None:
                level.append(None)
                about.append((-1.0, *known))
                worth.append(known[2] / known[1])
                continue
            gain, split, stats = next(best)
            worth.append(stats[2] / stats[1] if stats[1] else 0.0)
            about.append((gain if split else -1.0, *stats))
            if split is None:
                level.append(None)
                continue
            column = split[1] if split[0] == 0 else hist.numbers + split[1]
            level.append((*split, len(stats_below), hist.place(column)))
            sides = _sides(hist, mine, split, weights)
            following.append((mine, len(stats_below), int(sides[1][0] < sides[0][0])))
            stats_below += sides
        levels.append(level)
        values.append(worth)
        figures.append(about)
        if not following:
            return levels, values, figures
        pending = stats_below
        if len(levels) == s.depth:
            sums = [None] * len(pending)
            continue
        # Of two siblings the smaller is counted and the other is what remains of their parent.
        smaller = [left + right for _, left, right in following]
        sums = [None] * len(pending)
        for (parent, left, right), mine in zip(following, count(tree, levels, smaller), strict=True):
            sums[left + right], sums[left + 1 - right] = mine, parent - mine


def _local(parts: list[dict], hist: Histogram, weights: tuple, width: int, s: Settings) -> list[tuple]:
    """All trees, fitted on blocks at hand."""
    margins: list = [None] * len(parts)

    def count(tree: int, levels: list, wanted: list[int]) -> np.ndarray:
        return sum(hist.counted(rows, m, weights, levels, wanted, s, tree) for rows, m in zip(parts, margins, strict=True))

    out = []
    for tree in range(s.trees):
        out.append(grown(hist, weights, width, s, tree, count))
        rate = s.rate if tree else 1.0
        for rows in parts:
            del rows["now"]
        margins = [
            advanced(rows, np.zeros(len(rows["y"]), np.float32) if m is None else m, out[-1][0], out[-1][1], rate)
            for rows, m in zip(parts, margins, strict=True)
        ]
    return out


def _summed(found: RDD, parts: int) -> np.ndarray:
    return found.treeReduce(lambda a, b: a + b, 1 if parts <= PARTS_AT_DRIVER else 2)


def _everywhere(rows: RDD, hist: Histogram, weights: tuple, width: int, s: Settings) -> list[tuple]:
    """All trees, a job for each level; the margins are a table beside the rows, advanced tree by tree."""
    spark = SparkSession.active()
    parts = rows.getNumPartitions()
    state = one_each(rows.map(lambda r: np.zeros(len(r["y"]), np.float32)))
    old: list[RDD] = []
    out = []

    def count(tree: int, levels: list, wanted: list[int]) -> np.ndarray:
        def of(pairs: Iterator) -> Iterator:
            whole = None
            for r, m in pairs:
                mine = hist.counted(r, m if tree else None, weights, levels, wanted, s, tree)
                whole = mine if whole is None else whole + mine
            if whole is not None:
                yield whole

        return _summed(rows.zip(state).mapPartitions(of), parts)

    for tree in range(s.trees):
        out.append(grown(hist, weights, width, s, tree, count))
        while old:
            old.pop().unpersist()
        if tree + 1 == s.trees:
            break
        levels, leaves, rate = out[-1][0], out[-1][1], s.rate if tree else 1.0
        old.append(state)
        following = rows.zip(state).map(lambda p, a=levels, b=leaves, c=rate: advanced(p[0], p[1], a, b, c))
        state = one_each(following).persist(StorageLevel.MEMORY_AND_DISK)
        if (tree + 1) % TREES_PER_COPY == 0:
            state.checkpoint()
    state.unpersist()
    return out


def fit(spark: SparkSession, estimator: GBTClassifier, blocks: DataFrame, layout: Layout) -> GBTClassificationModel:
    """The estimator's model of the stored blocks."""
    s = Settings.of(estimator)
    shared = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    raw = opened(blocks)
    either = lambda a, b: b if a is None else a
    figures = raw.map(lambda b: (len(b["y"]), b["weights"], b["summary"])).treeReduce(
        lambda a, b: (a[0] + b[0], [either(x, y) for x, y in zip(a[1], b[1], strict=True)], merged(a[2], b[2])),
        1 if raw.getNumPartitions() <= PARTS_AT_DRIVER else 2,
    )
    count, weights = figures[0], tuple(0.0 if w is None else float(w) for w in figures[1])
    cuts = [cuts_of(v, w, s.bins) for v, w in figures[2]]
    hist = histogram([len(c) + 1 for c in cuts] + [n + 1 for n in layout.slots], layout.numbers)
    rows = raw.map(lambda b: binned(b, cuts, hist.packs))
    if count <= ROWS_PER_BLOCK:
        trees = rows.coalesce(1).mapPartitions(lambda held: [_local(list(held), hist, weights, layout.width, s)]).first()
    else:
        rows = one_each(rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            trees = _everywhere(rows, hist, weights, layout.width, s)
        finally:
            rows.unpersist()
    return _model(spark, estimator, trees, cuts, layout, s, f"{shared}/boosted-{uuid4().hex}")


def _nodes(tree: tuple, cuts: list[np.ndarray], layout: Layout) -> list[tuple]:
    """A tree's nodes as Spark stores them, in preorder; sister leaves of one value are their parent's leaf."""
    levels, values, figures = tree
    starts = layout.starts
    out: list = []

    def leaf_only(d: int, i: int) -> bool:
        if levels[d][i] is None:
            return True
        below = levels[d][i][3]
        return leaf_only(d + 1, below) and leaf_only(d + 1, below + 1) and values_of(d + 1, below) == values_of(d + 1, below + 1)

    def values_of(d: int, i: int) -> float:
        # A node whose halves agree has their value.
        return values[d][i] if levels[d][i] is None else values_of(d + 1, levels[d][i][3])

    def visit(d: int, i: int) -> int:
        gain, rows, weight, total, squares = figures[d][i]
        number = len(out)
        out.append(None)
        impurity = max((squares - total * total / weight) / weight, 0.0) if squares == squares and weight else -1.0
        stats = [float(weight), float(total), float(squares)]
        if leaf_only(d, i):
            out[number] = (number, float(values_of(d, i)), float(impurity), stats, int(rows), -1.0, -1, -1, (-1, [], -1))
            return number
        kind, column, cut, below, _ = levels[d][i]
        left, right = visit(d + 1, below), visit(d + 1, below + 1)
        split = (column, [float(cuts[column][cut])], -1) if kind == 0 else (starts[column] + cut, [float(kind == 2)], 2)
        out[number] = (number, float(values[d][i]), float(impurity), stats, int(rows), float(gain), left, right, split)
        return number

    visit(0, 0)
    return out


_NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
    "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def _model(spark: SparkSession, estimator: GBTClassifier, trees: list, cuts: list, layout: Layout, s: Settings, path: str) -> GBTClassificationModel:
    """Spark's model of the trees, by way of the form in which it is saved."""
    given = lambda params, names=None: {p.name: v for p, v in params.items() if names is None or p.name in names}
    stamp, version = int(time.time() * 1000), spark.version

    def about(kind: str, uid: str, names=None) -> str:
        mine, default = given(estimator._paramMap, names), given(estimator._defaultParamMap, names)
        return json.dumps({"class": kind, "timestamp": stamp, "sparkVersion": version, "uid": uid, "paramMap": mine, "defaultParamMap": default})

    tree_params = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
                   "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", "weightCol"}
    whole = json.loads(about("org.apache.spark.ml.classification.GBTClassificationModel", estimator.uid))
    whole |= {"numFeatures": layout.width, "numTrees": len(trees)}
    kind = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
    each = [(i, about(kind, f"dtr_{uuid4().hex[:12]}", tree_params), s.rate if i else 1.0) for i in range(len(trees))]
    nodes = [(i, node) for i, tree in enumerate(trees) for node in _nodes(tree, cuts, layout)]
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
