"""Toxicity by a chain of linear classifiers.

Evidence is gathered over all labelled rows of the sample: for each word and each beginning of a word, how many toxic
and clean texts hold it. What speaks clearly for toxicity becomes a lexicon. Categories
are predicted one after the other by logistic models of lexicon measures and entries; each model
also sees the probabilities of the categories before it. In training these come from models fitted
on the other folds, so a model learns how far earlier predictions can be trusted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch.llm.arrays import BYTE, Words, mix, powers
from tidewatch.llm.base import map_texts, query, table
from tidewatch.session import materialize

#: Categories in the order of the chain; the last one is the verdict.
CATEGORIES = ("abusive", "dense", "toxic")
#: Toxic rows the classifier is fitted on at most; of clean ones, twice as many.
SAMPLE = 4000
FOLDS = 5
PREFIXES = (4, 5, 6, 8)
BUCKETS = 1 << 22
#: A lexicon entry is in this many toxic texts at least, and that much likelier in them.
LEAST_TEXTS, LEAST_ODDS = 4, 24.0
LEXICON = 4096
ENTRIES = 128
MEASURES = 6
THRESHOLD = 0.5
PENALTY = 1e-3


def features(words: Words) -> np.ndarray:
    """Buckets of each word's features, a row each: the word itself, then its beginnings of some bytes (-1 if shorter)."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    out[:, 0] = words.hashes() % np.uint64(BUCKETS)
    lengths = words.ends - words.starts
    held = np.zeros(len(words), np.uint64)
    at = 0
    steps = powers(max(PREFIXES))
    for k, size in enumerate(PREFIXES):
        with np.errstate(over="ignore"):
            while at < size:
                place = np.minimum(words.starts + at, max(len(words.data) - 1, 0))
                held += BYTE[words.data[place]] * steps[at] if len(words) else 0
                at += 1
            out[:, k + 1] = np.where(lengths >= size, mix(held + np.uint64(size)) % np.uint64(BUCKETS), -1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> np.ndarray:
    """Weights (the last is the intercept) of a penalised logistic model."""
    x = np.hstack([x, np.ones((len(x), 1))])
    step = 1.0 / (0.25 * float((x * x).sum()) / len(x) + penalty)
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 0
    for k in range(rounds):
        slope = x.T @ (probability(x, ahead) - y) / len(x) + keep * ahead
        new = ahead - step * slope
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))


@dataclass
class Chain:
    """A lexicon (bucket to strength) and one logistic model for each category."""

    strength: np.ndarray
    entries: np.ndarray
    weights: list[np.ndarray]
    categories: tuple[str, ...] = CATEGORIES

    def measures(self, words: Words) -> np.ndarray:
        """Lexicon measures of each text, then which entries it holds."""
        return measures(words, self.strength, self.entries)

    def predict(self, x: np.ndarray) -> np.ndarray:
        found = np.zeros((len(x), 0))
        for w in self.weights:
            row = np.hstack([x, found, np.ones((len(x), 1))])
            found = np.hstack([found, probability(row, w)[:, None]])
        return found


def measures(words: Words, strength: np.ndarray, entries: np.ndarray) -> np.ndarray:
    n = len(words.first) - 1
    x = np.zeros((n, MEASURES + len(entries)))
    if not len(words):
        return x
    found = features(words)
    power = np.where(found >= 0, strength[found], 0.0)
    best = power.max(axis=1)
    hit = np.flatnonzero(best > 0)
    if not len(hit):
        return x
    doc = words.doc[hit]
    total = np.diff(words.first)
    hits = np.bincount(doc, minlength=n)
    x[:, 0] = np.minimum(hits, 20) / 20
    np.maximum.at(x[:, 1], doc, best[hit] / 10)
    kinds = np.unique(np.column_stack([doc, found[hit, 0]]), axis=0)
    x[:, 2] = np.minimum(np.bincount(kinds[:, 0], minlength=n), 10) / 10
    x[:, 3] = np.minimum(1, 10 * hits / np.maximum(total, 1))
    x[:, 4] = hits > 0
    x[:, 5] = np.where(hits > 0, np.log1p(total) / 10, 0)
    at = np.searchsorted(entries, found[hit])
    known = (at < len(entries)) & (entries[np.minimum(at, len(entries) - 1)] == found[hit]) if len(entries) else np.zeros(at.shape, bool)
    rows, _ = np.nonzero(known)
    x[doc[rows], MEASURES + at[known]] = 1
    return x


def evidence(sample: DataFrame) -> DataFrame:
    """For every feature: how many ``toxic`` and ``clean`` texts of the sample hold it."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1))
            label = np.asarray(batch.column(2)).astype(np.int64)
            found = features(words)
            pairs = np.unique((np.repeat(words.doc, found.shape[1]) * (BUCKETS + 1) + found.ravel() + 1))
            doc, feature = pairs // (BUCKETS + 1), pairs % (BUCKETS + 1) - 1
            doc, feature = doc[feature >= 0], feature[feature >= 0]
            kinds, at = np.unique(feature, return_inverse=True)
            toxic = np.bincount(at, weights=label[doc], minlength=len(kinds)).astype(np.int64)
            clean = np.bincount(at, weights=1 - label[doc], minlength=len(kinds)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(toxic), pa.array(clean)], ["feature", "toxic", "clean"])

        return each

    return map_texts(sample, make, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``doc_id, text, toxic`` of up to ``limit`` toxic and twice as many clean documents, chosen by a hash of the id.

    Labels that aren't 0 or 1 are left out, and so are ids with both, and those of no document in ``docs``.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clear = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .drop("most")
        .join(text.select("doc_id"), "doc_id", "left_semi")
        .withColumn("order", F.xxhash64("doc_id", F.lit(7)))
    )
    chosen = None
    for value, most in ((0, 2 * limit), (1, limit)):
        part = clear.where(F.col("toxic") == value).orderBy("order", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen.drop("order"), "toxic-labels")  # three times ``limit`` rows at most, so broadcast
    found = text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    return materialize(found, "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fit the chain on a bounded sample of labelled rows (``limit`` toxic ones, twice as many clean ones).

    Besides ``toxic``, which the labels give, a toxic text is ``abusive`` if it holds two different lexicon
    words or more, and ``dense`` if they are more of its words than in the middle toxic text.
    Without toxic or without clean rows nothing can be learned, and no text is called toxic.
    """
    sample = labelled_sample(docs, labels, limit)
    n_toxic, n_clean = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n_toxic or not n_clean:
        return Chain(np.zeros(BUCKETS, np.float32), np.zeros(0, np.int64), [])
    odds = (F.col("toxic") + 0.5) / (n_toxic + 1.0) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = min(LEAST_TEXTS, max(1, n_toxic // 10))
    found = (
        evidence(sample)
        .where((F.col("toxic") >= least) & (odds >= LEAST_ODDS))
        .select("feature", "toxic", F.log(odds).alias("odds"))
        .orderBy(F.desc("toxic"), F.desc("odds"), "feature")
        .limit(LEXICON)
        .collect()
    )
    strength = np.zeros(BUCKETS, np.float32)
    strength[[r["feature"] for r in found]] = [r["odds"] for r in found]
    entries = np.sort(np.array([r["feature"] for r in found[:ENTRIES]], np.int64))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = measures(Words(batch.column(1)), strength, entries)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

        return each

    rows = sorted(map_texts(sample, make, "doc_id long, toxic int, x array<double>").collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows])
    toxic = np.array([r["toxic"] for r in rows], float)
    middle = np.median(x[toxic > 0, 3])
    y = {"abusive": toxic * (x[:, 2] >= 0.2), "dense": toxic * (x[:, 3] > middle), "toxic": toxic}
    fold = np.arange(len(rows)) % folds
    weights, earlier = [], np.zeros((len(rows), 0))
    for category in CATEGORIES:
        z = np.hstack([x, earlier])
        out = np.zeros(len(rows))
        for k in range(folds):
            inside = fold != k
            if inside.all() or not inside.any():
                continue
            w = logistic(z[inside], y[category][inside])
            out[~inside] = probability(np.hstack([z[~inside], np.ones(((~inside).sum(), 1))]), w)
        weights.append(logistic(z, y[category]))
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(strength, entries, weights)


def classify(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, a probability for each category and the verdict ``rejected`` of every row, and the columns in ``keep``.

    Null and empty texts hold no evidence and are kept; null ids stay null; repeated rows each
    give a row, and equal texts equal verdicts; whole texts are read however long they are; an empty table gives no rows. Other
    columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)  # its size is fixed by BUCKETS and ENTRIES

    def make():
        model = held.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1))
            x = model.measures(words)
            found = model.predict(x) if model.weights else np.zeros((batch.num_rows, len(CATEGORIES)))
            columns = [pa.array(found[:, k]) for k in range(len(CATEGORIES))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array((found[:, -1] >= threshold) & (x[:, 4] > 0)), *map(batch.column, keep)],
                ["doc_id", *CATEGORIES, "rejected", *keep],
            )

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in keep if c != "text"])
    own = [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in CATEGORIES), T.StructField("rejected", T.BooleanType())]
    return map_texts(rows, make, T.StructType([*own, *(rows.schema[c] for c in keep)]))


@query("op8_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return classify(docs, fit(docs, table(spark, folder, "labels")))
