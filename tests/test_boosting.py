"""The booster against Spark's own, on rows of its own."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import blocks, boosting, models


@pytest.fixture(scope="module")
def training(spark):
    pick = random.Random(7)
    rows = []
    for _ in range(700):
        amount, kind = 100 * pick.random(), pick.choice("abcd")
        y = int((amount > 60 and kind != "a") != (pick.random() < 0.1))
        rows.append((amount, pick.random(), float(pick.randrange(5)), kind, pick.choice("xyz"), y))
    names = "Amount double, log_amount double, sender_out_degree double, Payment_type string, Payment_currency string, Is_laundering int"
    features = ["Amount", "log_amount", "sender_out_degree", "Payment_type", "Payment_currency"]
    prepared, encoded, n = models.weighted_training(spark.createDataFrame(rows, names).repartition(3), features)
    assert n == 700
    return prepared, encoded.cache()


def _estimator(**given):
    settings = dict(maxIter=12, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=3) | given
    return GBTClassifier(featuresCol="features", labelCol=S.TARGET, weightCol=models.WEIGHT, **settings)


@pytest.mark.parametrize("rows_per_block", [None, 100])
def test_the_trees_are_those_of_spark(spark, training, monkeypatch, rows_per_block):
    """By a single task, and by a job for each level of a tree with margins that are stored in between."""
    prepared, encoded = training
    if rows_per_block:
        monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", rows_per_block)
        monkeypatch.setattr(boosting, "TREES_PER_COPY", 10)
    layout = blocks.layout_of(prepared)
    held = blocks.stored_blocks(encoded, S.TARGET, models.WEIGHT, layout, rows_per_block)
    assert held.count() >= (7 if rows_per_block else 1)
    mine, theirs = boosting.fit(spark, _estimator(), held, layout), _estimator().fit(encoded)
    assert [t.numNodes for t in mine.trees] == [t.numNodes for t in theirs.trees]
    assert mine.treeWeights == theirs.treeWeights
    # Where two categories are left, splitting off either is the same; a column's slots together have the same importance.
    whole = lambda m: np.add.reduceat(m.featureImportances.toArray(), [0, 1, 2, *layout.starts])
    assert whole(mine) == pytest.approx(whole(theirs), abs=1e-6)
    score = lambda m: [r[0][1] for r in m.transform(encoded).select("probability").collect()]
    assert score(mine) == pytest.approx(score(theirs), abs=1e-6)


def test_rows_and_columns_are_sampled(spark, training):
    prepared, encoded = training
    layout = blocks.layout_of(prepared)
    held = blocks.stored_blocks(encoded, S.TARGET, models.WEIGHT, layout)
    sampled = boosting.fit(spark, _estimator(maxIter=3, subsamplingRate=0.5, featureSubsetStrategy="0.3"), held, layout)
    again = boosting.fit(spark, _estimator(maxIter=3, subsamplingRate=0.5, featureSubsetStrategy="0.3"), held, layout)
    assert [t.toDebugString.split("\n")[1:] for t in sampled.trees] == [t.toDebugString.split("\n")[1:] for t in again.trees]
    assert all(t.numNodes > 1 for t in sampled.trees)


def test_blocks_hold_the_vectors(spark, training):
    prepared, encoded = training
    layout = blocks.layout_of(prepared)
    want = sorted(tuple(r[0].toArray()) for r in encoded.select("features").collect())
    got = []
    for b in blocks.opened(blocks.stored_blocks(encoded, S.TARGET, models.WEIGHT, layout, 64)).collect():
        vectors = np.zeros((len(b["y"]), layout.width))
        for i, (values, codes) in enumerate(b["columns"]):
            vectors[:, i] = codes if values is None else values[codes]
        for start, top, slots in zip(layout.starts, layout.slots, b["slots"], strict=True):
            known = np.flatnonzero(slots < top)
            vectors[known, start + slots[known]] = 1.0
        got += [tuple(v) for v in vectors]
    assert sorted(got) == want


def test_columns_share_codes():
    packs = boosting.packing([32, 2, 6, 1, 5000, 32])
    assert sorted(c for members in packs for c, *_ in members) == [0, 1, 2, 3, 4, 5]
    assert [[c for c, *_ in members] for members in packs] == [[4], [0, 5, 1, 3], [2]]


def test_training_shuffles_no_encoded_rows(spark, training, monkeypatch):
    """Vectors used to be dealt anew and kept on disk once a task couldn't hold them."""
    prepared, encoded = training
    monkeypatch.setattr(models, "CELLS_PER_TASK", 10)
    monkeypatch.setattr(models, "in_bounded_parts", None)
    rows = encoded.select(F.lit(1.0).alias("Amount"), S.TARGET).withColumn("log_amount", F.rand(1))
    assert models.fit_booster(rows, ["Amount", "log_amount"], models.TrainingConfig(booster=models.BoosterConfig(trees=1))).stages


def test_rows_that_cannot_be_fitted_are_refused(spark, training):
    """As Spark's trees refuse them, and not taken for negatives."""
    prepared, encoded = training
    unlabelled = encoded.withColumn(S.TARGET, F.lit(None).cast("double"))
    endless = spark.createDataFrame([(DenseVector([float("inf"), 0.0]), 1.0, 1.0)], ["features", S.TARGET, models.WEIGHT])
    for rows, layout in ((unlabelled, blocks.layout_of(prepared)), (endless, blocks.Layout(2, ()))):
        with pytest.raises(Exception, match="must not"):
            blocks.stored_blocks(rows, S.TARGET, models.WEIGHT, layout)
