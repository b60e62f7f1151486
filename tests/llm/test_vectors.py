import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle_check import connect, differences
from tidewatch.llm import embedding_dedup, hard_negatives
from tidewatch.llm.embedding_dedup import layout, meets, near_vectors
from tidewatch.llm.hard_negatives import curve, hard_negatives as mined

SCHEMA = "vec_id long, embedding array<float>, label int, row long, node long, key string, block int, unit int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, lab, 1, 2, "k", 3, 4) for i, v, lab in data], SCHEMA)


def clusters(seed, sizes, dim=24, noise=0.055):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(n):
            v = base + rng.standard_normal(dim) * (noise if n > 1 else 0)
            out.append([float(x) for x in np.float32(v * rng.uniform(0.5, 2))])
    return out


AWKWARD = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [1.0], [2.0], [1.0, 0.0]]


def linked(data, cosine=0.95):
    """Links counted and components by comparing all pairs."""
    sound = []
    for k, (i, v, _) in enumerate(data):
        if v and None not in v and all(math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            sound.append((k, i, x / np.linalg.norm(x)))
    near = defaultdict(set)
    for a, (k, _, x) in enumerate(sound):
        for m, _, y in sound[a + 1 :]:
            if len(x) == len(y) and x @ y >= cosine:
                near[k].add(m)
                near[m].add(k)
    out, done = {}, set()
    for k in range(len(data)):
        if k in done:
            continue
        group, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - group:
                group.add(m)
                todo.append(m)
        done |= group
        ids = [data[m][0] for m in group if data[m][0] is not None]
        for m in group:
            out[m] = (len(near[m]), min(ids) if ids else None)
    return sorted(((data[k][0], *out[k]) for k in out), key=str)


def results(df):
    rows = df.collect()
    for r in rows:
        assert r["kept"] == (r["component_id"] is None or r["vec_id"] == r["component_id"])
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("noise", [0.02, 0.035, 0.05, 0.08])
def test_clusters_of_every_tightness(spark, noise):
    """Tight clusters are balls, loose ones are fringes and chains; every link and count as by brute force."""
    found = clusters(1, [150, 60, 9, 3, 2] + [1] * 80, noise=noise)
    found += [v for v in found[:3] for _ in range(40)] + [[2 * x for x in found[0]]]
    rng = random.Random(2)
    data = [(i if i != 50 else None, v, 0) for i, v in enumerate(found + AWKWARD)]
    data += [(7, found[200], 0), (7, found[5], 0)]
    rng.shuffle(data)
    assert results(near_vectors(frame(spark, data), miss=1e-5)) == linked(data)


def test_crowded_buckets_are_hashed_again(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CROWD", 12)
    found = clusters(3, [120, 40] + [1] * 30, noise=0.06)
    data = [(i, v, 0) for i, v in enumerate(found)]
    assert results(near_vectors(frame(spark, data), miss=1e-5)) == linked(data)


def test_recall_at_the_cosine(spark):
    """Pairs at the wanted cosine and just above and below it, one pair in each direction."""
    rng, data = np.random.default_rng(4), []
    for k in range(400):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        side = rng.standard_normal(64)
        side -= side @ base * base
        side /= np.linalg.norm(side)
        cosine = [0.9501, 0.9499, 0.96, 0.94][k % 4]
        other = cosine * base + math.sqrt(1 - cosine * cosine) * side
        data += [(2 * k, [float(x) for x in base], 0), (2 * k + 1, [float(x) for x in other], 0)]
    want, got = linked(data), results(near_vectors(frame(spark, data)))
    assert sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in want)
    assert all(n <= m for (_, n, _), (_, m, _) in zip(got, want, strict=True))


def test_layout_follows_the_number_of_vectors():
    width = layout(10)[2]
    assert 0 < meets(math.sqrt(2), width) < meets(0.3, width) < 1
    few, many = layout(1000), layout(1_000_000)
    assert few[0] < many[0] and few[1] < many[1]
    near = math.sqrt(0.1)
    for projections, tables, _ in (few, many):
        assert (1 - meets(near, width) ** projections) ** tables <= 1e-3


def test_no_vectors(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert mined(frame(spark, [])).count() == 0
    assert results(near_vectors(frame(spark, [(1, None, 0), (None, [], 0)]))) == [(1, 0, 1), (None, 0, None)]


def brute(data, every=100):
    sound = []
    for k, (i, v, label) in enumerate(data):
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        sound.append((k, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, i, label, x in sound:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, m, other) for m, j, other, y in sound if m != k and len(x) == len(y)]
        scored.sort()
        for s, j, _, _ in [r for r in scored if r[3] == label][:5]:
            fit = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, rank, r[1], -s, -r[0]) for rank, r in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [[float(x) for x in np.float32((centres[k % 6] + spread * rng.standard_normal(dim)) / math.sqrt(dim))] for k in range(n)]


@pytest.mark.parametrize("spread", [0.1, 1.0, 3.0])
def test_hard_negatives_by_brute_force(spark, spread):
    """Small blocks and groups, so that zone maps choose among many; also rows that take no part, and ties."""
    rng = random.Random(5)
    data = [(i, v, rng.choice([0, 0, 0, 1, 2, None])) for i, v in enumerate(vectors(6, 700, 12, spread))]
    data += [(1000 + k, data[k % 3][1], k % 4) for k in range(60)]
    data += [(2000 + 10 * k, v, 0) for k, v in enumerate(AWKWARD)] + [(None, data[0][1], 0)]
    data += [(3000 + k, [0.5, -0.25], k % 2) for k in range(0, 20)] + [(4000, [], 0), (4001, [], 0), (4002, [], 1)]
    rng.shuffle(data)
    got = mined(frame(spark, data).repartition(3), every=10, block=16, group=3).collect()
    assert sorted(tuple(r) for r in got) == brute(data, 10)


def test_rows_that_share_an_id(spark):
    data = [(100, [1.0, 0.5], 1), (100, [0.5, 1.0], 1), (100, [1.0, 1.0], 2), (7, [1.0, 0.4], 2), (8, [0.9, 0.5], 1)]
    got = mined(frame(spark, data)).collect()
    assert sorted(tuple(r) for r in got) == brute(data)


def test_large_components_stay_exact(spark):
    data = [(i, [float(60_000 - i), float(30_000 + 7 * i), -1.5], i % 3) for i in range(40)] + [(41, [70_000.0, 0.0, 0.0], 1)]
    got = mined(frame(spark, data), every=10).collect()
    assert sorted(tuple(r) for r in got) == brute(data[:-1], 10)


def test_neighbours_on_the_curve_are_neighbours_in_space():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 4), -1).reshape(-1, 4)
    keys = curve(grid, 2)
    order = sorted(range(len(grid)), key=lambda k: keys[k])
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_leave_blocks_out(spark):
    """Tight clusters: an anchor's window meets few blocks."""
    data = [(i, v, i % 6) for i, v in enumerate(vectors(8, 3000, 8, 0.02))]
    blocks = hard_negatives.stored(hard_negatives.keyed(frame(spark, data)), 100, 32, 2)
    zones = hard_negatives.zone_maps(blocks)
    groups = hard_negatives.group_zones(zones)
    assert zones.count() >= 3000 / 32 and zones.agg(F.countDistinct("block")).first()[0] == zones.count()
    asking = blocks.where("vec_id % 100 = 0").select(F.col("group").alias("chunk"), "row", "label", "dim", "vector", F.array("seed").alias("lows"), F.array(F.lit(1 << 62)).alias("highs"))
    assert hard_negatives.pairs(asking, groups, False).count() < 0.5 * asking.select("chunk").distinct().count() * groups.count()


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_hard_negatives"])
def test_query_agrees_with_sql(spark, small, name):
    assert differences(spark, small, connect(small), name) is None
