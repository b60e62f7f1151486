import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.common import documents, empty, frame, words
from tests.oracle_check import connect, rows_of
from tidewatch.llm import QUERIES
from tidewatch.llm.base import n_words
from tidewatch.llm.mixing import mixture, shares, taken
from tidewatch.llm.sharding import shards


def mixed(df):
    return taken(mixture(df, n_words(F.col("text"))))


def test_mix_agrees_with_sql(spark, small):
    df = QUERIES["op1_mixing"](spark, small)
    con = connect(small)
    con.execute(entry.oracle_sql()["op1_mixing"])
    names = [d[0] for d in con.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, con.fetchall())


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    found = {r["source"]: r for r in shares(sizes).collect()}
    assert found["a"]["target"] == 30 and sum(r["target"] for r in found.values()) == pytest.approx(2015)
    assert found[None]["target"] == 15  # last in order, so of weight 5, and capped
    assert found["b"]["target"] == pytest.approx(2 * found["c"]["target"])


def test_mix_of_awkward_rows(spark):
    out = [tuple(r) for r in mixed(frame(spark)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    assert Counter(r[0] for r in out) == Counter(r[0] for r in frame(spark).select("doc_id").collect())
    assert all(0 <= r[5] <= 3 * r[2] for r in out)
    total, targets = sum(r[2] for r in out), {}
    by_source = defaultdict(int)
    for r in out:
        by_source[r[1]] += r[5]
        targets[r[1]] = r[4]
    assert sum(targets.values()) == pytest.approx(total)
    assert all(abs(by_source[s] - t) <= max(40, 0.02 * t) for s, t in targets.items())
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in mixed(frame(spark)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    assert mixed(empty(spark)).count() == 0


def test_segments_cover_what_they_take(spark):
    parts = mixture(frame(spark), n_words(F.col("text"))).where("slot is not null").collect()
    assert all(0 <= p["offset"] and p["offset"] + p["words"] <= p["size"] and p["words"] > 0 for p in parts)
    slots = defaultdict(set)
    for p in parts:
        slots[p["slot"]].add(p["sid"])
    assert all(len(s) == 1 for s in slots.values())  # one source for each slot


def test_shards(spark, small):
    out = QUERIES["op2_sharding"](spark, small).collect()
    texts = dict(documents(spark, small))
    assert len(out) == len(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(slots) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in out)


def test_a_hot_text_is_divided_and_others_stay_together(spark):
    data = [(i, "same text", "en", "a", None, 1, "k", 1, 1, 1, "b") for i in range(2000)]
    data += [(i, f"text {i // 2}", "en", "a", None, 1, "k", 1, 1, 1, "b") for i in range(2000, 6000)]
    out = shards(frame(spark, data)).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s - mean) for s in sizes.values()) < 0.05 * mean
    homes = defaultdict(set)
    for r in out:
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) == 1


def test_shards_of_awkward_rows(spark):
    out = shards(frame(spark)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in frame(spark).collect())
    assert {r["size"] for r in out if r["doc_id"] in (3, 4)} == {1}
    assert shards(empty(spark)).count() == 0


def test_words_are_counted_as_the_pattern_says(spark):
    got = {r["doc_id"]: r["n"] for r in frame(spark).select("doc_id", n_words(F.col("text")).alias("n")).collect()}
    assert got[7] == len(words("wörter über alle maßen     日本語のテキスト 🎉🎉 ok")) and got[4] == 0
