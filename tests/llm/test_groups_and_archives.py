import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.common import LOWER, SCHEMA, documents, empty, frame, rows, words
from tests.oracle_check import connect, rows_of
from tidewatch.llm import QUERIES, near_dedup, warc
from tidewatch.llm.base import n_words
from tidewatch.llm.components import components
from tidewatch.llm.mixing import mixture, taken
from tidewatch.llm.near_dedup import layout, near_duplicates, signatures
from tidewatch.llm.packing import LENGTHS, packed
from tidewatch.session import shared_folder


def sets(texts, size):
    out = []
    for i, text in texts:
        found = words((text or "").translate(LOWER))
        runs = [tuple(found[k : k + size]) for k in range(len(found) - size + 1)] if len(found) >= size else [tuple(found)] if found else []
        out.append((i, frozenset(runs)))
    return out


def groups(texts, size, percent):
    """Component of each id, by comparing every pair."""
    found = [(i, s) for i, s in sets(texts, size) if i is not None]
    root = {i: i for i, _ in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(found):
        for j, b in found[k + 1 :]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


def edited(rng, base, changes):
    out = list(base)
    for k in rng.sample(range(len(base)), changes):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_around_the_threshold(spark, size, percent):
    """Edits of a few texts, with likenesses on both sides of the threshold, and texts between two others."""
    rng, data = random.Random(5), []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(60):
            base = edited(rng, base, 1).split() if g == 5 else base
            data.append((len(data) + 20, edited(rng, base, rng.randrange(0, 14))))
    data += [(i, t) for i, t, *_ in rows() if i != 11]
    rng.shuffle(data)
    docs = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in data], "doc_id long, text string, n int, keys string, node int")
    want, counted = groups(data, size, percent), Counter(data)
    out = near_duplicates(docs, size, percent).collect()
    assert len(out) == len(data)
    lengths = {i: len(s) for i, s in sets(data, size)}
    for r in out:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], lengths[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    assert counted and len(set(want.values())) > 20


def test_groups_of_the_query(spark, small):
    out = {r["doc_id"]: r["component_id"] for r in QUERIES["op7_near_dedup"](spark, small).collect()}
    assert out == groups(documents(spark, small), 3, 85)
    assert near_duplicates(empty(spark)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (9, c)], "doc_id long, text string")
    out = near_duplicates(docs, 3, 85).collect()
    assert {r["doc_id"]: r["kept"] for r in out if r["doc_id"] in (1, 9)} == {1: True, 9: True}
    assert {r["component_id"] for r in out if r["doc_id"] == 7} == {1}


def test_a_link_of_one_row_of_an_id_is_a_link_of_all(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, ""), (7, b), (7, c), (8, c), (9, d), (6, ""), (None, b)], "doc_id long, text string")
    out = near_duplicates(docs, 3, 85).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {
        (1, 1, True), (5, 1, False), (7, 1, False), (8, 1, False), (9, 9, True), (6, 6, True), (None, 1, False)
    }


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(np.concatenate((common, own[:200]))), np.unique(np.concatenate((common, own[200:])))
    values = signatures(np.concatenate((a, b, a)), np.cumsum([0, len(a), len(b), len(a)]), 240)
    assert (values[0] == values[2]).all()
    assert abs((values[0] == values[1]).mean() - 0.6) < 0.12
    single = signatures(a[:1], np.array([0, 1]), 240)[0]
    assert sorted(single >> 32) == list(range(240))  # one element fills each slot at a step of its own
    for percent in (50, 80, 85, 100):
        r, n = layout(percent)
        assert r * n <= 256 and (1 - min(percent / 100, 1 - 1e-9) ** r) ** n <= 1e-7


def test_long_texts_are_signed_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = [0, 1, 40, 5000, 7, 3000]
    items, bounds = rng.integers(0, 2**63, sum(lengths), dtype=np.uint64), np.cumsum([0, *lengths])
    whole = signatures(items, bounds, 96)
    for part in (64, 1000):
        monkeypatch.setattr(near_dedup, "ELEMENTS", part)
        assert (signatures(items, bounds, 96) == whole).all()


def test_a_text_of_millions_of_words(spark):
    """One text far longer than the rest is signed and compared whole."""
    long = " ".join(f"w{k % 70_001}x{k}" for k in range(1_500_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of a few words")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 1, 3: 3}


def test_too_low_a_likeness_is_refused():
    with pytest.raises(ValueError, match="too few"):
        layout(3)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {i for i in root if i not in found}
    assert all(found[i] == top(i) for i in found) and all(sum(top(j) == i for j in root) == 1 for i in alone)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def pages():
    rng = random.Random(3)
    line = warc.VERSION
    fake = line + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    out = []
    for i in range(120):
        body = "x" * rng.randrange(0, 2500) + "é" * (i % 3)
        body = [body, body + line + "junk\r\n" + body, fake + body + fake + fake, "y" * 1500, line, "a" + line * 5][i % 6]
        out.append((i, f"http://a/{i}\r\nb", None if i % 50 == 0 else body))
    return out + [(5, "u", ""), (None, None, "z" * 2000), (400, "u", "z" * 2000), (None, "u", None)]


def want_pages(data):
    largest = {}
    for i, _, html in data:
        if len((html or "").encode()) >= 1000:
            largest[html] = max(largest.get(html, -1), -1 if i is None else i)
    out = []
    for i, _, html in data:
        body, best = (html or "").encode(), largest.get(html)
        again = best is not None and best != (-1 if i is None else i)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(map(str, out))


def test_archives_with_version_lines_in_payloads(spark):
    data = pages()
    df = spark.createDataFrame([(*r, 1, "n") for r in data], "page_id long, url string, html string, id int, next string").repartition(3)
    path = f"{shared_folder(spark)}/test-archives"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")  # records lie across splits
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        warc.write_archives(df, path)
        got = sorted(str(tuple(r)) for r in warc.read_archives(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == want_pages(data)


def test_archives_of_no_pages(spark):
    path = f"{shared_folder(spark)}/test-no-archives"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archive_query_agrees_with_sql(spark, small):
    df = QUERIES["op4_warc"](spark, small)
    con = connect(small)
    con.execute(entry.oracle_sql()["op4_warc"])
    names = [d[0] for d in con.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, con.fetchall())


def check_bins(out, sizes):
    parts, bins = defaultdict(list), defaultdict(list)
    for r in out:
        parts[r["doc_id"]].append(r)
        bins[r["bin"]].append(r)
    assert Counter({i: sum(r["part_size"] for r in p) for i, p in parts.items()}) == Counter({i: sum(s) for i, s in sizes.items()})
    for held in bins.values():
        held.sort(key=lambda r: r["offset"])
        at, length = 0, held[0]["length"]
        for r in held:
            assert r["length"] == length and r["offset"] == at
            at += r["part_size"]
        assert at <= length and all(n >= length or n < at for n in LENGTHS)  # no shorter length would do
    return sum(r["part_size"] for r in out) / sum(b[0]["length"] for b in bins.values())


def test_packing(spark, small):
    sizes = defaultdict(list)
    for i, t in documents(spark, small):
        sizes[i].append(len(words(t)))
    out = QUERIES["op10_packing"](spark, small).collect()
    assert check_bins(out, sizes) > 0.95
    sizes = defaultdict(list)
    for i, t, *_ in rows():
        sizes[i].append(len(words(t)))
    assert check_bins(packed(frame(spark), n_words(F.col("text"))).collect(), sizes) > 0
    assert packed(empty(spark), n_words(F.col("text"))).count() == 0


def test_pipeline_stage_by_stage(spark, small):
    """Each stage against a plain version of its rule on what the stage before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{shared_folder(spark)}/test-stage-{name.replace(' ', '-')}"
        stage(spark, tables[-1], small).write.mode("overwrite").parquet(path)
        tables.append(spark.read.parquet(path))
    start, ruled, clean, single, mixed, bins = tables
    assert all(t.columns == columns for t in tables[:-1])

    kept = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, small).where("kept").collect()}
    assert {r["doc_id"] for r in ruled.collect()} == kept
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    left = {r["doc_id"] for r in clean.collect()}
    assert left <= kept and len(kept - left) <= len(toxic) * 3

    texts = [(r["doc_id"], r["text"]) for r in clean.collect()]
    of = groups(texts, 5, 80)
    left = [r["doc_id"] for r in single.collect()]
    assert sorted(of[i] for i in left) == sorted(set(of.values()))

    times = {
        r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in taken(mixture(single, n_words(F.col("text")))).collect()
    }
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})

    sizes = defaultdict(list)
    for r in mixed.collect():
        sizes[r["doc_id"]].append(len(words(r["text"])))
    check_bins(bins.collect(), sizes)


def test_pipeline_decides_by_row(spark, small):
    """Null ids don't save a row, and an id shared with a rejected row doesn't cost one."""
    found = spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'").select("doc_id", "text").collect()
    passed = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, small).where("kept").collect()}
    good = [r["text"] for r in found if r["doc_id"] in passed and 100 < len(words(r["text"])) < 400][:40]
    assert len(good) > 10
    frames = lambda data: spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    data = [(i, t, "en", "a") for i, t in enumerate(good)]
    ruled = corpus_pipeline.rules(spark, frames(data + [(0, "too short", "en", "a"), (None, "short", "en", "a"), (None, good[1], "en", "a")]), small)
    assert Counter(r["text"] for r in ruled.collect()) == Counter(good + good[1:2])

    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    near = corpus_pipeline.near_dedup(spark, frames([(i, t, "en", "a") for i, t in ((None, a), (None, a + " end"), (3, a), (3, b), (None, c), (2, c), (None, ""))]), small)
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter([(None, a), (3, b), (None, c), (None, "")])

    sources = [(None if k % 2 else k, f"{t} {k}", "en", "abc"[k % 3]) for k, t in enumerate([a, b, c] * 40)]
    mixed = corpus_pipeline.mixing(spark, frames(sources), small)
    size = {(x, n): 0 for x in "abc" for n in (True, False)}
    for r in mixed.collect():
        size[r["source"], r["doc_id"] is None] += 1
    assert size["a", True] > 1.5 * 20 and size["c", True] < 20  # as the targets of the sources say


def test_pipeline_of_awkward_and_no_rows(spark, small):
    for docs in (frame(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_columns_of_the_awkward_table_clash_with_the_operators():
    assert {"size", "key", "row", "slot", "n", "bin"} <= {c.split()[0] for c in SCHEMA.split(", ")}
