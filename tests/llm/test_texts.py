import hashlib
import math
import random
import re
import statistics
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import LONG, LOWER, documents, empty, frame, rows, words
from tidewatch.llm import QUERIES
from tidewatch.llm.context_trees import scored
from tidewatch.llm.quality import BYTE_VOCABULARY, COUNTS, PIECE_VOCABULARY, Fertility, bands, measures, quality_rules
from tidewatch.llm.spotsigs import ANCHORS, Spots, edited_fingerprints, fingerprints, similar, with_neighbours
from tidewatch.llm.token_counts import Vocabulary, token_counts, vocabulary_path
from tidewatch.llm.toxicity import classify, fit, labelled_sample

VOCABULARY = vocabulary_path("byte_bpe_50k.json")


def test_token_counts_are_the_library_s(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for out, texts in (
        (QUERIES["op6_token_counts"](spark, small).collect(), documents(spark, small)),
        (token_counts(frame(spark), VOCABULARY).collect(), [(r[0], r[1]) for r in rows()]),
    ):
        want = [
            (i, len(b := (t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts
        ]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)
    assert token_counts(empty(spark), VOCABULARY).count() == 0


def test_whole_tokens_are_one_token_each():
    library = Tokenizer.from_file(VOCABULARY)
    whole = sorted(Vocabulary(VOCABULARY).whole_tokens())
    assert len(whole) > 49_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole, add_special_tokens=False))


def base_measures(text):
    found = words(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    seen = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            seen |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return (
        len(found),
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(seen),
    )


def test_quality_rules(spark, small):
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    texts = dict(documents(spark, small))
    out = QUERIES["op3_quality_rules"](spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        want = base_measures(texts[r["doc_id"]])
        assert tuple(r[c] for c in counts) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [r for r in out if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)


def test_quality_rules_part_noise_from_clean_texts(spark):
    """Of labelled texts that pass the base rules; entropy is held against texts of the same length."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op3_quality_rules"](spark, folder).join(labels, "doc_id").where("not base_failed").collect()
    low, clean = [r for r in out if r["quality"] == 0], [r for r in out if r["quality"] == 1]
    assert len(low) > 10 and sum(not r["kept"] for r in low) >= 0.9 * len(low)
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    order = sorted(clean, key=lambda r: r["n_tokens"])
    short, long = ([r["evenness"] for r in part] for part in (order[: len(order) // 4], order[-(len(order) // 4) :]))
    assert abs(statistics.mean(short) - statistics.mean(long)) < statistics.stdev(short)


def test_quality_rules_keep_texts_beside_many_copies(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and doc_id < 300").collect()]
    data = [(i, t, "en") for i, t in enumerate(texts + texts[:1] * 500)]
    paths = vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY)
    alone, beside = (
        {r["doc_id"] for r in quality_rules(spark.createDataFrame(d, "doc_id long, text string, lang string"), *paths).where("kept").collect()}
        for d in (data[: len(texts)], data)
    )
    assert alone == {i for i in beside if i < len(texts)}


def test_quality_rules_of_awkward_rows(spark):
    paths = vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY)
    out = quality_rules(frame(spark), *paths).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows())
    by_id = {r["doc_id"]: r for r in out}
    for i in (3, 4, 5):
        assert by_id[i]["n_words"] == 0 and by_id[i]["base_failed"] and not by_id[i]["kept"]
    assert by_id[8]["n_words"] == len(words(LONG)) and by_id[8]["base_failed"]
    assert quality_rules(empty(spark), *paths).count() == 0


def spark_hash(text):
    if text is None:
        return 42
    found = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return found - (1 << 64) if found >> 63 else found


def test_neighbours_across_many_ranges(spark):
    """Ranges of three rows, an id and the null id that fill many of them, and ids far apart."""
    rng = random.Random(8)
    ids = [None] * 40 + [5] * 50 + [-(1 << 62), 1 << 62] + [rng.randrange(10**9) for _ in range(60)]
    data = [(i, f"text {k} " + "the quick brown fox " * (k % 5)) for k, i in enumerate(ids)]
    rng.shuffle(data)
    out = with_neighbours(spark.createDataFrame(data, "doc_id long, text string"), range_rows=3).collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]), r[1]))
    found = sorted((r["range"], r["guest"], r["doc_id"] is not None, r["doc_id"] or 0, spark_hash(r["text"]), r["text"]) for r in out)
    own = [r for r in found if not r[1]]
    assert [r[5] for r in own] == [t for _, t in order]
    for k, row in enumerate(own):
        follows = found[found.index(row) + 1]
        assert follows[0] == row[0] and follows[5] == order[(k + 1) % len(order)][1]
    assert len({r[0] for r in own}) > 10


def test_a_pair_exactly_at_the_likeness(spark):
    """55 of 100, 4 of 5 and a third: thresholds that doubles miss by a digit."""
    for least, n, both in ((0.55, 100, 55), (0.8, 5, 4), (0.3, 10, 3), (0.07, 100, 7), (1, 4, 4)):
        prints = spark.createDataFrame([(1, list(range(n))), (2, list(range(both)))], "doc_id long, fingerprint array<long>")
        _, pairs = similar(prints, least)
        assert [(r["class_id"], r["other"]) for r in pairs.collect()] == ([(1, 2)] if both < n else [])
        _, above = similar(prints, min(1, least + 0.001))
        assert above.count() == 0


def test_similar_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r["doc_id"]: frozenset(r["fingerprint"]) for r in fingerprints(docs).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    links = Counter()
    held = list(first)
    for k, a in enumerate(held):
        for b in held[k + 1 :]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op5_spotsigs_similar"](spark, small).collect()}
    assert got == {i: (first[s], links[s]) for i, s in sets.items()}


def test_signatures_by_their_definition(spark):
    """Anchors, chains of content words and the fallback, spelled out with lists."""
    anchors = {w for line in ANCHORS.values() for w in line.split()}
    texts = [r[1] or "" for r in rows()] + ["the big dog. And a cat of mine, was here in old town", "keine Anker hier nur Wörter"]
    texts += [f"{a} one two three four" for a in sorted(anchors)[:20]]
    spelled = lambda t: [w.lower() if w.isascii() else w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
    kinds = {}
    for text, mine in zip(texts, Spots().of(pa.array(texts))):
        found = spelled(text)
        content = [k for k, w in enumerate(found) if w not in anchors]
        want = set()
        for k, w in enumerate(found):
            after = [c for c in content if c > k]
            if w in anchors and len(after) >= 3:
                want.add((w, *(found[c] for c in after[:3])))
        want = want or ({("all", *found)} if found else set())
        assert len(mine) == len(want)
        for chain in want:
            kinds.setdefault(chain, set()).add(tuple(mine) if len(want) == 1 else None)
    # The same chain has the same signature wherever it stands alone.
    assert all(len(v - {None}) <= 1 for v in kinds.values())


def test_token_measures_are_the_libraries(spark, small):
    """Characters per token, byte share and entropy of whole texts, word by word with the libraries."""
    paths = vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY)
    pieces = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    bytes_ = Fertility(*paths).bytes
    data = documents(spark, small)[:60] + [(r[0], r[1]) for r in rows() if r[0] not in (8, 9)]
    docs = spark.createDataFrame([(k, t, "en") for k, (_, t) in enumerate(data)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in measures(docs, *paths, F.col("lang")).collect()}
    for k, (_, text) in enumerate(data):
        own, r = words(text), found[k]
        tokens = [t for w in own for t in bytes_.encode_ordinary(" " + w)]
        split = [p for w in own for p in pieces.encode(w)]
        assert (r["n_tokens"], r["n_pieces"], r["n_raw"]) == (len(tokens), len(split), sum(pieces.is_byte(p) for p in split))
        assert r["word_chars"] == sum(map(len, own))
        shares = [n / len(tokens) for n in Counter(tokens).values()]
        assert r["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9)


def test_bands_by_their_definition(spark):
    """Line of entropy and Tukey's outer fences of a group, with numpy."""
    folder = "/root/testdata/sf0.01"
    paths = vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY)
    measured = measures(spark.read.parquet(f"{folder}/documents.parquet"), *paths, F.col("lang")).collect()
    got = {r["group"]: r for r in bands(spark.createDataFrame(measured)).collect()}
    for lang in ("en", "de", "fr", "es"):
        mine = {tuple(r[c] for c in (*COUNTS, "entropy")) for r in measured if r["group"] == lang and r["n_words"] >= 50 and 2 * r["n_repeat_words"] <= r["n_words"]}
        t = np.array(sorted(mine))
        tokens, entropy = t[:, 5], t[:, 8]
        short = 1 / np.sqrt(tokens)
        slope, level = np.polyfit(short, entropy, 1)
        assert (got[lang]["slope"], got[lang]["level"]) == (pytest.approx(slope, rel=1e-3), pytest.approx(level, rel=1e-3))
        for name, values, middle in (
            ("chars_per_token", t[:, 1] / tokens, None),
            ("evenness", entropy - got[lang]["level"] - got[lang]["slope"] * short, entropy.mean()),
        ):
            low, mid, high = np.quantile(values, [0.25, 0.5, 0.75])
            floor = max(abs(mid if middle is None else middle) * 0.05, 0.02)
            assert got[lang][f"{name}_low"] == pytest.approx(min(low - 3 * (high - low), mid - floor), abs=1e-6)
            assert got[lang][f"{name}_high"] == pytest.approx(math.inf if name == "evenness" else max(high + 3 * (high - low), mid + floor), abs=1e-6)


def test_edited_texts(spark, small):
    for out, texts in (
        (QUERIES["op5_spotsigs"](spark, small).collect(), documents(spark, small)),
        (edited_fingerprints(frame(spark)).collect(), [(r[0], r[1]) for r in rows()]),
    ):
        order = sorted(((-(1 << 63) if i is None else i, spark_hash(t), (t or "").encode()), i, t or "") for i, t in texts)
        want = []
        for k, (_, i, text) in enumerate(order):
            half = len(text) // 2
            edited = text[: len(text) - half] + order[(k + 1) % len(order)][2][:half]
            want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in out)
        prints = defaultdict(set)
        for r in out:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            a, b = set(r["fingerprint"].split()), set(r["edited_fingerprint"].split())
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a and b else float(len(a) == len(b)))
            prints[r["edited_sha256"]].add(r["edited_fingerprint"])
        assert all(len(p) == 1 for p in prints.values())
    assert edited_fingerprints(empty(spark)).count() == 0


def test_similar_fingerprints_are_complete(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r["doc_id"]: frozenset(r["fingerprint"]) for r in fingerprints(docs).collect()}
    classes, pairs = similar(fingerprints(docs), 0.3)
    named = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert all(sets[i] == sets[c] and c <= i for i, c in named.items()) and len(set(named.values())) == len(set(sets.values()))
    keys, want = sorted(set(named.values())), set()
    for k, i in enumerate(keys):
        for j in keys[k + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.3 * len(sets[i] | sets[j]):
                want.add((i, j))
    assert {(r["class_id"], r["other"]) for r in pairs.collect()} == want


def test_toxicity_on_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(out) == 1000 and all(0 <= r["toxic"] <= 1 for r in out.values())
    toxic = [i for i, t in labels.items() if t]
    assert sum(out[i]["rejected"] for i in toxic) >= 0.65 * len(toxic)
    assert not any(out[i]["rejected"] for i, t in labels.items() if not t)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = fit(docs, labels.where("doc_id % 3 != 0"))
    out = {r["doc_id"]: r["rejected"] for r in classify(docs, chain).collect()}
    held = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 3 = 0").collect()}
    toxic, clean = [i for i, t in held.items() if t], [i for i, t in held.items() if not t]
    assert sum(out[i] for i in toxic) >= 0.9 * len(toxic)
    assert sum(out[i] for i in clean) <= 0.005 * len(clean)


def test_labels_of_other_documents_take_no_places(spark):
    docs = frame(spark, [(i, "some text", "en", "a", None, 7, "k", 1, 2, 3, "b") for i in range(6)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["toxic"] for r in labelled_sample(docs, labels, 3).collect()}
    assert found == {i: int(i % 2 == 0) for i in range(6)}


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (6, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    out = classify(frame(spark), fit(frame(spark), labels)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows())
    none = fit(frame(spark), labels.where("toxic = 0"))
    assert not any(r["rejected"] for r in classify(frame(spark), none).collect())
    assert classify(empty(spark), fit(empty(spark), labels)).count() == 0


def tree_scores(texts, depth):
    """Context-tree weighting by its definition, with dictionaries."""

    def steps(text):
        data = b"\0" * depth + (text or "").translate(LOWER).encode() + b"\xff"
        for p in range(depth, len(data)):
            for i in range(8):
                yield data[p - depth : p], (1 << i) | (data[p] >> (8 - i)), (data[p] >> (7 - i)) & 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    seen = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    for i, text in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for context, node, bit in steps(text):
                for d in range(depth + 1):
                    seen[d][context[depth - d :], node][bit] += 1
    below = [defaultdict(float) for _ in range(depth + 1)]
    for d in range(depth, 0, -1):
        for (context, node), n in seen[d].items():
            alone, rest = kt(n), below[d][context, node]
            high = max(alone, rest)
            whole = alone if d == depth else high + math.log(math.exp(alone - high) + math.exp(rest - high)) - math.log(2)
            below[d - 1][context[1:], node] += whole
    out = []
    for _, text in texts:
        total = 0.0
        for context, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                key = context[depth - d :], node
                if key in seen[d]:
                    n = seen[d][key]
                    own = (n[1] + 0.5) / (sum(n) + 1)
                    if p is None:
                        p = own
                    else:
                        share = 1 / (1 + math.exp(min(700, below[d][key] - kt(n))))
                        p = share * own + (1 - share) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def base_scores(texts):
    tokens = [(i, [*words((t or "").translate(LOWER)), None]) for i, t in texts]
    counts = Counter()
    for i, found in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(found)
    n, kinds = sum(counts.values()), len(counts)
    return n, [(len(f), sum(counts[w] > 0 for w in f), sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in f)) for _, f in tokens]


@pytest.mark.parametrize("held", [(1 << 19, 1 << 18), (200, 30)])
def test_scores(spark, small, held):
    """The small tables make nearly all runs and words go through the joins."""
    texts = [(i, t[:300]) for i, t in documents(spark, small)[:30]] + [(200, ""), (201, None), (None, "no id"), (3, "again"), (201, None)]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in texts], "doc_id long, text string, log double, n int")
    out = sorted(scored(docs, 3, *held).collect(), key=lambda r: (str(r["doc_id"]), r["score"]))
    n, base = base_scores(texts)
    want = sorted(zip(texts, base, tree_scores(texts, 3)), key=lambda w: (str(w[0][0]), w[2]))
    assert len(out) == len(want)
    for r, ((i, _), b, score) in zip(out, want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, b[0], b[1], n)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(b[2], rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)


def test_scores_of_no_rows(spark):
    assert scored(empty(spark)).count() == 0
