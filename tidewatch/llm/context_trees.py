"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a node of its own in every context of 0 to ``DEPTH`` preceding
bytes. A node's Krichevsky-Trofimov estimate is weighted against the product of its children, the same
decision in the contexts one byte longer, from the deepest contexts up; the weights then give the
probability of every byte after every context, a mixture over all depths. A context
that training never met has no estimate and takes that of the longest part of it that training did meet.

Counting and weighting are aggregates over the distinct byte runs of the corpus, level by level. Scoring needs
a run's log probability at each byte. The most frequent runs and words (a fixed number) are
broadcast; all others are looked up by a join, which meets no frequent key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.arrays import LOWER, Words, mix, utf8
from tidewatch.llm.base import query, slices, table
from tidewatch.session import materialize

DEPTH = 5
#: Byte runs and words that are broadcast; both tables have this size at any size of the corpus.
FREQUENT_RUNS, FREQUENT_WORDS = 1 << 19, 1 << 18
#: Distinct keys a counting task holds before it hands them on.
HELD = 1 << 20
FOLDS, HELD_OUT = 7, 2
#: Ends every text, as a byte no UTF-8 text has, and as a word.
END = 0xFF
END_WORD = np.uint64(0xE4D0F7E87)


def runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each byte of each text and its end, with the ``depth`` bytes before it (0 before the start), as one number."""
    lengths = np.diff(offsets)
    n = len(lengths)
    padded = np.zeros(len(data) + n * (depth + 1), np.uint64)
    ends = offsets[1:] + (np.arange(n) + 1) * (depth + 1)
    padded[np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, lengths)] = data
    padded[ends - 1] = END
    found = np.zeros(max(0, len(padded) - depth), np.uint64)
    for k in range(depth + 1):
        found = found << np.uint64(8) | padded[k : k + len(found)]
    real = np.ones(len(padded), bool)
    for k in range(depth):
        real[ends - lengths - 1 - depth + k] = False
    return found[real[depth:]]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and the text each belongs to."""
    words = Words(texts)
    n = len(words.first) - 1
    return np.concatenate((words.hashes(), np.full(n, END_WORD))), np.concatenate((words.doc, np.arange(n)))


def counted(docs: DataFrame, depth: int) -> DataFrame:
    """``kind, key, trained, n``: how often each byte run (kind 0) and word (kind 1) occurs, in training texts and in all.

    Input columns: held_out, text. Every task adds up what it meets before anything is shuffled.
    """

    def tally(keys: np.ndarray, trained: np.ndarray, all_of: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return keys, trained, all_of
        return keys[first], np.add.reduceat(trained[order], first), np.add.reduceat(all_of[order], first)

    def once(keys: np.ndarray, trained: bool):
        kinds, n = np.unique(keys, return_counts=True)
        return kinds, n if trained else np.zeros_like(n), n

    def run(batches):
        held = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def handed(kind):
            parts = held[kind]
            keys, trained, n = tally(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
            return keys, trained, n

        def record(kind, keys, trained, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(trained), pa.array(n)],
                ["kind", "key", "trained", "n"],
            )

        for batch in batches:
            for part in slices(batch):
                out = np.asarray(part.column(0)).astype(bool)
                for trained in (True, False):
                    rows = np.flatnonzero(out != trained)
                    if not len(rows):
                        continue
                    texts = part.column(1).take(pa.array(rows))
                    data, offsets = utf8(texts)
                    for kind, keys in ((0, runs(LOWER[data], offsets, depth)), (1, words_of(texts)[0])):
                        held[kind].append(once(keys, trained))
                        size[kind] += len(held[kind][-1][0])
                        if size[kind] > HELD:
                            merged = handed(kind)
                            if len(merged[0]) > HELD // 2:
                                yield record(kind, *merged)
                                held[kind], size[kind] = [], 0
                            else:
                                held[kind], size[kind] = [merged], len(merged[0])
        for kind in (0, 1):
            if held[kind]:
                yield record(kind, *handed(kind))

    return docs.mapInArrow(run, "kind int, key long, trained long, n long").groupBy("kind", "key").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive column, by Stirling's series eight steps further on."""
    far = x + 8
    series = (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + 1 / (12 * far) - 1 / (360 * far * far * far)
    low = x
    for k in range(1, 8):
        low = low * (x + k)
    return series - F.log(low)


def estimate() -> Column:
    """Log of the Krichevsky-Trofimov probability of ``n`` decisions of which ``ones`` are 1."""
    return log_gamma(F.col("n") - F.col("ones") + 0.5) + log_gamma(F.col("ones") + 0.5) - math.log(math.pi) - log_gamma(F.col("n") + 1.0)


def decisions(found: DataFrame) -> DataFrame:
    """The eight decisions of each run: ``node`` is the context, then the bits decided so far behind a leading 1."""
    return found.withColumn("i", F.explode(F.array(*map(F.lit, range(8))))).withColumns(
        {
            "node": F.expr("(key >> 8 << 8) | (1L << i) | ((key & 255) >> (8 - i))"),
            "bit": F.expr("((key & 255) >> (7 - i)) & 1"),
        }
    )


def model(trained: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth, ``node, one``: the probability of a 1 if that node's is the longest context training met.

    ``trained``: ``key, trained`` of the byte runs met in training.
    """
    level = (
        decisions(trained)
        .groupBy("node")
        .agg(F.sum("trained").alias("n"), F.sum(F.col("trained") * F.col("bit")).alias("ones"))
        .withColumn("whole", estimate())
        .withColumn("own", F.lit(1.0))
    )
    levels = [materialize(level, f"tree-{depth}")]
    for d in range(depth - 1, -1, -1):
        level = (
            levels[0]
            .groupBy(F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("node"))
            .agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("whole").alias("below"))
            .withColumn("alone", estimate())
            .withColumn("high", F.greatest("alone", "below"))
            .withColumn("whole", F.col("high") + F.log(F.exp(F.col("alone") - F.col("high")) + F.exp(F.col("below") - F.col("high"))) - math.log(2))
            .withColumn("own", 1 / (1 + F.exp(F.least(F.col("below") - F.col("alone"), F.lit(700.0)))))
            .select("node", "n", "ones", "whole", "own")
        )
        levels.insert(0, materialize(level, f"tree-{d}"))
    out, above = [], None
    for d in range(depth + 1):
        here = levels[d].withColumn("kt", (F.col("ones") + 0.5) / (F.col("n") + 1.0))
        if above is None:
            here = here.withColumns({"mixed": F.lit(0.0), "left": F.lit(1.0)})
        else:
            shorter = above.select(F.col("node").alias("parent"), F.col("then").alias("mixed"), F.col("rest").alias("left"))
            here = here.withColumn("parent", F.col("node").bitwiseAND((1 << 8 * d) - 1)).join(shorter, "parent").drop("parent")
        above = materialize(
            here.select(
                "node",
                (F.col("mixed") + F.col("left") * F.col("kt")).alias("one"),
                (F.col("mixed") + F.col("left") * F.col("own") * F.col("kt")).alias("then"),
                (F.col("left") * (1 - F.col("own"))).alias("rest"),
            ),
            f"tree-down-{d}",
        )
        out.append(above.select("node", "one"))
    return out


def log_probabilities(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``key, n, log``: log10 of the probability of each run's last byte after the others."""
    depth = len(levels) - 1
    open_bits = decisions(found.select("key", "n")).select("key", "n", "node", "bit")
    parts = None
    for d in range(depth, -1, -1):
        here = levels[d].withColumnRenamed("node", "at")
        joined = materialize(
            open_bits.join(here, F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1) == F.col("at"), "left").drop("at"), f"run-bits-{d}"
        )
        known = joined.where("one is not null").withColumn("log", F.log10(F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))))
        known = known.select("key", "n", "log")
        parts = known if parts is None else parts.unionByName(known)
        open_bits = joined.where("one is null").drop("one")
        if not open_bits.head(1):
            break
    else:
        parts = parts.unionByName(open_bits.select("key", "n", F.lit(math.log10(0.5)).alias("log")))
    return parts.groupBy("key").agg(F.max("n").alias("n"), F.sum("log").alias("log"))


class Lookup:
    """Values by 64-bit key: one probe for most keys, bisection for those that share a probe. Most frequent keys last."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slots[(mix(keys) >> self.shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.values = keys, values
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.slots[(mix(keys) >> self.shift).astype(np.int64)]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        if len(wrong):
            place = np.minimum(np.searchsorted(self.sorted, keys[wrong]), len(self.sorted) - 1)
            at[wrong] = np.where(self.sorted[place] == keys[wrong], self.order[place], -1)
        return at


def frequent(found: DataFrame, most: int, value: str) -> Lookup:
    """Up to ``most`` of the most frequent keys with their values, on the driver.

    Keys are counted by classes of frequency an eighth of a doubling wide, and whole classes are taken from the top while
    they fit, so no task ranks keys. What isn't taken is looked up by joins.
    """
    kind = F.floor(F.log2(F.col("n").cast("double")) * 8)
    least = None
    for r in sorted(found.groupBy(kind.alias("kind")).count().collect(), key=lambda r: -r["kind"]):
        most -= r["count"]
        if most < 0:
            break
        least = r["kind"]
    top = (found.where(kind >= least) if least is not None else found.limit(0)).select("key", "n", value).toArrow()
    order = np.lexsort((top.column("key").to_numpy(), top.column("n").to_numpy()))
    keys = top.column("key").to_numpy().astype(np.int64).view(np.uint64)
    return Lookup(keys[order], top.column(value).to_numpy()[order])


def scored(docs: DataFrame, depth: int = DEPTH, runs_held: int = FREQUENT_RUNS, words_held: int = FREQUENT_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every whole text.

    Training texts are those whose crc32 of the id as text, modulo 7, isn't 2; a null id counts as empty text.
    A null text is an empty one: its end alone is scored. Repeated rows are texts of their own, in training too.
    An empty table gives no rows; without training texts every decision has probability 1/2. A to Z are lower-cased for
    both scores. Other columns aren't read. ``score`` is log10 of the probability of the bytes and the end of the text,
    ``bits_per_byte`` its code length for each of them.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = materialize(counted(texts.select("held_out", "text"), depth), "run-counts")
    words = counts.where("kind = 1").drop("kind")
    found = counts.where("kind = 0").drop("kind")
    total, kinds = words.where("trained > 0").agg(F.sum("trained"), F.count(F.lit(1))).first()
    total = total or 0
    levels = model(found.where("trained > 0").select("key", "trained"), depth)
    logs = materialize(log_probabilities(found, levels), "run-logs")
    known = words.where("trained > 0").select("key", F.col("trained").alias("n"), F.log10(F.col("trained") + 1.0).alias("log"))
    held = docs.sparkSession.sparkContext.broadcast((frequent(logs, runs_held, "log"), frequent(known, words_held, "log")))

    def run(batches):
        byte_logs, word_logs = held.value

        def rest(keys: np.ndarray, owner: np.ndarray, n: int):
            """Keys to look up elsewhere, as a list with counts for each text."""
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((new, [len(keys)])))
            bounds = np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(times)], ["key", "times"])
            return pa.ListArray.from_arrays(pa.array(bounds), items)

        for batch in batches:
            for part in slices(batch, 2):
                n = part.num_rows
                column = part.column(2)
                data, offsets = utf8(column)
                keys = runs(LOWER[data], offsets, depth)
                at = byte_logs.find(keys)
                lengths = np.diff(offsets) + 1
                starts = np.cumsum(lengths) - lengths
                gained = np.where(at >= 0, byte_logs.values[at] if len(byte_logs.keys) else 0.0, 0.0)
                score = np.add.reduceat(gained, starts)
                missed = np.flatnonzero(at < 0)
                rare_runs = rest(keys[missed], np.searchsorted(starts, missed, side="right") - 1, n)
                spelled, owner = words_of(column)
                at = word_logs.find(spelled)
                there = at >= 0
                gained = np.where(there, word_logs.values[at] if len(word_logs.keys) else 0.0, 0.0)
                rare_words = rest(spelled[~there], owner[~there], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(3),
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(owner, weights=there, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(owner, weights=gained, minlength=n)),
                        pa.array(score),
                        pa.array(lengths),
                        rare_words,
                        rare_runs,
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "n_bytes", "rare_words", "rare_runs"],
                )

    rare = "array<struct<key: long, times: long>>"
    rows = materialize(
        texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            run,
            "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, n_bytes long, "
            f"rare_words {rare}, rare_runs {rare}",
        ),
        "scored-rows",
    )

    def looked_up(column: str, logs: DataFrame) -> DataFrame:
        each = rows.select("row", F.explode(column).alias("item")).select("row", "item.key", "item.times")
        return each.join(logs.select("key", "log"), "key").select("row", "times", (F.col("times") * F.col("log")).alias("log"))

    none = F.lit(0).cast("long")
    parts = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes")
    blank = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), none.alias("n_tokens")]
    for column, logs_of in (("rare_words", known), ("rare_runs", logs)):
        word = column == "rare_words"
        parts = parts.unionByName(
            looked_up(column, logs_of).select(
                "row",
                *blank,
                (F.col("times") if word else none).alias("n_known"),
                (F.col("log") if word else F.lit(0.0)).alias("base"),
                (F.lit(0.0) if word else F.col("log")).alias("score"),
                none.alias("n_bytes"),
            )
        )
    added = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")]
    whole = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *added)
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


@query("op9_context_trees")
def scored_query(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"))
