"""Quality rules by tokeniser fertility.

Public vocabularies measure a text: characters per token, share of tokens that are raw bytes of a
character the vocabulary doesn't know, and entropy of the token distribution. Natural text of one
language lies in narrow bands of these; symbol noise, shouting and repetition don't. The bands
are Tukey's outer fences of the texts that pass the base rules, per language (or script), over all
rows. Entropy is taken less what its language's texts of that length have.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.llm.arrays import Words
from tidewatch.llm.base import map_texts, query, table
from tidewatch.llm.token_counts import PRE_TOKEN, vocabulary_path
from tidewatch.plans.grouped import grouped_quantiles
from tidewatch.session import materialize

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MIN_WORDS = 50
#: A text whose words in repeated three-word windows are more than this share (in percent) fails.
REPEATED_PERCENT = 50
#: Texts of this length in tokens at least are held against the entropy band: shorter ones have fewer kinds of tokens.
ENTROPY_TOKENS = 50
#: A band ends so many quartile distances outside the quartiles (Tukey's outer fences, "far out"), and at least this
#: share of the median away from it, so that a group of near copies, which has no spread, doesn't reject all else.
FENCES, LEAST = 3.0, 0.05
#: Sums are taken over whole numbers of this fraction.
GRAIN = 1 << 20
#: Texts that lie next to each other in a quantile's piece, at least.
PIECE_ROWS = 2048
#: Words a task keeps the measures of.
CACHE = 400_000


def base_counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text: words, their characters, symbols, repeated lines, words in repeated windows."""
    n = len(words.first) - 1
    data, offsets = words.data, words.offsets
    upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    characters = upto((data & 0xC0) != 0x80)
    symbols = upto(SYMBOLS[data])
    lengths = characters[words.ends] - characters[words.starts]
    n_words = np.diff(words.first)
    per_word = np.concatenate(([0], np.cumsum(lengths)))
    window = np.zeros(max(0, len(hashes) - 2), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(3):
            window = window * np.uint64(0xD1342543DE82EF95) + hashes[k : k + len(window)]
    repeated, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b - a > 3:
            held = window[a : b - 2]
            order = np.argsort(held)
            same = held[order[1:]] == held[order[:-1]]
            if same.any():
                again = np.concatenate((order[1:][same], order[:-1][same]))
                seen = np.zeros(b - a, bool)
                for k in range(3):
                    seen[again + k] = True
                repeated[i] = seen.sum()
        low, high = np.searchsorted(breaks, offsets[i : i + 2])
        if high > low:
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            full = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
            lines[i] = len(full) - len(set(full))
    return {
        "n_words": n_words,
        "word_chars": per_word[words.first[1:]] - per_word[words.first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": lines,
        "n_repeat_words": repeated,
    }


class Fertility:
    """Token measures of words, kept for words seen before in the task (a bounded number)."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        with open(byte_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.raw = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.rows = np.zeros((0, 4), np.int64)  # tokens, pieces, raw bytes, where the tokens start
        self.tokens = np.zeros(0, np.int64)

    def learn(self, hashes: list[int], fresh: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in fresh]
        # Behind a space each, the words are encoded as one text; only a word's first token starts with the space.
        stream = np.array(self.bytes.encode_ordinary(" " + " ".join(texts)), np.int64)
        owner = np.cumsum(self.spaced[stream]) - 1
        if owner[0] or owner[-1] != len(texts) - 1:
            each = [self.bytes.encode_ordinary(" " + t) for t in texts]
            stream, owner = np.concatenate([np.array(i, np.int64) for i in each]), np.repeat(np.arange(len(each)), [len(i) for i in each])
        pieces = self.pieces.encode(texts, num_threads=1)
        lengths = np.bincount(owner, minlength=len(texts))
        spans = np.array([len(p) for p in pieces], np.int64)
        raw = np.concatenate(([0], np.cumsum(self.raw[np.concatenate([np.array(p, np.int64) for p in pieces])])))
        ends = np.cumsum(spans)
        starts = len(self.tokens) + np.cumsum(lengths) - lengths
        self.known.update(zip(hashes, range(len(self.rows), len(self.rows) + len(fresh))))
        self.rows = np.concatenate((self.rows, np.column_stack((lengths, spans, raw[ends] - raw[ends - spans], starts))))
        self.tokens = np.concatenate((self.tokens, stream))

    def measure(self, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
        n = len(words.first) - 1
        if len(self.known) > CACHE:
            self.clear()
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = kinds.tolist()
        unknown = [k for k, h in enumerate(keys) if h not in self.known]
        if unknown:
            text, at = words.data.tobytes(), first[unknown]
            self.learn([keys[k] for k in unknown], [text[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())])
        index = np.fromiter((self.known[h] for h in keys), np.int64, len(keys))[which]
        rows = self.rows[index]
        sums = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(rows[:, :3], axis=0)))
        each = sums[words.first[1:]] - sums[words.first[:-1]]
        lengths = rows[:, 0]
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = self.tokens[np.repeat(rows[:, 3], lengths) + place]
        held = np.sort(np.repeat(words.doc, lengths) * np.int64(1 << 20) + ids)
        new = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((new, [len(held)])))
        # Entropy of counts c that add up to t: log2(t) less the mean of log2(c).
        spread = np.bincount(held[new] >> 20, weights=times * np.log2(times), minlength=n)
        total = np.maximum(each[:, 0], 1)
        entropy = np.where(each[:, 0] > 0, np.log2(total) - spread / total, 0.0)
        return {"n_tokens": each[:, 0], "n_pieces": each[:, 1], "n_raw": each[:, 2], "entropy": entropy}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_pieces", "n_raw")


def measures(docs: DataFrame, byte_path: str, piece_path: str, group: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and token measures of every whole text, with ``doc_id``, ``group`` and the columns in ``keep``."""

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), group.cast("string").alias("group"), *[c for c in keep if c != "text"])
    kept = [f for f in rows.schema if f.name != "text" or "text" in keep]

    def make():
        fertility = Fertility(byte_path, piece_path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(batch.column(1), lower=False)
            hashes = words.hashes()
            found = base_counts(words, hashes) | fertility.measure(words, hashes)
            columns = [*(batch.column(f.name) for f in kept), *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(found["entropy"])]
            return pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *COUNTS, "entropy"])

        return each

    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    return map_texts(rows, make, T.StructType([*kept, *counts, T.StructField("entropy", T.DoubleType())]))


def base_failed(column=F.col) -> Column:
    return (column("n_words") < MIN_WORDS) | (100 * column("n_repeat_words") > REPEATED_PERCENT * column("n_words"))


def fertility_columns() -> dict[str, Column]:
    return {
        "chars_per_token": F.try_divide(F.col("word_chars").cast("double"), F.col("n_tokens")),
        "raw_share": F.try_divide(F.col("n_raw").cast("double"), F.col("n_pieces")),
        # Entropy rises with the number of tokens towards a limit; what it differs by from the group's line doesn't.
        "evenness": F.col("entropy") - F.col("level") - F.col("slope") * shortness(),
    }


def shortness() -> Column:
    """Entropy of a language's texts is close to a straight line in this, at any length."""
    return 1 / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))


def bands(measured: DataFrame, fences: float = FENCES, least: float = LEAST) -> DataFrame:
    """For each group, its line of entropy and what each measure may be: ``group, level, slope, <measure>_low, <measure>_high``.

    From all texts that pass the base rules, those with equal counts (copies) once. The share of raw bytes has no lower bound, and
    entropy no upper one: a text richer in tokens than usual isn't poor for it, and noise shows in the other measures.
    """
    quarter = [0.25, 0.5, 0.75]
    names = list(fertility_columns())
    texts = materialize(measured.where(~base_failed()).select("group", *COUNTS, "entropy").distinct(), "fertility-texts")
    # Sums of whole numbers: the line is the same in whatever order rows arrive.
    whole = texts.select("group", F.round(shortness() * GRAIN).cast("decimal(20,0)").alias("x"), F.round(F.col("entropy") * GRAIN).cast("decimal(20,0)").alias("y"))
    total = lambda c: F.sum(c.cast("decimal(22,0)")).cast("decimal(34,0)")
    x, y = F.col("x").cast("decimal(11,0)"), F.col("y").cast("decimal(11,0)")
    sums = whole.groupBy("group").agg(F.count(F.lit(1)).alias("n"), total(x).alias("sx"), total(y).alias("sy"), total(x * x).alias("sxx"), total(x * y).alias("sxy"))
    n, sx, sy = (F.col(c).cast("double") for c in ("n", "sx", "sy"))
    # Deviations from the means, so that one length only gives a spread of 0 and no slope.
    across = F.col("sxy").cast("double") - sx * sy / n
    along = F.col("sxx").cast("double") - sx * sx / n
    slope = F.when(along > F.col("sxx").cast("double") * 1e-9, across / along).otherwise(F.lit(0.0))
    lines = sums.select(F.col("group").alias("of"), ((sy - slope * sx) / n / GRAIN).alias("level"), slope.alias("slope"), (sy / n / GRAIN).alias("mean"))
    lines = materialize(lines, "fertility-lines")
    placed = materialize(texts.join(lines, F.col("group").eqNullSafe(F.col("of"))).withColumns(fertility_columns()).select("group", *names), "fertility-placed")
    # Pieces as long as there are pieces, so that a group with most of the rows is spread.
    piece = max(PIECE_ROWS, math.isqrt(placed.count()))
    found = grouped_quantiles(placed, ["group"], {m: quarter for m in names}, piece)
    found = found.join(lines, F.col("group").eqNullSafe(F.col("of"))).drop("of")
    out = [F.col("group"), F.col("level"), F.col("slope")]
    for n in names:
        q = [F.get(F.col(n), i) for i in range(3)]
        beyond = fences * (q[2] - q[0])
        floor = F.greatest(F.abs(F.col("mean") if n == "evenness" else q[1]) * least, F.lit(0.02))
        low = F.lit(0.0) if n == "raw_share" else F.least(q[0] - beyond, q[1] - floor)
        high = F.lit(float("inf")) if n == "evenness" else F.greatest(q[2] + beyond, q[1] + floor)
        out += [low.alias(f"{n}_low"), high.alias(f"{n}_high")]
    return found.select(*out)


def quality_rules(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    group: Column | None = None,
    fences: float = FENCES,
    least: float = LEAST,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, the base counts, the token measures, ``base_failed`` and ``kept`` of every row.

    ``group`` is the language by default (a null one is a group of its own). A null or empty text
    has counts of 0 and fails the base rules; a group in which every text fails them has no bands,
    and needs none. Whole texts are measured however long they are. Repeated rows each give a row; an empty table gives
    none. Columns other than the id, the text, the group and those in ``keep``, which are handed on, aren't read.
    """
    measured = materialize(measures(docs, byte_path, piece_path, F.col("lang") if group is None else group, keep), "fertility")
    limits = materialize(bands(measured, fences, least), "fertility-bands").withColumnRenamed("group", "of")
    inside = F.lit(True)
    for n in fertility_columns():
        fits = F.col(n).between(F.col(f"{n}_low"), F.col(f"{n}_high"))
        if n == "evenness":
            fits |= F.col("n_tokens") < ENTROPY_TOKENS
        inside &= F.coalesce(fits, F.lit(True))
    return (
        measured.withColumn("base_failed", base_failed())
        .join(limits, F.col("group").eqNullSafe(F.col("of")), "left")
        .withColumns(fertility_columns())
        .withColumn("kept", ~F.col("base_failed") & inside)
        .select("doc_id", *COUNTS[:5], "base_failed", "kept", "group", "n_tokens", *fertility_columns(), *keep)
    )


@query("op3_quality_rules")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY))
