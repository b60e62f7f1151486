"""SpotSigs fingerprints: chains of content words that follow common words.

Every occurrence of a common word (an anchor) with enough content words after it gives a signature, the hash of
the anchor and its chain. A text's fingerprint is the set of its signatures. Near
duplicates are found among fingerprints partitioned by their size, by their rarest signatures,
with pairs dropped early whose sizes cannot reach the wanted likeness.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.arrays import Words, mix
from tidewatch.llm.base import map_texts, query, slices, table
from tidewatch.plans.ordering import cut_points, with_piece
from tidewatch.session import materialize

ANCHORS = {
    "en": "a an and are as at be been but by for from had has he in is it of on or that the this to was were will with",
    "de": "als am an auf aus bei das dem den der des die ein eine einer es für ich im in ist mit nicht sich sie und von war zu",
    "fr": "au aux ce dans de des du elle en est et il je la le les on ou par pas pour que qui se son sur un une",
    "es": "al como con de del el en es la las lo los no o para por que se su sus un una y",
}
CHAIN = 3
SPACING = 1
#: Likeness of near duplicates.
LIKENESS = 0.8
#: More than what rounding a logarithm can move a size.
EDGE = 1e-9
#: Rows a neighbouring range of documents holds about.
RANGE_ROWS = 256


class Spots:
    """Signatures of texts: 32-bit numbers, sorted and distinct in each text."""

    def __init__(self, chain: int = CHAIN, spacing: int = SPACING, anchors: dict[str, str] = ANCHORS):
        self.chain, self.spacing = chain, spacing
        words = sorted({w for line in anchors.values() for w in line.split()})
        self.anchors = np.sort(Words(pa.array(words), punctuation=True).hashes())

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """A text with words but without a chain has the hash of all its words as its only signature; one without words has none."""
        words = Words(texts, punctuation=True)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.anchors, hashes), len(self.anchors) - 1)
        anchor = self.anchors[at] == hashes
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        begin = np.searchsorted(content, spots)
        end = begin + (self.chain - 1) * self.spacing
        fits = end < len(content)
        spots, begin, end = spots[fits], begin[fits], end[fits]
        same = words.doc[content[end]] == words.doc[spots] if len(spots) else np.zeros(0, bool)
        spots, begin = spots[same], begin[same]
        with np.errstate(over="ignore"):
            found = hashes[spots]
            for k in range(self.chain):
                found = found * np.uint64(0xD1342543DE82EF95) + hashes[content[begin + k * self.spacing]]
        found = (mix(found) >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(words.doc[spots], np.arange(len(words.first)))
        out = []
        for i in range(len(words.first) - 1):
            mine = found[cuts[i] : cuts[i + 1]]
            a, b = words.first[i : i + 2]
            if not len(mine) and b > a:
                with np.errstate(over="ignore"):
                    all_words = np.uint64(b - a)
                    for h in hashes[a:b]:
                        all_words = all_words * np.uint64(0xD1342543DE82EF95) + h
                mine = (mix(np.array([all_words])) >> np.uint64(32)).astype(np.uint32)
            out.append(np.unique(mine))
        return out


def spelled(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex(" ", 4)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two fingerprints; 0 without comparing them if their sizes can't reach ``least``. Two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def with_neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Documents in ranges of ascending id; the first of each range stands once more at the end of the range before.

    ``doc_id, text, range, guest``, each partition sorted by range, guests last, then id (null first), the text's hash and
    the text. The first document of all is the guest of the last range. A range holds about the square root of the number of
    rows, and ``range_rows`` at least, so ranges and their sizes grow alike; an id with more rows than two ranges hold
    is a range of its own, divided along the hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = rows.count()
    size = max(range_rows, math.isqrt(n))
    held = F.col("held")
    often = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held")).where(held > 2 * size)
    # At most half the square root of the number of rows.
    often = {r["doc_id"]: r["held"] // size + 1 for r in often.collect()}
    cuts = {float(c) for c in cut_points(rows, "doc_id", max(1, n // size))}
    cuts |= {float(i + k) for i in often if i is not None for k in (0, 1)}
    parts = rows.sparkSession.createDataFrame(list(often.items()), "often long, parts long")
    unit = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 11).cast("double") / float(1 << 53)
    part = F.coalesce(F.least(F.floor(unit * F.col("parts")), F.col("parts") - 1), F.lit(0)).cast("long")
    piece = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("piece")).cast("long")
    placed = with_piece(rows, "doc_id", sorted(cuts), "piece").join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("often")), "left")
    placed = placed.select("doc_id", "text", "hash", (F.shiftleft(piece, 32) + part).alias("range"))
    first = F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"), F.col("hash").alias("first_hash"))
    heads = materialize(placed.groupBy("range").agg(F.min(first).alias("head")), "spot-heads")
    along = W.orderBy("range")
    last = F.lit((heads.agg(F.max("range")).first() or [None])[0]).cast("long")
    hosts = materialize(heads.select(F.col("range").alias("at"), "head.id", "head.first_hash", F.coalesce(F.lag("range").over(along), last).alias("host")), "spot-hosts")
    at_head = (F.col("range") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id")) & F.col("hash").eqNullSafe(F.col("first_hash"))
    # A row for each range: the square root of the number of rows, so no text moves for it.
    guests = placed.join(F.broadcast(hosts), at_head).groupBy("host", "doc_id", "hash").agg(F.min("text").alias("text"))
    guests = guests.select("doc_id", "text", "hash", F.col("host").alias("range"), F.lit(True).alias("guest"))
    return (
        placed.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .repartition("range")
        .sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "hash", F.col("text").asc_nulls_first())
        .select("doc_id", "text", "range", "guest")
    )


def edited_fingerprints(docs: DataFrame, chain: int = CHAIN, spacing: int = SPACING) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    The edited text of a row is its text with the last half (rounded down) of the code points replaced by as
    many first ones of the next row's text, or all there are; next is by ascending id, then by the text's hash, after the
    last row the first. A null text counts as empty, a null id is below any other; of rows equal in
    id and text each is the next of the one before. Whole texts are taken however long they are. A single row is its own next. An empty table
    gives no rows. Other columns aren't read.
    """

    def run(batches):
        spots = Spots(chain, spacing)
        held = None  # the row whose successor isn't known yet: id, range, text, signatures
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts, spots.of(part.column(1)), part.column(3).to_pylist()))
                made = []
                for row in rows:
                    if held is not None and held[1] == row[1]:
                        made.append((held, row))
                    held = None if row[4] else row
                if made:
                    yield finished(spots, made)

    def finished(spots, made):
        edited, digests = [], []
        for (_, _, text, _, _), (_, _, follows, _, _) in made:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + follows[:half])
            digests.append(hashlib.sha256(edited[-1].encode("utf-8", "surrogatepass")).hexdigest())
        after = spots.of(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in made], pa.int64()),
                pa.array([len(a[2]) for a, _ in made], pa.int64()),
                pa.array(digests),
                pa.array([spelled(a[3]) for a, _ in made]),
                pa.array([spelled(s) for s in after]),
                pa.array([likeness(a[3], s) for (a, _), s in zip(made, after)]),
                pa.array([likeness(a[3], b[3]) for a, b in made]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_neighbours(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def fingerprints(docs: DataFrame, chain: int = CHAIN, spacing: int = SPACING) -> DataFrame:
    """``doc_id, fingerprint`` (array of signatures) of every whole text; null and empty texts have an empty one."""

    def make():
        spots = Spots(chain, spacing)
        return lambda batch: pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.astype(np.int64) for s in spots.of(batch.column(1))], pa.list_(pa.int64()))],
            ["doc_id", "fingerprint"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, make, "doc_id long, fingerprint array<long>")


def similar(prints: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Near duplicates among ``fingerprints``: ``(doc_id, class_id)`` and ``(class_id, other, likeness)``.

    Rows with equal fingerprints are one class, named by its smallest id; pairs are between classes, the
    smaller name first, and complete. Sizes are cut into parts so that a pair within
    reach lies in one part or in two neighbouring ones; within them a pair is met only if it shares
    one of the rarest signatures of both. ``least`` is taken as the fraction it is written as, and all thresholds are
    compared as whole numbers, so a pair exactly at it is found. Empty fingerprints are a class without pairs.
    """
    share = Fraction(str(least)).limit_denominator(1_000_000)
    if not 0 < share <= 1:
        raise ValueError(f"a likeness of {least} is outside (0, 1]")
    top, bottom = share.numerator, share.denominator
    prints = materialize(prints, "spots")
    members = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(prints.join(members, "fingerprint").select("doc_id", "class_id"), "spot-classes")
    sets = materialize(members.where(F.size("fingerprint") > 0).withColumn("n", F.size("fingerprint").cast("long")), "spot-sets")
    each = sets.select("class_id", "n", F.explode("fingerprint").alias("signature"))
    rare = each.join(each.groupBy("signature").agg(F.count(F.lit(1)).alias("held")), "signature").where("held > 1 or n = 1")
    rank = F.row_number().over(W.partitionBy("class_id").orderBy("held", "signature"))
    # Signatures no other class has stand before these in the order, so each row's rank is short of their number.
    alone = rare.groupBy("class_id").agg(F.count(F.lit(1)).alias("shared"))
    kept = F.expr(f"n - (n * {top} + {bottom - 1}) div {bottom} + 1")
    size = F.log(F.col("n").cast("double")) / -math.log(share) if share < 1 else F.col("n").cast("double")
    prefix = (
        rare.withColumn("rank", rank)
        .join(alone, "class_id")
        .where(F.col("rank") + F.col("n") - F.col("shared") <= kept)
        .withColumn("size", size)
        .withColumn("part", F.floor("size"))
        .select("class_id", "n", "signature", "size", "part")
    )
    # A part to either side, and one more where rounding may have moved a size across an edge.
    reach = F.sequence(F.floor(F.col("size") - 1 - EDGE), F.floor(F.col("size") + 1 + EDGE))
    other = prefix.select(F.col("class_id").alias("other"), F.col("n").alias("m"), "signature", F.explode(reach).alias("part"))
    pairs = (
        prefix.join(other, ["part", "signature"])
        .where((F.col("class_id") < F.col("other")) & (F.least("n", "m") * bottom >= F.greatest("n", "m") * top))
        .select("class_id", "other")
        .distinct()
    )
    one, two = sets.select("class_id", F.col("fingerprint").alias("a")), sets.select(F.col("class_id").alias("other"), F.col("fingerprint").alias("b"))
    both, union = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b") - F.size(F.array_intersect("a", "b"))
    found = (
        pairs.join(one, "class_id")
        .join(two, "other")
        .where(both.cast("long") * bottom >= union.cast("long") * top)
        .select("class_id", "other", (both / union).alias("likeness"))
    )
    return classes, found


@query("op5_spotsigs")
def fingerprint_query(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


@query("op5_spotsigs_similar")
def similar_query(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates by SpotSigs: each document's class, and how many other classes have a likeness of 0.8 or more with it."""
    classes, pairs = similar(fingerprints(table(spark, folder, "documents")), LIKENESS)
    pairs = materialize(pairs, "spot-pairs")
    ends = pairs.select("class_id").unionByName(pairs.select(F.col("other").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return classes.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
