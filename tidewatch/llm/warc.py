"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Archives are plain text-like files, so readers may split them anywhere. A reading task cuts its
split at every occurrence of the version line and emits candidates: where a record may start
and where, by its own length, the next one starts. Version lines inside payloads give false
candidates. A chain of successors from each file's start, followed by pointer jumping, reaches
exactly the true records; everything else is payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.base import query, table
from tidewatch.session import materialize, shared_folder

VERSION = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
#: Payloads of this many bytes at least are stored once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages whose payload is that of a page with a larger id: ``page_id, digest, refers_to``."""
    facts = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    large = materialize(facts.where(F.col("bytes") >= least).select("page_id", "digest"), "warc-digests")
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return large.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` (``page_id, url, html``) to WARC files in ``path``.

    A null html is an empty payload, a null url an empty one. Of rows with equal payloads of at least
    ``least`` bytes those with the largest id are responses (rows repeated with that id all are; a
    null id is below any other) and the others revisit it. Other columns aren't read; an empty
    table gives archives without records.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    again = materialize(revisits(rows, least), "warc-revisits").select(
        F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to"
    )
    digest = F.sha1("payload")
    joined = rows.join(
        again, F.col("page_id").eqNullSafe(F.col("again_id")) & (digest == F.col("again_digest")), "left"
    )
    visit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(visit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.when(visit, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(visit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(visit, 0).otherwise(F.octet_length("payload"))),
    )
    record = F.concat(F.lit(VERSION), lines, F.lit(BLANK), F.when(visit, "").otherwise(F.col("payload")))
    joined.select(record.alias("value")).write.option("lineSep", BLANK).text(path)


def field(header: Column, name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: *{pattern}\r?$", 1), F.lit(""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines: ``id, file, block, value``; ``id`` follows the order within a split."""
    return (
        spark.read.option("lineSep", VERSION)
        .text(path)
        .select(
            F.monotonically_increasing_id().alias("id"),
            F.xxhash64(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place a record may start: ``id, file, start, next`` and what its header says.

    ``start`` is where its version line starts (negative for what precedes the first line of a
    file), ``next`` where its successor would. ``digest`` is that of the payload if the piece holds
    all of the record.
    """
    step = len(VERSION)
    header = F.when(F.contains("value", F.lit(BLANK)), F.substring_index("value", BLANK, 1))
    rest = F.length("value") - F.length("header") - 2 * len(BLANK)
    found = (
        pieces(spark, path)
        .withColumn("header", header)
        .withColumn("length", field(F.col("header"), "Content-Length", r"(\d{1,18})").cast("long"))
        .withColumn("held", F.octet_length("value").cast("long"))
        .withColumn("takes", F.octet_length("header") + F.col("length") + 2 * len(BLANK))
        .select(
            "id",
            "file",
            "block",
            "held",
            "takes",
            "length",
            field(F.col("header"), "WARC-Type", r"(\S+)").alias("type"),
            field(F.col("header"), "WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
            field(F.col("header"), "WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
            field(F.col("header"), "WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("stated_digest"),
            field(F.col("header"), "X-Payload-Length", r"(\d{1,18})").cast("long").alias("stated_length"),
            F.when(
                F.col("takes") == F.col("held"),
                F.sha1(F.expr(f"substr(value, length(header) + {len(BLANK) + 1})").substr(F.lit(1), rest)),
            ).alias("digest"),
        )
    )
    found = materialize(found, "warc-pieces")
    splits = found.groupBy("file", "block").agg(F.sum(F.col("held") + step).alias("bytes"))
    bases = splits.select(
        "file",
        "block",
        (F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")).alias("base"),
    )
    before = F.sum(F.col("held") + step).over(W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return (
        found.withColumn("before", before - F.col("held") - step)
        .join(bases, ["file", "block"])
        .withColumn("start", F.col("base") + F.col("before") - step)
        .withColumn("next", F.col("start") + step + F.col("takes"))
        .drop("before", "base")
    )


def reachable(found: DataFrame) -> DataFrame:
    """Candidates that the successors from each file's start arrive at.

    Neighbours that follow one another are first joined to runs; a run is left only at its end, so
    jumping goes from run to run. Each round doubles the length of a jump: rounds grow with the
    logarithm of the false candidates in a file, and none is needed where there are none.
    """
    # Splits are linked each by itself; a table with a row for each split hands the end of one to the next.
    in_split = W.partitionBy("file", "block").orderBy("start")
    along = W.partitionBy("file").orderBy("block")
    split = ["file", "block"]
    placed = materialize(found.where("start >= 0").withColumn("came", F.lag("next").over(in_split)), "warc-placed")
    ends = placed.groupBy(*split).agg(F.max_by("next", "start").alias("last"))
    handed = ends.select(*split, F.lag("last").over(along).alias("handed"))
    fresh = F.coalesce(F.coalesce("came", "handed") != F.col("start"), F.lit(True)).cast("long")
    linked = materialize(placed.join(handed, split).withColumn("fresh", fresh).drop("came", "handed"), "warc-linked")
    counts = linked.groupBy(*split).agg(F.sum("fresh").alias("runs"))
    earlier = counts.select(*split, F.coalesce(F.sum("runs").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    runs = materialize(
        linked.join(earlier, split).withColumn("run", F.sum("fresh").over(in_split) + F.col("earlier")).drop("fresh", "earlier"), "warc-runs"
    )
    # Where each run is left to, if that is a candidate's place.
    last = runs.groupBy("file", "run").agg(F.max_by("next", "start").alias("next"))
    places = runs.select("file", F.col("start").alias("next"), F.col("run").alias("to"))
    jumps = materialize(last.join(places, ["file", "next"]).select("file", "run", "to", F.col("next").alias("entry")), "warc-jumps")
    reached = runs.where("start = 0").select("file", "run", F.col("start").alias("entry"))
    leaps = jumps.select("file", "run", "to", "entry")
    while leaps.head(1):
        reached = materialize(
            reached.unionByName(reached.join(leaps.withColumnRenamed("entry", "at"), ["file", "run"]).select("file", F.col("to").alias("run"), F.col("at").alias("entry"))),
            "warc-reached",
        )
        onward = leaps.select("file", F.col("run").alias("to"), F.col("to").alias("onto"), F.col("entry").alias("at"))
        leaps = materialize(leaps.join(onward, ["file", "to"]).select("file", "run", F.col("onto").alias("to"), F.col("at").alias("entry")), "warc-leaps")
    return runs.join(reached, ["file", "run"]).where("start >= entry").drop("run", "entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Digests and lengths of responses are those of the payload read; those of revisits are stated in
    the record. Whole payloads are read, also where they lie in several splits. Archives without records give no rows.
    """
    found = materialize(candidates(spark, path), "warc-candidates")
    records = materialize(reachable(found), "warc-records")
    whole = records.where("digest is not null")
    # Payloads with version lines inside lie in several pieces, which are read once more and joined.
    marked = found.select("id", "file", "block", "start").join(
        records.select("file", "start", F.struct("start", "next", F.col("digest").isNull().alias("broken")).alias("mark")), ["file", "start"], "left"
    )
    marked = materialize(marked, "warc-marked")
    lasts = marked.groupBy("file", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("start"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    marked = marked.join(lasts.select("file", "block", before.alias("before")), ["file", "block"])
    under = F.coalesce(F.last("mark", ignorenulls=True).over(W.partitionBy("file", "block").orderBy("start")), F.col("before"))
    parts = materialize(
        marked.withColumn("mark", under)
        .where("mark.broken and start < mark.next")
        .select("id", F.col("file").alias("of"), "start", F.col("mark.start").alias("record")),
        "warc-parts",
    )
    if parts.head(1):
        body = (
            pieces(spark, path)
            .join(parts, "id")
            .groupBy("of", "record")
            .agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("held"))
            .select("of", "record", F.concat_ws(VERSION, F.transform("held", lambda p: p["value"])).alias("value"))
            .withColumn("body", F.col("value").substr(F.position(F.lit(BLANK), F.col("value")) + len(BLANK), F.length("value")))
            .select("of", "record", F.col("body").substr(F.lit(1), F.length("body") - len(BLANK)).alias("payload"))
        )
        joined = records.where("digest is null").drop("digest").join(
            body.select(F.col("of").alias("file"), F.col("record").alias("start"), F.sha1("payload").alias("digest"), F.octet_length("payload").alias("read")),
            ["file", "start"],
        )
        wrong = F.raise_error(F.lit("a payload isn't as long as its record says"))
        whole = whole.unionByName(joined.withColumn("digest", F.when(F.col("read") == F.col("length"), F.col("digest")).otherwise(wrong)).drop("read"))
    visit = F.col("type") == "revisit"
    return whole.select(
        "page_id",
        F.when(visit, F.col("stated_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(visit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


ORACLE = f"""
SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest,
       CASE WHEN largest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest > page_id THEN largest END AS refers_to
FROM (SELECT page_id, html, CASE WHEN strlen(html) >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY html) END AS largest
      FROM pages)
"""


@query("op4_warc", ORACLE)
def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, folder, "pages"), path)
    return read_archives(spark, path)
