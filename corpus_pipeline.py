"""A corpus pipeline: rules, toxicity, near duplicates, mixing and packing, each stage on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.base import WORD, n_words, table
from tidewatch.llm.mixing import passes, stream_order
from tidewatch.llm.near_dedup import near_duplicates
from tidewatch.llm.packing import packed
from tidewatch.llm.quality import BYTE_VOCABULARY, PIECE_VOCABULARY, quality_rules
from tidewatch.llm.toxicity import classify, fit
from tidewatch.llm.token_counts import vocabulary_path
from tidewatch.session import materialize, scratch, shared_folder

#: Near duplicates share shingles of five words with a likeness of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: SQL can't tokenise, train a classifier or sign shingles; tests hold the rows against brute force.
ORACLE_SQL = None
PLACE = ("file_of_row", "row_of_file")


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row in its stored file, which tells rows apart and is the same whenever it is read.

    A table that isn't read from files is stored first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialize(docs, "stage-rows")
    return docs.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_number``: its file's number and its place in it. Files are numbered in a stored table with a row for each."""
    rows = placed(docs)
    files = rows.select(PLACE[0]).distinct()
    files = materialize(files.withColumn("file_number", F.row_number().over(W.orderBy(PLACE[0])).cast("long")), "stage-files")
    number = F.shiftleft("file_number", 40) + F.col(PLACE[1])
    return rows.join(files, PLACE[0]).select(*docs.columns, number.alias("row_number"))


def held(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``lang`` and all other columns as ``document``, whatever their names."""
    return docs.select("doc_id", "text", "lang", F.struct(*[c for c in docs.columns if c != "text"]).alias("document"))


def released(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("document")[c].alias(c) for c in names])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Each row is judged by itself, and its text goes along with its measures."""
    judged = quality_rules(held(docs), vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY), keep=("document", "text"))
    return released(judged.where("kept"), docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, doesn't call toxic."""
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return released(classify(held(docs), chain, keep=("document", "text")).where("not rejected"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the first in the order of stored rows; the numbers of the others are taken out.

    Each row is a document of its own: rows that share an id but not their text both stay.
    """
    rows = numbered(docs)
    groups = near_duplicates(rows.withColumn("doc_id", F.col("row_number")), SHINGLE, PERCENT)
    others = materialize(groups.where("not kept").select(F.col("doc_id").alias("row_number")), "stage-near")
    return rows.join(others, "row_number", "left_anti").drop("row_number")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole passes, and one more if half or more of a further one is taken.

    A table with a row for each source says how often its stream is taken and where the last pass ends, so a row tells by itself
    how often it is taken, and no text moves.
    """
    rows = placed(docs)
    # Rows without an id are shuffled by their place.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", *PLACE))
    named = rows.select(name.alias("doc_id"), "source", "text", *PLACE)
    taken = passes(named, n_words(F.col("text")), keep=PLACE).withColumnRenamed("source", "of")
    digest = F.md5(name.cast("binary"))
    known = {"digest": digest, "doc_id": name}
    own = F.struct(*[known.get(c, F.col(c)).alias(c) for c in stream_order(PLACE)])
    found = rows.withColumn("own", own).join(taken, F.col("source").eqNullSafe(F.col("of")))
    once_more = F.when(F.col("own") <= F.col("last"), 1).otherwise(0)
    times = F.when(F.col("text").rlike(WORD), F.col("passes") + once_more).otherwise(0).cast("int")
    each = found.withColumn("times_taken", times).where("times_taken > 0")
    return each.withColumn("times_taken", F.explode(F.sequence(F.lit(1), "times_taken"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document lies: one row for each part, with its bin and the bin's length."""
    return packed(docs, n_words(F.col("text")))


STAGES = [
    ("quality rules", rules),
    ("toxicity", toxicity),
    ("near duplicates", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written as Parquet to the shared folder and read by the next, and its own tables are removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
