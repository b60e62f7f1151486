"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings below plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Timestamps are compared in UTC; bad casts and overflows fail instead of turning null."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir`` for intermediate tables.

    Only a local session, as in tests, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_kept: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside this block are removed when it ends; write what is wanted of them before."""
    _kept.append([])
    try:
        yield
    finally:
        for path in _kept.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote and nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        _remove(table.sparkSession, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that later steps, and retries after a lost executor,
    start from the files; being columnar, readers take only what they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _kept:
        _kept[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it does no more than read files, else its stored copy: for a table that several jobs will read."""
    cheap = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "UnresolvedSubqueryColumnAliases"}
    waiting = [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() not in cheap:
            return materialize(df, name)
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return df
