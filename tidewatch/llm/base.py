"""Registry of the training-data queries, and the way texts reach Python in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space is exactly these bytes; every other run of characters is a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to array code in slices of about this many bytes (one longer text is a slice).
SLICE_BYTES = 2 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL it must agree with if there is one."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_words(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its text column (by position) holds about ``SLICE_BYTES`` in each slice."""
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
    start, ends = 0, np.cumsum(sizes)
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by the length of a binary column, as vectors of one length."""
    lengths = np.asarray(pc.binary_length(batch.column(column)))
    for length in np.unique(lengths):
        yield batch.take(pa.array(np.flatnonzero(lengths == length)))


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType
) -> DataFrame:
    """Run array code over slices of ``df``, whose second column is the text.

    ``make`` is called once in each task and returns the function for a slice, so that
    tables a task needs are built once.
    """

    def run(batches):
        each = make()
        for batch in batches:
            for part in slices(batch):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
