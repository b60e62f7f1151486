"""Encoded rows as compact column blocks, for fits that read them many times.

A block holds some hundred thousand rows of the ``features`` vector without loss: a numeric column as small codes into its distinct
values where they are few, else as it is, and of each encoded category the slot alone. That is about a fifth of the vectors'
size, so rows are encoded once, stored once, and never shuffled.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, TaskContext, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, functions as F

from tidewatch.operators.preprocessing import FEATURES, DictionaryEncoder
from tidewatch.session import materialize

#: Rows of a block: what a task works on at a time.
ROWS_PER_BLOCK = 1 << 18
#: Values in a column's summary; up to so many distinct ones it is exact.
POINTS = 1024

# Workers get this module's functions with the job, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Layout:
    """The ``features`` vector: so many numbers, then the slots of each category column."""

    numbers: int
    slots: tuple[int, ...]

    @property
    def width(self) -> int:
        return self.numbers + sum(self.slots)

    @property
    def starts(self) -> list[int]:
        return [self.numbers + sum(self.slots[:i]) for i in range(len(self.slots))]


def layout_of(prepared: PipelineModel) -> Layout:
    """Of the vectors a fitted preprocessing makes. Apart from the class, as workers don't need what it takes."""
    assembler = next(s for s in prepared.stages if isinstance(s, VectorAssembler))
    encoder = next((s for s in prepared.stages if isinstance(s, DictionaryEncoder)), None)
    numbers = sum(c.startswith("num_") for c in assembler.getInputCols())
    return Layout(numbers, tuple(encoder.getOrDefault(encoder.slots)) if encoder else ())


def smallest(codes: np.ndarray, top: int) -> np.ndarray:
    """The codes in the smallest type that holds ``top``."""
    return codes.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int32)


def thinned(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` of the sorted values at even steps of weight; each stands for those up to it."""
    if len(values) <= points:
        return values, weights
    ends = np.cumsum(weights)
    at = np.unique(np.minimum(np.searchsorted(ends, np.linspace(0, ends[-1], points + 1)[1:]), len(values) - 1))
    at[-1] = len(values) - 1
    return values[at], np.diff(ends[at], prepend=0.0)


def merged(one: list, other: list) -> list:
    """Summaries of the same columns, put together."""
    out = []
    for (a, wa), (b, wb) in zip(one, other, strict=True):
        values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        out.append(thinned(values, np.bincount(place, weights=np.concatenate([wa, wb]), minlength=len(values))))
    return out


def _matrix(vectors, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (column by row) and slots (category column by row, the number of slots where none is set) of Arrow vectors."""
    n = len(vectors)
    listed, indices = vectors.field("values"), vectors.field("indices")
    values = listed.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(values).all():
        raise ValueError("vectors to fit must not hold NaN or infinities")
    lengths = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    column[sparse[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    numbers = np.zeros((layout.numbers, n))
    slots = np.repeat(np.array(layout.slots, dtype=np.int64)[:, None], n, axis=1)
    numeric = column < layout.numbers
    numbers[column[numeric], row[numeric]] = values[numeric]
    hot = ~numeric & (values != 0)
    column, row = column[hot], row[hot]
    starts = np.array(layout.starts, dtype=np.int64)
    # Columns without slots start where the next one does; the last of those that start there has them.
    group = np.searchsorted(starts, column, side="right") - 1
    slots[group, row] = column - starts[group] if len(starts) else 0
    return numbers, slots


def _packed(numbers: np.ndarray, slots: np.ndarray, labels: np.ndarray, weights: np.ndarray, layout: Layout, name: tuple) -> dict:
    if np.isnan(labels).any() or np.isnan(weights).any():
        raise ValueError("labels and weights of rows to fit must not be null or NaN")
    columns, summary = [], []
    for column in numbers:
        values, codes = np.unique(column, return_inverse=True)
        summary.append(thinned(values, np.bincount(codes, weights=weights, minlength=len(values))))
        columns.append((values, smallest(codes, len(values) - 1)) if len(values) <= 65536 else (None, column.copy()))
    y = labels > 0.5
    each = [tuple(np.unique(weights[y == c])) for c in (False, True)]
    if max(map(len, each)) > 1:
        raise ValueError("rows of a class must weigh the same")
    return {
        "name": name,
        "y": y,
        "weights": [w[0] if w else None for w in each],
        "columns": columns,
        "summary": summary,
        "slots": [smallest(s, top) for s, top in zip(slots, layout.slots, strict=True)],
    }


def stored_blocks(encoded: DataFrame, label: str, weight: str, layout: Layout, rows_per_block: int | None = None) -> DataFrame:
    """Blocks of the rows, a binary each, stored once in the partitions the rows have."""
    most = rows_per_block or ROWS_PER_BLOCK

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, held, rows, number = TaskContext.get().partitionId(), [], 0, 0

        def block():
            numbers, slots, y, w = (np.concatenate(p, axis=-1) for p in zip(*held, strict=True))
            made = _packed(numbers, slots, y, w, layout, (part, number))
            return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(made, 5)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if held and rows + piece.num_rows > most:
                    yield block()
                    held, rows, number = [], 0, number + 1
                held.append((*_matrix(piece.column("v"), layout), *(piece.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))))
                rows += piece.num_rows
        if held:
            yield block()

    given = encoded.select(F.unwrap_udt(FEATURES).alias("v"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    return materialize(given.mapInArrow(packed, "block binary"), "training-blocks")


def one_each(rdd: RDD) -> RDD:
    """The same elements, each serialised by itself, so that tables made from one another can be zipped."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def opened(blocks: DataFrame) -> RDD:
    return blocks.rdd.map(lambda r: pickle.loads(r[0]))
