"""Imputation, category pooling and encoding, fitted on training rows only.

Categories are a stored dictionary: a row for each with its slot, numbered piece by piece along the names. Rows find
their slot by a join, so the number of categories is bounded by storage and no list of names passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import schema as S
from tidewatch.config import PreprocessingConfig
from tidewatch.plans.ordering import cut_points, pieces_for, quantiles, running_before
from tidewatch.session import materialize, shared_folder

FEATURES = "features"
POOLED = "__pooled"


@dataclass(frozen=True)
class ColumnCodes:
    """What a column's codes need besides the dictionary: the category that stands for null, and how many are kept and pooled."""

    mode: str
    kept: int
    rare: int

    @property
    def slots(self) -> int:
        return self.kept + bool(self.rare)


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians, mean of the middle two; 0 for a column without values."""
    found = quantiles(train, {c: [0.5] for c in columns}) if columns else {}
    return {c: 0.0 if found[c][0] is None else float(found[c][0]) for c in columns}


def category_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of every (column, category); combined on the map side."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns]
    return (
        train.select(F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell.column", "cell.category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_dictionary(
    train: DataFrame,
    columns: Sequence[str],
    config: PreprocessingConfig = PreprocessingConfig(),
    rows_per_piece: int | None = None,
) -> tuple[DataFrame, dict[str, ColumnCodes]]:
    """The stored dictionary ``column, category, n, kept, slot``, and a few numbers for each column.

    ``n`` counts a null as the column's most frequent category (the smallest on ties). Categories with at least
    ``min_category_count`` rows are kept and numbered in the order of their names, the others share the slot after them.
    """
    counts = materialize(category_counts(train, columns), "category-counts")
    present = F.col("category").isNotNull()
    typical = counts.groupBy("column").agg(
        F.min_by("category", F.when(present, F.struct(F.negative("n").alias("n"), "category"))).alias("mode"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
    )
    typical = {r["column"]: r for r in typical.collect()}
    empty = sorted(c for c in columns if c not in typical or typical[c]["mode"] is None)
    if empty:
        raise ValueError(f"{', '.join(empty)} has no values to learn from")
    filled = F.col("n")
    for c, r in typical.items():
        filled = F.when((F.col("column") == c) & (F.col("category") == r["mode"]), F.col("n") + r["missing"]).otherwise(filled)
    named = counts.where(present).withColumn("n", filled).withColumn("kept", F.col("n") >= config.min_category_count)
    named = materialize(named, "categories")
    sizes = {r["column"]: r for r in named.groupBy("column").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rare")).collect()}
    codes = {c: ColumnCodes(typical[c]["mode"], sizes[c]["kept"], sizes[c]["rare"]) for c in columns}

    kept = named.where("kept").withColumn("one", F.lit(1).cast("long"))
    cuts = cut_points(kept, "category", pieces_for(sum(c.kept for c in codes.values()), rows_per_piece))
    numbered = running_before(kept, ["column"], "category", {"slot": "one"}, cuts=cuts).drop("one")
    after = reduce(lambda old, c: F.when(F.col("column") == c, F.lit(codes[c].kept).cast("long")).otherwise(old), columns, F.lit(None).cast("long"))
    whole = numbered.unionByName(named.where(~F.col("kept")).withColumn("slot", after))
    return materialize(whole.select("column", "category", "n", "kept", "slot"), "dictionary"), codes


class DictionaryEncoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``idx_<column>``, the slot of each row's category; a category never seen gets the number after the last slot."""

    columns = Param(Params._dummy(), "columns", "category columns", TypeConverters.toListString)
    modes = Param(Params._dummy(), "modes", "category that stands for null, by column", TypeConverters.toListString)
    slots = Param(Params._dummy(), "slots", "number of slots, by column", TypeConverters.toListInt)
    folder = Param(Params._dummy(), "folder", "where the dictionary lies", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, modes=None, slots=None, folder=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def dictionary(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.getOrDefault(self.folder))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dictionary = self.dictionary(dataset.sparkSession)
        for c, mode, slots in zip(*(self.getOrDefault(p) for p in (self.columns, self.modes, self.slots)), strict=True):
            mine = dictionary.where(F.col("column") == c).select(F.col("category").alias("__category"), F.col("slot").alias("__slot"))
            value = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            found = dataset.withColumn("__value", value).join(mine, F.col("__value") == F.col("__category"), "left")
            dataset = found.withColumn(f"idx_{c}", F.coalesce("__slot", F.lit(slots)).cast("double")).drop("__value", "__category", "__slot")
        return dataset


def fit_preprocessor(
    train: DataFrame,
    features: Sequence[str] = tuple(S.MODEL_FEATURES),
    config: PreprocessingConfig = PreprocessingConfig(),
    known: dict[str, float] | None = None,
) -> PipelineModel:
    """A pipeline from feature columns to one ``features`` vector.

    Numbers get the training median. Categories get the training mode, rare
    ones share one slot, and categories never seen encode to all zeros. ``known`` are medians the caller has.
    """
    spark = train.sparkSession
    numeric = [c for c in features if c in S.NUMERIC_FEATURES]
    categorical = [c for c in features if c in S.CATEGORICAL_FEATURES]
    filled = [
        f"COALESCE(NANVL(CAST(`{c}` AS DOUBLE), NULL), {m!r}D) AS `num_{c}`"
        for c, m in ({c: known[c] for c in numeric} if known else medians(train, numeric)).items()
    ]
    stages: list = [SQLTransformer(statement=f"SELECT *{''.join(', ' + f for f in filled)} FROM __THIS__")]
    vectors = [f"num_{c}" for c in numeric]
    if categorical:
        dictionary, codes = fit_dictionary(train, categorical, config)
        folder = f"{shared_folder(spark)}/model-dictionary-{uuid4().hex}"
        dictionary.write.parquet(folder)
        slots = [codes[c].slots for c in categorical]
        stages.append(DictionaryEncoder(columns=categorical, modes=[codes[c].mode for c in categorical], slots=slots, folder=folder))
        index_names, hot_names = [f"idx_{c}" for c in categorical], [f"hot_{c}" for c in categorical]
        # The number after the last slot is that of unknown categories; dropping it leaves zeros.
        largest = spark.createDataFrame([tuple(map(float, slots))], ", ".join(f"`{c}` double" for c in index_names))
        stages.append(OneHotEncoder(inputCols=index_names, outputCols=hot_names, dropLast=True).fit(largest))
        vectors += hot_names
    stages.append(VectorAssembler(inputCols=vectors, outputCol=FEATURES))
    return PipelineModel(stages)


def vector_width(pipeline: PipelineModel) -> int:
    """Places of the ``features`` vector."""
    assembler = next(s for s in pipeline.stages if isinstance(s, VectorAssembler))
    encoder = next((s for s in pipeline.stages if isinstance(s, DictionaryEncoder)), None)
    slots = encoder.getOrDefault(encoder.slots) if encoder else []
    return sum(c.startswith("num_") for c in assembler.getInputCols()) + sum(slots)


def slot_names(spark: SparkSession, pipeline: PipelineModel) -> DataFrame:
    """``slot, feature``: the name of every place of the ``features`` vector."""
    assembler = next(s for s in pipeline.stages if isinstance(s, VectorAssembler))
    numbers = [c.removeprefix("num_") for c in assembler.getInputCols() if c.startswith("num_")]
    names = spark.createDataFrame(list(enumerate(numbers)), "slot long, feature string")
    encoder = next((s for s in pipeline.stages if isinstance(s, DictionaryEncoder)), None)
    if encoder is None:
        return names
    start, starts = len(numbers), []
    for c, slots in zip(encoder.getOrDefault(encoder.columns), encoder.getOrDefault(encoder.slots), strict=True):
        starts.append((c, start))
        start += slots
    offsets = spark.createDataFrame(starts, "column string, start long")
    label = F.concat_ws("=", "column", F.when(F.col("kept"), F.col("category")).otherwise(POOLED))
    places = encoder.dictionary(spark).join(offsets, "column").select((F.col("start") + F.col("slot")).alias("slot"), label.alias("feature"))
    return names.unionByName(places.distinct())
