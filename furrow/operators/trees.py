"""Tree ensembles with Spark ML.

Every (model, fold) fit is a distributed Spark ML job on a checkpointed
training set; independent fits run concurrently from a small thread pool so
the cluster stays busy when each training set is small. Spark's learners
have no L1/L2 leaf penalty and bin features into histograms, so results do
not equal another library's boosted trees bit for bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import config as K
from furrow.operators.backtest import ModelSpec, actual_col, back_transform, fold_table
from furrow.session import materialize


def learner(spec: ModelSpec, label: str = "label", scale: float = 1.0):
    p = spec.param_dict
    trees = max(1, int(round(p["trees"] * scale)))
    if spec.method == "boost":
        return GBTRegressor(labelCol=label, featuresCol="features", maxIter=trees,
                            maxDepth=p["depth"], stepSize=p["step"], subsamplingRate=p["rows"],
                            featureSubsetStrategy=str(p["cols"]), minInstancesPerNode=p["min_leaf"],
                            seed=K.SEED)
    if spec.method == "forest":
        return RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees,
                                     maxDepth=p["depth"], minInstancesPerNode=p["min_leaf"],
                                     featureSubsetStrategy=str(p["cols"]), seed=K.SEED)
    raise ValueError(spec.method)


def _assemble(df: DataFrame, spec: ModelSpec) -> DataFrame:
    va = VectorAssembler(inputCols=list(spec.features), outputCol="features", handleInvalid="error")
    return va.transform(df.withColumn("label", F.col(spec.target).cast("double")))


ROWS_A_PARTITION = 100_000
LEAST_PARTITIONS = 2


def dealt(df: DataFrame, by: Sequence[str] = ("week_ending",), partitions: int | None = None) -> DataFrame:
    """Rows in sorted partitions by a hash of ``by``, ``partitions`` of them or one for each
    ``ROWS_A_PARTITION`` rows. The learners' row sampling follows partitions and their order,
    so a fit on the same rows repeats exactly, however many files or tasks they came from."""
    rest = [c for c in df.columns if c not in by]
    if partitions is None:
        partitions = max(LEAST_PARTITIONS, -(-df.count() // ROWS_A_PARTITION))
    return df.repartition(partitions, *by).sortWithinPartitions(*by, *rest)


def fit_model(train: DataFrame, spec: ModelSpec, scale: float = 1.0):
    return learner(spec, scale=scale).fit(_assemble(train, spec))


def tree_backtest(spark: SparkSession, usable: DataFrame, specs: Sequence[ModelSpec],
                  keys: Sequence[str] = ("series",), min_train: int = K.MIN_TRAIN_YEARS,
                  scale: float = 1.0, parallel: int = 8,
                  extra: Sequence[str] = ("week_ending", "coverage")) -> DataFrame:
    """Out-of-sample level predictions of tree models over expanding folds.

    The fold list (group key x test year) is a handful of rows; the training
    rows are checkpointed once so no fit re-reads the raw feeds.
    """
    keys = list(keys)
    specs = [s for s in specs if s.method in ("boost", "forest")]
    data = materialize(dealt(usable))
    folds = [tuple(r) for r in fold_table(data, keys, min_train).collect()]

    def run(job):
        spec, fold = job
        kv, year = fold[:-1], fold[-1]
        cond = F.lit(True)
        for k, v in zip(keys, kv):
            cond = cond & (F.col(k) == v)
        part = data.where(cond)
        model = fit_model(part.where(F.col("year") < year), spec, scale)
        test = _assemble(part.where(F.col("year") == year), spec)
        p = model.transform(test)
        return p.select(*keys, F.lit(spec.name).alias("model"), "year", *extra,
                        back_transform(spec, F.col("prediction")).alias("pred_level"),
                        F.col(actual_col(spec)).alias("actual"))

    jobs = [(s, f) for s in specs for f in folds]
    if not jobs:  # too few years for a test fold: an empty result, same columns
        fields = [data.schema[c] for c in [*keys]] + [
            T.StructField("model", T.StringType()), data.schema["year"],
            *[data.schema[c] for c in extra],
            T.StructField("pred_level", T.DoubleType()), T.StructField("actual", T.DoubleType())]
        return spark.createDataFrame([], T.StructType(fields))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        parts = list(pool.map(run, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(spark: SparkSession, usable: DataFrame, spec: ModelSpec, key_values: dict,
                scale: float = 1.0) -> DataFrame:
    """Feature importance of a model fitted on all usable rows."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == v)
    model = fit_model(materialize(dealt(usable.where(cond))), spec, scale)
    imp = model.featureImportances.toArray().tolist()
    rows = [(*key_values.values(), spec.name, f, float(v)) for f, v in zip(spec.features, imp)]
    schema = ", ".join(f"{k} string" for k in key_values) + ", model string, feature string, importance double"
    return spark.createDataFrame(rows, schema)
