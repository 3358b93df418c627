"""Model steps on Spark ML.

The reference trains a gradient-boosted tree library on one machine; here the
learner is Spark ML's GBT, so scores differ while the surrounding contract
(preprocessing fitted on train, validation for early stopping, class weights,
batch scoring layout) is the same.

Boosted trees see a number only through its bin, so the learner reads the table
once, as weighted cells (``training_cells``): rows alike in bins, categories and label.
"""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.hashing import hash_unit_interval, input_row_hash
from tabsmith.operators.metrics import class_stats, metric_choice
from tabsmith.operators.split import cv_folds, entity_folds
from tabsmith.session import written


def feature_pipeline(categorical: list[str], numeric: list[str], label: str, task: str = "classification",
                     weight_col: str | None = None, validation_col: str | None = None,
                     **params) -> Pipeline:
    """L1: fill categorical nulls -> index categories -> assemble -> GBT."""
    fill = ", ".join([f"coalesce(cast(`{c}` as string), 'missing') as `{c}__s`" for c in categorical])
    stages = []
    if categorical:
        stages.append(SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"))
        stages.append(StringIndexer(inputCols=[f"{c}__s" for c in categorical],
                                    outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in categorical] + numeric,
                                  outputCol="features", handleInvalid="keep"))
    common = dict(featuresCol="features", labelCol=label, seed=42, **params)
    if weight_col:
        common["weightCol"] = weight_col
    if validation_col:
        common["validationIndicatorCol"] = validation_col
    model = GBTClassifier(**common) if task == "classification" else GBTRegressor(**common)
    stages.append(model)
    return Pipeline(stages=stages)


def bin_values(df: DataFrame, numeric: list[str], max_bins: int, seed: int = 42) -> dict[str, list[float]]:
    """Per number the values that stand for its bins, at most ``max_bins``, ascending; the bins part half way.

    As Spark's learner finds its splits: from a sample of ``max(max_bins ** 2, 10000)`` rows, every
    value where they are few, else values at equal steps of rows."""
    if not numeric:
        return {}
    wanted = max(max_bins ** 2, 10000)
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate(numeric)])
    n = df.count()
    if n > wanted:
        numbers = numbers.sample(fraction=wanted / n, seed=seed)
    rows = numbers.collect()    # about as many as wanted, whatever the table
    out = {}
    for i, c in enumerate(numeric):
        counts = Counter(r[i] for r in rows if r[i] is not None and not math.isnan(r[i]))
        values = sorted(counts)
        if len(values) > max_bins:
            step, seen, picked = sum(counts.values()) / max_bins, 0, []
            for v in values:
                # the value that holds the middle row of the next step
                seen += counts[v]
                if seen > step * (len(picked) + 0.5):
                    picked.append(v)
                    while seen > step * (len(picked) + 0.5) and len(picked) < max_bins:
                        picked.append(v)
            values = sorted(set(picked))
        out[c] = values
    return out


def binned(c: Column, values: list[float]) -> Column:
    """The value that stands for the bin of ``c``; a missing number goes with the highest, as in scoring."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(float(values[lo]))
        mid = (lo + hi) // 2
        return F.when(c <= F.lit((values[mid] + values[mid + 1]) / 2.0), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(values) - 1) if values else F.lit(0.0)


_CELL_WEIGHT = "_cell_weight"


def training_cells(df: DataFrame, categorical: list[str], numeric: list[str], keys: list[str], max_bins: int,
                   weight_col: str | None = None) -> DataFrame:
    """``df`` as the learner sees it: one row for rows alike in text of ``categorical``, bins of
    ``numeric`` and ``keys`` (label, folds), with their summed weight.

    Never more rows than ``df``, and never more than there are bins and categories put together,
    however long the table."""
    values = bin_values(df, numeric, max_bins)
    told = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing")).alias(c) for c in categorical],
                     *[binned(F.col(f"`{c}`").cast("double"), values[c]).alias(c) for c in numeric],
                     *[F.col(f"`{k}`") for k in keys],
                     (F.col(f"`{weight_col}`").cast("double") if weight_col else F.lit(1.0)).alias(_CELL_WEIGHT))
    held = [F.col(f"`{c}`") for c in [*categorical, *numeric, *keys]]
    cells = told.groupBy(*held).agg(F.sum(_CELL_WEIGHT).alias(_CELL_WEIGHT), F.count(F.lit(1)).alias("_cell_rows"))
    # dealt evenly: merged shuffle partitions would leave the learner two or three tasks
    return written(cells.repartition(df.sparkSession.sparkContext.defaultParallelism), "cells")


def _by_cells(learner, label: str, categorical: list[str], numeric: list[str]) -> bool:
    """Whether cells give the learner all it asks: not if it draws rows or counts them in a node."""
    drawn = learner.getSubsamplingRate() < 1 or learner.getMinInstancesPerNode() > 1 or learner.getMinWeightFractionPerNode() > 0
    return not drawn and label not in categorical + numeric


def _fit_steps(stages: list, cells: DataFrame, categorical: list[str]) -> list:
    """The feature steps before the learner, fitted: categories in the order of their rows."""
    done = []
    for stage in stages:
        if isinstance(stage, StringIndexer):
            counts = [cells.groupBy(F.col(f"`{c}`").alias("v")).agg(F.sum("_cell_rows").alias("n"))
                      .orderBy(F.col("n").desc(), "v").select("v") for c in categorical]
            stage = StringIndexerModel.from_arrays_of_labels(
                [[r["v"] for r in x.collect()] for x in counts], inputCols=stage.getInputCols(),
                outputCols=stage.getOutputCols(), handleInvalid=stage.getHandleInvalid())
        elif isinstance(stage, Estimator):
            raise TypeError(f"no step over cells for {type(stage).__name__}")
        done.append(stage)
    return done


def _on_cells(learner, n_cells: int):
    """The learner for cells: their bins are made, so it is to take each value as one and not to
    sample cells (it samples beyond the square of ``maxBins``, a 32-bit number)."""
    bins = min(max(learner.getMaxBins() + 1, math.isqrt(n_cells) + 1), 46340)
    return learner.copy({learner.weightCol: _CELL_WEIGHT, learner.maxBins: bins})


def train(df: DataFrame, categorical: list[str], numeric: list[str], label: str,
          task: str = "classification", persist_input: bool = False, **kw) -> PipelineModel:
    """L2: fit on rows of the train split (and val rows for early stopping).

    The learner works on ``training_cells``; where it draws rows or counts them, on the rows.
    ``persist_input`` keeps the fit rows (memory, spilling to disk) only while
    the stages fit, so the indexer and the learner do not recompute upstream
    work; a lost block is recomputed from lineage.
    """
    from pyspark import StorageLevel

    if persist_input:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pipe = feature_pipeline(categorical, numeric, label, task, **kw)
        *steps, learner = pipe.getStages()
        if not _by_cells(learner, label, categorical, numeric):
            return pipe.fit(df)
        keys = [label] + ([kw["validation_col"]] if kw.get("validation_col") else [])
        cells = training_cells(df, categorical, numeric, keys, learner.getMaxBins(), kw.get("weight_col"))
        steps = _fit_steps(steps, cells, categorical)
        fitted = _on_cells(learner, cells.count()).fit(PipelineModel(steps).transform(cells))
        return PipelineModel([*steps, fitted])
    finally:
        if persist_input:
            df.unpersist()


def score(model: PipelineModel, df: DataFrame, task: str = "classification") -> DataFrame:
    """Prediction, and the positive-class probability for classifiers."""
    out = model.transform(df)
    if task == "classification":
        arr = vector_to_array("probability")
        # Q14: a binary classifier must expose at least two class probabilities
        out = out.withColumn("y_proba", F.when(F.size(arr) >= 2, arr[1]).otherwise(
            F.raise_error(F.lit("probability vector has fewer than two classes"))))
    return out


EVALUATORS = {"average_precision": "areaUnderPR", "roc_auc": "areaUnderROC"}


def draw_param_maps(space: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """L3: n_iter seeded draws from the value lists (without repeats)."""
    grid = [dict(zip(space, vals)) for vals in itertools.product(*space.values())]
    rng = random.Random(seed)
    return grid if n_iter >= len(grid) else rng.sample(grid, n_iter)


def refine_space(best: dict, int_offsets: dict[str, list[int]], float_factors: dict[str, list[float]],
                 bounds: dict[str, tuple]) -> dict[str, list]:
    """L4: ints centre +- offsets, floats centre x factors (rounded); values out of
    bounds are left out; the centre is always kept."""
    def inside(k, values) -> list:
        lo, hi = bounds.get(k, (None, None))
        fit = {v for v in values if (lo is None or v >= lo) and (hi is None or v <= hi)}
        return sorted(fit | {best[k]})

    space = {k: inside(k, [best[k] + s * o for o in offs for s in (1, -1)]) for k, offs in int_offsets.items()}
    return space | {k: inside(k, [round(best[k] * f, 6) for f in factors]) for k, factors in float_factors.items()}


def random_search(train_df: DataFrame, categorical: list[str], numeric: list[str], label: str,
                  space: dict[str, list], n_iter: int = 2, folds: int = 2, seed: int = 42,
                  task: str = "classification", parallelism: int = 2, metric: str | None = None,
                  entity_key: str | None = None):
    """L3 + K5 + M23: seeded draws, folds by entity (classes spread evenly), Spark ML CrossValidator.

    Without a ``metric`` M23 chooses it: average precision for a rare class, else ROC AUC; RMSE in
    regression.  Without an ``entity_key`` each distinct row is an entity.  Fits and metrics work on
    the weighted cells of each fold; rows of a cell have one score, so the metrics are those of the rows."""
    pipe = feature_pipeline(categorical, numeric, label, task)
    model = pipe.getStages()[-1]
    draws = draw_param_maps(space, n_iter, seed)
    grid = []
    for d in draws:
        b = ParamGridBuilder()
        for k, v in d.items():
            b = b.baseOn((model.getParam(k), v))
        grid.extend(b.build())
    if task == "classification":
        chosen = metric or metric_choice(class_stats(train_df, label)).first()["metric"]
        ev = BinaryClassificationEvaluator(labelCol=label, metricName=EVALUATORS.get(chosen, chosen))
    else:
        ev = RegressionEvaluator(labelCol=label, metricName=metric or "rmse")
    keyed = train_df
    if entity_key is None:
        entity_key = "_row"
        keyed = train_df.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in train_df.columns]))
    if task == "classification":
        with_folds = entity_folds(keyed, entity_key, folds, label, seed, "_fold")
    else:
        with_folds = cv_folds(keyed, entity_key, folds, seed=seed, out="_fold")
    drawn = [c for c in draws if c.get("subsamplingRate", 1) < 1 or c.get("minInstancesPerNode", 1) > 1
             or c.get("minWeightFractionPerNode", 0) > 0 or "maxBins" in c]
    stages = pipe.getStages()
    with_folds = written(with_folds.select(*dict.fromkeys([*categorical, *numeric, label, "_fold"])), "folds")
    if not drawn and _by_cells(model, label, categorical, numeric):
        with_folds = training_cells(with_folds, categorical, numeric, [label, "_fold"], model.getMaxBins())
        steps = _fit_steps(stages[:-1], with_folds, categorical)
        stages = [*steps, _on_cells(model, with_folds.count())]
        ev.setWeightCol(_CELL_WEIGHT)
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=ev, foldCol="_fold",
                        numFolds=folds, parallelism=parallelism, seed=seed)
    fitted = cv.fit(with_folds)
    return fitted, draws


def cv_table(fitted, draws: list[dict]) -> list[tuple]:
    """(candidate, mean, std) from a fitted CrossValidator (small, on the driver)."""
    return [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(fitted.avgMetrics, fitted.stdMetrics))]


def feature_importances(model: PipelineModel, feature_names: list[str], spark, k: int = 20) -> DataFrame:
    """L6 + O4: model importances by feature name, top k."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(feature_names, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str,
                           key: str, n_buckets: int | None = None, seed: int = 42) -> DataFrame:
    """L7 re-aimed: per feature, rotate its values by one position inside hash
    buckets (a ``lag`` over hash order within each bucket -- no global sort),
    re-score and report the AUC drop.  The rotated values of all features come from
    one shuffle and are written; one scoring job per feature."""
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
    if n_buckets is None:
        n_buckets = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    u = hash_unit_interval(F.col(key), seed)
    d = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * n_buckets))
    w = Window.partitionBy("_b").orderBy("_u", key)
    # the bucket's last row by a frame of the whole bucket: one value a bucket.  A frame from the
    # current row on is summed up anew for every row, the square of the bucket
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rotated = [F.when(F.row_number().over(w) == 1, F.last(f).over(whole)).otherwise(F.lag(f, 1).over(w)).alias(f"_rotated_{i}")
               for i, f in enumerate(features)]
    d = written(d.select(*df.columns, *rotated), "rotated")
    base = ev.evaluate(model.transform(d.select(*df.columns)))
    rows = []
    for i, f in enumerate(features):
        told = d.withColumn(f, F.col(f"_rotated_{i}")).select(*df.columns)
        rows.append((f, float(base - ev.evaluate(model.transform(told)))))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double")


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row its nearest centre (the first on ties) and the squared distance."""
    near = np.argmin((centers * centers).sum(1) - 2 * (x @ centers.T), axis=1)
    return near, ((x - centers[near]) ** 2).sum(1)


def _arrow_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])


def _cluster_sums(sets: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows against every set of centres: per set and centre rows, cost and coordinate sums."""
    found = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in sets.items()}
    for batch in batches:
        all_x = _arrow_matrix(batch)
        for x in (all_x[i:i + 8192] for i in range(0, len(all_x), 8192)):
            for k, centers in sets.items():
                near, cost = _nearest(x, centers)
                for j, v in enumerate([np.ones(len(x)), cost, *x.T]):
                    found[k][:, j] += np.bincount(near, v, len(centers))
    rows = [(k, i, row.tolist()) for k, m in found.items() for i, row in enumerate(m)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                      pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["k", "i", "sums"])


def _drawn_rows(centers: np.ndarray, rate: float, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows drawn with a chance of ``rate`` times their cost; a task run again draws the same."""
    rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
    for batch in batches:
        x = _arrow_matrix(batch)
        drawn = x[rng.random(len(x)) < rate * _nearest(x, centers)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(drawn.tolist(), pa.list_(pa.float64()))], names=["x"])


def _seeded_centers(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over weighted candidates; fewer than ``k`` where they are not more."""
    rng = np.random.default_rng([seed, k])
    chosen = [candidates[rng.choice(len(weights), p=weights / weights.sum())]]
    while len(chosen) < k:
        chance = weights * _nearest(candidates, np.array(chosen))[1]
        if not chance.sum() > 0:
            break
        chosen.append(candidates[rng.choice(len(weights), p=chance / chance.sum())])
    return np.array(chosen)


def kmeans_elbow(df: DataFrame, cols: list[str], k_values=range(2, 21), seed: int = 42,
                 centers_for: int = 4, max_iter: int = 20, tol: float = 1e-4, init_rounds: int = 2):
    """Inertia for each k on complete numeric rows; centres for one k.

    Spark ML's algorithm (k-means|| starts, Lloyd steps until no centre moves by more than ``tol``,
    at most ``max_iter``), for all k in the same passes: a fit a k would read the table some 25
    times for each.  A pass sends one row a centre and task.  Rows are written evenly dealt, so
    a file of few row groups does not hold them in few tasks.  Each inertia is of its final centres."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    complete = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    x = written(complete.repartition(parts), "points")
    mean = x.agg(F.count(F.lit(1)), *[F.avg(c) for c in x.columns]).first()
    if not mean[0]:
        raise ValueError("no complete rows to cluster")
    shift = np.array(mean[1:], float)       # distances are taken around the mean, where they lose no digits
    x = x.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(x.columns, shift)])

    def passed(sets: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        sums = x.mapInArrow(partial(_cluster_sums, sets), "k int, i int, sums array<double>")
        n = len(cols) + 2
        rows = sums.groupBy("k", "i").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(n)]).alias("s")).collect()
        out = {k: np.zeros((len(c), n)) for k, c in sets.items()}
        for r in rows:
            out[r.k][r.i] = r.s
        return out

    ks = [int(k) for k in k_values]
    candidates = np.array([x.first()], float)
    for r in range(init_rounds):
        cost = passed({0: candidates})[0][:, 1].sum()
        if not cost > 0:
            break
        drawn = x.mapInArrow(partial(_drawn_rows, candidates, 2 * max(ks) / cost, seed + r), "x array<double>").collect()
        candidates = np.unique(np.vstack([candidates, *[np.array([d.x]) for d in drawn]]), axis=0)
    weights = passed({0: candidates})[0][:, 0]
    centers = {k: _seeded_centers(candidates, weights, k, seed) for k in ks}
    moving = dict(centers)
    for _ in range(max_iter):
        if not moving:
            break
        for k, m in passed(moving).items():
            old, held = centers[k], m[:, :1] > 0
            centers[k] = np.where(held, m[:, 2:] / np.maximum(m[:, :1], 1), old)     # a centre without rows stays
            moving[k] = centers[k]
            if (((centers[k] - old) ** 2).sum(1) <= tol * tol).all():
                del moving[k]
    last = passed(centers)
    costs = [(k, float(last[k][:, 1].sum())) for k in ks]
    told = [list(map(float, c)) for c in centers[centers_for] + shift] if centers_for in centers else None
    return costs, told


def batch_predictions(model: PipelineModel, features: DataFrame, entity_key: str, run_id: str,
                      stage: str, model_version: str, schema_version: str = "v1",
                      n_classes: int = 2, task: str = "classification") -> DataFrame:
    """L5 + X12 + P14: hash the input rows (key excluded), score, and project to
    the inference table layout; run id and timestamp are set on every row."""
    hashed = features.withColumn("input_hash", input_row_hash(features, exclude=[entity_key]))
    scored = model.transform(hashed)
    cols = [F.lit(run_id).alias("run_id"), F.expr("uuid()").alias("prediction_id"),
            F.current_timestamp().alias("timestamp"), F.lit(stage).alias("model_stage"),
            F.lit(model_version).alias("model_version"), F.col(entity_key).cast("string").alias("entity_id"),
            "input_hash", F.col("prediction").cast("double").alias("prediction"),
            F.lit(schema_version).alias("schema_version")]
    if task == "classification":
        arr = vector_to_array("probability")
        cols += [F.when(F.size(arr) >= 2, arr[i]).otherwise(F.raise_error(F.lit("fewer than two classes")))
                 .alias(f"proba_{i}") for i in range(n_classes)]
    return scored.select(*cols)
