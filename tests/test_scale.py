"""Learning steps whose work must not grow faster than their rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.operators import ml


def _rows(spark, n=6000):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        p, q, c = float(rng.integers(0, 30)), float(rng.integers(-8, 9)) / 4, ["a", "b", "c", None][int(rng.integers(0, 4))]
        y = float(rng.random() < 1 / (1 + np.exp(-(p / 8 - 2 + q * (1 if c == "b" else -0.4)))))
        rows.append((k, c, p, q, y, k % 7 == 0))
    return spark.createDataFrame(rows, "id int, c string, p double, q double, y double, is_val boolean")


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_cells_train_the_model_of_the_rows(spark, task):
    """Few values a number: bins are the values, so the model on cells is the model on rows."""
    df = _rows(spark).withColumn("w", F.col("y") * 1.5 + 0.5)
    kw = dict(maxIter=6, maxDepth=4, weight_col="w", validation_col="is_val")
    by_cells = ml.train(df, ["c"], ["p", "q"], "y", task, **kw)
    by_rows = ml.feature_pipeline(["c"], ["p", "q"], "y", task, **kw).fit(df)
    assert by_cells.stages[-1].getNumTrees == by_rows.stages[-1].getNumTrees
    told = [m.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("s") if task == "classification"
                                   else F.col("prediction").alias("s")) for m in (by_cells, by_rows)]
    both = told[0].join(told[1].withColumnRenamed("s", "r"), "id")
    assert both.agg(F.max(F.abs(F.col("s") - F.col("r")))).first()[0] < 1e-9


def test_cells_are_bounded_and_hold_every_row(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0)) for a, b in rng.normal(size=(20000, 2))]
                               + [(None, float("nan"), 1), (float("inf"), 0.0, 1)], "a double, b double, y int")
    cells = ml.training_cells(df, [], ["a", "b"], ["y"], 8)
    n, weight = cells.agg(F.count(F.lit(1)), F.sum("_cell_weight")).first()
    assert n <= 2 * 8 * 8 and weight == 20002
    values = ml.bin_values(df, ["a"], 8)["a"]
    # a missing number stands with the highest bin, as the trees score it
    top = df.select(ml.binned(F.col("a"), values).alias("v"), "a").where("a is null or a > 1e300").select("v").distinct().collect()
    assert [r.v for r in top] == [values[-1]]


def test_few_rows_reach_the_learner(spark, monkeypatch):
    """The learner's passes must not each read the whole table."""
    seen = []
    real = ml._on_cells
    monkeypatch.setattr(ml, "_on_cells", lambda learner, n: seen.append(n) or real(learner, n))
    df = _rows(spark)
    ml.train(df, ["c"], ["p", "q"], "y", maxIter=2, maxDepth=2)
    ml.random_search(df, ["c"], ["p", "q"], "y", {"maxDepth": [2], "maxIter": [2]}, n_iter=1, entity_key="id")
    assert len(seen) == 2 and max(seen) <= 2 * 2 * 4 * 30 * 17 < df.count() * 2
    ml.train(df, ["c"], ["p", "q"], "y", maxIter=2, maxDepth=2, subsamplingRate=0.5)    # it draws rows: no cells
    assert len(seen) == 2


def test_search_metrics_are_those_of_the_rows(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = _rows(spark)
    fitted, draws = ml.random_search(df, ["c"], ["p", "q"], "y", {"maxDepth": [3], "maxIter": [4]}, n_iter=1, folds=2, entity_key="id")
    folds = ml.entity_folds(df, "id", 2, "y", 42, "_fold").persist()
    ev, found = BinaryClassificationEvaluator(labelCol="y"), []
    for k in range(2):
        model = ml.feature_pipeline(["c"], ["p", "q"], "y", maxDepth=3, maxIter=4).fit(folds.where(F.col("_fold") != k))
        found.append(ev.evaluate(model.transform(folds.where(F.col("_fold") == k))))
    assert abs(ml.cv_table(fitted, draws)[0][1] - sum(found) / 2) < 1e-6
    assert "probability" in fitted.bestModel.transform(df).columns


def test_permutation_frames_end_with_the_bucket(spark):
    """One bucket of many rows: a frame from the current row on would be summed for each row anew."""
    import time
    df = spark.range(100000).selectExpr("id", "cast(id % 17 as double) p", "cast(id % 5 as double) q", "cast(id % 17 > 8 as double) y")
    model = ml.train(df, [], ["p", "q"], "y", maxIter=2, maxDepth=3)
    began = time.time()
    got = {r.feature: r.importance for r in ml.permutation_importance(model, df, ["p", "q"], "y", "id", n_buckets=1).collect()}
    assert time.time() - began < 30
    assert got["p"] > 0.3 and abs(got["q"]) < 1e-9


def test_elbow_reads_the_points_once_for_all_k(spark, monkeypatch):
    """All k share their passes, and few row groups do not hold the rows in few tasks."""
    passes = []
    monkeypatch.setattr(ml, "partial", lambda f, *a: passes.append(f.__name__) or __import__("functools").partial(f, *a))
    rng = np.random.default_rng(7)
    spots = np.array([[0, 0, 1e6], [9, 0, 1e6], [0, 9, 1e6], [9, 9, 1e6 + 40]])
    points = np.vstack([rng.normal(c, 0.1, (500, 3)) for c in spots])
    df = spark.createDataFrame([*map(tuple, points.tolist()), (None, 1.0, 2.0)], "a double, b double, c double").coalesce(1)
    costs, centers = ml.kmeans_elbow(df, ["a", "b", "c"], range(2, 9))
    assert len(passes) <= 2 * 2 + 1 + 20 + 1
    assert [k for k, _ in costs] == list(range(2, 9))
    by_place = sorted(centers, key=lambda c: [round(v) for v in c])
    assert np.allclose(by_place, sorted(spots.tolist()), atol=0.05)
    best = sum(((points[i * 500:(i + 1) * 500] - points[i * 500:(i + 1) * 500].mean(0)) ** 2).sum() for i in range(4))
    assert abs(dict(costs)[4] - best) < 1e-6 * best


def test_elbow_matches_the_learner(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(3000, 2))], "a double, b double")
    costs, _ = ml.kmeans_elbow(df, ["a", "b"], [2, 5, 10])
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for k, cost in costs:
        theirs = KMeans(k=k, seed=42).fit(vec).summary.trainingCost
        assert cost < theirs * 1.1
    same, told = ml.kmeans_elbow(df.limit(1).unionByName(df.limit(1)), ["a", "b"], [2, 4])
    assert [c for _, c in same] == [0.0, 0.0] and len(told) == 1


def test_quantiles_do_not_shuffle_rows_by_their_parts(spark):
    """Rows of one common value must not meet in one task of a join."""
    from tabsmith.operators.prefix import exact_quantiles
    df = spark.range(20000).selectExpr("id % 2 as g", "case when id % 10 < 8 then 7.5D else cast(id as double) end as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_quantiles(df, "v", [0.5, 0.99], ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
        assert not any("SortMergeJoin" in x and "LeftSemi" in x for x in plan.splitlines())
        got = {r.g: (r["q0.5"], r["q0.99"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for g in (0, 1):
        v = [7.5 if i % 10 < 8 else float(i) for i in range(20000) if i % 2 == g]
        assert np.allclose(got[g], np.quantile(v, [0.5, 0.99]))


def test_class_weights_do_not_shuffle_rows_by_class(spark):
    from tabsmith.operators import metrics
    df = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as double) as y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = metrics.with_weights(df, "y", metrics.class_weights(metrics.class_stats(df, "y"), "balanced"))
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert abs(out.agg(F.sum("weight")).first()[0] - 1000) < 1e-6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inference_sink_is_packed_and_not_sorted(spark, monkeypatch):
    from pyarrow import parquet
    from pyspark.sql import DataFrameWriter

    from tabsmith.plans.registry import QUERIES

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet

    def spied(self, path, *a, **kw):
        if "/predictions/" in path:
            seen.append((path, int(spark.conf.get(name))))
        return write(self, path, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    before = spark.conf.get(name)
    out = QUERIES["batch_inference"](spark, "/root/testdata/sf0.001")
    (path, writers), = seen
    assert writers >= 2 and spark.conf.get(name) == before  # with fewer, the rows of a task are sorted by partition
    files = [f.replace("file:", "", 1) for f in spark.read.parquet(path).inputFiles()]
    assert {x.split("model_stage=")[1].split("/")[0] for x in files} == {"production", "staging"}
    for f in files:
        meta = parquet.ParquetFile(f).metadata
        assert {meta.row_group(0).column(i).compression for i in range(meta.num_columns)} == {"ZSTD"}
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert {r["model_stage"]: r["count"] for r in out.groupBy("model_stage").count().collect()} == {"production": n, "staging": n}
