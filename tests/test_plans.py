"""Plan-shape tests (SURVEY §5 (4)): cumulative operators never gather the data
into one task; no registered-style plan uses a nested-loop join or Python."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_report import summarize  # noqa: E402

from tabsmith.operators import drift, features, metrics  # noqa: E402


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _data(spark):
    return spark.range(0, 5000).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
        (F.col("id") * 7919 % 1000 / 1000.0).alias("p"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("x"))


def _check(df):
    s = summarize(_plan(df))
    assert s["nested_loop"] == 0 and s["python"] == 0
    assert set(s["single_below"].split(",")) <= {"-", "carries", "HashAggregate"}, s
    return s


def test_global_fill_gathers_only_bucket_carries(spark):
    s = _check(features.fill_forward_backward(_data(spark), "x", ["id"]))
    assert s["single"] >= 1 and "carries" in s["single_below"]


def test_curve_metrics_and_ks_plans(spark):
    d = _data(spark)
    _check(metrics.roc_auc(d, "y", "p"))
    _check(metrics.average_precision(d, "y", "p"))
    _check(metrics.classification_metrics(d.withColumn("yhat", (F.col("p") >= 0.5).cast("int")), "y", "yhat", "p"))
    e = d.where("id < 2500").select(F.col("p").alias("v"))
    a = d.where("id >= 2500").select(F.col("p").alias("v"))
    _check(drift.ks_statistic(drift.long_form(e, a, ["v"], False)))


def test_segment_filters_reach_the_scan(spark, tmp_path):
    from tabsmith.operators.segment import apply_segmentation
    path = str(tmp_path / "t.parquet")
    _data(spark).write.parquet(path)
    out = apply_segmentation(spark.read.parquet(path), [("y", "eq", 1), ("x", "neq", 11)])
    plan = _plan(out)
    assert "PushedFilters: [" in plan and "EqualTo(y,1)" in plan
