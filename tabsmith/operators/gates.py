"""Promotion gates (G1-G3) over long metric tables.

metrics: (split, metric, value); thresholds: (split, metric, direction, threshold).
A candidate passes a check when it beats the reference strictly by 1e-8.  A metric
without a value on either side and an unknown direction fail the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8


def _beats(value, ref, direction):
    where = F.concat(F.lit(" for "), F.col("metric"), F.lit(" in "), F.col("split"))
    return (F.when(value.isNull() | ref.isNull(), F.raise_error(F.concat(F.lit("no value to compare"), where)))
            .when(direction == "maximize", value > ref + F.lit(EPSILON))
            .when(direction == "minimize", value < ref - F.lit(EPSILON))
            .otherwise(F.raise_error(F.concat(F.lit("no known direction"), where))).cast("boolean"))


def threshold_checks(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """G1 per (split, metric): value, threshold, passed, message, ord."""
    j = thresholds.join(metrics, ["split", "metric"], "left")
    passed = _beats(F.col("value"), F.col("threshold"), F.col("direction"))
    msg = F.when(~passed, F.format_string(
        "%s/%s: %s is short of the threshold %s (%s)", F.col("split"), F.col("metric"), F.col("value").cast("string"),
        F.col("threshold").cast("string"), F.col("direction")))
    return j.select("split", "metric", "direction", "value", "threshold",
                    passed.alias("passed"), msg.alias("message"),
                    F.col("ord") if "ord" in thresholds.columns else F.lit(0).alias("ord"))


def production_checks(metrics: DataFrame, production: DataFrame | None, thresholds: DataFrame) -> DataFrame:
    """The same rule against production metrics; no production model -> pass."""
    keys = thresholds.select("split", "metric", "direction", *(["ord"] if "ord" in thresholds.columns else []))
    if production is None:
        return keys.select("split", "metric", F.lit(True).alias("passed"), F.lit(None).cast("string").alias("message"),
                           F.col("ord") if "ord" in keys.columns else F.lit(0).alias("ord"))
    p = production.select("split", "metric", F.col("value").alias("production"))
    j = keys.join(metrics, ["split", "metric"], "left").join(p, ["split", "metric"], "left")
    passed = _beats(F.col("value"), F.col("production"), F.col("direction"))
    msg = F.when(~passed, F.format_string(
        "%s/%s: %s is no better than %s in production (%s)", F.col("split"), F.col("metric"),
        F.col("value").cast("string"), F.col("production").cast("string"), F.col("direction")))
    return j.select("split", "metric", passed.alias("passed"), msg.alias("message"),
                    F.col("ord") if "ord" in keys.columns else F.lit(0).alias("ord"))


def gate_decision(metrics: DataFrame, thresholds: DataFrame, production: DataFrame | None = None,
                  stage: str = "production") -> DataFrame:
    """Production needs G1 and G2, staging only G1; the first failure (by
    ``ord``) is the reason, reasons of both gates joined by '; '."""
    g1 = threshold_checks(metrics, thresholds).agg(
        F.every("passed").alias("meets_thresholds"),
        F.min_by("message", F.when(~F.col("passed"), F.col("ord"))).alias("threshold_message"))
    if stage == "staging":
        return g1.select("meets_thresholds", F.lit(True).alias("beats_production"),
                         F.col("meets_thresholds").alias("promote"),
                         F.coalesce(F.col("threshold_message"), F.lit("")).alias("reason"))
    g2 = production_checks(metrics, production, thresholds).agg(
        F.every("passed").alias("beats_production"),
        F.min_by("message", F.when(~F.col("passed"), F.col("ord"))).alias("production_message"))
    both = g1.unionByName(g2, allowMissingColumns=True) \
        .agg(F.max("meets_thresholds").alias("meets_thresholds"), F.max("beats_production").alias("beats_production"),
             F.max("threshold_message").alias("threshold_message"),
             F.max("production_message").alias("production_message"))
    return both.select("meets_thresholds", "beats_production",
                       (F.col("meets_thresholds") & F.col("beats_production")).alias("promote"),
                       F.concat_ws("; ", "threshold_message", "production_message").alias("reason"))
