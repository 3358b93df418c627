"""Spark ML plans (L1-L8, P14, P15, Q10).  No SQL oracle: learners are not
SQL-expressible, so these get the driver's rows-only check."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators import ml, quality, split
from tabsmith.plans.base import register, table

CAT = ["l_returnflag", "l_linestatus"]
NUM = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
# The search space of the example (GBT parameters).
SPACE = {"maxDepth": [2, 3, 4], "stepSize": [0.1, 0.3], "maxIter": [10]}


def _training_table(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    t = li.select(key.alias("entity_key"), *CAT, *NUM,
                  (F.dayofweek("l_shipdate") >= 6).cast("double").alias("label"))
    return split.hash_split(t, "entity_key", 0.2, 0.1, 42)


@register("train_score", covers="L1 L2 P15 M6 M20 M22")
def q_train_score(spark, d):
    from tabsmith.operators import metrics
    t = _training_table(spark, d)
    fit_rows = t.where("split != 'test'").withColumn("is_val", F.col("split") == "val")
    # Balanced class weights from the training rows reach the learner as weightCol
    weights = metrics.class_weights(metrics.class_stats(fit_rows.where("split = 'train'"), "label"), "balanced")
    model = ml.train(metrics.with_weights(fit_rows, "label", weights), CAT, NUM, "label", maxIter=10,
                     maxDepth=3, validation_col="is_val", weight_col="weight")
    scored = ml.score(model, t)
    return scored.select("entity_key", "split", F.col("label").cast("int").alias("y_true"),
                         F.col("prediction").cast("int").alias("y_pred"), "y_proba")


@register("batch_inference", covers="L5 X12 P14 Q10 Q14 S11")
def q_batch_inference(spark, d):
    t = _training_table(spark, d)
    model = ml.train(t.where("split = 'train'"), CAT, NUM, "label", maxIter=5, maxDepth=3)
    feats = t.select("entity_key", *CAT, *NUM)
    newer = ml.train(t.where("split = 'train'"), CAT, NUM, "label", maxIter=8, maxDepth=3)
    runs = [("production", model, "1"), ("staging", newer, "2")]
    each = [ml.batch_predictions(m, feats, "entity_key", run_id="run-1", stage=s, model_version=v) for s, m, v in runs]
    for out in each:
        quality.check_prediction_columns(out)
    # L5 sink: partitioned by run and stage under the shared folder; S11 reads a stage back
    from tabsmith.plans.storage import _scratch
    from tabsmith.sources.io import load_predictions, save_inference
    path = _scratch(spark, "predictions")
    save_inference(each[0].unionByName(each[1]), path)
    back = [load_predictions(spark, path, s) for s, _, _ in runs]
    return back[0].unionByName(back[1]).drop("prediction_id", "timestamp")


@register("batch_contract", covers="L5 P14 Q10 Q14 S11", sql=f"""
SELECT s.model_stage, count(*) AS n_rows, count(DISTINCT entity_key) AS n_entities, CAST(0 AS BIGINT) AS n_bad
FROM (SELECT l_orderkey || '-' || l_linenumber AS entity_key FROM lineitem), (VALUES ('production'), ('staging')) s(model_stage)
GROUP BY 1
""")
def q_batch_contract(spark, d):
    """Both stages score every row; probabilities are in [0, 1] and add up to one, hashes are full."""
    p = q_batch_inference(spark, d)
    bad = ~F.col("proba_1").between(0, 1) | (F.abs(F.col("proba_0") + F.col("proba_1") - 1) > 1e-9) \
        | (F.length("input_hash") != 64) | F.col("proba_1").isNull()
    return p.groupBy("model_stage").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"),
                                        F.count_if(bad).alias("n_bad"))


@register("search", covers="L3 L4 K5 A16")
def q_search(spark, d):
    t = _training_table(spark, d).where("split = 'train'")
    fitted, draws = ml.random_search(t, CAT, NUM, "label", SPACE, n_iter=2, folds=2, entity_key="entity_key")
    rows = ml.cv_table(fitted, draws)
    best = draws[max(range(len(rows)), key=lambda i: rows[i][1])]
    # L4: a second, narrow round around the broad round's best candidate
    narrow = ml.refine_space(best, {"maxDepth": [-1, 1]}, {"stepSize": [0.5, 2.0]},
                             {"maxDepth": (1, 10), "stepSize": (0.01, 1.0)})
    fitted2, draws2 = ml.random_search(t, CAT, NUM, "label", narrow, n_iter=2, folds=2, seed=43, entity_key="entity_key")
    out = [("broad", i, str(draws[i]), m, s) for i, m, s in rows]
    out += [("narrow", i, str(draws2[i]), m, s) for i, m, s in ml.cv_table(fitted2, draws2)]
    return spark.createDataFrame(out, "round string, candidate int, params string, mean_score double, std_score double")


@register("kmeans", covers="L8")
def q_kmeans(spark, d):
    li = table(spark, d, "lineitem")
    numeric = [f.name for f in li.schema.fields if isinstance(f.dataType, T.FractionalType)]
    costs, centers = ml.kmeans_elbow(li, numeric, range(2, 21))
    rows = [(k, c, [dict(zip(numeric, x)) for x in centers] if k == len(centers) else None) for k, c in costs]
    return spark.createDataFrame(rows, "k int, inertia double, centers array<map<string, double>>")


@register("feature_importance", covers="L6 O4")
def q_feature_importance(spark, d):
    t = _training_table(spark, d).where("split = 'train'")
    model = ml.train(t, CAT, NUM, "label", maxIter=5, maxDepth=3)
    return ml.feature_importances(model, [f"{c}" for c in CAT] + NUM, spark, k=20)


@register("permutation_importance", covers="L7 K4")
def q_permutation_importance(spark, d):
    t = _training_table(spark, d)
    model = ml.train(t.where("split = 'train'"), CAT, NUM, "label", maxIter=5, maxDepth=3)
    test = t.where("split = 'test'")
    return ml.permutation_importance(model, test, NUM, "label", "entity_key")
