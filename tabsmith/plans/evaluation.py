"""Plans for splits, evaluation metrics, drift, gates and snapshot catalogs.

The prediction table is derived from ``lineitem``: entity key
``l_orderkey-l_linenumber``, label ``l_returnflag = 'R'``, probability
``l_discount * 10`` (a second model: ``l_tax * 12.5``), continuous score
``l_extendedprice``, regression target ``l_extendedprice / 1000`` against
``l_quantity * 1.5``; the split is the portable hash split (test 0.2, val 0.1).
Drift compares rows shipped before 1998 (expected) with the rest (actual).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalar import threshold_class
from tabsmith.operators import drift, gates, metrics, split, synth
from tabsmith.operators.metrics import EPS64, linspace
from tabsmith.plans.base import r6, register, sql_float, table
from tabsmith.session import written
from tabsmith.sources import snapshots

SEED = 42
TEST, VAL = 0.2, 0.1
CUTOFF = "1998-01-01 00:00:00"

# ----------------------------------------------------------------- shared pieces

_KEY_SQL = "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))"
_U_SQL = (f"CAST(CAST(('0x' || substr(sha256(concat_ws(':', {_KEY_SQL}, '{SEED}')), 1, 15)) AS BIGINT) AS DOUBLE)"
          f" / 1.152921504606846976e18")
_SPLIT_SQL = (f"CASE WHEN u < {sql_float(TEST)} THEN 'test' "
              f"WHEN (u - {sql_float(TEST)}) / {sql_float(1 - TEST)} < {sql_float(VAL / (1 - TEST))} THEN 'val' "
              f"ELSE 'train' END")

PRED_CTE = f"""
p0 AS (SELECT {_KEY_SQL} AS entity_key, CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
              l_discount * 10 AS y_proba, l_tax * 12.5 AS y_proba_b, l_extendedprice AS score,
              l_extendedprice / 1000 AS y_reg, l_quantity * 1.5 AS yhat_reg, {_U_SQL} AS u
       FROM lineitem),
ps AS (SELECT *, {_SPLIT_SQL} AS split, CAST(y_proba >= 0.5 AS INTEGER) AS y_pred,
              CAST(y_proba_b >= 0.5 AS INTEGER) AS y_pred_b FROM p0)"""


def _predictions(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    p = li.select(key.alias("entity_key"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
                  (F.col("l_discount") * 10).alias("y_proba"), (F.col("l_tax") * 12.5).alias("y_proba_b"),
                  F.col("l_extendedprice").alias("score"), (F.col("l_extendedprice") / 1000).alias("y_reg"),
                  (F.col("l_quantity") * 1.5).alias("yhat_reg"))
    p = split.hash_split(p, "entity_key", TEST, VAL, SEED)
    t = metrics.resolve_threshold(None)  # M20: no stored threshold -> 0.5
    return p.withColumn("y_pred", threshold_class("y_proba", t)) \
        .withColumn("y_pred_b", threshold_class("y_proba_b", t))


def _ge_sum(col: str, pts: list[float]) -> str:
    """SQL for the number of points <= col (exact double literals)."""
    return " + ".join(f"CAST({col} >= {sql_float(t)} AS INTEGER)" for t in pts)


def _cls_base_sql(prob: str, pred: str, sfx: str = "") -> str:
    eps, one_m = sql_float(EPS64), sql_float(1 - EPS64)
    edges = linspace(11)
    return f"""
base{sfx} AS (SELECT split, count(*) AS n,
    count(*) FILTER (WHERE y_true = 0 AND {pred} = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND {pred} = 1) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND {pred} = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND {pred} = 1) AS tp,
    avg(y_true) AS positive_rate, avg({pred}) AS predicted_positive_rate,
    -avg(y_true * ln(pc) + (1 - y_true) * ln(1 - pc)) AS ll, avg(({prob} - y_true) * ({prob} - y_true)) AS brier_score
  FROM (SELECT *, least(greatest({prob}, {eps}), {one_m}) AS pc FROM ps) GROUP BY split),
sc{sfx} AS (SELECT split, {prob} AS s, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg
       FROM ps GROUP BY split, {prob}),
auc{sfx} AS (SELECT split, CASE WHEN max(P) > 0 AND max(N) > 0 THEN
          sum(pos * (COALESCE(nb, 0) + neg / 2e0)) / (CAST(max(P) AS DOUBLE) * max(N)) END AS roc_auc
        FROM (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
                     sum(pos) OVER (PARTITION BY split) AS P, sum(neg) OVER (PARTITION BY split) AS N FROM sc{sfx}) GROUP BY split),
ap{sfx} AS (SELECT split, CASE WHEN max(P) > 0 THEN sum((CAST(pos AS DOUBLE) / P) * (CAST(tc AS DOUBLE) / (tc + fc))) END AS pr_auc
       FROM (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tc,
                    sum(neg) OVER (PARTITION BY split ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc,
                    sum(pos) OVER (PARTITION BY split) AS P FROM sc{sfx}) GROUP BY split),
eb{sfx} AS (SELECT split, {_ge_sum(prob, edges)} - 1 AS bin, count(*) AS cnt, avg(y_true) AS acc, avg({prob}) AS conf
       FROM ps GROUP BY split, bin),
ece{sfx} AS (SELECT split, sum(CASE WHEN bin >= 0 AND bin < 10 THEN abs(acc - conf) * cnt ELSE 0 END) / sum(cnt) AS ece
        FROM eb{sfx} GROUP BY split),
cm{sfx} AS (SELECT base.split, n, tn, fp, fn, tp, positive_rate, predicted_positive_rate,
    (tp + tn) / n AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
    CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
         WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END AS balanced_accuracy,
    CASE WHEN (tp + fn > 0 OR tp + fp > 0) AND (tn + fp > 0 OR tn + fn > 0)
         THEN CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END END AS specificity,
    CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN ll END AS log_loss, brier_score, roc_auc, pr_auc, ece
  FROM base{sfx} base LEFT JOIN auc{sfx} auc ON base.split = auc.split LEFT JOIN ap{sfx} ap ON base.split = ap.split
            LEFT JOIN ece{sfx} ece ON base.split = ece.split)"""


_CLS_COLS = ["positive_rate", "predicted_positive_rate", "accuracy", "precision", "recall", "f1",
             "balanced_accuracy", "specificity", "log_loss", "brier_score", "roc_auc", "pr_auc", "ece"]


def _cls_metrics(spark, d, prob="y_proba", pred="y_pred"):
    p = _predictions(spark, d)
    return metrics.classification_metrics(p, "y_true", pred, prob, ["split"])


def _both_models(spark, d):
    """Metrics of the production and the candidate model, from one reduction."""
    models = {"production": ("y_pred", "y_proba"), "candidate": ("y_pred_b", "y_proba_b")}
    both = metrics.metrics_of_models(_predictions(spark, d), "y_true", models)
    return both.where("model = 'production'"), both.where("model = 'candidate'")


# ----------------------------------------------------------------- splits

@register("split_hash", covers="K1 K3", sql=f"""
WITH {PRED_CTE}
SELECT entity_key, split FROM ps
""")
def q_split_hash(spark, d):
    return _predictions(spark, d).select("entity_key", "split")


_EXACT_SQL = f"""
x AS (SELECT {_KEY_SQL} AS entity_key, CAST(l_returnflag = 'R' AS INTEGER) AS y, {_U_SQL} AS u FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY u, entity_key) - 1 AS rn, count(*) OVER (PARTITION BY y) AS n FROM x),
s AS (SELECT *, ceil(n * {sql_float(TEST)}) AS n_test,
             ceil((n - ceil(n * {sql_float(TEST)})) * {sql_float(VAL / (1 - TEST))}) AS n_val FROM r),
ex AS (SELECT entity_key, y, CASE WHEN rn < n_test THEN 'test' WHEN rn < n_test + n_val THEN 'val' ELSE 'train' END AS split FROM s)"""


def _exact(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    x = li.select(key.alias("entity_key"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return split.exact_split(x, "entity_key", TEST, VAL, stratify_by="y", seed=SEED)


@register("split_exact", covers="K1 K2 K3", sql=f"WITH {_EXACT_SQL}\nSELECT entity_key, split FROM ex")
def q_split_exact(spark, d):
    return _exact(spark, d).select("entity_key", "split")


@register("split_report", covers="K3 A1 A2", sql=f"""
WITH {_EXACT_SQL}
SELECT c.split, c.y AS class, c.n_rows, c.n_rows / t.n_split AS share, t.n_split, t.positive_rate
FROM (SELECT split, y, count(*) AS n_rows FROM ex GROUP BY split, y) c
JOIN (SELECT split, count(*) AS n_split, avg(y) AS positive_rate FROM ex GROUP BY split) t ON c.split = t.split
""")
def q_split_report(spark, d):
    return split.split_report(_exact(spark, d), "y")


@register("cv_folds", covers="K5", sql=f"""
WITH x AS (SELECT {_KEY_SQL} AS entity_key, CAST(l_returnflag = 'R' AS INTEGER) AS y, {_U_SQL} AS u FROM lineitem)
SELECT entity_key, CAST((row_number() OVER (PARTITION BY y ORDER BY u, entity_key) - 1) % 3 AS INTEGER) AS fold FROM x
""")
def q_cv_folds(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    x = li.select(key.alias("entity_key"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return split.cv_folds(x, "entity_key", 3, stratify_by="y", seed=SEED).select("entity_key", "fold")


@register("entity_folds", covers="K5 L3", sql=f"""
WITH x AS (SELECT {_KEY_SQL} AS entity_key, max(CAST(l_returnflag = 'R' AS INTEGER)) AS y, any_value({_U_SQL}) AS u
           FROM lineitem GROUP BY 1),
f AS (SELECT entity_key, CAST((row_number() OVER (PARTITION BY y ORDER BY u, entity_key) - 1) % 3 AS INTEGER) AS fold FROM x)
SELECT f.entity_key, f.fold, count(*) AS n_rows FROM f JOIN lineitem ON f.entity_key = {_KEY_SQL} GROUP BY 1, 2
""")
def q_entity_folds(spark, d):
    """Rows of each entity and fold; a repeated key is in one fold only."""
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    x = li.select(key.alias("entity_key"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return split.entity_folds(x, "entity_key", 3, "y", SEED).groupBy("entity_key", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("attribution_sample", covers="K4", sql=f"""
SELECT {_KEY_SQL} AS entity_key FROM lineitem ORDER BY {_U_SQL}, entity_key LIMIT 1000
""")
def q_attribution_sample(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return split.attribution_sample(li.select(key.alias("entity_key")), "entity_key", 1000, SEED)


# ----------------------------------------------------------------- classification metrics

@register("confusion", covers="A15 X16 M20", sql=f"""
WITH {PRED_CTE}
SELECT split, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp
FROM ps GROUP BY split
""")
def q_confusion(spark, d):
    return metrics.confusion_counts(_predictions(spark, d), "y_true", "y_pred")


@register("classification_report", covers="A15 M3", sql=f"""
WITH {PRED_CTE},
t AS (SELECT split, y_true AS class, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS tp FROM ps GROUP BY 1, 2),
pr AS (SELECT split, y_pred AS class, count(*) AS predicted FROM ps GROUP BY 1, 2),
j AS (SELECT COALESCE(t.split, pr.split) AS split, COALESCE(t.class, pr.class) AS class, COALESCE(support, 0) AS support,
             COALESCE(tp, 0) AS tp, COALESCE(predicted, 0) AS predicted
      FROM t FULL OUTER JOIN pr ON t.split = pr.split AND t.class = pr.class),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr_, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM j)
SELECT split, class, round(pr_, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr_ + rc > 0 THEN 2 * pr_ * rc / (pr_ + rc) ELSE 0.0 END, 6) AS f1, CAST(support AS BIGINT) AS support
FROM m
""")
def q_classification_report(spark, d):
    r = metrics.classification_report(_predictions(spark, d), "y_true", "y_pred")
    return r.select("split", "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("classification_metrics", covers="M1 M2 M3 M4 M5 M6 M7 M8 M9 M10 M11 M12", sql=f"""
WITH {PRED_CTE}, {_cls_base_sql('y_proba', 'y_pred')}
SELECT split, n, tn, fp, fn, tp, {', '.join(f'round({c}, 6) AS {c}' for c in _CLS_COLS)} FROM cm
""")
def q_classification_metrics(spark, d):
    m = _cls_metrics(spark, d)
    return m.select("split", "n", "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in _CLS_COLS])


@register("metrics_without_proba", covers="M12", sql=f"""
WITH {PRED_CTE}
SELECT split, round(avg(CAST(y_true = y_pred AS INTEGER)), 6) AS accuracy, NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS log_loss
FROM ps GROUP BY split
""")
def q_metrics_without_proba(spark, d):
    m = metrics.classification_metrics(_predictions(spark, d), "y_true", "y_pred", None, ["split"])
    return m.select("split", r6("accuracy").alias("accuracy"), "roc_auc", "log_loss")


@register("roc_auc", covers="M7 W6", sql=f"""
WITH {PRED_CTE},
sc AS (SELECT split, score AS s, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM ps GROUP BY 1, 2)
SELECT split, round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN
         sum(pos * (COALESCE(nb, 0) + neg / 2e0)) / (CAST(max(P) AS DOUBLE) * max(N)) END, 6) AS roc_auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
             sum(pos) OVER (PARTITION BY split) AS P, sum(neg) OVER (PARTITION BY split) AS N FROM sc)
GROUP BY split
""")
def q_roc_auc(spark, d):
    return metrics.roc_auc(_predictions(spark, d), "y_true", "score").select("split", r6("roc_auc").alias("roc_auc"))


@register("average_precision", covers="M8", sql=f"""
WITH {PRED_CTE},
sc AS (SELECT split, score AS s, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM ps GROUP BY 1, 2)
SELECT split, round(CASE WHEN max(P) > 0 THEN sum((CAST(pos AS DOUBLE) / P) * (CAST(tc AS DOUBLE) / (tc + fc))) END, 6) AS pr_auc
FROM (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tc,
             sum(neg) OVER (PARTITION BY split ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc,
             sum(pos) OVER (PARTITION BY split) AS P FROM sc)
GROUP BY split
""")
def q_average_precision(spark, d):
    return metrics.average_precision(_predictions(spark, d), "y_true", "score") \
        .select("split", r6("pr_auc").alias("pr_auc"))


@register("roc_curve", covers="M21", sql=f"""
WITH {PRED_CTE},
sc AS (SELECT split, score AS s, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM ps GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tc,
             sum(neg) OVER (PARTITION BY split ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc,
             sum(pos) OVER (PARTITION BY split) AS P, sum(neg) OVER (PARTITION BY split) AS N FROM sc)
SELECT split, s AS threshold, round(fc / N, 6) AS fpr, round(tc / P, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT split, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ps
""")
def q_roc_curve(spark, d):
    c = metrics.roc_curve(_predictions(spark, d), "y_true", "score")
    return c.select("split", "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("ece", covers="M11", sql=f"""
WITH {PRED_CTE},
eb AS (SELECT split, {_ge_sum('y_proba', linspace(11))} - 1 AS bin, count(*) AS cnt, avg(y_true) AS acc, avg(y_proba) AS conf
       FROM ps GROUP BY split, bin)
SELECT split, round(sum(CASE WHEN bin >= 0 AND bin < 10 THEN abs(acc - conf) * cnt ELSE 0 END) / sum(cnt), 6) AS ece
FROM eb GROUP BY split
""")
def q_ece(spark, d):
    return metrics.expected_calibration_error(_predictions(spark, d), "y_true", "y_proba").select(
        "split", r6("ece").alias("ece"))


_F1_CTE = f"""
cb AS (SELECT split, {_ge_sum('y_proba', linspace(101))} AS b, CAST(sum(y_true) AS BIGINT) AS pos,
              CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM ps GROUP BY split, b),
tot AS (SELECT split, sum(pos) AS P FROM cb GROUP BY split),
g AS (SELECT tot.split, P, i FROM tot, range(0, 101) r(i)),
gj AS (SELECT g.split, g.P, g.i, COALESCE(cb.pos, 0) AS pos_i, COALESCE(cb.neg, 0) AS neg_i
       FROM g LEFT JOIN cb ON g.split = cb.split AND g.i + 1 = cb.b),
cur AS (SELECT split, i, P, sum(pos_i) OVER (PARTITION BY split ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg_i) OVER (PARTITION BY split ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS fp FROM gj),
f AS (SELECT split, i, list_extract([{', '.join(sql_float(t) for t in linspace(101))}], i + 1) AS threshold,
             CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0.0 END AS f1 FROM cur)"""


@register("f1_curve", covers="M13", sql=f"""
WITH {PRED_CTE}, {_F1_CTE}
SELECT split, CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f
""")
def q_f1_curve(spark, d):
    c = metrics.f1_by_threshold(_predictions(spark, d), "y_true", "y_proba")
    return c.select("split", "i", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@register("best_f1", covers="M13 M19", sql=f"""
WITH {PRED_CTE}, {_F1_CTE}
SELECT split, round(threshold, 6) AS best_threshold, round(f1, 6) AS best_f1
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f1 DESC, i ASC) AS rk FROM f) WHERE rk = 1
""")
def q_best_f1(spark, d):
    b = metrics.best_f1_threshold(_predictions(spark, d), "y_true", "y_proba")
    return b.select("split", r6("best_threshold").alias("best_threshold"), r6("best_f1").alias("best_f1"))


@register("regression_metrics", covers="M14 M15 M16 M17 M18 X17", sql=f"""
WITH {PRED_CTE}
SELECT split, count(*) AS n, round(avg(abs(y_reg - yhat_reg)), 6) AS mae,
  round(avg((y_reg - yhat_reg) * (y_reg - yhat_reg)), 6) AS mse,
  round(sqrt(avg((y_reg - yhat_reg) * (y_reg - yhat_reg))), 6) AS rmse,
  round(CASE WHEN var_pop(y_reg) * count(y_reg) > 0 THEN 1 - sum((y_reg - yhat_reg) * (y_reg - yhat_reg)) / (var_pop(y_reg) * count(y_reg))
             WHEN sum((y_reg - yhat_reg) * (y_reg - yhat_reg)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
  round(CASE WHEN var_pop(y_reg) > 0 THEN 1 - var_pop(y_reg - yhat_reg) / var_pop(y_reg)
             WHEN var_pop(y_reg - yhat_reg) = 0 THEN 1.0 ELSE 0.0 END, 6) AS explained_variance,
  round(avg(y_reg - yhat_reg), 6) AS residual_mean, round(stddev_samp(y_reg - yhat_reg), 6) AS residual_std,
  round(quantile_cont(abs(y_reg - yhat_reg), 0.5), 6) AS median_ae
FROM ps GROUP BY split
""")
def q_regression_metrics(spark, d):
    m = metrics.regression_metrics(_predictions(spark, d), "y_reg", "yhat_reg")
    cols = ["mae", "mse", "rmse", "r2", "explained_variance", "residual_mean", "residual_std", "median_ae"]
    return m.select("split", "n", *[r6(c).alias(c) for c in cols])


@register("class_stats", covers="A3", sql="""
SELECT quality AS class, count(*) AS n_class, CAST(sum(count(*)) OVER () AS BIGINT) AS n,
       min(count(*)) OVER () / sum(count(*)) OVER () AS minority_ratio
FROM labels GROUP BY quality
""")
def q_class_stats(spark, d):
    s = metrics.class_stats(table(spark, d, "labels"), "quality")
    return s.select("class", "n_class", F.col("n").cast("long").alias("n"), "minority_ratio")


_Y_SQL = "CAST(l_returnflag = 'R' AS INTEGER)"


@register("class_weights", covers="M22", sql=f"""
SELECT class, round(n / (k * n_class), 6) AS weight FROM (
  SELECT {_Y_SQL} AS class, count(*) AS n_class, sum(count(*)) OVER () AS n, count(*) OVER () AS k
  FROM lineitem GROUP BY 1)
""")
def q_class_weights(spark, d):
    y = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    w = metrics.class_weights(metrics.class_stats(y, "y"), "balanced")
    return w.select("class", r6("weight").alias("weight"))


@register("class_weight_policies", covers="M22", sql=f"""
WITH s AS (SELECT y AS class, c, sum(c) OVER () AS n, count(*) OVER () AS k, min(c) OVER () / sum(c) OVER () AS minority,
                  sum(c) OVER () - c AS others FROM (SELECT {_Y_SQL} AS y, count(*) AS c FROM lineitem GROUP BY 1))
SELECT p.policy, g.strategy, s.class,
       round(CASE WHEN g.strategy = 'balanced' THEN n / (k * c) WHEN class = 1 THEN others / c ELSE 1.0 END, 6) AS weight
FROM s, (VALUES ('off'), ('if_imbalanced'), ('always')) p(policy), (VALUES ('balanced'), ('ratio')) g(strategy)
WHERE p.policy = 'always' OR (p.policy = 'if_imbalanced' AND minority < 0.4)
""")
def q_class_weight_policies(spark, d):
    y = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    stats = written(metrics.class_stats(y, "y"), "class-stats")
    parts = [metrics.class_weights(stats, p, 0.4, strategy=g).select(
        F.lit(p).alias("policy"), F.lit(g).alias("strategy"), "class", r6("weight").alias("weight"))
        for p in ("off", "if_imbalanced", "always") for g in ("balanced", "ratio")]
    return reduce(DataFrame.unionByName, parts)


@register("metric_choice", covers="M23 A3", sql=f"""
SELECT round(min(c) / sum(c), 6) AS minority_ratio,
       CASE WHEN min(c) / sum(c) < 0.4 THEN 'average_precision' ELSE 'roc_auc' END AS metric
FROM (SELECT count(*) AS c FROM lineitem GROUP BY {_Y_SQL})
""")
def q_metric_choice(spark, d):
    y = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    m = metrics.metric_choice(metrics.class_stats(y, "y"), threshold=0.4)
    return m.select(r6("minority_ratio").alias("minority_ratio"), "metric")


# ----------------------------------------------------------------- drift

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TXT = ["l_returnflag", "l_linestatus"]
_EXP_SQL = f"l_shipdate < TIMESTAMP '{CUTOFF}'"


def _sides(spark, d):
    li = table(spark, d, "lineitem")
    cut = F.col("l_shipdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    cols = _NUM + _TXT
    return li.where(cut).select(*cols), li.where(~cut).select(*cols)


@register("drift_method", covers="D1 A4", sql="\nUNION ALL\n".join(
    [f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) >= 20 THEN 'ks' ELSE 'psi' END AS method FROM lineitem WHERE {_EXP_SQL}"
     for c in _NUM] + [f"SELECT '{c}', NULL::BIGINT, 'psi'" for c in _TXT]))
def q_drift_method(spark, d):
    e, _ = _sides(spark, d)
    return drift.drift_methods(e, _NUM + _TXT)


def _psi_num_sql(c: str) -> str:
    edges = " + ".join(f"CAST(v > {i} * step + lo AS INTEGER)" for i in range(10))
    return f"""SELECT '{c}' AS feature, round(sum((e - a) * ln(e / a)), 6) AS score FROM (
  SELECT CASE WHEN e_cnt = 0 THEN 1e-6 ELSE e_cnt / e_tot END AS e, CASE WHEN a_cnt = 0 THEN 1e-6 ELSE a_cnt / a_tot END AS a
  FROM (SELECT bin, count(*) FILTER (WHERE side = 'e') AS e_cnt, count(*) FILTER (WHERE side = 'a') AS a_cnt,
               sum(count(*) FILTER (WHERE side = 'e')) OVER () AS e_tot, sum(count(*) FILTER (WHERE side = 'a')) OVER () AS a_tot
        FROM (SELECT side, ({edges}) + CAST(v = lo AS INTEGER) AS bin
              FROM (SELECT CASE WHEN {_EXP_SQL} THEN 'e' ELSE 'a' END AS side, CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL) x,
                   (SELECT lo, hi, (hi - lo) / 10 AS step FROM (
                      SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                             CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
                      FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {_EXP_SQL}))) st
              WHERE v >= lo AND v <= hi)
        GROUP BY bin))"""


def _psi_cat_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(sum((e - a) * ln(e / a)), 6) AS score FROM (
  SELECT CASE WHEN e_cnt = 0 THEN 1e-6 ELSE e_cnt / e_tot END AS e, CASE WHEN a_cnt = 0 THEN 1e-6 ELSE a_cnt / a_tot END AS a
  FROM (SELECT v, count(*) FILTER (WHERE side = 'e') AS e_cnt, count(*) FILTER (WHERE side = 'a') AS a_cnt,
               sum(count(*) FILTER (WHERE side = 'e')) OVER () AS e_tot, sum(count(*) FILTER (WHERE side = 'a')) OVER () AS a_tot
        FROM (SELECT CASE WHEN {_EXP_SQL} THEN 'e' ELSE 'a' END AS side, CAST({c} AS VARCHAR) AS v FROM lineitem WHERE {c} IS NOT NULL)
        GROUP BY v))"""


def _ks_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(max(abs(ce / E - ca / A)), 6) AS score FROM (
  SELECT sum(e) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ce, sum(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ca,
         sum(e) OVER () AS E, sum(a) OVER () AS A
  FROM (SELECT v, count(*) FILTER (WHERE side = 'e') AS e, count(*) FILTER (WHERE side = 'a') AS a
        FROM (SELECT CASE WHEN {_EXP_SQL} THEN 'e' ELSE 'a' END AS side, CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL)
        GROUP BY v))"""


_PSI_NUM = ["l_discount", "l_tax"]
_KS = ["l_quantity", "l_extendedprice"]


@register("psi_numeric", covers="D2", sql="\nUNION ALL\n".join(_psi_num_sql(c) for c in _PSI_NUM))
def q_psi_numeric(spark, d):
    e, a = _sides(spark, d)
    return drift.psi_numeric(drift.long_form(e, a, _PSI_NUM, False)).select("feature", r6("score").alias("score"))


@register("psi_categorical", covers="D3", sql="\nUNION ALL\n".join(_psi_cat_sql(c) for c in _TXT))
def q_psi_categorical(spark, d):
    e, a = _sides(spark, d)
    return drift.psi_categorical(drift.long_form(e, a, _TXT, True)).select("feature", r6("score").alias("score"))


@register("ks", covers="D4 W5", sql="\nUNION ALL\n".join(_ks_sql(c) for c in _KS))
def q_ks(spark, d):
    e, a = _sides(spark, d)
    return drift.ks_statistic(drift.long_form(e, a, _KS, False)).select("feature", r6("score").alias("score"))


_SEV = "CASE WHEN score < 0.1 THEN 'low' WHEN score < 0.25 THEN 'moderate' WHEN score < 0.5 THEN 'high' ELSE 'severe' END"


@register("drift_all", covers="D5 D6 D1 Q16 D10", sql=f"""
SELECT feature, method, round(score, 6) AS score, {_SEV} AS severity FROM (
  {' UNION ALL '.join([f"SELECT feature, 'ks' AS method, score FROM ({_ks_sql(c).replace('round(max(abs(ce / E - ca / A)), 6)', 'max(abs(ce / E - ca / A))')})" for c in _KS]
                      + [f"SELECT feature, 'psi', score FROM ({_psi_num_sql(c).replace('round(sum((e - a) * ln(e / a)), 6)', 'sum((e - a) * ln(e / a))')})" for c in _PSI_NUM]
                      + [f"SELECT feature, 'psi', score FROM ({_psi_cat_sql(c).replace('round(sum((e - a) * ln(e / a)), 6)', 'sum((e - a) * ln(e / a))')})" for c in _TXT])})
""")
def q_drift_all(spark, d):
    e, a = _sides(spark, d)
    rep = drift.validated(drift.drift_report(e, a, _NUM + _TXT))
    return rep.select("feature", "method", r6("score").alias("score"), "severity")


@register("similarity", covers="Y9", sql=f"""
SELECT feature, round(1 - score, 6) AS similarity FROM ({' UNION ALL '.join(
    _ks_sql(c).replace('round(max(abs(ce / E - ca / A)), 6)', 'max(abs(ce / E - ca / A))') for c in ['l_quantity', 'l_discount'])})
UNION ALL
SELECT feature, round(1 - 0.5 * sum(abs(e / te - a / ta)), 6) FROM (
  SELECT feature, e, a, sum(e) OVER (PARTITION BY feature) AS te, sum(a) OVER (PARTITION BY feature) AS ta FROM (
    SELECT feature, v, count(*) FILTER (WHERE side = 'e') AS e, count(*) FILTER (WHERE side = 'a') AS a FROM (
      {' UNION ALL '.join(f"SELECT '{c}' AS feature, CASE WHEN {_EXP_SQL} THEN 'e' ELSE 'a' END AS side, CAST({c} AS VARCHAR) AS v FROM lineitem WHERE {c} IS NOT NULL" for c in _TXT)})
    GROUP BY feature, v))
GROUP BY feature
""")
def q_similarity(spark, d):
    e, a = _sides(spark, d)
    s = synth.similarity_score(e, a, ["l_quantity", "l_discount"], _TXT)
    return s.select("feature", r6("similarity").alias("similarity"))


# ----------------------------------------------------------------- monitoring and gates

# Metric directions used by the monitoring and promotion examples.
DIRECTIONS = [("accuracy", "maximize"), ("precision", "maximize"), ("recall", "maximize"), ("f1", "maximize"),
              ("roc_auc", "maximize"), ("pr_auc", "maximize"), ("log_loss", "minimize"), ("brier_score", "minimize")]


def _long_metrics(m, split_name=None):
    names = [n for n, _ in DIRECTIONS]
    sel = m if split_name is None else m.where(F.col("split") == split_name)
    return sel.select("split", *[F.col(n).cast("double") for n in names]).unpivot(["split"], names, "metric", "value")


def _long_sql(source: str, where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT split, '{n}' AS metric, {n} AS value FROM {source} {where}" for n, _ in DIRECTIONS)


def _dir_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, '{dd}' AS direction" for n, dd in DIRECTIONS)


@register("performance_assessment", covers="D7 D8", sql=f"""
WITH {PRED_CTE}, {_cls_base_sql('y_proba', 'y_pred')},
lm AS ({_long_sql('cm')}), dirs AS ({_dir_sql()}),
cur AS (SELECT metric, value AS current FROM lm WHERE split = 'test'),
ex AS (SELECT metric, value AS expected FROM lm WHERE split = 'train')
SELECT cur.metric, dirs.direction, round(current, 6) AS current, round(expected, 6) AS expected,
  CASE WHEN direction = 'maximize' AND current < expected THEN 'degradation'
       WHEN direction = 'minimize' AND current > expected THEN 'degradation' ELSE 'acceptable' END AS status
FROM cur JOIN ex ON cur.metric = ex.metric JOIN dirs ON cur.metric = dirs.metric
""")
def q_performance_assessment(spark, d):
    lm = _long_metrics(_both_models(spark, d)[0])
    cur = lm.where("split = 'test'").select("metric", F.col("value").alias("current"))
    exp = lm.where("split = 'train'").select("metric", F.col("value").alias("expected"))
    dirs = spark.createDataFrame(DIRECTIONS, "metric string, direction string")
    out = drift.performance_assessment(cur, exp, dirs)
    return out.select("metric", "direction", r6("current").alias("current"), r6("expected").alias("expected"), "status")


@register("stage_compare", covers="D9", sql=f"""
WITH {PRED_CTE}, {_cls_base_sql('y_proba', 'y_pred')}, {_cls_base_sql('y_proba_b', 'y_pred_b', '_b')},
lm_a AS ({_long_sql('cm', "WHERE split = 'test'")}), lm_b AS ({_long_sql('cm_b', "WHERE split = 'test'")}),
dirs AS ({_dir_sql()})
SELECT metric, direction, round(production, 6) AS production, round(staging, 6) AS staging,
       round(difference, 6) AS difference,
       CASE WHEN difference > 0 THEN 'improvement' WHEN difference < 0 THEN 'degradation' ELSE 'no_change' END AS status
FROM (SELECT a.metric, dirs.direction, a.value AS production, b.value AS staging,
             CASE WHEN dirs.direction = 'maximize' THEN b.value - a.value ELSE a.value - b.value END AS difference
      FROM lm_a a JOIN lm_b b ON a.metric = b.metric JOIN dirs ON a.metric = dirs.metric)
""")
def q_stage_compare(spark, d):
    dirs = spark.createDataFrame(DIRECTIONS, "metric string, direction string")
    production, candidate = _both_models(spark, d)
    prod = _long_metrics(production, "test").join(dirs, "metric").select("metric", "value", "direction")
    stag = _long_metrics(candidate, "test").join(dirs, "metric").select("metric", "value", "direction")
    cmp = drift.validated_stages(drift.compare_stages(prod, stag))
    return cmp.select("metric", "direction", r6("production").alias("production"), r6("staging").alias("staging"),
                      r6("difference").alias("difference"), "status")


# Promotion thresholds of the gate example (split, metric, direction, threshold).
THRESHOLDS = [("val", "accuracy", "maximize", 0.5), ("val", "roc_auc", "maximize", 0.45),
              ("test", "f1", "maximize", 0.2), ("test", "log_loss", "minimize", 30.0)]


def _gate_inputs(spark, d):
    prod, cand = map(_long_metrics, _both_models(spark, d))
    th = spark.createDataFrame([(s, m, dd, t, i) for i, (s, m, dd, t) in enumerate(THRESHOLDS)],
                               "split string, metric string, direction string, threshold double, ord int")
    return cand, prod, th


def _th_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS split, '{m}' AS metric, '{dd}' AS direction, {sql_float(t)} AS threshold"
                              for s, m, dd, t in THRESHOLDS)


_GATE_CTE = f"""
{PRED_CTE}, {_cls_base_sql('y_proba_b', 'y_pred_b', '_b')}, {_cls_base_sql('y_proba', 'y_pred')},
cand AS ({_long_sql('cm_b')}), th AS ({_th_sql()}), prod AS ({_long_sql('cm')}),
g1 AS (SELECT th.split, th.metric, COALESCE(CASE WHEN direction = 'maximize' THEN value > threshold + 1e-8
                                                 WHEN direction = 'minimize' THEN value < threshold - 1e-8 END, FALSE) AS passed
       FROM th LEFT JOIN cand ON th.split = cand.split AND th.metric = cand.metric),
g2 AS (SELECT th.split, th.metric, COALESCE(CASE WHEN direction = 'maximize' THEN c.value > p.value + 1e-8
                                                 WHEN direction = 'minimize' THEN c.value < p.value - 1e-8 END, FALSE) AS passed
       FROM th LEFT JOIN cand c ON th.split = c.split AND th.metric = c.metric
               LEFT JOIN prod p ON th.split = p.split AND th.metric = p.metric)"""


@register("gate_checks", covers="G1 G2", sql=f"""
WITH {_GATE_CTE}
SELECT 'thresholds' AS gate, split, metric, passed FROM g1 UNION ALL SELECT 'production', split, metric, passed FROM g2
""")
def q_gate_checks(spark, d):
    cand, prod, th = _gate_inputs(spark, d)
    a = gates.threshold_checks(cand, th).select(F.lit("thresholds").alias("gate"), "split", "metric", "passed")
    b = gates.production_checks(cand, prod, th).select(F.lit("production").alias("gate"), "split", "metric", "passed")
    return a.unionByName(b)


@register("gate_without_production", covers="G2 G3", sql=f"""
WITH {_GATE_CTE}
SELECT bool_and(passed) AS meets_thresholds, TRUE AS beats_production, bool_and(passed) AS promote,
       coalesce(count(*) FILTER (WHERE NOT passed) > 0, FALSE) AS has_reason FROM g1
""")
def q_gate_without_production(spark, d):
    """The first model of all has no production model to beat; a failed gate gives its reason."""
    cand, _, th = _gate_inputs(spark, d)
    out = gates.gate_decision(cand, th, None, "production")
    return out.select("meets_thresholds", "beats_production", "promote", (F.length("reason") > 0).alias("has_reason"))


_REG_DIRECTIONS = [("mae", "minimize"), ("rmse", "minimize"), ("r2", "maximize")]


@register("performance_regression", covers="D7 D8 M14 M15", sql=f"""
WITH {PRED_CTE},
m AS (SELECT split, avg(abs(y_reg - yhat_reg)) AS mae, sqrt(avg((y_reg - yhat_reg) * (y_reg - yhat_reg))) AS rmse,
             1 - sum((y_reg - yhat_reg) * (y_reg - yhat_reg)) / (var_pop(y_reg) * count(*)) AS r2 FROM ps GROUP BY split),
l AS (SELECT split, unnest(['mae', 'rmse', 'r2']) AS metric, unnest([mae, rmse, r2]) AS value, unnest(['minimize', 'minimize', 'maximize']) AS direction FROM m)
SELECT c.metric, c.direction, round(c.value, 6) AS current, round(e.value, 6) AS expected,
  CASE WHEN c.direction = 'maximize' AND c.value < e.value THEN 'degradation'
       WHEN c.direction = 'minimize' AND c.value > e.value THEN 'degradation' ELSE 'acceptable' END AS status
FROM l c JOIN l e ON c.metric = e.metric WHERE c.split = 'test' AND e.split = 'train'
""")
def q_performance_regression(spark, d):
    """D7 for a regression: current errors against those expected from training."""
    m = metrics.regression_metrics(_predictions(spark, d), "y_reg", "yhat_reg", ["split"])
    long = m.unpivot(["split"], [n for n, _ in _REG_DIRECTIONS], "metric", "value")
    dirs = spark.createDataFrame(_REG_DIRECTIONS, "metric string, direction string")
    out = drift.performance_assessment(long.where("split = 'test'").select("metric", F.col("value").alias("current")),
                                       long.where("split = 'train'").select("metric", F.col("value").alias("expected")), dirs)
    return out.select("metric", "direction", r6("current").alias("current"), r6("expected").alias("expected"), "status")


@register("gate_decision", covers="G1 G2 G3", sql=f"""
WITH {_GATE_CTE}
SELECT m AS meets_thresholds, b AS beats_production, m AND b AS promote
FROM (SELECT (SELECT bool_and(passed) FROM g1) AS m, (SELECT bool_and(passed) FROM g2) AS b)
""")
def q_gate_decision(spark, d):
    cand, prod, th = _gate_inputs(spark, d)
    return gates.gate_decision(cand, th, prod, "production").select("meets_thresholds", "beats_production", "promote")


# ----------------------------------------------------------------- snapshot catalogs, search summaries

_CAT_SQL = """
cat AS (SELECT o_orderpriority AS name, 'v_' || o_orderstatus AS version,
               CASE WHEN o_totalprice < 5000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') END
               || '_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS snapshot_id FROM orders),
val AS (SELECT *, split_part(snapshot_id, '_', 1) AS ts, split_part(snapshot_id, '_', 2) AS uuid FROM cat
        WHERE len(string_split(snapshot_id, '_')) = 2 AND contains(split_part(snapshot_id, '_', 1), 'T')),
lat AS (SELECT name, version, snapshot_id AS latest_snapshot, n FROM (
          SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY ts DESC, uuid DESC) AS rn,
                 count(*) OVER (PARTITION BY name, version) AS n FROM val) WHERE rn = 1)"""


def _catalog(spark, d):
    o = table(spark, d, "orders")
    ts = F.when(F.col("o_totalprice") < 5000, F.date_format("o_orderdate", "yyyy-MM-dd")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH-mm-ss"))
    sid = F.concat_ws("_", ts, F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8))
    return o.select(F.col("o_orderpriority").alias("name"), F.concat(F.lit("v_"), "o_orderstatus").alias("version"),
                    sid.alias("snapshot_id"))


@register("latest_snapshot", covers="S8 S9", sql=f"""
WITH {_CAT_SQL}
SELECT name, version, latest_snapshot, n AS n_valid_snapshots FROM lat
""")
def q_latest_snapshot(spark, d):
    return snapshots.latest_snapshots(_catalog(spark, d))


@register("bindings", covers="S10", sql=f"""
WITH {_CAT_SQL},
req AS (SELECT name, version, CASE WHEN name = '1-URGENT' THEN min(snapshot_id) END AS given_snapshot FROM val GROUP BY name, version)
SELECT req.name, req.version, COALESCE(given_snapshot, latest_snapshot) AS snapshot
FROM req LEFT JOIN lat ON req.name = lat.name AND req.version = lat.version
""")
def q_bindings(spark, d):
    cat = _catalog(spark, d)
    valid = snapshots.parse_snapshot_ids(cat).where("snapshot_valid")
    req = valid.groupBy("name", "version").agg(
        F.when(F.col("name") == "1-URGENT", F.min("snapshot_id")).alias("given_snapshot"))
    out = snapshots.resolve_snapshots(req, snapshots.latest_snapshots(cat))
    return out.select("name", "version", "snapshot")


_CV_CTE = """
sc AS (SELECT p_brand AS candidate, LEAST(floor(u * 3), 2) AS fold, avg(p_retailprice) / 1000 AS score
       FROM (SELECT *, CAST(CAST(('0x' || substr(sha256(concat_ws(':', CAST(p_partkey AS VARCHAR), '42')), 1, 15)) AS BIGINT) AS DOUBLE)
                       / 1.152921504606846976e18 AS u FROM part) GROUP BY 1, 2),
sm AS (SELECT candidate, avg(score) AS mean_score, stddev_pop(score) AS std_score, count(*) AS n_folds FROM sc GROUP BY 1)"""


def _cv_scores(spark, d):
    p = table(spark, d, "part")
    f = split.cv_folds(p, "p_partkey", 3, seed=SEED)
    return f.groupBy(F.col("p_brand").alias("candidate"), "fold").agg((F.avg("p_retailprice") / 1000).alias("score"))


@register("cv_summary", covers="A16 W4", sql=f"""
WITH {_CV_CTE}
SELECT candidate, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, n_folds,
       CAST(rank() OVER (ORDER BY mean_score DESC) AS INTEGER) AS rank FROM sm
""")
def q_cv_summary(spark, d):
    s = metrics.cv_summary(_cv_scores(spark, d))
    return s.select("candidate", r6("mean_score").alias("mean_score"), r6("std_score").alias("std_score"),
                    "n_folds", "rank")


@register("best_candidate", covers="O6", sql=f"""
WITH {_CV_CTE}
SELECT candidate, round(mean_score, 6) AS mean_score FROM sm ORDER BY mean_score DESC, candidate LIMIT 1
""")
def q_best_candidate(spark, d):
    b = metrics.best_candidate(metrics.cv_summary(_cv_scores(spark, d)))
    return b.select("candidate", r6("mean_score").alias("mean_score"))


@register("topk_importance", covers="O4 A14", sql="""
SELECT feature, round(importance, 6) AS importance FROM (
  SELECT 'f' || CAST(i - 1 AS VARCHAR) AS feature, avg(abs(CAST(v AS DOUBLE))) AS importance
  FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY i)
ORDER BY importance DESC, feature LIMIT 10
""")
def q_topk_importance(spark, d):
    e = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "v"))
    long = e.select(F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature"), F.col("v").cast("double").alias("value"))
    imp = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    return imp.orderBy(F.col("importance").desc(), "feature").limit(10).select("feature", r6("importance").alias("importance"))


@register("ground_truth_join", covers="J7 D7 A15", sql="""
SELECT p.split, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp
FROM (SELECT o_orderkey AS entity_id, o_orderpriority AS split, CAST(o_totalprice > 250000 AS INTEGER) AS y_pred FROM orders) p
JOIN (SELECT o_orderkey AS entity_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y_true FROM orders) t ON p.entity_id = t.entity_id
GROUP BY p.split
""")
def q_ground_truth_join(spark, d):
    """Predictions carry no label; ground truth joins by the entity key (never by position)."""
    from tabsmith.operators.joins import join_ground_truth
    o = table(spark, d, "orders")
    preds = o.select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("split"),
                     (F.col("o_totalprice") > 250000).cast("int").alias("y_pred"))
    truth = o.select(F.col("o_orderkey").alias("entity_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y_true"))
    return metrics.confusion_counts(join_ground_truth(preds, truth, "entity_id"), "y_true", "y_pred")
