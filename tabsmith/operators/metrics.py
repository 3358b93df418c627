"""Evaluation metrics on a long prediction table.

Every metric is grouped by ``group_cols`` (``split`` by default, optionally
problem/segment/stage too), so all splits come out of one job.  Curve-based
metrics first reduce to one row per distinct score and then use the bucketed
prefix of :mod:`tabsmith.operators.prefix`; no step moves the data of a group
into one task.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.prefix import bucket_of, exact_quantiles, prefix_aggregate
from tabsmith.session import written

EPS64 = sys.float_info.epsilon


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def linspace(n_points: int) -> list[float]:
    """``numpy.linspace(0, 1, n_points)`` point by point: ``i * (1/(n-1))``, last = 1.0."""
    step = 1.0 / (n_points - 1)
    pts = [i * step for i in range(n_points)]
    pts[-1] = 1.0
    return pts


def resolve_threshold(stored: float | None, default: float = 0.5) -> float:
    """A missing stored threshold falls back to 0.5; outside [0, 1] is an error."""
    if stored is None:
        return default
    if not 0.0 <= float(stored) <= 1.0:
        raise ValueError(f"threshold {stored} outside [0, 1]")
    return float(stored)


def confusion_counts(df: DataFrame, y: str, y_pred: str, group_cols=("split",)) -> DataFrame:
    """A15 (binary): tn, fp, fn, tp in one aggregate."""
    yy, pp = _col(y), _col(y_pred)
    return df.groupBy(*group_cols).agg(
        F.count_if((yy == 0) & (pp == 0)).alias("tn"),
        F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 1) & (pp == 0)).alias("fn"),
        F.count_if((yy == 1) & (pp == 1)).alias("tp"),
    )


def classification_report(df: DataFrame, y: str, y_pred: str, group_cols=("split",)) -> DataFrame:
    """Per-class precision, recall, F1 and support (any number of classes)."""
    g = list(group_cols)
    truth = df.groupBy(*g, F.col(y).alias("class")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(y) == F.col(y_pred)).alias("tp"))
    pred = df.groupBy(*g, F.col(y_pred).alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    j = truth.join(pred, [*g, "class"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return j.select(*g, "class", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def prediction_counts(df: DataFrame, y: str, y_pred: str, prob: str | None, group_cols) -> DataFrame:
    """The one pass over the prediction table: positives and negatives per
    (group, score, predicted class).  Every classification metric below is
    computed from this reduction (one shuffle, map-side combined)."""
    yy = _col(y).cast("int")
    keys = [*group_cols, (_col(prob).cast("double") if prob is not None else F.lit(None).cast("double")).alias("score"),
            _col(y_pred).cast("int").alias("pred")]
    return df.groupBy(*keys).agg(F.sum(F.when(yy == 1, 1).otherwise(0)).cast("long").alias("pos"),
                                 F.sum(F.when(yy == 1, 0).otherwise(1)).cast("long").alias("neg"))


def classification_metrics(df: DataFrame, y: str, y_pred: str, prob: str | None = None,
                           group_cols=("split",), threshold: float | None = None,
                           include_curves: bool = True, reduced: DataFrame | None = None) -> DataFrame:
    """M1-M6, M9, M10, M12 (+ M7, M8, M11 when ``include_curves``), one row per group.

    Probability metrics are null when no probability column is given (M12).  ``reduced`` are the
    :func:`prediction_counts` of ``df`` where they are there already; ``df`` is then not read.
    """
    g = list(group_cols)
    if not g:
        return classification_metrics(df.withColumn("_all", F.lit(0)), y, y_pred, prob, ["_all"],
                                       threshold, include_curves).drop("_all")
    red = prediction_counts(df, y, y_pred, prob, g) if reduced is None else reduced
    pos, neg, pred, sc = F.col("pos"), F.col("neg"), F.col("pred"), F.col("score")
    cnt = pos + neg
    aggs = [
        F.sum(cnt).alias("n"),
        F.sum(F.when(pred == 0, neg).otherwise(0)).alias("tn"),
        F.sum(F.when(pred == 1, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(pred == 0, pos).otherwise(0)).alias("fn"),
        F.sum(F.when(pred == 1, pos).otherwise(0)).alias("tp"),
        F.sum(pos).alias("_pos"),
        F.sum(F.when(pred == 1, cnt).otherwise(0)).alias("_ppos"),
    ]
    if prob is not None:
        pc = F.least(F.greatest(sc, F.lit(EPS64)), F.lit(1 - EPS64))
        aggs += [
            F.sum(pos * F.log(pc) + neg * F.log(1 - pc)).alias("_ll"),
            F.sum(pos * (sc - 1) * (sc - 1) + neg * sc * sc).alias("_br"),
        ]
    base = red.groupBy(*g).agg(*aggs)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    P, N, n = tp + fn, tn + fp, F.col("n")
    recall_pos = F.when(P > 0, tp / P)
    recall_neg = F.when(N > 0, tn / N)
    out = base.select(
        *g, n.cast("long").alias("n"), *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")],
        (F.col("_pos") / n).alias("positive_rate"), (F.col("_ppos") / n).alias("predicted_positive_rate"),
        ((tp + tn) / n).alias("accuracy"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(P > 0, tp / P).otherwise(0.0).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when((P > 0) & (N > 0), (recall_pos + recall_neg) / 2)
         .when(P > 0, recall_pos).otherwise(recall_neg).alias("balanced_accuracy"),
        # the confusion matrix is 2x2 only when both labels occur in y or y_pred
        F.when(((P > 0) | (tp + fp > 0)) & ((N > 0) | (tn + fn > 0)),
               F.when(N > 0, tn / N).otherwise(0.0)).alias("specificity"),
        *([F.when((P > 0) & (N > 0), -F.col("_ll") / n).alias("log_loss"), (F.col("_br") / n).alias("brier_score")]
          if prob is not None else
          [F.lit(None).cast("double").alias("log_loss"), F.lit(None).cast("double").alias("brier_score")]),
    )
    if threshold is not None:
        out = out.withColumn("threshold", F.lit(float(threshold)))
    if include_curves:
        if prob is not None:
            by_score = red.groupBy(*g, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            raw = df.where(_col(prob).isNotNull()).select(*g, _col(prob).cast("double").alias("score")) if reduced is None \
                else red.where(F.col("score").isNotNull()).select(*g, "score")
            curve = _curve_from_counts(by_score.where(F.col("score").isNotNull()), g, None, raw)
            ranks = curve.groupBy(*g).agg(_auc_expr(), _ap_expr())
            out = out.join(ranks, g, "left").join(_ece_from_counts(by_score, g), g, "left")
        else:
            out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("roc_auc", "pr_auc", "ece")])
    return out


def metrics_of_models(df: DataFrame, y: str, models: dict[str, tuple[str, str]], group_cols=("split",)) -> DataFrame:
    """:func:`classification_metrics` of several models over one table, with a ``model`` column.

    ``models`` maps a name to its (prediction, probability) columns.  The table is read once: the
    model is one more group of the reduction, which is written, and so are the metrics, so gates
    and comparisons of any number read one small table."""
    g = list(group_cols)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), _col(pred).alias("_pred"), _col(prob).cast("double").alias("_prob"))
                               for name, (pred, prob) in models.items()]))
    long = df.select(*g, _col(y).alias("_y"), each.alias("m")).select(*g, "_y", "m.*")
    red = written(prediction_counts(long, "_y", "_pred", "_prob", ["model", *g]), "prediction-counts")
    return written(classification_metrics(long, "_y", "_pred", "_prob", ["model", *g], reduced=red), "metrics")


def score_counts(df: DataFrame, y: str, score: str, group_cols=("split",)) -> DataFrame:
    """Reduce to one row per (group, distinct score): positives and negatives."""
    yy = _col(y).cast("int")
    return df.where(_col(score).isNotNull()).groupBy(*group_cols, _col(score).cast("double").alias("score")).agg(
        F.sum(F.when(yy == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(yy == 1, 0).otherwise(1)).cast("long").alias("neg"))


def score_curve(df: DataFrame, y: str, score: str, group_cols=("split",), n_buckets=None) -> DataFrame:
    """One row per (group, distinct score) with positives/negatives below the
    score and group totals -- the single prefix pass behind M7, M8 and M21.

    Descending cumulative counts follow as ``total - below``.  Quantile
    boundaries come from the raw score column, so the reduction is computed
    once.
    """
    g = list(group_cols)
    c = score_counts(df, y, score, g)
    raw = df.where(_col(score).isNotNull()).select(*g, _col(score).cast("double").alias("score"))
    return _curve_from_counts(c, g, n_buckets, raw)


def _curve_from_counts(c: DataFrame, g: list, n_buckets, raw: DataFrame) -> DataFrame:
    return prefix_aggregate(c, ["score"], {"pos_below": ("sum", "pos"), "neg_below": ("sum", "neg")}, g,
                            inclusive=False, n_buckets=n_buckets, bounds_from=raw,
                            with_totals={"P": ("sum", "pos"), "N": ("sum", "neg")}) \
        .withColumn("pos_below", F.coalesce(F.col("pos_below"), F.lit(0))) \
        .withColumn("neg_below", F.coalesce(F.col("neg_below"), F.lit(0)))


def _auc_expr():
    num = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    P, N = F.max("P"), F.max("N")
    return F.when((P > 0) & (N > 0), num / (P * N)).alias("roc_auc")


def _ap_expr():
    tp_cum = F.col("P") - F.col("pos_below")  # positives with score >= this one
    fp_cum = F.col("N") - F.col("neg_below")
    term = (F.col("pos") / F.col("P")) * (tp_cum / (tp_cum + fp_cum))
    return F.when(F.max("P") > 0, F.sum(term)).alias("pr_auc")


def roc_auc(df: DataFrame, y: str, score: str, group_cols=("split",), n_buckets=None) -> DataFrame:
    """M7: Mann-Whitney on distinct scores, ties count half; one class -> null."""
    return score_curve(df, y, score, group_cols, n_buckets).groupBy(*group_cols).agg(_auc_expr())


def average_precision(df: DataFrame, y: str, score: str, group_cols=("split",), n_buckets=None) -> DataFrame:
    """M8: step-function average precision, Σ ΔR·P by descending score, ties merged."""
    return score_curve(df, y, score, group_cols, n_buckets).groupBy(*group_cols).agg(_ap_expr())


def ranking_metrics(df: DataFrame, y: str, score: str, group_cols=("split",), n_buckets=None) -> DataFrame:
    """M7 + M8 from one prefix pass."""
    return score_curve(df, y, score, group_cols, n_buckets).groupBy(*group_cols).agg(_auc_expr(), _ap_expr())


def roc_curve(df: DataFrame, y: str, score: str, group_cols=("split",), n_buckets=None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first (no
    intermediate points dropped), plus the (inf, 0, 0) start point."""
    g = list(group_cols)
    cur = score_curve(df, y, score, g, n_buckets)
    pts = cur.select(*g, F.col("score").alias("threshold"),
                     F.when(F.col("N") > 0, (F.col("N") - F.col("neg_below")) / F.col("N")).alias("fpr"),
                     F.when(F.col("P") > 0, (F.col("P") - F.col("pos_below")) / F.col("P")).alias("tpr"))
    start = df.groupBy(*g).agg(F.lit(float("inf")).alias("threshold"),
                               F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def _ece_from_counts(by_score: DataFrame, g: list, n_bins: int = 10, include_top: bool = False) -> DataFrame:
    edges = linspace(n_bins + 1)
    b = bucket_of(F.col("score"), edges) - 1
    if include_top:
        b = F.when(b == n_bins, n_bins - 1).otherwise(b)
    cnt = F.col("pos") + F.col("neg")
    per_bin = by_score.groupBy(*g, b.alias("bin")).agg(
        F.sum(cnt).alias("cnt"), F.sum("pos").alias("_p"), F.sum(F.col("score") * cnt).alias("_s"))
    inside = (F.col("bin") >= 0) & (F.col("bin") < n_bins)
    gap = F.abs(F.col("_p") / F.col("cnt") - F.col("_s") / F.col("cnt")) * F.col("cnt")
    return per_bin.groupBy(*g).agg((F.sum(F.when(inside, gap).otherwise(0.0)) / F.sum("cnt")).alias("ece"))


def expected_calibration_error(df: DataFrame, y: str, prob: str, group_cols=("split",),
                               n_bins: int = 10, include_top: bool = False) -> DataFrame:
    """Equal-width bins ``[lo, hi)``; ``p == 1.0`` lands in no bin but still
    counts in the weight denominator (reference behaviour); ``include_top``
    puts it in the last bin instead.  Rows are first reduced to distinct
    probabilities."""
    g = list(group_cols)
    return _ece_from_counts(score_counts(df, y, prob, g), g, n_bins, include_top)


def f1_by_threshold(df: DataFrame, y: str, prob: str, group_cols=("split",), n_points: int = 101) -> DataFrame:
    """M13 curve: F1 of ``p >= t`` for every grid point ``t`` in linspace(0, 1, n_points).

    Rows reduce to at most ``n_points + 1`` buckets per group before anything
    else happens; the grid comes from ``sequence`` (a generator, not a join).
    """
    g = list(group_cols)
    grid = linspace(n_points)
    yy = _col(y).cast("int")
    b = bucket_of(_col(prob).cast("double"), grid)
    counts = df.groupBy(*g, b.alias("b")).agg(
        F.sum(F.when(yy == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(yy == 1, 0).otherwise(1)).cast("long").alias("neg"))
    totals = counts.groupBy(*g).agg(F.sum("pos").alias("P"))
    gridrows = totals.select(*g, "P", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"))
    cr = counts.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("b").alias("_b"), "pos", "neg")
    cond = gridrows["i"] + 1 == cr["_b"]
    for c in g:
        cond = cond & gridrows[c].eqNullSafe(cr[f"_g_{c}"])
    j = gridrows.join(cr, cond, "left").select(
        *[gridrows[c] for c in g], "P", "i",
        F.coalesce(F.col("pos"), F.lit(0)).alias("pos_i"), F.coalesce(F.col("neg"), F.lit(0)).alias("neg_i"))
    w = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy(F.col("i").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("pos_i").over(w)
    fp = F.sum("neg_i").over(w)
    cur = j.select(*g, "i", tp.alias("tp"), fp.alias("fp"), "P")
    denom = 2 * F.col("tp") + F.col("fp") + (F.col("P") - F.col("tp"))
    grid_expr = F.array(*[F.lit(t) for t in grid])
    return cur.select(*g, "i", F.element_at(grid_expr, F.col("i") + 1).alias("threshold"),
                      F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(0.0).alias("f1"))


def best_f1_threshold(df: DataFrame, y: str, prob: str, group_cols=("split",), n_points: int = 101) -> DataFrame:
    """The threshold with the highest F1; the first (lowest) maximum wins."""
    g = list(group_cols)
    curve = f1_by_threshold(df, y, prob, g, n_points)
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("i")))
    return curve.groupBy(*g).agg(best.alias("_b")).select(
        *g, F.col("_b.threshold").alias("best_threshold"), F.col("_b.f1").alias("best_f1"))


def regression_metrics(df: DataFrame, y: str, y_pred: str, group_cols=("split",)) -> DataFrame:
    """MAE, MSE, RMSE, R², median absolute error, explained variance,
    residual mean and std (ddof 1).  Constant targets: R² and explained
    variance are 1 for a perfect fit, else 0."""
    g = list(group_cols)
    if not g:
        return regression_metrics(df.withColumn("_all", F.lit(0)), y, y_pred, ["_all"]).drop("_all")
    from tabsmith.functions.scalar import residual
    yy = _col(y).cast("double")
    e = residual(y, y_pred)
    base = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(yy) * F.count(yy)).alias("_sst"),
        F.var_pop(yy).alias("_vy"),
        F.var_pop(e).alias("_ve"),
        F.avg(e).alias("residual_mean"),
        F.stddev_samp(e).alias("residual_std"),
    )

    def guarded(num, den):
        return F.when(den > 0, 1 - num / den).when(num == 0, 1.0).otherwise(0.0)

    med = exact_quantiles(df.withColumn("_ae", F.abs(e)), "_ae", [0.5], g, names=["median_ae"])
    out = base.select(*g, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                      guarded(F.col("_sse"), F.col("_sst")).alias("r2"),
                      guarded(F.col("_ve"), F.col("_vy")).alias("explained_variance"),
                      "residual_mean", "residual_std")
    return out.join(med, g, "left")


def class_stats(df: DataFrame, y: str) -> DataFrame:
    """A3: (class, n_class, n, minority_ratio); ratio = min count / n."""
    counts = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    n, least = (counts.agg(f("n_class")).scalar() for f in (F.sum, F.min))
    return counts.select("class", "n_class", n.alias("n"), (least / n).alias("minority_ratio"))


def class_weights(stats: DataFrame, policy: str = "always", threshold: float = 0.2,
                  positive_class=1, strategy: str | None = None) -> DataFrame:
    """M22 on the A3 table (one row per class, so tiny).

    ``policy`` says when: ``off`` -> no rows; ``if_imbalanced`` -> only when the minority ratio is
    below ``threshold``; ``always``.  ``strategy`` says how: ``balanced`` -> n / (k * count);
    ``ratio`` -> neg/pos on the positive class, 1 on others.  A strategy's name as the policy is
    ``always`` with that strategy."""
    if policy in ("balanced", "ratio"):
        policy, strategy = "always", strategy or policy
    strategy = strategy or "balanced"
    if policy not in ("off", "if_imbalanced", "always") or strategy not in ("balanced", "ratio"):
        raise ValueError(f"unknown class-weight policy {policy!r} or strategy {strategy!r}")
    if strategy == "ratio":
        pos = F.sum(F.when(F.col("class") == positive_class, F.col("n_class"))).over(Window.partitionBy("n"))
        weight = F.when(F.col("class") == positive_class, (F.col("n") - pos) / pos).otherwise(1.0)
    else:
        weight = F.col("n") / (F.count(F.lit(1)).over(Window.partitionBy("n")) * F.col("n_class"))
    weighted = stats.withColumn("weight", weight)
    if policy == "off":
        weighted = weighted.where(F.lit(False))
    if policy == "if_imbalanced":
        weighted = weighted.where(F.col("minority_ratio") < threshold)
    return weighted.select("class", "weight")


def with_weights(df: DataFrame, y: str, weights: DataFrame) -> DataFrame:
    """Attach a ``weight`` column for Spark ML's ``weightCol``.  The weight table
    has one row per class, so it is broadcast: a join by class would put all rows of a class in one task."""
    w = F.broadcast(weights.withColumnRenamed("class", "_wc"))
    return df.join(w, F.col(y) == F.col("_wc"), "left").drop("_wc") \
        .withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0)))


def metric_choice(stats: DataFrame, task: str = "classification", mode: str = "adaptive",
                  threshold: float = 0.2, fixed: str = "roc_auc") -> DataFrame:
    """Regression -> rmse; fixed -> the given name; adaptive -> average
    precision when the minority ratio is below the threshold, else ROC AUC."""
    r = stats.agg(F.max("minority_ratio").alias("minority_ratio"))
    if task == "regression":
        return r.select("minority_ratio", F.lit("rmse").alias("metric"))
    if mode == "fixed":
        return r.select("minority_ratio", F.lit(fixed).alias("metric"))
    return r.select("minority_ratio", F.when(F.col("minority_ratio") < threshold, "average_precision")
                    .otherwise("roc_auc").alias("metric"))


def cv_summary(scores: DataFrame, candidate: str = "candidate", score: str = "score") -> DataFrame:
    """A16 + W4 + O6: mean, std and rank of the test score per candidate.

    The summary has one row per candidate (a search's draw count), so the
    global rank window runs over that small table only.
    """
    s = scores.groupBy(candidate).agg(F.avg(score).alias("mean_score"),
                                      F.stddev_pop(score).alias("std_score"),
                                      F.count(F.lit(1)).alias("n_folds"))
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean_score").desc())))


def best_candidate(summary: DataFrame, candidate: str = "candidate") -> DataFrame:
    """The candidate with the highest mean score (ties: smallest id); a top-1 report."""
    return summary.orderBy(F.col("mean_score").desc(), F.col(candidate)).limit(1)
