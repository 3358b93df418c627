"""Evaluation metrics, drift, monitoring, gates and snapshot catalogs."""

import math

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import drift, gates, metrics
from tabsmith.sources import snapshots


def _pred(spark, y, p=None, yhat=None):
    rows = [(i, "test", y[i], (yhat or [0] * len(y))[i], None if p is None else p[i]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id int, split string, y int, yhat int, p double")


def test_accuracy_without_probabilities(spark):
    df = _pred(spark, [0, 1, 1, 0], yhat=[0, 1, 0, 0])
    m = metrics.classification_metrics(df, "y", "yhat", None).first()
    assert m.accuracy == 0.75 and m.roc_auc is None and m.log_loss is None and m.ece is None
    assert m.precision == 1.0 and m.recall == 0.5 and m.specificity == 1.0


def test_perfect_ranking(spark):
    df = _pred(spark, [0, 1, 1, 0], p=[0.1, 0.9, 0.8, 0.2], yhat=[0, 1, 1, 0])
    m = metrics.classification_metrics(df, "y", "yhat", "p").first()
    assert m.roc_auc == 1.0 and m.pr_auc == 1.0


def test_auc_ties_count_half_and_single_class(spark):
    df = _pred(spark, [0, 1, 0, 1], p=[0.5, 0.5, 0.2, 0.9])
    assert metrics.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(0.875)
    one = _pred(spark, [1, 1], p=[0.2, 0.3])
    assert metrics.roc_auc(one, "y", "p").first().roc_auc is None


def test_average_precision_step_rule(spark):
    y = [1, 0, 1, 0, 1]
    p = [0.9, 0.8, 0.7, 0.7, 0.1]
    df = _pred(spark, y, p=p)
    # by hand: thresholds 0.9 (P=1,R=1/3), 0.8 (2/3 hold), 0.7 (P=2/4,R=2/3), 0.1 (P=3/5,R=1)
    expected = (1 / 3) * 1.0 + (1 / 3) * 0.5 + (1 / 3) * 0.6
    assert metrics.average_precision(df, "y", "p").first().pr_auc == pytest.approx(expected)


def test_ece_reference_case_and_top_bin(spark):
    df = _pred(spark, [0, 1], p=[0.01, 0.99])
    assert metrics.expected_calibration_error(df, "y", "p").first().ece == pytest.approx(0.01)
    top = _pred(spark, [1, 0], p=[1.0, 0.05])
    assert metrics.expected_calibration_error(top, "y", "p").first().ece == pytest.approx(0.025)
    assert metrics.expected_calibration_error(top, "y", "p", include_top=True).first().ece == pytest.approx(0.025)


def test_best_f1(spark):
    df = _pred(spark, [0, 0, 1, 1], p=[0.1, 0.4, 0.6, 0.9])
    b = metrics.best_f1_threshold(df, "y", "p").first()
    assert b.best_threshold == pytest.approx(0.41) and b.best_f1 == 1.0
    same = _pred(spark, [1, 1, 1], p=[0.9, 0.9, 0.9])
    assert metrics.best_f1_threshold(same, "y", "p").first().best_threshold == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([("t", 1.0, 1.5), ("t", 2.0, 2.5), ("t", 3.0, 2.0)], "split string, y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    assert m.mae == pytest.approx(2 / 3) and m.mse == pytest.approx(0.5)
    assert m.r2 == pytest.approx(0.25) and m.residual_mean == pytest.approx(0.0)
    assert m.median_ae == pytest.approx(0.5) and m.rmse == pytest.approx(math.sqrt(0.5))


def test_class_stats_and_weights(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 1, 0, 1]], "y int")
    s = {r["class"]: (r.n_class, r.n, r.minority_ratio) for r in metrics.class_stats(df, "y").collect()}
    assert s == {0: (2, 5, 0.4), 1: (3, 5, 0.4)}
    big = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "y int")
    w = {r["class"]: r.weight for r in metrics.class_weights(metrics.class_stats(big, "y"), "balanced").collect()}
    assert w == pytest.approx({0: 100 / 180, 1: 100 / 20})
    choice = metrics.metric_choice(metrics.class_stats(big, "y"), threshold=0.2).first().metric
    assert choice == "average_precision"


def _long(spark, e, a, t="double"):
    ex = spark.createDataFrame([(v,) for v in e], f"x {t}")
    ac = spark.createDataFrame([(v,) for v in a], f"x {t}")
    return ex, ac


def test_psi_numeric_drops_out_of_range(spark):
    ex, ac = _long(spark, [1.0, 2.0, 2.0, 3.0, 4.0, 5.0], [1.0, 1.0, 2.0, 3.0, 4.0, 6.0])
    r = drift.psi_numeric(drift.long_form(ex, ac, ["x"], False), n_bins=4).first()
    assert r.score >= 0 and r.n_actual == 5


def test_psi_categorical_and_ks(spark):
    ex, ac = _long(spark, ["a", "a", "b", "c"], ["a", "b", "b", "c"], "string")
    r = drift.psi_categorical(drift.long_form(ex, ac, ["x"], True)).first()
    assert r.score == pytest.approx(0.346574, abs=1e-6)
    ex, ac = _long(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0])
    assert drift.ks_statistic(drift.long_form(ex, ac, ["x"], False)).first().score == 0.0
    ex, ac = _long(spark, [1.0, 2.0, None], [3.0, 4.0])
    assert drift.ks_statistic(drift.long_form(ex, ac, ["x"], False)).first().score == 1.0


def test_constant_column_psi(spark):
    ex, ac = _long(spark, [2.0, 2.0, 2.0], [2.0, 2.4, 1.7])
    r = drift.psi_numeric(drift.long_form(ex, ac, ["x"], False)).first()
    assert r.score > 0


def test_drift_report_and_severity(spark):
    ex = spark.range(0, 100).select(F.col("id").cast("double").alias("num"),
                                    (F.col("id") % 3).cast("string").alias("cat"))
    ac = spark.range(50, 150).select(F.col("id").cast("double").alias("num"),
                                     (F.col("id") % 3).cast("string").alias("cat"))
    rep = {r.feature: (r.method, r.severity) for r in drift.drift_report(ex, ac).collect()}
    assert rep["num"] == ("ks", "severe") and rep["cat"][0] == "psi"


def test_stage_comparison(spark):
    prod = spark.createDataFrame([("auc", 0.5, "maximize"), ("loss", 0.3, "minimize"), ("only_prod", 1.0, "maximize")],
                                 "metric string, value double, direction string")
    stag = spark.createDataFrame([("auc", 0.7, "maximize"), ("loss", 0.1, "minimize")],
                                 "metric string, value double, direction string")
    got = {r.metric: r.status for r in drift.compare_stages(prod, stag).collect()}
    assert got == {"auc": "improvement", "loss": "improvement"}
    bad = spark.createDataFrame([("auc", 0.7, "minimize")], "metric string, value double, direction string")
    with pytest.raises(ValueError):
        drift.assert_stage_comparison(drift.compare_stages(prod, bad))


def test_gates(spark):
    m = spark.createDataFrame([("test", "auc", 0.8), ("test", "loss", 0.2)], "split string, metric string, value double")
    th = spark.createDataFrame([("test", "auc", "maximize", 0.7, 0), ("test", "loss", "minimize", 0.3, 1)],
                               "split string, metric string, direction string, threshold double, ord int")
    d = gates.gate_decision(m, th, None).first()
    assert d.promote and d.meets_thresholds and d.beats_production
    prod = spark.createDataFrame([("test", "auc", 0.9), ("test", "loss", 0.1)], "split string, metric string, value double")
    d2 = gates.gate_decision(m, th, prod).first()
    assert d2.meets_thresholds and not d2.beats_production and not d2.promote


def test_latest_snapshot(spark):
    ids = ["2026-03-28T12-00-00_aaaaaaaa", "2026-03-28T12-00-00_bbbbbbbb", "2026-03-28T13-00-00_cccccccc",
           "notasnapshot", "2026-03-28_dddddddd"]
    cat = spark.createDataFrame([(i,) for i in ids], "snapshot_id string")
    assert snapshots.get_latest_snapshot(cat) == ids[2]
    assert snapshots.get_latest_snapshot(cat.where(F.col("snapshot_id") != ids[2])) == ids[1]
    with pytest.raises(LookupError):
        snapshots.get_latest_snapshot(cat.where(F.lit(False)))


def test_lazy_drift_validation_raises(spark):
    bad = spark.createDataFrame([("f", "ks", 1.5, 10, 10)],
                                "feature string, method string, score double, n_expected long, n_actual long")
    with pytest.raises(Exception):
        drift.validated(bad).collect()
    ok = spark.createDataFrame([("f", "psi", 0.2, 10, 10)],
                               "feature string, method string, score double, n_expected long, n_actual long")
    assert drift.validated(ok).first().score == 0.2


def test_snapshot_directory_catalog(spark, tmp_path):
    for name, version, sid in [("a", "v1", "2026-01-01T00-00-00_aaaa0000"), ("a", "v1", "2026-02-01T00-00-00_bbbb0000"),
                               ("a", "v2", "bad"), ("b", "v1", "2026-03-01T00-00-00_cccc0000")]:
        (tmp_path / name / version / sid).mkdir(parents=True)
    cat = snapshots.list_snapshot_dirs(spark, str(tmp_path))
    latest = {(r.name, r.version): r.latest_snapshot for r in snapshots.latest_snapshots(cat).collect()}
    assert latest == {("a", "v1"): "2026-02-01T00-00-00_bbbb0000", ("b", "v1"): "2026-03-01T00-00-00_cccc0000"}


def test_gates_and_assessment_fail_on_missing_values(spark):
    from tabsmith.operators import drift, gates
    metrics = spark.createDataFrame([("test", "auc", 0.9)], "split string, metric string, value double")
    rule = lambda metric, direction: spark.createDataFrame(
        [("test", metric, direction, 0.8)], "split string, metric string, direction string, threshold double")
    assert gates.gate_decision(metrics, rule("auc", "maximize")).first().promote
    for bad in (rule("f1", "maximize"), rule("auc", "up")):
        with pytest.raises(Exception, match="for (f1|auc) in test"):
            gates.gate_decision(metrics, bad, stage="staging").collect()
    side = lambda name, value: spark.createDataFrame([("auc", value)], f"metric string, {name} double")
    up = spark.createDataFrame([("auc", "maximize")], "metric string, direction string")
    with pytest.raises(Exception, match="no value for metric auc"):
        drift.performance_assessment(side("current", None), side("expected", 0.5), up).collect()


def test_binding_that_lacks_a_set_fails(spark):
    req = spark.createDataFrame([("a", "v1", None)], "name string, version string, given_snapshot string")
    latest = spark.createDataFrame([("a", "v1", "s1")], "name string, version string, latest_snapshot string")
    none = spark.createDataFrame([], "binding_id string, kind string, name string, version string, snapshot string")
    assert snapshots.resolve_snapshots(req, latest).first().snapshot == "s1"
    with pytest.raises(Exception, match="no snapshot for a v1"):
        snapshots.resolve_snapshots(req, latest, none, "b").collect()


def test_refined_space_stays_in_bounds():
    from tabsmith.operators.ml import refine_space
    space = refine_space({"depth": 9, "rate": 0.1}, {"depth": [5]}, {"rate": [0.5, 20]}, {"depth": (1, 10), "rate": (0, 1)})
    assert space == {"depth": [4, 9], "rate": [0.05, 0.1]}


def test_class_weight_policy_and_strategy(spark):
    """When to weigh and how are chosen apart."""
    y = spark.createDataFrame([(int(k < 2),) for k in range(10)], "y int")
    stats = metrics.class_stats(y, "y")

    def weights(*args, **kw):
        return {r["class"]: round(r.weight, 6) for r in metrics.class_weights(stats, *args, **kw).collect()}

    assert weights("off", strategy="ratio") == {}
    assert weights("if_imbalanced", 0.1, strategy="ratio") == {}
    assert weights("if_imbalanced", 0.3, strategy="ratio") == {0: 1.0, 1: 4.0} == weights("ratio")
    assert weights("always") == {0: 0.625, 1: 2.5} == weights("balanced")
    with pytest.raises(ValueError):
        weights("sometimes")
