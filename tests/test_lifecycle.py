"""Fingerprints, lineage, targets, encodings, attributions, staged metrics, pair trends and user
aggregates: literal cases and brute force in plain Python."""

import itertools
import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsmith.functions import targets
from tabsmith.functions.hashing import content_fingerprint, portable_fingerprint
from tabsmith.operators import encode, features, integrity, keys, ml, synth, trees
from tabsmith.operators.user_aggregate import UserAggregate
from tabsmith.sources import lineage


def folder(spark, name):
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


@pytest.mark.parametrize("a,b", [(("a|b", "c"), ("a", "b|c")), ((None, "x"), ("NULL", "x")), (("s3:", ""), ("", "s3:")), ((None, ""), ("", None))])
def test_fingerprints_tell_rows_apart(spark, a, b):
    one, other = (spark.createDataFrame([r], "x string, y string") for r in (a, b))
    assert portable_fingerprint(one).first() != portable_fingerprint(other).first()
    assert content_fingerprint(one).first() != content_fingerprint(other).first()


def test_row_id_does_not_depend_on_row_order(spark):
    rows = [("k", 1.00000000001, 1), ("k", 1.00000000002, 2), ("k", 1.00000000003, 3), ("l", 0.5, 4)]
    got = [{r.n: r.row_id for r in keys.add_row_id(spark.createDataFrame(list(p), "k string, v double, n int").coalesce(1).drop("n")
            .withColumn("n", F.round((F.col("v") - 1) * 1e11).cast("long")), ["k"]).collect()} for p in (rows, rows[::-1])]
    assert got[0] == got[1] and len(set(got[0].values())) == 4


def test_file_hashes_do_not_depend_on_chunk_tasks_and_see_changes(spark):
    path, facts = folder(spark, "set"), folder(spark, "facts")
    df = spark.range(0, 5000).withColumn("v", F.col("id") * 0.5)
    df.coalesce(2).write.parquet(path)
    small = {r.file: r.sha256 for r in integrity.file_hashes(spark, path, chunk_bytes=1000).collect()}
    assert len(small) == 2
    import hashlib
    local = path.removeprefix("file:")
    for name, found in small.items():
        raw = open(os.path.join(local, name), "rb").read()
        parts = [hashlib.sha256(raw[k:k + 1000]).hexdigest() for k in range(0, len(raw), 1000)]
        assert hashlib.sha256("\n".join(parts).encode()).hexdigest() == found
    integrity.write_manifest(spark, path, facts)
    assert integrity.verify_feature_set(spark, path, facts, "id") == []
    with pytest.raises(ValueError, match="entity key"):
        integrity.verify_feature_set(spark, path, facts, "nope")
    df.limit(10).write.mode("append").parquet(path)
    assert integrity.verify_feature_set(spark, path, facts, "id", strict=False) == []
    with pytest.raises(ValueError, match="files"):
        integrity.verify_feature_set(spark, path, facts, "id")
    other = folder(spark, "other")
    df.withColumnRenamed("v", "w").write.parquet(other)
    with pytest.raises(ValueError, match="schema"):
        integrity.verify_feature_set(spark, other, facts, "id", strict=False)


def test_lineage_reload_and_changed_snapshot(spark):
    a, b = folder(spark, "a"), folder(spark, "b")
    spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "k int, v string").write.parquet(a)
    spark.createDataFrame([(1, 10), (3, 30)], "k int, w int").write.parquet(b)
    rows = lineage.record_lineage(spark, [{"name": "a", "version": "v1", "snapshot": "s1", "path": a},
                                          {"name": "b", "version": "v1", "snapshot": "s2", "path": b, "keys": ["k"], "how": "left", "cardinality": "1:1"}])
    stored = folder(spark, "rows")
    rows.write.parquet(stored)
    rows = spark.read.parquet(stored)
    got = sorted(map(str, (tuple(r) for r in lineage.reload_from_lineage(spark, rows).select("k", "v", "w").collect())))
    assert got == sorted(map(str, [(1, "x", 10), (2, None, None), (None, "z", None)]))
    with pytest.raises(ValueError, match="positions"):
        lineage.reload_from_lineage(spark, rows.where("position = 1"))
    spark.createDataFrame([(1, 11), (3, 30)], "k int, w int").write.mode("overwrite").parquet(b)
    with pytest.raises(ValueError, match="s2"):
        lineage.reload_from_lineage(spark, rows)


def test_target_registry(spark):
    df = spark.createDataFrame([("e1", "A", "A", "No-Show", 99.5), ("e2", "A", "B", None, 1.0), ("e3", None, None, "Check-Out", None)],
                               "row_id string, reserved_room_type string, assigned_room_type string, reservation_status string, adr double")
    assert [tuple(r) for r in targets.build_target(df, "room_upgrade", "v1", "row_id").orderBy("row_id").collect()] == [("e1", 0), ("e2", 1), ("e3", 0)]
    assert [tuple(r) for r in targets.build_target(df, "no_show", "v1", "row_id").orderBy("row_id").collect()] == [("e1", 1), ("e2", 0), ("e3", 0)]
    assert [tuple(r) for r in targets.build_target(df, "adr", "v1", "row_id").orderBy("row_id").collect()] == [("e1", 99.5), ("e2", 1.0), ("e3", None)]
    with pytest.raises(KeyError):
        targets.build_target(df, "adr", "v2", "row_id")
    with pytest.raises(ValueError):
        targets.build_target(df, "lead_time", "v1", "row_id")
    with pytest.raises(ValueError):
        targets.build_target(df, "adr", "v1", "nope")
    with pytest.raises(KeyError):
        targets.register_target("adr", "v1", targets.pass_through("adr", "double"))


def test_ordered_statistics_use_earlier_rows_only(spark):
    rows = [(k, None if k % 9 == 0 else f"c{k % 4}" if k % 3 else "hot", None if k % 10 == 0 else k * 7 % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, c string, y int")
    got = {r.id: r["c__target_mean"] for r in encode.ordered_statistics(df, ["c"], "y", "id", weight=2.0).collect()}
    known = [y for _, _, y in rows if y is not None]
    prior = sum(known) / len(known)
    import hashlib
    u = {k: int(hashlib.sha256(f"{k}:42".encode()).hexdigest()[:15], 16) / 2 ** 60 for k, _, _ in rows}
    for k, c, _ in rows:
        before = [y for j, d, y in rows if d == c and u[j] < u[k] and y is not None]
        assert math.isclose(got[k], (sum(before) + 2 * prior) / (len(before) + 2))


def test_training_with_two_hundred_categories(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f"c{c}", float(rng.random()), int(rng.random() < (0.9 if c % 2 else 0.1))) for k, c in enumerate(rng.integers(0, 200, 4000).tolist())]
    df = spark.createDataFrame(rows, "id long, c string, x double, y int")
    model = encode.train_encoded(df.where("id < 3000"), [], ["c"], ["x"], "y", "id", maxIter=5, maxDepth=3)
    late = model.score(df.where("id >= 3000").unionByName(spark.createDataFrame([(9999, "unseen", 0.5, 1), (9998, None, 0.5, 1)], df.schema)))
    right = late.select((F.col("prediction") == F.col("y")).cast("int").alias("r")).agg(F.avg("r"), F.count("r")).first()
    assert right[1] == 1002 and right[0] > 0.8
    by = encode.train_encoded(df, [], ["c"], ["x"], "y", "id", task="regression", loss="MAE", maxIter=2)
    assert by.model.stages[-1].getLossType() == "absolute"
    with pytest.raises(ValueError):
        encode.train_encoded(df, [], ["c"], ["x"], "y", "id", task="regression", loss="Poisson")


def small_model(spark, task="classification"):
    rng = np.random.default_rng(3)
    rows = [(k, ["a", "b", "c", None][k % 4], float(rng.integers(0, 9)), float(rng.random()), float(rng.random())) for k in range(500)]
    df = spark.createDataFrame([(*r, float((r[2] > 4) ^ (r[1] == "b") ^ (r[3] > 0.8))) for r in rows], "id int, c string, p double, q double, r double, y double")
    return df, ml.train(df, ["c"], ["p", "q", "r"], "y", task=task, maxIter=4, maxDepth=4)


def test_attributions_are_exact_shapley_values(spark):
    """Against the definition: all coalitions, absent features averaged by covers down the tree."""
    df, model = small_model(spark)
    ensemble = trees.read_ensemble(model)
    x = np.array([r.f for r in trees._features(model, df.limit(12), []).select(F.col("_x").alias("f")).collect()])

    def value(leaf, row, present):
        met = leaf.meets(row[None, :])
        out = leaf.value
        for (j, *_, passed), ok in zip(leaf.parts, met):
            out *= float(ok[0]) if j in present else passed
        return out

    got = ensemble.contributions(x)
    n = ensemble.n_features
    for row, mine in zip(x, got):
        game = {s: sum(value(leaf, row, s) for tree in ensemble.trees for leaf in tree)
                for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for i in range(n):
            phi = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) *
                      (game[tuple(sorted((*s, i)))] - game[s]) for s in game if i not in s)
            assert math.isclose(phi, mine[i], abs_tol=1e-12)
        assert math.isclose(game[()], ensemble.expected(), abs_tol=1e-12)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_staged_scores_end_at_the_model_score(spark, task):
    from pyspark.ml.functions import vector_to_array
    df, model = small_model(spark, task)
    scored = model.transform(df).select("id", (vector_to_array("rawPrediction")[1] if task == "classification" else F.col("prediction")).alias("m"))
    got = trees.staged_scores(model, df, ["id"]).join(scored, "id").collect()
    assert len(got) == 500 and all(len(r.stages) == 4 and math.isclose(r.stages[-1], r.m, abs_tol=1e-12) for r in got)


def test_best_iteration_prefers_fewer_trees_on_ties(spark):
    rows = [("train", 1, [0.5, 0.5, 2.0]), ("train", 0, [-0.5, -0.5, 2.0]), ("val", 1, [0.5, 0.5, -2.0]), ("val", 0, [-0.5, -0.5, 2.0])]
    df = spark.createDataFrame(rows, "split string, y int, stages array<double>")
    assert {r.metric: r.value for r in trees.training_metrics(df, "y").collect()} == {"best_iteration": 1.0, "train_auc": 1.0, "val_auc": 1.0}
    with pytest.raises(ValueError):
        trees.training_metrics(df.where("split = 'train'"), "y")


def test_pair_trends_of_equal_and_shuffled_tables(spark):
    rows = [(float(k), float(2 * k), "a" if k < 50 else "b", "x" if k < 50 else "y") for k in range(100)]
    real = spark.createDataFrame(rows, "p double, q double, c string, d string")
    same = synth.pair_trends(real, real, ["p", "q"], ["c", "d"])
    assert same.count() == 6 and all(math.isclose(r.similarity, 1.0) for r in same.collect())
    made = spark.createDataFrame([(p, 198.0 - q, c, "x" if k % 2 else "y") for k, (p, q, c, _) in enumerate(rows)], real.schema)
    got = {(r.column_a, r.column_b): r.similarity for r in synth.pair_trends(real, made, ["p", "q"], ["c", "d"]).collect()}
    assert math.isclose(got[("p", "q")], 0.0, abs_tol=1e-12) and math.isclose(got[("c", "d")], 0.5) and math.isclose(got[("c", "p")], 1.0)
    score = {r.property: r.score for r in synth.synthetic_quality(synth.similarity_score(real, made, ["p"], ["c"]), synth.pair_trends(
        real, made, ["p", "q"], ["c", "d"])).collect()}
    assert math.isclose(score["overall"], (score["column_shapes"] + score["column_pair_trends"]) / 2)


def product():
    """Defined here so that it travels to the workers by value."""
    class Product(UserAggregate):
        def init(self):
            return (1.0, 0.0)

        def update(self, state, value):
            return (state[0] * value, state[1] + 1)

        def merge(self, a, b):
            return (a[0] * b[0], a[1] + b[1])

        def finish(self, state):
            return state[0] if state[1] else None

    return Product()


def test_user_aggregate_equals_a_window_and_spreads_a_hot_group(spark):
    from tabsmith.operators.user_aggregate import running_user_aggregate
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
        (F.col("id") % 40).cast("string")).alias("g"), (F.col("id") * 7919 % 3001).alias("t"), "id",
        F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5)).alias("v"))
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.id: r.p for r in df.select("id", F.when(F.count("v").over(w) > 0, F.product("v").over(w)).alias("p")).collect()}
    for nb in (1, 24):
        rows = running_user_aggregate(df, ["g"], ["t"], "v", product(), n_buckets=nb)
        got = {r.id: r._result for r in rows.collect()}
        assert got.keys() == ref.keys() and all((got[k] is None) == (ref[k] is None) and (got[k] is None or math.isclose(got[k], ref[k])) for k in ref)
    mean = df.agg(F.avg("v")).first()[0]
    filled = {r.id: r.f for r in features.pit_feature(df, ["g"], "t", "v", product(), "f").collect()}
    assert all(math.isclose(filled[k], mean if ref[k] is None else ref[k]) for k in ref)


def test_pipeline_steps_in_order_saved_and_loaded(spark):
    from pyspark.ml import PipelineModel

    from tabsmith.operators import steps
    rows = [(k, k % 3, k % 5, ["a", None, "b"][k % 3], float(k % 2)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, stays_in_weekend_nights int, stays_in_week_nights int, c string, y double").withColumn("noise", F.lit(1))
    order = [("validate", ["c:string", "stays_in_week_nights"]), ("engineer", ["TotalStay"]), ("fill", ["c"]), ("select", ["c", "total_stay"])]
    pipe = steps.build_pipeline(order, ["c"], ["total_stay"], "y", keep=["id"], maxIter=2, maxDepth=2)
    model = pipe.fit(df)
    path = folder(spark, "model")
    model.write().save(path)
    again = PipelineModel.load(path)
    assert [type(s).__name__ for s in again.stages[:4]] == ["SchemaValidator", "FeatureEngineer", "CategoryFill", "FeatureSelector"]
    assert tuple(steps.scores_equal(ml.score(model, df), ml.score(again, df), "id", "y_proba").first()) == (200, 0)
    assert "noise" not in model.transform(df).columns and "id" in model.transform(df).columns
    with pytest.raises(ValueError):
        again.transform(df.drop("c"))
    with pytest.raises(ValueError):
        again.transform(df.withColumn("c", F.lit(1)))
    with pytest.raises(KeyError):
        steps.build_pipeline([("scale", ["c"])], ["c"], [], "y")


def test_drift_of_odd_columns(spark):
    """Nulls, a constant column, booleans, a column that is null on one side, exactly 20 distinct values."""
    from tabsmith.operators import drift
    one = spark.createDataFrame([(k % 20, 5.0, k % 2 == 0, "a" if k % 2 else None, float(k % 19)) for k in range(400)],
                                "twenty int, same double, flag boolean, c string, nineteen double")
    other = one.withColumn("c", F.coalesce("c", F.lit("b"))).withColumn("twenty", F.col("twenty") + 10)
    got = {r.feature: (r.method, round(r.score, 6)) for r in drift.drift_report(one, other).collect()}
    assert got["twenty"] == ("ks", 0.5) and got["same"] == ("psi", 0.0) and got["flag"] == ("psi", 0.0) and got["nineteen"] == ("psi", 0.0)
    assert got["c"][0] == "psi" and got["c"][1] > 1
    with pytest.raises(ValueError):
        drift.drift_report(one, other.drop("c"))
