"""Derived features, point-in-time features, fills, targets, segmentation, splits."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import scalar, targets
from tabsmith.operators import features, segment, split
from tabsmith.operators.prefix import prefix_aggregate
from tabsmith.operators.prefix import exact_quantiles, prefix_row_number


def test_total_stay_and_price_per_person(spark):
    df = spark.createDataFrame([(0, 3, 100.0, 0, 0, 0), (2, 4, 90.0, 2, 1, 0), (1, 0, 50.0, 1, 0, 0)],
                               "we int, wk int, adr double, a int, c int, b int")
    out = df.select(scalar.total_stay("we", "wk").alias("t"),
                    scalar.price_per_person("adr", "a", "c", "b").alias("p")).collect()
    assert [r.t for r in out] == [3, 6, 1]
    assert [r.p for r in out][:2] == [100.0, 30.0]


def test_season(spark):
    weeks = [1, 10, 21, 22, 34, 35, 47, 48, 52, None]
    df = spark.createDataFrame([(w,) for w in weeks], "w int")
    got = [r.s for r in df.select(scalar.season_of_week("w").alias("s")).collect()]
    assert got == ["Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter", "Winter", "Winter"]


def test_arrival_date(spark):
    df = spark.createDataFrame([(2024, "February", 29), (2025, "December", 31), (2024, "Feb", 10),
                                (2023, "February", 29)], "y int, m string, d int")
    got = [r.x for r in df.select(scalar.arrival_date("y", "m", "d").alias("x")).collect()]
    assert got == [dt.date(2024, 2, 29), dt.date(2025, 12, 31), None, None]


@pytest.mark.parametrize("n_buckets", [1, 3, 16])
def test_pit_mean_reference_case(spark, n_buckets):
    df = spark.createDataFrame([("A", "2024-01-02", 20.0, 1), ("A", "2024-01-01", 10.0, 2),
                                ("B", "2024-01-01", 30.0, 3), ("B", "2024-01-03", 50.0, 4)],
                               "hotel string, t string, adr double, id int").withColumn("t", F.to_date("t"))
    out = features.pit_feature(df, ["hotel"], "t", "adr", "mean", "f", ["id"], n_buckets=n_buckets)
    got = [r.f for r in out.orderBy("hotel", "t").collect()]
    assert got == [27.5, 10.0, 27.5, 30.0]


def test_pit_ties_use_tiebreak(spark):
    df = spark.createDataFrame([("A", 1, 10.0, 2), ("A", 1, 20.0, 1), ("A", 2, 30.0, 3)],
                               "g string, t int, v double, id int")
    out = {r.id: r.f for r in features.pit_feature(df, ["g"], "t", "v", "sum", "f", ["id"]).collect()}
    assert out == {1: 20.0, 2: 20.0, 3: 30.0}  # id 1 first: no history -> global mean 20


def test_fill_forward_backward_across_buckets(spark):
    rows = [(i, None if i % 7 == 0 or i < 3 else i * 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x int")
    for nb in (1, 5, 64):
        got = {r.id: r.x for r in features.fill_forward_backward(df, "x", ["id"], n_buckets=nb).collect()}
        expected, last = {}, None
        first = next(v for _, v in rows if v is not None)
        for i, v in rows:
            last = v if v is not None else last
            expected[i] = last if last is not None else first
        assert got == expected


@pytest.mark.parametrize("n_buckets", [1, 7, 64])
def test_prefix_row_number_partition_invariant(spark, n_buckets):
    df = spark.range(0, 2000).withColumn("g", (F.col("id") % 3).cast("int")).withColumn("k", F.rand(7))
    ref = None
    try:
        for parts in ("1", "7", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.id: r.rn for r in prefix_row_number(df, ["k", "id"], ["g"], name="rn", n_buckets=n_buckets).collect()}
            ref = ref or got
            assert got == ref
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(v for k, v in ref.items() if k % 3 == 0) == list(range(667))


def test_exact_quantiles_match_linear_rule(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 2, 4, 10]], "v double")
    q = exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0]).first()
    vals = sorted([5, 1, 3, 2, 4, 10])

    def lin(p):
        h = (len(vals) - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        return vals[lo] + (vals[hi] - vals[lo]) * (h - lo)
    assert [round(x, 9) for x in q] == [round(lin(p), 9) for p in [0.0, 0.25, 0.5, 0.99, 1.0]]


def test_segmentation(spark):
    df = spark.createDataFrame([("City Hotel", "Online TA", 110.0), ("Resort Hotel", "Online TA", 90.0),
                                ("City Hotel", "Offline TA/TO", 130.0)], "hotel string, market_segment string, adr double")
    out = segment.apply_segmentation(df, [("hotel", "eq", "City Hotel"), ("market_segment", "eq", "Online TA")])
    assert out.columns == ["adr"] and [r.adr for r in out.collect()] == [110.0]
    inn = segment.apply_segmentation(df, [("hotel", "in", ["City Hotel"])])
    assert sorted(r.adr for r in inn.collect()) == [110.0, 130.0]
    with pytest.raises(ValueError):
        segment.apply_segmentation(df, [("hotel", "eq", "Nowhere")])


def test_neq_and_not_in_are_true_on_null(spark):
    from tabsmith.functions.predicates import predicate
    df = spark.createDataFrame([(None,), ("a",)], "x string")
    r = df.select(predicate("x", "neq", "a").alias("n"), predicate("x", "not_in", ["a"]).alias("ni"),
                  predicate("x", "eq", "a").alias("e")).collect()
    assert [(x.n, x.ni, x.e) for x in r] == [(True, True, False), (False, False, True)]


def test_targets_and_transforms(spark):
    df = spark.createDataFrame([("A", "A", "No-Show"), ("A", "B", None), (None, None, "Check-Out")],
                               "r string, a string, s string")
    out = df.select(targets.differs_flag("r", "a").alias("u"), targets.equals_flag("s", "No-Show").alias("n")).collect()
    assert [(x.u, x.n) for x in out] == [(0, 1), (1, 0), (0, 0)]
    y = spark.createDataFrame([(0.0,), (1.0,), (9.0,)], "y double")
    assert [r.y for r in targets.transform_target(y, "y", "sqrt").collect()] == [0.0, 1.0, 3.0]
    assert [round(r.y, 12) for r in targets.transform_target(y, "y", "log1p").collect()] == \
        [round(math.log1p(v), 12) for v in (0.0, 1.0, 9.0)]
    with pytest.raises(ValueError):
        targets.transform_target(spark.createDataFrame([(-1.0,)], "y double"), "y", "sqrt")
    with pytest.raises(ValueError):
        targets.transform_target(y, "y", "boxcox", 0.5)
    with pytest.raises(ValueError):
        targets.transform_target(y, "y", "boxcox")
    pos = spark.createDataFrame([(1.5,), (4.0,)], "y double")
    for lam in (0.0, 0.5):
        t = targets.transform_target(pos, "y", "boxcox", lam)
        back = targets.inverse_transform_target(t, "y", "boxcox", lam)
        assert [round(r.y, 9) for r in back.collect()] == [1.5, 4.0]


def test_stratified_exact_split(spark):
    df = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(100)], "id int, y int")
    out = split.exact_split(df, "id", 0.2, 0.1, stratify_by="y", seed=42)
    sizes = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 70, "val": 10, "test": 20}
    again = {r.id: r.split for r in split.exact_split(df.repartition(7), "id", 0.2, 0.1, "y", 42).collect()}
    assert again == {r.id: r.split for r in out.collect()}
    rep = split.split_report(out, "y").where("split = 'test'").collect()
    assert {r["class"]: r.n_rows for r in rep} == {0: 14, 1: 6}


def test_hash_split_is_stable(spark):
    df = spark.range(0, 1000).withColumn("key", F.col("id").cast("string"))
    a = split.hash_split(df, "key", 0.2, 0.1).select("id", "split")
    b = split.hash_split(df.repartition(13), "key", 0.2, 0.1).select("id", "split")
    assert sorted(a.collect()) == sorted(b.collect())
    shares = {r.split: r.c for r in a.groupBy("split").count().withColumnRenamed("count", "c").collect()}
    assert 150 < shares["test"] < 250 and 50 < shares["val"] < 150


def test_hot_group_split_matches_plain_window(spark):
    """One key holding a third of the rows: the hot path must equal a plain window."""
    from pyspark.sql import Window
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"),
        (F.col("id") * 7919 % 3001).alias("t"), F.col("id").alias("id"), (F.col("id") % 11).cast("double").alias("v"))
    got = {r.id: (r.s, r.c) for r in prefix_aggregate(
        df, ["t", "id"], {"s": ("sum", "v"), "c": ("count", F.lit(1))}, ["g"]).collect()}
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.id: (r.s, r.c) for r in df.select("id", F.sum("v").over(w).alias("s"),
                                                F.count(F.lit(1)).over(w).alias("c")).collect()}
    assert got == ref


def test_pit_with_pandas_aggregate(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def median(v: pd.Series) -> float:
        return float(v.median())

    df = spark.createDataFrame([("A", 1, 10.0, 1), ("A", 2, 30.0, 2), ("A", 3, 20.0, 3), ("A", 4, 0.0, 4)],
                               "g string, t int, v double, id int")
    got = {r.id: r.f for r in features.pit_feature(df, ["g"], "t", "v", median, "f", ["id"]).collect()}
    assert got == {1: 15.0, 2: 10.0, 3: 20.0, 4: 20.0}


def test_many_buckets_equal_a_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 6000).select(F.col("id"), (F.col("id") * 7919 % 6007).cast("double").alias("t"),
                                     (F.col("id") % 13).cast("double").alias("v"))
    got = {r.id: r.s for r in prefix_aggregate(df, ["t", "id"], {"s": ("sum", "v")}, n_buckets=900).collect()}
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.id: r.s for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    assert got == ref


def test_bucket_assignment_matches_bisect(spark):
    import bisect

    from pyspark.sql import Row

    from tabsmith.operators.prefix import Bounds, sort_key
    for n in (0, 1, 10, 300):
        bounds = [float(i * 3) for i in range(1, n + 1)] + [float("inf")] * (n > 0)
        keys = [None, float("-inf"), -5.0, 0.0, 3.0, 4.5, 6.0, float(n * 3), float(n * 3) + 1.0, 29.9999, 30.0, float("inf"), float("nan")]
        df = spark.createDataFrame(list(enumerate(keys)), "i int, k double")
        key = sort_key(df, ["k"])
        made = Bounds([Row(k0=b) for b in bounds], df.select(key.alias("k")).schema["k"].dataType)
        got = {r.i: r.b for r in made.add_bucket(df, ["k"], "b").select("i", "b").collect()}
        exp = {i: 0 if k is None else len(bounds) if k != k else bisect.bisect_right(bounds, k) for i, k in enumerate(keys)}
        assert got == exp, n


ODD = [None, "", "same prefix of many letters a", "same prefix of many letters b", "Z", "é", "日本", 'quote " and \\ and \n', "a"]


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_over_strings_dates_and_decimals_equals_a_window(spark, descending):
    """Whole tuples decide: common prefixes, nulls, decimals, times to the microsecond; also reversed."""
    import datetime as dt
    from decimal import Decimal

    from pyspark.sql import Window
    rows = [(k, k % 3, ODD[k * 7 % len(ODD)], None if k % 11 == 0 else Decimal(k * 37 % 50) / 4,
             None if k % 13 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=k * 7919 % 100),
             None if k % 5 == 0 else float(k * 31 % 17)) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, g int, s string, d decimal(20,3), t timestamp_ntz, v double")
    df = df.withColumn("day", F.to_date("t")).withColumn("at", F.col("t").cast("timestamp"))
    order = ["s", "d", "day", "t", "at", "id"]
    aggs = {"n": ("count", F.lit(1)), "s_v": ("sum", "v"), "hi": ("max", "v"), "l": ("last", "v")}
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    for groups in ([], ["g"]):
        w = Window.partitionBy(*groups).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
        ref = df.select("id", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s_v"), F.max("v").over(w).alias("hi"),
                        F.last("v", ignorenulls=True).over(w).alias("l")).collect()
        got = prefix_aggregate(df, order, aggs, groups, descending=descending, n_buckets=20,
                               with_totals={"first": ("first", "v"), "all": ("sum", "v")}).select("id", *aggs).collect()
        assert sorted(map(str, got)) == sorted(map(str, ref))


@pytest.mark.parametrize("column", ["t", "name"])
def test_no_bucket_exceeds_twice_the_mean(spark, column):
    """A key holding a third of all rows, and names that share a long prefix, fall into even buckets."""
    from tabsmith.operators.prefix import range_bounds
    n, nb = 30000, 16
    df = spark.range(0, n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"),
                                  (F.col("id") * 7919 % 30011).cast("double").alias("t"),
                                  F.format_string("Customer#%012d", F.col("id") * 7919 % 30011).alias("name"))
    bounds = range_bounds(df, ["g", column], nb)
    placed = bounds.add_bucket(df, ["g", column], "b")
    sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
    assert len(sizes) == nb and max(sizes) <= 2 * n / nb
    hot = placed.where("g = 'hot'").groupBy("b").count()
    assert hot.count() >= nb // 3


def test_running_std_of_large_values(spark):
    """Squared deviations are merged, not differences of large sums."""
    df = spark.createDataFrame([(k, 1e9 + k % 3) for k in range(300)], "id int, v double").withColumn("g", F.lit(1))
    import statistics
    vals = [1e9 + k % 3 for k in range(300)]
    for nb in (1, 16):
        got = {r.id: r.f for r in features.pit_feature(df, ["g"], "id", "v", "std", "f", n_buckets=nb).collect()}
        assert all(math.isclose(got[k], statistics.stdev(vals[:k]), rel_tol=1e-6) for k in range(2, 300, 17))


def test_order_code_follows_doubles(spark):
    import struct

    from tabsmith.operators.prefix import order_code
    rng = __import__("random").Random(4)
    vals = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    vals = [v for v in vals if v == v] + [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
                                          float("inf"), float("-inf"), 1.0, 1.9999999999999998, 2.0, 0.1, 3.0]
    got = {r.i: r.c for r in spark.createDataFrame(list(enumerate(vals)), "i int, v double").select("i", order_code(F.col("v")).alias("c")).collect()}
    for i, v in enumerate(vals):
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert got[i] == (-bits if v < 0 else bits)


def test_quantiles_of_few_values_move_few_rows(spark):
    """An 11-value column with a hot value: exact per group, and no plan step ranks rows."""
    import numpy as np
    df = spark.range(0, 5000, 1, 4).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(7.25)).otherwise(
        (F.col("id") % 11).cast("double")).alias("v"))
    df = df.withColumn("v", F.when(F.col("v") == 3, F.lit(None)).otherwise(-F.col("v")))
    got = {r.g: (r.a, r.b, r.c) for r in exact_quantiles(df, "v", [0.01, 0.5, 0.99], ["g"], names=["a", "b", "c"]).collect()}
    rows = df.collect()
    for g in (0, 1):
        vals = [r.v for r in rows if r.g == g and r.v is not None]
        assert np.allclose(got[g], np.quantile(vals, [0.01, 0.5, 0.99]))
    wide = spark.range(0, 3000).select((F.col("id") * 7919 % 3001 / 7.0 - 100).alias("v"))
    assert np.allclose(list(exact_quantiles(wide, "v", [0.0, 0.333, 1.0]).first()),
                       np.quantile([r.v for r in wide.collect()], [0.0, 0.333, 1.0]))


def test_entity_folds_keep_entities_whole_and_spread_classes(spark):
    """Repeated keys lie in one fold, each class is dealt out evenly, order of rows does not matter."""
    from tabsmith.operators.split import entity_folds
    rows = [(None if k == 7 else f"e{k}", int(k % 10 == 0), r) for k in range(200) for r in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "key string, y int, r int")
    got = entity_folds(df, "key", 4, "y").collect()
    folds = {}
    for r in got:
        folds.setdefault(r.key, set()).add(r.fold)
    assert len(got) == len(rows) and all(len(f) == 1 for f in folds.values())
    rare = [next(iter(folds[f"e{k}"])) for k in range(0, 200, 10)]
    assert sorted(rare.count(f) for f in range(4)) == [5, 5, 5, 5]
    again = {(r.key, r.r): r.fold for r in entity_folds(df.repartition(5).orderBy("r"), "key", 4, "y").collect()}
    assert again == {(r.key, r.r): r.fold for r in got}
