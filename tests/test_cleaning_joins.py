"""Cleaning, keys and joins: literal cases of the reference's unit tests plus null-key cases."""

import pytest

from tabsmith.operators import clean, joins
from tabsmith.operators.keys import add_row_id


def test_rules_keep_null_and_empty(spark):
    df = spark.createDataFrame(
        [(-1, " City Hotel "), (5, " Resort Hotel "), (11, " City Hotel "), (None, ""), (3, " City Hotel ")],
        "lead_time int, hotel string")
    rules = [clean.ValueRule("lead_time", "gte", 0), clean.ValueRule("lead_time", "lte", 10),
             clean.ValueRule("hotel", "in", ["City Hotel"])]
    out = clean.apply_rules(clean.strip_strings(df), rules).collect()
    assert [(r.lead_time, r.hotel) for r in out] == [(None, ""), (3, "City Hotel")]
    report = {(r.rule, r.column): r.rejected for r in clean.rejection_report(clean.strip_strings(df), rules).collect()}
    assert report == {("gte", "lead_time"): 1, ("lte", "lead_time"): 1, ("in", "hotel"): 1}


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2)], "`  Arrival Date-Year  ` int, `Guest Name` int")
    assert clean.normalize_columns(df).columns == ["arrival_date_year", "guest_name"]


def test_int_null_policy(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "lead_time int")
    keep = clean.enforce_schema(df, clean.SchemaSpec((("lead_time", "smallint"),), int_nulls="widen"))
    drop = clean.enforce_schema(df, clean.SchemaSpec((("lead_time", "smallint"),), int_nulls="drop"))
    assert keep.count() == 3 and dict(keep.dtypes)["lead_time"] == "double"
    assert drop.count() == 2


def test_enforce_schema_missing_and_extra(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "A", 9)], "is_canceled long, d string, hotel string, extra int")
    spec = clean.SchemaSpec((("is_canceled", "tinyint"), ("d", "date"), ("hotel", "string")))
    out = clean.enforce_schema(df, spec)
    assert out.columns == ["is_canceled", "d", "hotel"]
    with pytest.raises(ValueError):
        clean.enforce_schema(df.drop("hotel"), spec)


def test_policy_rules_only_tighter():
    with pytest.raises(ValueError):
        clean.merge_rules([clean.ValueRule("x", "gte", -5)], [clean.ValueRule("x", "gte", 0)])
    merged = clean.merge_rules([clean.ValueRule("x", "gte", 3)], [clean.ValueRule("y", "lte", 9)])
    assert {(r.column, r.op) for r in merged} == {("x", "gte"), ("y", "lte")}


def test_merge_overlap_keeps_left(spark):
    main = spark.createDataFrame([(1, "A", 0), (2, "B", 0), (3, "C", 0)], "row_id int, hotel string, main_only int")
    inc = spark.createDataFrame([(2, "B_new", 200), (3, "C_new", 300), (4, "D_new", 400)],
                                "row_id int, hotel string, incoming_only int")
    out = joins.merge(main, inc, ["row_id"], "inner", validate="1:1").orderBy("row_id").collect()
    assert [(r.row_id, r.hotel, r.incoming_only) for r in out] == [(2, "B", 200), (3, "C", 300)]


def test_merge_no_match_is_empty(spark):
    a = spark.createDataFrame([(1,), (2,)], "row_id int")
    b = spark.createDataFrame([(9,), (10,)], "row_id int")
    assert joins.merge(a, b, ["row_id"], "inner").count() == 0


def test_merge_null_keys_match_and_outer_coalesces(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, b string")
    inner = joins.merge(a, b, ["k"], "inner").collect()
    assert [(r.k, r.a, r.b) for r in inner] == [(None, "x", "p")]
    outer = sorted(joins.merge(a, b, ["k"], "outer").collect(), key=lambda r: (r.k is not None, r.k or 0))
    assert [(r.k, r.a, r.b) for r in outer] == [(None, "x", "p"), (1, "y", None), (2, None, "q")]
    with pytest.raises(ValueError):
        joins.merge(a, b, ["k"], "cross")


def test_cardinality_validation(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        joins.merge(a, b, ["k"], "inner", validate="one_to_one")
    assert joins.merge(a, b, ["k"], "inner", validate="m:1").count() == 2


def test_dataset_order():
    order = joins.dataset_order([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z"])])
    assert order.index("a") < order.index("b") and set(order) == {"a", "b", "c"}


def test_assembly_left_wins_and_target(spark):
    s1 = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, f1 int")
    s2 = spark.createDataFrame([(1, 100, 200)], "id int, f1 int, f2 int")
    target = spark.createDataFrame([(1, 1)], "id int, target int")
    feats = joins.assemble_feature_sets({"set_1": s1, "set_2": s2}, "id")
    rows = joins.join_target(feats, target, "id").collect()
    assert len(rows) == 1 and rows[0].f1 == 10 and rows[0].f2 == 200
    assert joins.keys_missing_in_target(s1, target, "id").count() == 2


def test_row_id_unique_with_duplicates(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("B", 1)], "room string, n int")
    out = add_row_id(df, ["room", "n"]).collect()
    ids = [r.row_id for r in out]
    assert len(set(ids)) == 3
    dup = sorted(r.row_id for r in out if r.room == "A")
    assert dup[0].rsplit("-", 1)[0] == dup[1].rsplit("-", 1)[0]
    assert sorted(i.rsplit("-", 1)[1] for i in dup) == ["0", "1"]


def test_lineage_diff_and_schema_merge(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    diff = sorted((r.side, r.x) for r in joins.lineage_diff(a, b).collect())
    assert diff == [("actual_only", 3), ("expected_only", 1), ("expected_only", 2)]
    s1 = spark.createDataFrame([("lead_time", "int"), ("hotel", "string")], "feature string, dtype string")
    s2 = spark.createDataFrame([("hotel", "category"), ("adr", "float")], "feature string, dtype string")
    merged = {r.feature: r.dtype for r in joins.aggregate_schema_tables([s1, s2]).collect()}
    assert merged == {"lead_time": "int", "hotel": "string", "adr": "float"}


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    from tabsmith.sources import io
    rows = [(1, 'a "q" b'), (2, "line1\nline2"), (3, "x,y\r\n\\z "), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    io.save_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "t"), df.schema).collect())) == rows


def test_nan_and_microseconds(spark):
    from tabsmith.functions.hashing import input_row_hash, portable_fingerprint
    from tabsmith.operators.clean import ValueRule, rule_keeps
    from tabsmith.operators.synth import impute
    d = spark.sql("SELECT * FROM VALUES (double('NaN')), (1D), (5D), (null) AS t(x)")
    assert d.where(rule_keeps(d, ValueRule("x", "lte", 2))).count() == 3
    t = spark.sql("SELECT timestamp'2024-01-01 00:00:00.000001' AS t UNION ALL SELECT timestamp'2024-01-01 00:00:00.000002'")
    assert t.select(input_row_hash(t)).distinct().count() == 2
    a, b = (spark.createDataFrame([(x,)], "x double") for x in (0.1, 0.1 + 1e-14))
    assert portable_fingerprint(a).first() != portable_fingerprint(b).first()
    odd = impute(spark.createDataFrame([(2,), (3,), (None,)], "x int"), ["x"], [])
    assert sorted(r.x for r in odd.collect()) == [2, 2.5, 3]


def test_assembly_checks_each_set_once(spark):
    """A repeated key in any set is named; null keys are one key."""
    s1 = spark.createDataFrame([(1, 10), (2, 20)], "id int, f1 int")
    s2 = spark.createDataFrame([(1, 1), (1, 2)], "id int, f2 int")
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "id int, f3 int")
    with pytest.raises(ValueError, match="set_2 is not unique"):
        joins.assemble_feature_sets({"set_1": s1, "set_2": s2}, "id")
    with pytest.raises(ValueError, match="set_3 is not unique"):
        joins.assemble_feature_sets({"set_1": s1, "set_3": nulls}, "id")
    assert joins.assemble_feature_sets({"set_1": s1, "set_2": s2}, "id", validate=False).count() == 2
