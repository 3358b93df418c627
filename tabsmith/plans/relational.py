"""Plans for cleaning, keys, joins, features, targets and profiles.

Surrogates for the booking domain on the driver tables: nights ->
``l_quantity``/``l_linenumber``; price per head -> ``l_extendedprice /
l_quantity``; season -> ISO week of ``l_shipdate``; PIT -> ``events`` by
``user_id`` ordered by ``ts``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import predicates, scalar, targets
from tabsmith.functions.hashing import content_fingerprint, input_row_hash
from tabsmith.operators import clean, features, joins, prefix, profile, quality, segment, synth
from tabsmith.operators.keys import add_row_id_for, register_row_id_policy
from tabsmith.plans.base import r6, register, round_to, table
from tabsmith.sources.io import NULL_TOKENS, apply_null_tokens

# ---------------------------------------------------------------- cleaning

ORDERS_SPEC = clean.SchemaSpec(columns=(
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "date"), ("o_orderpriority", "string")))
ORDERS_RULES = [clean.ValueRule("o_totalprice", "gte", 2000.0),
                clean.ValueRule("o_totalprice", "lte", 450000.0),
                clean.ValueRule("o_orderstatus", "in", ["F", "O"])]
ORDERS_POLICY = [clean.ValueRule("o_totalprice", "gte", 0.0),
                 clean.ValueRule("o_totalprice", "lte", 600000.0),
                 clean.ValueRule("o_orderstatus", "in", ["F", "O", "P"]),
                 clean.ValueRule("o_custkey", "gte", 0)]


def _raw_orders(spark, d):
    """Orders with raw-looking headers, so the name rules (P1) do real work."""
    o = table(spark, d, "orders")
    return o.toDF(*[f"  {c.upper().replace('_', '-', 1)} " for c in o.columns])


@register("clean_orders", covers="P1 P2 P3 P4 F1 F2 F3 U1", sql="""
SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
       trim(o_orderstatus) AS o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       CAST(o_orderdate AS DATE) AS o_orderdate, trim(o_orderpriority) AS o_orderpriority
FROM orders
WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL
  AND (o_totalprice >= 2000.0 OR o_totalprice IS NULL)
  AND (o_totalprice <= 450000.0 OR o_totalprice IS NULL)
  AND (trim(o_orderstatus) IN ('F', 'O') OR o_orderstatus IS NULL OR trim(o_orderstatus) = '')
""")
def q_clean_orders(spark, d):
    return clean.clean_table(_raw_orders(spark, d), ORDERS_SPEC, ORDERS_RULES)


@register("clean_report", covers="F7 F1 F2 F3", sql="""
SELECT 'gte' AS rule, 'o_totalprice' AS "column", CAST(count(*) FILTER (WHERE NOT (o_totalprice >= 2000.0 OR o_totalprice IS NULL)) AS BIGINT) AS rejected FROM orders
UNION ALL SELECT 'lte', 'o_totalprice', CAST(count(*) FILTER (WHERE NOT (o_totalprice <= 450000.0 OR o_totalprice IS NULL)) AS BIGINT) FROM orders
UNION ALL SELECT 'in', 'o_orderstatus', CAST(count(*) FILTER (WHERE NOT (trim(o_orderstatus) IN ('F', 'O') OR o_orderstatus IS NULL OR trim(o_orderstatus) = '')) AS BIGINT) FROM orders
UNION ALL SELECT 'gte', 'o_custkey', CAST(count(*) FILTER (WHERE NOT (o_custkey >= 0 OR o_custkey IS NULL)) AS BIGINT) FROM orders
""")
def q_clean_report(spark, d):
    rules = clean.merge_rules(ORDERS_RULES, ORDERS_POLICY)
    o = clean.strip_strings(table(spark, d, "orders"))
    return clean.rejection_report(o, rules)


def _tokens_sql() -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)


@register("null_csv_tokens", covers="S2", sql=f"""
SELECT n_nationkey, CASE WHEN raw IN ({_tokens_sql()}) THEN NULL ELSE raw END AS n_name
FROM (SELECT n_nationkey,
             CASE n_regionkey WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'NULL'
                  ELSE n_name END AS raw
      FROM nation)
""")
def q_null_csv_tokens(spark, d):
    n = table(spark, d, "nation")
    raw = n.select("n_nationkey", F.when(F.col("n_regionkey") == 0, "NA").when(F.col("n_regionkey") == 1, "")
                   .when(F.col("n_regionkey") == 2, "nan").when(F.col("n_regionkey") == 3, "NULL")
                   .otherwise(F.col("n_name")).alias("n_name"))
    return apply_null_tokens(raw, ["n_name"])


# ---------------------------------------------------------------- predicates, segments

_SEG = "NULLIF(c_mktsegment, 'BUILDING')"
_BAL = "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END"


@register("predicates_all", covers="F4", sql=f"""
SELECT c_custkey,
  COALESCE(seg = 'MACHINERY', FALSE) AS p_eq,
  seg IS DISTINCT FROM 'MACHINERY' AS p_neq,
  COALESCE(seg IN ('MACHINERY', 'FURNITURE'), FALSE) AS p_in,
  NOT COALESCE(seg IN ('MACHINERY', 'FURNITURE'), FALSE) AS p_not_in,
  COALESCE(bal > 5000, FALSE) AS p_gt, COALESCE(bal >= 5000, FALSE) AS p_gte,
  COALESCE(bal < 1000, FALSE) AS p_lt, COALESCE(bal <= 1000, FALSE) AS p_lte
FROM (SELECT c_custkey, {_SEG} AS seg, {_BAL} AS bal FROM customer)
""")
def q_predicates_all(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.expr(_SEG).alias("seg"), F.expr(_BAL).alias("bal"))
    p = predicates.predicate
    return c.select("c_custkey",
                    p("seg", "eq", "MACHINERY").alias("p_eq"), p("seg", "neq", "MACHINERY").alias("p_neq"),
                    p("seg", "in", ["MACHINERY", "FURNITURE"]).alias("p_in"),
                    p("seg", "not_in", ["MACHINERY", "FURNITURE"]).alias("p_not_in"),
                    p("bal", "gt", 5000).alias("p_gt"), p("bal", "gte", 5000).alias("p_gte"),
                    p("bal", "lt", 1000).alias("p_lt"), p("bal", "lte", 1000).alias("p_lte"))


@register("segment", covers="F5 F6", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def q_segment(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return segment.apply_segmentation(o, [("o_orderstatus", "eq", "F"),
                                          ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])])


# ---------------------------------------------------------------- keys and hashes

def _field_sql(tag: str, c: str) -> str:
    """A field of ``hashing.row_text``."""
    text = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '{tag}-' ELSE '{tag}' || CAST(length({text}) AS VARCHAR) || ':' || {text} END"


@register("row_id", covers="X10 W1 O3 R4", sql=f"""
WITH li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
                   CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem),
h AS (SELECT *, sha256(concat_ws('-', CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus)) AS base,
             sha256({_field_sql("i", "l_orderkey")} || {_field_sql("i", "l_partkey")} || {_field_sql("i", "l_suppkey")} ||
                    {_field_sql("i", "l_linenumber")} || {_field_sql("s", "l_returnflag")} || {_field_sql("s", "l_linestatus")} ||
                    {_field_sql("t", "l_shipdate")}) AS fp
      FROM li)
SELECT l_orderkey, l_linenumber,
       base || '-' || CAST(row_number() OVER (PARTITION BY base ORDER BY fp) - 1 AS VARCHAR) AS row_id
FROM h
""")
def q_row_id(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                            "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("l_shipdate"))
    register_row_id_policy("lineitem", ["l_partkey", "l_returnflag", "l_linestatus"])
    return add_row_id_for(li, "lineitem").select("l_orderkey", "l_linenumber", "row_id")


@register("row_id_unique", covers="Q1 X10", sql="""
SELECT CAST(0 AS BIGINT) AS n_duplicate_ids, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem
""")
def q_row_id_unique(spark, d):
    ids = q_row_id(spark, d)
    return ids.agg((F.count(F.lit(1)) - F.count_distinct("row_id")).alias("n_duplicate_ids"),
                   F.count(F.lit(1)).alias("n_rows"))


@register("input_hash", covers="X12", sql="""
SELECT o_orderkey,
       sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
                        o_orderpriority, o_orderstatus, printf('%.9e', o_totalprice))) AS input_hash
FROM orders
""")
def q_input_hash(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", input_row_hash(o, exclude=["o_orderkey"]).alias("input_hash"))


@register("fingerprint_portable", covers="X14 S12 Q8", sql=f"""
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256({_field_sql("i", "c_custkey")} || {_field_sql("s", "c_name")} ||
       {_field_sql("i", "c_nationkey")} || {_field_sql("f", "c_acctbal")} || {_field_sql("s", "c_mktsegment")}), 1, 15)) AS BIGINT)) AS VARCHAR) AS sum_sha
FROM customer
""")
def q_fingerprint_portable(spark, d):
    from tabsmith.functions.hashing import portable_fingerprint
    return portable_fingerprint(table(spark, d, "customer"))


@register("fingerprint", covers="X14 S12")
def q_fingerprint(spark, d):
    return content_fingerprint(table(spark, d, "customer"))


# ---------------------------------------------------------------- joins

def _orders_by_day(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), round_to(F.sum("o_totalprice"), 2).alias("total_price"))


def _lines_by_day(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), round_to(F.sum("l_quantity"), 2).alias("quantity"))


_ODAY = ("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total_price "
         "FROM orders GROUP BY 1")
_LDAY = ("SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity "
         "FROM lineitem GROUP BY 1")


def _merge_sql(how: str, key: str) -> str:
    return f"""
SELECT {key} AS day, l.n_rows, l.total_price, r.quantity
FROM ({_ODAY}) l {how} JOIN ({_LDAY}) r ON l.day IS NOT DISTINCT FROM r.day
"""


for _how, _key in (("inner", "l.day"), ("left", "l.day"), ("right", "r.day"), ("outer", "COALESCE(l.day, r.day)")):
    def _mk(how):
        def q(spark, d):
            return joins.merge(_orders_by_day(spark, d), _lines_by_day(spark, d), ["day"], how, validate="1:1")
        return q
    register(f"merge_{_how}", covers="J1 J2 P9",
             sql=_merge_sql({"outer": "FULL OUTER"}.get(_how, _how.upper()), _key))(_mk(_how))


@register("merge_null_keys", covers="J1", sql="""
SELECT c.c_custkey, c.nationkey, n.nation_name
FROM (SELECT c_custkey, NULLIF(c_nationkey, 0) AS nationkey FROM customer) c
JOIN (SELECT NULLIF(n_nationkey, 0) AS nationkey, n_name AS nation_name FROM nation) n
  ON c.nationkey IS NOT DISTINCT FROM n.nationkey
""")
def q_merge_null_keys(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("NULLIF(c_nationkey, 0)").alias("nationkey"))
    n = table(spark, d, "nation").select(F.expr("NULLIF(n_nationkey, 0)").alias("nationkey"),
                                         F.col("n_name").alias("nation_name"))
    return joins.merge(c, n, ["nationkey"], "inner", validate="m:1")


@register("merge_validate", covers="J2", sql="""
SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
""")
def q_merge_validate(spark, d):
    return joins.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey"])


def _feature_sets(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    profile_set = c.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"),
                           F.col("c_nationkey").alias("nationkey"))
    orders_set = o.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), round_to(F.sum("o_totalprice"), 2).alias("total_spent"),
        F.max("o_orderpriority").alias("acctbal"))  # overlapping name: the left copy wins
    target = c.select(F.col("c_custkey").alias("custkey"), (F.col("c_acctbal") > 5000).cast("int").alias("target"))
    return {"b_orders": orders_set, "a_profile": profile_set}, target


@register("assemble", covers="J4 J5 J6 P8 O2", sql="""
SELECT a.custkey, a.acctbal, a.nationkey, b.n_orders, b.total_spent, t.target
FROM (SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_nationkey AS nationkey FROM customer) a
JOIN (SELECT o_custkey AS custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_spent
      FROM orders GROUP BY 1) b ON a.custkey IS NOT DISTINCT FROM b.custkey
JOIN (SELECT c_custkey AS custkey, CAST(c_acctbal > 5000 AS INTEGER) AS target FROM customer) t
  ON a.custkey = t.custkey
""")
def q_assemble(spark, d):
    sets, target = _feature_sets(spark, d)
    feats = joins.assemble_feature_sets(sets, "custkey")
    joins.assert_keys_in_target(feats, target, "custkey")
    return joins.output_columns(joins.join_target(feats, target, "custkey", assembled=True), "custkey", target=None)


@register("join_coverage", covers="J8", sql="""
SELECT CAST(sum(COALESCE(r.n, 0)) AS DOUBLE) / count(*) AS coverage
FROM orders l LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) GROUP BY 1) r
  ON l.o_orderkey = r.l_orderkey
""")
def q_join_coverage(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct().withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.join_coverage(table(spark, d, "orders"), lines, ["o_orderkey"])


@register("lineage_diff", covers="U3", sql="""
SELECT nationkey, 'expected_only' AS side FROM
  (SELECT c_nationkey AS nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
UNION ALL
SELECT nationkey, 'actual_only' FROM
  (SELECT s_nationkey AS nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)
""")
def q_lineage_diff(spark, d):
    e = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return joins.lineage_diff(e, a)


@register("lineage_union", covers="U5", sql="""
SELECT c_nationkey AS nationkey, c_mktsegment AS segment FROM customer
UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier
""")
def q_lineage_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("SUPPLIER").alias("segment"))
    return joins.union_distinct(c, s)


@register("schema_merge", covers="P11 S7", sql="""
SELECT feature, dtype FROM (
  SELECT feature, dtype, row_number() OVER (PARTITION BY feature ORDER BY src, pos) AS rn FROM (
    SELECT 'c_custkey' AS feature, 'bigint' AS dtype, 0 AS src, 0 AS pos
    UNION ALL SELECT 'c_name', 'string', 0, 1 UNION ALL SELECT 'c_nationkey', 'int', 0, 2
    UNION ALL SELECT 'c_acctbal', 'double', 0, 3 UNION ALL SELECT 'c_mktsegment', 'string', 0, 4
    UNION ALL SELECT 'c_custkey', 'int', 1, 0 UNION ALL SELECT 'c_acctbal', 'float', 1, 1
    UNION ALL SELECT 's_name', 'string', 1, 2))
WHERE rn = 1
""")
def q_schema_merge(spark, d):
    from tabsmith.sources.io import schema_table
    c = table(spark, d, "customer")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("c_custkey"),
                                           F.col("s_acctbal").cast("float").alias("c_acctbal"), "s_name")
    merged = joins.aggregate_schema_tables([schema_table(spark, c), schema_table(spark, s)])
    return merged.select("feature", "dtype")


# ---------------------------------------------------------------- derived features and targets

@register("derived_features", covers="X1 X2 X3 X4 X13 X18", sql="""
SELECT l_orderkey, l_linenumber,
       CAST(l_quantity AS INTEGER) + l_linenumber AS total_stay,
       round(l_extendedprice / CASE WHEN l_quantity = 0 THEN 1 ELSE l_quantity END, 6) AS adr_per_person,
       CASE WHEN weekofyear(l_shipdate) BETWEEN 10 AND 21 THEN 'Spring'
            WHEN weekofyear(l_shipdate) BETWEEN 22 AND 34 THEN 'Summer'
            WHEN weekofyear(l_shipdate) BETWEEN 35 AND 47 THEN 'Fall' ELSE 'Winter' END AS season,
       monthname(l_shipdate) AS month_name,
       CAST(l_shipdate AS DATE) AS arrival_date
FROM lineitem
""")
def q_derived_features(spark, d):
    li = table(spark, d, "lineitem")
    parts = scalar.date_parts(F.col("l_shipdate"))
    x = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  parts["year"].alias("y"), parts["month"].alias("month_name"), parts["day"].alias("dd"),
                  parts["week"].alias("wk"))
    return x.select("l_orderkey", "l_linenumber",
                    scalar.total_stay("l_quantity", "l_linenumber").alias("total_stay"),
                    r6(scalar.price_per_person("l_extendedprice", "l_quantity")).alias("adr_per_person"),
                    scalar.season_of_week("wk").alias("season"), "month_name",
                    scalar.arrival_date("y", "month_name", "dd").alias("arrival_date"))


_EV_DATE = "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END"


@register("fill_dates", covers="W3 X4", sql=f"""
SELECT event_id, COALESCE(
  last_value(d IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(d IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM (SELECT event_id, {_EV_DATE} AS d FROM events)
""")
def q_fill_dates(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_EV_DATE).alias("d"))
    return features.fill_forward_backward(e, "d", ["event_id"], out="filled").select("event_id", "filled")


@register("fill_dates_by_user", covers="W3", sql=f"""
SELECT event_id, COALESCE(
  last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM (SELECT event_id, user_id, ts, {_EV_DATE} AS d FROM events)
""")
def q_fill_dates_by_user(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.expr(_EV_DATE).alias("d"))
    return features.fill_forward_backward(e, "d", ["ts", "event_id"], ["user_id"], out="filled") \
        .select("event_id", "filled")


@register("fill_by_name", covers="W3", sql="""
SELECT c_custkey, COALESCE(
  last_value(d IGNORE NULLS) OVER (ORDER BY c_name, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(d IGNORE NULLS) OVER (ORDER BY c_name, c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS d FROM customer)
""")
def q_fill_by_name(spark, d):
    """Names share a long prefix; the whole string decides the bucket."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.expr("CASE WHEN c_acctbal > 0 THEN c_acctbal END").alias("d"))
    return features.fill_forward_backward(c, "d", ["c_name", "c_custkey"], out="filled").select("c_custkey", "filled")


@register("prefix_descending", covers="W5 W6", sql="""
SELECT c_custkey, CAST(count(*) OVER w AS BIGINT) AS n_after, CAST(sum(CAST(trunc(c_acctbal) AS BIGINT)) OVER w AS BIGINT) AS units_after,
       last_value(CASE WHEN c_acctbal > 0 THEN c_custkey END IGNORE NULLS) OVER w AS last_positive
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_name DESC, c_custkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def q_prefix_descending(spark, d):
    """Running count, sum and last value over the names of a market segment from the last to the first."""
    c = table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("long").alias("units"),
        F.expr("CASE WHEN c_acctbal > 0 THEN c_custkey END").alias("positive"))
    out = prefix.prefix_aggregate(c, ["c_name", "c_custkey"], {
        "n_after": ("count", F.lit(1)), "units_after": ("sum", "units"), "last_positive": ("last", "positive")},
        ["c_mktsegment"], descending=True)
    return out.select("c_custkey", "n_after", "units_after", "last_positive")


_A = "NULLIF(o_orderstatus, 'P')"
_B = "CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END"


@register("targets", covers="X5 X6 X7 R3", sql=f"""
SELECT o_orderkey, CAST((a IS DISTINCT FROM b) AS INTEGER) AS room_upgrade,
       CAST(COALESCE(a = 'F', FALSE) AS INTEGER) AS no_show, o_totalprice AS price
FROM (SELECT o_orderkey, o_totalprice, {_A} AS a, {_B} AS b FROM orders)
""")
def q_targets(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    return o.select("o_orderkey", targets.differs_flag("a", "b").alias("room_upgrade"),
                    targets.equals_flag("a", "F").alias("no_show"), F.col("o_totalprice").alias("price"))


@register("target_transforms", covers="X8 X9", sql="""
SELECT o_orderkey,
  round(ln(1 + o_totalprice), 6) AS t_log1p, round(sqrt(o_totalprice), 6) AS t_sqrt,
  round((pow(o_totalprice, 0.5) - 1) / 0.5, 6) AS t_boxcox, round(ln(o_totalprice), 6) AS t_boxcox0,
  round(exp(ln(1 + o_totalprice)) - 1, 2) AS inv_log1p, round(sqrt(o_totalprice) * sqrt(o_totalprice), 2) AS inv_sqrt,
  round(pow(0.5 * ((pow(o_totalprice, 0.5) - 1) / 0.5) + 1, 2.0), 2) AS inv_boxcox
FROM orders
""")
def q_target_transforms(spark, d):
    o = table(spark, d, "orders")
    x = "o_totalprice"
    cols = {"t_log1p": targets.forward(x, "log1p"), "t_sqrt": targets.forward(x, "sqrt"),
            "t_boxcox": targets.forward(x, "boxcox", 0.5), "t_boxcox0": targets.forward(x, "boxcox", 0.0)}
    t = o.select("o_orderkey", *[v.alias(k) for k, v in cols.items()])
    return t.select("o_orderkey", *[r6(k).alias(k) for k in cols],
                    round_to(targets.inverse("t_log1p", "log1p"), 2).alias("inv_log1p"),
                    round_to(targets.inverse("t_sqrt", "sqrt"), 2).alias("inv_sqrt"),
                    round_to(targets.inverse("t_boxcox", "boxcox", 0.5), 2).alias("inv_boxcox"))


_PIT_VALUE = "CAST(value AS DECIMAL(12, 2))"


def _pit_sql(func: str) -> str:
    w = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    gm = "(SELECT CAST(sum(v) AS DOUBLE) / count(v) FROM ev)"
    val = {"mean": f"CAST(sum(v) OVER {w} AS DOUBLE) / count(v) OVER {w}",
           "sum": f"CASE WHEN count(v) OVER {w} > 0 THEN CAST(sum(v) OVER {w} AS DOUBLE) END",
           "min": f"CAST(min(v) OVER {w} AS DOUBLE)", "max": f"CAST(max(v) OVER {w} AS DOUBLE)",
           "count": f"CAST(count(v) OVER {w} AS DOUBLE)", "std": f"stddev_samp(CAST(v AS DOUBLE)) OVER {w}"}[func]
    return f"""
WITH ev AS (SELECT event_id, user_id, ts, {_PIT_VALUE} AS v FROM events)
SELECT event_id, round(CASE WHEN count(*) OVER {w} = 0 THEN {gm} ELSE COALESCE({val}, {gm}) END, 6) AS feature
FROM ev
"""


for _f in ("mean", "sum", "min", "max", "count", "std"):
    def _mkp(func):
        def q(spark, d):
            e = table(spark, d, "events").withColumn("value", F.expr(_PIT_VALUE))
            out = features.pit_feature(e, ["user_id"], "ts", "value", func, "feature", tiebreak=["event_id"])
            return out.select("event_id", r6("feature").alias("feature"))
        return q
    register(f"pit_{_f}", covers="W2 R5", sql=_pit_sql(_f))(_mkp(_f))


@register("feature_operators", covers="R1 R2 Q9 X1 X2 X3 X4", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) + l_linenumber AS total_stay,
  round(l_extendedprice / CASE WHEN CAST(l_quantity AS INTEGER) + l_linenumber + 0 = 0 THEN 1
        ELSE CAST(l_quantity AS INTEGER) + l_linenumber + 0 END, 6) AS adr_per_person,
  CASE WHEN weekofyear(l_shipdate) BETWEEN 10 AND 21 THEN 'Spring' WHEN weekofyear(l_shipdate) BETWEEN 22 AND 34 THEN 'Summer'
       WHEN weekofyear(l_shipdate) BETWEEN 35 AND 47 THEN 'Fall' ELSE 'Winter' END AS arrival_season,
  CAST(l_shipdate AS DATE) AS arrival_date
FROM lineitem
""")
def q_feature_operators(spark, d):
    li = table(spark, d, "lineitem")
    parts = scalar.date_parts(F.col("l_shipdate"))
    booking = li.select("l_orderkey", "l_linenumber",
                        F.col("l_quantity").cast("int").alias("stays_in_weekend_nights"),
                        F.col("l_linenumber").alias("stays_in_week_nights"),
                        F.col("l_extendedprice").alias("adr"),
                        F.col("l_quantity").cast("int").alias("adults"), F.col("l_linenumber").alias("children"),
                        F.lit(0).alias("babies"), parts["week"].alias("arrival_date_week_number"),
                        parts["year"].alias("arrival_date_year"), parts["month"].alias("arrival_date_month"),
                        parts["day"].alias("arrival_date_day_of_month"))
    out = features.apply_operators(booking, ["TotalStay", "AdrPerPerson", "ArrivalSeason", "ArrivalDate"])
    return out.select("l_orderkey", "l_linenumber", "total_stay", r6("adr_per_person").alias("adr_per_person"),
                      "arrival_season", "arrival_date")


@register("fill_categorical", covers="P12", sql="""
SELECT p_partkey, COALESCE(CAST(NULLIF(p_brand, 'Brand#1') AS VARCHAR), 'missing') AS p_brand,
       COALESCE(CAST(p_size AS VARCHAR), 'missing') AS p_size
FROM part
""")
def q_fill_categorical(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("NULLIF(p_brand, 'Brand#1')").alias("p_brand"), "p_size")
    return features.fill_categorical_missing(p, ["p_brand", "p_size", "not_a_column"])


@register("lump_top_n", covers="Y7 O5", sql="""
WITH top AS (SELECT p_brand AS b FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
             ORDER BY count(*) DESC, p_brand ASC LIMIT 20)
SELECT p_partkey, CASE WHEN top.b IS NOT NULL THEN p_brand ELSE 'Other' END AS p_brand
FROM part LEFT JOIN top ON part.p_brand = top.b
""")
def q_lump_top_n(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return synth.lump_top_n(p, "p_brand", 20)


@register("top_categories", covers="O5", sql="""
SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count(*) DESC, p_brand ASC LIMIT 20
""")
def q_top_categories(spark, d):
    return profile.most_frequent(table(spark, d, "part"), "p_brand", 20)


# ---------------------------------------------------------------- profiles

def _describe_sql(t: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
  FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {t})""")
    return "\nUNION ALL\n".join(parts)


@register("profile", covers="A7 A8 A9", sql=_describe_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def q_profile(spark, d):
    out = profile.describe(table(spark, d, "customer"))
    return out.select("column", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("null_report", covers="A9 Q15", sql="""
SELECT 'c_custkey' AS "column", CAST(count(*) - count(c_custkey) AS BIGINT) AS n_null FROM customer
UNION ALL SELECT 'c_name', CAST(count(*) - count(c_name) AS BIGINT) FROM customer
UNION ALL SELECT 'c_nationkey', CAST(count(*) - count(c_nationkey) AS BIGINT) FROM customer
UNION ALL SELECT 'c_acctbal', CAST(count(*) - count(bal) AS BIGINT) FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
UNION ALL SELECT 'c_mktsegment', CAST(count(*) - count(seg) AS BIGINT) FROM (SELECT NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer)
""")
def q_null_report(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey",
                                           F.expr(_BAL).alias("c_acctbal"), F.expr("NULLIF(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return profile.null_report(c)


@register("any_null_share", covers="A9", sql=f"""
SELECT avg(CASE WHEN bal IS NULL OR seg IS NULL THEN 1.0 ELSE 0.0 END) AS any_null_share
FROM (SELECT {_BAL} AS bal, {_SEG} AS seg FROM customer)
""")
def q_any_null_share(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(_BAL).alias("bal"), F.expr(_SEG).alias("seg"))
    return profile.any_null_share(c, exclude=["c_custkey"])


@register("footprint", covers="A13 S12", sql="""
SELECT CAST(sum(strlen(c_name)) + sum(strlen(c_mktsegment)) + 8 * count(c_custkey) + 4 * count(c_nationkey)
            + 8 * count(c_acctbal) AS BIGINT) AS logical_bytes, count(*) AS n_rows
FROM customer
""")
def q_footprint(spark, d):
    return profile.footprint(table(spark, d, "customer"))


_QCOLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("quantiles", covers="A6", sql="\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.01), 6) AS q_low, round(quantile_cont({c}, 0.99), 6) AS q_high FROM lineitem"""
    for c in _QCOLS))
def q_quantiles(spark, d):
    q = profile.quantile_pair(table(spark, d, "lineitem"), _QCOLS)
    return q.select("column", r6("q_low").alias("q_low"), r6("q_high").alias("q_high"))


@register("clip", covers="X15 Y3", sql="""
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_extendedprice < q.lo THEN q.lo WHEN l_extendedprice > q.hi THEN q.hi ELSE l_extendedprice END, 6) AS l_extendedprice,
  round(CASE WHEN l_quantity < q.qlo THEN q.qlo WHEN l_quantity > q.qhi THEN q.qhi ELSE l_quantity END, 6) AS l_quantity
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi,
                       quantile_cont(l_quantity, 0.01) AS qlo, quantile_cont(l_quantity, 0.99) AS qhi FROM lineitem) q
""")
def q_clip(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = synth.clip_to_real_range(li, li, ["l_extendedprice", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", r6("l_extendedprice").alias("l_extendedprice"),
                      r6("l_quantity").alias("l_quantity"))


_CCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("correlations", covers="A10", sql="\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_CCOLS) for b in _CCOLS[i + 1:]))
def q_correlations(spark, d):
    return profile.correlations(table(spark, d, "lineitem"), _CCOLS).select("col_a", "col_b", r6("corr").alias("corr"))


@register("rare_categories", covers="A11", sql="""
SELECT CAST(count(*) FILTER (WHERE n < 40) AS BIGINT) AS n_rare, count(*) AS n_categories
FROM (SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name)
""")
def q_rare_categories(spark, d):
    return profile.rare_categories(table(spark, d, "part"), "p_name", 40)


@register("least_frequent", covers="A11 O5", sql="""
SELECT p_name AS value, count(*) AS count FROM part WHERE p_name IS NOT NULL
GROUP BY p_name ORDER BY count(*) ASC, p_name ASC LIMIT 5
""")
def q_least_frequent(spark, d):
    return profile.least_frequent(table(spark, d, "part"), "p_name", 5)


@register("duplicates", covers="A12 U1", sql="""
SELECT CAST(COALESCE(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority)
""")
def q_duplicates(spark, d):
    return profile.duplicate_rows(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@register("value_distribution", covers="A5", sql="""
SELECT l_returnflag AS value, count(*) AS count, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS share
FROM lineitem GROUP BY l_returnflag
""")
def q_value_distribution(spark, d):
    return profile.value_distribution(table(spark, d, "lineitem"), "l_returnflag")


@register("quality_report", covers="Q1 Q2 Q3 Q4 Q7 Q15", sql="""
SELECT 'entity_key_unique' AS rule, 'c_custkey' AS "column", CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected, count(*) - count(DISTINCT c_custkey) = 0 AS passed FROM customer
UNION ALL SELECT 'entity_key_not_null', 'c_custkey', CAST(count(*) - count(c_custkey) AS BIGINT), 0, count(*) - count(c_custkey) = 0 FROM customer
UNION ALL SELECT 'min_rows', '*', count(*), 100, count(*) >= 100 FROM customer
UNION ALL SELECT 'not_null', 'c_name', CAST(count(*) - count(c_name) AS BIGINT), 0, count(*) - count(c_name) = 0 FROM customer
UNION ALL SELECT 'not_null', 'c_acctbal', CAST(count(*) - count(c_acctbal) AS BIGINT), 0, count(*) - count(c_acctbal) = 0 FROM customer
UNION ALL SELECT 'max_cardinality', 'c_mktsegment', count(DISTINCT c_mktsegment), 4, count(DISTINCT c_mktsegment) <= 4 FROM customer
UNION ALL SELECT 'target_not_null', 'high_balance', CAST(count(*) - count(c_acctbal) AS BIGINT), 0, count(*) - count(c_acctbal) = 0 FROM customer
UNION ALL SELECT 'target_min_classes', 'high_balance', count(DISTINCT c_acctbal > 5000), 2, count(DISTINCT c_acctbal > 5000) >= 2 FROM customer
UNION ALL SELECT 'target_positive_present', 'high_balance', count(*) FILTER (WHERE c_acctbal > 5000), 1, count(*) FILTER (WHERE c_acctbal > 5000) >= 1 FROM customer
UNION ALL SELECT 'target_min_class_count', CAST(CAST(c_acctbal > 5000 AS INTEGER) AS VARCHAR), count(*), 50, count(*) >= 50 FROM customer GROUP BY c_acctbal > 5000
""")
def q_quality_report(spark, d):
    c = table(spark, d, "customer").withColumn("high_balance", (F.col("c_acctbal") > 5000).cast("int"))
    return quality.quality_report(c, entity_key="c_custkey", min_rows=100, not_null=["c_name", "c_acctbal"],
                                  max_cardinality={"c_mktsegment": 4}, target="high_balance",
                                  min_class_count=50)


# ---------------------------------------------------------------- synthetic-data repair

_REAL = "event_type = 'view'"


@register("date_shift", covers="Y1", sql=f"""
SELECT event_id, strftime(ts + ((SELECT max(ts) FROM events WHERE {_REAL}) - (SELECT min(ts) FROM events WHERE NOT ({_REAL})))
                          + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events WHERE NOT ({_REAL})
""")
def q_date_shift(spark, d):
    e = table(spark, d, "events")
    real, syn = e.where(_REAL), e.where(f"NOT ({_REAL})")
    out = synth.shift_dates_after(real, syn, ["ts"])
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("split_date_shift", covers="Y2 X4 X13", sql=f"""
SELECT event_id, CAST(year(nd) AS INTEGER) AS y, monthname(nd) AS m, CAST(day(nd) AS INTEGER) AS dd, CAST(weekofyear(nd) AS INTEGER) AS wk FROM (
  SELECT event_id, CAST(ts AS DATE) + CAST((SELECT max(CAST(ts AS DATE)) FROM events WHERE {_REAL})
        - (SELECT min(CAST(ts AS DATE)) FROM events WHERE NOT ({_REAL})) AS INTEGER) + 1 AS nd
  FROM events WHERE NOT ({_REAL}))
""")
def q_split_date_shift(spark, d):
    e = table(spark, d, "events")
    parts = scalar.date_parts(F.col("ts"))
    e = e.select("event_id", "event_type", parts["year"].alias("y"), parts["month"].alias("m"),
                 parts["day"].alias("dd"), parts["week"].alias("wk"))
    out = synth.shift_split_dates_after(e.where(_REAL), e.where(f"NOT ({_REAL})"), "y", "m", "dd", "wk")
    return out.select("event_id", "y", "m", "dd", "wk")


@register("domain_repair", covers="Y4 Y8 X15", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
       COALESCE(NULLIF(c_nationkey, 0), 0) AS c_nationkey
FROM customer
""")
def q_domain_repair(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.expr("NULLIF(c_nationkey, 0)").alias("c_nationkey"))
    return synth.zero_fill(synth.domain_repair(c, {"c_acctbal": 0.0}), ["c_nationkey"])


@register("category_align", covers="Y5", sql="""
SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) THEN c_nationkey END AS c_nationkey
FROM customer
""")
def q_category_align(spark, d):
    real = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return synth.align_categories(real, c, ["c_nationkey"])


@register("impute", covers="Y6", sql=f"""
SELECT c_custkey, COALESCE(bal, (SELECT quantile_cont(bal2, 0.5) FROM (SELECT {_BAL} AS bal2 FROM customer))) AS c_acctbal,
       COALESCE(seg, 'missing') AS c_mktsegment
FROM (SELECT c_custkey, {_BAL} AS bal, {_SEG} AS seg FROM customer)
""")
def q_impute(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(_BAL).alias("c_acctbal"), F.expr(_SEG).alias("c_mktsegment"))
    return synth.impute(c, ["c_acctbal"], ["c_mktsegment"])


@register("union_old", covers="U2", sql="""
SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
""")
def q_union_old(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"),
                                             F.col("s_acctbal").alias("c_acctbal"))
    return synth.union_old(old, new)


@register("merge_all", covers="J3 J9 J1", sql="""
SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, n.n_name, n.n_regionkey, o.n_orders
FROM customer c
LEFT JOIN nation n ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o
  ON c.c_custkey IS NOT DISTINCT FROM o.c_custkey
""")
def q_merge_all(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    # the orders aggregate shares no key with nation, so J3 puts it after customer in config order
    return joins.merge_all([
        {"name": "customer", "df": c, "keys": ["c_custkey", "c_nationkey"]},
        {"name": "orders", "df": o, "keys": ["c_custkey"], "how": "left", "validate": "m:1"},
        {"name": "nation", "df": n, "keys": ["c_nationkey"], "how": "left", "validate": "m:1"},
    ]).select("c_custkey", "c_nationkey", "c_acctbal", "n_name", "n_regionkey", "n_orders")


@register("eda_subsets", covers="F8 A9", sql=f"""
SELECT count(*) FILTER (WHERE bal IS NULL) AS n_null_balance, count(*) FILTER (WHERE seg IS NULL) AS n_null_segment,
       count(*) FILTER (WHERE bal IS NULL AND seg IS NULL) AS n_both_null,
       count(*) FILTER (WHERE c_acctbal >= 0) AS n_non_negative
FROM (SELECT c_acctbal, {_BAL} AS bal, {_SEG} AS seg FROM customer)
""")
def q_eda_subsets(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", F.expr(_BAL).alias("bal"), F.expr(_SEG).alias("seg"))
    return c.agg(F.count_if(F.col("bal").isNull()).alias("n_null_balance"),
                 F.count_if(F.col("seg").isNull()).alias("n_null_segment"),
                 F.count_if(F.col("bal").isNull() & F.col("seg").isNull()).alias("n_both_null"),
                 F.count_if(F.col("c_acctbal") >= 0).alias("n_non_negative"))


@register("safe_numbers", covers="X19 Y5", sql=r"""
SELECT event_id, TRY_CAST(regexp_extract(props, ':\s*([0-9]+)', 1) AS INTEGER) AS k,
       TRY_CAST(event_type AS INTEGER) AS event_type_num
FROM events
""")
def q_safe_numbers(spark, d):
    e = table(spark, d, "events").select("event_id", F.regexp_extract("props", r":\s*([0-9]+)", 1).alias("k"),
                                         F.col("event_type").alias("event_type_num"))
    return synth.coerce_types(e, {"k": "int", "event_type_num": "int"})


@register("footprint_documents", covers="A13 S12", sql="""
SELECT CAST(sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)) + 8 * count(doc_id) + 8 * count(n_chars) AS BIGINT)
       AS logical_bytes, count(*) AS n_rows
FROM documents
""")
def q_footprint_documents(spark, d):
    """Logical size of the document table, whole texts included."""
    return profile.footprint(table(spark, d, "documents"))


@register("null_report_documents", covers="A9 Q15", sql="""
SELECT 'doc_id' AS "column", CAST(count(*) - count(doc_id) AS BIGINT) AS n_null FROM documents
UNION ALL SELECT 'text', CAST(count(*) - count(text) AS BIGINT) FROM documents
UNION ALL SELECT 'lang', CAST(count(*) - count(lang) AS BIGINT) FROM documents
UNION ALL SELECT 'source', CAST(count(*) - count(source) AS BIGINT) FROM documents
UNION ALL SELECT 'n_chars', CAST(count(*) - count(n_chars) AS BIGINT) FROM documents
""")
def q_null_report_documents(spark, d):
    return profile.null_report(table(spark, d, "documents"))
