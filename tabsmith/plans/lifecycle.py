"""Plans from stored snapshots to trained models: lineage, targets, encodings, attributions, staged
metrics, drift between bindings, synthetic quality.

Learners cannot be put in SQL; where one takes part, the oracle states the contract that its result
must keep (additivity, probabilities, one row per input row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import targets
from tabsmith.operators import drift, encode, features, joins, ml, steps, synth, trees
from tabsmith.operators.user_aggregate import UserAggregate
from tabsmith.plans.base import r6, register, round_to, table
from tabsmith.plans.model import CAT, NUM, _training_table
from tabsmith.plans.storage import _scratch
from tabsmith.sources import io, lineage, snapshots

# ---- lineage (J9) ---------------------------------------------------------------


@register("lineage_reload", covers="J9 U3 J1 J2", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey, n_name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def q_lineage_reload(spark, d):
    """Orders with customer and nation, rebuilt from lineage rows over stored snapshots."""
    store = _scratch(spark, "lineage")
    parts = {"orders": table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_totalprice"),
             "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", F.col("c_nationkey").alias("nationkey")),
             "nation": table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")}
    recorded = []
    for name, df in parts.items():
        path = f"{store}/{name}/v1/data.parquet"
        df.write.parquet(path)
        recorded.append({"name": name, "version": "v1", "snapshot": "2026-01-01T00-00-00_0000abcd", "path": path, "how": "left",
                         "keys": {"customer": ["custkey"], "nation": ["nationkey"]}.get(name),
                         "cardinality": None if name == "orders" else "m:1"})
    rows = f"{store}/lineage.parquet"
    lineage.record_lineage(spark, recorded).write.parquet(rows)
    out = lineage.reload_from_lineage(spark, spark.read.parquet(rows))
    return out.select("o_orderkey", F.col("custkey").alias("o_custkey"), "o_totalprice", "c_name", F.col("nationkey").alias("c_nationkey"), "n_name")


# ---- targets (R3, X7) -------------------------------------------------------------

# Which driver column stands for which source column of the example.
_AS_SOURCE = {"adr": "o_totalprice", "lead_time": "CAST(o_custkey AS INT)", "is_repeated_guest": "CAST(o_custkey % 2 AS INT)",
              "total_of_special_requests": "CAST(o_custkey % 5 AS INT)", "is_canceled": "CAST(o_custkey % 3 = 0 AS INT)",
              "reserved_room_type": "o_orderstatus", "assigned_room_type": "CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END",
              "reservation_status": "CASE WHEN o_totalprice > 300000 THEN 'No-Show' END"}


@register("target_registry", covers="R3 X5 X6 X7", sql=f"""
SELECT o_orderkey, {_AS_SOURCE['adr']} AS adr, {_AS_SOURCE['lead_time']} AS lead_time, {_AS_SOURCE['is_repeated_guest']} AS is_repeated_guest,
       {_AS_SOURCE['total_of_special_requests']} AS total_of_special_requests, {_AS_SOURCE['is_canceled']} AS is_canceled,
       CAST(o_orderstatus IS DISTINCT FROM {_AS_SOURCE['assigned_room_type']} AS INT) AS room_upgrade,
       CAST(o_totalprice > 300000 AS INT) AS no_show FROM orders
""")
def q_target_registry(spark, d):
    """Every registered target over the orders, joined by key."""
    o = table(spark, d, "orders").select("o_orderkey", *[F.expr(e).alias(c) for c, e in _AS_SOURCE.items()])
    built = {f"{n}/{v}": targets.build_target(o, n, v, "o_orderkey") for n, v in sorted(targets.TARGETS)}
    return joins.assemble_feature_sets(built, "o_orderkey")


# ---- categories with many values (L2) ------------------------------------------------

def _customers_of_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority",
                                            "o_totalprice", (F.dayofweek("o_orderdate") >= 5).cast("int").alias("label"))


_ORDER_U = "CAST(CAST(('0x' || substr(sha256(concat_ws(':', CAST(o_orderkey AS VARCHAR), '42')), 1, 15)) AS BIGINT) AS DOUBLE) / 1152921504606846976.0"


@register("target_statistics", covers="L2 W2", sql=f"""
WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CAST(dayofweek(o_orderdate) >= 4 AS INT) AS label, {_ORDER_U} AS u FROM orders),
p AS (SELECT avg(label) AS prior FROM o)
SELECT o_orderkey, round((coalesce(sum(label) OVER w, 0) + prior) / (count(label) OVER w + 1), 6) AS customer__target_mean
FROM o, p WINDOW w AS (PARTITION BY customer ORDER BY u, CAST(o_orderkey AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def q_target_statistics(spark, d):
    """A customer's mean label over its earlier orders, in hash order."""
    out = encode.ordered_statistics(_customers_of_orders(spark, d), ["customer"], "label", "o_orderkey")
    return out.select("o_orderkey", r6("customer__target_mean").alias("customer__target_mean"))


@register("train_many_categories", covers="L2 P15", sql="""
SELECT o_orderkey, CAST(dayofweek(o_orderdate) >= 4 AS INT) AS label, TRUE AS has_probability FROM orders
""")
def q_train_many_categories(spark, d):
    """A classifier over thousands of customers; every order gets a probability."""
    t = _customers_of_orders(spark, d)
    model = encode.train_encoded(t, ["o_orderpriority"], ["customer"], ["o_totalprice"], "label", "o_orderkey", maxIter=5, maxDepth=3)
    return model.score(t).select("o_orderkey", "label", F.col("y_proba").between(0.0, 1.0).alias("has_probability"))


# ---- pipeline steps (L1) ---------------------------------------------------------------

_STEP_ORDER = [("validate", ["stays_in_weekend_nights:int", "stays_in_week_nights:int", "market:string", "price:double"]),
               ("fill", ["market"]), ("engineer", ["TotalStay"]), ("select", ["market", "price", "total_stay"])]


@register("pipeline_steps", covers="L1 P7 P12 R2 Q6", sql="SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM orders")
def q_pipeline_steps(spark, d):
    """A configured pipeline, fitted, saved to the shared folder and loaded again, scores every order as before."""
    from pyspark.ml import PipelineModel
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("stays_in_weekend_nights"), (F.col("o_custkey") % 7).cast("int").alias("stays_in_week_nights"),
        F.expr("nullif(o_orderpriority, '1-URGENT')").alias("market"), F.col("o_totalprice").alias("price"),
        (F.dayofweek("o_orderdate") >= 5).cast("double").alias("label"))
    model = steps.build_pipeline(_STEP_ORDER, ["market"], ["price", "total_stay"], "label", keep=["o_orderkey"], maxIter=3, maxDepth=3).fit(o)
    path = _scratch(spark, "pipeline-model")
    model.write().save(path)
    again = PipelineModel.load(path)
    return steps.scores_equal(ml.score(model, o), ml.score(again, o), "o_orderkey", "y_proba")


# ---- attributions and staged metrics (L7, M19) -----------------------------------------

def _small_model(spark, d):
    t = _training_table(spark, d)
    return t, ml.train(t.where("split = 'train'"), CAT, NUM, "label", maxIter=5, maxDepth=3)


@register("attribution_additivity", covers="L7", sql="""
SELECT l_returnflag, count(*) AS n_rows, TRUE AS adds_up FROM lineitem GROUP BY l_returnflag
""")
def q_attribution_additivity(spark, d):
    """Contributions and base of every row add up to the model's own margin."""
    from pyspark.ml.functions import vector_to_array
    t, model = _small_model(spark, d)
    told = model.transform(t).withColumn("margin", vector_to_array("rawPrediction")[1])
    rows = trees.tree_contributions(model, told.select(*t.columns, "margin"), ["l_returnflag", "margin"])
    off = F.abs(F.col("base") + F.expr("aggregate(contributions, 0D, (a, c) -> a + c)") - F.col("margin"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), (F.max(off) < 1e-9).alias("adds_up"))


@register("attribution_topk", covers="L7 A14 O4")
def q_attribution_topk(spark, d):
    """Mean absolute exact attributions over all test rows."""
    t, model = _small_model(spark, d)
    rows = trees.tree_contributions(model, t.where("split = 'test'"), ["entity_key"])
    return trees.attribution_importances(rows, [*CAT, *NUM], k=20)


_STAGES = ["(l_discount - 0.05) * 4", "(l_discount - 0.05) * 4 + (l_quantity - 25) / 50", "(l_quantity - 25) / 10", "CAST(l_tax AS DOUBLE)"]
_STAGE_SPLIT = "CASE l_linenumber % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"


def _auc_sql(split: str) -> str:
    return f"""SELECT '{split}_auc' AS metric, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS value FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM x JOIN best ON i = b WHERE split = '{split}' GROUP BY s))"""


@register("training_metrics", covers="M19 M7", sql=f"""
WITH x AS (SELECT {_STAGE_SPLIT} AS split, CAST(l_returnflag = 'R' AS INT) AS y, unnest([1, 2, 3, 4]) AS i, unnest([{', '.join(_STAGES)}]) AS s FROM lineitem),
l AS (SELECT i, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS loss FROM (
        SELECT i, y, least(greatest(1 / (1 + exp(-2 * s)), 1e-15), 1 - 1e-15) AS p FROM x WHERE split = 'val') GROUP BY i),
best AS (SELECT i AS b FROM l ORDER BY loss, i LIMIT 1)
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'best_iteration' AS metric, CAST(b AS DOUBLE) AS value FROM best UNION ALL {_auc_sql('train')} UNION ALL {_auc_sql('val')})
""")
def q_training_metrics(spark, d):
    """Best iteration by validation loss, train and validation AUC there, from a table of staged scores."""
    scored = table(spark, d, "lineitem").select(F.expr(_STAGE_SPLIT).alias("split"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
                                                F.array(*map(F.expr, _STAGES)).alias("stages"))
    return trees.training_metrics(scored, "y", n_stages=len(_STAGES)).select("metric", r6("value").alias("value"))


_REG_STAGES = ["ln(1 + l_extendedprice) * 0.9", "ln(1 + l_extendedprice * (1 + l_discount))", "ln(1 + l_quantity * 1000)"]


def _reg_sql(split: str) -> str:
    return f"""SELECT unnest(['{split}_rmse', '{split}_mae', '{split}_r2']) AS metric, unnest([rmse, mae, r2]) AS value FROM (
  SELECT sqrt(avg((t - p) * (t - p))) AS rmse, avg(abs(t - p)) AS mae, 1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)) AS r2
  FROM (SELECT exp(y) - 1 AS t, exp(s) - 1 AS p FROM x JOIN best ON i = b WHERE split = '{split}'))"""


@register("training_metrics_regression", covers="M19 M14 M15 X9", sql=f"""
WITH x AS (SELECT {_STAGE_SPLIT} AS split, ln(1 + l_extendedprice) AS y, unnest([1, 2, 3]) AS i, unnest([{', '.join(_REG_STAGES)}]) AS s FROM lineitem),
best AS (SELECT i AS b FROM (SELECT i, avg((y - s) * (y - s)) AS loss FROM x WHERE split = 'val' GROUP BY i) ORDER BY loss, i LIMIT 1)
SELECT metric, round(value, 4) AS value FROM (
  SELECT 'best_iteration' AS metric, CAST(b AS DOUBLE) AS value FROM best UNION ALL {_reg_sql('train')} UNION ALL {_reg_sql('val')})
""")
def q_training_metrics_regression(spark, d):
    """The same for a regression on a log scale, errors on the original one."""
    scored = table(spark, d, "lineitem").select(F.expr(_STAGE_SPLIT).alias("split"), F.expr("ln(1 + l_extendedprice)").alias("y"),
                                                F.array(*map(F.expr, _REG_STAGES)).alias("stages"))
    out = trees.training_metrics(scored, "y", "regression", inverse=lambda c: F.exp(c) - 1, n_stages=len(_REG_STAGES))
    return out.select("metric", round_to("value", 4).alias("value"))


@register("train_metrics_model", covers="M19 L2")
def q_train_metrics_model(spark, d):
    """M19 of a trained model: staged margins of its own trees."""
    t, model = _small_model(spark, d)
    return trees.training_metrics(trees.staged_scores(model, t, ["split", "label"]), "label")


# ---- drift between two bindings (D10) ---------------------------------------------------

_EARLY = "o_orderkey % 2 = 0"


@register("drift_snapshots", covers="D10 D5 S10 D4", sql=f"""
SELECT 'o_totalprice' AS feature, 'ks' AS method, round(max(abs(ce / E - ca / A)), 6) AS score FROM (
  SELECT sum(e) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ce, sum(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ca,
         sum(e) OVER () AS E, sum(a) OVER () AS A FROM (
    SELECT v, count(*) FILTER (WHERE early) AS e, count(*) FILTER (WHERE NOT early) AS a FROM (
      SELECT {_EARLY} AS early, CASE WHEN {_EARLY} THEN o_totalprice ELSE o_totalprice * 1.25 END AS v FROM orders) GROUP BY v))
""")
def q_drift_snapshots(spark, d):
    """Features of the training binding against those of the inference binding, both resolved from one store."""
    store = _scratch(spark, "drift-store")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ids = {"train": "2026-01-01T00-00-00_0000abcd", "infer": "2026-02-01T00-00-00_0000abce"}
    io.persist_feature_snapshot(o.where(_EARLY), store, "prices", "v1", ids["train"])
    later = o.where(f"NOT ({_EARLY})").withColumn("o_totalprice", F.col("o_totalprice") * 1.25)
    io.persist_feature_snapshot(later, store, "prices", "v1", ids["infer"])
    requested = spark.createDataFrame([("prices", "v1", None)], "name string, version string, given_snapshot string")
    bound = spark.createDataFrame([(b, "features", "prices", "v1", s) for b, s in ids.items()],
                                  "binding_id string, kind string, name string, version string, snapshot string")
    expected, actual = snapshots.drift_inputs(spark, store, requested, bound, "train", "infer", "o_orderkey")
    rep = drift.drift_report(expected, actual, exclude=["o_orderkey"])
    return rep.select("feature", "method", r6("score").alias("score"))


# ---- synthetic quality (Y9) ----------------------------------------------------------------

_Y9_NUM, _Y9_CAT, _Y9_REAL = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], "l_linenumber % 2 = 0"


def _trend_sql() -> str:
    parts = []
    for i, a in enumerate(_Y9_NUM):
        for b in _Y9_NUM[i + 1:]:
            parts.append(f"""SELECT '{a}' AS column_a, '{b}' AS column_b, 'correlation' AS kind,
  1 - abs(corr({a}, {b}) FILTER (WHERE {_Y9_REAL}) - corr({a}, {b}) FILTER (WHERE NOT ({_Y9_REAL}))) / 2 AS similarity FROM lineitem""")
    for i, a in enumerate(_Y9_CAT):
        for b in [*_Y9_CAT[i + 1:], *_Y9_NUM]:
            cell = b if b in _Y9_CAT else f"""greatest(least(floor(({b} - (SELECT min({b}) FROM lineitem WHERE {_Y9_REAL})) /
  (SELECT max({b}) - min({b}) FROM lineitem WHERE {_Y9_REAL}) * 10), 9), 0)"""
            parts.append(f"""SELECT '{a}', '{b}', 'contingency', 1 - sum(abs(r / tr - s / ts)) / 2 FROM (
  SELECT r, s, sum(r) OVER () AS tr, sum(s) OVER () AS ts FROM (
    SELECT count(*) FILTER (WHERE {_Y9_REAL}) AS r, count(*) FILTER (WHERE NOT ({_Y9_REAL})) AS s FROM lineitem
    WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {cell}))""")
    return "\nUNION ALL ".join(parts)


def _sides(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", *_Y9_NUM, *_Y9_CAT)
    return li.where(_Y9_REAL), li.where(f"NOT ({_Y9_REAL})")


@register("pair_trends", covers="Y9", sql=f"SELECT column_a, column_b, kind, round(similarity, 6) AS similarity FROM ({_trend_sql()})")
def q_pair_trends(spark, d):
    real, made = _sides(spark, d)
    return synth.pair_trends(real, made, _Y9_NUM, _Y9_CAT).withColumn("similarity", r6("similarity"))


@register("synthetic_quality", covers="Y9", sql=f"""
SELECT 'column_pair_trends' AS property, round(avg(similarity), 6) AS score, avg(similarity) >= 0.7 AS passed FROM ({_trend_sql()})
""")
def q_synthetic_quality(spark, d):
    """The gate on pair trends."""
    real, made = _sides(spark, d)
    gate = synth.quality_gate(synth.pair_trends(real, made, _Y9_NUM, _Y9_CAT))
    return gate.select(F.lit("column_pair_trends").alias("property"), r6("score").alias("score"), "passed")


# ---- a caller's own aggregate (R5) -----------------------------------------------------------

class Spread(UserAggregate):
    """The range of the values so far, and whether there are any."""

    def init(self):
        return (float("inf"), float("-inf"))

    def update(self, state, value):
        return (min(state[0], value), max(state[1], value))

    def merge(self, a, b):
        return (min(a[0], b[0]), max(a[1], b[1]))

    def finish(self, state):
        return state[1] - state[0] if state[0] <= state[1] else None


@register("pit_user_aggregate", covers="R5 W2", sql="""
WITH g AS (SELECT avg(value) AS m FROM events)
SELECT event_id, round(coalesce(max(value) OVER w - min(value) OVER w, m), 6) AS feature FROM events, g
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def q_pit_user_aggregate(spark, d):
    """The range of a user's earlier values, as an aggregate of the caller's own."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = features.pit_feature(e, ["user_id"], "ts", "value", Spread(), "feature", tiebreak=["event_id"])
    return out.select("event_id", r6("feature").alias("feature"))
