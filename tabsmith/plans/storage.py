"""Plans for sources and sinks: each writes to the shared folder named by
``spark.checkpoint.dir`` and returns what it reads back, so the oracle is the
SQL over the original table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.hashing import content_fingerprint, schema_fingerprint
from tabsmith.operators import clean, features, integrity, joins, quality
from tabsmith.plans.base import register, table
from tabsmith.session import ensure_checkpoint_dir
from tabsmith.sources import io


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tabsmith-store", name, uuid.uuid4().hex)


# ---------------------------------------------------------------- freeze a feature set

FREEZE_COLS = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"]
FREEZE_ROLES = {"o_custkey": "numerical", "o_totalprice": "numerical", "o_orderstatus": "categorical",
                "o_orderdate": "datetime"}


@register("freeze_features", covers="A4 P5 P6 P7 P10 P13 Q3 Q4 Q5 Q6 Q8 S1 S3 S4 S7 X14 R4", sql="""
SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice, o_orderstatus,
       CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders
""")
def q_freeze_features(spark, d):
    o = table(spark, d, "orders")
    narrow = o.select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice",
                      "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    processed = clean.remove_columns(narrow, ["o_orderpriority"])
    feats = features.prepare_features(processed, "o_orderkey", FREEZE_COLS)
    quality.require_columns(feats, ["o_orderkey", *FREEZE_COLS])
    bad_roles = quality.check_roles(feats, FREEZE_ROLES)
    if bad_roles:
        raise ValueError(f"role/type mismatch: {bad_roles}")
    quality.assert_quality(quality.quality_report(feats, entity_key="o_orderkey", not_null=FREEZE_COLS,
                                                  max_cardinality={"o_orderstatus": 10}))
    store = _scratch(spark, "feature_store")
    path = io.persist_feature_snapshot(feats, store, "order_features", "v1", "2026-01-01T00-00-00_0000abcd",
                                       bucket_by="o_orderkey")
    schema = io.schema_table(spark, feats, entity_key="o_orderkey", roles=FREEZE_ROLES)
    schema.coalesce(1).write.option("header", True).csv(os.path.join(os.path.dirname(path), "input_schema.csv"))
    listed = features.pipeline_features(spark.read.option("header", True).csv(
        os.path.join(os.path.dirname(path), "input_schema.csv")))
    back = io.read_data(spark, "parquet", path)
    back = features.select_features(back, ["o_orderkey", *[c for c in FREEZE_COLS if c in listed]])
    # integrity (Q8): schema hash must match; content fingerprints must agree
    if schema_fingerprint(back.schema) != schema_fingerprint(feats.schema):
        raise ValueError("schema hash of the frozen snapshot differs")
    if content_fingerprint(back).first() != content_fingerprint(feats).first():
        raise ValueError("content fingerprint of the frozen snapshot differs")
    return back


@register("file_hashes", covers="X14 Q13", sql=None)
def q_file_hashes(spark, d):
    """Hash tree of every file of a written snapshot, chunk by chunk."""
    path = _scratch(spark, "files")
    io.save_data(table(spark, d, "customer"), path, "zstd")
    return integrity.file_hashes(spark, path)


@register("feature_set_integrity", covers="Q8 Q13 X14", sql="""
SELECT count(*) AS n_rows, TRUE AS strict_ok, CAST(0 AS BIGINT) AS n_different FROM customer
""")
def q_feature_set_integrity(spark, d):
    """A stored snapshot against its stored manifest: key, schema, content and files."""
    path, facts = _scratch(spark, "integrity"), _scratch(spark, "manifest")
    io.save_data(table(spark, d, "customer"), path, "zstd")
    integrity.write_manifest(spark, path, facts)
    warnings = integrity.verify_feature_set(spark, path, facts, "c_custkey")
    different = integrity.compare_manifest(spark, path, facts).count()
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("n_rows", F.lit(not warnings).alias("strict_ok"), F.lit(different).cast("long").alias("n_different"))


# ---------------------------------------------------------------- format round trips

CUSTOMER_SCHEMA = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                                T.StructField("c_mktsegment", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])


@register("csv_roundtrip", covers="S1 S2 S13", sql="""
SELECT c_custkey, c_name, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       c_acctbal FROM customer
""")
def q_csv_roundtrip(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
         .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("NA")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        "c_acctbal")
    path = _scratch(spark, "csv")
    io.save_csv(c, path)
    return io.read_data(spark, "csv", path, CUSTOMER_SCHEMA)


@register("csv_documents_roundtrip", covers="S1 S2 S13", sql=f"""
SELECT doc_id, CASE WHEN text IN ({", ".join(repr(t) for t in io.NULL_TOKENS)}) THEN NULL ELSE text END AS text FROM documents
""")
def q_csv_documents_roundtrip(spark, d):
    """Whole texts, with line breaks and quotes, through the CSV sink and back."""
    path = _scratch(spark, "csv-documents")
    io.save_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return io.read_data(spark, "csv", path, schema)


@register("json_roundtrip", covers="S1", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
""")
def q_json_roundtrip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                         F.to_date("o_orderdate").alias("o_orderdate"))
    path = _scratch(spark, "json")
    o.write.json(path)
    return io.read_data(spark, "json", path, o.schema)


@register("arrow_roundtrip", covers="S1", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem
""")
def q_arrow_roundtrip(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
                                            F.to_date("l_shipdate").alias("l_shipdate"))
    path = _scratch(spark, "arrow")
    written = io.write_arrow_ipc(li, path).count()
    if written == 0:
        raise ValueError("nothing written")
    return io.read_data(spark, "arrow", path, li.schema)


# ---------------------------------------------------------------- prediction and report sinks

def _pred_sink_sql():
    from tabsmith.plans.evaluation import PRED_CTE
    return f"WITH {PRED_CTE}\nSELECT entity_key, split, y_true, y_pred, y_proba FROM ps WHERE split = 'test'"


def _metrics_sql():
    from tabsmith.plans.evaluation import q_classification_metrics  # noqa: F401  (registers it first)
    from tabsmith.plans.base import ORACLE
    return ORACLE["classification_metrics"]


@register("predictions_sink", covers="S5 S11 O1", sql=_pred_sink_sql())
def q_predictions_sink(spark, d):
    from tabsmith.plans.evaluation import _predictions

    p = _predictions(spark, d).select("entity_key", "split", "y_true", "y_pred", F.col("y_proba"))
    path = _scratch(spark, "predictions")
    io.save_predictions(joins.sorted_for_sink(p, ["entity_key"]), path)
    return spark.read.parquet(path).where(F.col("split") == "test")


@register("metrics_csv", covers="S6 M6", sql=_metrics_sql())
def q_metrics_csv(spark, d):
    from tabsmith.plans.evaluation import q_classification_metrics

    m = q_classification_metrics(spark, d)
    path = _scratch(spark, "metrics")
    io.save_metrics_csv(m, path)
    return spark.read.option("header", True).schema(m.schema).csv(path)
