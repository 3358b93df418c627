"""Data-quality assertions (Q1-Q16) compiled into one aggregate pass.

``quality_report`` returns ``(rule, column, observed, expected, passed)``;
``assert_quality`` raises on the first failure, like the reference's eager
checks.  Schema-level rules (Q5, Q6, Q9, Q10) read metadata only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators.joins import duplicate_keys


def quality_report(df: DataFrame, *, entity_key: str | None = None, min_rows: int | None = None,
                   not_null: list[str] | tuple = (), max_cardinality: dict[str, int] | None = None,
                   target: str | None = None, task: str = "classification", positive_class=1,
                   min_class_count: int | None = None, target_min: float | None = None,
                   target_max: float | None = None, all_columns_not_null: bool = False) -> DataFrame:
    """Q1-Q4, Q7, Q15 in one aggregate (plus one ``groupBy(target)`` for class counts)."""
    rules = []  # (rule, column, observed expr, expected literal, pass expr on observed)
    if entity_key:
        rules.append(("entity_key_unique", entity_key,
                      F.count(F.lit(1)) - F.count_distinct(F.col(entity_key)), 0, "eq"))
        rules.append(("entity_key_not_null", entity_key, F.count_if(F.col(entity_key).isNull()), 0, "eq"))
    if min_rows:
        rules.append(("min_rows", "*", F.count(F.lit(1)), min_rows, "ge"))
    cols = list(not_null) + ([c for c in df.columns if c not in not_null] if all_columns_not_null else [])
    for c in cols:
        rules.append(("not_null", c, F.count_if(F.col(f"`{c}`").isNull()), 0, "eq"))
    for c, limit in (max_cardinality or {}).items():
        rules.append(("max_cardinality", c, F.count_distinct(F.col(f"`{c}`")), limit, "le"))
    if target:
        t = F.col(target)
        rules.append(("target_not_null", target, F.count_if(t.isNull()), 0, "eq"))
        if task == "classification":
            rules.append(("target_min_classes", target, F.count_distinct(t), 2, "ge"))
            rules.append(("target_positive_present", target, F.count_if(t == F.lit(positive_class)), 1, "ge"))
        else:
            if target_min is not None:
                rules.append(("target_min", target, F.count_if(t < F.lit(target_min)), 0, "eq"))
            if target_max is not None:
                rules.append(("target_max", target, F.count_if(t > F.lit(target_max)), 0, "eq"))
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "rule string, column string, observed bigint, expected bigint, passed boolean")
    wide = df.agg(*[r[2].cast("long").alias(f"o{i}") for i, r in enumerate(rules)])
    stack = ", ".join(f"'{r[0]}', '{r[1]}', o{i}, cast({int(r[3])} as bigint), '{r[4]}'"
                      for i, r in enumerate(rules))
    long = wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, column, observed, expected, cmp)")
    passed = (F.when(F.col("cmp") == "eq", F.col("observed") == F.col("expected"))
              .when(F.col("cmp") == "ge", F.col("observed") >= F.col("expected"))
              .otherwise(F.col("observed") <= F.col("expected")))
    out = long.select("rule", "column", "observed", "expected", passed.alias("passed"))
    if target and task == "classification" and min_class_count:
        per_class = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("observed"))
        out = out.unionByName(per_class.select(
            F.lit("target_min_class_count").alias("rule"), F.col(target).cast("string").alias("column"),
            F.col("observed").cast("long"), F.lit(int(min_class_count)).cast("long").alias("expected"),
            (F.col("observed") >= min_class_count).alias("passed")))
    return out


def assert_quality(report: DataFrame) -> None:
    failed = report.where(~F.col("passed")).limit(1).collect()
    if failed:
        raise ValueError(f"data-quality rule failed: {failed[0].asDict()}")


def entity_key_duplicates(df: DataFrame, entity_key: str) -> DataFrame:
    """Q1 listing: every duplicated key with its count."""
    return duplicate_keys(df, [entity_key])


def min_rows_ok(df: DataFrame, n: int | None) -> bool:
    """Q2, short-circuiting: reads at most ``n`` rows."""
    if not n:
        return True
    return df.limit(n).count() >= n


# ---- schema-level checks --------------------------------------------------

ROLE_TYPES = {
    "categorical": (T.StringType, T.BooleanType),
    "numerical": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def check_roles(df: DataFrame, roles: dict[str, str]) -> list[str]:
    """Q5: columns whose type does not fit their role."""
    bad = []
    for c, role in roles.items():
        if not isinstance(df.schema[c].dataType, ROLE_TYPES[role]):
            bad.append(c)
    return bad


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Q6."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")


PREDICTION_BASE_COLUMNS = ["run_id", "prediction_id", "timestamp", "model_stage", "model_version",
                           "entity_id", "input_hash", "prediction", "schema_version"]


def check_prediction_columns(df: DataFrame) -> None:
    """Q10: the 9 base columns and contiguous ``proba_0..n-1``."""
    require_columns(df, PREDICTION_BASE_COLUMNS)
    idx = sorted(int(c.split("_", 1)[1]) for c in df.columns if c.startswith("proba_"))
    if idx != list(range(len(idx))):
        raise ValueError(f"probability columns are not contiguous: {idx}")


def check_file_hash(actual: str, expected: str | None) -> None:
    """Q13: absent expected hash -> skip."""
    if expected is not None and actual != expected:
        raise ValueError("stored file hash differs from the data")
