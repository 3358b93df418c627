"""Reproducible splits, folds and samples (K1-K5, A1, A2).

Membership comes from a hash of the entity key and a seed, never from
``randomSplit`` or row order, so training and evaluation recompute the same
split on any cluster layout.  The exact variant (sizes equal to the
reference's ``ceil`` rule, per class when stratified) ranks rows by that
hash with the bucketed prefix -- no global sort into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.hashing import hash_unit_interval
from tabsmith.operators.prefix import prefix_row_number
from tabsmith.session import written


def hash_split(df: DataFrame, key: str, test_size: float, val_size: float = 0.0,
               seed: int = 42, out: str = "split") -> DataFrame:
    """K1/K3 (approximate sizes): thresholds on a uniform hash; test first, then val."""
    u = hash_unit_interval(F.col(key), seed)
    val_frac = val_size / (1 - test_size) if val_size else 0.0
    # the second draw re-uses the hash's position inside the non-test range
    rest = (u - F.lit(test_size)) / F.lit(1 - test_size)
    return df.withColumn(out, F.when(u < test_size, "test")
                         .when(rest < val_frac, "val").otherwise("train"))


def exact_split(df: DataFrame, key: str, test_size: float, val_size: float = 0.0,
                stratify_by: str | None = None, seed: int = 42, out: str = "split",
                n_buckets: int | None = None) -> DataFrame:
    """K1-K3 with exact sizes: per stratum of n rows, ``ceil(n*test)`` rows go to
    test, then ``ceil(m*val/(1-test))`` of the remaining m to val, in hash order."""
    u = hash_unit_interval(F.col(key), seed)
    d = df.withColumn("_u", u).withColumn("_k", F.col(key).cast("string"))
    groups = [stratify_by] if stratify_by else []
    # without strata the hash itself deals rows out, and boundaries need no pass over the data
    ranked = prefix_row_number(d, ["_u", "_k"], groups, name="_r", n_buckets=n_buckets, with_count="_n", uniform=True)
    n = F.col("_n").cast("double")
    n_test = F.ceil(n * F.lit(float(test_size)))
    rem = F.col("_n") - n_test
    val_frac = float(val_size) / (1.0 - float(test_size)) if val_size else 0.0
    n_val = F.ceil(rem.cast("double") * F.lit(val_frac))
    r = F.col("_r")
    return ranked.withColumn(out, F.when(r < n_test, "test").when(r < n_test + n_val, "val")
                             .otherwise("train")).drop("_u", "_k", "_r", "_n")


def split_report(df: DataFrame, y: str, split: str = "split") -> DataFrame:
    """A1 + A2 + row counts: (split, class, n_rows, share, n_split, positive_rate)."""
    per = df.groupBy(split, F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_rows"))
    tot = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_split"),
                                F.avg(F.col(y).cast("double")).alias("positive_rate"))
    return per.join(tot, split).select(split, "class", "n_rows", (F.col("n_rows") / F.col("n_split")).alias("share"),
                                       "n_split", "positive_rate")


def attribution_sample(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """K4: min(n, rows) rows without replacement, chosen by hash (a top-n by hash)."""
    return df.withColumn("_u", hash_unit_interval(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def cv_folds(df: DataFrame, key: str, k: int, stratify_by: str | None = None, seed: int = 42,
             out: str = "fold", n_buckets: int | None = None) -> DataFrame:
    """K5: k folds.  Unstratified: ``floor(u * k)``.  Stratified: round-robin over
    the hash order inside each class, so every class is spread evenly."""
    u = hash_unit_interval(F.col(key), seed)
    if not stratify_by:
        return df.withColumn(out, F.least(F.floor(u * k), F.lit(k - 1)).cast("int"))
    d = df.withColumn("_u", u).withColumn("_k", F.col(key).cast("string"))
    ranked = prefix_row_number(d, ["_u", "_k"], [stratify_by], name="_r", n_buckets=n_buckets)
    return ranked.withColumn(out, F.pmod(F.col("_r"), F.lit(k)).cast("int")).drop("_u", "_k", "_r")


def entity_folds(df: DataFrame, key: str, k: int, stratify_by: str, seed: int = 42, out: str = "fold",
                 n_buckets: int | None = None) -> DataFrame:
    """K5 by entity: each key lies whole in one fold, and the keys of each class are dealt out in
    hash order.  A key of several classes counts for its highest; null keys form one entity."""
    # ranking reads the entities several times: grouped once
    entities = written(df.groupBy(F.col(f"`{key}`").alias("_entity")).agg(F.max(stratify_by).alias("_class")), "entities")
    folds = cv_folds(entities, "_entity", k, "_class", seed, "_dealt", n_buckets).select("_entity", "_dealt")
    return df.join(folds, F.col(f"`{key}`").eqNullSafe(F.col("_entity"))).withColumn(out, F.col("_dealt")) \
        .drop("_entity", "_dealt")


def expected_sizes(n: int, test_size: float, val_size: float = 0.0) -> tuple[int, int, int]:
    """Driver-side helper for tests: (train, val, test) sizes of the exact rule."""
    n_test = math.ceil(n * test_size)
    n_val = math.ceil((n - n_test) * (val_size / (1 - test_size))) if val_size else 0
    return n - n_test - n_val, n_val, n_test
