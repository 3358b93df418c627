"""Drift between a reference (expected) and a current (actual) table, and
performance monitoring (D1-D9, Q16).

All columns are handled in one pass per type: both tables are unpivoted to
``(feature, side, value)`` -- numeric columns as double, the rest as text --
instead of looping over columns.  Per-feature edge tables have one row per
column, a bound fixed by the schema, so they are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators.prefix import prefix_aggregate
from tabsmith.session import written

PSI_FLOOR = 1e-6
KS_MIN_DISTINCT = 20
N_BINS = 10
# Severity bands (upper bounds, exclusive) shared by KS and PSI.
SEVERITY_BANDS = [(0.1, "low"), (0.25, "moderate"), (0.5, "high")]
SEVERITY_TOP = "severe"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)


def numeric_columns(df: DataFrame, cols=None) -> list[str]:
    cols = cols or df.columns
    return [f.name for f in df.schema.fields if f.name in set(cols) and isinstance(f.dataType, _NUMERIC)]


def long_form(expected: DataFrame, actual: DataFrame, cols: list[str], as_text: bool) -> DataFrame:
    """(side, feature, value) for the given columns of both tables, nulls dropped."""
    missing = [c for c in cols if c not in actual.columns]
    if missing:
        raise ValueError(f"columns missing from the actual table: {missing}")
    t = "string" if as_text else "double"

    def side(df, name):
        return df.select(F.lit(name).alias("side"),
                         *[F.col(f"`{c}`").cast("int" if isinstance(df.schema[c].dataType, T.BooleanType)
                                                else t).cast(t).alias(c) for c in cols])

    both = side(expected, "expected").unionByName(side(actual, "actual"))
    return both.unpivot(["side"], cols, "feature", "value").where(F.col("value").isNotNull())


def drift_methods(expected: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric with >= 20 distinct expected values -> ks; everything else -> psi."""
    cols = cols or expected.columns
    num = numeric_columns(expected, cols)
    rows = []
    if num:
        cd = expected.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in num])
        rows.append(cd.unpivot([], num, "feature", "n_distinct"))
    text = [c for c in cols if c not in set(num)]
    spark = expected.sparkSession
    out = reduce(lambda a, b: a.unionByName(b), rows) if rows else \
        spark.createDataFrame([], "feature string, n_distinct bigint")
    out = out.select("feature", F.col("n_distinct").cast("long"),
                     F.when(F.col("n_distinct") >= KS_MIN_DISTINCT, "ks").otherwise("psi").alias("method"))
    if text:
        out = out.unionByName(spark.createDataFrame([(c, None, "psi") for c in text],
                                                    "feature string, n_distinct bigint, method string"))
    return out


def _psi_from_counts(counts: DataFrame) -> DataFrame:
    """counts: (feature, bin, side, cnt) -> (feature, psi); shares floor at 1e-6."""
    per_bin = counts.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("side") == "expected", F.col("cnt")).otherwise(0)).alias("e_cnt"),
        F.sum(F.when(F.col("side") == "actual", F.col("cnt")).otherwise(0)).alias("a_cnt"))
    totals = per_bin.groupBy("feature").agg(F.sum("e_cnt").alias("e_tot"), F.sum("a_cnt").alias("a_tot"))
    j = per_bin.join(F.broadcast(totals), "feature")
    e = F.col("e_cnt") / F.col("e_tot")
    a = F.col("a_cnt") / F.col("a_tot")
    e = F.when(F.col("e_cnt") == 0, F.lit(PSI_FLOOR)).otherwise(e)
    a = F.when(F.col("a_cnt") == 0, F.lit(PSI_FLOOR)).otherwise(a)
    return j.groupBy("feature").agg(F.sum((e - a) * F.log(e / a)).alias("score"),
                                    F.min("e_tot").alias("n_expected"), F.min("a_tot").alias("n_actual"))


def numeric_edges(long_num: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Per feature: equal-width edges over the expected range (constant -> +-0.5)."""
    mm = long_num.where(F.col("side") == "expected").groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    return mm.select("feature", lo.alias("lo"), hi.alias("hi"), ((hi - lo) / n_bins).alias("step"))


def psi_numeric(long_num: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Right-closed bins (lowest edge included) over the expected range;
    actual values outside it leave the actual distribution."""
    return _psi_of_numbers(_counts_of(long_num), n_bins)


def _counts_of(long_form: DataFrame) -> DataFrame:
    """(feature, value, n_e, n_a): equal values of both sides in one row."""
    return long_form.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "expected").alias("n_e"), F.count_if(F.col("side") == "actual").alias("n_a"))


def _psi_of_numbers(counts: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    edges = numeric_edges(counts.where("n_e > 0").withColumn("side", F.lit("expected")), n_bins)
    j = counts.join(F.broadcast(edges), "feature")  # one row per column
    v = F.col("value")
    e = [F.lit(i) * F.col("step") + F.col("lo") for i in range(n_bins)]
    b = reduce(lambda acc, x: acc + x, [(v > ei).cast("int") for ei in e]) + (v == e[0]).cast("int")
    inside = j.where((v >= F.col("lo")) & (v <= F.col("hi"))).withColumn("bin", b.cast("string"))
    # every bin exists on both sides (empty bins -> floor on both -> 0 contribution)
    return _psi_of_bins(inside)


def _psi_of_bins(counts: DataFrame) -> DataFrame:
    """(feature, bin, n_e, n_a) -> (feature, psi)."""
    sides = counts.groupBy("feature", "bin").agg(F.sum("n_e").alias("expected"), F.sum("n_a").alias("actual"))
    return _psi_from_counts(sides.unpivot(["feature", "bin"], ["expected", "actual"], "side", "cnt"))


def psi_categorical(long_text: DataFrame) -> DataFrame:
    """D3: the text value is the bin."""
    return _psi_of_bins(_counts_of(long_text).withColumnRenamed("value", "bin"))


def ks_statistic(long_num: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Max |F_expected - F_actual| over the pooled values (nulls dropped)."""
    return _ks_of_counts(_counts_of(long_num), long_num.select("feature", "value"), n_buckets)


def _ks_of_counts(counts: DataFrame, bounds_from: DataFrame, n_buckets: int | None = None) -> DataFrame:
    pre = prefix_aggregate(counts, ["value"], {"cum_e": ("sum", "n_e"), "cum_a": ("sum", "n_a")}, ["feature"],
                           inclusive=True, n_buckets=n_buckets, bounds_from=bounds_from,
                           with_totals={"tot_e": ("sum", "n_e"), "tot_a": ("sum", "n_a")})
    return pre.groupBy("feature").agg(
        F.max(F.abs(F.col("cum_e") / F.col("tot_e") - F.col("cum_a") / F.col("tot_a"))).alias("score"),
        F.max("tot_e").alias("n_expected"), F.max("tot_a").alias("n_actual"))


def severity(score_col: str = "score"):
    """Low / moderate / high / severe."""
    s = F.col(score_col)
    expr = None
    for bound, label in SEVERITY_BANDS:
        expr = F.when(s < bound, label) if expr is None else expr.when(s < bound, label)
    return expr.otherwise(SEVERITY_TOP)


def value_counts(expected: DataFrame, actual: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, text, n_e, n_a) of all columns of both tables, nulls dropped: one reduction,
    each table read once.  Numeric columns fill ``value``, all others ``text``."""
    missing = [c for c in cols if c not in actual.columns]
    if missing:
        raise ValueError(f"columns missing from the actual table: {missing}")
    num = set(numeric_columns(expected, cols))

    def cells(df: DataFrame, is_expected: bool) -> DataFrame:
        def number(c):
            whole = F.col(f"`{c}`").cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(f"`{c}`")
            return whole.cast("double") if c in num else F.lit(None).cast("double")

        each = [F.struct(F.lit(c).alias("feature"), number(c).alias("value"),
                         (F.lit(None) if c in num else F.col(f"`{c}`")).cast("string").alias("text")) for c in cols]
        return df.select(F.lit(is_expected).alias("e"), F.explode(F.array(*each)).alias("cell")).select("e", "cell.*")

    both = cells(expected, True).unionByName(cells(actual, False))
    return both.where("value IS NOT NULL OR text IS NOT NULL").groupBy("feature", "value", "text").agg(
        F.count_if("e").alias("n_e"), F.count_if(~F.col("e")).alias("n_a"))


def drift_report(expected: DataFrame, actual: DataFrame, cols: list[str] | None = None,
                 exclude: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """D5 + D1 + D6: one row per feature (feature, method, score, severity).

    The entity key should be passed in ``exclude`` (it is not a feature).  Value counts of all
    columns are reduced once and written; the exact distinct counts that choose the method, KS and
    PSI all come from them.
    """
    cols = [c for c in (cols or expected.columns) if c not in set(exclude)]
    counts = written(value_counts(expected, actual, cols), "drift-counts")
    num = numeric_columns(expected, cols)
    distinct = {r["feature"]: r["n"] for r in counts.where("n_e > 0 AND value IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")).collect()}    # one row per column
    ks_cols = [c for c in num if distinct.get(c, 0) >= KS_MIN_DISTINCT]
    psi_cols = [c for c in num if c not in ks_cols]
    text_cols = [c for c in cols if c not in set(num)]
    parts = []
    if ks_cols:
        numbers = counts.where(F.col("feature").isin(ks_cols)).select("feature", "value", "n_e", "n_a")
        parts.append(_ks_of_counts(numbers, numbers.select("feature", "value"), n_buckets).withColumn("method", F.lit("ks")))
    if psi_cols:
        parts.append(_psi_of_numbers(counts.where(F.col("feature").isin(psi_cols)).drop("text")).withColumn("method", F.lit("psi")))
    if text_cols:
        bins = counts.where(F.col("feature").isin(text_cols)).select("feature", F.col("text").alias("bin"), "n_e", "n_a")
        parts.append(_psi_of_bins(bins).withColumn("method", F.lit("psi")))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("feature", "method", "score", severity().alias("severity"),
                      F.col("n_expected").cast("long"), F.col("n_actual").cast("long"))


def validated(report: DataFrame) -> DataFrame:
    """Q16 inside the plan: the query fails at execution when a score is out of
    range, without running the report a second time."""
    bad = (((F.col("method") == "ks") & ((F.col("score") < 0) | (F.col("score") > 1)))
           | ((F.col("method") == "psi") & ((F.col("score") < 0) | F.isnan("score")
                                             | (F.abs("score") == float("inf"))))
           | F.col("score").isNull() | (F.col("n_expected") == 0) | (F.col("n_actual") == 0))
    msg = F.concat(F.lit("invalid drift value for feature "), F.col("feature"))
    return report.withColumn("score", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(msg))
                             .otherwise(F.col("score")).cast("double"))


def check_drift_values(report: DataFrame) -> None:
    """Q16: KS within [0, 1]; PSI non-negative and finite; a side with no values is an error."""
    bad = report.where(
        ((F.col("method") == "ks") & ((F.col("score") < 0) | (F.col("score") > 1)))
        | ((F.col("method") == "psi") & ((F.col("score") < 0) | F.isnan("score")
                                          | (F.abs("score") == float("inf"))))
        | F.col("score").isNull() | (F.col("n_expected") == 0) | (F.col("n_actual") == 0)).limit(5).collect()
    if bad:
        raise ValueError(f"invalid drift values: {[r.asDict() for r in bad]}")


def performance_assessment(current: DataFrame, expected: DataFrame, directions: DataFrame) -> DataFrame:
    """Per metric, maximize -> degradation when current < expected;
    minimize -> when current > expected; equal is acceptable.

    current (metric, current), expected (metric, expected), directions (metric, direction).
    A metric without a value on either side or without a known direction fails the query.
    """
    j = current.join(expected, "metric", "full_outer").join(directions, "metric", "left")
    fail = lambda why: F.raise_error(F.concat(F.lit(why + " for metric "), F.col("metric"))).cast("string")
    status = (F.when(F.col("current").isNull() | F.col("expected").isNull(), fail("no value"))
              .when((F.col("direction") == "maximize") & (F.col("current") < F.col("expected")), "degradation")
              .when((F.col("direction") == "minimize") & (F.col("current") > F.col("expected")), "degradation")
              .when(F.col("direction").isin("maximize", "minimize"), "acceptable")
              .otherwise(fail("no known direction")))
    return j.select("metric", "direction", "current", "expected", status.alias("status"))


def compare_stages(production: DataFrame, staging: DataFrame) -> DataFrame:
    """Shared metrics only; signed difference in the good direction.

    Inputs: (metric, value, direction).  Differing directions are flagged as
    ``direction_mismatch`` (``assert_stage_comparison`` raises on them).
    """
    p = production.select("metric", F.col("value").alias("production"), F.col("direction").alias("_pd"))
    s = staging.select("metric", F.col("value").alias("staging"), F.col("direction").alias("_sd"))
    j = p.join(s, "metric", "inner")
    diff = F.when(F.col("_pd") == "maximize", F.col("staging") - F.col("production")) \
        .when(F.col("_pd") == "minimize", F.col("production") - F.col("staging"))
    status = (F.when(F.col("_pd") != F.col("_sd"), "direction_mismatch")
              .when(diff > 0, "improvement").when(diff < 0, "degradation")
              .when(diff == 0, "no_change").otherwise("invalid_direction"))
    return j.select("metric", F.col("_pd").alias("direction"), "production", "staging",
                    diff.alias("difference"), status.alias("status"))


def validated_stages(cmp: DataFrame) -> DataFrame:
    """D9 contract inside the plan: differing directions fail the query."""
    bad = F.col("status").isin("direction_mismatch", "invalid_direction")
    return cmp.withColumn("status", F.when(bad, F.raise_error(F.concat(F.lit("cannot compare metric "),
                                                                      F.col("metric")))).otherwise(F.col("status")))


def assert_stage_comparison(cmp: DataFrame) -> None:
    bad = cmp.where(F.col("status").isin("direction_mismatch", "invalid_direction")).limit(1).collect()
    if bad:
        raise ValueError(f"cannot compare stages: {bad[0].asDict()}")
