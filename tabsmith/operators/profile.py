"""Table profiles and exploration aggregates.

Per-column work is one multi-expression ``agg`` or one ``unpivot`` followed
by a grouped aggregate -- never a Python loop of jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators.prefix import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
          T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def value_distribution(df: DataFrame, col: str, normalize: bool = True, dropna: bool = True) -> DataFrame:
    """A5: counts (and shares) per value; nulls excluded unless ``dropna=False``."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    counts = d.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts
    total = d.count()  # one scalar: shares stay a map-side projection
    return counts.select("value", "count", (F.col("count") / F.lit(float(total))).alias("share"))


def null_report(df: DataFrame) -> DataFrame:
    """Null count per column (one aggregate, unpivoted)."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "n_null").select("column", F.col("n_null").cast("long"))


def any_null_share(df: DataFrame, exclude: list[str] | tuple = ()) -> DataFrame:
    """Share of rows with at least one null outside ``exclude``."""
    cols = [c for c in df.columns if c not in set(exclude)]
    anyn = F.lit(False)
    for c in cols:
        anyn = anyn | F.col(f"`{c}`").isNull()
    return df.agg(F.avg(anyn.cast("double")).alias("any_null_share"))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per numeric column.

    Quartiles are exact (linear interpolation) and computed for all columns at
    once on the unpivoted table.
    """
    cols = cols or numeric_cols(df)
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, "column", "value")
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], names=["p25", "p50", "p75"])
    return stats.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quantile_pair(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Exact linear-interpolated quantiles per numeric column."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    return exact_quantiles(long, "value", [lo, hi], ["column"], names=["q_low", "q_high"])


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median and mean per column."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    med = exact_quantiles(long, "value", [0.5], ["column"], names=["median"])
    return long.groupBy("column").agg(F.avg("value").alias("mean")).join(med, "column", "left")


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A10: pairwise-complete Pearson correlation of every pair in one aggregate."""
    cols = cols or numeric_cols(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"p{i}")
                    for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', p{i}" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, corr)")


def category_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def rare_categories(df: DataFrame, col: str, min_count: int = 10) -> DataFrame:
    """Number of categories seen fewer than ``min_count`` times."""
    return category_counts(df, col).agg(F.count_if(F.col("count") < min_count).alias("n_rare"),
                                        F.count(F.lit(1)).alias("n_categories"))


def least_frequent(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The k least frequent values (ties by value) -- a bottom-k report."""
    return category_counts(df, col).orderBy(F.col("count").asc(), F.col("value").asc()).limit(k)


def most_frequent(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent values (ties by value) -- a top-k report."""
    return category_counts(df, col).orderBy(F.col("count").desc(), F.col("value").asc()).limit(k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows repeating an earlier identical row (nulls equal), via one
    grouped count with map-side combine."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c")) \
        .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def logical_bytes_expr(df: DataFrame) -> Column:
    """A13 re-aimed: logical size = string bytes + fixed width x non-null count."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)))
        elif isinstance(f.dataType, T.DecimalType):
            parts.append(F.count(c) * 16)
        else:
            parts.append(F.count(c) * _WIDTH.get(type(f.dataType), 8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")


def footprint(df: DataFrame) -> DataFrame:
    return df.agg(logical_bytes_expr(df).alias("logical_bytes"),
                  F.count(F.lit(1)).alias("n_rows"))


def memory_change(old_bytes: float, new_bytes: float) -> dict:
    """Old, new, change, change % (0 when old is 0) in MB."""
    mb_old, mb_new = old_bytes / 1024 ** 2, new_bytes / 1024 ** 2
    change = mb_new - mb_old
    return {"old_mb": mb_old, "new_mb": mb_new, "change_mb": change,
            "change_pct": (change / mb_old * 100.0) if mb_old else 0.0}


def class_distribution(df: DataFrame, y: str, group_cols=("split",)) -> DataFrame:
    """A1: normalised class counts per group."""
    g = list(group_cols)
    c = df.groupBy(*g, F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*g)))
