"""Repair and scoring of generated rows against real rows.

Real-table statistics (ranges, quantiles, categories) are reduced to a few
values per column before they touch the generated rows; category lists and
top-N tables are size-checked before a broadcast, with a shuffle join beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import scalar
from tabsmith.operators.drift import ks_statistic, long_form
from tabsmith.operators.profile import numeric_cols, quantile_pair



def shift_dates_after(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``max(real) - min(synthetic) + 1 day`` to every datetime column.

    Two one-row aggregates give one offset per column (driver holds one number
    per column); the shift itself is a projection.
    """
    r = real.agg(*[F.max(c).alias(c) for c in cols]).first().asDict()
    s = synth.agg(*[F.min(c).alias(c) for c in cols]).first().asDict()
    exprs = {}
    for c in cols:
        if r[c] is None or s[c] is None:
            continue
        delta = r[c] - s[c]
        if isinstance(synth.schema[c].dataType, T.DateType):
            exprs[c] = F.date_add(F.col(c), delta.days + 1)
        else:
            micros = (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds + 86400 * 1_000_000
            exprs[c] = F.col(c) + F.expr(f"make_dt_interval(0, 0, 0, {micros / 1e6:.6f})")
    return synth.withColumns(exprs)


def shift_split_dates_after(real: DataFrame, synth: DataFrame, year: str, month: str, day: str,
                            week: str | None = None) -> DataFrame:
    """Y2: build the date from (year, month name, day), shift it as Y1, rebuild the parts."""
    def with_date(df):
        return df.withColumn("_d", scalar.arrival_date(year, month, day))
    shifted = shift_dates_after(with_date(real), with_date(synth), ["_d"])
    parts = scalar.date_parts(F.col("_d"))
    out = shifted.withColumns({year: parts["year"], month: parts["month"], day: parts["day"]})
    if week:
        out = out.withColumn(week, parts["week"])
    return out.drop("_d")


def _holding(dtype: T.DataType, *values) -> T.DataType:
    """The type, or double where it is an integer type and a value has a fraction."""
    fraction = any(v is not None and float(v) != int(v) for v in values)
    return T.DoubleType() if fraction and isinstance(dtype, T.IntegralType) else dtype


def clip_to_real_range(real: DataFrame, synth: DataFrame, cols: list[str] | None = None,
                       lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip numeric columns to the real 1 %-99 % range (exact quantiles).

    An integer column with a fractional bound becomes double."""
    cols = cols or [c for c in numeric_cols(real) if c in synth.columns]
    bounds = {r["column"]: (r["q_low"], r["q_high"]) for r in quantile_pair(real, cols, lo, hi).collect()}
    return synth.withColumns({c: scalar.clip(c, *bounds[c]).cast(_holding(synth.schema[c].dataType, *bounds[c]))
                              for c in cols if c in bounds})


def domain_repair(df: DataFrame, lower_bounds: dict[str, float],
                  stay_cols: tuple[str, str] | None = None) -> DataFrame:
    """Per-column lower bounds; a zero-night stay becomes one week night."""
    out = df.withColumns({c: scalar.clip(c, lo=v) for c, v in lower_bounds.items()})
    if stay_cols:
        we, wk = stay_cols
        out = out.withColumn(wk, F.when((F.col(we) == 0) & (F.col(wk) == 0), F.lit(1)).otherwise(F.col(wk)))
    return out


def align_categories(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Values outside the real categories become null.

    One distinct-value table per column; its measured size decides how it is joined.
    """
    out = synth
    for c in cols:
        cats = real.where(F.col(c).isNotNull()).select(F.col(c).alias("_cat")).distinct()
        cats = cats.withColumn("_ok", F.lit(True))
        j = out.join(cats, F.col(c) == F.col("_cat"), "left")
        out = j.withColumn(c, F.when(F.col("_ok"), F.col(c))).drop("_cat", "_ok")
    return out


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Y5 casts: unparsable -> null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def impute(df: DataFrame, numeric: list[str], text: list[str], text_token: str = "missing") -> DataFrame:
    """Numeric -> exact median, text -> token; an integer column with a
    fractional median becomes double.  A column without values stays null."""
    from tabsmith.operators.profile import column_medians

    med = {r["column"]: r["median"] for r in column_medians(df, numeric).collect()} if numeric else {}
    med = {c: float(med[c]) for c in numeric if med.get(c) is not None}
    filled = df.withColumns({c: F.col(c).cast(_holding(df.schema[c].dataType, m)) for c, m in med.items()}).fillna(med)
    return filled.fillna({c: text_token for c in text})


def lump_top_n(df: DataFrame, col: str, n: int = 20, other: str = "Other", out: str | None = None) -> DataFrame:
    """Keep the n most frequent values (ties by value), others -> ``Other``.

    The top-n table has n rows -- a proven bound -- so it is broadcast.
    """
    top = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_top")).agg(F.count(F.lit(1)).alias("_n")) \
        .orderBy(F.col("_n").desc(), F.col("_top").asc()).limit(n).select("_top")
    j = df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left")
    return j.withColumn(out or col, F.when(F.col("_top").isNotNull(), F.col(col)).otherwise(F.lit(other))) \
        .drop("_top")


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Y8."""
    return df.fillna(0, subset=cols)


def union_old(old: DataFrame, new: DataFrame) -> DataFrame:
    """By column name, missing columns filled with null."""
    return old.unionByName(new, allowMissingColumns=True)


def similarity_score(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Y9 re-aimed: per column 1 - KS (numeric) or 1 - total variation distance
    (categorical), then the mean over columns."""
    parts = []
    if numeric:
        ks = ks_statistic(long_form(real, synth, numeric, False))
        parts.append(ks.select("feature", (1 - F.col("score")).alias("similarity")))
    if categorical:
        lt = long_form(real, synth, categorical, True)
        cnt = lt.groupBy("feature", "value").agg(F.count_if(F.col("side") == "expected").alias("n_e"),
                                                 F.count_if(F.col("side") == "actual").alias("n_a"))
        tot = cnt.groupBy("feature").agg(F.sum("n_e").alias("tot_e"), F.sum("n_a").alias("tot_a"))
        # one row per feature (a schema-sized table): broadcast is bounded
        tv = cnt.join(F.broadcast(tot), "feature").groupBy("feature").agg(
            (1 - 0.5 * F.sum(F.abs(F.col("n_e") / F.col("tot_e") - F.col("n_a") / F.col("tot_a"))))
            .alias("similarity"))
        parts.append(tv)
    return reduce(lambda a, b: a.unionByName(b), parts)


def quality_gate(scores: DataFrame, min_score: float = 0.7) -> DataFrame:
    """Y9 gate on the mean column similarity."""
    return scores.agg(F.avg("similarity").alias("score")).withColumn("passed", F.col("score") >= min_score)


def pair_trends(real: DataFrame, synth: DataFrame, num_cols: list[str], cat_cols: list[str], bins: int = 10) -> DataFrame:
    """How well pairs of columns move together: ``column_a, column_b, kind, similarity``.

    Two numeric columns: 1 - |difference of correlations| / 2.  Otherwise 1 - half the absolute
    difference of the shares of value pairs, a numeric column in ``bins`` equal parts of its real
    range.  All value pairs are counted in one reduction, all correlations in another; rows where
    either value is null are left out."""
    both = real.select(F.lit("r").alias("_side"), *num_cols, *cat_cols).unionByName(
        synth.select(F.lit("s").alias("_side"), *num_cols, *cat_cols))
    parts = []
    pairs = [(a, b) for i, a in enumerate(num_cols) for b in num_cols[i + 1:]]
    if pairs:
        corr = both.groupBy("_side").agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{k}")
                                           for k, (a, b) in enumerate(pairs)])
        wide = corr.agg(*[(1 - F.abs(F.max(F.when(F.col("_side") == "r", F.col(f"p{k}"))) -
                                     F.max(F.when(F.col("_side") == "s", F.col(f"p{k}")))) / 2).alias(f"p{k}") for k in range(len(pairs))])
        stacked = ", ".join(f"'{a}', '{b}', p{k}" for k, (a, b) in enumerate(pairs))
        parts.append(wide.selectExpr(f"stack({len(pairs)}, {stacked}) AS (column_a, column_b, similarity)").withColumn("kind", F.lit("correlation")))
    mixed = [(a, b) for i, a in enumerate(cat_cols) for b in [*cat_cols[i + 1:], *num_cols]]
    if mixed:
        ranges = real.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in num_cols for n, f in (("lo", F.min), ("hi", F.max))]).first() \
            if num_cols else {}

        def binned(c: str):
            if c in cat_cols:
                return F.col(c).cast("string")
            lo, hi = ranges[f"lo_{c}"], ranges[f"hi_{c}"]
            if lo is None or hi == lo:
                return F.when(F.col(c).isNotNull(), F.lit("0"))
            part = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) * bins)
            return F.greatest(F.least(part, F.lit(bins - 1)), F.lit(0)).cast("string")

        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), binned(a).alias("a"), binned(b).alias("b")) for k, (a, b) in enumerate(mixed)]))
        counts = both.select("_side", each.alias("p")).where("p.a IS NOT NULL AND p.b IS NOT NULL").groupBy("p.k", "p.a", "p.b").agg(
            F.count_if(F.col("_side") == "r").alias("r"), F.count_if(F.col("_side") == "s").alias("s"))
        totals = counts.groupBy("k").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))     # one row per pair of columns
        far = counts.join(totals, "k").groupBy("k").agg(F.sum(F.abs(F.col("r") / F.col("tr") - F.col("s") / F.col("ts"))).alias("d"))
        names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in mixed])
        parts.append(far.select(names[F.col("k")]["a"].alias("column_a"), names[F.col("k")]["b"].alias("column_b"),
                                (1 - F.col("d") / 2).alias("similarity")).withColumn("kind", F.lit("contingency")))
    if not parts:
        raise ValueError("no pair of columns")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("column_a", "column_b", "kind", "similarity")


def synthetic_quality(shapes: DataFrame, trends: DataFrame) -> DataFrame:
    """``property, score``: mean column shape, mean pair trend, and ``overall``, the mean of both."""
    means = shapes.agg(F.avg("similarity").alias("score")).withColumn("property", F.lit("column_shapes")).unionByName(
        trends.agg(F.avg("similarity").alias("score")).withColumn("property", F.lit("column_pair_trends")))
    overall = means.agg(F.avg("score").alias("score")).withColumn("property", F.lit("overall"))
    return means.unionByName(overall).select("property", "score")
