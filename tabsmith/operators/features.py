"""Feature operators and their registry."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import scalar
from tabsmith.operators.prefix import prefix_aggregate
from tabsmith.operators.user_aggregate import UserAggregate, running_user_aggregate

PIT_FUNCS = ("mean", "sum", "min", "max", "count", "std")


def pit_feature(df: DataFrame, group_cols: list[str], order_col: str, agg_col: str,
                func: str, name: str, tiebreak: list[str] | tuple = (),
                n_buckets: int | None = None) -> DataFrame:
    """Aggregate over *earlier* rows of the group (ordered by ``order_col``
    then ``tiebreak``); rows without history get the global mean of ``agg_col``.

    Runs on the bucketed prefix, so a hot group is split across tasks.
    """
    if isinstance(func, UserAggregate):
        rows = running_user_aggregate(df, group_cols, [order_col, *tiebreak], agg_col, func, n_buckets)
        mean = df.agg(F.avg(F.col(agg_col).cast("double")).alias("m")).first()["m"]
        return rows.withColumn(name, F.coalesce(F.when(F.col("_seen"), F.col("_result")), F.lit(mean).cast("double"))).drop("_result", "_seen")
    if callable(func):
        return _pit_udf(df, group_cols, order_col, agg_col, func, name, tiebreak)
    if func not in PIT_FUNCS:
        raise ValueError(f"unsupported PIT aggregate {func!r}; use one of {PIT_FUNCS}")
    # decimal inputs keep exact sums, so the result does not depend on how
    # rows are spread over tasks; everything else is summed as double
    exact = isinstance(df.schema[agg_col].dataType, T.DecimalType)
    v = F.col(agg_col) if exact else F.col(agg_col).cast("double")
    aggs = {"_pit_hist": ("count", F.lit(1)), "_pit_n": ("count", v)}
    if func in ("mean", "sum"):
        aggs["_pit_s"] = ("sum", v)
    if func == "std":
        aggs["_pit_m"] = ("moments", v.cast("double"))
    if func in ("min", "max"):
        aggs["_pit_m"] = (func, v)
    order = [order_col, *tiebreak]
    pre = prefix_aggregate(df, order, aggs, group_cols, inclusive=False, n_buckets=n_buckets)
    g = df.agg(F.sum(v).alias("s"), F.count(v).alias("n")).first()
    global_mean = float(g["s"]) / g["n"] if g["n"] else None
    n = F.col("_pit_n")
    s = F.col("_pit_s").cast("double") if func in ("mean", "sum") else None
    if func == "mean":
        val = s / n
    elif func == "sum":
        val = F.when(n > 0, s)
    elif func == "count":
        val = n.cast("double")
    elif func == "std":
        val = F.when(n > 1, F.sqrt(F.col("_pit_m")["m2"] / (n - 1)))
    else:
        val = F.col("_pit_m").cast("double")
    filled = F.when(F.col("_pit_hist") == 0, F.lit(global_mean)).otherwise(
        F.coalesce(val, F.lit(global_mean)))
    return pre.withColumn(name, filled.cast("double")).drop(*aggs)


def _pit_udf(df: DataFrame, group_cols, order_col, agg_col, udf, name, tiebreak) -> DataFrame:
    """R5 escape hatch: any grouped-aggregate ``pandas_udf`` over the earlier
    rows of the group (Arrow batches, not row-at-a-time).  This path uses a
    plain per-group window; a ``UserAggregate`` does the same split across tasks."""
    w = Window.partitionBy(*group_cols).orderBy(order_col, *tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    global_mean = df.agg(F.avg(F.col(agg_col).cast("double")).alias("m")).first()["m"]
    hist = F.count(F.lit(1)).over(w)
    val = udf(F.col(agg_col).cast("double")).over(w)
    return df.withColumn(name, F.when(hist == 0, F.lit(global_mean))
                         .otherwise(F.coalesce(val.cast("double"), F.lit(global_mean))))


def fill_forward_backward(df: DataFrame, col: str, order_cols: list[str], group_cols=(),
                          out: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """Forward fill then backward fill in ``order_cols`` order (global when
    ``group_cols`` is empty) without a single-partition window."""
    pre = prefix_aggregate(df, order_cols, {"_ff": ("last", F.col(col))}, group_cols,
                           inclusive=True, n_buckets=n_buckets,
                           with_totals={"_first": ("first", F.col(col))})
    return pre.withColumn(out or col, F.coalesce(F.col("_ff"), F.col("_first").getField("v"))) \
        .drop("_ff", "_first")


# ---- named operators (R1) -------------------------------------------------

@dataclass(frozen=True)
class FeatureOperator:
    name: str
    inputs: tuple
    outputs: tuple
    fn: Callable[[DataFrame], DataFrame]


def _total_stay(df):
    return df.withColumn("total_stay", scalar.total_stay("stays_in_weekend_nights", "stays_in_week_nights"))


def _adr_per_person(df):
    return df.withColumn("adr_per_person", scalar.price_per_person("adr", "adults", "children", "babies"))


def _arrival_season(df):
    return df.withColumn("arrival_season", scalar.season_of_week("arrival_date_week_number"))


def _arrival_date(df):
    return df.withColumn("arrival_date", scalar.arrival_date(
        "arrival_date_year", "arrival_date_month", "arrival_date_day_of_month"))


REGISTRY: dict[str, FeatureOperator] = {
    "TotalStay": FeatureOperator("TotalStay", ("stays_in_weekend_nights", "stays_in_week_nights"),
                                 ("total_stay",), _total_stay),
    "AdrPerPerson": FeatureOperator("AdrPerPerson", ("adr", "adults", "children", "babies"),
                                    ("adr_per_person",), _adr_per_person),
    "ArrivalSeason": FeatureOperator("ArrivalSeason", ("arrival_date_week_number",),
                                     ("arrival_season",), _arrival_season),
    "ArrivalDate": FeatureOperator("ArrivalDate", ("arrival_date_year", "arrival_date_month",
                                                   "arrival_date_day_of_month"),
                                   ("arrival_date",), _arrival_date),
}


def apply_operators(df: DataFrame, names: list[str],
                    registry: dict[str, FeatureOperator] | None = None) -> DataFrame:
    """R2 + Q9: apply named operators in order; inputs checked, outputs verified."""
    registry = REGISTRY if registry is None else registry
    out = df
    for n in names:
        if n not in registry:
            raise KeyError(f"unknown feature operator {n!r}")
        op = registry[n]
        missing = [c for c in op.inputs if c not in out.columns]
        if missing:
            raise ValueError(f"{n} needs columns {missing}")
        out = op.fn(out)
        absent = [c for c in op.outputs if c not in out.columns]
        if absent:
            raise ValueError(f"{n} did not produce {absent}")
    return out


def prepare_features(df: DataFrame, entity_key: str, cols: list[str]) -> DataFrame:
    """Entity key first, then the configured columns; missing -> error."""
    missing = [c for c in [entity_key, *cols] if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(entity_key, *[c for c in cols if c != entity_key])


def select_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ordered projection, missing -> error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing selected features: {missing}")
    return df.select(*cols)


def fill_categorical_missing(df: DataFrame, cols: list[str], token: str = "missing") -> DataFrame:
    """Null -> ``missing``, cast to string; absent columns are ignored."""
    present = set(c for c in cols if c in df.columns)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(token)).alias(c)
                       if c in present else F.col(f"`{c}`") for c in df.columns])


CATEGORICAL_DTYPES = ("string",)


def pipeline_features(schema_table: DataFrame, segmentation_cols: list[str] | None = None,
                      include_segmentation: bool = False) -> list[str]:
    """P10: feature names from a schema table (metadata-sized)."""
    rows = schema_table.select("feature").collect()
    feats = [r["feature"] for r in rows]
    if segmentation_cols and not include_segmentation:
        feats = [f for f in feats if f not in set(segmentation_cols)]
    return feats


def categorical_features(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """P10: categorical = string-typed (the schema is the source of truth)."""
    cols = cols or df.columns
    return [f.name for f in df.schema.fields
            if f.name in set(cols) and isinstance(f.dataType, (T.StringType, T.BooleanType))]


def compose(*fns: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(lambda acc, f: acc.transform(f), fns, df)
