"""Segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.predicates import filter_predicate, predicate


def check_segment_values(df: DataFrame, filters: list[tuple]) -> None:
    """each filter value must occur among rows passing the earlier filters
    (one aggregate for all filters)."""
    checks, earlier = [], F.lit(True)
    for i, (col, op, value) in enumerate(filters):
        if col not in df.columns:
            raise ValueError(f"segmentation column {col} not found")
        # like the reference: every configured value (for any operator) must occur
        values = value if isinstance(value, (list, tuple, set)) else [value]
        for j, v in enumerate(values):
            checks.append(F.max((earlier & predicate(col, "eq", v)).cast("int")).alias(f"c{i}_{j}"))
        earlier = earlier & predicate(col, op, value)
    if not checks:
        return
    row = df.agg(*checks).first().asDict()
    absent = [k for k, v in row.items() if not v]
    if absent:
        raise ValueError(f"segment values not present in the data: {absent}")


def apply_segmentation(df: DataFrame, filters: list[tuple], enabled: bool = True,
                       include_in_model: bool = False, check: bool = True) -> DataFrame:
    """conjunction of predicates in order; filter columns are dropped unless
    ``include_in_model``.  Catalyst merges the filters and pushes them down."""
    if not enabled or not filters:
        return df
    if check:
        check_segment_values(df, filters)
    out = df
    for col, op, value in filters:
        out = out.where(filter_predicate(col, op, value))
    if not include_in_model:
        out = out.drop(*{c for c, _, _ in filters})
    return out
