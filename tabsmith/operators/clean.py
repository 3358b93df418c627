"""Cleaning: names, schema, value rules, de-duplication.

The whole interim step is one lazy plan -- a projection, one filter and a
``dropDuplicates`` -- plus one aggregate for the rejection report.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUND_OPS = ("gt", "gte", "lt", "lte")
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class NameRules:
    lower: bool = True
    strip: bool = True
    spaces_to_underscore: bool = True
    dashes_to_underscore: bool = True


@dataclass(frozen=True)
class ValueRule:
    """One value rule; ``op`` in gt/gte/lt/lte or ``in`` (``value`` is then a list)."""
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class SchemaSpec:
    columns: tuple  # ((name, spark type string), ...) in output order
    datetime_format: str | None = None
    int_nulls: str = "drop"  # or "widen"
    extras: dict = field(default_factory=dict)


def normalize_name(name: str, rules: NameRules = NameRules()) -> str:
    """P1 for one name, in the fixed order lower -> strip -> space -> dash."""
    if rules.lower:
        name = name.lower()
    if rules.strip:
        name = name.strip()
    if rules.spaces_to_underscore:
        name = name.replace(" ", "_")
    if rules.dashes_to_underscore:
        name = name.replace("-", "_")
    return name


def normalize_columns(df: DataFrame, rules: NameRules = NameRules()) -> DataFrame:
    """Rename all columns (metadata only)."""
    return df.toDF(*[normalize_name(c, rules) for c in df.columns])


def enforce_schema(df: DataFrame, spec: SchemaSpec) -> DataFrame:
    """Required columns must exist, extras are dropped, every column is cast.

    Casts run under ANSI rules, so an out-of-range value raises instead of
    wrapping the way pandas narrowing does.  Integer columns with nulls are
    either dropped row-wise or widened to double (P3).
    """
    names = [n for n, _ in spec.columns]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    exprs = []
    int_cols = []
    for n, t in spec.columns:
        c = F.col(f"`{n}`")
        dtype = T._parse_datatype_string(t) if isinstance(t, str) else t
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and spec.datetime_format:
            exprs.append(F.to_timestamp(c.cast("string"), spec.datetime_format).cast(dtype).alias(n))
        elif isinstance(dtype, _INTS) and spec.int_nulls == "widen":
            exprs.append(c.cast("double").alias(n))
        else:
            exprs.append(c.cast(dtype).alias(n))
        if isinstance(dtype, _INTS):
            int_cols.append(n)
    out = df.select(*exprs)
    if spec.int_nulls == "drop" and int_cols:
        # explicit IS NOT NULL (rather than dropna) so Parquet receives the filter
        keep = F.lit(True)
        for c in int_cols:
            keep = keep & F.col(f"`{c}`").isNotNull()
        out = out.where(keep)
    return out


def strip_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Trim string columns (before any value check)."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = strings if cols is None else set(cols) & strings
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) if c in targets else F.col(f"`{c}`")
                       for c in df.columns])


def remove_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: drop columns; absent ones are an error."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"cannot remove absent columns: {absent}")
    return df.drop(*cols)


def rule_keeps(df: DataFrame, rule: ValueRule) -> Column:
    """A row passes when the rule holds, or the value is null, NaN or ''."""
    c = F.col(f"`{rule.column}`")
    if isinstance(df.schema[rule.column].dataType, (T.FloatType, T.DoubleType)):
        c = F.nanvl(c, F.lit(None))
    if rule.op == "gte":
        ok = c >= F.lit(rule.value)
    elif rule.op == "gt":
        ok = c > F.lit(rule.value)
    elif rule.op == "lte":
        ok = c <= F.lit(rule.value)
    elif rule.op == "lt":
        ok = c < F.lit(rule.value)
    elif rule.op == "in":
        vals = [v for v in rule.value if v is not None]
        ok = c.isin(vals) if vals else F.lit(False)
    else:
        raise ValueError(f"unknown rule operator {rule.op!r}")
    keep = ok | c.isNull()  # never null: ok is null only when c is null
    if isinstance(df.schema[rule.column].dataType, T.StringType):
        keep = keep | (c == F.lit(""))
    return keep


def merge_rules(configured: list[ValueRule], defaults: list[ValueRule]) -> list[ValueRule]:
    """policy rules fill in columns without a configured rule; configured
    bounds may only be tighter than the policy's."""
    by_key = {(r.column, r.op): r for r in configured}
    for d in defaults:
        c = by_key.get((d.column, d.op))
        if c is None:
            by_key[(d.column, d.op)] = d
            continue
        looser = ((d.op in ("gte", "gt") and c.value < d.value)
                  or (d.op in ("lte", "lt") and c.value > d.value)
                  or (d.op == "in" and not set(c.value) <= set(d.value)))
        if looser:
            raise ValueError(f"rule on {c.column} ({c.op} {c.value}) is looser than the policy ({d.value})")
    return list(by_key.values())


def apply_rules(df: DataFrame, rules: list[ValueRule]) -> DataFrame:
    """All rules as one filter (Catalyst pushes the null-free parts to the scan)."""
    cond = F.lit(True)
    for r in rules:
        cond = cond & rule_keeps(df, r)
    return df.where(cond)


def rejection_report(df: DataFrame, rules: list[ValueRule]) -> DataFrame:
    """Rows each rule would reject, from one aggregate pass, in long form."""
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, column string, rejected bigint")
    aggs = [F.count_if(~rule_keeps(df, r)).alias(f"r{i}") for i, r in enumerate(rules)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{r.op}', '{r.column}', r{i}" for i, r in enumerate(rules))
    return wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, column, rejected)")


def deduplicate(df: DataFrame) -> DataFrame:
    """Drop repeated rows (all columns, nulls equal).  Partial aggregation
    collapses duplicates map-side, so a hot repeated row never reaches one
    reducer in bulk."""
    return df.dropDuplicates()


def clean_table(df: DataFrame, spec: SchemaSpec, rules: list[ValueRule],
                names: NameRules = NameRules(), drop_duplicates: bool = True) -> DataFrame:
    """A2 as one plan: P1 -> P2/P3 -> P4 -> F1-F3 -> U1."""
    out = normalize_columns(df, names)
    out = enforce_schema(out, spec)
    out = strip_strings(out)
    out = apply_rules(out, rules)
    return deduplicate(out) if drop_duplicates else out
