"""Targets and target transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFORMS = ("log1p", "sqrt", "boxcox")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def differs_flag(a, b) -> Column:
    """1 when the values differ (two nulls count as equal)."""
    return (~_col(a).eqNullSafe(_col(b))).cast("int")


def equals_flag(a, value) -> Column:
    """1 when ``a == value``; null -> 0."""
    return F.coalesce(_col(a) == F.lit(value), F.lit(False)).cast("int")


def forward(c, method: str, lam: float | None = None) -> Column:
    """X8 expression."""
    x = _col(c).cast("double")
    if method == "log1p":
        return F.log1p(x)
    if method == "sqrt":
        return F.sqrt(x)
    if method == "boxcox":
        if lam is None:
            raise ValueError("boxcox needs lambda")
        return F.log(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1) / F.lit(float(lam))
    raise ValueError(f"unknown transform {method!r}")


def inverse(c, method: str, lam: float | None = None) -> Column:
    """X9 expression."""
    x = _col(c).cast("double")
    if method == "log1p":
        return F.expm1(x)
    if method == "sqrt":
        return x * x
    if method == "boxcox":
        if lam is None:
            raise ValueError("boxcox needs lambda")
        return F.exp(x) if lam == 0 else F.pow(F.lit(float(lam)) * x + 1, F.lit(1.0 / lam))
    raise ValueError(f"unknown transform {method!r}")


def domain_violations(c, method: str) -> Column:
    """Count of rows outside the transform's domain (aggregate expression)."""
    x = _col(c).cast("double")
    if method == "log1p":
        bad = x.isNull() | (x < -1)
    elif method == "sqrt":
        bad = x < 0
    elif method == "boxcox":
        bad = x <= 0
    else:
        raise ValueError(method)
    return F.count_if(F.coalesce(bad, F.lit(False)))


def transform_target(df: DataFrame, target: str, method: str, lam: float | None = None,
                     out: str | None = None, check: bool = True) -> DataFrame:
    """X8 with the reference's domain rules: log1p only warns, sqrt and boxcox raise."""
    if method == "boxcox" and lam is None:
        raise ValueError("boxcox needs lambda")
    if check and method in ("sqrt", "boxcox"):
        bad = df.agg(domain_violations(target, method).alias("n")).first()["n"]
        if bad:
            raise ValueError(f"{method}: {bad} values of {target} outside the domain")
    return df.withColumn(out or target, forward(target, method, lam))


def inverse_transform_target(df: DataFrame, col: str, method: str, lam: float | None = None,
                             out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, inverse(col, method, lam))


# ---- target registry (R3) ----------------------------------------------------

def pass_through(name: str, dtype: str) -> Callable[[DataFrame], Column]:
    """The column itself as the target, in the target's type; the table must have it."""
    def build(df: DataFrame) -> Column:
        if name not in df.columns:
            raise ValueError(f"target {name!r} needs a column of that name")
        return F.col(f"`{name}`").cast(dtype)
    return build


def from_columns(needed: tuple[str, ...], make: Callable[..., Column]) -> Callable[[DataFrame], Column]:
    """A target computed from columns, all of which the table must have."""
    def build(df: DataFrame) -> Column:
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise ValueError(f"target needs columns {missing}")
        return make(*needed)
    return build


#: (name, version) -> builder.  Names, versions and input columns are fixed values.
TARGETS: dict[tuple[str, str], Callable[[DataFrame], Column]] = {
    ("adr", "v1"): pass_through("adr", "double"),
    ("lead_time", "v1"): pass_through("lead_time", "int"),
    ("is_repeated_guest", "v1"): pass_through("is_repeated_guest", "int"),
    ("total_of_special_requests", "v1"): pass_through("total_of_special_requests", "int"),
    ("is_canceled", "v1"): pass_through("is_canceled", "int"),
    ("room_upgrade", "v1"): from_columns(("reserved_room_type", "assigned_room_type"), differs_flag),
    ("no_show", "v1"): from_columns(("reservation_status",), lambda c: equals_flag(c, "No-Show")),
}


def register_target(name: str, version: str, build: Callable[[DataFrame], Column]) -> None:
    """Add a target; a version that exists already cannot change."""
    if (name, version) in TARGETS:
        raise KeyError(f"target {name!r} {version!r} is registered already")
    TARGETS[(name, version)] = build


def build_target(df: DataFrame, name: str, version: str, entity_key: str) -> DataFrame:
    """``entity_key`` and the target, under its name; an unknown (name, version) raises."""
    if (name, version) not in TARGETS:
        raise KeyError(f"no target {name!r} {version!r}; known: {sorted(TARGETS)}")
    if entity_key not in df.columns:
        raise ValueError(f"entity key {entity_key!r} missing")
    return df.select(F.col(f"`{entity_key}`"), TARGETS[(name, version)](df).alias(name))
