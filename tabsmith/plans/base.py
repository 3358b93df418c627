"""Registration helpers shared by the plan modules."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def register(name: str, sql: str | None = None, covers: str = ""):
    """Register a plan under ``name`` with its oracle SQL (None -> rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate plan {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        COVERS[name] = covers
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def round_to(c, places: int = 6):
    """Round a double the way SQL engines do on binary values:
    ``round(x * 10^d) / 10^d`` (Spark's own ``round`` works on the shortest
    decimal text, which differs on values next to a tie)."""
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** places)
    return F.round(x.cast("double") * F.lit(scale), 0) / F.lit(scale)


def r6(c):
    """Round doubles to 6 places so both engines hash equal values."""
    return round_to(c, 6)


def sql_float(x: float) -> str:
    """A double literal both Spark SQL and DuckDB read as DOUBLE."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))
