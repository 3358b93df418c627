"""Ordered prefix computations without a single-partition window.

A window with an ``orderBy`` but no ``partitionBy`` (or with a hot group key)
sends every row of the group to one task.  Cumulative statistics (running
aggregates, row numbers, forward fill, ROC/PR curves, KS, exact splits) are
instead computed over range buckets of the whole ``(group, ordering)`` tuple:

1. boundaries are tuples of the data themselves: a row count gives the rate of
   a sample of about ``SAMPLED_PER_BUCKET`` rows a bucket, and the first tuple
   of each n-th part of it becomes a boundary (fewer than ``n_buckets`` tuples
   reach the driver).  They are constants from then on, so recomputed
   tasks and branches agree;
2. a row's bucket is the number of boundaries at or below its tuple, found by
   binary search in Spark's own tuple order (nulls first, strings by bytes,
   decimals and doubles exactly).  A group that holds a third of the rows covers
   a third of the buckets; small groups lie whole inside one;
3. only groups that a boundary falls into -- fewer than ``n_buckets`` -- need
   anything from other buckets: their per-bucket partials are reduced with
   map-side combine, and an exclusive running combine gives each bucket's
   carry-in (at most two rows a boundary);
4. the data are shuffled once by ``(group, bucket)``, and a window inside adds
   the local running value to the carry-in.

Boundaries are sampled; results are exact, because equal tuples fall in one
bucket and buckets are contiguous in the ordering.
"""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.session import written

SAMPLED_PER_BUCKET = 100
_BUCKET = "_pfx_bucket"


def default_buckets(spark) -> int:
    """As many buckets as the cluster's shuffles have partitions."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        n = 200
    return max(16, n)


# ---- boundaries and buckets -------------------------------------------------

def _comparable(df: DataFrame, name: str) -> Column:
    """The column, times as whole microseconds and dates as days: same order, and exact in the driver."""
    dtype, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        day = F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000
        second = F.date_part(F.lit("SECOND"), c).cast("decimal(10,6)") * 1_000_000
        return day + (F.hour(c).cast("long") * 3600 + F.minute(c) * 60) * 1_000_000 + second.cast("long")
    return c


def sort_key(df: DataFrame, cols: list[str]) -> Column:
    """The ordering tuple as a struct; structs compare field by field, nulls first."""
    return F.struct(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(cols)])


@dataclass
class Bounds:
    """Boundary tuples in ascending order; ``key_type`` is the type of the tuple."""
    rows: list[Row]
    key_type: T.StructType

    def add_bucket(self, df: DataFrame, cols: list[str], name: str, descending: bool = False) -> DataFrame:
        """``df`` with the number of boundaries at or below its tuple ``cols``; counted from the end if ``descending``."""
        low, key = free_names(df, "_pfx_low", "_pfx_key")
        if not self.rows:
            return df.withColumn(name, F.lit(0))
        at = _as_constant(self.rows, self.key_type)
        # one projection a step: each stays in generated code, and the key's own expression, a hash
        # perhaps, is computed once a row
        out = df.withColumn(key, sort_key(df, cols).cast(_nullable(self.key_type))).withColumn(low, F.lit(0))
        for k in reversed(range(len(self.rows).bit_length())):
            up = F.col(low) + (1 << k)
            out = out.withColumn(low, F.when(F.get(at, up - 1) <= F.col(key), up).otherwise(F.col(low)))
        found = F.lit(len(self.rows)) - F.col(low) if descending else F.col(low)
        return out.withColumn(name, found).drop(low, key)

    def members(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """The rows whose tuple ``cols`` is one of the boundaries.  These are fewer than there are
        buckets, a proven bound, so they are broadcast."""
        some = df.sparkSession.range(1).select(F.inline(_as_constant(self.rows, self.key_type)))
        names = [f"_pfx_m{i}" for i in range(len(cols))]
        same = [_comparable(df, c).eqNullSafe(F.col(n)) for c, n in zip(cols, names)]
        return df.join(F.broadcast(some.toDF(*names)), reduce(lambda a, b: a & b, same), "left_semi")

    def leading(self, n: int) -> "Bounds":
        """The distinct first ``n`` fields of the boundaries."""
        kept = T.StructType(self.key_type.fields[:n])
        rows = [Row(**dict(zip(kept.names, r[:n]))) for r in self.rows]
        return Bounds(_distinct(rows), kept)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def _nullable(key_type: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in key_type.fields])


def _json_value(v):
    if isinstance(v, Row):
        return {k: _json_value(x) for k, x in v.asDict().items()}
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(v).decode("ascii")
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    return str(v)   # decimals


def _as_constant(rows: list[Row], key_type: T.StructType) -> Column:
    """An array of tuples as one foldable expression."""
    text = json.dumps([_json_value(r) for r in rows])
    return F.from_json(F.lit(text), T.ArrayType(key_type))


def _distinct(rows: list[Row]) -> list[Row]:
    """Rows in order, without repeats."""
    return [r for i, r in enumerate(rows) if i == 0 or tuple(r) != tuple(rows[i - 1])]


def range_bounds(source: DataFrame, cols: list[str], n_buckets: int) -> Bounds:
    """Boundaries that cut ``source`` into about ``n_buckets`` even ranges of the tuple ``cols``."""
    keys = source.select(sort_key(source, cols).alias("k"))
    if n_buckets <= 1:
        return Bounds([], keys.schema["k"].dataType)
    n, wanted = keys.count(), SAMPLED_PER_BUCKET * n_buckets
    # about `wanted` rows, in one task
    some = keys if n <= wanted else keys.sample(fraction=wanted / n, seed=17)
    tiles = some.select("k", F.ntile(n_buckets).over(Window.orderBy("k")).alias("tile"))
    rows = [r["k"] for r in tiles.groupBy("tile").agg(F.min("k").alias("k")).orderBy("tile").collect()][1:]
    return Bounds(_distinct(rows), keys.schema["k"].dataType)


def bucket_of(key: Column, bounds: list[float]) -> Column:
    """Number of ``bounds`` that are ``<= key`` (nulls go to bucket 0)."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(key >= F.lit(bounds[mid - 1]), build(mid, hi)).otherwise(build(lo, mid - 1))

    return build(0, len(bounds))


# ---- running aggregates ------------------------------------------------------

def _moments(count: Column, mean: Column, var_pop: Column) -> Column:
    return F.struct(count.cast("double").alias("n"), mean.alias("mean"), (var_pop * count).alias("m2"))


def merge_moments(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two sets together."""
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"),
                    (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a.isNull() | (F.coalesce(a["n"], F.lit(0.0)) == 0), b).when(
        b.isNull() | (F.coalesce(b["n"], F.lit(0.0)) == 0), a).otherwise(both)


def _partial(func: str, v: Column, order: Column, descending: bool) -> Column:
    if func in ("last", "first"):
        seen = F.when(v.isNotNull(), order)
        return (F.max_by if (func == "last") != descending else F.min_by)(v, seen)
    if func == "moments":
        return _moments(F.count(v), F.avg(v), F.var_pop(v))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[func](v)


def _combine(func: str, partial: Column, frame) -> Column:
    if func in ("sum", "count"):
        return F.sum(partial).over(frame)
    if func in ("min", "max"):
        return {"min": F.min, "max": F.max}[func](partial).over(frame)
    if func == "last":
        return F.last(partial, ignorenulls=True).over(frame)
    if func == "first":
        return F.first(partial, ignorenulls=True).over(frame)
    # buckets of one group, in order; few
    none = F.lit(None).cast("struct<n: double, mean: double, m2: double>")
    return F.aggregate(F.collect_list(partial).over(frame), none, merge_moments)


def _local(func: str, v: Column, frame) -> Column:
    if func == "last":
        return F.last(v, ignorenulls=True).over(frame)
    if func == "first":
        return F.first(v, ignorenulls=True).over(frame)
    if func == "moments":
        return _moments(F.count(v).over(frame), F.avg(v).over(frame), F.var_pop(v).over(frame))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[func](v).over(frame)


def _merge(func: str, local: Column, carry: Column) -> Column:
    if func == "sum":
        return F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    if func == "count":
        return local + F.coalesce(carry, F.lit(0)).cast("long")
    if func in ("min", "max"):
        return {"min": F.least, "max": F.greatest}[func](local, carry)
    if func == "last":
        return F.coalesce(local, carry)
    if func == "moments":
        return merge_moments(carry, local)
    raise ValueError(func)


AGGREGATES = ("sum", "count", "min", "max", "last", "moments")


def _checked(aggs, allowed) -> dict[str, tuple[str, Column]]:
    for func, _ in (aggs or {}).values():
        if func not in allowed:
            raise ValueError(f"unsupported prefix aggregate {func!r}; use one of {allowed}")
    return {name: (func, F.col(v) if isinstance(v, str) else v) for name, (func, v) in (aggs or {}).items()}


def prefix_aggregate(df: DataFrame, order_cols: list[str],
                     aggs: dict[str, tuple[str, Column | str]],
                     group_cols: list[str] | tuple = (), inclusive: bool = False,
                     descending: bool = False, n_buckets: int | None = None,
                     with_totals: dict[str, tuple[str, Column | str]] | None = None,
                     bounds_from: DataFrame | None = None, uniform: bool = False) -> DataFrame:
    """Add running aggregates over earlier rows of the same group.

    ``aggs`` maps an output name to ``(func, value)`` with func in ``sum count
    min max last moments`` (``last`` = last non-null value, ``moments`` =
    struct of count ``n``, ``mean`` and squared deviations ``m2``).  Rows are
    ordered by ``order_cols``, nulls first, or the whole tuple reversed if
    ``descending``; the caller supplies a unique tie-break when the order must
    be total.  ``inclusive`` includes the current row.  ``with_totals`` adds
    whole-group aggregates (``sum count min max first``) from the same pass.

    ``bounds_from`` is a cheaper source of the group and ordering columns (for
    example the raw columns before a reduction); any source gives exact results.
    ``uniform`` says that the first ordering column is a uniform number in
    [0, 1) and there are no groups: boundaries then need no pass at all.
    """
    groups = list(group_cols)
    values, totals = _checked(aggs, AGGREGATES), _checked(with_totals, ("sum", "count", "min", "max", "first"))
    n_buckets = n_buckets or default_buckets(df.sparkSession)
    if uniform and not groups:
        cut = F.least(F.floor(F.col(order_cols[0]) * n_buckets), F.lit(n_buckets - 1)).cast("int")
        data, bounds = df.withColumn(_BUCKET, F.lit(n_buckets) - cut if descending else cut), None
    else:
        bounds = range_bounds(df if bounds_from is None else bounds_from, [*groups, *order_cols], n_buckets)
        data = bounds.add_bucket(df, [*groups, *order_cols], _BUCKET, descending)

    # groups that a boundary falls into: at most one a boundary
    inside = data
    if groups:
        inside = bounds.leading(len(groups)).members(df, groups)
        inside = bounds.add_bucket(inside, [*groups, *order_cols], _BUCKET, descending)
    order = sort_key(df, list(order_cols))
    partials = inside.groupBy(*groups, _BUCKET).agg(
        *[_partial(f, v, order, descending).alias(f"_p_{name}") for name, (f, v) in values.items()],
        *[_partial(f, v, order, descending).alias(f"_q_{name}") for name, (f, v) in totals.items()])
    gw = Window.partitionBy(*groups).orderBy(_BUCKET)
    before = gw.rowsBetween(Window.unboundedPreceding, -1)
    whole = gw.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carries = partials.select(
        *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], F.col(_BUCKET).alias("_cb"), F.lit(True).alias("_split"),
        *[_combine(f, F.col(f"_p_{name}"), before).alias(f"_c_{name}") for name, (f, _) in values.items()],
        *[_combine(f, F.col(f"_q_{name}"), whole).alias(f"_t_{name}") for name, (f, _) in totals.items()])
    # at most two rows a boundary: a proven bound, so broadcasting is safe
    carries = F.broadcast(carries)
    cond = [data[_BUCKET] == carries["_cb"]] + [data[g].eqNullSafe(carries[f"_g{i}"]) for i, g in enumerate(groups)]
    joined = data.join(carries, reduce(lambda a, b: a & b, cond), "left")

    rows = Window.partitionBy(*groups, _BUCKET).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order_cols])
    frame = rows.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    full = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def total(name: str, func: str, v: Column) -> Column:
        out = F.when(F.col("_split"), F.col(f"_t_{name}")).otherwise(_local(func, v, full))
        return (F.struct(out.alias("v")) if func == "first" else out).alias(name)

    return joined.select(
        *[data[c] for c in df.columns],
        *[_merge(f, _local(f, v, frame), F.col(f"_c_{name}")).alias(name) for name, (f, v) in values.items()],
        *[total(name, f, v) for name, (f, v) in totals.items()])


def prefix_row_number(df: DataFrame, order_cols: list[str], group_cols=(), name: str = "row_number",
                      n_buckets: int | None = None, with_count: str | None = None, uniform: bool = False) -> DataFrame:
    """0-based position of each row within its group in ``order_cols`` order."""
    totals = {with_count: ("count", F.lit(1))} if with_count else None
    return prefix_aggregate(df, order_cols, {name: ("count", F.lit(1))}, group_cols,
                            inclusive=False, n_buckets=n_buckets, with_totals=totals, uniform=uniform)


# ---- exact quantiles ----------------------------------------------------------

_FEW_PARTS = 100_000    # parts that are broadcast: some MB
_LEVELS = (42, 21, 0)   # a number's 64 bits are refined in parts of 22, 21 and 21


def order_code(x: Column) -> Column:
    """The bits of a double as a long of the same order; -0.0 as 0.0, NaN above all."""
    size = F.abs(x)
    rough = F.floor(F.log2(size)).cast("int")
    m = size * F.pow(F.lit(2.0), -rough)      # powers of two are exact
    power = rough + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0)
    fraction = F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m) - 1
    bits = (power.cast("long") + 1023) * (1 << 52) + (fraction * float(1 << 52)).cast("long")
    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")
    code = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0 ** -1022, tiny).otherwise(bits)
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x == 0, F.lit(0)).when(x < 0, -code).otherwise(code)


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_cols=(),
                    names: list[str] | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles (numpy ``linear`` / SQL ``quantile_cont``).

    Selection by nested histograms over the bits of the numbers: counts per leading part tell
    which part holds each wanted rank, and only those parts are counted by the next bits.  No row
    is ranked; equal values meet in map-side combine, so a column of 11 values moves at most 11
    rows a partition, group and level.  Nulls are left out; a group without values has no row.
    """
    groups = list(group_cols)
    names = names or [f"q{p}" for p in probs]
    held = [f"_g{i}" for i in range(len(groups))]
    base = df.select(*[F.col(f"`{g}`").alias(h) for g, h in zip(groups, held)], F.col(value_col).cast("double").alias("_v"))
    base = base.where(F.col("_v").isNotNull()).withColumn("_code", order_code(F.col("_v")))
    mask = (1 << 21) - 1
    base = base.select(*held, "_v", *[(F.shiftright("_code", s) if k == 0 else F.shiftright("_code", s).bitwiseAND(F.lit(mask)))
                                      .alias(f"_c{k}") for k, s in enumerate(_LEVELS)])

    found, few = None, False
    for k in range(len(_LEVELS)):
        path = [f"_c{j}" for j in range(k)]
        rows = base
        if found is not None:
            parts = found.select(*[F.col(c).alias(f"{c}_") for c in held + path]).distinct()
            same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in held + path]
            if few:
                parts = F.broadcast(parts)
            rows = base.join(parts, reduce(lambda a, b: a & b, same), "left_semi")
        counts = rows.groupBy(*held, *path, f"_c{k}").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"))
        # the parts of one number range: at most 2 ** 22, as many as occur
        w = Window.partitionBy(*held, *path).orderBy(f"_c{k}")
        counts = counts.withColumn("_below", F.sum("_n").over(w) - F.col("_n"))
        if found is None:
            counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*held)))
            at = [(F.col("_all") - 1).cast("double") * F.lit(float(p)) for p in probs]
            ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
            hits = counts.select("*", F.explode(ranks).alias("_rank")).withColumn("_left", F.col("_rank"))
        else:
            here = found.select(*[F.col(c).alias(f"{c}_") for c in held + path], "_all", "_rank", "_left")
            hits = counts.join(here, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in held + path]))
        hits = hits.where((F.col("_left") >= F.col("_below")) & (F.col("_left") < F.col("_below") + F.col("_n")))
        found = hits.select(*held, *path, f"_c{k}", "_v", "_all", "_rank", (F.col("_left") - F.col("_below")).alias("_left"))
        if k < len(_LEVELS) - 1:
            # a few rows a group; counted, so that rows are met where they lie: a shuffle by these
            # parts would sort all rows of a part (of one common value) in one task
            found = written(found, "parts")
            few = found.count() <= _FEW_PARTS

    out = []
    for p, name in zip(probs, names):
        at = (F.col("_all") - 1).cast("double") * F.lit(float(p))
        low = F.max(F.when(F.col("_rank") == F.floor(at), F.col("_v")))
        high = F.max(F.when(F.col("_rank") == F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return found.groupBy(*held).agg(*out).select(*[F.col(h).alias(g) for h, g in zip(held, groups)], *[F.col(f"`{x}`") for x in names])
