"""A caller's own point-in-time aggregate, split over tasks.

Rows lie in range buckets of (group, ordering), as for the built-in aggregates.  Groups that a bucket
boundary falls into have a state per bucket; the states before a bucket, merged, are what its rows
start from.  Rows stream through Arrow batches in order, so neither a group nor a bucket is ever
held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.prefix import default_buckets, range_bounds, sort_key


class UserAggregate:
    """States are tuples of doubles.  ``finish`` may give None; values are never None."""

    def init(self) -> tuple[float, ...]:
        raise NotImplementedError

    def update(self, state: tuple, value: float) -> tuple:
        raise NotImplementedError

    def merge(self, a: tuple, b: tuple) -> tuple:
        """The state of a's rows followed by b's."""
        raise NotImplementedError

    def finish(self, state: tuple) -> float | None:
        raise NotImplementedError


def _bucket_states(agg: UserAggregate, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal keys: its key and the state of its values."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state))
                key, state = k, agg.init()
            if v is not None:
                state = agg.update(state, v)
        yield _states(done)
    if key is not None:
        yield _states([(key, state)])


def _states(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"_key": pa.array([k for k, _ in rows], pa.string()),
                                       "_state": pa.array([list(s) for _, s in rows], pa.list_(pa.float64()))})


def _running(agg: UserAggregate, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the result over all rows before it, and whether there are any."""
    key, state, seen = None, None, False
    for batch in batches:
        n = batch.num_columns
        out, before = [], []
        columns = [batch.column(j).to_pylist() for j in (n - 3, n - 2, n - 1)]
        for k, v, carries in zip(*columns):
            if k != key:
                key = k
                state = reduce(agg.merge, map(tuple, carries), agg.init()) if carries else agg.init()
                seen = bool(carries)
            out.append(agg.finish(state) if seen else None)
            before.append(seen)
            seen = True
            if v is not None:
                state = agg.update(state, v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n - 3], pa.array(out, pa.float64()), pa.array(before, pa.bool_())],
                                         names=[*batch.schema.names[:n - 3], "_result", "_seen"])


def running_user_aggregate(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, agg: UserAggregate,
                           n_buckets: int | None = None) -> DataFrame:
    """``df`` with ``_result`` (over earlier rows of the group, nulls passed over) and ``_seen``
    (whether there are earlier rows)."""
    bounds = range_bounds(df, [*group_cols, *order_cols], n_buckets or default_buckets(df.sparkSession))
    data = bounds.add_bucket(df, [*group_cols, *order_cols], "_b")
    gkey = F.to_json(sort_key(df, group_cols), {"ignoreNullFields": "false"}) if group_cols else F.lit("")
    data = data.withColumn("_g", gkey).withColumn("_key", F.concat_ws("#", F.col("_b").cast("string"), "_g")) \
        .withColumn("_v", F.col(value_col).cast("double"))

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartition("_key").sortWithinPartitions("_key", *order_cols)

    inside = bounds.leading(len(group_cols)).members(data, group_cols) if group_cols else data
    states = ordered(inside).select("_key", "_v").mapInArrow(partial(_bucket_states, agg), "_key string, _state array<double>")
    at = F.split("_key", "#", 2)
    # a group's states in bucket order; at most two rows a boundary in all
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = states.select("_key", "_state", at[0].cast("int").alias("_bucket"), at[1].alias("_group")).select(
        F.col("_key").alias("_ckey"), F.collect_list("_state").over(before).alias("_carries"))
    joined = data.join(F.broadcast(carries), F.col("_key") == F.col("_ckey"), "left")
    rows = ordered(joined).select(*[F.col(f"`{c}`") for c in df.columns], "_key", "_v", "_carries")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(partial(_running, agg), f"{schema}, _result double, _seen boolean")
