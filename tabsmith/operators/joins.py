"""Keyed joins with cardinality checks, assembly and lineage set operations
(J1-J9, P8, P9, P11, U3, U5).

Physical join choice is left to Catalyst/AQE.  Null keys match each other
(pandas merge semantics), expressed with ``<=>`` which Spark still plans as
an equi-join (hash/sort-merge on (coalesce(key), isnull(key))).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOWS = ("inner", "left", "right", "outer")
_VALIDATE = {"1:1": "1:1", "one_to_one": "1:1", "1:m": "1:m", "one_to_many": "1:m",
             "m:1": "m:1", "many_to_one": "m:1", "m:m": "m:m", "many_to_many": "m:m"}


def normalize_validate(v: str | None) -> str | None:
    if v is None:
        return None
    if v not in _VALIDATE:
        raise ValueError(f"unknown cardinality {v!r}")
    return _VALIDATE[v]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once (nulls form one key), with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: list[str], side: str = "table") -> None:
    """Raise when a key repeats; stops at the first duplicate found."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"{side} is not unique on {keys}: e.g. {dup[0].asDict()}")


def assert_each_unique(tables: dict[str, DataFrame], keys: list[str]) -> None:
    """Every table unique on ``keys``, in one job over the key columns alone."""
    tagged = [d.select(F.lit(name).alias("_table"), *[F.col(f"`{k}`") for k in keys]) for name, d in tables.items()]
    dup = duplicate_keys(reduce(DataFrame.unionByName, tagged), ["_table", *keys]).limit(1).collect()
    if dup:
        found = dup[0].asDict()
        raise ValueError(f"{found.pop('_table')} is not unique on {keys}: e.g. {found}")


def check_cardinality(left: DataFrame, right: DataFrame, keys: list[str], validate: str | None) -> None:
    """Duplicates on a "1" side raise."""
    v = normalize_validate(validate)
    if v in ("1:1", "1:m"):
        assert_unique(left, keys, "left")
    if v in ("1:1", "m:1"):
        assert_unique(right, keys, "right")


def drop_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Non-key columns already on the left are dropped from the right."""
    overlap = [c for c in right.columns if c in set(left.columns) and c not in set(keys)]
    return right.drop(*overlap)


def merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
          validate: str | None = None, overlap: str = "keep_left") -> DataFrame:
    """Equi-join on ``keys`` present on both sides, null keys matching.

    ``how`` in inner/left/right/outer.  A keyless ``cross`` merge is refused:
    it emits all pairs and cannot be bounded.
    """
    if how == "cross":
        raise ValueError("cross merges are not supported: they emit every pair of rows")
    if how not in HOWS:
        raise ValueError(f"unknown join type {how!r}")
    for side, d in (("left", left), ("right", right)):
        missing = [k for k in keys if k not in d.columns]
        if missing:
            raise ValueError(f"{side} side lacks merge keys {missing}")
    if overlap == "keep_left":
        right = drop_overlap(left, right, keys)
    check_cardinality(left, right, keys, validate)
    r = right.select(*[F.col(f"`{k}`").alias(f"_rk{i}") for i, k in enumerate(keys)],
                     *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_rk{i}"]) for i, k in enumerate(keys)])
    joined = left.join(r, cond, "full_outer" if how == "outer" else how)
    if how in ("inner", "left"):
        key_exprs = [left[k].alias(k) for k in keys]
    elif how == "right":
        key_exprs = [r[f"_rk{i}"].alias(k) for i, k in enumerate(keys)]
    else:
        key_exprs = [F.coalesce(left[k], r[f"_rk{i}"]).alias(k) for i, k in enumerate(keys)]
    return joined.select(*key_exprs,
                         *[left[c] for c in left.columns if c not in keys],
                         *[r[c] for c in right.columns if c not in keys])


def dataset_order(datasets: list[tuple[str, list[str]]]) -> list[str]:
    """Edge i -> j (i < j) when key sets intersect; a topological order
    (ties in config order) decides the join sequence.  Config-level only."""
    names = [n for n, _ in datasets]
    keys = {n: set(k) for n, k in datasets}
    indeg = {n: 0 for n in names}
    edges = {n: [] for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if keys[a] & keys[b]:
                edges[a].append(b)
                indeg[b] += 1
    order, ready = [], [n for n in names if indeg[n] == 0]
    while ready:
        n = ready.pop(0)
        order.append(n)
        for m in edges[n]:
            indeg[m] -= 1
            if indeg[m] == 0:
                ready.append(m)
                ready.sort(key=names.index)
    return order


def merge_all(datasets: list[dict]) -> DataFrame:
    """J1 over J3's order (J9's reload): each item has ``name, df, keys, how, validate``.

    The first dataset is taken as is, even when empty.
    """
    by_name = {d["name"]: d for d in datasets}
    order = dataset_order([(d["name"], d["keys"]) for d in datasets])
    out = by_name[order[0]]["df"]
    for n in order[1:]:
        d = by_name[n]
        out = merge(out, d["df"], d["keys"], d.get("how", "left"), d.get("validate"))
    return out


def assemble_feature_sets(sets: dict[str, DataFrame], entity_key: str, validate: bool = True) -> DataFrame:
    """Feature sets sorted by name, inner 1:1 joins on the entity key,
    overlapping columns keep the left copy.  Each join shuffles on the entity
    key; consecutive joins on the same key reuse that partitioning, so k sets
    cost k shuffles, not k^2."""
    names = sorted(sets)
    out = sets[names[0]]
    if validate:   # each set once: inner joins of unique keys are unique
        assert_each_unique(sets, [entity_key])
    for n in names[1:]:
        out = merge(out, sets[n], [entity_key], "inner")
    return out


def join_target(features: DataFrame, target: DataFrame, entity_key: str,
                validate: bool = True, assembled: bool = False) -> DataFrame:
    """Inner 1:1 on the entity key; colliding target columns get ``_target``.  ``assembled``
    features have been checked by :func:`assemble_feature_sets`, so only the target is."""
    t = target.select(*[F.col(c).alias(c if c == entity_key or c not in features.columns else f"{c}_target")
                        for c in target.columns])
    if validate:
        check_cardinality(features, t, [entity_key], "m:1" if assembled else "1:1")
    return features.join(t, entity_key, "inner")


def keys_missing_in_target(features: DataFrame, target: DataFrame, entity_key: str) -> DataFrame:
    """Feature keys absent from the target."""
    return features.select(entity_key).join(target.select(entity_key), entity_key, "left_anti")


def assert_keys_in_target(features: DataFrame, target: DataFrame, entity_key: str) -> None:
    if keys_missing_in_target(features, target, entity_key).limit(1).count():
        raise ValueError("feature entity keys are missing from the target")


def join_ground_truth(predictions: DataFrame, truth: DataFrame, key: str = "entity_id") -> DataFrame:
    """By key, never by position."""
    return predictions.join(truth, key, "inner")


def join_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after the inner join / rows before (one aggregate)."""
    r = right.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = left.select(*keys).join(r, keys, "left")
    return j.agg((F.sum(F.coalesce(F.col("_n"), F.lit(0))) / F.count(F.lit(1))).alias("coverage"))


def output_columns(df: DataFrame, entity_key: str, target: str | None = None) -> DataFrame:
    """Entity key first, a column named as the target dropped, repeated names keep the first."""
    seen, cols = set(), []
    for i, c in enumerate(df.columns):
        if c in seen or c == target:
            continue
        seen.add(c)
        cols.append(i)
    names = [df.columns[i] for i in cols]
    ordered = [entity_key] + [c for c in names if c != entity_key]
    return df.select(*[F.col(f"`{c}`") for c in ordered])


def aggregate_schema_tables(schemas: list[DataFrame]) -> DataFrame:
    """Union of schema tables, the first occurrence of each feature wins."""
    tagged = [s.withColumn("_src", F.lit(i)).withColumn("_pos", F.monotonically_increasing_id())
              for i, s in enumerate(schemas)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy("feature").orderBy("_src", "_pos")
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src", "_pos")


def lineage_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Multiset difference both ways; empty means the lineages agree."""
    a = expected.exceptAll(actual).withColumn("side", F.lit("expected_only"))
    b = actual.exceptAll(expected).withColumn("side", F.lit("actual_only"))
    return a.unionByName(b)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """Distinct union of lineage rows."""
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def sorted_for_sink(df: DataFrame, keys: list[str]) -> DataFrame:
    """O1/O2: ascending, nulls last, only where the output must be ordered."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
