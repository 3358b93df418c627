"""Snapshot catalog: latest snapshot, per-(name, version) latest, bindings.

A catalog is a DataFrame with at least ``snapshot_id`` (``{timestamp}_{uuid}``,
timestamp shaped ``YYYY-MM-DDTHH-MM-SS``) and optional ``name``/``version``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd'T'HH-mm-ss"


def parse_snapshot_ids(catalog: DataFrame, id_col: str = "snapshot_id") -> DataFrame:
    """Add ``snapshot_ts``/``snapshot_uuid`` and a validity flag.

    Valid ids split on ``_`` into exactly two parts and the first part holds a
    ``T`` and parses as a timestamp; everything else is skipped by the
    consumers below.
    """
    parts = F.split(F.col(id_col), "_")
    head = parts.getItem(0)
    ts = F.try_to_timestamp(head, F.lit(TS_FORMAT))
    valid = (F.size(parts) == 2) & F.coalesce(head.contains("T"), F.lit(False)) & ts.isNotNull()
    return catalog.withColumns({
        "snapshot_ts": F.when(valid, ts),
        "snapshot_uuid": F.when(valid, F.element_at(parts, 2)),
        "snapshot_valid": F.coalesce(valid, F.lit(False)),
    })


def latest_snapshots(catalog: DataFrame, by: list[str] | tuple = ("name", "version"),
                     id_col: str = "snapshot_id") -> DataFrame:
    """Newest valid snapshot per group; ties on time broken by uuid."""
    parsed = parse_snapshot_ids(catalog, id_col).where("snapshot_valid")
    return parsed.groupBy(*by).agg(
        F.max_by(F.col(id_col), F.struct("snapshot_ts", "snapshot_uuid")).alias("latest_snapshot"),
        F.count(F.lit(1)).alias("n_valid_snapshots"),
    )


def _list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Sub-directory names through Hadoop's FileSystem (HDFS, S3, GCS, local)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def list_snapshot_dirs(spark: SparkSession, base: str) -> DataFrame:
    """S9 input: catalog of ``base/name/version/snapshot_id`` folders.

    Directory metadata only (one row per snapshot) is listed on the driver.
    """
    rows = []
    for name in _list_dirs(spark, base):
        for version in _list_dirs(spark, f"{base.rstrip('/')}/{name}"):
            for sid in _list_dirs(spark, f"{base.rstrip('/')}/{name}/{version}"):
                rows.append((name, version, sid))
    return spark.createDataFrame(rows, "name string, version string, snapshot_id string")


def get_latest_snapshot(catalog: DataFrame, id_col: str = "snapshot_id") -> str:
    """S8 for one folder: returns the id; raises when no valid id exists."""
    row = latest_snapshots(catalog.withColumn("_all", F.lit(1)), ["_all"], id_col).first()
    if row is None:
        raise LookupError("no valid snapshots")
    return row["latest_snapshot"]


def resolve_snapshots(requested: DataFrame, latest: DataFrame, bindings: DataFrame | None = None,
                      binding_id: str | None = None) -> DataFrame:
    """Binding (when a binding id is named) -> explicitly given -> latest.

    ``requested``: (name, version, given_snapshot nullable);
    ``latest``: output of :func:`latest_snapshots`;
    ``bindings``: (binding_id, kind, name, version, snapshot).
    """
    out = requested.join(latest.select("name", "version", "latest_snapshot"), ["name", "version"], "left")
    if binding_id is not None:
        if bindings is None:
            raise ValueError("a binding id was given without a binding table")
        b = bindings.where(F.col("binding_id") == binding_id).select(
            "name", "version", F.col("snapshot").alias("bound_snapshot"))
        out = out.join(b, ["name", "version"], "left")
        chosen = F.col("bound_snapshot")
    else:
        chosen = F.coalesce(F.col("given_snapshot"), F.col("latest_snapshot"))
    missing = F.raise_error(F.concat(F.lit("no snapshot for "), F.col("name"), F.lit(" "), F.col("version")))
    return out.withColumn("snapshot", F.coalesce(chosen, missing.cast("string")))


def read_feature_sets(spark: SparkSession, store: str, resolved: DataFrame, entity_key: str) -> DataFrame:
    """The feature sets of :func:`resolve_snapshots`, joined one to one on the entity key."""
    from tabsmith.operators.joins import assemble_feature_sets
    sets = {f"{r['name']}/{r['version']}": spark.read.parquet(f"{store.rstrip('/')}/{r['name']}/{r['version']}/{r['snapshot']}/features.parquet")
            for r in resolved.collect()}   # one row per feature set
    if not sets:
        raise LookupError("no feature sets requested")
    return assemble_feature_sets(sets, entity_key)


def drift_inputs(spark: SparkSession, store: str, requested: DataFrame, bindings: DataFrame, reference: str, actual: str,
                 entity_key: str) -> tuple[DataFrame, DataFrame]:
    """The features that the registered model was trained on (binding ``reference``) and those
    bound to the inference run (binding ``actual``), two resolutions of the same request."""
    latest = latest_snapshots(list_snapshot_dirs(spark, store))
    return tuple(read_feature_sets(spark, store, resolve_snapshots(requested, latest, bindings, b), entity_key) for b in (reference, actual))
