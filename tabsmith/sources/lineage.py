"""Reload of a table from the lineage rows that recorded how it was joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsmith.functions.hashing import portable_fingerprint
from tabsmith.operators.joins import lineage_diff, merge

LINEAGE_SCHEMA = ("position int, name string, version string, snapshot string, path string, keys array<string>, how string, "
                  "cardinality string, fingerprint string")


def _fingerprint(df: DataFrame) -> str:
    row = portable_fingerprint(df).first()
    return f"{row['n_rows']}:{row['sum_sha']}"


def record_lineage(spark: SparkSession, datasets: list[dict]) -> DataFrame:
    """Lineage rows of datasets in join order: ``name, version, snapshot, path`` and, but for the
    first, ``keys, how`` and optionally ``cardinality`` (J2); the content's fingerprint is taken now."""
    rows = [(i, d["name"], d["version"], d["snapshot"], d["path"], d.get("keys"), d.get("how", "left"), d.get("cardinality"),
             _fingerprint(spark.read.parquet(d["path"]))) for i, d in enumerate(datasets)]
    return spark.createDataFrame(rows, LINEAGE_SCHEMA)


def reload_from_lineage(spark: SparkSession, lineage: DataFrame) -> DataFrame:
    """Read every recorded snapshot, check that what was read is what was recorded (U3 over the
    rows, fingerprints included), and join in the recorded order.

    One row per dataset, so lineage is metadata-sized.  A changed, missing or repeated row raises."""
    rows = lineage.orderBy("position").collect()
    if not rows:
        raise ValueError("empty lineage")
    if [r["position"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"lineage positions are not 0..{len(rows) - 1}")
    tables = [spark.read.parquet(r["path"]) for r in rows]
    actual = spark.createDataFrame([(*r[:-1], _fingerprint(t)) for r, t in zip(rows, tables)], LINEAGE_SCHEMA)
    wrong = lineage_diff(lineage.select(actual.columns), actual).where("side = 'expected_only'").select("name", "snapshot").collect()
    if wrong:
        raise ValueError(f"snapshots differ from their lineage: {[tuple(w) for w in wrong]}")
    out = tables[0]
    for r, t in zip(rows[1:], tables[1:]):
        out = merge(out, t, list(r["keys"]), r["how"], r["cardinality"])
    return out

