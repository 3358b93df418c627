"""Stable row keys (X10 + W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.hashing import row_key_hash, row_text
from tabsmith.operators.prefix import prefix_row_number


def add_row_id(df: DataFrame, key_cols: list[str], name: str = "row_id",
               n_buckets: int | None = None) -> DataFrame:
    """``sha256(key text) + '-' + k`` where k counts earlier rows with the same key.

    Rows sharing a key hash are ordered by a SHA-256 fingerprint of the whole
    row (every digit of it), so the suffix does not depend on the order of rows.
    The counter uses the bucketed prefix: a key held by a third of all rows is split over
    many tasks instead of one window partition.
    """
    fp = F.sha2(row_text(df), 256)
    d = df.withColumn("_rid_base", row_key_hash(df, key_cols)).withColumn("_rid_fp", fp)
    ranked = prefix_row_number(d, ["_rid_fp"], ["_rid_base"], name="_rid_n", n_buckets=n_buckets)
    return ranked.withColumn(name, F.concat_ws("-", "_rid_base", F.col("_rid_n").cast("string"))) \
        .drop("_rid_base", "_rid_fp", "_rid_n")


# Which columns make the row key of each dataset (dataset name -> key columns).
ROW_ID_POLICIES: dict[str, list[str]] = {}


def register_row_id_policy(dataset: str, key_cols: list[str]) -> None:
    ROW_ID_POLICIES[dataset] = list(key_cols)


def add_row_id_for(df: DataFrame, dataset: str, name: str = "row_id") -> DataFrame:
    """Look up the dataset's key columns; datasets without a policy are an error."""
    if dataset not in ROW_ID_POLICIES:
        raise KeyError(f"no row-id policy for dataset {dataset!r}")
    return add_row_id(df, ROW_ID_POLICIES[dataset], name)
