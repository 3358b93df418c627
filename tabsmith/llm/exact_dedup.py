"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they agree after each run of white space became one blank
(null counts as empty).  Two narrow groupings -- by length, then by (length,
hash of the first characters) -- settle every text that is alone in its group.
Only the rows left over have their whole content read again and hashed.  All
three groupings combine before the shuffle, so a group of copies that holds a
third of the rows arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import cut, free, one_space

PREFIX_CHARS = 64


def full_hash(c):
    return F.sha2(one_space(c), 256)


def _groups(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    norm = one_space("_t")
    narrow = cut(d.select("doc_id", F.octet_length(norm).alias("_len"),
                          F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_pre")))
    by_len = narrow.groupBy("_len").agg(F.count(F.lit(1)).alias("_n_len"))
    step1 = narrow.join(by_len, "_len")
    open1 = step1.where("_n_len > 1").drop("_n_len")
    by_pre = open1.groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n_pre"))
    step2 = open1.join(by_pre, ["_len", "_pre"])
    alone = step1.where("_n_len = 1").select("doc_id").unionByName(
        step2.where("_n_pre = 1").select("doc_id"))

    # Rows whose content must be read: their ids lead back to the texts.
    left = cut(step2.where("_n_pre > 1").select(F.col("doc_id").alias("_id")).distinct())
    full = (d.join(left, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
            .select("doc_id", full_hash("_t").alias("sha256")))
    rows = cut(full.groupBy("sha256", "doc_id").agg(F.count(F.lit(1)).alias("_n")))
    groups = rows.groupBy("sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    refined = rows.join(groups, "sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256")
    # an id of several texts has all of them read again, so its settled ones must not come twice
    single = alone.join(left, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lit(None).cast("string").alias("sha256"))
    return single.unionByName(refined)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per (id, text): ``doc_id, keep_id, group_size, kept, sha256``.

    ``keep_id`` is the smallest id among rows of equal text, ``group_size`` counts
    those rows (repeats included); ``sha256`` (of the text with single blanks) is
    there for the texts that had to be read to the end, null for the others.  Null
    text equals empty text.  A null id never wins against another id; of a text
    that only null ids carry, one row with a null ``keep_id`` is kept.  Rows that
    repeat both id and text come out once.  An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    return _groups(docs, id_col, text_col, prefix_chars)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, all columns unchanged; rows that
    repeat an id and its text come once."""
    sha, out = free(docs, "_sha", "_out")
    marks = exact_dedup(docs, id_col, text_col).where("NOT kept").select(
        F.col("doc_id").alias(id_col), F.col("sha256").alias(sha), F.lit(True).alias(out))
    # rows and marks meet in one shuffle of the texts; a mark comes first in its group
    rows = docs.withColumn(sha, full_hash(text_col)).withColumn(out, F.lit(False)).unionByName(
        marks, allowMissingColumns=True)
    (at,) = free(rows, "_at")
    order = Window.partitionBy(id_col, sha).orderBy(F.col(out).desc())
    return rows.withColumn(at, F.row_number().over(order)).where((F.col(at) == 1) & ~F.col(out)).drop(sha, out, at)
