"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a word budget (its target).  A document is taken by whole epochs
(``floor(target / source size)``) plus once more when its hash lies below the
source's threshold.  The threshold comes from nested histograms: words are summed
by source and hash bucket, the bucket in which the running sum passes the budget
is split into finer buckets, and only the rows of that bucket are summed again.
Nothing is sorted, and a source with a third of all rows is only ever summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import cut, free, n_words

BITS, LEVELS = 12, 3  # 36 hash bits, 4096 buckets a level
WEIGHTS = (5, 2, 1)


def hash36(id_col: str | Column) -> Column:
    """36 bits of the MD5 of the id in decimal digits (null: of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """``_key, source, source_size`` -> the same with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``max_epochs`` times its source,
    and what that leaves over goes to the others by weight until none is above.
    The stopping sources are those with the least size per weight, so one running
    sum in that order finds them.  The windows here see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy(F.lit(0))
    before = (Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    s = (s.withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
         .withColumn("_rest", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_full", F.col("_cap") * F.col("_open") <= F.col("_rest") * F.col("_w")))
    unit = ((F.max("_all").over(every) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every))
            / F.nullif(F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every), F.lit(0.0)))
    return s.withColumn("_unit", unit).select(
        "_key", "source", "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_unit") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words (null text: 0), ``copies`` how often the mix takes the row
    (0 .. ``max_epochs``), ``taken = copies * size``.  A null source is a source of
    its own, the last in order.  Rows that repeat an id share its hash and are
    taken together; a null id hashes like the empty text.  A source without words
    has target 0 and its rows are not taken.  Reruns agree, as nothing but ids,
    sizes and sources decides.  Other columns are ignored.
    """
    d = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        n_words(text_col).alias("size"), hash36(id_col).alias("_h"))
            .withColumn("_key", F.when(F.col("source").isNull(), F.lit("n"))
                        .otherwise(F.concat(F.lit("s"), F.col("source")))))
    sizes = d.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0,
                    F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    plan = cut(plan.withColumn("_epochs", epochs.cast("int"))
               .withColumn("_rem", F.col("target") - F.col("_epochs") * F.col("source_size")))

    # Nested histograms: only rows inside the bucket that holds the threshold go on.
    bound = plan.select("_key", "_rem", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_base"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = d if level == 0 else d.withColumn("_at", F.shiftright("_h", shift + BITS)).join(
            bound.select("_key", "_at"), ["_key", "_at"], "left_semi")
        hist = inside.groupBy("_key", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_words"))
        run = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.join(bound.drop("_at"), "_key").withColumn("_upto", F.col("_base") + F.sum("_words").over(run))
        bound = cut(hist.where("_upto - _words <= _rem AND _rem < _upto").select(
            "_key", "_rem", F.col("_b").alias("_at"), (F.col("_upto") - F.col("_words")).alias("_base"),
            F.col("_upto").alias("_upto")).drop("_upto" if level < LEVELS - 1 else "_none"))
    threshold = bound.select("_key", (F.col("_at") + F.when(
        F.col("_upto") - F.col("_rem") < F.col("_rem") - F.col("_base"), 1).otherwise(0)).alias("_threshold"))
    plan = plan.join(threshold, "_key", "left").select(
        "_key", "source_size", "target", "_epochs", F.coalesce("_threshold", F.lit(0)).alias("_threshold"))
    out = d.join(plan, "_key").withColumn(
        "copies", F.when(F.col("source_size") > 0,
                         F.col("_epochs") + (F.col("_h") < F.col("_threshold")).cast("int")).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns unchanged."""
    key, times, copy = free(docs, "_id", "_copies", "_copy")
    m = (mix(docs, id_col, text_col, source_col, weights, share, max_epochs).where("copies > 0")
         .groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times)))
    return (docs.join(m, F.col(id_col).eqNullSafe(F.col(key)))
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
            .drop(key, times, copy))
