"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, label`` for every id in a link; ``label`` is the smallest id of its component.

    Each round gives a node the smallest label around it (summed up before the
    shuffle, so a node with very many links is no burden), lets the nodes that a
    label names follow, and jumps from labels to their labels.  Rounds grow with
    the logarithm of the longest chain; nothing but a row count comes to the driver.
    """
    e = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = e.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("label"))
    lab = cut(lab)
    while True:
        around = e.join(lab.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        # what a node hears also holds for the node its label names
        heard = around.join(lab.withColumnRenamed("id", "x"), "x").select(
            F.col("x").alias("id"), "label", F.least("m", "label").alias("m"))
        roots = heard.where("m < label").groupBy(F.col("label").alias("id")).agg(F.min("m").alias("r"))
        step = heard.join(roots, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("m", F.coalesce("r", "m")).alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut(step.join(jump, "label", "left").select("id", "old", F.coalesce("next", "label").alias("label")))
        lab = new.select("id", "label")
        if new.where("label <> old").limit(1).count() == 0:
            return lab
