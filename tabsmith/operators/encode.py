"""Categories with many values as ordered target statistics (L2).

A row's category becomes the mean label of *earlier* rows of that category, in hash order of the
entity key, drawn towards the overall mean; a row's own label never enters its feature.  For scoring
the statistics of all training rows are frozen, one row per category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.hashing import hash_unit_interval
from tabsmith.operators import ml
from tabsmith.operators.prefix import prefix_aggregate


def encoded_name(c: str) -> str:
    return f"{c}__target_mean"


def _smoothed(total: Column, n: Column, prior: float, weight: float) -> Column:
    return (F.coalesce(total, F.lit(0.0)) + F.lit(prior * weight)) / (F.coalesce(n, F.lit(0)) + F.lit(float(weight)))


def label_mean(df: DataFrame, label: str) -> float:
    """Mean of the known labels; 0 for a table without any."""
    return float(df.agg(F.avg(F.col(label).cast("double")).alias("m")).first()["m"] or 0.0)


def ordered_statistics(df: DataFrame, cols: list[str], label: str, key: str, weight: float = 1.0, seed: int = 42,
                       prior: float | None = None) -> DataFrame:
    """``df`` with one more column per category column: the smoothed mean label of earlier rows.

    A null category is a category.  Rows with a null label count for nothing.  Rows that repeat a key
    come in the order of their labels and the category; a hot category is cut into range buckets."""
    prior = label_mean(df, label) if prior is None else prior
    out = df.withColumn("_u", hash_unit_interval(F.col(key), seed)).withColumn("_k", F.col(key).cast("string")) \
        .withColumn("_y", F.col(label).cast("double"))
    for c in cols:
        out = prefix_aggregate(out, ["_u", "_k", "_y"], {"_n": ("count", "_y"), "_s": ("sum", "_y")}, [c])
        out = out.withColumn(encoded_name(c), _smoothed(F.col("_s"), F.col("_n"), prior, weight)).drop("_n", "_s")
    return out.drop("_u", "_k", "_y")


def frozen_statistics(df: DataFrame, col: str, label: str, weight: float = 1.0, prior: float | None = None) -> DataFrame:
    """``col`` and its smoothed mean label over all rows, one aggregate."""
    prior = label_mean(df, label) if prior is None else prior
    y = F.col(label).cast("double")
    return df.groupBy(col).agg(F.sum(y).alias("_s"), F.count(y).alias("_n")).select(
        col, _smoothed(F.col("_s"), F.col("_n"), prior, weight).alias(encoded_name(col)))


@dataclass
class EncodedModel:
    """A fitted pipeline with the statistics of its categories with many values."""
    model: PipelineModel
    statistics: dict[str, DataFrame]
    prior: float
    task: str

    def encode(self, df: DataFrame) -> DataFrame:
        """Frozen statistics by category; a category that training did not see gets the prior."""
        for c, stats in self.statistics.items():
            known = stats.select(F.col(c).alias("_c"), F.col(encoded_name(c)).alias("_v"))
            df = df.join(known, F.col(c).eqNullSafe(F.col("_c")), "left") \
                .withColumn(encoded_name(c), F.coalesce("_v", F.lit(self.prior))).drop("_c", "_v")
        return df

    def score(self, df: DataFrame) -> DataFrame:
        return ml.score(self.model, self.encode(df), self.task)


#: Regression losses by the names users ask for them, and the learner's own.
LOSSES = {"RMSE": "squared", "MAE": "absolute"}


def train_encoded(df: DataFrame, few: list[str], many: list[str], numeric: list[str], label: str, key: str,
                  task: str = "classification", weight: float = 1.0, loss: str | None = None, **params) -> EncodedModel:
    """L2 with categories of any number of values: ``few`` are indexed, ``many`` are target statistics.

    ``loss`` is RMSE or MAE for regression.  Poisson is refused: the learner has no such loss."""
    if loss is not None:
        if task == "classification" or loss not in LOSSES:
            raise ValueError(f"loss {loss!r} is not one of {sorted(LOSSES)} for regression")
        params["lossType"] = LOSSES[loss]
    prior = label_mean(df, label)
    fit = ordered_statistics(df, many, label, key, weight, prior=prior)
    model = ml.train(fit, few, [*map(encoded_name, many), *numeric], label, task, **params)
    return EncodedModel(model, {c: frozen_statistics(df, c, label, weight, prior) for c in many}, prior, task)
