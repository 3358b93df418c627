"""What a fitted tree ensemble says row by row: exact attributions (L7) and staged scores.

The trees are read from the model once, as arrays of a size that only the model decides, and
travel with the tasks; rows are scored in Arrow batches where they lie, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.metrics import regression_metrics, roc_auc


@dataclass
class Leaf:
    """A leaf as what each feature of its path must satisfy.

    ``parts`` holds per feature its index, the bounds ``low < x <= high``, the category sets it must
    be in (None: any), and the share of training weight that this feature's splits let through."""
    value: float
    share: float
    parts: list[tuple[int, float, float, frozenset | None, float]]

    def meets(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for j, low, high, inside, _ in self.parts:
            ok = ~(x[:, j] <= low) if low > -np.inf else np.ones(len(x), bool)     # a missing number goes right, as in Spark
            if high < np.inf:
                ok &= x[:, j] <= high
            if inside is not None:
                ok &= np.isin(x[:, j], list(inside))
            out.append(ok)
        return out


@dataclass
class Ensemble:
    """Leaves of each tree, already times the tree's weight."""
    trees: list[list[Leaf]]
    n_features: int

    def expected(self) -> float:
        """The score of no feature at all: leaves by their share of training weight."""
        return float(sum(leaf.value * leaf.share for tree in self.trees for leaf in tree))

    def staged(self, x: np.ndarray) -> np.ndarray:
        """Per row the score after one tree, two trees, and so on."""
        out = np.zeros((len(x), len(self.trees)))
        for t, tree in enumerate(self.trees):
            for leaf in tree:
                there = np.logical_and.reduce([np.ones(len(x), bool), *leaf.meets(x)])
                out[there, t] = leaf.value
        return np.cumsum(out, axis=1)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values per row and feature, with absent features averaged by node covers.

        A leaf's game is a product over its path's features, so only which of them a row meets
        matters: values for all such patterns of a leaf are computed once and looked up."""
        out = np.zeros((len(x), self.n_features))
        for leaf in (leaf for tree in self.trees for leaf in tree if leaf.parts):
            code = sum(ok.astype(np.int64) << k for k, ok in enumerate(leaf.meets(x)))
            table = _pattern_values(leaf)
            for k, (j, *_) in enumerate(leaf.parts):
                out[:, j] += table[code, k]
        return out


def _pattern_values(leaf: Leaf) -> np.ndarray:
    """Per pattern of met features (bit k: the k-th) each feature's Shapley value."""
    d = len(leaf.parts)
    passed = [p[4] for p in leaf.parts]
    weight = [factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]
    out = np.zeros((1 << d, d))
    for code, met in enumerate(product([0.0, 1.0], repeat=d)):
        met = met[::-1]                                     # the first bit counts least
        for i in range(d):
            # coefficient k: coalitions of k other features present, the rest averaged
            poly = np.array([1.0])
            for j in range(d):
                if j != i:
                    poly = np.convolve(poly, [passed[j], met[j]])
            out[code, i] = leaf.value * (met[i] - passed[i]) * float(np.dot(poly, weight))
    return out


def read_ensemble(model: PipelineModel) -> Ensemble:
    """The trees of a pipeline's last stage (a gradient-boosted or forest model, or one tree)."""
    last = model.stages[-1]
    trees = list(getattr(last, "trees", None) or [last])
    weights = list(getattr(last, "treeWeights", None) or [1.0])

    def walk(node, path, share) -> Iterator[Leaf]:
        if node.getClass().getSimpleName() == "LeafNode":
            yield path, float(node.prediction()), share
            return
        split, total = node.split(), node.impurityStats().count()
        j = int(split.featureIndex())
        for left, child in ((True, node.leftChild()), (False, node.rightChild())):
            if split.getClass().getSimpleName() == "ContinuousSplit":
                t = float(split.threshold())
                test = (-np.inf, t, None) if left else (t, np.inf, None)
            else:
                test = (-np.inf, np.inf, frozenset(split.leftCategories() if left else split.rightCategories()))
            part = float(child.impurityStats().count()) / float(total)
            yield from walk(child, [*path, (j, *test, part)], share * part)

    def merged(path, value, share, weight) -> Leaf:
        parts: dict[int, tuple] = {}
        for j, low, high, inside, part in path:
            l0, h0, i0, p0 = parts.get(j, (-np.inf, np.inf, None, 1.0))
            parts[j] = (max(low, l0), min(high, h0), inside if i0 is None else i0 if inside is None else i0 & inside, p0 * part)
        return Leaf(value * weight, share, [(j, *p) for j, p in parts.items()])

    return Ensemble([[merged(p, v, s, w) for p, v, s in walk(t._call_java("rootNode") if hasattr(t, "_call_java") else t.rootNode(), [], 1.0)]
                     for t, w in zip(trees, weights)], int(last.numFeatures))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.num_columns - 1)
    return np.asarray(x.flatten(), float).reshape(len(x), -1)


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = batch.schema.names[:-1]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new.values()], names=[*kept, *new])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(x.ravel()))


def _contribution_rows(ensemble: Ensemble, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = ensemble.expected()
    for batch in batches:
        x = _matrix(batch)
        score = ensemble.staged(x)[:, -1] if len(x) else np.zeros(0)
        yield _with(batch, {"base": pa.array(np.full(len(x), base)), "raw_score": pa.array(score), "contributions": _lists(ensemble.contributions(x))})


def _staged_rows(ensemble: Ensemble, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _with(batch, {"stages": _lists(ensemble.staged(_matrix(batch)))})


def _features(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    ready = df
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    return ready.select(*keep, vector_to_array("features").alias("_x"))


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", " + more


def tree_contributions(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Per row ``keep`` with ``base``, ``raw_score`` (the ensemble's margin) and ``contributions``,
    one per feature in the model's order; base and contributions add up to the raw score."""
    rows = _features(model, df, keep)
    return rows.mapInArrow(partial(_contribution_rows, read_ensemble(model)),
                           _schema(rows, keep, "base double, raw_score double, contributions array<double>"))


def attribution_importances(contributions: DataFrame, names: list[str], k: int = 20) -> DataFrame:
    """A14 + O4: mean absolute contribution per feature, the ``k`` highest, one aggregate."""
    wide = contributions.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"c{i}") for i in range(len(names))])
    stacked = ", ".join(f"'{n}', c{i}" for i, n in enumerate(names))
    long = wide.selectExpr(f"stack({len(names)}, {stacked}) AS (feature, mean_abs_contribution)")
    return long.orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(k)


def staged_scores(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Per row ``keep`` and ``stages``, the margins after each number of trees."""
    rows = _features(model, df, keep)
    return rows.mapInArrow(partial(_staged_rows, read_ensemble(model)), _schema(rows, keep, "stages array<double>"))


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))     # Spark's boosted trees model half the log odds


def iteration_losses(scored: DataFrame, y: str, task: str = "classification", split: str = "split",
                     n_stages: int | None = None) -> DataFrame:
    """``split, iteration, loss``: mean log loss (or squared error) after each number of trees, in one pass."""
    if n_stages is None:
        n_stages = scored.agg(F.max(F.size("stages"))).first()[0] or 0
    if not n_stages:
        raise ValueError("no staged scores to choose an iteration from")
    yy = F.col(y).cast("double")

    def loss(i: int) -> Column:
        s = F.col("stages")[i]
        if task != "classification":
            return F.avg((yy - s) * (yy - s))
        p = F.least(F.greatest(_probability(s), F.lit(1e-15)), F.lit(1 - 1e-15))
        return -F.avg(yy * F.ln(p) + (1 - yy) * F.ln(1 - p))

    wide = scored.groupBy(split).agg(*[loss(i).alias(f"l{i}") for i in range(n_stages)])
    stacked = ", ".join(f"{i + 1}, l{i}" for i in range(n_stages))
    return wide.selectExpr(f"`{split}`", f"stack({n_stages}, {stacked}) AS (iteration, loss)")


def training_metrics(scored: DataFrame, y: str, task: str = "classification", split: str = "split", train: str = "train", val: str = "val",
                     inverse=None, n_stages: int | None = None) -> DataFrame:
    """One row per metric (``metric, value``).

    The best iteration has the lowest validation loss, the fewest trees on ties.  Classification:
    train and validation AUC at it.  Regression: RMSE, MAE and R2 of both splits there, where
    ``inverse`` (X9), a function on a column, takes target and score back to the original scale."""
    losses = iteration_losses(scored, y, task, split, n_stages).where(F.col(split) == val)
    best = losses.agg(F.min(F.struct("loss", "iteration"))["iteration"].alias("b")).first()["b"]
    if best is None:
        raise ValueError(f"no rows in split {val!r}")
    at = scored.where(F.col(split).isin(train, val)).withColumn("_s", F.col("stages")[int(best) - 1])
    if task == "classification":
        per = roc_auc(at, y, "_s", [split])
        found = {"auc": "roc_auc"}
    else:
        back = inverse or (lambda c: c)
        at = at.select(split, back(F.col(y).cast("double")).alias("_y"), back(F.col("_s")).alias("_p"))
        per = regression_metrics(at, "_y", "_p", [split])
        found = {"rmse": "rmse", "mae": "mae", "r2": "r2"}
    stacked = ", ".join(f"concat(`{split}`, '_{name}'), CAST({c} AS double)" for name, c in found.items())
    rows = per.selectExpr(f"stack({len(found)}, {stacked}) AS (metric, value)")
    first = scored.sparkSession.createDataFrame([("best_iteration", float(best))], "metric string, value double")
    return first.unionByName(rows)
