"""Pipeline steps that fit, save and load with Spark ML (L1): schema validator, category fill, feature
engineer and selector, in the order that a configuration gives them."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators import features, ml, quality


class _Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "the columns or names the step works on", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def names(self) -> list[str]:
        return self.getOrDefault(self.columns)


class SchemaValidator(_Step):
    """``columns`` as ``name`` or ``name:type`` must be there, of that Spark type."""

    def _transform(self, df: DataFrame) -> DataFrame:
        wanted = [c.partition(":") for c in self.names()]
        quality.require_columns(df, [name for name, _, _ in wanted])
        wrong = {name: df.schema[name].dataType.simpleString() for name, _, kind in wanted
                 if kind and df.schema[name].dataType.simpleString() != kind}
        if wrong:
            raise ValueError(f"columns of another type than configured: {wrong}")
        return df


class CategoryFill(_Step):
    """P12 over ``columns``: a null category becomes ``missing``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return features.fill_categorical_missing(df, self.names())


class FeatureEngineer(_Step):
    """R2: the named feature operators, in order."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return features.apply_operators(df, self.names())


class FeatureSelector(_Step):
    """``columns``, and of the others only those in ``keep`` that the table has (label, key, weight)."""
    keep = Param(Params._dummy(), "keep", "columns that pass through if present", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns: list[str] | None = None, keep: list[str] | None = None):
        super(_Step, self).__init__()
        self._setDefault(keep=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        more = [c for c in self.getOrDefault(self.keep) if c in df.columns and c not in self.names()]
        return features.select_features(df, [*self.names(), *more])


STEPS = {"validate": SchemaValidator, "fill": CategoryFill, "engineer": FeatureEngineer, "select": FeatureSelector}


def build_pipeline(steps: list[tuple[str, list[str]]], categorical: list[str], numeric: list[str], label: str,
                   task: str = "classification", keep: list[str] | tuple = (), **params) -> Pipeline:
    """L1: the configured steps in the given order, then the learner's own stages.

    ``steps`` are (name, columns) pairs; an unknown name raises.  ``keep`` passes the selector
    beside the label."""
    stages = []
    for name, columns in steps:
        if name not in STEPS:
            raise KeyError(f"unknown pipeline step {name!r}; known: {sorted(STEPS)}")
        more = {"keep": [label, *keep]} if name == "select" else {}
        stages.append(STEPS[name](columns=list(columns), **more))
    return Pipeline(stages=[*stages, *ml.feature_pipeline(categorical, numeric, label, task, **params).getStages()])


def scores_equal(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """``n_rows, n_different``: rows of either side whose score differs or that the other lacks."""
    both = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key, "full")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_different"))
