"""Pluggable model set.

A model is a builder from feature expressions to a score expression.  Models
render to SQL expression text over named feature columns, so the same formula
runs in Spark (``F.expr`` -> Catalyst, whole-stage codegen, no Python) and in
the SQL oracle.  A model that cannot be written as an expression (a large
forest) instead returns a Spark Column from an Arrow ``pandas_udf``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.contract import FEATURES_V1


def fmt(x: float) -> str:
    """Exact SQL literal for a double (repr round-trips; typed as DOUBLE)."""
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        raise ValueError("non-finite model parameter")
    return f"CAST({x!r} AS DOUBLE)"


def feature_refs(prefix: str = "") -> list[str]:
    return [f"CAST({prefix}{n} AS DOUBLE)" for n in FEATURES_V1]


@dataclass
class SqlScorer:
    """A scorer defined by an SQL expression builder over the ordered feature refs."""

    build: Callable[[list[str]], str]

    def sql(self, x: list[str]) -> str:
        return self.build(x)

    def column(self, x: list[str]) -> Column:
        return F.expr(self.sql(x))


@dataclass
class ModelSet:
    """Isolation-forest decision, autoencoder reconstruction error, classifier P(y=1)."""

    if_decision: object  # .sql(x) -> str  or .column(x) -> Column
    ae_mse: object
    ae_threshold: float
    proba: object


def sigmoid_sql(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


def clip_sql(z: str, lo: float, hi: float) -> str:
    return f"least(greatest({z}, {fmt(lo)}), {fmt(hi)})"


def dot_sql(x: list[str], w: list[float], b: float) -> str:
    terms = " + ".join(f"({xi}) * {fmt(wi)}" for xi, wi in zip(x, w))
    return f"({terms} + {fmt(b)})"


class PandasModel:
    """A user model on the ordered (n, 7) feature matrix, run as an Arrow ``pandas_udf``.

    ``fn`` takes a float ndarray of shape (n, 7) (contract order) and returns
    n scores - e.g. ``lambda x: model.decision_function(x)`` or
    ``lambda x: model.predict_proba(x)[:, 1]``.  Rows travel in Arrow batches.
    """

    def __init__(self, fn):
        self.fn = fn

    def column(self, x: list[str]) -> Column:
        from pyspark.sql import types as T

        fn = self.fn

        @F.pandas_udf(T.DoubleType())
        def user_model(*cols: pd.Series) -> pd.Series:
            m = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            return pd.Series(np.asarray(fn(m), dtype=float).reshape(-1))

        return user_model(*[F.expr(c) if isinstance(c, str) else c for c in x])
