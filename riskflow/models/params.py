"""Model parameter families, rendered as SQL expressions (M2, M4, M6).

* :class:`LogitParams`  P(y=1) = sigmoid(w . x + b)
* :class:`AutoencoderParams` min-max scaling, relu hidden layers, identity
  output; score input is the row MSE between the scaled input and its
  reconstruction.  Rendered layer by layer (:meth:`layer_sql`) so each layer
  is its own projection and no expression is inlined exponentially.
* :class:`ForestParams` isolation forest as node arrays; small forests render
  to nested CASE, large ones are scored by an Arrow UDF (see iforest.py).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from riskflow.models.base import dot_sql, fmt, sigmoid_sql

EULER_GAMMA = 0.5772156649015329


def average_path_length(n: float) -> float:
    """c(n): expected path length of an unsuccessful BST search (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


@dataclass
class LogitParams:
    weights: list[float]
    bias: float
    version: int = 0

    def sql(self, x: list[str]) -> str:
        return sigmoid_sql(dot_sql(x, self.weights, self.bias))

    def margin_sql(self, x: list[str]) -> str:
        return dot_sql(x, self.weights, self.bias)


@dataclass
class AutoencoderParams:
    mins: list[float]
    maxs: list[float]
    layers: list[tuple[list[list[float]], list[float]]]  # (W[in][out], b[out])
    threshold: float

    def scaled_sql(self, x: list[str]) -> list[str]:
        out = []
        for xi, lo, hi in zip(x, self.mins, self.maxs):
            rng = hi - lo
            scale = rng if rng != 0.0 else 1.0
            out.append(f"(({xi}) - {fmt(lo)}) / {fmt(scale)}")
        return out

    def layer_sql(self, i: int, inputs: list[str]) -> list[str]:
        w, b = self.layers[i]
        last = i == len(self.layers) - 1
        outs = []
        for j in range(len(b)):
            z = dot_sql(inputs, [w[k][j] for k in range(len(inputs))], b[j])
            outs.append(z if last else f"greatest({z}, 0.0)")
        return outs

    def mse_sql(self, scaled: list[str], recon: list[str]) -> str:
        sq = [f"(({r}) - ({s})) * (({r}) - ({s}))" for r, s in zip(recon, scaled)]
        return f"(({' + '.join(sq)}) / {fmt(len(sq))})"

    def apply(self, df, x: list[str], name: str):
        return ae_apply(self, df, x, name)

    def sql(self, x: list[str]) -> str:
        """Single-expression form (small nets only; prefer the staged form)."""
        h = self.scaled_sql(x)
        scaled = h
        for i in range(len(self.layers)):
            h = self.layer_sql(i, h)
        return self.mse_sql(scaled, h)


@dataclass
class ForestParams:
    """Trees as parallel arrays; children -1 marks a leaf."""

    feature: list[list[int]]
    threshold: list[list[float]]
    left: list[list[int]]
    right: list[list[int]]
    n_samples: list[list[int]]
    max_samples: int
    offset: float
    depth_cap: list[int] = field(default_factory=list)

    def path_sql(self, t: int, x: list[str]) -> str:
        def node(i: int, depth: int) -> str:
            if self.left[t][i] < 0:
                return fmt(depth + average_path_length(self.n_samples[t][i]))
            f = self.feature[t][i]
            return (f"CASE WHEN {x[f]} <= {fmt(self.threshold[t][i])} THEN {node(self.left[t][i], depth + 1)} "
                    f"ELSE {node(self.right[t][i], depth + 1)} END")

        return node(0, 0)

    def score_samples_sql(self, x: list[str]) -> str:
        mean = " + ".join(f"({self.path_sql(t, x)})" for t in range(len(self.feature)))
        c = average_path_length(self.max_samples)
        return f"(-power(2.0, -((({mean}) / {fmt(len(self.feature))}) / {fmt(c)})))"

    def sql(self, x: list[str]) -> str:
        """Decision function = score_samples - offset."""
        return f"({self.score_samples_sql(x)} - {fmt(self.offset)})"


def ae_apply(params: AutoencoderParams, df, x: list[str], name: str):
    """Add the reconstruction MSE as column ``name``, one projection per layer.

    Each layer's units are materialised as columns behind a fence, so a unit's
    expression is written once and referenced by name in the next layer.
    """
    from pyspark.sql import functions as F

    from riskflow.functions.plan import fence

    tmp: list[str] = []
    scaled = [f"_ae_s{i}" for i in range(len(x))]
    d = fence(df.select("*", *[F.expr(e).alias(n) for e, n in zip(params.scaled_sql(x), scaled)]))
    tmp += scaled
    prev = scaled
    for li in range(len(params.layers)):
        names = [f"_ae_l{li}_{j}" for j in range(len(params.layers[li][1]))]
        d = fence(d.select("*", *[F.expr(e).alias(n) for e, n in zip(params.layer_sql(li, prev), names)]))
        tmp += names
        prev = names
    d = d.withColumn(name, F.expr(params.mse_sql(scaled, prev)))
    return d.drop(*tmp)
