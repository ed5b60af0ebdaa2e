"""Isolation forest training (M1) and scoring (M2) as Spark jobs (Liu, Ting, Zhou 2008).

Fit:
  1. normal rows, seeded sample of at most ``sample_size`` rows (K3);
  2. per tree, the ``max_samples`` rows with the smallest seeded hash of
     (row id, tree) - an exact, repeatable subsample without replacement.
     Rows are pre-filtered on that same hash (~4 x max_samples candidates a
     tree), which keeps the smallest ones whatever the table's size; a tree left
     short is redrawn from all rows by the same order;
  3. ``groupBy(tree).applyInPandas`` grows each tree (random feature, uniform
     split, height limit ceil(log2(max_samples))) -> node table;
  4. offset = linear ``contamination`` quantile of the training scores.
Score: decision = score_samples - offset, score_samples = -2^(-E[h(x)] / c(psi)),
with a vectorised NumPy traversal in an Arrow ``pandas_udf``; the node arrays
(n_trees x 2 * max_samples entries, bounded by parameters, not data) travel
with the function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.contract import FEATURES_V1, IF_CONTAMINATION, IF_SAMPLE_SIZE, IF_SUBSAMPLE, IF_TREES, SEED
from riskflow.models.params import ForestParams, average_path_length
from riskflow.operators.evaluate import seeded_sample
from riskflow.operators.ordering import exact_quantiles

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, n_samples long"


def _grow(x: np.ndarray, rng: np.random.Generator, height_limit: int):
    feature, threshold, left, right, n_samples = [], [], [], [], []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        n_samples.append(int(len(idx)))
        if depth >= height_limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] <= t
        feature[me], threshold[me] = f, t
        left[me] = build(idx[mask], depth + 1)
        right[me] = build(idx[~mask], depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return feature, threshold, left, right, n_samples


def _tree_builder(seed: int, height_limit: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_h", kind="stable")[FEATURES_V1].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        f, t, l, r, n = _grow(x, rng, height_limit)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f), dtype="int32"), "feature": f,
                             "threshold": t, "left": l, "right": r, "n_samples": n})
    return build


def tree_samples(train: DataFrame, id_col: str, n_trees: int, psi: int, n_train: int, seed: int,
                 spare: float = 4.0) -> DataFrame:
    """For each tree the ``psi`` rows with the smallest seeded hash: the rows, ``tree`` and ``_h``.

    Each row's trees are chosen inside one higher-order expression, so only
    about ``spare`` x psi (row, tree) pairs a tree are ever materialised.
    """
    h = lambda t: F.xxhash64(F.col(id_col), F.lit(seed), t)
    keep = min(1.0, spare * psi / n_train)
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    if keep < 1.0:
        cut = -(1 << 63) + int(keep * (1 << 64))
        trees = F.filter(trees, lambda t: h(t) < F.lit(cut))
    w = Window.partitionBy("tree").orderBy("_h", id_col)

    def smallest(trees: Column) -> DataFrame:
        d = train.select("*", F.explode(trees).alias("tree")).withColumn("_h", h(F.col("tree")))
        return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r")

    picked = smallest(trees)
    full = {r["tree"] for r in picked.groupBy("tree").count().where(F.col("count") >= psi).collect()}
    short = [t for t in range(n_trees) if t not in full]
    if short and keep < 1.0:  # too few rows passed the pre-filter: those trees choose among all rows
        picked = picked.where(~F.col("tree").isin(short)).unionByName(smallest(F.array(*[F.lit(t) for t in short])))
    return picked


def fit_isolation_forest(features: DataFrame, id_col: str = "event_id", n_trees: int = IF_TREES,
                         max_samples: int = IF_SUBSAMPLE, contamination: float = IF_CONTAMINATION,
                         sample_size: int = IF_SAMPLE_SIZE, seed: int = SEED) -> tuple[ForestParams, dict]:
    label = F.col("isFraud") == 0 if "isFraud" in features.columns else F.lit(True)
    totals = features.agg(F.count(F.lit(1)).alias("rows"), F.count_if(label).alias("normal")).first()
    normal = features.where(label)
    train = seeded_sample(normal.select(id_col, *FEATURES_V1), id_col, sample_size, seed)
    n_train = min(sample_size, int(totals["normal"]))
    psi = min(max_samples, n_train)
    height = int(math.ceil(math.log2(max(psi, 2))))
    picked = tree_samples(train.select(id_col, *FEATURES_V1), id_col, n_trees, psi, n_train, seed).cache()
    nodes = picked.groupBy("tree").applyInPandas(_tree_builder(seed, height), NODE_SCHEMA)
    rows = nodes.orderBy("tree", "node").collect()  # n_trees x <= 2 * psi rows: bounded by parameters
    picked.unpersist()
    forest = ForestParams([[] for _ in range(n_trees)], [[] for _ in range(n_trees)], [[] for _ in range(n_trees)],
                          [[] for _ in range(n_trees)], [[] for _ in range(n_trees)], psi, 0.0)
    for r in rows:
        t = r["tree"]
        forest.feature[t].append(r["feature"])
        forest.threshold[t].append(r["threshold"])
        forest.left[t].append(r["left"])
        forest.right[t].append(r["right"])
        forest.n_samples[t].append(r["n_samples"])
    scored = train.withColumn("_s", ForestUDF(forest, samples_only=True).column([F.col(c) for c in FEATURES_V1]))
    q = exact_quantiles(scored, "_s", [contamination]).first()
    forest.offset = float(q["q_0"])
    info = {"rows_total": int(totals["rows"]), "rows_normal": int(totals["normal"]), "rows_train": n_train,
            "sample_size_requested": sample_size, "max_samples": psi, "n_trees": n_trees,
            "contamination": contamination, "random_state": seed, "offset": forest.offset}
    return forest, info


class ForestUDF:
    """Arrow UDF scorer for a trained forest (decision function by default)."""

    def __init__(self, forest: ForestParams, samples_only: bool = False):
        self.forest = forest
        self.samples_only = samples_only

    def column(self, x) -> Column:
        f = self.forest
        width = max(len(t) for t in f.feature)
        pad = lambda rows, fill: np.array([r + [fill] * (width - len(r)) for r in rows])
        feat, thr = pad(f.feature, -1).astype(np.int64), pad(f.threshold, 0.0).astype(float)
        left, right = pad(f.left, -1).astype(np.int64), pad(f.right, -1).astype(np.int64)
        leaf_len = np.vectorize(average_path_length)(pad(f.n_samples, 0).astype(float))
        c_psi = average_path_length(f.max_samples)
        offset = 0.0 if self.samples_only else f.offset
        n_trees = len(f.feature)

        @F.pandas_udf(T.DoubleType())
        def forest_score(*cols: pd.Series) -> pd.Series:
            xm = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            n = len(xm)
            rows = np.arange(n)
            total = np.zeros(n)
            for t in range(n_trees):
                node = np.zeros(n, dtype=np.int64)
                depth = np.zeros(n)
                while True:
                    internal = left[t, node] >= 0
                    if not internal.any():
                        break
                    go_left = xm[rows, np.maximum(feat[t, node], 0)] <= thr[t, node]
                    nxt = np.where(go_left, left[t, node], right[t, node])
                    node = np.where(internal, nxt, node)
                    depth += internal
                total += depth + leaf_len[t, node]
            return pd.Series(-np.power(2.0, -(total / n_trees) / c_psi) - offset)

        cols = [F.expr(c) if isinstance(c, str) else c for c in x]
        return forest_score(*cols)
