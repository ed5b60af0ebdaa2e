"""Autoencoder training (M3): 7-5-3-5-7, relu hidden layers, identity output, Adam.

Data-parallel epochs over fixed shards of the training sample: row i of the
sample order belongs to shard i mod (number of shards), and a shard holds at
most ``rows_per_shard`` rows, so the result depends on rows and seed and never
on the partitioning.  Weights and Adam moments (120 numbers each) go to every
task with the function; each shard runs mini-batch steps (squared error plus
L2 penalty) in ``mapInPandas`` and returns (rows, weights, moments, loss) -
one row per shard; the driver averages them by row count in shard order and
starts the next epoch.  Scaling is min-max fitted on the training part (A10); the
threshold is the 0.99 linear quantile of validation row MSE (A11).
Weights are not expected to equal any other implementation's; shape,
threshold rule and seed reproducibility are the contract.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import AE_LAYERS, AE_MAX_EPOCHS, AE_SAMPLE_SIZE, FEATURES_V1, SEED, TRAIN_FRACTION
from riskflow.models.params import AutoencoderParams, ae_apply
from riskflow.operators.evaluate import minmax_fit, minmax_transform, seeded_sample
from riskflow.operators.ordering import exact_quantiles, global_row_index
from riskflow.session import cut_lineage

LEARNING_RATE = 1e-3
BATCH_SIZE = 200
TOL = 1e-4
N_ITER_NO_CHANGE = 10
MIN_ROWS = 11
L2 = 1e-4
ROWS_PER_SHARD = 25_000


def _init(seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    flat = []
    for n_in, n_out in zip(AE_LAYERS[:-1], AE_LAYERS[1:]):
        bound = np.sqrt(6.0 / (n_in + n_out))
        flat.append(rng.uniform(-bound, bound, size=(n_in, n_out)))
        flat.append(rng.uniform(-bound, bound, size=n_out))
    return flat


def _flatten(ws: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in ws])


def _unflatten(v: np.ndarray) -> list[np.ndarray]:
    out, i = [], 0
    for n_in, n_out in zip(AE_LAYERS[:-1], AE_LAYERS[1:]):
        out.append(v[i:i + n_in * n_out].reshape(n_in, n_out))
        i += n_in * n_out
        out.append(v[i:i + n_out])
        i += n_out
    return out


def _forward(ws, x):
    acts = [x]
    h = x
    n_layers = len(ws) // 2
    for li in range(n_layers):
        z = h @ ws[2 * li] + ws[2 * li + 1]
        h = np.maximum(z, 0.0) if li < n_layers - 1 else z
        acts.append(h)
    return acts


def _grads(ws, x):
    acts = _forward(ws, x)
    n = len(x)
    delta = (acts[-1] - x) * (2.0 / (n * x.shape[1]))
    grads = [None] * len(ws)
    for li in range(len(ws) // 2 - 1, -1, -1):
        grads[2 * li] = acts[li].T @ delta
        grads[2 * li + 1] = delta.sum(axis=0)
        if li > 0:
            delta = (delta @ ws[2 * li].T) * (acts[li] > 0)
    loss = float(np.mean((acts[-1] - x) ** 2))
    return grads, loss


def _shard_epoch(state: dict, epoch: int, seed: int):
    """One epoch over the shards of a partition, each from the same weights and moments."""
    def one(shard: int, x: np.ndarray) -> dict:
        ws, m, v = (_unflatten(state[k].copy()) for k in ("w", "m", "v"))
        b1, b2, eps = 0.9, 0.999, 1e-8
        step, loss_sum = state["step"], 0.0
        order = np.random.default_rng([seed, epoch, shard]).permutation(len(x))
        for s in range(0, len(x), BATCH_SIZE):
            xb = x[order[s:s + BATCH_SIZE]]
            g, loss = _grads(ws, xb)
            step += 1
            for i in range(len(ws)):
                if i % 2 == 0:  # weights, not biases
                    g[i] = g[i] + L2 * ws[i] / len(xb)
                m[i] = b1 * m[i] + (1 - b1) * g[i]
                v[i] = b2 * v[i] + (1 - b2) * g[i] ** 2
                mh = m[i] / (1 - b1 ** step)
                vh = v[i] / (1 - b2 ** step)
                ws[i] = ws[i] - LEARNING_RATE * mh / (np.sqrt(vh) + eps)
            loss_sum += loss * len(xb)
        return {"shard": shard, "rows": len(x), "steps": step, "loss": loss_sum / len(x),
                "w": _flatten(ws).tolist(), "m": _flatten(m).tolist(), "v": _flatten(v).tolist()}

    def run(it):
        for pdf in it:
            for shard, flat in zip(pdf["_shard"], pdf["_x"]):
                yield pd.DataFrame([one(int(shard), np.asarray(flat, dtype=float).reshape(-1, AE_LAYERS[0]))])
    return run


EPOCH_SCHEMA = "shard long, rows long, steps long, loss double, w array<double>, m array<double>, v array<double>"


def fit_autoencoder(features: DataFrame, id_col: str = "event_id", sample_size: int = AE_SAMPLE_SIZE,
                    max_epochs: int = AE_MAX_EPOCHS, seed: int = SEED,
                    fraction: float = TRAIN_FRACTION, rows_per_shard: int = ROWS_PER_SHARD) -> tuple[AutoencoderParams, dict]:
    normal = features.where(F.col("isFraud") == 0) if "isFraud" in features.columns else features
    sample = seeded_sample(normal.select(id_col, *FEATURES_V1), id_col, sample_size, seed, min_rows=MIN_ROWS)
    sample = sample.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    idx = global_row_index(sample, ["_h", id_col], "_i")  # sample order
    n = idx.count()
    cut = int(fraction * n)
    if cut <= 0 or cut >= n:
        raise ValueError("Dataset is too small for train/validation split.")
    train = idx.where(F.col("_i") < cut)
    val = idx.where(F.col("_i") >= cut)
    mins, maxs = minmax_fit(train)
    sc = [f"{c}_s" for c in FEATURES_V1]
    shards = -(-cut // rows_per_shard)
    scaled = minmax_transform(train, mins, maxs, suffix="_s").select(
        (F.col("_i") % shards).alias("_shard"), F.struct("_i", F.array(*sc).alias("x")).alias("_r"))
    train_s = cut_lineage(scaled.repartition(shards, "_shard").groupBy("_shard").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["x"])).alias("_x")))
    start = _flatten(_init(seed))
    state = {"w": start, "m": np.zeros_like(start), "v": np.zeros_like(start), "step": 0}
    best, stall, losses = np.inf, 0, []
    for epoch in range(max_epochs):
        parts = sorted(train_s.mapInPandas(_shard_epoch(state, epoch, seed), EPOCH_SCHEMA).collect(), key=lambda p: p["shard"])
        total = sum(p["rows"] for p in parts)  # one row per shard
        state = {k: sum(np.array(p[k]) * p["rows"] for p in parts) / total for k in ("w", "m", "v")}
        state["step"] = max(p["steps"] for p in parts)
        loss = sum(p["loss"] * p["rows"] for p in parts) / total
        losses.append(loss)
        if loss > best - TOL:
            stall += 1
            if stall >= N_ITER_NO_CHANGE:
                break
        else:
            stall = 0
        best = min(best, loss)
    ws = _unflatten(state["w"])
    layers = [(ws[2 * i].tolist(), ws[2 * i + 1].tolist()) for i in range(len(ws) // 2)]
    net = AutoencoderParams(mins, maxs, layers, 0.0)
    scored = ae_apply(net, val, [f"CAST({c} AS DOUBLE)" for c in FEATURES_V1], "_mse")
    net.threshold = float(exact_quantiles(scored, "_mse", [0.99]).first()["q_0"])
    info = {"rows_normal": normal.count(), "rows_sample": n, "rows_train": cut, "rows_val": n - cut,
            "epochs": len(losses), "final_loss": losses[-1], "threshold_p99": net.threshold, "random_state": seed}
    return net, info
