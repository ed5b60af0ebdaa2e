"""Closed-form demo models (M8), as pure expressions.

Fixed values: forest decision -(amount - 100) / 100; scaler x / 1000; the
autoencoder reconstructs every scaled feature except the first, which it caps
at 0.12; reconstruction threshold 0.01; classifier P(y=1) =
clip(0.1 + 0.8 * clip(amount / 1000, 0, 1), 0, 1).
"""

from __future__ import annotations

from riskflow.models.base import ModelSet, SqlScorer, clip_sql, fmt

DEMO_AE_THRESHOLD = 0.01
DEMO_AE_CAP = 0.12
DEMO_SCALE = 1000.0


def _if(x: list[str]) -> str:
    return f"(-(({x[0]}) - {fmt(100.0)}) / {fmt(100.0)})"


def _ae(x: list[str]) -> str:
    scaled = [f"(({xi}) / {fmt(DEMO_SCALE)})" for xi in x]
    recon = [f"least({scaled[0]}, {fmt(DEMO_AE_CAP)})"] + scaled[1:]
    sq = [f"(({r}) - ({s})) * (({r}) - ({s}))" for r, s in zip(recon, scaled)]
    return f"(({' + '.join(sq)}) / {fmt(len(x))})"


def _proba(x: list[str]) -> str:
    a = clip_sql(f"({x[0]}) / {fmt(DEMO_SCALE)}", 0.0, 1.0)
    return clip_sql(f"{fmt(0.1)} + {fmt(0.8)} * {a}", 0.0, 1.0)


def demo_models() -> ModelSet:
    return ModelSet(
        if_decision=SqlScorer(_if),
        ae_mse=SqlScorer(_ae),
        ae_threshold=DEMO_AE_THRESHOLD,
        proba=SqlScorer(_proba),
    )
