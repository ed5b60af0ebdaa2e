"""Verdicts by groups of candidates: bounds hold every candidate, and what they leave open is judged one by one."""

import random

import numpy as np

from conftest import SF_SMALL
from riskflow.contract import FEATURES_V1
from riskflow.models.fixed import FIXED_LOGIT
from riskflow.models.params import LogitParams
from riskflow.plans.model_queries import feats
from riskflow.streaming import update_chain as UC


def near(rnd, n, by):
    return [LogitParams([w * rnd.uniform(1 - by, 1 + by) for w in FIXED_LOGIT.weights], FIXED_LOGIT.bias + rnd.uniform(-by, by)) for _ in range(n)]


def test_group_bounds_hold_all_candidates(spark):
    holdout = feats(spark, SF_SMALL).select(*FEATURES_V1, "isFraud").cache()
    rnd = random.Random(4)
    groups = [near(rnd, 5, by) for by in (1e-6, 1e-3, 0.3)]
    rows = UC.group_counts(holdout, groups).collect()
    widths = []
    for i, g in enumerate(groups):
        b = UC.group_bounds(*np.array([[r["lo"], r["hi"], r["pos"], r["neg"]] for r in rows if r["grp"] == i]).T)
        for r in UC.exact(holdout, g).collect():
            for k, c in (("precision", "precision_at_0_5"), ("recall", "recall_at_0_5"), ("pr_auc", "pr_auc")):
                assert b[k][0] <= r[c] * (1 + 1e-12) and r[c] <= b[k][1] * (1 + 1e-12)
        widths.append(b["pr_auc"][1] - b["pr_auc"][0])
    assert widths[0] < 0.05 and widths[0] <= widths[1] <= widths[2]


def test_a_window_of_like_candidates_is_judged_without_looking_at_each(spark, monkeypatch):
    holdout = feats(spark, SF_SMALL).select(*FEATURES_V1, "isFraud").cache()
    models = near(random.Random(5), 40, 1e-6)
    ap = next(r["pr_auc"] for r in UC.exact(holdout, models[:1]).collect())
    asked = []
    one = UC._passes
    monkeypatch.setattr(UC, "_passes", lambda h, m, *a: asked.append(len(m)) or one(h, m, *a))
    low = {"precision": 0.0, "recall": 0.0, "pr_auc": ap / 2}
    assert UC.passes(holdout, models, low) == [True] * 40 and UC.passes(holdout, models, low | {"pr_auc": min(1.0, ap * 1.2)}) == [False] * 40
    assert not asked
    least = {"precision": 0.0, "recall": 0.0, "pr_auc": sorted(r["pr_auc"] for r in UC.exact(holdout, models).collect())[20]}
    want = [r["pr_auc"] >= least["pr_auc"] for r in sorted(UC.exact(holdout, models).collect(), key=lambda r: r["cand"])]
    assert UC.passes(holdout, models, least) == want and asked == [40]


def test_exact_measures_over_ranges_of_the_score(spark, monkeypatch):
    """Several ranges and chunks, rows scored alike, NaN and null, against the measures of one model after another."""
    from pyspark.sql import functions as F

    from riskflow.models.base import feature_refs
    from riskflow.operators import evaluate as EV

    monkeypatch.setattr(UC, "RANGE_ROWS", 90)
    monkeypatch.setattr(UC, "CHUNK", 2)
    x, k = F.col(FEATURES_V1[0]), F.monotonically_increasing_id() % 10
    odd = F.when(k == 0, F.lit(1e9)).when(k == 1, F.lit(None)).when(k == 2, F.lit(float("nan"))).otherwise(x)
    holdout = feats(spark, SF_SMALL).select(*FEATURES_V1, "isFraud").withColumn(FEATURES_V1[0], odd).cache()
    models = near(random.Random(6), 3, 1e-3)
    got = {r["cand"]: r for r in UC.exact(holdout, models).collect()}
    for i, m in enumerate(models):
        w = EV.holdout_evaluation(holdout.withColumn("_s", F.expr(m.sql(feature_refs()))), "_s", "isFraud").first()
        assert abs(got[i]["pr_auc"] - w["pr_auc"]) < 1e-12
        assert (got[i]["precision_at_0_5"], got[i]["recall_at_0_5"]) == (w["precision_at_0_5"], w["recall_at_0_5"])
    assert UC.exact(holdout.limit(0), models).count() == 0
