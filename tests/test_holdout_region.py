"""Chains judged inside regions of weights, and exact measures of many models, against one model after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskflow.contract import FEATURES_V1
from riskflow.models.base import feature_refs
from riskflow.models.fixed import FIXED_LOGIT
from riskflow.models.params import LogitParams
from riskflow.models.registry import ModelRegistry
from riskflow.operators import evaluate as EV
from riskflow.operators import feedback as FB
from riskflow.plans.model_queries import feats
from riskflow.streaming import holdout_region as HR
from riskflow.streaming import update_chain as UC

START = LogitParams(list(FIXED_LOGIT.weights), FIXED_LOGIT.bias, version=0)
LR, BATCHES = 1e-4, 14


@pytest.fixture(scope="module")
def holdout(spark):
    return feats(spark, SF_SMALL).select(*FEATURES_V1, "isFraud").cache()


@pytest.fixture(scope="module")
def numbered(spark):
    rnd = random.Random(8)
    rows = [(i, int(rnd.random() < 0.5 + 0.4 * (-1) ** (i // 30)), *[float(v) for v in (rnd.expovariate(1 / 150), rnd.random(), rnd.gauss(0, 40), rnd.randint(0, 1), rnd.randint(0, 1), rnd.randint(0, 23), rnd.randint(1, 3))])
            for i in range(15 * BATCHES - 4)]
    return FB.cut_batches(spark.createDataFrame(rows, "event_id long, y int, " + ", ".join(f"{c} double" for c in FEATURES_V1)).repartition(3), "event_id", 15)


def measured(x, y, m):
    """Precision and recall at 0.5 and average precision of one model, row after row."""
    p = 1 / (1 + np.exp(-(x @ np.array(m.weights) + m.bias)))
    hit, tp = p >= 0.5, int(((p >= 0.5) & y).sum())
    ap = sum((p[y & (p == v)]).size * y[p >= v].sum() / (p >= v).sum() for v in np.unique(p[y]))
    return tp / hit.sum() if hit.any() else 0.0, tp / y.sum(), ap / y.sum()


@pytest.fixture(scope="module")
def arrays(holdout, numbered):
    h = holdout.toPandas()
    return h[FEATURES_V1].to_numpy(float), h["isFraud"].to_numpy() == 1, numbered.orderBy("event_id").toPandas()


def one_by_one(arrays, minimums):
    x, y, fed = arrays
    live, out = START, []
    for b, rows in fed.groupby("batch_no"):
        bx, by = rows[FEATURES_V1].to_numpy(float), rows["y"].to_numpy(float)
        w = np.array(live.weights)
        err = 1 / (1 + np.exp(-(bx @ w + live.bias))) - by
        cand = LogitParams(list(w - LR * (err @ bx / len(by) + UC.ALPHA * w)), live.bias - LR * err.mean(), version=live.version + 1)
        got = measured(x, y, cand)
        ok = all(v >= minimums[k] for v, k in zip(got, ("precision", "recall", "pr_auc"), strict=True))
        out.append((b, len(by), cand, ok, got))
        live = cand if ok else live
    return out


def flips(chain):
    return sum(a[3] != b[3] for a, b in zip(chain, chain[1:], strict=False))


def a_minimum_that_flips(arrays, which):
    """Minimums under which the chain goes most often between passing and failing."""
    free = one_by_one(arrays, {"precision": 0.0, "recall": 0.0, "pr_auc": 0.0})
    of = lambda v: {"precision": 0.0, "recall": 0.0, "pr_auc": 0.0} | {which: v}
    i = ("precision", "recall", "pr_auc").index(which)
    most = max({r[4][i] for r in free}, key=lambda v: flips(one_by_one(arrays, of(v * 0.9999))))
    return of(most * 0.9999)


def same(got, want):
    assert [(b, n, c.version, ok) for b, n, c, ok in got] == [(b, n, c.version, ok) for b, n, c, ok, _ in want]
    for (_, _, c, _), (_, _, w, _, _) in zip(got, want, strict=True):
        assert c.weights == pytest.approx(w.weights, rel=1e-9) and c.bias == pytest.approx(w.bias, rel=1e-9)


def test_changes_of_the_outcome_cost_no_pass_over_the_holdout(spark, holdout, numbered, arrays, monkeypatch):
    """Before, every change between passing and failing read the holdout again."""
    packed, asked, regions = UC.packed_batches(numbered), [], []
    one, region = UC.passes, UC.region_window
    monkeypatch.setattr(UC, "passes", lambda *a: asked.append(1) or one(*a))
    monkeypatch.setattr(UC, "region_window", lambda *a: regions.append(1) or region(*a))
    minimums = a_minimum_that_flips(arrays, "precision")
    want = one_by_one(arrays, minimums)
    assert flips(want) >= 2
    same([x for w in UC.run_chain(packed, BATCHES, START, LR, holdout, minimums) for x in w], want)
    assert not asked and len(regions) < flips(want)
    monkeypatch.setattr(HR, "WINDOW_ROWS", 50)  # several regions
    same([x for w in UC.run_chain(packed, BATCHES, START, LR, holdout, minimums) for x in w], want)
    assert not asked
    monkeypatch.setattr(HR, "OPEN_ROWS", -1)  # no region: by windows
    same([x for w in UC.run_chain(packed, BATCHES, START, LR, holdout, minimums) for x in w], want)
    assert asked


def test_the_average_precision_is_checked_for_all_candidates(spark, holdout, numbered, arrays, monkeypatch):
    monkeypatch.setattr(HR, "GROUP", 4)
    minimums = a_minimum_that_flips(arrays, "pr_auc")
    want = one_by_one(arrays, minimums)
    assert 0 < sum(r[3] for r in want) < BATCHES
    same([x for w in UC.run_chain(UC.packed_batches(numbered), BATCHES, START, LR, holdout, minimums) for x in w], want)


def odd(holdout):
    """Some rows with a null, a NaN or an infinity, of both labels, and some that all models score alike."""
    x, k = F.col(FEATURES_V1[0]), F.pmod(F.hash(*FEATURES_V1), F.lit(12))
    some = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.lit(float("-inf"))).when(k == 4, F.lit(1e9)).otherwise(x)
    return holdout.withColumn("isFraud", F.when(F.pmod(F.hash(x), F.lit(7)) == 0, 1).otherwise(F.col("isFraud"))).withColumn(FEATURES_V1[0], some).cache()


def near(rnd, n, by):
    return [LogitParams([w * rnd.uniform(1 - by, 1 + by) for w in FIXED_LOGIT.weights], FIXED_LOGIT.bias + rnd.uniform(-by, by)) for _ in range(n)]


def test_measures_of_many_models(spark, holdout, monkeypatch):
    for data in (holdout, odd(holdout)):
        rows = HR.packed_rows(data)
        of = HR.totals(rows)
        assert of["n"] + of["nulls"] + of["nans"] == data.count()
        models = near(random.Random(9), 9, 0.05)
        got, bounds = HR.measures(rows, of, models), HR.ap_bounds(HR.ap_counts(rows, [HR.box_of(np.array([HR.vector(m) for m in models]))])[0], of)
        for m, g in zip(models, got, strict=True):
            w = EV.holdout_evaluation(data.withColumn("_s", F.expr(m.sql(feature_refs()))), "_s", "isFraud").first()
            assert g[:2] == (w["precision_at_0_5"], w["recall_at_0_5"]) and g[2] == pytest.approx(w["pr_auc"], rel=1e-12)
            assert bounds[0] <= g[2] <= bounds[1]
        assert UC.measured(data, rows, of, models) == got
    with monkeypatch.context() as m:
        m.setattr(HR, "KEPT_ROWS", 3)  # too many to be held: over ranges
        assert HR.measures(rows, of, models) is None
        for a, b in zip(UC.measured(data, rows, of, models[:2]), got[:2], strict=True):
            assert a == pytest.approx(b, rel=1e-12)


def test_versions_saved_together(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path))
    reg.save_all("m", "logistic", [(v, {"v": v}) for v in range(1, 6)])
    assert len(list(tmp_path.rglob("*.parquet"))) == 1  # before, a folder and a file a version
    reg.save_all("m", "logistic", [(v, {"v": -v}) for v in range(2, 4)])
    reg.save("m", 3, "logistic", {"v": 0})
    assert reg.versions("m") == [1, 2, 3, 4, 5] and reg.live_version("m") == 5
    assert [reg.load("m", v)["params"]["v"] for v in range(1, 6)] == [1, -2, 0, 4, 5]
    with pytest.raises(FileNotFoundError):
        reg.load("m", 9)
