import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import evaluate as EV


def _ap_bruteforce(y, s):
    # step-sum AP, equal scores form one threshold
    order = sorted(set(s), reverse=True)
    P = sum(y)
    if P == 0:
        return 0.0
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, si in zip(y, s) if si >= t and yi == 1)
        fp = sum(1 for yi, si in zip(y, s) if si >= t and yi == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_average_precision_with_ties(spark):
    rng = np.random.default_rng(7)
    s = [float(round(x, 1)) for x in rng.random(200)]
    y = [int(v) for v in (rng.random(200) < 0.3)]
    df = spark.createDataFrame(list(zip(s, y)), "s double, y int")
    r = EV.holdout_evaluation(df, "s", "y", 0.5).first()
    assert r["pr_auc"] == pytest.approx(_ap_bruteforce(y, s), rel=1e-12)
    tp = sum(1 for a, b in zip(s, y) if a >= 0.5 and b == 1)
    fp = sum(1 for a, b in zip(s, y) if a >= 0.5 and b == 0)
    assert r["tp"] == tp and r["fp"] == fp
    assert r["precision_at_0_5"] == pytest.approx(tp / (tp + fp))


def test_no_positives_gives_zero(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 0)], "s double, y int")
    r = EV.holdout_evaluation(df, "s", "y").first()
    assert r["pr_auc"] == 0.0 and r["recall_at_0_5"] == 0.0 and r["precision_at_0_5"] == 0.0


def test_promotion_check_strict_and_reasons(spark):
    m = spark.createDataFrame([(0.1, 0.2, 0.3)], "precision_at_0_5 double, recall_at_0_5 double, pr_auc double")
    r = EV.promotion_check(m, 0.2, 0.2, 0.4).first()
    assert not r["passed"]
    assert r["reasons"] == ("precision_at_0_5=0.100000 below min_precision=0.200000; "
                            "pr_auc=0.300000 below min_pr_auc=0.400000")
    ok = EV.promotion_check(m, 0.1, 0.2, 0.3).first()
    assert ok["passed"] and ok["reasons"] == ""


def test_budget_is_bankers_rounded_with_floor_of_one():
    assert EV.budget_size(200, 0.1) == 20
    assert EV.budget_size(25, 0.1) == 2  # 2.5 -> 2
    assert EV.budget_size(35, 0.1) == 4  # 3.5 -> 4
    assert EV.budget_size(3, 0.01) == 1


def test_alert_budget_ties_keep_arrival_order(spark):
    df = spark.createDataFrame([(i, 0.5 if i < 6 else 0.1) for i in range(20)], "id long, s double")
    got = [r["id"] for r in EV.alert_budget(df, "s", "id", 0.2).orderBy("alert_rank").collect()]
    assert got == [0, 1, 2, 3]


def test_adaptive_threshold_cases(spark):
    df = spark.createDataFrame([(i / 100.0,) for i in range(100)], "s double")
    r = EV.adaptive_threshold(df, "s", quantile=0.9, ceiling=0.8).first()
    assert r["threshold"] == pytest.approx(0.8)
    few = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "s double")
    r2 = EV.adaptive_threshold(few, "s", current_threshold=0.55, min_samples=10).first()
    assert r2["threshold"] == 0.55


def test_positional_split_disjoint_and_complete(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k")
    s = EV.positional_split(df, ["k"])
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 80, "validation": 21}
    with pytest.raises(ValueError):
        EV.positional_split(spark.range(0, 1), ["id"])


def test_seeded_sample_exact_and_repeatable(spark):
    df = spark.range(0, 1000)
    a = sorted(r[0] for r in EV.seeded_sample(df, "id", 100, 42).collect())
    b = sorted(r[0] for r in EV.seeded_sample(df, "id", 100, 42).collect())
    assert len(a) == 100 and a == b
    assert EV.seeded_sample(df, "id", 5000, 42).count() == 1000


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    w = {r["y"]: r["weight"] for r in EV.balanced_weights(df, "y").collect()}
    assert w == {0: pytest.approx(10 / 16), 1: pytest.approx(10 / 4)}


def test_evaluate_model_on_holdout_checks_columns(spark):
    import tempfile

    from conftest import SF_SMALL
    from riskflow.models.fixed import FIXED_LOGIT
    from riskflow.plans.model_queries import feats

    d = tempfile.mkdtemp(prefix="riskflow-hold-", dir="/tmp")
    feats(spark, SF_SMALL).write.parquet(f"{d}/ok")
    r = EV.evaluate_model_on_holdout(spark, FIXED_LOGIT, f"{d}/ok").first()
    assert 0.0 <= r["pr_auc"] <= 1.0 and r["rows_holdout"] == 1000
    feats(spark, SF_SMALL).drop("hour_of_day").write.parquet(f"{d}/no_feature")
    with pytest.raises(ValueError, match="missing required feature columns: \\['hour_of_day'\\]"):
        EV.evaluate_model_on_holdout(spark, FIXED_LOGIT, f"{d}/no_feature")
    feats(spark, SF_SMALL).drop("isFraud").write.parquet(f"{d}/no_label")
    with pytest.raises(ValueError, match="target column"):
        EV.evaluate_model_on_holdout(spark, FIXED_LOGIT, f"{d}/no_label")


def test_nan_and_missing_scores_are_no_hits(spark):
    from riskflow.operators.evaluate import confusion_at, holdout_evaluation

    df = spark.createDataFrame([(0.9, 1), (float("nan"), 0), (None, 1), (0.1, 0)], "s double, y int")
    for r in (confusion_at(df, "s", "y").first(), holdout_evaluation(df, "s", "y").first()):
        assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)


def test_quantiles_of_nothing_keep_one_row(spark):
    from riskflow.operators.evaluate import adaptive_threshold
    from riskflow.operators.profile import amount_stats

    none = spark.createDataFrame([], "amount double")
    assert tuple(amount_stats(none).collect()[0]) == (None,) * 5
    assert adaptive_threshold(none, "amount", current_threshold=0.4).first()["threshold"] == 0.4


def test_budget_against_sorted_rows(spark):
    """Ties at the cut, NaN (first), missing scores (last), a budget of all rows, and no rows."""
    import math
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice([0.9, 0.5, 0.5, 0.5, 0.1, -0.0, 0.0, float("nan"), None]), rng.choice([0, 1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s double, y int")

    def place(r):
        none, nan = r[1] is None, r[1] is not None and math.isnan(r[1])
        return (2 if none else 0 if nan else 1, 0.0 if none or nan else -r[1], r[0])

    want = sorted(rows, key=place)
    for ratio in (0.001, 0.05, 0.3, 0.95, 1.0):
        k = EV.budget_size(300, ratio)
        got = [r["id"] for r in EV.alert_budget(df, "s", "id", ratio).orderBy("alert_rank").collect()]
        assert got == [r[0] for r in want[:k]]
        q = EV.quality_at_budget(df, "s", "id", "y", ratio).first()
        assert (q["alerts_sent"], q["tp"]) == (k, sum(r[2] == 1 for r in want[:k]))
        assert q["positives"] == sum(r[2] == 1 for r in rows)
    assert EV.alert_budget(df.limit(0), "s", "id", 0.1).count() == 0
    assert tuple(EV.quality_at_budget(df.limit(0), "s", "id", "y", 0.1).first()) == (0, 0, 0, 0.0, 0.0)
