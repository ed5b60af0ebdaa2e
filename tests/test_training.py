import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskflow.contract import FEATURES_V1
from riskflow.models.autoencoder import fit_autoencoder
from riskflow.models.iforest import ForestUDF, fit_isolation_forest
from riskflow.models.logit import train_logit
from riskflow.models.params import average_path_length
from riskflow.models.registry import ModelRegistry
from riskflow.plans.model_queries import SPLIT_ORDER, feats


@pytest.fixture(scope="module")
def features(spark):
    return feats(spark, SF_SMALL).cache()


def test_average_path_length():
    assert average_path_length(1) == 0.0 and average_path_length(2) == 1.0
    assert average_path_length(256) == pytest.approx(10.244770920116851, rel=1e-9)


def test_isolation_forest_shape_and_seed(spark, features):
    f1, info = fit_isolation_forest(features, n_trees=20, max_samples=64)
    f2, _ = fit_isolation_forest(features, n_trees=20, max_samples=64)
    assert f1.threshold == f2.threshold and f1.offset == f2.offset  # same seed, same forest
    assert info["max_samples"] == 64 and len(f1.feature) == 20
    for t in range(20):
        assert f1.n_samples[t][0] == 64
        # every leaf count adds up to the root count
        leaves = [n for n, l in zip(f1.n_samples[t], f1.left[t]) if l < 0]
        assert sum(leaves) == 64
    d = features.withColumn("d", ForestUDF(f1).column([F.col(c) for c in FEATURES_V1]))
    frac = d.agg(F.avg((F.col("d") < 0).cast("double"))).first()[0]
    assert 0.0 <= frac < 0.05


def test_autoencoder_threshold_and_seed(spark, features):
    n1, i1 = fit_autoencoder(features, max_epochs=3)
    n2, _ = fit_autoencoder(features, max_epochs=3)
    assert n1.threshold > 0 and n1.threshold == pytest.approx(n2.threshold, rel=1e-12)
    assert [len(b) for _, b in n1.layers] == [5, 3, 5, 7]
    assert i1["rows_train"] + i1["rows_val"] == i1["rows_sample"]


def test_autoencoder_needs_rows(spark, features):
    with pytest.raises(ValueError):
        fit_autoencoder(features.limit(5), max_epochs=1)


def test_logit_trains_and_reports(spark, features):
    params, metrics = train_logit(features, SPLIT_ORDER)
    m = metrics.first()
    assert len(params.weights) == 7
    assert m["rows_train"] + m["rows_val"] == features.count()
    assert 0.0 <= m["val_pr_auc"] <= 1.0


def test_logit_missing_column(spark, features):
    with pytest.raises(ValueError, match="Missing required columns"):
        train_logit(features.drop("hour_of_day"), SPLIT_ORDER)


def test_registry_roundtrip_and_run_log(spark):
    root = tempfile.mkdtemp(prefix="riskflow-reg-", dir="/tmp")
    reg = ModelRegistry(spark, root)
    assert reg.validate(["logit"]) == {"logit": False}
    with pytest.raises(FileNotFoundError):
        reg.require(["logit"])
    reg.save("logit", 1, "logistic", {"weights": [1.0] * 7, "bias": 0.0})
    reg.save("logit", 2, "logistic", {"weights": [2.0] * 7, "bias": 0.0})
    reg.set_live("logit", 1)
    assert reg.load("logit")["params"]["weights"][0] == 1.0
    assert reg.versions("logit") == [1, 2]
    run = reg.log_run("logit", "r1", {"a": 1, "b": None, "c": [1, 2], "d": True}, {"m": 0.5, "ok": True, "s": "x"}).first()
    assert run["params"] == {"a": "1", "c": "[1, 2]", "d": "True"}
    assert run["metrics"] == {"m": 0.5, "ok": 1.0}


def test_model_set_round_trip_scores_the_same(spark, features):
    from riskflow.models.base import ModelSet
    from riskflow.models.registry import load_model_set, save_model_set
    from riskflow.operators.scoring import score

    forest, _ = fit_isolation_forest(features, n_trees=10, max_samples=32)
    net, _ = fit_autoencoder(features, max_epochs=2)
    logit, _ = train_logit(features, SPLIT_ORDER)
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="riskflow-set-", dir="/tmp"))
    save_model_set(reg, 1, forest, net, logit)
    loaded = load_model_set(reg)
    direct = ModelSet(if_decision=ForestUDF(forest), ae_mse=net, ae_threshold=net.threshold, proba=logit)
    a = score(features, direct).select("event_id", F.col("ensemble_score").alias("a"))
    b = score(features, loaded).select("event_id", F.col("ensemble_score").alias("b"))
    assert a.join(b, "event_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12


def test_autoencoder_does_not_depend_on_the_partitioning(spark):
    from riskflow.models.autoencoder import fit_autoencoder
    from riskflow.plans.model_queries import feats

    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        net, info = fit_autoencoder(feats(spark, "/root/testdata/sf0.001").repartition(n), max_epochs=2, rows_per_shard=200)
        got.append((net.layers, net.threshold, info["rows_train"]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_tree_samples_are_the_smallest_hashes_with_and_without_the_prefilter(spark):
    from pyspark.sql import functions as F
    from riskflow.models.iforest import tree_samples

    rows = spark.range(400).withColumnRenamed("id", "k")
    hashes = rows.select("k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t")).select("k", "t", F.xxhash64("k", F.lit(9), "t").alias("h")).collect()
    want = {(t, k) for t in range(5) for _, k in sorted((r["h"], r["k"]) for r in hashes if r["t"] == t)[:10]}
    for spare in (0.5, 1.0, 4.0, 1e9):  # all trees short, some short, none short, no pre-filter
        got = tree_samples(rows, "k", 5, 10, 400, 9, spare).select("tree", "k").collect()
        assert len(got) == 50 and {(r["tree"], r["k"]) for r in got} == want
