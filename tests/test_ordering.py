import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.operators.ordering import exact_quantiles, global_row_index, grouped_row_number, running_sums


def test_global_row_index_equals_row_number(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("k"))
    got = global_row_index(df, ["k", "id"], "ix", num_partitions=7).select("id", "ix")
    want = df.select("id", (F.row_number().over(Window.orderBy("k", "id")) - 1).alias("ix"))
    assert got.exceptAll(want).count() == 0 and got.count() == 5000


def test_grouped_row_number_splits_hot_groups(spark):
    # one hot key holding a third of the rows, pieces of 64 rows
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17).alias("g"))
    got = grouped_row_number(df, ["g"], "id", "rn", bucket_rows=64)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert got.select("id", "g", "rn").exceptAll(want.select("id", "g", "rn")).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, v long")
    got = {r["id"]: r["cum_v"] for r in running_sums(df, ["id"], ["v"], num_partitions=5).collect()}
    acc = 0
    for i in range(100):
        acc += i % 3
        assert got[i] == acc


def test_exact_quantiles_grouped_vs_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=300)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double")
    q = {r["g"]: r for r in exact_quantiles(df, "x", [0.0, 0.5, 0.995, 1.0], ["g"]).collect()}
    for g in range(3):
        a = np.array([v for k, v in rows if k == g])
        assert q[g]["n"] == len(a)
        for i, p in enumerate([0.0, 0.5, 0.995, 1.0]):
            assert q[g][f"q_{i}"] == pytest.approx(np.quantile(a, p), rel=1e-12)


def test_quantiles_with_a_hot_value_spread_over_partitions(spark):
    # a third of the rows share one value; ranks still give numpy's answer
    vals = [5.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.9]).first()
    for i, p in enumerate([0.25, 0.5, 0.9]):
        assert q[f"q_{i}"] == pytest.approx(np.quantile(np.array(vals), p))
    idx = global_row_index(df.withColumn("t", F.monotonically_increasing_id()), ["x", "t"], "r", num_partitions=6)
    sizes = [r["count"] for r in idx.groupBy(F.floor(F.col("r") / 150)).count().collect()]
    assert max(sizes) <= 150


def test_quantiles_by_selection(spark, monkeypatch):
    """Sketch, buckets and the one bucket put in order, against numpy: ties, infinities, wide ranges, small and large groups."""
    from riskflow.operators import ordering

    monkeypatch.setattr(ordering, "FEW", 50)
    monkeypatch.setattr(ordering, "CELLS", 8)
    monkeypatch.setattr(ordering, "ACCURACY", 200)
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=4000), "ties": rng.integers(0, 3, 3000).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 2000),
              "one": np.array([3.5]), "few": rng.normal(size=20), None: rng.exponential(size=1500), "ends": np.array([-np.inf] * 5 + [1.0] * 90 + [np.inf] * 5)}
    qs = [0.0, 0.001, 0.3, 0.5, 0.995, 1.0]
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, "x", qs, ["g"]).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k]["n"] == len(v)
        for i, q in enumerate(qs):
            want = np.quantile(v, q)
            assert got[k][f"q_{i}"] == pytest.approx(want, rel=1e-12) or np.isnan(want), (k, q)
    flat = exact_quantiles(df.where("g = 'wide'"), "x", qs).first()
    assert [flat[f"q_{i}"] for i in range(len(qs))] == pytest.approx(np.quantile(groups["wide"], qs), rel=1e-12)
    none = exact_quantiles(df.limit(0), "x", [0.0, 0.5]).first()
    assert (none["n"], none["q_0"], none["q_1"]) == (0, None, None)
    assert exact_quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    from riskflow.operators import ordering

    monkeypatch.setattr(ordering, "FEW", 0)
    monkeypatch.setattr(ordering, "MARGIN", -4000)  # brackets beside the quantile
    v = np.random.default_rng(2).normal(size=500)
    got = exact_quantiles(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", [0.5]).first()
    assert got["q_0"] == pytest.approx(np.quantile(v, 0.5))


def test_quantile_plans_move_no_values(spark):
    from riskflow.operators import ordering

    seen = []
    keep = ordering.cut_lineage
    ordering.cut_lineage = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        exact_quantiles(spark.range(100).selectExpr("id * 1.0 AS x"), "x", [0.5]).collect()
    finally:
        ordering.cut_lineage = keep
    assert seen and not any("rangepartitioning" in p for p in seen)


def test_bottom_rows_by_counts(spark):
    from riskflow.operators.evaluate import seeded_sample
    from riskflow.operators.ordering import bottom_cut

    ids = [*range(3000), *[7] * 800, None, None]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, x string").repartition(5)
    hashed = df.select("id", F.xxhash64("id", F.lit(3)).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r["h"], -1 if r["id"] is None else r["id"]))
    for n in (1, 10, 777, 2000, 3801, 3802, 9999):
        got = sorted(-1 if r["id"] is None else r["id"] for r in seeded_sample(df, "id", n, 3).collect())
        assert got == sorted(-1 if r["id"] is None else r["id"] for r in order[:n])
    assert bottom_cut(df, "id", F.xxhash64("id", F.lit(3)), 5000) == (3802, None, 0)
    with pytest.raises(ValueError):
        seeded_sample(df.limit(0), "id", 5, 3)


def test_null_keys_are_numbered(spark):
    from riskflow.operators.ordering import grouped_row_number

    df = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "a", None), (4, "a", None), (5, "a", 2)], "id long, k string, step int")
    got = {r.id: r.rn for r in grouped_row_number(df, ["k", "step"], "id").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}


def test_previous_value_crosses_ranges_and_keeps_nulls(spark):
    from riskflow.operators.ordering import previous_value

    vals = [None if i % 7 == 3 else i * i for i in range(100)]
    df = spark.createDataFrame(list(enumerate(vals)), "k int, v int").repartition(5)
    got = [r["p"] for r in previous_value(df, ["k"], "v", "p", num_partitions=6).orderBy("k").collect()]
    assert got == [None, *vals[:-1]]


def test_grouped_quantiles_of_many_groups_without_forced_broadcast(spark):
    df = spark.range(0, 3000).selectExpr("id % 1000 as g", "cast(id as double) as x")
    q = exact_quantiles(df, "x", [0.5], ["g"])
    assert {r["g"]: r["q_0"] for r in q.collect()} == {g: g + 1000.0 for g in range(1000)}
    assert "strategy=broadcast" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_range_count_follows_the_tables_read(spark, tmp_path):
    from riskflow.session import target_partitions

    path = str(tmp_path / "t")
    spark.range(0, 50000).selectExpr("id", "id % 7 as g").write.parquet(path)
    t = spark.read.parquet(path)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert target_partitions(t) == base
    one = target_partitions(t, 10000)
    assert one > base
    both = target_partitions(t.join(t.groupBy("g").count(), "g"), 10000)
    assert 2 * one - 1 <= both <= 2 * one  # the sum of the tables, not the product of the sides
    rows = spark.createDataFrame([(1, 2.0)], "a int, b double").select("b").where("b > 0")
    assert target_partitions(rows) == max(base, rows.rdd.getNumPartitions())  # no size known
