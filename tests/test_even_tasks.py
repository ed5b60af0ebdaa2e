"""A large file of one row group is shared by rows, however many splits its bytes are planned into."""

import pytest

from riskflow.sources import tables
from riskflow.streaming import jobs


@pytest.fixture
def one_group(spark, tmp_path):
    """40,000 rows in one row group, planned as many splits of which one has the rows."""
    spark.range(0, 40_000, 1, 1).selectExpr("id AS event_id", "sha2(CAST(id AS STRING), 512) AS props").write.parquet(str(tmp_path / "events.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    yield str(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def rows_a_task(df):
    return [r["count"] for r in df.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]


def test_rows_of_one_row_group_reach_all_tasks(spark, one_group, monkeypatch):
    raw = tables.table(spark, one_group, "events")
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(rows_a_task(raw)) == 1
    even = rows_a_task(tables.events(spark, one_group))
    assert len(even) == spark.sparkContext.defaultParallelism and sum(even) == 40_000 and max(even) < 11_000
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 2_000)  # the largest task stays bounded as the table grows
    even = rows_a_task(tables.events(spark, one_group))
    assert len(even) == 20 and sum(even) == 40_000 and max(even) < 2_500
    assert tables.even_tasks(tables.events(spark, one_group)) is None and tables.even_tasks(raw.limit(0)) is None
    jobs.land(raw, f"{one_group}/landing", 0, 2)
    assert len([f for f in spark.read.parquet(f"{one_group}/landing").inputFiles()]) == 10
