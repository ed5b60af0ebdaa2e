"""Scans of the driver's parquet tables (column pruning and filters reach the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ROWS_PER_TASK = 1 << 17


def even_tasks(df: DataFrame) -> int | None:
    """Tasks that share the rows evenly, at most ``ROWS_PER_TASK`` each; None if the scan's own splits do about as well.

    A file splits at its row groups only: one of a single row group goes to one task whole, whatever its size and however
    many splits the scan plans.  So rows are counted by split (without columns, that is from the file footers).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    per = df.groupBy(F.spark_partition_id().alias("_split")).agg(F.count(F.lit(1)).alias("n"))
    r = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("splits")).first()
    tasks = max(slots, -(-r["n"] // ROWS_PER_TASK))
    if r["n"] and (r["splits"] < slots or r["most"] > 2 * -(-r["n"] // tasks)):
        return tasks
    return None


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows in tasks of a bounded number of rows, for CPU-heavy work a row (JSON checks, scoring); by the hash of a key.

    A scan whose splits are even already is left as it is (no shuffle).
    """
    tasks = even_tasks(df)
    return df if tasks is None else df.repartition(tasks, key)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id")
