"""Connected components of a pair table by alternating star steps; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.blocks import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: the larger neighbours of u point to the least of u and its neighbours; small star: the smaller ones and u do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u")
    out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id that occurs in ``u, v``; an empty table gives an empty one.

    Each round is written to the shared folder; the rounds end when the pairs no longer change.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = mark(now)
    while True:
        before, now = now, stored(_star(_star(now, True), False))
        discard(before)
        got = mark(now)
        if got == was:
            break
        was = got
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
