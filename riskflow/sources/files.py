"""File sources and sinks.

* S1  transaction CSV with a header, explicit schema (no inference); the headers
      are read first so missing columns are reported (V9) before the data is read;
      files are read by the names in their own headers.
* S4  feedback JSON lines: blank lines skipped; lines that do not decode to an
      object go to the dead letter with their error.
* S8  feedback publish: ``to_json(struct(*))`` lines.
* S9  model-update signals, one folder per update.
* S10 report sinks: one-row DataFrames written as JSON.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.contract import EXPECTED_COLUMNS, SIGNAL_SCHEMA, TXN_SCHEMA
from riskflow.functions.jsonrules import parse_strict


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the header line, as the CSV reader takes them (quotes included)."""
    return spark.read.option("header", True).csv(path).columns


def _headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a folder, grouped by their header line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("line"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [[unquote(f) for f in g["files"]] for g in groups]


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV -> typed transaction table, columns by name; columns absent from all files stay absent.

    Files with equal headers are one scan; scans of different headers (another order, more or fewer columns) are
    joined by column name, and a column that a file lacks is null for its rows.
    """
    groups = _headers(spark, path)
    fields = {f.name: f for f in TXN_SCHEMA.fields}

    def scan(files: str | list[str]) -> DataFrame:
        header = csv_header(spark, files if isinstance(files, str) else files[0])
        schema = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in header])
        return spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").schema(schema).csv(files)

    if len(groups) <= 1:
        return scan(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(scan, groups))


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in EXPECTED_COLUMNS if c not in df.columns]


def read_feedback_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per non-blank line that decodes to an object (see :func:`feedback_dead_letters`)."""
    return _feedback_lines(spark, path).where(F.col("error").isNull()).drop("error")


def feedback_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines that do not decode to an object: (raw, error)."""
    return _feedback_lines(spark, path).where(F.col("error").isNotNull())


def _feedback_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("raw")).where(F.col("raw") != "")
    _, err = parse_strict("raw")
    return lines.select("raw", err.alias("error"))


def publish_json(df: DataFrame, path: str) -> None:
    """Each row as one JSON object per line, nulls included (append)."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def append_signals(spark: SparkSession, path: str, signals: list[tuple[str, str, int, int]]) -> DataFrame:
    """One row a model update (model type, path, update count, batch size), ``updated_at`` set by the engine.

    ``path`` is the folder of these updates, so a retry replaces its own signals.
    """
    rows = spark.createDataFrame(signals, "model_type string, model_path string, online_update_count long, batch_size int")
    sig = rows.withColumn("updated_at", F.current_timestamp())
    sig.select(*[f.name for f in SIGNAL_SCHEMA.fields]).coalesce(1).write.mode("overwrite").parquet(path)
    return sig


def write_report(df: DataFrame, path: str) -> None:
    """A (one-row) report as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
