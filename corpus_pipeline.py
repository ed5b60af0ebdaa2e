"""Training-data pipeline: quality classifier, near-duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import decontaminate, near_duplicates, personal_data, quality_classifier, sentence_pieces
from riskflow.llm.blocks import stored
from riskflow.session import ensure_conf
from riskflow.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts; fit on the labelled rows among them.

    Rows of one doc_id stay if one of them is accepted; a null doc_id is not judged and stays.
    """
    ensure_conf(spark)
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels")).where("doc_id is not null")
    rejected = judged.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each near-duplicate group (five-word shingles, similarity 0.8)."""
    ensure_conf(spark)
    return near_duplicates.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    ensure_conf(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows."""
    ensure_conf(spark)
    clean = personal_data.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts."""
    ensure_conf(spark)
    return sentence_pieces.encode(docs)


STAGES = [("quality", quality), ("near", near), ("decontaminated", decontaminated), ("private", private), ("encode", encode)]

# The classifier, the sketches and the lattice have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
