"""The target counts of the quality rules come from every trusted document."""

from pyspark.sql import functions as F

from riskflow.llm import quality_rules


def test_all_trusted_documents_count(spark):
    docs = spark.range(20_600).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert (quality_rules.log_ratios(docs, labels) == 0).all()  # the target is the raw corpus
    odd = docs.unionByName(spark.createDataFrame([(None, "#" * 50)], "doc_id long, text string"))
    assert (quality_rules.log_ratios(odd, labels.unionByName(labels.limit(5))) != 0).any()  # a null id is not trusted
