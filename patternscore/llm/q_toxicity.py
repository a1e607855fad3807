"""op9: severity of all documents. SQL can't fit the model, so the tests measure held-out accuracy."""

from pyspark.sql import functions as F

from .toxicity import fit_severity, grades_of, score_severity


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_severity(docs, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_severity(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict = {}
