"""op5: fuzzy line dedup of all documents. SQL can't express the signatures, so the tests hold it against brute force."""

from pyspark.sql import functions as F

from .line_dedup import line_dedup


def op5_line_dedup(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL: dict = {}
