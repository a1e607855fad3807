"""op1: personal data in all documents. SQL can't express the votes, so the tests hold base spans against plain regexes."""

from .pii import find_pii


def op1_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_pii": op1_pii}
ORACLE_SQL: dict = {}
