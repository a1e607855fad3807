"""op8: SimHash components of all documents. SQL lacks XXH64, so the tests hold it against brute force."""

from .simhash import simhash_components


def op8_simhash(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict = {}
