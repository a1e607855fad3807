"""op12: spelling variants among the words of all documents. SQL lacks crc32, so the tests hold it against brute force."""

from .common import saved
from .spelling import deleted_letter, variants, word_counts


def op12_spelling_variants(spark, sf_dir):
    words = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=deleted_letter).where("n >= 2")
    return variants(saved(words, "words"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE_SQL: dict = {}
