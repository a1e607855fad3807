"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternscore.llm.common import dropped_since, mark, saved
from patternscore.llm.decontaminate import clean_documents
from patternscore.llm.line_dedup import line_dedup
from patternscore.llm.packing import pack
from patternscore.llm.q_packing import tokenizer_path
from patternscore.llm.simhash import near_dedup
from patternscore.llm.toxicity import toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on their labelled rows, does not call toxic."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("NOT toxic").select(*[f"`{c}`" for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier similar line; n_chars follows the text.

    A null text stays as it is. Of similar lines the one with the smallest (doc_id, text hash, line number) stays, a null doc_id last.
    """
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets are similar (0.8 or more): candidates by SimHash and by sketch bands, every link checked.

    The smallest doc_id stays (null last), then the smallest text hash; of rows that repeat both, any one. All columns stay.
    """
    return near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Null and empty texts have no words and stay; items without words or without id hit nothing. Rows that repeat share their answer.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their place in training sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: SQL has neither the severity model, the signatures nor the tokenizer: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    point = mark()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped_since(spark, point, docs)  # the tables of the stage and the one that it read
    return STAGES[-1][1](spark, docs, sf_dir)
