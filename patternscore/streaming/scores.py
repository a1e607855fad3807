"""A frozen model over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import Cleaner, Model


def score_stream(rows: DataFrame, model: Model, path: str, checkpoint: str, cleaner: Cleaner | None = None, **trigger) -> StreamingQuery:
    """Starts a query that cleans and scores the rows of a stream into Parquet under ``path``; trigger as for writeStream, by default what is there now.

    Nothing is fitted, so a row gets the score that it gets in a batch. Each micro-batch has a folder of its own that a retry overwrites, so
    after a failure no row is there twice; scored() reads them.
    """

    def write(batch: DataFrame, number: int) -> None:
        model.score(cleaner.transform(batch) if cleaner else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scored(spark, path: str) -> DataFrame:
    """What score_stream() has written so far."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
