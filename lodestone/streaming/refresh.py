"""Postings kept up to date by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings
from ..sources.store import path_exists

BUCKETS = 64


def _write(batch: DataFrame, number: int, path: str) -> None:
    """One folder per batch, written whole: a batch that is run again replaces itself."""
    rows = postings(batch, "doc_id", "text").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")


def start_refresh(docs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the postings of a stream ``docs(doc_id, text)`` under ``path``.

    The checkpoint numbers the batches and each has a folder of its own, so a restart after
    a failure neither loses nor doubles a document."""
    writer = docs.writeStream.foreachBatch(lambda df, n: _write(df, n, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """All batches; a filter on ``bucket`` prunes the files of other terms."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "term string, doc_id long, w double, batch int, bucket int")
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
