"""What the operators of this subpackage share: the store, batches, and ASCII case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.store import discard, materialize, remove_path, scratch_path, shared_dir, stored_as

__all__ = ["bound_batches", "discard", "lower_ascii", "materialize", "read_table", "remove_path", "scratch_path", "shared_dir", "stored_as"]

#: Bytes of an Arrow batch, which a task holds on both sides of the socket at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_BYTES``, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "1g"))
    if now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return store.read_table(spark, sf_dir, name)


def lower_ascii(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
