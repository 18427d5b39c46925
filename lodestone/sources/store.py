"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, SparkSession] = {}

#: On a local folder Hadoop starts processes (``chmod``) for each file and its checksum, which
#: until they run share the memory of the JVM and are counted as if it were theirs. Scratch
#: files have no checksums, so fewer are started. Other file systems are written as ever.
_SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where it is unset (tests, a laptop) is a temporary folder made and set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestone-{tag}-{uuid.uuid4().hex}"
    _own[path] = spark
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_path(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


@atexit.register
def _clean() -> None:
    for path, spark in _own.items():
        try:
            remove_path(spark, path)
        except Exception:  # the JVM may be gone
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation and two consumers do not compute it twice."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**_SCRATCH).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_as(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which only reads ``table``, is discarded by discarding that."""
    df._stored_at = table._stored_at
    return df


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once nothing reads them any more; those that
    it did not write stay."""
    for t in tables:
        path = t.__dict__.get("_stored_at")
        if path and _own.pop(path, None):
            remove_path(t.sparkSession, path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, sort_by: str | None = None) -> DataFrame:
    """A stored table, built and written first if it is absent or ``rebuild`` is set.

    A table counts as present once its success marker is there, so a build that failed
    half-way is done again. ``sort_by`` clusters the files by a key, whose row groups a
    later filter can then skip.
    """
    if rebuild or not path_exists(spark, f"{path}/_SUCCESS"):
        df = build()
        if sort_by:
            df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_required(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; an absent one is an error that names it."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no finished table at {path}; build it first")
    return spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
