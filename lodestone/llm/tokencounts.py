"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch is a table of signed changes: an insert adds one document with its count, a delete
takes one away, a revision is a delete of the old count and an insert of the new one. Only
the batch's totals are stored. They are written to a folder of the attempt's own, and the
batch counts from the moment that a marker of its name, which can be created only once,
names that folder: an attempt that failed half-way, a batch that is committed again and two
writers of one batch all leave exactly one version. Totals are the sum over committed
batches, so the order of commits does not matter, and a compaction replaces batches by
their sum without forgetting their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import fast_bpe

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens", "n_chars")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens, chars)`` per row, by one pass of the BPE
    tokenizer in file ``tokenizer``. A null or empty text has no tokens; keys may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = fast_bpe(tokenizer)
        for b in batches:
            n = np.array([len(x) for x in bpe.encode(b.column("text"))], np.int64)
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "source", "lang", "chars")), pa.array(n)], names=["doc_id", "source", "lang", "chars", "tokens"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(source as string) source", "cast(lang as string) lang", "cast(coalesce(length(text), 0) as long) chars")
    rows = rows.mapInArrow(run, "doc_id long, source string, lang string, chars long, tokens long")
    return rows.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens", "chars")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that turn the old counts of some documents into new ones."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """A rollup in a folder that driver and executors share.

    ``marks`` holds a marker per batch, ``sums`` one per compaction, ``data`` the totals."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, kind: str) -> list[str]:
        fs, at = self._at(kind)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _mark(self, kind: str, name: str) -> dict:
        """What a marker says; nothing if it is absent or its writer was lost in between."""
        fs, at = self._at(kind, name)
        if not fs.exists(at) or not fs.getFileStatus(at).getLen():
            return {}
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _set_mark(self, kind: str, name: str, what: dict) -> bool:
        fs, at = self._at(kind, name)
        if fs.exists(at) and not fs.getFileStatus(at).getLen():
            fs.delete(at, False)
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        return True

    def _write(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{attempt}")
        return attempt

    def committed(self, batch: str) -> bool:
        return bool(self._mark("marks", batch))

    def batches(self) -> list[str]:
        """The names of all committed batches."""
        return [n for n in self._names("marks") if self.committed(n)]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows under a name; False if it was committed before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch's name holds letters, digits, - and _ only")
        if self.committed(batch):
            return False
        sign = F.col("sign").cast("long")
        total = changes.groupBy(*KEYS).agg(
            F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce("tokens", F.lit(0))).alias("n_tokens"), F.sum(sign * F.coalesce("chars", F.lit(0))).alias("n_chars")
        )
        return self._set_mark("marks", batch, {"data": self._write(total)})

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/data/{f}" for f in folders))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS))

    def _newest(self) -> dict:
        """The newest compaction: its folder and the batches in it."""
        return next((m for n in reversed(self._names("sums")) if (m := self._mark("sums", n))), {})

    def _all(self) -> tuple[list[str], list[str]]:
        newest = self._newest()
        names = self.batches()
        fresh = [self._mark("marks", n)["data"] for n in names if n not in set(newest.get("batches", ()))]
        return names, [newest["data"], *fresh] if newest else fresh

    def compact(self) -> bool:
        """Store the sum of all batches committed so far, which later totals start from;
        False if another compaction came first. Committed names stay committed."""
        names, folders = self._all()
        number = f"{len(self._names('sums')):09d}"
        return self._set_mark("sums", number, {"data": self._write(self._sum(folders)), "batches": names})

    def totals(self, *batches: str) -> DataFrame:
        """Totals over all committed batches, or over the named ones that are committed; keys
        that fell to nothing are left out. Null keys are groups of their own."""
        folders = [m["data"] for b in dict.fromkeys(batches) if (m := self._mark("marks", b))] if batches else self._all()[1]
        return self._sum(folders).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")
