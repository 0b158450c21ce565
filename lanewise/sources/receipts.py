"""Batches that are whole or absent: staged under their id, then named by one receipt.

A batch's tables are written to a folder that no reader looks at. One rename then puts a receipt
beside the others, and readers follow receipts only. So a stop before the rename leaves nothing
to see, a stop after it leaves nothing to do, and a batch that is replayed is known by its id.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = "batch_id string, folder string, tables array<string>, stamp string, digest string"


class Receipts:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(f"{self.root}/receipts")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)

    def _path(self, name: str) -> object:
        return self._hadoop.Path(self._at, name)

    def receipts(self) -> DataFrame:
        return self.spark.read.schema(RECEIPT).json(f"{self.root}/receipts/*.json") if self._fs.globStatus(self._path("*.json")) else self.spark.createDataFrame([], RECEIPT)

    def committed(self, batch_id: str | int) -> bool:
        return self._fs.exists(self._path(f"{batch_id}.json"))

    def status(self, stamp: str, digest: str) -> str:
        """``new``, ``older`` or ``duplicate``; the latest stamp with another content is an error."""
        last = self.receipts().orderBy(F.desc("stamp")).select("stamp", "digest").first()
        if last is None or stamp > last.stamp:
            return "new"
        if stamp < last.stamp:
            return "older"
        if digest != last.digest:
            raise ValueError("same stamp, other content")
        return "duplicate"

    def publish(self, batch_id: str | int, tables: dict[str, DataFrame], stamp: str = "", digest: str = "", step: Callable[[str], None] = lambda name: None) -> bool:
        """Publish a batch unless it has been; returns whether it was. ``step`` is told of each step done."""
        if self.committed(batch_id):
            return False
        folder = f"{self.root}/staged/{batch_id}-{uuid.uuid4().hex}"
        step("begun")
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
            step(f"staged {name}")
        draft = self._path(f".{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"batch_id": str(batch_id), "folder": folder, "tables": sorted(tables), "stamp": stamp, "digest": digest}).encode()))
        out.close()
        step("drafted")
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, self._path(f"{batch_id}.json"), none)  # fails if another writer was first
        step("committed")
        return True

    def read(self, table: str, batch_id: str | int | None = None) -> DataFrame:
        """Rows of a table in one batch, or in all of them."""
        known = self.receipts().where(F.array_contains("tables", table))
        if batch_id is not None:
            known = known.where(F.col("batch_id") == str(batch_id))
        folders = [r.folder for r in known.collect()]  # one a batch
        if not folders:
            raise FileNotFoundError(f"no receipt for table {table}")
        return self.spark.read.parquet(*[f"{f}/{table}" for f in folders])

    def sweep(self) -> int:
        """Delete staged folders and drafts that no receipt names; only while no writer is at work."""
        held = {self._hadoop.Path(r.folder).getName() for r in self.receipts().collect()}
        loose = [s.getPath() for s in self._fs.globStatus(self._hadoop.Path(f"{self.root}/staged/*")) or [] if s.getPath().getName() not in held]
        loose += [s.getPath() for s in self._fs.globStatus(self._path(".*.draft")) or []]
        for path in loose:
            self._fs.delete(path, True)
        return len(loose)

    def sink(self, table: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a micro-batch run again after a stop is published once."""
        return lambda batch, batch_id: self.publish(batch_id, {table: batch}) and None
