"""Transactions over tables of files: several tables are written, and become visible together or not at all.

A transaction stages its rows in folders of its own. Committing is one rename, of a manifest that names the folders, to
the transaction's number; readers see only what a manifest names. A transaction that fails, or whose driver dies, leaves
nothing that can be seen; one that is run again under its number is staged anew, and if it was committed before, it is
passed over. So a stream that gives its batch number writes each row once, whatever is repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables below one path, in any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.mkdirs(self._at("_commits"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def committed(self, number: int) -> bool:
        return self._fs.exists(self._at(f"_commits/{number}.json"))

    @contextmanager
    def transaction(self, number: int) -> Iterator[Transaction]:
        """Commits at the end of the block, rolls back on any failure in it. Committed before: what the block writes goes nowhere."""
        scope = Transaction(self, number)
        try:
            yield scope
        except BaseException:
            scope.rollback()
            raise
        scope.commit()

    def _folders(self, table: str | None = None) -> list[str]:
        """The committed folders: one entry a commit and table."""
        rows = self.spark.read.schema("number long, tab string, folder string").json(f"{self.path}/_commits")
        rows = rows if table is None else rows.where(F.col("tab") == table)
        return [r["folder"] for r in rows.select("folder").collect()]

    def read(self, table: str, schema) -> DataFrame:
        folders = self._folders(table)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def vacuum(self) -> int:
        """Removes staged folders that no manifest names. Not while a transaction runs."""
        held, gone = set(self._folders()), 0
        for table in self._fs.listStatus(self._at("")):
            name = table.getPath().getName()
            if name != "_commits":
                for folder in self._fs.listStatus(table.getPath()):
                    if f"{name}/{folder.getPath().getName()}" not in held:
                        gone += self._fs.delete(folder.getPath(), True)
        return gone


class Transaction:
    def __init__(self, store: Store, number: int) -> None:
        self.store, self.number, self.staged = store, number, []
        self.over = store.committed(number)

    def write(self, table: str, rows: DataFrame) -> None:
        if not self.over:
            folder = f"{table}/{self.number}-{uuid.uuid4().hex}"
            self.staged.append((table, folder))
            rows.write.parquet(f"{self.store.path}/{folder}")

    def rollback(self) -> None:
        for _, folder in self.staged:
            self.store._fs.delete(self.store._at(folder), True)
        self.staged, self.over = [], True

    def commit(self) -> None:
        if self.over:
            return
        store, draft = self.store, self.store._at(f"_commits/.{self.number}-{uuid.uuid4().hex}")
        out = store._fs.create(draft, False)
        out.write(bytearray("\n".join(json.dumps({"number": self.number, "tab": t, "folder": f}) for t, f in self.staged).encode()))
        out.close()
        rename = store._jvm.org.apache.hadoop.fs.Options.Rename
        context = store._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(store._conf).getUri(), store._conf)
        try:  # fails where another attempt under this number came first
            context.rename(draft, store._at(f"_commits/{self.number}.json"), store.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception:
            store._fs.delete(draft, False)
            if not store.committed(self.number):
                self.rollback()
                raise
            self.rollback()
        self.over = True
