"""A table to which several writers append rows with new keys: a lookup cache filled by many jobs at once."""

from __future__ import annotations

import posixpath
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.operators.lookup import insert_if_absent


@dataclass(frozen=True)
class Batch:
    """Rows written aside, none of whose keys is in the first ``version`` batches."""

    folder: str
    version: int


class SharedTable:
    """Batches of Parquet in a folder and one small numbered file for each that counts.

    A batch is written to a folder of its own, which nobody reads. It takes effect when the file with the next number is
    created, which only one writer can do. Another writer then takes the keys that have come in between out of its own
    batch and tries the number after that. Readers see whole batches only; a job that fails leaves a folder without a file.

    The file system must create a file without overwriting as one step, as HDFS does. If a writer dies between creating
    its file and writing the name into it, the others stop with an error that names the file; deleting it gives way.
    A null is no key and is not stored.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, schema: T.StructType | str) -> SharedTable:
        """An empty table; one that is there already is left as it is."""
        empty = self.spark.createDataFrame([], schema)
        self.commit(Batch(self._write(empty), 0))
        return self

    def folders(self) -> list[str]:
        """Folders of the batches that count, in their order."""
        names, number = [], 0
        while self._fs.exists(self._number(number)):
            names.append(f"{self.path}/{self._name_in(number)}")
            number += 1
        return names

    def read(self, folders: list[str] | None = None) -> DataFrame:
        """All rows of the batches that count now, or of the given ones."""
        folders = self.folders() if folders is None else folders
        if not folders:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.spark.read.schema(self._schema(folders)).parquet(*folders)

    def stage(self, new: DataFrame, order: str | None = None) -> Batch:
        """Write the rows with new keys aside, one for each key (the first by ``order``)."""
        folders = self.folders()
        held = self.read(folders)
        rows = insert_if_absent(held, new.filter(F.col(self.key).isNotNull()), self.key, order)
        return Batch(self._write(rows.select(*held.columns)), len(folders))

    def commit(self, batch: Batch) -> bool:
        """Let a batch count; false if another one has taken its number."""
        try:
            out = self._fs.create(self._number(batch.version), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(f"{posixpath.basename(batch.folder)}\n", "ascii"))
        out.close()
        return True

    def rebase(self, batch: Batch) -> Batch:
        """The same batch without the keys of the batches that have come in since it was staged."""
        folders = self.folders()
        mine, since = self.read([batch.folder]), self.read(folders[batch.version :])
        left = mine.join(since.select(self.key), self.key, "left_anti").select(*mine.columns)
        return Batch(self._write(left), len(folders))

    def append_if_absent(self, new: DataFrame, order: str | None = None) -> None:
        """Add the rows whose keys are not there yet, however many other writers do so at the same time."""
        batch = self.stage(new, order)
        while not self.commit(batch):
            batch = self.rebase(batch)

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.path}/batch-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def _schema(self, folders: list[str]) -> T.StructType:
        return self.spark.read.parquet(folders[0]).schema

    def _number(self, number: int):
        return self._hadoop(f"{self.path}/_versions/{number:010d}")

    def _name_in(self, number: int, patience: float = 10.0) -> str:
        until = time.monotonic() + patience
        while True:
            stream = self._fs.open(self._number(number))
            text = bytes(stream.readAllBytes()).decode("ascii")
            stream.close()
            if text.endswith("\n"):
                return text.strip()
            if time.monotonic() > until:
                raise RuntimeError(f"a writer has not finished {self._number(number)}")
            time.sleep(0.1)
