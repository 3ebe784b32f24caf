"""Tables that jobs store on their way in the folder that driver and executors share, and the file system it is on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where none is set, on a local master, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Folders of the tables that each open own_tables has stored, the innermost last.
_owners: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


#: Spark deletes what a query has shuffled at the query's end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written within are deleted when it is written; else they stay until the driver's memory
    happens to fill, beside all that a query shuffles later."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def store(df: DataFrame, outer: bool = False) -> DataFrame:
    """The table written as Parquet to the shared folder and read again: it cuts the lineage, what reads it twice does not
    work it out twice, and a lost executor costs no recomputation of what led to it. It is gone at the end of own_tables, or
    with outer of the own_tables around that."""
    where = new_folder(df.sparkSession)
    owners = _owners.get()[:-1] if outer else _owners.get()
    if owners:
        owners[-1].append(where)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end, however it ends; of this thread's work only, and not what a query that
    is returned from within still has to read: that is to be stored with outer."""
    mine: list[str] = []
    token = _owners.set((*_owners.get(), mine))
    try:
        yield
    finally:
        _owners.reset(token)
        for where in mine:
            Files(spark, where).delete(where)


class Files:
    """What is needed of the file system of a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of modification in ms) of what is in a folder, hidden files left out; none if it is not there."""
        if not self.exists(folder):
            return []
        found = [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path(folder))]
        return sorted(x for x in found if not x[0].startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a small file that is there as a whole or not at all; False if one of that name is there already."""
        folder, last = name.rsplit("/", 1)
        hidden = self.path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(hidden), self.fs.makeQualified(self.path(name)), no_options)
        except Exception as e:
            self.fs.delete(hidden, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

