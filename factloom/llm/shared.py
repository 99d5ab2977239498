"""Where the operators keep what they write between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: `spark.checkpoint.dir`, or in a local session (tests) one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has, inside of the folder of `kept_in` where one is open."""
    return f"{_folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def kept_in(path: str) -> Iterator[None]:
    """What is stored within goes below `path`, so that it can be deleted as one."""
    before = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it, whichever that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends here and an executor may be lost afterwards."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
