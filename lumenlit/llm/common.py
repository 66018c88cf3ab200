"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.session import ship, spread  # noqa: F401  (ship: for the queries)

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_stored: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where it is unset, one beside the warehouse is used by a session on a single machine;
    a cluster needs the setting.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def persisted(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; ``drop_stored`` deletes it."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.parquet(path)


def stored_tables() -> int:
    """How many tables this session's queries have stored so far; ``drop_stored`` takes it as ``since``."""
    return len(_stored)


def drop_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables stored since a moment but for the last ``keep``, once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _stored[since : len(_stored) - keep]
    for path in map(jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(conf).delete(path, True)
    del _stored[since : len(_stored) - keep]
    return len(gone)


def release() -> None:
    """Give memory that a task has freed back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The function of a ``mapInArrow``, whose task ends by giving memory back."""

    @functools.wraps(work)
    def run(*args: Any) -> Iterator[pa.RecordBatch]:
        yield from work(*args)
        release()

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def salt_of_doc(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: as the empty text)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds
