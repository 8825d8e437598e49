"""Tables written once in the shared folder, and rows carried whole under one name."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a session of one
    machine names none, as in tests."""
    base = spark.conf.get(SHARED, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="prospectry-llm-")
        spark.conf.set(SHARED, base)
    return base.rstrip("/")


_open: list[list[str]] = []  # tables to drop at the end of each ``scratch`` that has begun


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` meanwhile go at the end, but for those written to last. What is
    made of the others has to be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """``df`` worked out once and read back from the shared folder.

    Cuts lineage in a way that survives lost executors. Starts a job.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    if _open and not lasting:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, keep: list[str] | None = None):
    """All (or the named) columns of a row in one struct, so that no working column clashes."""
    names = df.columns if keep is None else keep
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
