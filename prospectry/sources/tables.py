"""Stored tables with declared schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.mail import sender_address
from ..rules import BODY_CUT, INBOX_DAYS


SHARED = "spark.checkpoint.dir"


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return read_table(spark, path, schemas.LEADS)


def read_outreach(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return read_table(spark, path, schemas.OUTREACH)


def readable_pages(pages: DataFrame) -> DataFrame:
    """Pages that brought something back."""
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return readable_pages(read_table(spark, path, schemas.PAGES))


def recent_messages(
    messages: DataFrame, now: Column, since_days: int = INBOX_DAYS, body_cut: int = BODY_CUT
) -> DataFrame:
    """Messages from the last days (whole days), sender address parsed, body cut.

    The date test is written on ``received_at`` itself so that it reaches the scan. Works on a
    streaming DataFrame too.
    """
    earliest = F.date_sub(F.to_date(now), since_days).cast("timestamp_ntz")
    return messages.filter(F.col("received_at") >= earliest).select(
        "msg_id", "received_at", sender_address(F.col("sender")).alias("sender"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.left(F.coalesce("body", F.lit("")), F.lit(body_cut)).alias("body"),
    )


def spread(scan: DataFrame) -> DataFrame:
    """A small table dealt out over all cores before heavy work on each row. Moves every row: for
    callers who know that the table is a small file, never done by the library itself."""
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)


def work_dir(spark: SparkSession) -> str:
    """A new directory under the session's shared checkpoint folder (``spark.checkpoint.dir``)."""
    base = spark.conf.get(SHARED, None)
    if not base:
        raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/prospectry-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` worked out once and read back from a table in the shared checkpoint folder.

    For narrow results of dear plans that are used more than once. Starts a job; survives the loss
    of executors because nothing of it stays in their memory.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
