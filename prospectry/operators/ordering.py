"""Positions and firsts without gathering the rows of a table or group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .skew import join_skewed

_RANGE_BITS = 33  # of an id that grows within a range of sorted rows, below the range's number


def numbered(
    df: DataFrame, order: Sequence[str | Column], out: str, start: int | Column = 1
) -> DataFrame:
    """``df`` with ``out`` = dense place of the row in the order of ``order`` (columns of any kind).

    A global ``row_number`` would put every row into one task. Here Spark sorts the rows into
    ranges, so that no task has more than its share whatever the keys are, and the rows are written
    down once with their place in their range. Counts of the ranges, one row for each task that
    wrote, give the places before each range. Rows that tie in all of ``order`` follow each other in
    any order, but each has a place of its own. Starts a job; ``df`` is read twice, once for the
    bounds of the ranges, so a dear ``df`` should be ``written`` before.
    """
    places = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    in_range = F.col("_at").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    range_ = F.shiftright("_at", _RANGE_BITS)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = places.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return places.withColumn("_range", range_).join(F.broadcast(before), "_range").withColumn(
        out, (F.col("_before") + in_range + first).cast("bigint")).select(*df.columns, out)


def row_index(df: DataFrame, ord_col: str, out: str, start: int | Column = 1) -> DataFrame:
    """``numbered`` by one column."""
    return numbered(df, [ord_col], out, start)


def places_within(rows: DataFrame, key: str, ord_col: str, least: int) -> DataFrame:
    """``(key, ord_col, place)``: dense places from 0, in the order of the bigint ``ord_col``, of the
    rows of every key that has more than ``least`` of them; ``ord_col`` is unique within its key.

    Two levels: keys are counted, and only the rows of large ones, which may lie anywhere in the
    order, are numbered; so neither sparse ids nor a key with most of the rows make a large task.
    Starts jobs.
    """
    large = rows.groupBy(key).count().filter(F.col("count") > least).select(key)
    if large.isEmpty():
        return rows.select(key, ord_col, F.lit(None).cast("bigint").alias("place")).limit(0)
    placed = numbered(join_skewed(rows.select(key, ord_col), large, key, "left_semi"), [key, ord_col], "_n")
    firsts = placed.groupBy(key).agg(F.min("_n").alias("_first"))
    return join_skewed(placed, firsts, key).select(key, ord_col, (F.col("_n") - F.col("_first")).alias("place"))


def first_by(df: DataFrame, keys: list[str], ord_cols: list[str]) -> DataFrame:
    """The first row of each key in the order of ``ord_cols``; combines before the shuffle, so a
    key with most of the rows costs no more than others."""
    rest = [c for c in df.columns if c not in keys and c not in ord_cols]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ord_cols, *rest)).alias("_first"))
    return best.select(*keys, "_first.*").select(*df.columns)


def at_most_per_key(
    df: DataFrame, keys: list[str], ord_cols: list[str], cap: Column, highest: int
) -> DataFrame:
    """The first ``cap`` rows of each key (``cap`` may differ by row, never above ``highest``).

    The literal bound lets Spark drop rows beyond it before the shuffle (window group limit), so
    no task ever sees more than ``highest`` rows per key and map task.
    """
    numbered = df.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*ord_cols)))
    return numbered.filter(F.col("_rn") <= highest).filter(F.col("_rn") <= cap).drop("_rn")
