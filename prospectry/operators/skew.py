"""Joins with a side that is unique on the key, where few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when more than one row in so many has it, so there are fewer heavy keys than that.
HEAVY_SHARE = 128
SALTS = 64
#: Keys counted at once by the frequent-items sketch; its counts are at most 3.5 / _TRACKED of all
#: rows too high, never too low, so no heavy key is missed.
_TRACKED = 8192


def heavy_keys(rows: DataFrame, key: str, share: int = HEAVY_SHARE) -> DataFrame:
    """The values of ``key`` that more than one in ``share`` rows have: fewer than 2 * ``share`` rows.

    One pass with a sketch of fixed size; no shuffle by key.
    """
    found = rows.filter(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(2 * share), F.lit(_TRACKED)).alias("_top"), F.count("*").alias("_n"))
    each = found.select("_n", F.explode("_top").alias("_t"))
    return each.filter(F.col("_t.count") * share > F.col("_n")).select(F.col("_t.item").alias(key))


def join_skewed(
    rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", keys: DataFrame | None = None,
    share: int = HEAVY_SHARE, salts: int = SALTS,
) -> DataFrame:
    """``rows`` joined with ``unique`` (one row for each ``key``) as ``rows.join(unique, key, how)``.

    Rows of heavy keys are dealt over ``salts`` tasks, and the few rows of ``unique`` that they meet
    are replicated; all other rows join plainly. ``how`` is inner, left, left_semi or left_anti.
    Rows without a key are dealt out too. Heavy keys are looked for in ``keys`` if given: a cheaper
    table with the same skew, so that a dear ``rows`` is worked out once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no such join: {how}")
    heavy = F.broadcast(heavy_keys(rows if keys is None else keys, key, share).withColumn("_heavy", F.lit(True)))
    dealt: Column = F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns]), F.lit(salts)).cast("int")
    left = rows.join(heavy, key, "left").withColumn(
        "_salt", F.when(F.col("_heavy") | F.col(key).isNull(), dealt).otherwise(F.lit(0))).drop("_heavy")
    everywhere = F.sequence(F.lit(0), F.lit(salts - 1))
    right = unique.join(heavy, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_heavy"), everywhere).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return left.join(right, [key, "_salt"], how).drop("_salt")
