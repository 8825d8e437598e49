"""Outcome counts in long form, zero counts included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISCOVERY_OUTCOMES = (
    "added", "duplicate", "skipped_not_relevant", "skipped_content_site", "skipped_not_a_vendor",
    "skipped_non_us", "fetch_failed",
)
ROSTER_OUTCOMES = ("added", "updated", "no_domain", "enriched", "unreachable")


def long_counts(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """``(outcome, n)``: one aggregate per outcome in a single pass over ``df``."""
    totals = df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(k).alias("n")) for k in counts])
    return totals.select(F.explode(pairs).alias("p")).select("p.outcome", "p.n")


def count_outcomes(df: DataFrame, outcomes: tuple[str, ...], column: str = "outcome") -> DataFrame:
    return long_counts(df, {o: F.count_if(F.col(column) == o) for o in outcomes})


def discovery_funnel(outcomes: DataFrame) -> DataFrame:
    """A3."""
    return count_outcomes(outcomes, DISCOVERY_OUTCOMES)


def roster_funnel(outcomes: DataFrame) -> DataFrame:
    """A4 over ``(outcome, enrichment)``; a site reached without an address counts as unreachable."""
    merged = F.col("enrichment").isin("unreachable", "reached")
    return long_counts(outcomes, {
        "added": F.count_if(F.col("outcome") == "added"),
        "updated": F.count_if(F.col("outcome") == "updated"),
        "no_domain": F.count_if(F.col("outcome") == "no_domain"),
        "enriched": F.count_if(F.col("enrichment") == "enriched"),
        "unreachable": F.count_if(merged),
    })
