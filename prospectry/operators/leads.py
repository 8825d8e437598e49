"""Qualifying visited sites and adding them to the lead table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.strings import blank_to_null
from ..sources.tables import written
from .ordering import first_by, numbered


class TableChange(NamedTuple):
    """The new state of a table and what happened to each input row."""

    table: DataFrame
    outcomes: DataFrame


def skip_reason(allow_non_us: bool = False, vendors_only: bool = True) -> Column:
    """Why a profile does not qualify, null when it does; the first reason counts."""
    reason = F.when(F.col("company_type").isNull(), "skipped_not_relevant")
    if vendors_only:
        reason = reason.when(
            F.col("is_content_site") & ~F.col("sells_direct"), "skipped_content_site"
        ).when(~F.col("sells_direct"), "skipped_not_a_vendor")
    if not allow_non_us:
        reason = reason.when(~F.col("us_based"), "skipped_non_us")
    return reason


def judged_visits(
    visits: DataFrame, profiles: DataFrame, allow_non_us: bool = False, vendors_only: bool = True
) -> DataFrame:
    """Visits (``ord, url, domain, query, source``) with their profile and ``reason``.

    P15 comes first: a visit that brought no readable page is ``fetch_failed``.
    """
    rest = profiles.drop("url")
    return visits.join(rest, "domain", "left").withColumn(
        "reason",
        F.when(F.coalesce("n_pages", F.lit(0)) == 0, "fetch_failed").otherwise(
            skip_reason(allow_non_us, vendors_only)))


def preview(judged: DataFrame) -> DataFrame:
    """What a dry run shows of the visited sites."""
    return judged.filter(~F.col("reason").eqNullSafe("fetch_failed")).select(
        "domain", "company_type", "sells_direct", "manufactures", "is_content_site", "us_based",
        "state", "email")


def add_leads(leads: DataFrame, judged: DataFrame, now: Column) -> TableChange:
    """K1: qualifying sites become leads unless their domain already is one.

    Ids go on from the highest in visit order. Existing leads stay as they are. The table is the
    old one plus the new rows (``new_leads`` gives just those, for an append).
    """
    outcomes = lead_outcomes(leads, judged)
    return TableChange(
        leads.unionByName(new_leads(leads, judged, now)), outcomes)


def lead_outcomes(leads: DataFrame, judged: DataFrame) -> DataFrame:
    """``(ord, domain, outcome)`` of every visit."""
    known = leads.select("domain", F.lit(True).alias("_known"))
    joined = judged.select("ord", "domain", "reason").join(known, "domain", "left")
    outcome = F.coalesce(
        "reason", F.when(F.col("_known"), "duplicate").otherwise("added"))
    return joined.select("ord", "domain", outcome.alias("outcome"))


def new_leads(leads: DataFrame, judged: DataFrame, now: Column) -> DataFrame:
    """K1: the rows to add. They are written down before they are numbered, so the texts behind
    ``judged`` are read once. Starts jobs."""
    wanted = judged.filter(F.col("reason").isNull())
    wanted = first_by(wanted, ["domain"], ["ord"]).join(
        leads.select("domain"), "domain", "left_anti")
    last_id = F.coalesce(leads.agg(F.max("id")).scalar(), F.lit(0))
    rows = numbered(written(wanted), ["ord"], "id", start=last_id + 1).select(
        "*", F.coalesce(blank_to_null(F.col("company_name")), "domain").alias("_name")
    ).select(
        "id", F.col("_name").alias("company_name"), F.col("url").alias("website"), "domain",
        "email", "phone", "description", "source", F.col("query").alias("matched_query"),
        "research_only_evidence", "company_type", "sells_direct", "manufactures", "us_based",
        "state", F.lit("new").alias("status"),
        now.alias("created_at"), now.alias("updated_at"))
    return schemas.conform(rows, schemas.LEADS, schemas.LEAD_DEFAULTS)
