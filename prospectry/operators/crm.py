"""Lead list, lead history, manual edits and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.strings import blank_to_null
from .leads import TableChange
from .ordering import places_within

#: A lead's messages are nested by pages of 2^12, so no row ever holds more.
HISTORY_BITS = 12
_HISTORY_FIELDS = ("id", "created_at", "delivery", "to_email", "step", "error")


def list_leads(leads: DataFrame, status: str = "", company_type: str = "") -> DataFrame:
    """Filtered leads, newest first; an empty filter lets everything through."""
    if status:
        leads = leads.filter(F.col("status") == status)
    if company_type:
        leads = leads.filter(F.col("company_type") == company_type)
    return leads.orderBy(F.col("created_at").desc_nulls_last(), "id")


def display_rows(leads: DataFrame) -> DataFrame:
    """The columns of the lead list as shown."""
    dash = F.lit("—")
    shown = lambda c: F.coalesce(blank_to_null(F.col(c)), dash)
    return leads.select(
        "id", "company_name", "website", "domain", shown("email").alias("email"),
        F.replace(shown("company_type"), F.lit("_"), F.lit(" ")).alias("company_type"),
        shown("state").alias("state"), "status", "source",
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("")).alias("added"))


def lead_by_id(leads: DataFrame, lead_id: int) -> DataFrame:
    """One row or none."""
    return leads.filter(F.col("id") == lead_id)


def lead_history(leads: DataFrame, outreach: DataFrame) -> DataFrame:
    """Leads with their messages nested in log order.

    One row for each lead and each page (``part``, from 0) of its messages; all but the last page
    are full, however the log ids lie. A lead without messages has one row, of part 0. Only leads
    with more than a page are numbered, which starts a job.
    """
    places = places_within(outreach, "lead_id", "id", 1 << HISTORY_BITS)
    parted = outreach.join(places, ["lead_id", "id"], "left").withColumn(
        "part", F.shiftright(F.coalesce("place", F.lit(0)).cast("bigint"), HISTORY_BITS))
    nested = parted.groupBy("lead_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(*_HISTORY_FIELDS))).alias("history"))
    joined = leads.join(nested.withColumnRenamed("lead_id", "id"), "id", "left")
    empty = F.array().cast(nested.schema["history"].dataType)
    return joined.select(
        *leads.columns, F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        F.coalesce("history", empty).alias("history"))


def delete_leads(
    leads: DataFrame, outreach: DataFrame, deletes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """K6: both tables without the leads in ``deletes`` (``lead_id``); unknown ids do nothing."""
    ids = deletes.select("lead_id").distinct()
    return (
        leads.join(ids.withColumnRenamed("lead_id", "id"), "id", "left_anti").select(*leads.columns),
        outreach.join(ids, "lead_id", "left_anti").select(*outreach.columns))


def apply_edits(leads: DataFrame, edits: DataFrame, now: Column) -> TableChange:
    """K7: ``edits`` (``ord, lead_id, status, company_type, notes, opted_out``) in order.

    Status and notes change where given; company type (blank: none) and opting out are taken as
    they are. Whoever is or becomes ``replied`` gets ``replied_at`` once.
    """
    def last(c: str, given: Column | None = None) -> Column:
        key = F.struct("ord", F.col(c).alias("v"))
        return F.max(key if given is None else F.when(given, key))["v"]

    final = edits.groupBy(F.col("lead_id").alias("id")).agg(
        F.lit(True).alias("_edited"),
        last("status", F.col("status").isNotNull()).alias("_status"),
        last("notes", F.col("notes").isNotNull()).alias("_notes"),
        last("company_type").alias("_type"),
        F.coalesce(last("opted_out"), F.lit(False)).alias("_out"),
        F.coalesce(F.bool_or(F.col("status") == "replied"), F.lit(False)).alias("_replied"),
        F.min(F.struct("ord", "status"))["status"].isNull().alias("_kept_first"))
    rows = leads.join(final, "id", "left")
    edited = F.coalesce("_edited", F.lit(False))
    replied = edited & (
        F.col("_replied") | (F.col("_kept_first") & (F.col("status") == "replied")))
    new = {
        "replied_at": F.when(replied, F.coalesce("replied_at", now)).otherwise(F.col("replied_at")),
        "status": F.coalesce("_status", "status"),
        "company_type": F.when(edited, blank_to_null(F.col("_type"))).otherwise(
            F.col("company_type")),
        "notes": F.coalesce("_notes", "notes"),
        "opted_out": F.when(edited, F.col("_out")).otherwise(F.col("opted_out")),
    }
    changed = F.lit(False)
    for c, v in new.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    new["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    table = rows.withColumns(new).select(*schemas.LEADS.names)
    known = edits.join(leads.select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    return TableChange(table, known)
