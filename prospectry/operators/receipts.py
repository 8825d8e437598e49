"""What became of the messages handed over: receipts into the message log and the lead table (K4, A5).

A receipt is ``(lead_id, step, delivery, error, delivered_at)``. Receipts come late, more than once
and in any order. The outcome of a message is a merge keyed by lead and step: the first ``sent``,
else the first ``drafted``, else the last ``failed``. Merging is associative and merging a receipt
again changes nothing, so receipts can be applied as often as they come.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .outreach import is_stopped, mark_contacted
from .ordering import numbered

KEY = ["lead_id", "step"]


class Delivered(NamedTuple):
    """The tables after receipts, and ``(lead_id, step, delivery, outcome)`` of each outcome."""

    leads: DataFrame
    log: DataFrame
    outcomes: DataFrame


def final_receipts(receipts: DataFrame) -> DataFrame:
    """``(lead_id, step, delivery, error, delivered_at)``: one row for each lead and step.

    Combines before the shuffle, so a message with very many receipts costs one row a task.
    Deliveries other than sent and drafted count as failed; receipts without a lead or step go.
    """
    rank = F.when(F.col("delivery") == "sent", 0).when(F.col("delivery") == "drafted", 1)
    rows = receipts.filter("lead_id IS NOT NULL AND step IS NOT NULL").select(*KEY, rank.alias("_rank"), "delivered_at", "error")
    best = rows.groupBy(*KEY).agg(
        F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "delivered_at"))).alias("_ok"),
        F.max(F.when(F.col("_rank").isNull(), F.struct("delivered_at", "error"))).alias("_failed"))
    ok = F.col("_ok").isNotNull()
    return best.select(
        *KEY,
        F.when(F.col("_ok._rank") == 0, "sent").when(ok, "drafted").otherwise("failed").alias("delivery"),
        F.when(~ok, F.col("_failed.error")).alias("error"),
        F.when(ok, F.col("_ok.delivered_at")).otherwise(F.col("_failed.delivered_at")).alias("delivered_at"))


def _told(outreach: DataFrame, messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """Final receipts with what is planned for them (``_planned``) and what the log has already:
    ``_done``, a delivered row of that lead and step, and ``_same``, a row of the same moment."""
    planned = messages.select(F.col("id").alias("lead_id"), "step", F.lit(True).alias("_planned")).distinct()
    done = outreach.filter(F.col("delivery") != "failed").select(*KEY, F.lit(True).alias("_done")).distinct()
    same = outreach.select(*KEY, F.col("created_at").alias("delivered_at"), F.lit(True).alias("_same")).distinct()
    rows = final_receipts(receipts).join(planned, KEY, "left").join(done, KEY, "left")
    return rows.join(same, [*KEY, "delivered_at"], "left")


def receipt_outcomes(outreach: DataFrame, messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(lead_id, step, delivery, outcome)``: ``logged``, ``known`` (the log has it, or the message
    was delivered before) or ``unplanned`` (no such message)."""
    outcome = (
        F.when(F.col("_done") | F.col("_same"), "known").when(F.col("_planned"), "logged").otherwise("unplanned"))
    return _told(outreach, messages, receipts).select(*KEY, "delivery", outcome.alias("outcome"))


def receipt_log_rows(outreach: DataFrame, messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """K4: the log rows of planned ``messages`` (``id`` is the lead's) that have a receipt, numbered on
    from the log's last in the order of delivery. Messages without a receipt are still open; what the
    log has already is not logged again. Only keys are numbered, the texts are joined to them."""
    last_id = F.coalesce(outreach.agg(F.max("id")).scalar(), F.lit(0))
    fresh = _told(outreach, messages, receipts).filter("_planned AND _done IS NULL AND _same IS NULL")
    ages = messages.select(F.col("id").alias("lead_id"), "step", F.col("created_at").alias("_since"))
    turns = numbered(
        fresh.select(*KEY, "delivery", "error", "delivered_at").join(ages, KEY),
        ["delivered_at", F.col("_since").asc_nulls_first(), "lead_id", "step"], "id", start=last_id + 1)
    texts = messages.select(F.col("id").alias("lead_id"), "step", "to_email", "subject", "body")
    rows = turns.drop("_since").withColumnRenamed("delivered_at", "created_at").join(texts, KEY)
    return schemas.conform(rows, schemas.OUTREACH, schemas.OUTREACH_DEFAULTS)


def apply_receipts(
    leads: DataFrame, outreach: DataFrame, messages: DataFrame, receipts: DataFrame, now: Column
) -> Delivered:
    """K4: delivered messages make their leads ``contacted``; failed ones are logged with their error
    and leave the lead as it was. Applied again to its own result it changes nothing."""
    rows = receipt_log_rows(outreach, messages, receipts)
    reached = rows.select(F.col("lead_id").alias("id"), "delivery")
    return Delivered(
        mark_contacted(leads, reached, now), outreach.unionByName(rows), receipt_outcomes(outreach, messages, receipts))


def with_receipts(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """``messages`` that have a receipt, with its ``delivery`` and ``error``; ``outreach_funnel`` over
    them counts what really happened."""
    final = final_receipts(receipts).select(F.col("lead_id").alias("id"), "step", "delivery", "error")
    return messages.drop("delivery", "error").join(final, ["id", "step"])


def leads_as_logged(leads: DataFrame, outreach: DataFrame) -> DataFrame:
    """The lead table as of the message log: a lead whose last delivered message is newer than its row
    becomes ``contacted`` as of that message, unless it has replied, opted out or is closed."""
    sent = outreach.filter(F.col("delivery") != "failed").groupBy(F.col("lead_id").alias("id")).agg(
        F.max("created_at").alias("_at"))
    newer = F.col("_at").isNotNull() & (F.col("updated_at").isNull() | (F.col("_at") > F.col("updated_at"))) & ~is_stopped()
    return leads.join(sent, "id", "left").withColumns({
        "status": F.when(newer, "contacted").otherwise(F.col("status")),
        "updated_at": F.when(newer, F.col("_at")).otherwise(F.col("updated_at")),
    }).select(*schemas.LEADS.names)
