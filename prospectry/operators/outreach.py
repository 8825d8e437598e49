"""Which lead is due for which message, and the message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.mail import fill_template, sender_problems, step_label
from ..rules import FINAL_STATUSES, INTERVAL_DAYS, MAX_FOLLOWUPS
from .leads import TableChange
from .funnels import long_counts
from .ordering import numbered


def contactable(leads: DataFrame, only_manufacturers: bool = False) -> DataFrame:
    """P10/P11."""
    out = leads.filter(F.col("email").isNotNull() & (F.col("email") != ""))
    return out.filter("manufactures") if only_manufacturers else out


def is_stopped() -> Column:
    """Replied, opted out, or in a final status."""
    return (
        F.col("replied_at").isNotNull() | F.coalesce("opted_out", F.lit(False))
        | F.lower(F.coalesce("status", F.lit(""))).isin(list(FINAL_STATUSES)))


def message_history(outreach: DataFrame) -> DataFrame:
    """``(lead_id, n_delivered, last_at)`` over messages that did not fail."""
    delivered = outreach.filter(F.col("delivery") != "failed")
    return delivered.groupBy("lead_id").agg(
        F.count("*").alias("n_delivered"), F.max("created_at").alias("last_at"))


def next_step(now: Column, interval_days: int = INTERVAL_DAYS,
              max_followups: int = MAX_FOLLOWUPS) -> Column:
    """1 for a first contact, 2 and up for follow-ups, null when nothing is due."""
    n = F.coalesce("n_delivered", F.lit(0))
    waited = F.col("last_at").isNull() | (
        F.col("last_at") <= now - F.make_dt_interval(days=F.lit(interval_days)))
    return (
        F.when(is_stopped(), F.lit(None))
        .when(n == 0, F.lit(1))
        .when(n >= max_followups + 1, F.lit(None))
        .when(waited, n + 1)
        .cast("int"))


def with_next_step(
    leads: DataFrame, outreach: DataFrame, now: Column, interval_days: int = INTERVAL_DAYS,
    max_followups: int = MAX_FOLLOWUPS,
) -> DataFrame:
    """Leads with ``n_delivered``, ``last_at`` and ``next_step``; one aggregate, one join."""
    history = message_history(outreach).withColumnRenamed("lead_id", "id")
    return leads.join(history, "id", "left").withColumn(
        "next_step", next_step(now, interval_days, max_followups))


def plan_outreach(
    leads: DataFrame, outreach: DataFrame, now: Column, only_manufacturers: bool = False,
    limit: int | None = None, interval_days: int = INTERVAL_DAYS,
    max_followups: int = MAX_FOLLOWUPS,
) -> DataFrame:
    """L2: leads that are due, with ``step``, oldest first; at most ``limit``.

    Stopped leads are filtered before the join with the history.
    """
    open_ = contactable(leads, only_manufacturers).filter(~is_stopped())
    due = with_next_step(open_, outreach, now, interval_days, max_followups)
    due = due.filter(F.col("next_step").isNotNull()).withColumn("step", F.col("next_step"))
    due = due.select(*leads.columns, "step").orderBy(F.col("created_at").asc_nulls_first(), "id")
    return due if limit is None else due.limit(limit)


def render_messages(
    planned: DataFrame, first: tuple[str, str], follow_up: tuple[str, str], sender: dict[str, str]
) -> DataFrame:
    """the planned leads with ``to_email, subject, body, label``.

    ``first`` and ``follow_up`` are (subject, body) templates, ``sender`` the named fields.
    """
    intro = F.col("step") == 1
    body = F.when(intro, F.lit(first[1])).otherwise(F.lit(follow_up[1]))
    return planned.withColumns({
        "to_email": F.col("email"),
        "subject": F.when(intro, F.lit(first[0])).otherwise(F.lit(follow_up[0])),
        "body": fill_template(body, sender),
        "label": step_label(F.col("step")),
    })


def draft_rows(messages: DataFrame, sender_name: str, sender_email: str) -> DataFrame:
    """K5: header fields, body and draft name of each message; no Reply-To without a sender."""
    needs_quotes = F.lit(sender_name).rlike(r'[()<>@,:;".\[\]\\]')
    name = F.when(
        needs_quotes, F.concat(F.lit('"'), F.regexp_replace(F.lit(sender_name), r'([\\"])', r"\\$1"),
                               F.lit('"'))).otherwise(F.lit(sender_name))
    from_ = F.when(
        F.lit(sender_name) == "", F.lit(sender_email)
    ).otherwise(F.concat(name, F.lit(f" <{sender_email}>")))
    return messages.select(
        F.col("id").alias("lead_id"), "step", F.col("to_email").alias("to"), "subject",
        from_.alias("from"),
        F.lit(sender_email if sender_email else None).cast("string").alias("reply_to"), "body",
        F.format_string(
            "%04d-step%d-%s.eml", "id", "step", F.replace("domain", F.lit("."), F.lit("_"))
        ).alias("draft"))


def with_problems(messages: DataFrame, sender: dict[str, str]) -> DataFrame:
    """``problems`` that keep a message from being sent (drafts may still be written)."""
    field = lambda k: F.lit(sender.get(k))
    return messages.withColumn("problems", sender_problems(
        field("sender_email"), field("sender_postal_address"), field("unsubscribe_line")))


def with_delivery(messages: DataFrame, send: bool) -> DataFrame:
    """Delivery of each message as planned: drafts, or hand-over to a mail server.

    Sending with incomplete sender settings is refused: reading such a row raises an error.
    """
    delivery = F.lit("drafted")
    if send:
        delivery = F.when(F.size("problems") == 0, F.lit("sent")).otherwise(F.raise_error(
            F.concat(F.lit("sender settings missing: "), F.array_join("problems", ", "))))
    return messages.withColumns(
        {"delivery": delivery, "error": F.lit(None).cast("string")})


def log_rows(outreach: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """K4: the log rows of ``messages`` (``id`` is the lead's), numbered on from the log's last in
    the order in which they are sent: oldest lead first, as planned. Only lead ids are numbered; the
    texts are joined to them."""
    last_id = F.coalesce(outreach.agg(F.max("id")).scalar(), F.lit(0))
    turns = numbered(
        messages.select(F.col("id").alias("lead_id"), "created_at"),
        [F.col("created_at").asc_nulls_first(), "lead_id"], "id", start=last_id + 1)
    rows = messages.withColumnRenamed("id", "lead_id").select(
        "lead_id", "to_email", "step", "subject", "body", "delivery", "error",
        now.alias("created_at")).join(turns.select("lead_id", "id"), "lead_id")
    return schemas.conform(rows, schemas.OUTREACH, schemas.OUTREACH_DEFAULTS)


def mark_contacted(leads: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """K4: leads with a message that did not fail become ``contacted``."""
    delivered = messages.filter(F.col("delivery") != "failed").select(
        "id", F.lit(True).alias("_contacted")).distinct()
    rows = leads.join(delivered, "id", "left")
    return rows.withColumns({
        "status": F.when(F.col("_contacted"), "contacted").otherwise(F.col("status")),
        "updated_at": F.when(F.col("_contacted"), now).otherwise(F.col("updated_at")),
    }).select(*schemas.LEADS.names)


def log_outreach(
    leads: DataFrame, outreach: DataFrame, messages: DataFrame, now: Column
) -> tuple[DataFrame, TableChange]:
    """K4: ``(new leads table, change of the log)``."""
    log = outreach.unionByName(log_rows(outreach, messages, now))
    return mark_contacted(leads, messages, now), TableChange(log, messages)


def outreach_funnel(messages: DataFrame) -> DataFrame:
    """A5 over messages with ``step`` and ``delivery``."""
    ok = F.col("delivery") != "failed"
    return long_counts(messages, {
        "prepared": F.count("*"),
        "first_contact": F.count_if(ok & (F.col("step") == 1)),
        "followups": F.count_if(ok & (F.col("step") > 1)),
        "sent": F.count_if(F.col("delivery") == "sent"),
        "drafted": F.count_if(F.col("delivery") == "drafted"),
        "failed": F.count_if(F.col("delivery") == "failed"),
    })


def due_counts(
    leads: DataFrame, outreach: DataFrame, now: Column, interval_days: int = INTERVAL_DAYS,
    max_followups: int = MAX_FOLLOWUPS,
) -> DataFrame:
    """One row ``(due, contactable)``."""
    steps = with_next_step(contactable(leads), outreach, now, interval_days, max_followups)
    return steps.agg(F.count("next_step").alias("due"), F.count("*").alias("contactable"))
