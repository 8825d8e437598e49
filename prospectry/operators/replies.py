"""Inbox messages to replies and opt-outs of contacted leads.

Every lead contacted at a mail domain meets the same messages of that domain, so messages are
reduced to one row per mail domain before the join: a domain with a great share of messages and
leads never yields their product. The leads of such a domain are dealt over tasks, each with a copy
of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.mail import wants_out
from ..functions.urls import mail_domain
from ..rules import DEFAULT_RULES, RuleSet
from .leads import TableChange
from .skew import join_skewed

POLICIES = ("any", "first")


def contacted_map(outreach: DataFrame, leads: DataFrame) -> DataFrame:
    """Distinct ``(mail_domain, lead_id)`` of messages that did not fail, to existing leads."""
    sent = outreach.filter(F.col("delivery") != "failed").select(
        mail_domain(F.col("to_email")).alias("mail_domain"), "lead_id").distinct()
    return sent.join(leads.select(F.col("id").alias("lead_id")), "lead_id", "left_semi").select(
        "mail_domain", "lead_id")


def message_digest(messages: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``(mail_domain, n_messages, first_id, first_out, any_out)`` of the senders' domains."""
    out = wants_out(F.col("subject"), F.col("body"), rules.opt_out_pattern)
    rows = messages.select(
        mail_domain(F.col("sender")).alias("mail_domain"), "msg_id", out.alias("out"))
    return rows.groupBy("mail_domain").agg(
        F.count("*").alias("n_messages"), F.min(F.struct("msg_id", "out")).alias("f"),
        F.bool_or("out").alias("any_out"),
    ).select("mail_domain", "n_messages", F.col("f.msg_id").alias("first_id"),
             F.col("f.out").alias("first_out"), "any_out")


def reply_updates(
    contacted: DataFrame, digest: DataFrame, policy: str = "any"
) -> DataFrame:
    """``(lead_id, first_msg_id, opted_out)`` of leads with a reply.

    ``policy='first'`` lets only the first message decide about opting out; ``'any'`` heeds the
    wish in whichever message it comes.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    matched = join_skewed(contacted, digest, "mail_domain")
    per_lead = matched.groupBy("lead_id").agg(
        F.min(F.struct("first_id", "first_out")).alias("f"), F.bool_or("any_out").alias("any_out"))
    out = F.col("any_out") if policy == "any" else F.col("f.first_out")
    return per_lead.select(
        "lead_id", F.col("f.first_id").alias("first_msg_id"), out.alias("opted_out"))


def apply_updates(leads: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """K9: ``replied_at`` is set once, the status becomes ``replied``, opting out is final."""
    new = updates.select(
        F.col("lead_id").alias("id"), F.lit(True).alias("_replied"), F.col("opted_out").alias("_out"))
    rows = leads.join(new, "id", "left")
    replied = F.col("_replied")
    touched = replied & (
        F.col("replied_at").isNull() | (F.col("status") != "replied")
        | (F.col("_out") & ~F.col("opted_out")))
    return rows.withColumns({
        "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
        "replied_at": F.when(replied, F.coalesce("replied_at", now)).otherwise(F.col("replied_at")),
        "status": F.when(replied, "replied").otherwise(F.col("status")),
        "opted_out": F.col("opted_out") | F.coalesce("_out", F.lit(False)),
    }).select(*schemas.LEADS.names)


def apply_replies(
    leads: DataFrame, outreach: DataFrame, messages: DataFrame, now: Column, policy: str = "any",
    rules: RuleSet = DEFAULT_RULES,
) -> TableChange:
    """K9 from messages (``msg_id, sender, subject, body``); outcomes are the reply updates."""
    updates = reply_updates(
        contacted_map(outreach, leads), message_digest(messages, rules), policy)
    return TableChange(apply_updates(leads, updates, now), updates)


def unmatched_messages(digest: DataFrame, contacted: DataFrame) -> DataFrame:
    """senders' domains nobody was contacted at, with their message counts."""
    return digest.join(contacted.select("mail_domain").distinct(), "mail_domain", "left_anti")


def reply_funnel(digest: DataFrame, contacted: DataFrame, policy: str = "any") -> DataFrame:
    """``(outcome, n)``: replies and opt-outs per lead, unmatched per message."""
    updates = reply_updates(contacted, digest, policy)
    strays = unmatched_messages(digest, contacted)
    rows = updates.select(
        F.when(F.col("opted_out"), "opt_outs").otherwise("replies").alias("outcome"),
        F.lit(1).cast("bigint").alias("n")
    ).unionByName(strays.select(F.lit("unmatched").alias("outcome"), F.col("n_messages").alias("n")))
    counts = rows.agg(*[
        F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)).alias(k)
        for k in ("replies", "opt_outs", "unmatched")])
    pairs = F.array(*[
        F.struct(F.lit(k).alias("outcome"), F.col(k).alias("n"))
        for k in ("replies", "opt_outs", "unmatched")])
    return counts.select(F.explode(pairs).alias("p")).select("p.outcome", "p.n")
