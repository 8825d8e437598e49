"""Replies first, then whoever is still due: one tick of the cadence."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import outreach as out_ops
from ..operators import replies as reply_ops
from ..rules import DEFAULT_RULES, INBOX_DAYS, INTERVAL_DAYS, MAX_FOLLOWUPS, RuleSet
from ..sources.tables import recent_messages, written


class Tick(NamedTuple):
    leads_after_replies: DataFrame
    reply_updates: DataFrame
    messages: DataFrame
    new_log_rows: DataFrame
    leads: DataFrame
    funnel: DataFrame


def run(
    leads: DataFrame, outreach: DataFrame, inbox: DataFrame | None, now: Column,
    first: tuple[str, str], follow_up: tuple[str, str], sender: dict[str, str],
    only_manufacturers: bool = False, limit: int | None = None, send: bool = False,
    interval_days: int = INTERVAL_DAYS, max_followups: int = MAX_FOLLOWUPS,
    since_days: int = INBOX_DAYS, policy: str = "any", rules: RuleSet = DEFAULT_RULES,
) -> Tick:
    """``messages`` is the hand-over to whatever delivers mail; ``new_log_rows`` goes to the log.

    A message is planned only for a (lead, step) the log has no delivered row for, so a tick that
    is run again over its own log plans nothing twice. The plan is worked out once and written down.
    """
    if inbox is None:
        updates = leads.select(F.col("id").alias("lead_id")).limit(0).withColumns({
            "first_msg_id": F.lit(None).cast("bigint"), "opted_out": F.lit(False)})
        answered = leads
    else:
        answered, updates = reply_ops.apply_replies(
            leads, outreach, recent_messages(inbox, now, since_days), now, policy, rules)
    planned = written(out_ops.plan_outreach(
        answered, outreach, now, only_manufacturers, limit, interval_days, max_followups))
    messages = out_ops.with_delivery(
        out_ops.with_problems(out_ops.render_messages(planned, first, follow_up, sender), sender),
        send)
    return Tick(
        answered, updates, messages, out_ops.log_rows(outreach, messages, now),
        out_ops.mark_contacted(answered, messages, now), out_ops.outreach_funnel(messages))
