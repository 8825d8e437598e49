"""From candidates and stored pages to new leads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_domain, url_path
from ..operators import candidates as cand
from ..operators import gates, leads as lead_ops, sites
from ..operators.funnels import discovery_funnel
from ..operators.skew import join_skewed
from ..rules import DEFAULT_RULES, RuleSet
from ..sources.tables import written


@dataclass(frozen=True)
class Discovery:
    """``judged`` is worked out and written down; the rest follows from it without reading pages.

    ``new_leads`` is numbered when it is first asked for: a preview needs none of that.
    """

    judged: DataFrame
    outcomes: DataFrame
    funnel: DataFrame
    leads: DataFrame
    now: Column

    @cached_property
    def new_leads(self) -> DataFrame:
        return lead_ops.new_leads(self.leads, self.judged, self.now)


def gated(
    evidence: DataFrame, domains: DataFrame, host_addresses: DataFrame | None = None,
    robots_rules: DataFrame | None = None, unreadable: DataFrame | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Page rows of the given (distinct) domains that may be read: public hosts, paths robots allow.

    ``keys`` has the ``url`` of all pages and nothing dear: hosts and paths are judged on it, before
    pages are parsed, and written down. A domain with a great share of the pages is dealt over tasks.
    """
    keys = (evidence if keys is None else keys).select("url").withColumn("domain", url_domain(F.col("url")))
    domains = domains.select("domain")
    if host_addresses is not None:
        domains = gates.only_public(domains, host_addresses)
    domains = written(domains)
    rows = join_skewed(evidence, domains, "domain", "left_semi", keys)
    if robots_rules is not None:
        asked = join_skewed(keys, domains, "domain", "left_semi").select("domain", _robots_path().alias("path"))
        closed = written(gates.robots_verdicts(
            written(asked.distinct()), robots_rules, unreadable).filter("NOT allowed").select("domain", "path"))
        rows = rows.withColumn("path", _robots_path()).join(closed, ["domain", "path"], "left_anti")
    return rows.select(*evidence.columns)


def _robots_path() -> Column:
    path = url_path(F.col("url"))
    return F.when(path == "", F.lit("/")).otherwise(path)


def run(
    candidates: DataFrame, pages: DataFrame, leads: DataFrame, now: Column,
    rules: RuleSet = DEFAULT_RULES, limit: int | None = None, allow_non_us: bool = False,
    vendors_only: bool = True, candidates_only: bool = True, skip_known: bool = True,
    host_addresses: DataFrame | None = None, robots_rules: DataFrame | None = None,
    unreadable: DataFrame | None = None,
) -> Discovery:
    """Visit list, profiles, qualification, insertion and funnel.

    Pages are reduced to evidence where they are read; visits, gates and known leads join those
    narrow rows, so page bodies are never shuffled for them. ``skip_known`` leaves domains that
    are leads already out of the roll-up; those visits are still reported, as ``duplicate`` (a
    full run would report some of them as skipped).
    """
    visits = cand.visit_list(candidates, limit)
    to_read = visits.select("domain")
    if skip_known:
        to_read = to_read.join(leads.select("domain"), "domain", "left_anti")
    evidence = gated(
        sites.page_evidence(pages, rules, candidates_only), to_read, host_addresses, robots_rules,
        unreadable, keys=pages)
    profiles = sites.profiles_from(evidence, rules, candidates_only)
    judged = lead_ops.judged_visits(visits, profiles, allow_non_us, vendors_only)
    if skip_known:
        known = leads.select("domain", F.lit(True).alias("_known"))
        judged = judged.join(known, "domain", "left").withColumn(
            "reason", F.when(F.col("_known").isNull(), F.col("reason"))).drop("_known")
    judged = written(judged)
    outcomes = lead_ops.lead_outcomes(leads, judged)
    return Discovery(judged, outcomes, discovery_funnel(outcomes), leads, now)
