"""A roster of names into the lead table: look up missing domains, merge, enrich."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import hosts as host_ops
from ..operators import matching, roster as roster_ops
from ..operators.funnels import roster_funnel
from ..rules import DEFAULT_RULES, RuleSet
from ..sources.tables import written


class RosterImport(NamedTuple):
    domain_map: DataFrame
    leads: DataFrame
    outcomes: DataFrame
    funnel: DataFrame
    unresolved: DataFrame


def run(
    roster: DataFrame, domain_map: DataFrame, leads: DataFrame, now: Column,
    lookups: DataFrame | None = None, profiles: DataFrame | None = None,
    country: str | None = None, limit: int | None = None, rules: RuleSet = DEFAULT_RULES,
) -> RosterImport:
    """``lookups`` (``name, position, url``) answers for names without a domain; only those are
    scored. ``profiles`` of the sites enriches leads without an address."""
    part = roster_ops.roster_part(roster, country, limit)
    missing = roster_ops.missing_names(part, domain_map)
    if lookups is None:
        resolved = missing.withColumn("domain", F.lit(None).cast("string"))
    else:
        wanted = lookups.join(missing.select("name"), "name", "left_semi")
        resolved = matching.resolve_names(missing, wanted, rules)
    found = resolved.filter(F.col("domain").isNotNull()).select(
        F.col("ord").alias("line_no"), "name", "country", "domain")
    merged = roster_ops.merge_domain_map(domain_map, found)
    located = roster_ops.located_roster(part, merged)
    change = roster_ops.merge_roster(leads, located, now, profiles)
    return RosterImport(
        merged, change.table, change.outcomes, roster_funnel(change.outcomes),
        matching.unresolved_sample(resolved))


class Resolution(NamedTuple):
    """``totals`` is one row ``(resolved, unresolved, added, known)``: names, then seed hosts."""

    domain_map: DataFrame
    seed_additions: DataFrame
    totals: DataFrame
    unresolved: DataFrame


def resolve(
    roster: DataFrame, domain_map: DataFrame, lookups: DataFrame, seeds: DataFrame,
    country: str | None = None, limit: int | None = None, rules: RuleSet = DEFAULT_RULES,
) -> Resolution:
    """Every name of the roster (or of one country's, or the first ``limit``) is looked up, also one
    that has a domain already; what is found goes into the map and onto the seed list. Leads are not
    touched. ``lookups`` is ``(name, position, url)``, ``seeds`` ``(url)``."""
    part = roster_ops.roster_part(roster, country, limit)
    wanted = lookups.join(part.select("name").distinct(), "name", "left_semi")
    resolved = written(matching.resolve_names(part, wanted, rules))
    found = resolved.filter(F.col("domain").isNotNull())
    rows = found.select(F.col("ord").alias("line_no"), "name", "country", "domain")
    hosts = found.select(F.col("domain").alias("host")).distinct()
    merged = written(host_ops.seed_merge_counts(hosts, seeds))
    totals = matching.resolution_totals(resolved).select(
        "resolved", "unresolved", merged.select("added").scalar().alias("added"),
        merged.select("already").scalar().alias("known"))
    return Resolution(
        roster_ops.merge_domain_map(domain_map, rows), host_ops.seed_additions(hosts, seeds), totals,
        matching.unresolved_sample(resolved))
