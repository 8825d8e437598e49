"""A hand-kept roster of companies into the lead table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.strings import blank_to_null
from ..rules import ROSTER_HOME_COUNTRY, ROSTER_SOURCE
from .leads import TableChange
from .ordering import first_by, numbered
from .skew import join_skewed


def roster_part(
    roster: DataFrame, country: str | None = None, limit: int | None = None
) -> DataFrame:
    """One country's names (any case; none given: all), then the first ``limit``."""
    if country:
        roster = roster.filter(F.lower("country") == country.lower())
    return roster if limit is None else roster.orderBy("ord").limit(limit)


def missing_names(roster: DataFrame, domain_map: DataFrame) -> DataFrame:
    """Roster rows whose name has no domain yet."""
    return roster.join(domain_map.select("name"), "name", "left_anti").select(*roster.columns)


def merge_domain_map(domain_map: DataFrame, found: DataFrame) -> DataFrame:
    """``(name, country, domain)`` sorted by name; newly found rows win, the last of them
    by ``line_no``."""
    old = domain_map.withColumn("_new", F.lit(0))
    new = found.withColumn("_new", F.lit(1))
    both = old.select("_new", "line_no", "name", "country", "domain").unionByName(
        new.select("_new", "line_no", "name", "country", "domain"))
    best = both.groupBy("name").agg(
        F.max(F.struct("_new", "line_no", "country", "domain")).alias("b"))
    return best.select("name", "b.country", "b.domain").orderBy("name")


def located_roster(roster: DataFrame, domain_map: DataFrame) -> DataFrame:
    """Roster rows with their domain, null where the map has none."""
    known = domain_map.select("name", "domain")
    return roster.join(known, "name", "left").select("ord", "name", "country", "domain")


def roster_outcomes(
    located: DataFrame, leads: DataFrame, profiles: DataFrame | None = None
) -> DataFrame:
    """``(ord, name, domain, outcome, enrichment)`` of every roster row.

    W10: of several names on one new domain the first adds it, the others update it. With
    ``profiles`` the enrichment of leads without an address is told as well: ``enriched``,
    ``reached`` (a page, but no address) or ``unreachable``; once an address is found, later rows
    of that domain need none (null).
    """
    firsts = located.filter(F.col("domain").isNotNull()).groupBy("domain").agg(
        F.min("ord").alias("_first"))
    known = leads.select(
        "domain", F.lit(True).alias("_known"), blank_to_null(F.col("email")).alias("_email"))
    facts = firsts.join(known, "domain", "left")
    if profiles is not None:
        facts = facts.join(
            profiles.select("domain", "n_pages", F.col("email").alias("_found")), "domain", "left")
    rows = join_skewed(located, facts, "domain", "left")
    is_first = F.col("ord") == F.col("_first")
    outcome = (
        F.when(F.col("domain").isNull(), "no_domain")
        .when(F.col("_known").isNull() & is_first, "added").otherwise("updated"))
    enrichment = F.lit(None).cast("string")
    if profiles is not None:
        address = blank_to_null(F.col("_found")).isNotNull()
        enrichment = F.when(
            F.col("domain").isNotNull() & F.col("_email").isNull(),
            F.when(address, F.when(is_first, "enriched"))
            .when(F.coalesce("n_pages", F.lit(0)) > 0, "reached").otherwise("unreachable"))
    return rows.select(
        "ord", "name", "domain", outcome.alias("outcome"), enrichment.alias("enrichment"))


def tagged_source(source: Column, tag: str = ROSTER_SOURCE) -> Column:
    """the tag appended once."""
    return F.when(
        (source != "") & ~F.contains(source, F.lit(tag)), F.concat(source, F.lit("+" + tag))
    ).otherwise(source)


def merge_roster(
    leads: DataFrame, located: DataFrame, now: Column, profiles: DataFrame | None = None
) -> TableChange:
    """Every located roster row is a lead afterwards; optionally enriched."""
    rows = first_by(
        located.filter(F.col("domain").isNotNull()).select("domain", "ord", "name", "country"),
        ["domain"], ["ord"])
    last_id = F.coalesce(leads.agg(F.max("id")).scalar(), F.lit(0))
    fresh = rows.join(leads.select("domain"), "domain", "left_anti")
    fresh = numbered(fresh, ["ord"], "id", start=last_id + 1).select(
        "id", F.col("name").alias("company_name"),
        F.concat(F.lit("https://"), "domain", F.lit("/")).alias("website"), "domain",
        F.lit(ROSTER_SOURCE).alias("source"),
        (F.col("country") == ROSTER_HOME_COUNTRY).alias("us_based"), F.lit("new").alias("status"),
        now.alias("created_at"), now.alias("updated_at"))
    fresh = schemas.conform(fresh, schemas.LEADS, schemas.LEAD_DEFAULTS)
    listed = rows.select("domain", F.lit(True).alias("_listed"))
    marked = leads.join(listed, "domain", "left")
    source = F.when(F.col("_listed"), tagged_source(F.col("source"))).otherwise(F.col("source"))
    changed = source != F.col("source")
    kept = marked.withColumns({
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
        "source": source,
    }).select(*schemas.LEADS.names)
    table = kept.unionByName(fresh)
    if profiles is not None:
        table = enrich_leads(table, profiles, now, only=listed.select("domain"))
    return TableChange(table, roster_outcomes(located, leads, profiles))


def enrich_leads(
    leads: DataFrame, profiles: DataFrame, now: Column, only: DataFrame | None = None
) -> DataFrame:
    """Leads without an address take from their site's profile what they lack.

    Only empty fields are filled, flags are OR-ed, ``us_based`` is left alone.
    """
    found = profiles.select(
        "domain", *[F.col(c).alias(f"_{c}") for c in (
            "email", "phone", "description", "company_type", "research_only_evidence", "state",
            "sells_direct", "manufactures", "n_pages")])
    if only is not None:
        found = found.join(only, "domain", "left_semi")
    rows = leads.join(found.filter(F.col("_n_pages") > 0), "domain", "left")
    open_ = (F.coalesce("email", F.lit("")) == "") & F.col("_n_pages").isNotNull()
    updates: dict[str, Column] = {}
    for c in ("email", "phone", "description", "company_type", "research_only_evidence", "state"):
        fill = (F.coalesce(c, F.lit("")) == "") & (F.coalesce(f"_{c}", F.lit("")) != "")
        updates[c] = F.when(open_ & fill, F.col(f"_{c}")).otherwise(F.col(c))
    for c in ("sells_direct", "manufactures"):
        more = F.coalesce(open_ & F.col(f"_{c}"), F.lit(False))
        updates[c] = F.coalesce(c, F.lit(False)) | more
    changed = F.lit(False)
    for c, v in updates.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    updates["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    return rows.withColumns(updates).select(*schemas.LEADS.names)
