"""Pages to one profile per domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact, html, urls
from ..rules import DEFAULT_RULES, RuleSet
from ..sources.tables import readable_pages
from .ordering import first_by
from .site_text import conclusions, page_findings, site_findings

PAGE_FIELDS = ("company_name", "description", "email", "phone")
_KEPT = ("url",) + PAGE_FIELDS


def _paths(rules: RuleSet) -> Column:
    return F.array(*[F.lit(p) for p in rules.candidate_paths])


def candidate_page_urls(domains: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``(domain, path_rank, path, url)`` of the pages to read for each domain."""
    rows = domains.select("domain", F.posexplode(_paths(rules)).alias("path_rank", "p"))
    path = F.when(F.col("p") == "", F.lit("/")).otherwise(F.col("p"))
    return rows.select(
        "domain", "path_rank", path.alias("path"),
        F.concat(F.lit("https://"), "domain", path).alias("url"))


def pages_on_paths(pages: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Readable pages on the candidate paths of their domain; ``ord`` is the rank of the path."""
    path = F.regexp_replace(urls.url_path(F.col("url")), r"/+\z", "")
    located = readable_pages(pages).select(
        "page_id", "url", "html", urls.url_domain(F.col("url")).alias("domain"),
        (F.array_position(_paths(rules), path) - 1).alias("ord"))
    return located.filter((F.col("ord") >= 0) & (F.col("domain") != ""))


def candidate_pages(pages: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``(domain, ord, page_id, url)`` of a domain's candidate pages, one per path (the lowest
    ``page_id``), so a site never has more pages than there are paths. The choice combines before
    the shuffle: many copies of one path cost one row per map task."""
    located = pages_on_paths(pages, rules).select("domain", "ord", "page_id", "url")
    return first_by(located, ["domain", "ord"], ["page_id"])


def page_features(
    pages: DataFrame, rules: RuleSet = DEFAULT_RULES, ord_col: str = "page_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(domain, ord, *keep, url, text, company_name, description, email, phone)`` of each page
    (F16-F19, F1, F2, W5). Addresses come from links first, then from the raw markup (U3)."""
    domain = F.col("domain") if "domain" in pages.columns else urls.url_domain(F.col("url"))
    live = readable_pages(pages).select(
        domain.alias("domain"), F.col(ord_col).alias("ord"), *keep, "url", "html",
        html.live_markup(F.col("html")).alias("live"),
    ).filter(F.col("domain") != "")
    texts = live.withColumns({
        "nodes": html.joined_nodes(F.col("live")), "tags": html.meta_tags(F.col("live")),
    }).withColumn(
        "text", html.decode_entities(F.col("nodes")))
    pool = F.concat(html.mailto_addresses(F.col("live")), contact.addresses(F.col("html")))
    return texts.select(
        "domain", "ord", *keep, "url", "text",
        html.company_name(F.col("live"), F.col("tags")).alias("company_name"),
        html.meta_description(F.col("live"), F.col("tags")).alias("description"),
        contact.best_address(pool, F.col("domain"), rules).alias("email"),
        contact.first_phone(F.col("text")).alias("phone"))


def contact_rollup(features: DataFrame) -> DataFrame:
    """A1: per domain the first non-null name, description, address and phone in page order.

    Each field is a minimum over (position, value), so pages combine before the shuffle.
    """
    return features.groupBy("domain").agg(
        F.count("*").alias("n_pages"),
        *[_first_of(f)["v"].alias(f) for f in PAGE_FIELDS])


def _first_of(field: str) -> Column:
    """The first non-null value with its place: a minimum that goes on being one when merged."""
    return F.min(F.when(F.col(field).isNotNull(), F.struct("ord", F.col(field).alias("v"))))


def page_evidence(
    pages: DataFrame, rules: RuleSet = DEFAULT_RULES, candidates_only: bool = True, with_ids: bool = False
) -> DataFrame:
    """What each page that counts contributes to its site's profile: narrow rows without texts.

    ``candidates_only`` counts the candidate paths of each domain, as a polite visit would: each
    page on such a path is judged where it is read, and one for each path is chosen afterwards,
    from rows of about a kilobyte. Otherwise every stored page counts, in ``page_id`` order.
    ``with_ids`` keeps ``page_id``, for evidence that is stored and joined with later pages. Rows can still be gated by
    ``domain`` and ``url`` before ``profiles_from`` rolls them up; that is the place for joins
    with large tables, because page bodies never move for them.
    """
    if candidates_only:
        features = page_features(pages_on_paths(pages, rules), rules, "ord", ("page_id",))
        findings = page_findings(features, rules, ("page_id", *_KEPT))
        chosen = first_by(findings, ["domain", "ord"], ["page_id"])
        return chosen if with_ids else chosen.drop("page_id")
    kept = page_findings(page_features(pages, rules), rules, _KEPT)
    return kept.withColumn("page_id", F.col("ord")) if with_ids else kept


def joined_evidence(*parts: DataFrame) -> DataFrame:
    """Evidence of several times (``with_ids``) as that of all pages at once: one page for each place,
    the lowest ``page_id``, whatever came when."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return first_by(rows, ["domain", "ord"], ["page_id"]).drop("page_id")


def profiles_from(
    evidence: DataFrame, rules: RuleSet = DEFAULT_RULES, candidates_only: bool = True
) -> DataFrame:
    """Page evidence rolled up to one profile per domain (A1, and F6-F12 over the site's text).

    ``pages_checked`` lists the pages of a site visited on its candidate paths; it is null when
    all stored pages count, however many a domain has, and ``n_pages`` counts them.
    """
    run_aggs = {"n_pages": F.count("*")} | {f: _first_of(f) for f in _KEPT}
    site_aggs = {"n_pages": F.sum("n_pages")} | {f: F.min(f) for f in _KEPT}
    if candidates_only:
        run_aggs["urls"] = F.collect_list(F.struct("ord", "url"))
        site_aggs["urls"] = F.flatten(F.collect_list("urls"))
        checked = F.transform(F.array_sort("urls"), lambda p: p["url"])
    else:
        checked = F.lit(None).cast("array<string>")
    most = len(rules.candidate_paths) if candidates_only else None
    sites = site_findings(evidence, rules, run_aggs, site_aggs, most_pages=most)
    sites = sites.withColumns({f: F.col(f)["v"] for f in _KEPT})
    out = sites.select(
        "domain", "n_pages", *_KEPT, checked.alias("pages_checked"),
        *[c.alias(k) for k, c in conclusions(sites, rules).items()])
    return out.select(
        "url", "domain", "company_name", "email", "phone", "description",
        "research_only_evidence", "company_type", "sells_direct", "manufactures",
        "is_content_site", "us_based", "state", "n_pages", "pages_checked")


def site_profiles(
    pages: DataFrame, rules: RuleSet = DEFAULT_RULES, candidates_only: bool = True
) -> DataFrame:
    """One profile per domain with readable pages."""
    return profiles_from(page_evidence(pages, rules, candidates_only), rules, candidates_only)
