"""Provider results to an ordered list of candidate sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_domain
from ..rules import DEFAULT_RULES, LOOKUP_RESULTS, RuleSet
from ..sources.tables import written
from .ordering import at_most_per_key, first_by, numbered
from .skew import join_skewed

#: First failures that are sent to all tasks: a row of a provider and a query each.
MOST_PROVIDERS = 10_000


def configured_only(rows: DataFrame, configured: Sequence[str]) -> DataFrame:
    """Rows of providers that are set up."""
    return rows.filter(F.col("provider").isin(list(configured)))


def before_first_failure(
    rows: DataFrame, keys: Sequence[str] = ("provider",), order: Sequence[str] = ("q_ord",)
) -> DataFrame:
    """What a provider was asked before its first failure; later queries are never sent.

    ``rows`` has ``failed``. The failing row itself brought nothing. With ``page`` in ``order``
    the earlier pages of the failing query stay. The first failures (one row for each provider, no
    bodies) are counted: up to ``MOST_PROVIDERS`` go to where the rows are read, so that no body is
    moved for them. More than that are joined, with heavy providers dealt out.
    """
    at = F.struct(*order)
    failures = written(
        rows.filter("failed").groupBy(*keys).agg(F.min(at).alias("_first_failure")))
    same = [c for c in rows.columns if c not in keys]
    if failures.limit(MOST_PROVIDERS + 1).count() <= MOST_PROVIDERS:
        joined = rows.join(F.broadcast(failures), list(keys), "left")
    else:
        key = F.struct(*keys)
        joined = join_skewed(
            rows.select(F.to_json(key).alias("_key"), *keys, *same),
            failures.select(F.to_json(key).alias("_key"), "_first_failure"), "_key", "left",
            keys=rows.select(F.to_json(key).alias("_key")))
    kept = joined.filter(F.col("_first_failure").isNull() | (at < F.col("_first_failure")))
    return kept.select(*rows.columns)


def _page(results: DataFrame) -> Column:
    return F.col("page").cast("bigint") if "page" in results.columns else F.lit(0).cast("bigint")


def _result_order(results: DataFrame) -> list[str]:
    return [*(["page"] if "page" in results.columns else []), "position"]


def _cap(wanted: int, rules: RuleSet) -> Column:
    cap = F.lit(wanted)
    for name, most in rules.provider_caps.items():
        if most is not None:
            cap = F.when(F.col("provider") == name, F.lit(min(wanted, most))).otherwise(cap)
    return cap


def cap_results(
    results: DataFrame, wanted: int, rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """The first results of each query over its pages, as many as asked for and its provider
    gives."""
    return at_most_per_key(
        results, ["provider", "q_ord"], _result_order(results), _cap(wanted, rules), wanted)


def directory_websites(places: DataFrame, details: DataFrame) -> DataFrame:
    """Places with the website of their details; places without one drop out."""
    sites = details.filter(F.coalesce("website", F.lit("")) != "").groupBy("place_id").agg(
        F.min("website").alias("url"))
    return places.filter(F.col("place_id") != "").join(sites, "place_id")


def provider_rank(rules: RuleSet = DEFAULT_RULES) -> Column:
    rank = F.lit(len(rules.provider_caps))
    for i, name in enumerate(rules.provider_caps):
        rank = F.when(F.col("provider") == name, F.lit(i)).otherwise(rank)
    return rank


def candidate_list(*results: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``(ord, url, query, source)`` over provider results, provider by provider, query by
    query, page by page, result by result; ``ord`` counts from 1 without gaps.

    The order is that of whole keys (rank, query, page, position), then of URL and query where a
    result is listed twice, so no id is too large for it. Results are read once and written down.
    """
    keys = ["rank", "q_ord", "page", "position", "url", "query", "source"]
    rows = None
    for found in results:
        part = found.select(
            provider_rank(rules).alias("rank"), "q_ord", _page(found).alias("page"), "position", "url", "query",
            F.col("provider").alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return numbered(written(rows), keys, "ord").select("ord", "url", "query", "source")


def seed_candidates(seeds: DataFrame) -> DataFrame:
    """Candidates out of a seed list instead of a search."""
    return seeds.select(
        "ord", "url", F.lit("manual seed list").alias("query"), F.lit("seed_list").alias("source"))


def first_per_domain(candidates: DataFrame) -> DataFrame:
    """Each domain's first candidate; URLs without a domain drop out."""
    located = candidates.withColumn("domain", url_domain(F.col("url")))
    return first_by(located.filter(F.col("domain") != ""), ["domain"], ["ord"])


def visit_list(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """The domains to visit, at most ``limit`` new ones in candidate order."""
    firsts = first_per_domain(candidates)
    return firsts if limit is None else firsts.orderBy("ord").limit(limit)


def lookup_results(
    results: DataFrame, configured: Sequence[str], rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """Results of the one provider that answers name look-ups: the first configured one."""
    chosen = [p for p in rules.lookup_providers if p in set(configured)][:1]
    one = results.filter(F.col("provider").isin(chosen) if chosen else F.lit(False))
    return at_most_per_key(
        one, ["provider", "q_ord"], _result_order(results), F.lit(LOOKUP_RESULTS), LOOKUP_RESULTS)
