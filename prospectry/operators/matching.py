"""Company names to official domains by scored look-up results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import host_label, position_nudge, similarity_bound, slug, slug_similarity
from ..functions.urls import is_official_candidate, lookup_host
from ..rules import DEFAULT_RULES, RuleSet


def _bounded(lookups: DataFrame, rules: RuleSet) -> DataFrame:
    """``(name, host, position, nudge, _a, _b, _most)``: official hosts at their best place, both
    slugs, and what their similarity is at most."""
    hosts = lookups.withColumn("host", lookup_host(F.col("url")))
    hosts = hosts.filter(is_official_candidate(F.col("host"), rules))
    best = hosts.groupBy("name", "host").agg(F.min("position").alias("position"))
    slugs = best.withColumns({
        "nudge": position_nudge(F.col("position")), "_a": F.coalesce(slug(F.col("name")), F.lit("")),
        "_b": F.coalesce(slug(host_label(F.col("host"))), F.lit(""))})
    return slugs.withColumn("_most", similarity_bound(F.col("_a"), F.col("_b")))


def _undecided() -> Column:
    return (F.col("_a") != F.col("_b")) & (F.col("_most") > 0)


def pairs_to_compare(rows: DataFrame) -> DataFrame:
    """The distinct slug pairs ``(_a, _b)`` whose similarity nothing but the measure itself tells."""
    return rows.filter(_undecided()).select("_a", "_b").distinct()


def _scored(rows: DataFrame) -> DataFrame:
    pairs = pairs_to_compare(rows).withColumn("_s", slug_similarity(F.col("_a"), F.col("_b")))
    scored = rows.join(pairs, ["_a", "_b"], "left").withColumn(
        "similarity", F.when(_undecided(), F.col("_s")).otherwise(F.col("_most")))
    return scored.select(
        "name", "host", "position", "similarity", (F.col("similarity") + F.col("nudge")).alias("score"))


def scored_hosts(lookups: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``(name, host, position, similarity, score)`` from ``(name, position, url)``.

    A host that appears several times for a name keeps its best place. Equal slugs and slugs without
    a common letter are decided without a Python call, the others with one for each distinct pair.
    """
    return _scored(_bounded(lookups, rules))


def promising_hosts(lookups: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Those hosts of ``lookups`` whose score can reach the threshold, by lengths and letter counts."""
    return _bounded(lookups, rules).filter(F.col("_most") + F.col("nudge") >= rules.match_threshold)


def official_domains(lookups: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``(name, domain, score)`` for names with a confident match.

    Highest score wins, the earlier result on a tie; it must be positive and reach the threshold.
    Hosts that cannot reach it are dropped before they are compared.
    """
    key = F.struct("score", (-F.col("position")).alias("earlier"), "host")
    best = _scored(promising_hosts(lookups, rules)).groupBy("name").agg(F.max(key).alias("b"))
    return best.filter(
        (F.col("b.score") > 0) & (F.col("b.score") >= rules.match_threshold)
    ).select("name", F.col("b.host").alias("domain"), F.col("b.score").alias("score"))


def resolve_names(
    names: DataFrame, lookups: DataFrame, rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """``names`` (``ord, name, country``) with ``domain``, null where nothing matched well."""
    return names.join(official_domains(lookups, rules).drop("score"), "name", "left").select(
        *names.columns, "domain")


def resolution_totals(resolved: DataFrame) -> DataFrame:
    """One row ``(resolved, unresolved)``."""
    return resolved.agg(
        F.count("domain").alias("resolved"), F.count_if(F.col("domain").isNull()).alias("unresolved"))


def unresolved_sample(resolved: DataFrame, n: int = 20) -> DataFrame:
    """The first unresolved names in roster order."""
    return resolved.filter(F.col("domain").isNull()).orderBy("ord").limit(n).select("ord", "name")
