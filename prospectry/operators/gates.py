"""Which hosts and paths may be visited, decided over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import is_global_address
from .skew import join_skewed

def public_domains(host_addresses: DataFrame) -> DataFrame:
    """Domains all of whose addresses are globally routable, from ``(domain, ip)``."""
    judged = host_addresses.groupBy("domain").agg(
        F.bool_and(is_global_address(F.col("ip"))).alias("public"))
    return judged.filter("public").select("domain")


def only_public(rows: DataFrame, host_addresses: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Rows of public domains; a domain without any address is refused. A domain with a great share
    of the rows (or of ``keys``, a cheaper table of the same domains) is dealt over tasks."""
    return join_skewed(rows, public_domains(host_addresses), "domain", "left_semi", keys)


def agent_rules(groups: DataFrame, user_agent: str) -> DataFrame:
    """The robots rules (``domain, ord, prefix, allow``) that hold for ``user_agent``.

    ``groups`` is ``(domain, group, agent, ord, prefix, allow)``: a group of rules names one agent
    or several. The first group that names the agent's product (case ignored, any part of it)
    decides alone; without one the first group for ``*`` does; without that there are no rules.
    """
    product = user_agent.split("/")[0].lower()
    everyone = F.trim("agent") == "*"
    ours = (~everyone) & (F.trim("agent") != "") & F.contains(F.lit(product), F.lower(F.trim("agent")))
    named = groups.filter(everyone | ours).select("domain", F.struct(everyone.alias("default"), "group").alias("place"))
    chosen = named.groupBy("domain").agg(F.min("place")["group"].alias("group"))
    rules = groups.filter(everyone | ours).join(chosen, ["domain", "group"], "left_semi")
    return rules.select("domain", "ord", "prefix", "allow").distinct()


def looked_up_prefixes(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """``domain, path, prefix``: of each path those of its prefixes that are as long as some rule
    prefix of its domain; none for domains without rules. At most paths times distinct lengths rows.
    """
    lengths = rules.groupBy("domain").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    known = join_skewed(asked, lengths, "domain")
    return known.select("domain", "path", F.explode(F.transform(
        F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.left(F.col("path"), n))).alias("prefix"))


def robots_verdicts(
    requests: DataFrame, robots_rules: DataFrame, unreadable: DataFrame | None = None
) -> DataFrame:
    """``requests`` (``domain, path, ...``) with ``allowed``.

    ``robots_rules`` is ``(domain, ord, prefix, allow)``: the first rule whose prefix begins the
    path decides; without one the path is allowed. Domains in ``unreadable`` (rules could not be
    read) are refused. A path is matched by looking up its own prefixes, so a domain with very many
    rules or paths meets only the rules that apply instead of all pairs; and only prefixes of
    lengths that the domain's rules have are looked up. The short prefixes that all paths of a
    domain share are told apart as heavy keys.
    """
    # an empty Disallow allows everything, '*' stands for every path
    prefix = F.when(F.col("prefix") == "*", F.lit("")).otherwise(F.col("prefix"))
    rules = robots_rules.select(
        "domain", prefix.alias("prefix"), "ord",
        (F.col("allow") | (F.col("prefix") == "")).alias("allow"))
    rules = rules.groupBy("domain", "prefix").agg(F.min(F.struct("ord", "allow")).alias("rule"))
    asked = requests.select("domain", "path").distinct()
    key = F.concat_ws("\n", "domain", "prefix").alias("_key")
    found = join_skewed(
        looked_up_prefixes(asked, rules).select(key, "domain", "path"), rules.select(key, "rule"), "_key")
    first = found.groupBy("domain", "path").agg(F.min("rule")["allow"].alias("_allow"))
    out = requests.join(first, ["domain", "path"], "left")
    allowed = F.coalesce("_allow", F.lit(True))
    if unreadable is not None:
        closed = unreadable.select("domain", F.lit(True).alias("_closed")).distinct()
        out = join_skewed(out, closed, "domain", "left", keys=requests)
        allowed = allowed & F.col("_closed").isNull()
    return out.select(*requests.columns, allowed.alias("allowed"))
