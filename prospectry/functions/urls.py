"""URLs, hosts and mail addresses to domains (P1-P4) and host mining from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import BARE_DOMAIN_PATTERN, DEFAULT_RULES, URL_PATTERN, RuleSet
from .strings import any_of, drop_www, strip

_AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def authority(url: Column) -> Column:
    """The part between ``//`` and the path, as written; ``''`` when the URL has none."""
    return F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL without query or fragment; ``''`` for the bare host."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def url_domain(url: Column) -> Column:
    """Lower-cased authority without one leading ``www.``; port and user info stay."""
    return drop_www(F.lower(authority(url)))


def normalize_host(host: Column) -> Column:
    """Lower, trimmed, no trailing dots, no ``www.``."""
    return drop_www(F.rtrim(strip(F.lower(host)), F.lit(".")))


def mail_domain(address: Column) -> Column:
    """What follows the first ``@``; ``''`` without one."""
    at = F.instr(address, "@")
    after = F.when(at > 0, F.substr(address, at + 1)).otherwise(F.lit(""))
    return drop_www(strip(F.lower(after)))


def is_company_host(host: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Dotted, not an asset file name, and neither it nor its last two labels denied."""
    denied = list(rules.non_company_hosts)
    asset = any_of(host.endswith(s) for s in rules.asset_suffixes)
    out = host.contains(".") & ~asset
    if denied:
        registrable = F.substring_index(host, ".", -2)
        out = out & ~registrable.isin(denied) & ~host.isin(denied)
    return F.coalesce(out, F.lit(False))


def is_official_candidate(host: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """A company host that is not on the exact-match list of directories and marketplaces."""
    out = is_company_host(host, rules)
    if rules.never_official_hosts:
        out = out & ~host.isin(list(rules.never_official_hosts))
    return out


def lookup_host(url: Column) -> Column:
    """Host of a look-up result: scheme removed, cut at the first slash, normalised."""
    bare = F.regexp_replace(url, r"^https?://", "")
    return normalize_host(F.substring_index(bare, "/", 1))


def seed_host(line: Column) -> Column:
    """Host of a seed-list line: its authority, or the line itself where it has no scheme."""
    host = authority(line)
    return normalize_host(F.when(host == "", line).otherwise(host))


def url_hosts(text: Column) -> Column:
    """normalised hosts of absolute URLs in a text."""
    found = F.when(
        F.contains(F.lower(text), F.lit("://")),
        F.regexp_extract_all(text, F.lit("(?iU)(" + URL_PATTERN + ")"), 1),
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda u: normalize_host(authority(u)))


def bare_hosts(text: Column) -> Column:
    """normalised bare domains in a text."""
    # letters of either case are spelled out, and a label must be seen to end in a dot, before the
    # pattern proper is tried
    pattern = BARE_DOMAIN_PATTERN.replace("a-z", "a-zA-Z").removeprefix(r"\b")
    found = F.regexp_extract_all(
        text, F.lit(rf"(?U)\b(?=[a-zA-Z0-9\-]++\.)({pattern})"), 1)
    return F.transform(found, normalize_host)


def text_hosts(
    text: Column, source_host: Column | None = None, rules: RuleSet = DEFAULT_RULES
) -> Column:
    """Distinct company hosts of a text (URLs and bare domains), minus its own host."""
    hosts = F.array_union(url_hosts(text), bare_hosts(text))
    hosts = F.filter(hosts, lambda h: is_company_host(h, rules))
    if source_host is not None:
        own = normalize_host(source_host)
        hosts = F.when(own.isNull() | (own == ""), hosts).otherwise(F.array_remove(hosts, own))
    return hosts
