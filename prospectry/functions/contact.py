"""Addresses and phone numbers in text, and the choice of the best address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import ADDRESS_PATTERN, DEFAULT_RULES, PHONE_PATTERN, RuleSet
from .strings import any_of, blank_to_null, strip


def addresses(text: Column) -> Column:
    """every address in the text, in order, duplicates kept."""
    return F.when(
        F.instr(text, "@") > 0, F.regexp_extract_all(text, F.lit(f"({ADDRESS_PATTERN})"), 1)
    ).otherwise(F.array().cast("array<string>"))


def first_phone(text: Column) -> Column:
    """first North-American looking number, null if there is none."""
    return blank_to_null(F.regexp_extract(text, rf"(?U)(?=[+(\d])({PHONE_PATTERN})", 1))


def is_usable_address(address: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """P5: well formed, no template residue, not a generic or placeholder account."""
    local = F.lower(F.substring_index(address, "@", 1))
    domain = F.lower(F.substr(address, F.instr(address, "@") + 1))
    out = ~address.contains("%") & address.rlike(rf"\A(?:{ADDRESS_PATTERN})\z")
    locals_ = list(rules.generic_locals + rules.placeholder_locals)
    if locals_:
        out = out & ~local.isin(locals_)
    if rules.placeholder_mail_domains:
        out = out & ~domain.isin(list(rules.placeholder_mail_domains))
    return F.coalesce(out, F.lit(False))


def best_address(
    candidates: Column, site_domain: Column | None = None, rules: RuleSet = DEFAULT_RULES
) -> Column:
    """On the site's own domain first, then role accounts, then the shortest, then input order.

    A minimum over structs inside the array, so no row is exploded or sorted.
    """
    usable = F.filter(F.transform(candidates, strip), lambda e: is_usable_address(e, rules))

    def key(e: Column, i: Column) -> Column:
        domain = F.lower(F.substr(e, F.instr(e, "@") + 1))
        lowered = F.lower(e)
        off_site = F.lit(1)
        if site_domain is not None:
            own = F.coalesce(site_domain, F.lit("")) != ""
            off_site = F.when(own & (domain == F.lower(site_domain)), 0).otherwise(1)
        role = any_of(lowered.contains(w) for w in rules.role_words)
        return F.struct(
            off_site.alias("off_site"), F.when(role, 0).otherwise(1).alias("not_role"),
            F.length(e).alias("n"), i.alias("i"), e.alias("address"),
        )

    return F.array_min(F.transform(usable, key))["address"]
