"""Search queries from keywords and templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import DEFAULT_COMPANY_TYPES, DEFAULT_RULES, LOOKUP_QUERY, RuleSet
from .ordering import numbered


def build_queries(
    keywords: DataFrame, company_types: Sequence[str] = DEFAULT_COMPANY_TYPES,
    max_queries: int | None = None, rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """``(q_ord, type, query)``: every template with every keyword, the types taking turns.

    ``keywords`` is ``(ord, keyword)``. Within a type, queries go template by template; the n-th
    query of each type comes before any (n+1)-th one. That place follows from the keyword's index
    by arithmetic, so nothing is numbered over a whole type.
    """
    unknown = sorted(set(company_types) - set(rules.templates))
    if unknown:
        raise ValueError(
            f"unknown company type(s): {unknown}; valid: {sorted(rules.templates)}")
    types = list(dict.fromkeys(company_types))
    templates = [
        F.struct(F.lit(i).alias("type_ord"), F.lit(name).alias("type"),
                 F.lit(j).alias("tpl_ord"), F.lit(t).alias("template"))
        for i, name in enumerate(types) for j, t in enumerate(rules.templates[name])
    ]
    total = keywords.agg(F.count("*")).scalar()
    indexed = numbered(keywords, ["ord"], "kw", start=0)
    rows = indexed.select("kw", "keyword", F.explode(F.array(*templates)).alias("t"))
    turn = F.col("t.tpl_ord") * total + F.col("kw")
    queries = rows.select(
        (turn * len(types) + F.col("t.type_ord")).cast("bigint").alias("q_ord"),
        F.col("t.type").alias("type"),
        F.replace("t.template", F.lit(rules.placeholder), "keyword").alias("query"))
    ordered = queries.orderBy("q_ord")
    return ordered if max_queries is None else ordered.limit(max_queries)


def lookup_queries(names: DataFrame) -> DataFrame:
    """the query that looks up a company name's own site."""
    return names.withColumn("query", F.format_string(LOOKUP_QUERY, "name"))
