"""Company hosts out of saved pages and pasted text, and their merge into a seed list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import seed_host, text_hosts
from ..rules import DEFAULT_RULES, RuleSet


def mined_hosts(
    texts: DataFrame, content: str = "content", source_host: str | None = None,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Distinct company hosts over all texts; each text's own host is left out of it."""
    own = F.col(source_host) if source_host else None
    hosts = texts.select(F.explode(text_hosts(F.col(content), own, rules)).alias("host"))
    return hosts.distinct()


def seed_hosts(seeds: DataFrame) -> DataFrame:
    """Distinct hosts of a seed list ``(url)``."""
    return seeds.select(seed_host(F.col("url")).alias("host")).distinct()


def new_hosts(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Hosts not on the seed list yet."""
    return hosts.join(seed_hosts(seeds), "host", "left_anti")


def seed_additions(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """K3: ``(host, url)`` lines to append to the seed list, sorted by host."""
    return new_hosts(hosts, seeds).select(
        "host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("url")).orderBy("host")


def seed_merge_counts(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """K3: one row ``(added, already)`` for a list of distinct hosts."""
    known = seed_hosts(seeds).withColumn("known", F.lit(True))
    return hosts.join(known, "host", "left").agg(
        F.count_if(F.col("known").isNull()).alias("added"), F.count("known").alias("already"))
