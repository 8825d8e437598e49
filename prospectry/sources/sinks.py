"""Writing lists and message drafts where people and mail programs pick them up (K2, K3, K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAP_HEADER = "# name\tcountry\tresolved domain"


def write_domain_map(domain_map: DataFrame, path: str) -> None:
    """K2: tab-separated lines sorted by name under a comment line.

    ``path`` must not be what ``domain_map`` is read from.
    """
    rows = domain_map.select(
        F.lit(1).alias("part"), "name", F.concat_ws("\t", "name", "country", "domain").alias("value"))
    header = domain_map.sparkSession.range(1).select(
        F.lit(0).alias("part"), F.lit("").alias("name"), F.lit(MAP_HEADER).alias("value"))
    ordered = header.unionByName(rows).orderBy("part", "name")
    ordered.select("value").write.mode("overwrite").text(path)


def append_seeds(additions: DataFrame, path: str) -> None:
    """K3: new seed lines (``url``) added to a seed list kept as a directory of text files."""
    additions.select("url").write.mode("append").text(path)


def write_drafts(drafts: DataFrame, path: str) -> None:
    """K5: one JSON object per message."""
    drafts.write.mode("overwrite").json(path)
