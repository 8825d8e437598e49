"""Search and directory responses at rest to result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The JSON fields of the four search response shapes and of the directory's.
_SEARCH_JSON = (
    "items array<struct<link:string,title:string,snippet:string>>,"
    "webPages struct<value:array<struct<url:string,name:string,snippet:string>>>,"
    "organic array<struct<link:string,title:string,snippet:string>>,"
    "web struct<results:array<struct<url:string,title:string,description:string>>>"
)
_DIRECTORY_JSON = "results array<struct<place_id:string,name:string,formatted_address:string>>"


def _rows(items: Column, url: str, title: str, snippet: str) -> Column:
    def text(x: Column, field: str) -> Column:
        return F.coalesce(x[field], F.lit(""))

    return F.transform(
        items,
        lambda x: F.struct(
            text(x, url).alias("url"), text(x, title).alias("title"),
            text(x, snippet).alias("snippet"),
        ),
    )


def _page(df: DataFrame) -> list[str]:
    return ["page"] if "page" in df.columns else []


def search_results(responses: DataFrame) -> DataFrame:
    """``(provider, q_ord, query[, page], position, url, title, snippet)`` from response bodies.

    A response is ``(provider, q_ord, query, failed, body[, page])``. Missing fields become ``''``,
    a missing list brings no rows, and so does a failed response. ``position`` is the place within
    the response; where a query has several pages, ``page`` is kept and comes before it.
    """
    j = F.col("j")
    results = (
        F.when(F.col("provider") == "google_cse", _rows(j["items"], "link", "title", "snippet"))
        .when(F.col("provider") == "bing",
              _rows(j["webPages"]["value"], "url", "name", "snippet"))
        .when(F.col("provider") == "serper", _rows(j["organic"], "link", "title", "snippet"))
        .when(F.col("provider") == "brave",
              _rows(j["web"]["results"], "url", "title", "description"))
    )
    parsed = responses.filter(~F.coalesce("failed", F.lit(False))).select(
        "provider", "q_ord", "query", *_page(responses),
        F.from_json("body", _SEARCH_JSON).alias("j"),
    )
    rows = parsed.select(
        "provider", "q_ord", "query", *_page(responses), F.posexplode(results).alias("pos", "r")
    )
    return rows.select(
        "provider", "q_ord", "query", *_page(responses), F.col("pos").cast("bigint").alias("position"), "r.*")


def directory_results(responses: DataFrame) -> DataFrame:
    """``(provider, q_ord, query[, page], position, place_id, name, address)``."""
    parsed = responses.filter(~F.coalesce("failed", F.lit(False))).select(
        "provider", "q_ord", "query", *_page(responses),
        F.from_json("body", _DIRECTORY_JSON)["results"].alias("results"),
    )
    rows = parsed.select(
        "provider", "q_ord", "query", *_page(responses), F.posexplode("results").alias("pos", "r")
    )
    return rows.select(
        "provider", "q_ord", "query", *_page(responses), F.col("pos").cast("bigint").alias("position"),
        F.coalesce("r.place_id", F.lit("")).alias("place_id"),
        F.coalesce("r.name", F.lit("")).alias("name"),
        F.col("r.formatted_address").alias("address"),
    )
