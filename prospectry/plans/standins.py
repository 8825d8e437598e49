"""Leads, message log, inbox, roster and provider responses derived from the given tables.

The tables at hand are not a lead database; these projections give them its shapes, row for row,
so that every operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.urls import url_domain
from ..rules import RuleSet
from ..sources.tables import spread

#: Session setting of a bench on small files: deal their rows out over all cores. Off by default.
SPREAD = "prospectry.spread"

# Words that do occur in the texts take the place of the usual vocabulary.
RULES = RuleSet(
    keywords=("license", "free"),
    compounding_signals=("all rights reserved",), manufacturing_signals=("license", "only"),
    commerce_signals=("license", "free", "that", "dans"), content_signals=("only", "nicht", "from"),
    evidence_phrases=("all rights reserved", "license", "free"),
    negation_words=("not", "the", "der", "la"),
    state_names=("Only", "License"), state_abbreviations=("CI", "DE", "IN", "LA", "OF", "TO"),
    non_company_hosts=("mail5.example.com", "example.net"),
    never_official_hosts=("spam-farm.example.org",),
    opt_out_pattern="only|dans|nicht",
)
NOW = "2001-08-02 00:00:00"
FOLLOWUPS = 12
PROVIDERS = ("google_cse", "serper", "brave", "bing", "google_places")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts as it is stored; dealt out only where the session asks for it."""
    rows = table(spark, sf_dir, name)
    return spread(rows) if spark.conf.get(SPREAD, "false") == "true" else rows


def _days(c: Column) -> Column:
    return F.make_dt_interval(days=c.cast("int"))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    since = F.lit("1995-01-01").cast("timestamp_ntz") + _days(key % 1000)
    rows = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("company_name"),
        F.format_string("https://site%d.example.net/", key).alias("website"),
        F.format_string("site%d.example.net", key).alias("domain"),
        F.when(key % 10 == 0, None).when(key % 10 == 1, "").otherwise(
            F.format_string("sales@m%d.example.net", key % 97)).alias("email"),
        F.when(segment == "BUILDING", "vendor_roster").otherwise(F.lower(segment)).alias("source"),
        F.when(segment == "HOUSEHOLD", "research_only").when(segment == "MACHINERY", "manufacturing_lab")
        .when(segment == "FURNITURE", "consumer_and_research").alias("company_type"),
        (F.col("c_acctbal") > 0).alias("sells_direct"), (segment == "MACHINERY").alias("manufactures"),
        (nation < 5).alias("us_based"),
        F.when(nation == 0, "replied").when(nation == 1, "qualified").when(nation == 2, "disqualified")
        .when(nation < 12, "contacted").otherwise("new").alias("status"),
        F.when(nation == 0, F.lit("2001-07-01").cast("timestamp_ntz")).alias("replied_at"),
        (F.col("c_acctbal") < -800).alias("opted_out"),
        since.alias("created_at"), since.alias("updated_at"))
    return schemas.conform(rows, schemas.LEADS)


def outreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, status = F.col("o_custkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), lead.alias("lead_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.format_string("info@p%d.example.org", lead % 53))
        .otherwise(F.format_string("sales@m%d.example.net", lead % 97)).alias("to_email"),
        F.lit(1).alias("step"), F.col("o_orderpriority").alias("subject"), F.lit("").alias("body"),
        F.when(status == "F", "failed").when(status == "P", "drafted").otherwise("sent").alias(
            "delivery"),
        F.when(status == "F", "bounced").alias("error"), F.col("o_orderdate").alias("created_at"))
    return schemas.conform(rows, schemas.OUTREACH)


def messages_of(conversations: DataFrame) -> DataFrame:
    conv = F.col("conv_id")
    return conversations.filter(F.col("role") == "user").select(
        (conv * 1000 + F.col("turn")).alias("msg_id"),
        (F.lit("2001-06-01").cast("timestamp_ntz") + _days(conv % 60)).alias("received_at"),
        F.format_string("Person <jane@m%d.example.net>", conv % 131).alias("sender"),
        F.lit("").alias("subject"), F.col("text").alias("body"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "conversations"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.when(F.col("n_name") == "NATION_1", "United States").otherwise(F.col("n_name")).alias("country"))
    rows = table(spark, sf_dir, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), "country")


def domain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three suppliers of four are mapped, several to one domain."""
    rows = roster(spark, sf_dir).filter(F.col("ord") % 4 != 0)
    return rows.select(
        F.col("ord").alias("line_no"), "name", "country",
        F.format_string("site%d.example.net", F.col("ord") % 37 * 60).alias("domain"))


def page_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the pages that end in .org, as leads already known."""
    pages = table(spark, sf_dir, "pages").select(
        url_domain(F.col("url")).alias("domain"), F.col("page_id").alias("id"))
    rows = pages.filter(F.col("domain").endswith(".org")).groupBy("domain").agg(
        F.min("id").alias("id")).select(
            "id", F.col("domain").alias("company_name"),
            F.concat(F.lit("https://"), "domain", F.lit("/")).alias("website"), "domain")
    return schemas.conform(rows, schemas.LEADS, schemas.LEAD_DEFAULTS)


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ord"), "url", F.format_string("q%d", F.col("page_id") % 7).alias("query"),
        F.lit("serper").alias("source"))


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under the address of their language section, so that paths repeat within a site."""
    return read(spark, sf_dir, "pages").withColumn(
        "url", F.regexp_replace("url", r"^([a-z]+://[^/]+/[a-z]+).*", "$1"))


LANGUAGE_RULES = RULES.but(candidate_paths=("/en", "/de", "/fr", "/es"))


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response for each page, in the four response shapes, with two results each."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    base = F.substring_index("url", "?", 1)

    def items(url: str, title: str, snippet: str | None) -> Column:
        def one(u: Column, t: Column) -> Column:
            cols = [u.alias(url), t.alias(title)]
            if snippet:
                cols.append(F.concat(F.lit("about "), t).alias(snippet))
            return F.struct(*cols)
        return F.array(one(F.col("url"), F.format_string("t%d", n)), one(base, F.lit("again")))

    body = (
        F.when(n % 4 == 0, F.to_json(F.struct(items("link", "title", "snippet").alias("items"))))
        .when(n % 4 == 1, F.to_json(F.struct(items("link", "title", None).alias("organic"))))
        .when(n % 4 == 2, F.to_json(F.struct(F.struct(
            items("url", "title", "description").alias("results")).alias("web"))))
        .otherwise(F.to_json(F.struct(F.struct(
            items("url", "name", "snippet").alias("value")).alias("webPages")))))
    provider = F.element_at(F.array(*[F.lit(p) for p in PROVIDERS[:4]]), (n % 4 + 1).cast("int"))
    return pages.select(
        provider.alias("provider"), n.alias("q_ord"), F.format_string("q%d", n % 7).alias("query"),
        (n % 11 == 5).alias("failed"), body.alias("body"))


def directory_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    place = F.struct(
        F.format_string("p%d", n).alias("place_id"), F.format_string("Place %d", n).alias("name"),
        F.when(n % 2 == 0, F.lit("1 Main St")).alias("formatted_address"))
    return table(spark, sf_dir, "pages").select(
        F.lit("google_places").alias("provider"), n.alias("q_ord"),
        F.format_string("q%d", n % 7).alias("query"), F.lit(False).alias("failed"),
        F.to_json(F.struct(F.array(place, place).alias("results"))).alias("body"))


def place_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.format_string("p%d", "page_id").alias("place_id"),
        F.when(F.col("url").contains(".com"), F.col("url")).when(
            F.col("url").contains(".net"), "").alias("website"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up results for names made of site labels; a third of them are the site itself."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    label = F.initcap(F.regexp_extract(url_domain(F.col("url")), r"([a-z\-]+)\.example", 1))
    names = pages.select(
        F.concat(label, F.lit(" Inc.")).alias("name"), (F.col("page_id") % 7).alias("position"),
        (F.col("page_id") + F.col("page_id") % 3).alias("other"))
    results = pages.select(F.col("page_id").alias("other"), "url")
    return names.join(results, "other").select("name", "position", "url")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as manual edits; some leads are edited twice."""
    doc, quality = F.col("doc_id"), F.col("quality")
    return table(spark, sf_dir, "labels").select(
        doc.alias("ord"), (doc % 250).alias("lead_id"),
        F.when(quality == 1, "replied").when(doc % 3 == 0, "qualified").alias("status"),
        F.when(doc % 5 == 0, "").when(doc % 5 == 1, "manufacturing_lab").alias("company_type"),
        F.when(doc % 2 == 0, F.format_string("note %d", doc)).alias("notes"),
        (F.col("toxic") == 1).alias("opted_out"))
