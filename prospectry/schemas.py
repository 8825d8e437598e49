"""Schemas and value domains of the tables. ``!`` marks NOT NULL columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(),
    "strings": T.ArrayType(T.StringType()),
}


def _schema(spec: str) -> T.StructType:
    out = T.StructType()
    for item in spec.split(","):
        name, kind = item.split()
        out.add(name, _TYPES[kind.rstrip("!")], not kind.endswith("!"))
    return out


LEADS = _schema(
    "id bigint, company_name string!, website string!, domain string!, email string, phone string,"
    "description string, source string!, matched_query string, research_only_evidence string,"
    "company_type string, sells_direct boolean!, manufactures boolean!, us_based boolean!,"
    "state string, status string!, replied_at timestamp_ntz, opted_out boolean!, notes string,"
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
OUTREACH = _schema(
    "id bigint, lead_id bigint!, to_email string!, step int!, subject string!, body string!,"
    "delivery string!, error string, created_at timestamp_ntz"
)
PAGES = _schema("page_id bigint, url string, html string")
MESSAGES = _schema(
    "msg_id bigint, received_at timestamp_ntz, sender string, subject string, body string"
)
PROFILES = _schema(
    "url string, domain string, company_name string, email string, phone string,"
    "description string, research_only_evidence string, company_type string,"
    "sells_direct boolean, manufactures boolean, is_content_site boolean, us_based boolean,"
    "state string, n_pages bigint, pages_checked strings"
)
SEARCH_RESPONSES = _schema(
    "provider string, q_ord bigint, query string, failed boolean, body string"
)
SEARCH_RESULTS = _schema(
    "provider string, q_ord bigint, query string, position bigint, url string, title string,"
    "snippet string"
)
DIRECTORY_RESULTS = _schema(
    "provider string, q_ord bigint, query string, position bigint, place_id string, name string,"
    "address string"
)
ROSTER = _schema("ord bigint, name string, country string")
DOMAIN_MAP = _schema("line_no bigint, name string, country string, domain string")
LOOKUPS = _schema("name string, position bigint, url string")
CANDIDATES = _schema("ord bigint, url string, query string, source string")
REPLY_UPDATES = _schema(
    "lead_id bigint, first_msg_id bigint, opted_out boolean, applied_at timestamp_ntz"
)

RECEIPTS = _schema(
    "lead_id bigint, step int, delivery string, error string, delivered_at timestamp_ntz"
)

LEAD_STATUSES = ("new", "contacted", "replied", "qualified", "disqualified")
COMPANY_TYPES = (
    "research_only", "consumer_and_research", "compounding_pharmacy", "manufacturing_lab",
)
DELIVERIES = ("drafted", "sent", "failed")

# Values a new lead or message takes where none is given.
LEAD_DEFAULTS = {
    "source": "unknown", "sells_direct": False, "manufactures": False, "us_based": False,
    "status": "new", "opted_out": False,
}
OUTREACH_DEFAULTS = {"step": 1, "delivery": "drafted"}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Columns of ``schema`` in order; absent columns become null, nulls take ``defaults``."""
    defaults = defaults or {}
    cols: list[Column] = []
    for f in schema:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def domain_violations(leads: DataFrame) -> DataFrame:
    """Leads whose status or company type lies outside the value domains."""
    return leads.filter(
        ~F.col("status").isin(*LEAD_STATUSES)
        | (F.col("company_type").isNotNull() & ~F.col("company_type").isin(*COMPANY_TYPES))
    )
