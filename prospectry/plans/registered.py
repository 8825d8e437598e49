"""The named queries of ``__spark_entry__``: every operator over the given tables."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import contact, html, mail, text, urls
from ..operators import (
    candidates, crm, funnels, gates, hosts, leads, matching, ordering, outreach, query_building, receipts,
    replies, roster, site_text, sites, vocabulary,
)
from ..rules import ASSET_SUFFIXES
from ..sources import lists, search, tables
from ..streaming import jobs
from . import discovery, outreach_cycle, roster_import
from . import standins as s
from .standins import RULES, now, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers ``f``. Sessions of one machine that name no shared folder get one of their own."""
    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        if not spark.conf.get(tables.SHARED, None) and spark.sparkContext.master.startswith("local"):
            spark.conf.set(tables.SHARED, tempfile.mkdtemp(prefix="prospectry-"))
        return f(spark, d)

    QUERIES[f.__name__] = run
    return f


def pages(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "pages")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "documents")


def joined(array: Column | str, sep: str = "|") -> Column:
    return F.array_join(array, sep)


# --- pages to profiles ------------------------------------------------------------------------


@query
def page_domains(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.url_domain(F.col("url")).alias("domain"),
        urls.url_path(F.col("url")).alias("path"))


@query
def page_fields(spark, d):
    features = sites.page_features(pages(spark, d), RULES)
    return features.select(
        F.col("ord").alias("page_id"), "domain", "company_name", "description", "email", "phone",
        F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


@query
def contact_rollup(spark, d):
    return sites.contact_rollup(sites.page_features(pages(spark, d), RULES))


@query
def site_profiles(spark, d):
    out = sites.site_profiles(pages(spark, d), RULES, candidates_only=False)
    return out.drop("pages_checked")


@query
def visited_profiles(spark, d):
    out = sites.site_profiles(s.language_pages(spark, d), s.LANGUAGE_RULES)
    return out.withColumn("pages_checked", joined("pages_checked"))


@query
def candidate_pages(spark, d):
    pages = sites.candidate_pages(s.language_pages(spark, d), s.LANGUAGE_RULES)
    return pages.select("domain", F.col("ord").alias("path_rank"), "page_id", "url")


@query
def candidate_page_urls(spark, d):
    domains = table(spark, d, "pages").select(urls.url_domain(F.col("url")).alias("domain")).distinct()
    return sites.candidate_page_urls(domains)


@query
def site_text_pieces(spark, d):
    features = sites.page_features(pages(spark, d), RULES)
    return site_text.site_pieces(features).select(
        "domain", "piece", "n_pages", F.length("text").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def page_mailto_links(spark, d):
    """F18 over pages whose footers get a contact link."""
    n = F.col("page_id")
    linked = F.concat(
        "html", F.format_string("<a class=c href=\"mailto:office%d@site.example.net?subject=x\">w</a>", n))
    live = pages(spark, d).select("page_id", html.live_markup(linked).alias("live"))
    return live.select("page_id", joined(html.mailto_addresses(F.col("live"))).alias("addresses"))


@query
def page_meta_fields(spark, d):
    """F16/F17 over pages with site name and description in their heads."""
    n = F.col("page_id")
    head = F.format_string(
        "<head><meta property=\"og:site_name\" content=\"Site %d &amp; Co\">"
        "<meta content='About %d' name='description'>", n, n)
    marked = F.replace("html", F.lit("<head>"), F.when(n % 3 != 0, head).otherwise(F.lit("<head>")))
    live = pages(spark, d).select("page_id", html.live_markup(marked).alias("live"))
    return live.select(
        "page_id", html.company_name(F.col("live")).alias("company_name"),
        html.meta_description(F.col("live")).alias("description"))


# --- text rules over documents ----------------------------------------------------------------


@query
def doc_addresses(spark, d):
    docs = documents(spark, d)
    return docs.select(
        "doc_id", F.posexplode(contact.addresses(F.col("text"))).alias("pos", "address"))


@query
def doc_best_address(spark, d):
    docs = documents(spark, d)
    pool = F.concat(
        F.array(F.lit("privacy@mail2.example.com")), contact.addresses(F.col("text")),
        F.array(F.lit(" info@mail2.example.com "), F.format_string("d%d@mail3.example.com", "doc_id")))
    return docs.select(
        "doc_id", contact.best_address(pool, F.lit("mail3.example.com"), RULES).alias("on_site"),
        contact.best_address(pool, None, RULES).alias("anywhere"))


@query
def doc_phones(spark, d):
    docs = documents(spark, d).select(
        "doc_id", contact.first_phone(F.col("text")).alias("phone"))
    return docs.filter(F.col("phone").isNotNull())


@query
def keyword_docs(spark, d):
    docs = documents(spark, d)
    return docs.filter(text.contains_any(F.col("text"), RULES.keywords)).select("doc_id", "lang")


@query
def signal_flags(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", text.count_signals(t, RULES.commerce_signals).alias("n_commerce"),
        text.sells_direct(t, RULES).alias("sells_direct"),
        text.is_content_site(t, RULES).alias("is_content_site"))


@query
def unnegated_signals(spark, d):
    t = F.col("text")
    return documents(spark, d).select(
        "doc_id", text.manufactures(t, RULES).alias("manufactures"),
        text.unnegated_signal(t, RULES.compounding_signals, RULES).alias("compounding"))


@query
def evidence_snippets(spark, d):
    docs = documents(spark, d).select(
        "doc_id", text.evidence(F.col("text"), RULES).alias("snippet"))
    return docs.filter(F.col("snippet").isNotNull())


@query
def us_presence(spark, d):
    docs = documents(spark, d).select(
        "doc_id", text.us_presence(F.col("text"), RULES).alias("us"))
    return docs.select("doc_id", "us.is_us", "us.state")


@query
def us_presence_with_zip(spark, d):
    """The abbreviation branch of F6: no state names, a zip code written after abbreviations."""
    rules = RULES.but(state_names=("Absent State",))
    marked = F.regexp_replace("text", "(IN|OF|DE) ", "$1 46201 ")
    docs = documents(spark, d).select(
        "doc_id", text.us_presence(marked, rules).alias("us"))
    return docs.select("doc_id", "us.is_us", "us.state")


@query
def company_types(spark, d):
    t = F.col("text")
    docs = documents(spark, d).select("doc_id", "text", text.evidence(t, RULES).alias("e"))
    return docs.select("doc_id", text.text_company_type(t, F.col("e"), RULES).alias("company_type"))


@query
def skip_reasons(spark, d):
    """P14 with and without its flags, over documents as sites."""
    t = F.col("text")
    docs = documents(spark, d).select("doc_id", "text", text.evidence(t, RULES).alias("e"))
    flags = docs.select(
        "doc_id", text.text_company_type(t, F.col("e"), RULES).alias("company_type"),
        text.sells_direct(t, RULES).alias("sells_direct"),
        text.is_content_site(t, RULES).alias("is_content_site"),
        text.us_presence(t, RULES)["is_us"].alias("us_based"))
    return flags.select(
        "doc_id", leads.skip_reason().alias("strict"), leads.skip_reason(True).alias("any_country"),
        leads.skip_reason(False, False).alias("any_kind"))


# --- hosts ------------------------------------------------------------------------------------


def _texts(spark, d):
    docs = documents(spark, d).select(
        F.col("text").alias("content"), F.lit("mail1.example.com").alias("source_host"))
    linked = pages(spark, d).select(
        F.concat_ws(" ", "url", "html").alias("content"), F.lit(None).cast("string").alias("source_host"))
    return docs.unionByName(linked)


def _seeds(spark, d):
    url = F.col("url")
    host = urls.authority(url)
    return table(spark, d, "pages").filter(url.contains(".org")).select(
        F.when(F.col("page_id") % 2 == 0, url).otherwise(F.concat(host, F.lit("."))).alias("url"))


@query
def mined_hosts(spark, d):
    return hosts.mined_hosts(_texts(spark, d), source_host="source_host", rules=RULES)


@query
def doc_hosts(spark, d):
    docs = documents(spark, d)
    found = docs.select("doc_id", F.array_sort(urls.text_hosts(F.col("text"), None, RULES)).alias("h"))
    return found.filter(F.size("h") > 0).select("doc_id", joined("h").alias("hosts"))


@query
def seed_additions(spark, d):
    found = hosts.mined_hosts(_texts(spark, d), source_host="source_host", rules=RULES)
    return hosts.seed_additions(found, _seeds(spark, d))


@query
def seed_merge_counts(spark, d):
    found = hosts.mined_hosts(_texts(spark, d), source_host="source_host", rules=RULES)
    return hosts.seed_merge_counts(found, _seeds(spark, d))


def _keyword_table(spark, d):
    """The first word, and the first two, of every benchmark item."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    return table(spark, d, "benchmark").select(
        F.explode(F.array(words[0], F.concat_ws(" ", words[0], words[1]))).alias("keyword"))


@query
def keyword_table_docs(spark, d):
    """J10 with a table of keywords, as whole words."""
    return vocabulary.keyword_hits(table(spark, d, "documents"), _keyword_table(spark, d), "doc_id")


@query
def keyword_substring_docs(spark, d):
    """J10 with a table of keywords, anywhere in the text."""
    return vocabulary.keyword_substrings(table(spark, d, "documents"), _keyword_table(spark, d), "doc_id")


@query
def denied_host_table(spark, d):
    """J11 with a table of denied hosts: those of every seventh page, and one whole domain."""
    rows = table(spark, d, "pages").select("page_id", urls.normalize_host(urls.authority(F.col("url"))).alias("host"))
    denied = rows.filter(F.col("page_id") % 7 == 0).select("host").union(
        spark.range(1).select(F.lit("example.net")))
    return vocabulary.without_denied_hosts(rows, denied)


@query
def company_hosts(spark, d):
    """P2/P3 over page hosts, some of them asset names."""
    n = F.col("page_id")
    suffix = F.element_at(
        F.array(*[F.lit(x) for x in ("", ".", *ASSET_SUFFIXES)]), (n % 13 + 1).cast("int"))
    host = F.concat(urls.authority(F.col("url")), suffix)
    rows = table(spark, d, "pages").select("page_id", urls.normalize_host(host).alias("host"))
    return rows.withColumn("is_company", urls.is_company_host(F.col("host"), RULES))


# --- queries, providers, candidates -----------------------------------------------------------


def _keywords(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("keyword")).agg(
        F.min("p_partkey").alias("ord"))


@query
def query_plan(spark, d):
    types = ("manufacturing_lab", "research_only", "compounding_pharmacy")
    return query_building.build_queries(_keywords(spark, d), types)


@query
def query_budget(spark, d):
    return query_building.build_queries(_keywords(spark, d), max_queries=40)


@query
def lookup_queries(spark, d):
    return query_building.lookup_queries(s.roster(spark, d).select("name"))


@query
def provider_breaker(spark, d):
    calls = table(spark, d, "events").select(
        F.col("user_id").alias("provider"), F.col("event_id").alias("q_ord"),
        (F.col("event_type") == "error").alias("failed"))
    return candidates.before_first_failure(calls).select("provider", "q_ord")


@query
def query_caps(spark, d):
    names = F.array(*[F.lit(p) for p in s.PROVIDERS])
    results = table(spark, d, "events").select(
        F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("provider"),
        F.col("user_id").alias("q_ord"), F.col("event_id").alias("position"))
    return candidates.cap_results(results, 40)


@query
def search_results(spark, d):
    return search.search_results(s.search_responses(spark, d))


@query
def directory_websites(spark, d):
    places = search.directory_results(s.directory_responses(spark, d))
    return candidates.directory_websites(places, s.place_details(spark, d))


def _candidates(spark, d):
    answered = candidates.before_first_failure(s.search_responses(spark, d))
    configured = candidates.configured_only(answered, ("bing", "brave", "serper"))
    found = candidates.cap_results(search.search_results(configured), 10)
    places = candidates.directory_websites(
        search.directory_results(s.directory_responses(spark, d)), s.place_details(spark, d))
    return candidates.candidate_list(found, candidates.cap_results(places, 10))


@query
def candidate_union(spark, d):
    return _candidates(spark, d)


@query
def first_candidates(spark, d):
    return candidates.first_per_domain(_candidates(spark, d))


@query
def visit_list(spark, d):
    return candidates.visit_list(s.page_candidates(spark, d), 25)


@query
def lookup_provider(spark, d):
    found = search.search_results(s.search_responses(spark, d))
    return candidates.lookup_results(found, ("brave", "google_cse"), RULES).drop("snippet")


# --- leads ------------------------------------------------------------------------------------


def _judged(spark, d):
    visits = candidates.visit_list(s.page_candidates(spark, d))
    profiles = sites.site_profiles(pages(spark, d), RULES, candidates_only=False)
    return leads.judged_visits(visits, profiles, allow_non_us=True, vendors_only=True)


@query
def lead_inserts(spark, d):
    known = s.page_leads(spark, d)
    return leads.new_leads(known, _judged(spark, d), now())


@query
def lead_outcomes(spark, d):
    return leads.lead_outcomes(s.page_leads(spark, d), _judged(spark, d))


@query
def discovery_funnel(spark, d):
    return funnels.discovery_funnel(lead_outcomes(spark, d))


@query
def dry_run_preview(spark, d):
    return leads.preview(_judged(spark, d))


# --- roster and resolution --------------------------------------------------------------------


def _located(spark, d):
    return roster.located_roster(s.roster(spark, d), s.domain_map(spark, d))


@query
def roster_part(spark, d):
    return roster.roster_part(s.roster(spark, d), "united STATES")


@query
def roster_head(spark, d):
    return roster.roster_part(s.roster(spark, d), "NATION_3", 3)


@query
def roster_located(spark, d):
    return _located(spark, d)


@query
def missing_names(spark, d):
    return roster.missing_names(s.roster(spark, d), s.domain_map(spark, d))


@query
def domain_map_merge(spark, d):
    found = s.roster(spark, d).filter(F.col("ord") % 2 == 0).select(
        F.col("ord").alias("line_no"), "name", "country",
        F.format_string("new%d.example.org", "ord").alias("domain"))
    return roster.merge_domain_map(s.domain_map(spark, d), found)


@query
def roster_merge(spark, d):
    return roster.merge_roster(s.leads(spark, d), _located(spark, d), now()).table


def _roster_profiles(spark, d):
    """Profiles of a third of the sites, every other with an address."""
    n = F.col("c_custkey")
    return table(spark, d, "customer").filter(n % 3 == 0).select(
        F.format_string("site%d.example.net", n).alias("domain"),
        F.when(n % 2 == 0, F.format_string("hello@site%d.example.net", n)).alias("email"),
        F.col("c_name").alias("phone"), F.lit("").alias("description"),
        F.lit("research_only").alias("company_type"),
        F.lit(None).cast("string").alias("research_only_evidence"), F.lit("Texas").alias("state"),
        F.lit(True).alias("sells_direct"), F.lit(None).cast("boolean").alias("manufactures"),
        (n % 5).alias("n_pages"))


@query
def roster_merge_enriched(spark, d):
    return roster.merge_roster(
        s.leads(spark, d), _located(spark, d), now(), _roster_profiles(spark, d)).table


@query
def roster_outcomes(spark, d):
    return roster.roster_outcomes(
        _located(spark, d), s.leads(spark, d), _roster_profiles(spark, d))


@query
def roster_funnel(spark, d):
    return funnels.roster_funnel(roster_outcomes(spark, d))


@query
def enriched_leads(spark, d):
    return roster.enrich_leads(s.leads(spark, d), _roster_profiles(spark, d), now())


@query
def host_scores(spark, d):
    return matching.scored_hosts(s.lookups(spark, d), RULES)


@query
def official_domains(spark, d):
    return matching.official_domains(s.lookups(spark, d), RULES)


def _resolved(spark, d):
    found = s.lookups(spark, d)
    names = found.groupBy("name").agg(F.count("*").alias("ord"))
    return matching.resolve_names(names, found, RULES)


@query
def resolution_totals(spark, d):
    return matching.resolution_totals(_resolved(spark, d))


@query
def unresolved_names(spark, d):
    return _resolved(spark, d).filter(F.col("domain").isNull()).select("name")


def _resolution(spark, d):
    """A resolve-only run over all looked-up names, numbered by name."""
    found = s.lookups(spark, d)
    names = ordering.numbered(found.select("name").distinct(), ["name"], "ord").withColumn("country", F.lit("US"))
    return roster_import.resolve(names, s.domain_map(spark, d), found, _seeds(spark, d), rules=RULES)


@query
def resolve_map(spark, d):
    """The name-to-domain map after a resolve-only run."""
    return _resolution(spark, d).domain_map


@query
def resolve_seeds(spark, d):
    return _resolution(spark, d).seed_additions


@query
def resolve_totals(spark, d):
    return _resolution(spark, d).totals


@query
def unresolved_sample(spark, d):
    """The first twenty names that nothing matched well."""
    return _resolution(spark, d).unresolved


# --- outreach ---------------------------------------------------------------------------------

FIRST = ("Nice to meet you", "Hello,\n\n{sender_name}\n{sender_company}\n{unsubscribe_line}")
FOLLOW_UP = ("Re: Nice to meet you", "Hi again, {sender_name} {{x}} {sender_email}")
SENDER = {
    "sender_name": "Pat Doe, Sales", "sender_email": "pat@sender.example.org", "sender_company": "Doe Ltd",
    "sender_postal_address": "", "unsubscribe_line": "Reply unsubscribe to stop",
}


def _planned(spark, d):
    return outreach.plan_outreach(
        s.leads(spark, d), s.outreach(spark, d), now(), interval_days=30, max_followups=s.FOLLOWUPS)


def _messages(spark, d):
    return outreach.render_messages(_planned(spark, d), FIRST, FOLLOW_UP, SENDER)


@query
def contactable_makers(spark, d):
    return outreach.contactable(s.leads(spark, d), only_manufacturers=True).select("id", "email")


@query
def message_history(spark, d):
    return outreach.message_history(s.outreach(spark, d))


@query
def next_steps(spark, d):
    rows = outreach.with_next_step(
        s.leads(spark, d), s.outreach(spark, d), now(), 30, s.FOLLOWUPS)
    # shown as 0: no message yet, nothing due
    return rows.select(
        "id", F.coalesce("n_delivered", F.lit(0)).alias("n_delivered"), "last_at",
        F.coalesce("next_step", F.lit(0)).alias("next_step"))


@query
def due_plan(spark, d):
    return _planned(spark, d).select("id", "email", "step", "created_at")


@query
def due_plan_capped(spark, d):
    return outreach.plan_outreach(
        s.leads(spark, d), s.outreach(spark, d), now(), True, 10, 30, s.FOLLOWUPS
    ).select("id", "email", "step")


@query
def draft_messages(spark, d):
    return outreach.draft_rows(
        _messages(spark, d), SENDER["sender_name"], SENDER["sender_email"])


@query
def message_problems(spark, d):
    rows = outreach.with_problems(_messages(spark, d), SENDER)
    return rows.select("id", "label", joined("problems").alias("problems"))


def _delivered(spark, d):
    return outreach.with_delivery(_messages(spark, d), send=False).withColumn(
        "delivery", F.when(F.col("id") % 6 == 0, "failed").otherwise(F.col("delivery")))


@query
def outreach_log(spark, d):
    return outreach.log_rows(s.outreach(spark, d), _delivered(spark, d), now())


@query
def contacted_leads(spark, d):
    return outreach.mark_contacted(s.leads(spark, d), _delivered(spark, d), now())


@query
def outreach_funnel(spark, d):
    return outreach.outreach_funnel(_delivered(spark, d))


def _receipts(spark, d):
    """Receipts of the planned messages: every sixth failed first, half of those were sent later,
    every fifth came twice, and some name leads that nothing was planned for."""
    id_ = F.col("id")
    planned = _messages(spark, d).select("id", "step")

    def told(rows, delivery, minutes, lead=id_):
        failed = delivery == "failed"
        return rows.select(
            lead.alias("lead_id"), "step", delivery.alias("delivery"), F.when(failed, "refused").alias("error"),
            (now() + F.make_dt_interval(mins=minutes)).alias("delivered_at"))

    first = F.when(id_ % 6 == 0, "failed").otherwise("sent")
    minutes = (id_ % 7).cast("int")
    return (
        told(planned, first, minutes)
        .union(told(planned.filter(id_ % 12 == 0), F.lit("sent"), F.lit(60)))
        .union(told(planned.filter(id_ % 5 == 0), first, minutes))
        .union(told(planned.filter(id_ % 17 == 0), first, minutes, id_ + 10_000_000)))


@query
def delivery_receipts(spark, d):
    """K4: the log rows that receipts bring."""
    return receipts.receipt_log_rows(s.outreach(spark, d), _messages(spark, d), _receipts(spark, d)).drop("body")


@query
def receipt_outcomes(spark, d):
    return receipts.receipt_outcomes(s.outreach(spark, d), _messages(spark, d), _receipts(spark, d))


@query
def receipt_leads(spark, d):
    """K4: the lead table after receipts."""
    return receipts.apply_receipts(
        s.leads(spark, d), s.outreach(spark, d), _messages(spark, d), _receipts(spark, d), now()
    ).leads.select("id", "status", "updated_at")


@query
def receipt_funnel(spark, d):
    """A5 over what receipts say."""
    return outreach.outreach_funnel(receipts.with_receipts(_messages(spark, d), _receipts(spark, d)))


@query
def due_counts(spark, d):
    return outreach.due_counts(
        s.leads(spark, d), s.outreach(spark, d), now(), 30, s.FOLLOWUPS)


# --- replies ----------------------------------------------------------------------------------


@query
def recent_messages(spark, d):
    return tables.recent_messages(s.messages(spark, d), now(), since_days=30)


@query
def contacted_map(spark, d):
    return replies.contacted_map(s.outreach(spark, d), s.leads(spark, d))


def _digest(spark, d):
    return replies.message_digest(s.messages(spark, d), RULES)


@query
def opt_out_messages(spark, d):
    rows = s.messages(spark, d)
    out = mail.wants_out(F.col("subject"), F.col("body"), RULES.opt_out_pattern)
    return rows.filter(out).select(
        "msg_id", mail.sender_address(F.col("sender")).alias("sender"),
        urls.mail_domain(F.col("sender")).alias("raw_domain"))


def _inbox(spark, d):
    return tables.recent_messages(s.messages(spark, d), now(), since_days=3_000)


@query
def reply_updates(spark, d):
    digest = replies.message_digest(_inbox(spark, d), RULES)
    return replies.reply_updates(contacted_map(spark, d), digest)


@query
def reply_updates_first(spark, d):
    digest = replies.message_digest(_inbox(spark, d), RULES)
    return replies.reply_updates(contacted_map(spark, d), digest, "first")


@query
def replied_leads(spark, d):
    return replies.apply_replies(
        s.leads(spark, d), s.outreach(spark, d), _inbox(spark, d), now(), rules=RULES).table


@query
def unmatched_messages(spark, d):
    digest = replies.message_digest(_inbox(spark, d), RULES)
    return replies.unmatched_messages(digest, contacted_map(spark, d)).select(
        "mail_domain", "n_messages")


@query
def reply_funnel(spark, d):
    digest = replies.message_digest(_inbox(spark, d), RULES)
    return replies.reply_funnel(digest, contacted_map(spark, d))


# --- lead management --------------------------------------------------------------------------


@query
def lead_list(spark, d):
    return crm.display_rows(crm.list_leads(s.leads(spark, d), "contacted", "research_only"))


@query
def lead_list_all(spark, d):
    return crm.display_rows(crm.list_leads(s.leads(spark, d)))


@query
def lead_by_id(spark, d):
    return crm.lead_by_id(s.leads(spark, d), 42).select("id", "company_name", "domain", "status")


@query
def lead_history(spark, d):
    rows = crm.lead_history(s.leads(spark, d), s.outreach(spark, d))
    shown = F.transform("history", lambda h: F.concat_ws(
        " ", h["delivery"], F.lit("to"), h["to_email"], F.date_format(h["created_at"], "yyyy-MM-dd")))
    return rows.select("id", "part", F.size("history").alias("n"), joined(shown).alias("history"))


def _deletes(spark, d):
    return table(spark, d, "labels").select((F.col("doc_id") * 3).alias("lead_id"))


@query
def leads_after_delete(spark, d):
    return crm.delete_leads(s.leads(spark, d), s.outreach(spark, d), _deletes(spark, d))[0].select(
        "id", "domain")


@query
def outreach_after_delete(spark, d):
    return crm.delete_leads(s.leads(spark, d), s.outreach(spark, d), _deletes(spark, d))[1].select(
        "id", "lead_id")


@query
def edited_leads(spark, d):
    return crm.apply_edits(s.leads(spark, d), s.edits(spark, d), now()).table


# --- gates ------------------------------------------------------------------------------------


@query
def robots_verdicts(spark, d):
    url = F.col("url")
    pages = table(spark, d, "pages").select(
        "page_id", urls.url_domain(url).alias("domain"), urls.url_path(url).alias("path"))
    n = F.col("page_id")
    rules = pages.select(
        "domain", n.alias("ord"),
        F.when(n % 5 == 0, F.lit("")).when(n % 5 == 1, F.lit("/en")).when(n % 5 == 2, F.lit("*"))
        .when(n % 5 == 3, F.lit("/de")).otherwise(F.col("path")).alias("prefix"),
        (n % 3 == 0).alias("allow")).filter(n % 4 != 0)
    closed = pages.filter(F.col("domain").startswith("blog.ththo")).select("domain")
    return gates.robots_verdicts(pages, rules, closed)


def _addresses(spark, d):
    n = F.col("page_id")
    first = F.element_at(F.array(*[F.lit(x) for x in (
        "8", "93", "10", "172", "192", "100", "11", "198")]), (n % 97 % 8 + 1).cast("int"))
    return table(spark, d, "pages").select(
        urls.url_domain(F.col("url")).alias("domain"),
        F.concat_ws(".", first, (n % 200).cast("string"), (n % 7).cast("string"),
                    F.lit("9")).alias("ip"))


@query
def public_domains(spark, d):
    return gates.public_domains(_addresses(spark, d))


@query
def public_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"))
    return gates.only_public(pages, _addresses(spark, d))


# --- lists ------------------------------------------------------------------------------------


@query
def keyword_lines(spark, d):
    """S1/S2 grammar over the lines of all documents."""
    lines = documents(spark, d).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    value = F.when(F.col("pos") % 9 == 4, F.concat(F.lit("#"), "line")).when(
        F.col("pos") % 9 == 5, F.concat(F.lit("  # "), "line")).otherwise(F.col("line"))
    ord_ = F.struct("doc_id", "pos").alias("ord")
    kept = lists.plain_list(lines.select(ord_, value.alias("value")), "keyword")
    return kept.select("ord.doc_id", "ord.pos", F.md5(F.col("keyword").cast("binary")).alias("keyword_md5"))


@query
def roster_lines(spark, d):
    r = s.roster(spark, d)
    value = F.when(F.col("ord") % 7 == 0, F.concat(F.lit(" # "), "name")).when(
        F.col("ord") % 7 == 1, F.concat(F.lit("  "), "name", F.lit("  "))
    ).otherwise(F.concat("name", F.lit(" \t "), "country"))
    return lists.parse_roster(r.select("ord", value.alias("value")))


@query
def domain_map_lines(spark, d):
    r = s.roster(spark, d)
    value = F.when(F.col("ord") % 7 == 0, F.concat("name", F.lit("\t"), "country")).otherwise(
        F.concat("country", F.lit("\t"), "name", F.lit("\t"), F.format_string("d%d.net", "ord")))
    return lists.parse_domain_map(r.select("ord", value.alias("value")))


@query
def message_templates(spark, d):
    docs = documents(spark, d).select(
        "doc_id",
        lists.parse_template(F.concat(F.lit("SUBJECT:  a: "), "text")).alias("t"))
    return docs.select(
        "doc_id", F.md5(F.col("t.subject").cast("binary")).alias("subject_md5"),
        F.md5(F.col("t.body").cast("binary")).alias("body_md5"))


# --- plans and streams ------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, d, name).schema)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _discovery(spark, d):
    """Robots and addresses consulted, known domains left unread."""
    pages = table(spark, d, "pages")
    blocked = pages.filter(F.col("page_id") % 3 == 0).select(
        urls.url_domain(F.col("url")).alias("domain"), F.col("page_id").alias("ord"),
        urls.url_path(F.col("url")).alias("prefix"), F.lit(False).alias("allow"))
    return discovery.run(
        s.page_candidates(spark, d), pages, s.page_leads(spark, d), now(), RULES, allow_non_us=True,
        candidates_only=False, host_addresses=_addresses(spark, d), robots_rules=blocked)


@query
def discovery_run(spark, d):
    """What became of every visit."""
    return _discovery(spark, d).outcomes


@query
def discovery_new_leads(spark, d):
    """The leads that the run adds."""
    return _discovery(spark, d).new_leads.select("id", "domain")


@query
def cadence_leads(spark, d):
    """The lead table after the tick."""
    tick = outreach_cycle.run(
        s.leads(spark, d), s.outreach(spark, d), None, now(), FIRST, FOLLOW_UP,
        SENDER, interval_days=30, max_followups=s.FOLLOWUPS, rules=RULES)
    return tick.leads.select("id", "status", "updated_at")


@query
def lead_table(spark, d):
    """The lead table, stored and read with its declared schema."""
    path = tables.work_dir(spark)
    s.leads(spark, d).write.parquet(path)
    return tables.read_leads(spark, path).select("id", "domain", "email", "status", "source", "created_at")


@query
def outreach_table(spark, d):
    """The message log, stored and read with its declared schema."""
    path = tables.work_dir(spark)
    s.outreach(spark, d).write.parquet(path)
    return tables.read_outreach(spark, path).drop("body")


@query
def cadence_run(spark, d):
    """Replies applied, then the messages still due."""
    tick = outreach_cycle.run(
        s.leads(spark, d), s.outreach(spark, d), s.messages(spark, d), now(), FIRST, FOLLOW_UP,
        SENDER, interval_days=30, max_followups=s.FOLLOWUPS, since_days=20, rules=RULES)
    return tick.new_log_rows


@query
def roster_run(spark, d):
    """Merge and enrichment of one country's roster."""
    run = roster_import.run(
        s.roster(spark, d), s.domain_map(spark, d), s.leads(spark, d), now(),
        profiles=_roster_profiles(spark, d), country="nation_7")
    return run.funnel


@query
def discovery_stream(spark, d):
    """T1 run to its end over the stored pages."""
    work = tables.work_dir(spark)
    jobs.discover_stream(
        _stream(spark, d, "pages"), f"{work}/leads", f"{work}/checkpoint", now(), RULES,
        allow_non_us=True, candidates_only=False).awaitTermination()
    return jobs.read_batches(spark, f"{work}/leads", schemas.LEADS)


@query
def reply_stream(spark, d):
    """T2 run to its end over the stored conversations."""
    work = tables.work_dir(spark)
    leads_ = s.leads(spark, d)
    jobs.reply_stream(
        s.messages_of(_stream(spark, d, "conversations")), leads_, s.outreach(spark, d),
        f"{work}/updates", f"{work}/checkpoint", now(), since_days=3_000,
        rules=RULES).awaitTermination()
    return jobs.leads_with_replies(leads_, jobs.merged_updates(spark, f"{work}/updates"))


@query
def cadence_tick(spark, d):
    """T3, run twice: the second run of a tick changes nothing."""
    path = f"{tables.work_dir(spark)}/log"
    jobs.write_batch(s.outreach(spark, d), path, jobs.TICKS, 0)
    for _ in range(2):
        jobs.cadence_tick(
            s.leads(spark, d), path, 1, now(), FIRST, FOLLOW_UP, SENDER, 30, s.FOLLOWUPS)
    return jobs.read_batches(spark, path, schemas.OUTREACH)
