"""Findings over page-wise text equal those over the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from prospectry.functions import text as tx
from prospectry.operators.site_text import (
    conclusions, page_findings, site_findings, site_pieces,
)
from prospectry.operators.sites import (
    candidate_page_urls, contact_rollup, page_features, site_profiles,
)
from prospectry.rules import RuleSet

RULES = RuleSet(
    keywords=("peptide lab",), manufacturing_signals=("gmp facility", "our lab"),
    compounding_signals=("compounding pharmacy",), commerce_signals=("add to cart", "buy now", "sku"),
    content_signals=("this article", "buying guide"),
    evidence_phrases=("for research use only", "research use only", "ruo"),
)
PHRASES = (
    "peptide lab", "gmp facility", "our lab", "compounding pharmacy", "add to cart", "buy now", "sku",
    "this article", "buying guide", "for research use only", "research use only", "ruo", "not",
    "never", "isn't", "no longer", "New York", "West Virginia", "texas", "USA", "U.S.A",
    "United States", "IN", "OR", "CA", "46201", "97035-1234", "é", "x", "y" * 40, "z" * 90, "",
)


def sites(seed, n):
    """Texts of few phrases, cut into pages at spaces, so that matches straddle pages."""
    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        vocabulary = rnd.sample(PHRASES, rnd.randint(3, 9)) + ["filler"] * rnd.randint(0, 6)
        words = " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40))).split(" ")
        cuts = sorted(rnd.sample(range(len(words) + 1), min(len(words), rnd.randint(0, 12))))
        bounds = [0, *cuts, len(words)]
        ords = sorted(rnd.sample(range(200), len(bounds) - 1))
        for o, i, j in zip(ords, bounds, bounds[1:]):
            rows.append((f"d{d}", o, " ".join(words[i:j])))
    return rows


@pytest.mark.parametrize("run_bits, shift", [(0, 0), (2, 0), (2, 20), (10, 0)])
def test_same_as_whole_text(spark, run_bits, shift):
    """Also where ids are far apart (``shift``): pages are merged by their places."""
    rows = [(d, o << shift, t) for d, o, t in sites(run_bits, 300)]
    pages = spark.createDataFrame(rows, "domain string, ord bigint, text string").repartition(5)
    found = site_findings(
        page_findings(pages, RULES), RULES, {"n": F.count("*")}, 
        {"n": F.sum(F.when(F.col("level") == 1, F.col("n")))}, run_bits)
    got = found.select("domain", "n", *[c.alias(k) for k, c in conclusions(found, RULES).items()])

    whole = {}
    for d, _, t in sorted(rows):
        whole.setdefault(d, []).append(t)
    full = spark.createDataFrame(
        [(d, len(ts), " ".join(ts)) for d, ts in whole.items()], "domain string, n bigint, t string")
    t = F.col("t")
    evidence = tx.evidence(t, RULES)
    us = tx.us_presence(t, RULES)
    want = full.select(
        "domain", "n", evidence.alias("research_only_evidence"),
        tx.text_company_type(t, evidence, RULES).alias("company_type"),
        tx.sells_direct(t, RULES).alias("sells_direct"),
        tx.manufactures(t, RULES).alias("manufactures"),
        tx.is_content_site(t, RULES).alias("is_content_site"),
        us["is_us"].alias("us_based"), us["state"].alias("state"))
    got = {r.domain: r for r in got.collect()}
    want = {r.domain: r for r in want.collect()}
    assert got == want
    assert sum(r.research_only_evidence is not None for r in want.values()) > 20
    assert sum(r.state is not None for r in want.values()) > 20


def test_groups_are_bounded_whatever_the_ids_are(spark, monkeypatch):
    """Nine of ten pages on one site, ids a million apart: no group has over four rows."""
    from prospectry.operators import site_text

    seen, merge = [], site_text._merge

    def watched(rows, keys, *rest):
        seen.append(rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first())
        return merge(rows, keys, *rest)

    monkeypatch.setattr(site_text, "_merge", watched)
    texts = [("hot", i << 20, f"w{i}" + " our" * (i == 17)) for i in range(60)] + [(f"d{i}", i, "x") for i in range(6)]
    texts[18] = ("hot", 18 << 20, "lab texas")
    pages = spark.createDataFrame(texts, "domain string, ord bigint, text string").repartition(3)
    got = site_findings(page_findings(pages, RULES), RULES, {"n": F.count("*")}, {"n": F.sum("n")}, 2)
    rows = {r.domain: r for r in got.collect()}
    assert [tuple(x) for x in seen] == [(4, 66), (4, 15 + 6), (4, 4 + 6)]
    assert rows["hot"].n == 60 and rows["hot"].manufacturing and rows["hot"].state_name.value == "texas"
    assert not rows["d1"].manufacturing


def test_pieces(spark):
    rows = [("a", 0, "x"), ("a", 63, "y"), ("a", 64, "z"), ("b", 5, "")]
    pages = spark.createDataFrame(rows, "domain string, ord bigint, text string")
    got = [tuple(r) for r in site_pieces(pages).orderBy("domain", "piece").collect()]
    assert got == [("a", 0, 2, "x y"), ("a", 1, 1, "z"), ("b", 0, 1, "")]


PAGES = [
    (1, "https://www.ridge.test/about", "<title>| x</title><p>about</p>"),
    (2, "https://ridge.test/", '<title></title><a href="mailto:bob@else.test">m</a>peptide lab'),
    (3, "https://ridge.test", "<title>never read</title>"),
    (4, "https://ridge.test/contact/",
     "<title>Ridge</title><!-- sales@ridge.test --><p>Add to cart. SKU. Austin, Texas 555-123-4567"),
    (5, "https://ridge.test/blog", "<p>not a candidate page: buy now"),
    (6, "https://vale.test/contact", ""), (7, "https://vale.test/", None), (8, "nohost", "<p>x"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def test_candidate_profile(spark):
    rows = site_profiles(pages(spark), RULES).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.domain == "ridge.test" and r.url == "https://ridge.test/"
    assert r.company_name == ""          # set by the about page, later pages not consulted
    assert r.email == "bob@else.test"    # the first page that has one
    assert r.phone == "555-123-4567" and r.state == "Texas" and r.us_based
    assert r.sells_direct and r.company_type == "consumer_and_research"
    assert r.pages_checked == [PAGES[1][1], PAGES[0][1], PAGES[3][1]] and r.n_pages == 3


def test_all_pages_profile(spark):
    r = site_profiles(pages(spark), RULES, candidates_only=False).collect()
    assert [(x.domain, x.n_pages, x.pages_checked) for x in r] == [("ridge.test", 5, None)]
    roll = contact_rollup(page_features(pages(spark), RULES)).collect()
    assert [(x.company_name, x.email, x.phone) for x in roll] == [
        ("", "bob@else.test", "555-123-4567")]


def test_candidate_urls(spark):
    got = candidate_page_urls(spark.createDataFrame([("a.test",)], "domain string"))
    rows = got.orderBy("path_rank").collect()
    assert [(r.path, r.url) for r in rows][:2] == [
        ("/", "https://a.test/"), ("/about", "https://a.test/about")]
    assert len(rows) == 5
