"""Queries, providers, candidates, qualification and insertion."""

import json

import pytest
from helpers import NOW, at, by, leads, profile_rows, rows_of
from pyspark.sql import functions as F

from prospectry.operators import candidates, funnels, gates, hosts, query_building, sites
from prospectry.operators import leads as lead_ops
from prospectry.operators.ordering import first_by, numbered, row_index
from prospectry.plans import discovery
from prospectry.rules import QUERY_TEMPLATES, RuleSet
from prospectry.sources import lists, search


def test_row_index_over_blocks(spark):
    ords = [5, 0, 1 << 19, (1 << 20) + 3, (1 << 20) + 1, 3 << 40, (3 << 40) + 7, 1 << 62]
    df = spark.createDataFrame([(o,) for o in ords], "ord bigint").repartition(4)
    got = by(row_index(df, "ord", "n", start=10), "ord", "n")
    assert got == {o: i for i, o in enumerate(sorted(ords), start=10)}


def test_dense_numbers_for_keys_of_any_kind(spark):
    rows = [(p, q, g, i) for p in ("a", "b") for q in (0, 1 << 32, (1 << 62) + 1) for g in range(100) for i in range(3)]
    shuffled = spark.createDataFrame(rows, "p string, q bigint, page int, pos int").repartition(7)
    order = [F.col("p").desc(), "q", "page", "pos"]
    got = numbered(shuffled, order, "n", start=F.lit(5)).orderBy("n").collect()
    wanted = sorted(rows, key=lambda r: (-ord(r[0]), *r[1:]))
    assert [tuple(r) for r in got] == [(*r, i) for i, r in enumerate(wanted, 5)]
    assert numbered(shuffled.limit(0), order, "n").count() == 0
    ties = numbered(spark.range(50).select(F.lit(1).alias("k")).repartition(5), ["k"], "n")
    assert sorted(r["n"] for r in ties.collect()) == list(range(1, 51))


def test_candidates_keep_their_order_for_large_ids_and_many_pages(spark):
    def body(*urls):
        return json.dumps({"organic": [{"link": u} for u in urls]})

    rows = [("serper", q, "q", False, body(f"https://s{q}-{g}.test", f"https://t{q}-{g}.test"), g)
            for q in (1, 2, 1 << 32, 1 << 40) for g in range(100)]
    rows += [("serper", 3, "q", False, body(*[f"https://r{i}.test" for i in range(70)]), 0)]
    df = spark.createDataFrame(
        rows, "provider string, q_ord bigint, query string, failed boolean, body string, page int").repartition(6)
    found = search.search_results(df)
    listed = candidates.candidate_list(found).orderBy("ord").collect()
    wanted = [f"https://{x}{q}-{g}.test" for q in (1, 2) for g in range(100) for x in "st"]
    wanted += [f"https://r{i}.test" for i in range(70)]
    wanted += [f"https://{x}{q}-{g}.test" for q in (1 << 32, 1 << 40) for g in range(100) for x in "st"]
    assert [r.url for r in listed] == wanted and [r.ord for r in listed] == list(range(1, len(wanted) + 1))
    capped = candidates.cap_results(found.filter("q_ord = 1"), 150)
    assert {(r.page, r.position) for r in capped.collect()} == {(g, i) for g in range(50) for i in range(2)}  # that provider gives 100
    firsts = candidates.visit_list(candidates.candidate_list(found), 3).collect()
    assert [r.domain for r in firsts] == ["s1-0.test", "t1-0.test", "s1-1.test"]


def test_first_by(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert rows_of(first_by(df, ["k"], ["o"]), "k") == [("a", 1, "y"), ("b", 3, None)]


def keywords(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "ord bigint, keyword string")


def test_queries_take_turns(spark):
    q = query_building.build_queries(keywords(spark, "k1", "k2"), list(QUERY_TEMPLATES), 4)
    assert sorted(r.type for r in q.collect()) == sorted(QUERY_TEMPLATES)


def test_queries_full_order(spark):
    rules = RuleSet(templates={"a": ("1 {peptide}", "2 {peptide}"), "b": ("3 {peptide}",)})
    q = query_building.build_queries(keywords(spark, "x", "y"), ("a", "b"), rules=rules)
    assert [r.query for r in q.orderBy("q_ord").collect()] == [
        "1 x", "3 x", "1 y", "3 y", "2 x", "2 y"]
    with pytest.raises(ValueError, match="nope"):
        query_building.build_queries(keywords(spark, "x"), ["a", "nope"], rules=rules)
    assert query_building.build_queries(keywords(spark), ("a",), rules=rules).count() == 0


def test_lookup_query(spark):
    df = query_building.lookup_queries(spark.createDataFrame([("Acme",)], "name string"))
    assert df.first().query == '"Acme" peptides official site'


BODIES = {
    "google_cse": {"items": [{"link": "https://a.test", "title": "A"}, {"title": "no link"}]},
    "bing": {"webPages": {"value": [{"url": "https://b.test", "name": "B", "snippet": "s"}]}},
    "serper": {"organic": [{"link": "https://c.test", "title": "C", "snippet": "s"}], "x": 1},
    "brave": {"web": {"results": [{"url": "https://d.test", "title": "D", "description": "s"}]}},
}


def responses(spark, *rows):
    return spark.createDataFrame(
        list(rows), "provider string, q_ord bigint, query string, failed boolean, body string")


def test_search_shapes(spark):
    df = responses(spark, *[(p, 0, "q", False, json.dumps(b)) for p, b in BODIES.items()],
                   ("serper", 1, "q", False, "{}"), ("serper", 2, "q", True, None))
    got = rows_of(search.search_results(df).select("provider", "position", "url", "title", "snippet"),
                  "provider", "position")
    assert got == [
        ("bing", 0, "https://b.test", "B", "s"), ("brave", 0, "https://d.test", "D", "s"),
        ("google_cse", 0, "https://a.test", "A", ""), ("google_cse", 1, "", "no link", ""),
        ("serper", 0, "https://c.test", "C", "s")]


def test_breaker_keeps_other_providers(spark):
    one = json.dumps(BODIES["serper"])
    df = responses(
        spark, ("google_cse", 0, "q", True, None), ("google_cse", 1, "r", False, one),
        ("serper", 0, "q", False, one), ("serper", 1, "r", False, one),
        ("brave", 0, "q", False, one), ("brave", 1, "r", True, None), ("brave", 2, "s", False, one))
    kept = candidates.before_first_failure(df)
    assert rows_of(kept.select("provider", "q_ord"), "provider", "q_ord") == [
        ("brave", 0), ("serper", 0), ("serper", 1)]


def test_breaker_keeps_earlier_pages(spark):
    df = spark.createDataFrame(
        [("p", 0, 0, False), ("p", 0, 1, True), ("p", 1, 0, False)],
        "provider string, q_ord bigint, page int, failed boolean")
    kept = candidates.before_first_failure(df, order=("q_ord", "page"))
    assert rows_of(kept.select("q_ord", "page")) == [(0, 0)]


def test_caps_and_union(spark):
    rows = [(p, 0, "q", i, f"https://{p}{i}.test") for p in ("brave", "bing", "google_places")
            for i in range(60)]
    df = spark.createDataFrame(
        rows, "provider string, q_ord bigint, query string, position bigint, url string")
    capped = candidates.cap_results(df, 55)
    assert by(capped.groupBy("provider").count(), "provider", "count") == {
        "brave": 20, "bing": 50, "google_places": 55}
    listed = candidates.candidate_list(capped).orderBy("ord").collect()
    assert [r.source for r in listed] == ["brave"] * 20 + ["bing"] * 50 + ["google_places"] * 55
    assert listed[0].url == "https://brave0.test" and listed[19].url == "https://brave19.test"


def test_directory(spark):
    body = json.dumps({"results": [
        {"place_id": "p1", "name": "One", "formatted_address": "x"}, {"place_id": "", "name": "None"},
        {"place_id": "p2"}, {"place_id": "p3", "name": "Three"}]})
    places = search.directory_results(responses(spark, ("google_places", 0, "q", False, body)))
    details = spark.createDataFrame(
        [("p1", "https://one.test"), ("p2", ""), ("p3", "https://three.test")],
        "place_id string, website string")
    got = candidates.cap_results(candidates.directory_websites(places, details), 2)
    assert rows_of(got.select("name", "address", "url"), "name") == [
        ("One", "x", "https://one.test"), ("Three", None, "https://three.test")]


def test_first_visit_and_limit(spark):
    df = spark.createDataFrame(
        [(3, "https://www.a.test/x", "q3", "s"), (1, "https://b.test", "q1", "s"),
         (2, "http://a.test", "q2", "s"), (0, "no domain", "q0", "s"), (4, "https://c.test", "q4", "s")],
        "ord bigint, url string, query string, source string")
    assert rows_of(candidates.visit_list(df, 2).select("ord", "domain"), "ord") == [
        (1, "b.test"), (2, "a.test")]
    assert candidates.visit_list(df).count() == 3


def test_lookup_provider(spark):
    rows = [(p, 0, "q", i, f"https://{i}.test") for p in ("google_cse", "brave") for i in range(8)]
    df = spark.createDataFrame(
        rows, "provider string, q_ord bigint, query string, position bigint, url string")
    got = candidates.lookup_results(df, ("google_cse", "brave"))
    assert {r.provider for r in got.collect()} == {"brave"} and got.count() == 6
    assert candidates.lookup_results(df, ()).count() == 0


SELLER = {"company_type": "research_only", "sells_direct": True, "us_based": True}


@pytest.mark.parametrize("change, flags, want", [
    ({"company_type": None}, {}, "skipped_not_relevant"),
    ({"us_based": False}, {}, "skipped_non_us"),
    ({"us_based": False}, {"allow_non_us": True}, None),
    ({"is_content_site": True, "sells_direct": False}, {}, "skipped_content_site"),
    ({"is_content_site": True}, {}, None),
    ({"sells_direct": False}, {}, "skipped_not_a_vendor"),
    ({}, {}, None),
    ({"sells_direct": False}, {"vendors_only": False}, None),
])
def test_skip_reason(spark, change, flags, want):
    df = profile_rows(spark, {"domain": "a.test", **SELLER, **change})
    assert df.select(lead_ops.skip_reason(**flags)).first()[0] == want


def visits(spark, *domains):
    return spark.createDataFrame(
        [(i, f"https://{d}/", f"q{i}", "serper", d) for i, d in enumerate(domains)],
        "ord bigint, url string, query string, source string, domain string")


def test_insert_once(spark):
    known = leads(spark, {"domain": "old.test", "id": 7})
    profiles = profile_rows(
        spark, {"domain": "old.test", **SELLER}, {"domain": "new.test", "company_name": "", **SELLER},
        {"domain": "next.test", "company_name": "Next", **SELLER},
        {"domain": "skip.test", "company_type": "research_only"})
    judged = lead_ops.judged_visits(
        visits(spark, "next.test", "old.test", "new.test", "skip.test", "dead.test"), profiles)
    change = lead_ops.add_leads(known, judged, at())
    assert by(change.outcomes, "domain", "outcome") == {
        "old.test": "duplicate", "new.test": "added", "next.test": "added",
        "skip.test": "skipped_not_a_vendor", "dead.test": "fetch_failed"}
    got = by(change.table, "domain", "id", "company_name", "matched_query", "status", "created_at")
    assert got["next.test"] == (8, "Next", "q0", "new", NOW)
    assert got["new.test"] == (9, "new.test", "q2", "new", NOW)
    assert got["old.test"][0] == 7 and len(got) == 3
    again = lead_ops.add_leads(change.table, judged, at())
    assert sorted(rows_of(again.table)) == sorted(rows_of(change.table))
    counts = by(funnels.discovery_funnel(again.outcomes), "outcome", "n")
    assert counts == {
        "added": 0, "duplicate": 3, "skipped_not_relevant": 0, "skipped_content_site": 0,
        "skipped_not_a_vendor": 1, "skipped_non_us": 0, "fetch_failed": 1}
    assert lead_ops.preview(judged).count() == 4


def test_discovery_run_gates(spark):
    rules = RuleSet(keywords=("peptide",))
    html = "<title>T</title>peptide add to cart sku Texas"
    pages = spark.createDataFrame(
        [(1, "https://a.test/", html), (2, "https://b.test/", html), (3, "https://c.test/", html),
         (4, "https://c.test/about", html), (5, "https://d.test/", html)],
        "page_id bigint, url string, html string")
    cand = pages.select(F.col("page_id").alias("ord"), "url", F.lit("q").alias("query"),
                        F.lit("serper").alias("source"))
    ips = spark.createDataFrame(
        [("a.test", "8.8.8.8"), ("b.test", "8.8.8.8"), ("b.test", "10.0.0.1"), ("c.test", "1.1.1.1"),
         ("d.test", "1.1.1.1")], "domain string, ip string")
    robots = spark.createDataFrame(
        [("c.test", 0, "/about", False), ("a.test", 0, "/", True), ("a.test", 1, "/", False)],
        "domain string, ord bigint, prefix string, allow boolean")
    run = discovery.run(cand, pages, leads(spark, {"domain": "d.test"}), at(), rules,
                        host_addresses=ips, robots_rules=robots)
    assert by(run.outcomes, "domain", "outcome") == {
        "a.test": "added", "b.test": "fetch_failed", "c.test": "added", "d.test": "duplicate"}
    assert by(run.judged, "domain", "n_pages") == {
        "a.test": 1, "b.test": None, "c.test": 1, "d.test": None}
    assert run.new_leads.count() == 2


def test_robots(spark):
    asked = spark.createDataFrame(
        [("a.test", "/"), ("a.test", "/contact"), ("b.test", "/x"), ("c.test", "/"), ("d.test", "/"),
         ("e.test", "/q")], "domain string, path string")
    rules = spark.createDataFrame(
        [("a.test", 0, "/con", False), ("a.test", 1, "/", True), ("d.test", 0, "*", False),
         ("e.test", 0, "", False), ("e.test", 1, "/", False)],
        "domain string, ord bigint, prefix string, allow boolean")
    closed = spark.createDataFrame([("c.test",), ("c.test",)], "domain string")
    got = {(r.domain, r.path): r.allowed for r in gates.robots_verdicts(asked, rules, closed).collect()}
    assert got == {("a.test", "/"): True, ("a.test", "/contact"): False, ("b.test", "/x"): True,
                   ("c.test", "/"): False, ("d.test", "/"): False, ("e.test", "/q"): True}


def test_public_domains(spark):
    ips = spark.createDataFrame(
        [("a", "8.8.8.8"), ("a", "::1"), ("b", "2606:4700::1111"), ("c", "bad")], "domain string, ip string")
    assert rows_of(gates.public_domains(ips)) == [("b",)]


def test_seed_merge(spark):
    texts = spark.createDataFrame(
        [("see https://known.test/x and fresh.test", "dir.test"), ("dir.test too", "www.dir.test")],
        "content string, own string")
    found = hosts.mined_hosts(texts, source_host="own")
    seeds = spark.createDataFrame([("https://www.known.test/",), ("bare.test.",)], "url string")
    assert sorted(rows_of(found)) == [("fresh.test",), ("known.test",)]
    assert rows_of(hosts.seed_additions(found, seeds)) == [("fresh.test", "https://fresh.test/")]
    assert rows_of(hosts.seed_merge_counts(found, seeds)) == [(1, 1)]


def test_list_files(spark, tmp_path):
    (tmp_path / "k.txt").write_text("# note\n\n  BPC  \n  # kept\nTB\r\n")
    got = lists.read_keywords(spark, str(tmp_path / "k.txt")).orderBy("ord")
    assert [r.keyword for r in got.collect()] == ["BPC", "# kept", "TB"]
    assert lists.read_seed_urls(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "r.tsv").write_text("# h\nAcme\tCanada\n  # x\nBolt\n\tNone\n")
    assert rows_of(lists.read_roster(spark, str(tmp_path / "r.tsv")).select("name", "country"), "name") == [
        ("Acme", "Canada"), ("Bolt", ""), ("None", "")]
    (tmp_path / "m.tsv").write_text("A\tx\told.test\nB\tonly two\nA\ty\tnew.test\textra\n")
    assert rows_of(lists.read_domain_map(spark, str(tmp_path / "m.tsv")).select(
        "name", "country", "domain")) == [("A", "y", "new.test")]
    (tmp_path / "t.txt").write_text("SUBJECT: Hi: there \n\n\nBody {x}\nend\n")
    assert rows_of(lists.read_template(spark, str(tmp_path / "t.txt"))) == [("Hi: there", "Body {x}\nend")]
    (tmp_path / "bad.txt").write_text("Hello\n")
    with pytest.raises(Exception, match="Subject"):
        lists.read_template(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "b.html").write_text("see\nacme.test")
    assert lists.read_blob(spark, str(tmp_path / "b.html")).first().content == "see\nacme.test"


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_same_with_any_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pages = spark.createDataFrame(
            [(i, f"https://s{i % 5}.test/", f"<title>t{i}</title>x{i}") for i in range(40)],
            "page_id bigint, url string, html string").repartition(int(partitions))
        got = by(sites.site_profiles(pages, RuleSet(), candidates_only=False), "domain",
                 "company_name", "n_pages")
        assert got == {f"s{i}.test": (f"t{i}", 8) for i in range(5)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
