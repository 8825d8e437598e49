"""Column functions on single values."""

import ipaddress
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from prospectry.functions import addresses as ip
from prospectry.functions import contact, html, mail, names, text, urls
from prospectry.rules import RuleSet

ARR = "array<string>"


def test_url_domain(column):
    cases = {
        "https://www.ridgeline.test/about": "ridgeline.test",
        "https://shop.ridgeline.test": "shop.ridgeline.test",
        "HTTP://User@WWW.Ridge.test:8080/x": "user@www.ridge.test:8080",
        "https://WWW.ridge.test?x=1": "ridge.test",
        "//cdn.ridge.test/x": "cdn.ridge.test",
        "ridgeline.test/about": "", "": "", "https://ridge.test#a/b": "ridge.test",
    }
    assert column(urls.url_domain, list(cases)) == list(cases.values())


def test_hosts(column):
    cases = {" WWW.Acme.test.. ": "acme.test", "acme.test": "acme.test", "www.": "www"}
    assert column(urls.normalize_host, list(cases)) == list(cases.values())
    hosts = {
        "ridge.test": True, "localhost": False, "facebook.com": False, "m.facebook.com": False,
        "logo.png": False, "cdn.shopify.com": False, "ridge.co.uk": True, "": False,
    }
    assert column(urls.is_company_host, list(hosts)) == list(hosts.values())


def test_text_hosts(column):
    blob = (
        '<a href="https://www.bluepeak.test/shop">x</a> <a href="https://facebook.com/y">f</a> '
        "Visit greenvale.test today <img src='https://cdn.site.test/logo.png'> héacme.test"
    )
    got = column(lambda c: F.array_sort(urls.text_hosts(c)), [blob])[0]
    assert got == ["bluepeak.test", "cdn.site.test", "greenvale.test"]
    got = column(
        lambda c: F.array_sort(urls.text_hosts(c, F.lit("www.greenvale.test."))), [blob]
    )[0]
    assert got == ["bluepeak.test", "cdn.site.test"]


def test_mail_domain(column):
    cases = {"jane@www.ridge.test": "ridge.test", "a@b@c.test": "b@c.test", "nobody": "",
             "x@ RIDGE.test ": "ridge.test"}
    assert column(urls.mail_domain, list(cases)) == list(cases.values())


def test_usable_address(column):
    bad = ["%5Bemail%5D@example", "contact@mysite.com", "your@email", "your@email.com", "a@b",
           "not-an-email", "MAILTO:a@x.test", "webmaster@ridge.test", "x@Example.com", "a@b.test\n"]
    assert column(contact.is_usable_address, bad) == [False] * len(bad)
    assert column(contact.is_usable_address, ["jane.d+x@ridge.test"]) == [True]


def test_best_address(column):
    rows = [
        ["privacy@ridge.test", "sales@ridge.test"],
        ["hello@ridge.testt", "hello@ridge.test"],
        ["webmaster@ridge.test"], [],
        ["zed@other.test", "bob@ridge.test"],
        ["abe@x.test", "bob@x.test"],
        ["bob@x.test", "infodesk@longer-name.test"],
    ]
    site = lambda c: contact.best_address(c, F.lit("ridge.test"))
    assert column(site, rows, ARR) == [
        "sales@ridge.test", "hello@ridge.test", None, None, "bob@ridge.test", "abe@x.test",
        "infodesk@longer-name.test",
    ]
    assert column(contact.best_address, rows[:1], ARR) == ["sales@ridge.test"]


def test_phone_and_addresses(column):
    cases = {
        "call (555) 123-4567 now": "(555) 123-4567", "+1-555-123-4567": "+1-555-123-4567",
        "id 123455512345678": "12345551234", "none": None, "555 123 4567": "555 123 4567",
    }
    assert column(contact.first_phone, list(cases)) == list(cases.values())
    assert column(contact.addresses, ["a@x.test, b@y.test a@x.test", "none"]) == [
        ["a@x.test", "b@y.test", "a@x.test"], []]


def test_html_fields(column):
    og = '<meta property="og:site_name" content=" Acme &amp; Co ">'
    cases = {
        og + "<title>Other</title>": "Acme & Co",
        '<meta content=\'Acme\' property=\'og:site_name\'/><title>t</title>': "Acme",
        '<meta property="og:site_name" content=""><title>Title here</title>': "Title here",
        "<title>\n Acme | Shop</title>": "Acme", "<TITLE>Acme - Shop - x</TITLE>": "Acme",
        "<title>| x</title>": "", "<p>none</p>": None, "<title></title>": None,
    }
    assert column(lambda c: html.company_name(html.live_markup(c)), list(cases)) == list(
        cases.values())
    meta = {
        '<meta name="description" content="We make &quot;things&quot; ">': 'We make "things"',
        "<meta content='Other > order' name='description'>": "Other > order",
        '<meta name="description">': None, '<meta name="descriptions" content="x">': None,
        '<!-- <meta name="description" content="x"> -->': None,
    }
    assert column(lambda c: html.meta_description(html.live_markup(c)), list(meta)) == list(
        meta.values())


def test_mailto(column):
    page = (
        '<a href="mailto:a@x.test?subject=s">m</a><a class=b href=\'MAILTO:b@x.test\'>n</a>'
        '<a data-x="1" href="mailto:&#99;@x.test">o</a><a href="/about">p</a>'
    )
    got = column(lambda c: html.mailto_addresses(html.live_markup(c)), [page])[0]
    assert got == ["a@x.test", "MAILTO:b@x.test", "c@x.test"]


def test_visible_text(column):
    cases = {
        "<p>a</p><script>var t='</p>x';</script><style>p{}</style><!-- c -->b": "a b",
        "<p>one<b> two </b>\n<i>three": "one two three",
        "<p>x &amp;amp; &copy;&middot;&#8364;&#x41; &lt;b&gt; &bogus;</p>": "x &amp; ©·€A <b> &bogus;",
        "<p>&nbsp;a&nbsp;</p>": "a", "<a title='x > y'>ok</a>": "ok", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "<script>var c='<!--';</script>kept": "kept", "<p title=\"bad>rest": "rest",
        "line one\nline two": "line one\nline two", "<script>never closed <p>x": "",
    }
    got = column(lambda c: html.visible_text(html.live_markup(c)), list(cases))
    assert got == list(cases.values())


def test_visible_text_many_tags(column):
    page = "<td></td>" * 20_000 + "x" + " " * 20_000 + "<br>" * 20_000 + "y"
    assert column(lambda c: html.visible_text(html.live_markup(c)), [page]) == ["x y"]


def test_us_presence(column):
    cases = {
        "made in the USA.": (True, None), "Austin, teXas, we ship": (True, "teXas"),
        "Springfield, IN 46201.": (True, "IN"), "Berlin, Germany.": (False, None),
        "U.S. based": (False, None), "U.S.A based": (True, None), "éUSA": (False, None),
        "IN           46201": (False, None), "IN then OR 97035": (False, None),
        "OR 97035-1234": (True, "OR"), "\U0001F600 CA 90210": (True, "CA"),
        "CA         9021 44": (False, None), "West Virginia": (True, "West Virginia"),
    }
    got = [tuple(r) for r in column(text.us_presence, list(cases))]
    assert got == list(cases.values())


def test_negation(column):
    f = lambda c: text.unnegated_signal(c, ("gmp facility", "our lab"))
    cases = {
        "we run a GMP facility": True, "not a gmp facility": False,
        "not a gmp facility but later we have a real gmp facility": True,
        "not" + " " * 22 + "our lab": False, "not" + " " * 23 + "our lab": True,
        "nothing here": False, "": False, "aren't in our lab": False, "knot our lab": True,
        "our lab our lab": True, "never our lab": False,
        "k" + "not" + "x" * 0 + " " * 22 + "our lab": False,
    }
    assert column(f, list(cases)) == list(cases.values())


def test_overlapping_signals(column):
    f = lambda c: text.unnegated_signal(c, ("aba", "cgmp", "gmp"))
    cases = {"not" + " " * 21 + "ababa": True, "not" + " " * 20 + "ababa": False,
             "not" + " " * 22 + "ababa": True, "not" + " " * 22 + "cgmp": True}
    assert column(f, list(cases)) == list(cases.values())


def test_types(column):
    rules = RuleSet(keywords=("peptide",))
    fn = lambda c: text.text_company_type(c, text.evidence(c, rules), rules)
    cases = {
        "peptide licensed compounding pharmacy": "compounding_pharmacy",
        "peptide cGMP custom synthesis": "manufacturing_lab",
        "Peptide for research use only": "research_only", "peptides shop": "consumer_and_research",
        "We are not a compounding pharmacy. peptide; Research use only": "research_only",
        "This site is not a gmp facility and does not manufacture peptide": "consumer_and_research",
        "unrelated gmp facility": None,
    }
    assert column(fn, list(cases)) == list(cases.values())


def test_evidence(column):
    t = "x" * 60 + " strictly For Research Use Only. Not for human consumption " + "y" * 60
    at = t.lower().find("for research use only")
    want = t[at - 40:at + 21 + 40].strip()
    assert column(text.evidence, [t, "unrelated", "Virtuoso"]) == [want, None, None]
    assert column(text.evidence, ["RUO"]) == ["RUO"]


def test_signals(column):
    assert column(text.sells_direct, ["Add to cart. In stock", "add to cart", ""]) == [
        True, False, False]
    assert column(
        text.is_content_site, ["We may earn a commission. Our editorial team", "a guide"]
    ) == [True, False]


def test_keywords(column):
    f = lambda c: text.contains_any(c, ("BPC-157", "x+"))
    assert column(f, ["has bpc-157", "X+", "no"]) == [True, True, False]


@pytest.mark.parametrize("pair", [
    ("Blue Sky Peptide", "blueskypeptide.com"), ("Blue Sky Peptide", "randomhealthblog.com"),
    ("A", ""), ("", ""), ("Acme Labs, Inc.", "acme-labs.co.uk"),
])
def test_similarity(spark, pair):
    df = spark.createDataFrame([pair], "n string, h string")
    got = df.select(names.name_similarity(F.col("n"), F.col("h"))).first()[0]
    keep = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    assert got == SequenceMatcher(None, keep(pair[0]), keep(pair[1].split(".")[0])).ratio()


def test_mail_functions(column):
    cases = {"Jane <jane@x.test>": "jane@x.test", " a@x.test ": "a@x.test", "": "", None: ""}
    assert column(mail.sender_address, list(cases)) == list(cases.values())
    out = {"please Unsubscribe me": True, "opt out": True, "opt-out": True, "optout": True,
           "adopt output": False, "do not email": True, "hello": False}
    assert column(lambda c: mail.wants_out(F.lit("s"), c), list(out)) == list(out.values())
    got = column(
        lambda c: mail.fill_template(c, {"a": "{b}", "b": "B"}), ["{a}-{b}-{{a}}", None])
    assert got == ["{b}-B-{a}", None]
    with pytest.raises(Exception, match="unknown template field"):
        column(lambda c: mail.fill_template(c, {"a": "x"}), ["{other}"])


def test_global_addresses(column):
    samples = [
        "127.0.0.1", "10.0.0.1", "192.168.1.1", "169.254.169.254", "0.0.0.0", "8.8.8.8",
        "100.64.0.1", "192.0.0.9", "224.0.0.1", "::1", "::", "fe80::1", "2001:db8::1",
        "2606:4700::1111", "::ffff:8.8.8.8", "2001:4:112::1", "1.2.3", "x", "256.1.1.1",
        "2001:4860:4860:0:0:0:0:8888", "1:2:3", "64:ff9b::1", "198.51.100.7", "172.32.0.1",
    ]

    def truth(s):
        try:
            a = ipaddress.ip_address(s)
        except ValueError:
            return False
        return a.is_global

    want = [truth(s) for s in samples]
    want[samples.index("::ffff:8.8.8.8")] = False  # mixed notation is refused
    assert column(ip.is_global_address, samples) == want


def test_rules_reject_bad_phrases():
    with pytest.raises(ValueError):
        RuleSet(manufacturing_signals=("",))
    with pytest.raises(ValueError):
        RuleSet(commerce_signals=("Upper",))
