"""Keywords and denied hosts as tables."""

from pyspark.sql import functions as F

from prospectry import RuleSet
from prospectry.functions.strings import contains_some
from prospectry.operators import vocabulary


def test_keywords_of_any_number_are_found_as_whole_words(spark):
    words = [(f"word{i}",) for i in range(6_000)] + [("BPC-157",), ("c++",), ("two  words",), ("two words",), ("...",), (None,)]
    keywords = spark.createDataFrame(words, "keyword string")
    texts = [(1, "has WORD5999 and bpc-157."), (2, "word59990 (two words) c++"), (3, None), (4, ""), (5, "bpc 157 xbpc-157")]
    got = vocabulary.keyword_hits(spark.createDataFrame(texts, "id bigint, text string"), keywords, "id").collect()
    assert sorted(map(tuple, got)) == [(1, "bpc-157"), (1, "word5999"), (2, "c++"), (2, "two words")]
    assert len(RuleSet(keywords=tuple(w for w, in words[:6_000])).keywords) == 6_000


def test_keywords_of_any_number_are_found_anywhere(spark):
    words = [f"word{i}" for i in range(3000)] + ["BPC-157", "  c++ ", "two words", "ß", "é", "", None, "ü\n"]
    texts = [(1, "has WORD2999 and xbpc-157x."), (2, "two  words, two words; c++ swords"), (3, None), (4, ""), (5, "STRASSE ß É")]
    frame = spark.createDataFrame(texts, "id bigint, text string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = vocabulary.keyword_substrings(frame, table, "id")
    low = sorted({w.strip().lower() for w in words if w} - {""})
    wanted = sorted((i, w) for i, t in texts for w in low if w in (t or "").lower())
    assert sorted(map(tuple, got.collect())) == wanted and (1, "word299") in wanted
    blocks = vocabulary.keyword_substrings(frame, table, "id", block_bytes=60_000)
    assert sorted(map(tuple, blocks.collect())) == wanted
    # as with the keywords of a rule set
    literal = frame.filter(contains_some(F.lower("text"), low)).select("id")
    assert {r[0] for r in literal.collect()} == {i for i, _ in wanted}
    assert vocabulary.keyword_substrings(frame, table.limit(0), "id").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Join" not in plan


def test_a_text_meets_all_its_keywords_at_once(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma")], "id bigint, text string")
    words = spark.createDataFrame([(w,) for w in ("alpha beta", "beta gamma", "alpha gamma", "alpha")], "keyword string")
    got = vocabulary.keyword_hits(texts, words, "id")
    assert sorted(r.keyword for r in got.collect()) == ["alpha", "alpha beta", "beta gamma"]
    assert "collect_set" in got._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_text_are_not_moved_to_few_keywords(spark):
    texts = spark.createDataFrame([(1, "Alpha  beta (alpha beta) c++"), (2, "xalpha beta"), (3, None), (4, "éalpha —c++")], "id bigint, text string")
    words = spark.createDataFrame([(w,) for w in ("alpha beta", "alpha", "c++", "beta)")], "keyword string")
    got = vocabulary.keyword_hits(texts, words, "id")
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(1, "alpha"), (1, "alpha beta"), (1, "beta)"), (1, "c++"), (4, "c++")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    # tables too large to be sent are joined, with the same result
    assert sorted(map(tuple, vocabulary.keyword_hits(texts, words, "id", block_bytes=0).collect())) == rows


def test_denied_hosts_of_any_number(spark):
    denied = spark.range(6_000).selectExpr("concat('d', id, '.test') AS host").union(
        spark.createDataFrame([("a.b.test",)], "host string"))
    hosts = ["d7.test", "www.d8.test", "x.d6001.test", "a.b.test", "b.test", "c.a.b.test", None]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host for r in vocabulary.without_denied_hosts(rows, denied).collect()}
    assert got == {"x.d6001.test", "b.test", "c.a.b.test", None}
