"""Joins with heavy keys, and gates that look only where something can be found."""

import json

import pytest
from helpers import by, leads, rows_of
from pyspark.sql import functions as F

from prospectry.operators import candidates, gates, replies, roster
from prospectry.operators.skew import heavy_keys, join_skewed
from prospectry.sources import search


@pytest.fixture()
def plain_shuffles(spark):
    """Shuffled joins with as many tasks as partitions, so that one key is one task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def share_of_largest_task(df):
    counts = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


def skewed(spark, n=4000, column="domain"):
    """Nine of ten rows on one key, some on keys of their own, some without."""
    key = F.when(F.col("id") % 10 != 0, "hot.test").when(F.col("id") % 50 == 0, F.lit(None)).otherwise(
        F.format_string("d%d.test", F.col("id") % 300))
    return spark.range(n).withColumn(column, key)


def test_heavy_keys_are_few_and_none_is_missed(spark):
    assert [r[0] for r in heavy_keys(skewed(spark), "domain").collect()] == ["hot.test"]
    many = spark.range(20_000).select((F.col("id") % 7000).alias("k"))
    assert heavy_keys(many, "k").count() == 0
    even = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert heavy_keys(even, "k").count() == 10
    assert heavy_keys(even.limit(0), "k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_is_the_plain_join(spark, plain_shuffles, how):
    rows = skewed(spark)
    unique = spark.createDataFrame(
        [("hot.test", 1), ("d10.test", 2), ("d70.test", 3), ("unused.test", 4)], "domain string, v int")
    key = lambda r: tuple(map(str, r))
    got, wanted = join_skewed(rows, unique, "domain", how), rows.join(unique, "domain", how)
    assert got.columns == wanted.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, wanted.collect()))
    if how != "left_anti":
        assert share_of_largest_task(wanted) > 0.85
        assert share_of_largest_task(got) < 0.35


def test_unknown_join(spark):
    with pytest.raises(ValueError):
        join_skewed(spark.range(1), spark.range(1), "id", "full")


def test_public_hosts_of_a_heavy_domain(spark, plain_shuffles):
    addresses = spark.createDataFrame(
        [("hot.test", "8.8.8.8"), ("d10.test", "10.0.0.1"), ("d20.test", "8.8.4.4")], "domain string, ip string")
    got = gates.only_public(skewed(spark), addresses)
    assert by(got.groupBy("domain").count(), "domain", "count") == {"hot.test": 3600, "d20.test": 14}
    assert share_of_largest_task(got) < 0.35 and "_salt" in plan(got)


def test_replies_of_a_heavy_mail_domain(spark, plain_shuffles):
    contacted = skewed(spark, column="mail_domain").withColumnRenamed("id", "lead_id").filter("mail_domain IS NOT NULL")
    digest = spark.createDataFrame(
        [("hot.test", 2, 11, False, True), ("d10.test", 1, 12, True, True)],
        "mail_domain string, n_messages long, first_id long, first_out boolean, any_out boolean")
    got = replies.reply_updates(contacted, digest, "first")
    assert by(got.groupBy("first_msg_id", "opted_out").count(), "first_msg_id", "count") == {11: 3600, 12: 14}
    assert "_salt" in plan(got)


def test_roster_of_a_heavy_domain(spark, plain_shuffles):
    located = skewed(spark).select(
        F.col("id").alias("ord"), F.format_string("n%d", "id").alias("name"), F.lit("US").alias("country"), "domain")
    got = roster.roster_outcomes(located, leads(spark, {"domain": "d20.test"}))
    counts = {(r["domain"], r["outcome"]): r["count"] for r in got.groupBy("domain", "outcome").count().collect()}
    assert counts["hot.test", "added"] == 1 and counts["hot.test", "updated"] == 3599
    assert counts[None, "no_domain"] == 80 and counts["d20.test", "updated"] == 14 and ("d20.test", "added") not in counts
    assert share_of_largest_task(got) < 0.35


def robots(spark, *rows):
    return spark.createDataFrame(list(rows), "domain string, ord int, prefix string, allow boolean")


def test_prefixes_are_looked_up_at_the_lengths_of_rules_only(spark):
    rules = robots(spark, ("hot.test", 1, "/private/", False), ("hot.test", 2, "/private/open", True),
                   ("hot.test", 3, "/a", False), ("hot.test", 4, "/b", False), ("d20.test", 1, "", False))
    paths = skewed(spark).select("domain", F.concat(
        F.when(F.col("id") % 4 == 0, "/private/").when(F.col("id") % 4 == 1, "/private/open/").otherwise("/c/"),
        F.col("id").cast("string"), F.repeat(F.lit("/long"), 40)).alias("path"))
    looked_up = gates.looked_up_prefixes(paths, rules)
    counts = by(looked_up.groupBy("domain").count(), "domain", "count")
    assert set(counts) == {"hot.test", "d20.test"}  # domains without rules are skipped
    assert counts["hot.test"] <= 3600 * 3 and counts["d20.test"] == 14
    got = gates.robots_verdicts(paths, rules)
    wanted = paths.filter(~((F.col("domain") == "hot.test") & F.col("path").startswith("/private/")) | F.col("domain").isNull())
    assert got.filter("allowed").count() == wanted.count() and got.count() == 4000


def test_verdicts_of_a_heavy_domain_are_dealt_out(spark, plain_shuffles):
    rules = robots(spark, ("hot.test", 1, "/x", False))
    asked = skewed(spark).select("domain", F.concat(F.lit("/x"), F.col("id").cast("string")).alias("path"))
    looked_up = gates.looked_up_prefixes(asked, rules)
    assert looked_up.count() == 3600 and share_of_largest_task(looked_up) < 0.35


def test_rules_of_a_user_agent(spark):
    groups = spark.createDataFrame([
        ("a.test", 1, "*", 1, "/all", False), ("a.test", 2, "Finder", 1, "/finder", False),
        ("a.test", 2, "other", 1, "/finder", False), ("a.test", 3, "finder", 1, "/late", False),
        ("b.test", 1, "otherbot", 1, "/", False), ("b.test", 2, " * ", 1, "/b", False), ("b.test", 3, "*", 1, "/c", False),
        ("c.test", 1, "otherbot", 1, "/", False), ("d.test", 1, "", 1, "/", False)],
        "domain string, group int, agent string, ord int, prefix string, allow boolean")
    got = gates.agent_rules(groups, "SiteFinder/1.0 (+https://x.test)")
    assert rows_of(got.select("domain", "prefix"), "domain") == [("a.test", "/finder"), ("b.test", "/b")]
    asked = spark.createDataFrame(
        [("a.test", "/all"), ("a.test", "/finder/x"), ("b.test", "/b1"), ("c.test", "/")], "domain string, path string")
    verdicts = gates.robots_verdicts(asked, got)
    assert by(verdicts, "path", "allowed") == {"/all": True, "/finder/x": False, "/b1": False, "/": True}


def test_no_body_is_moved_before_it_is_parsed(spark, plain_shuffles, monkeypatch):
    one = json.dumps({"organic": [{"link": "https://x.test"}]})
    rows = [("serper", q, "q", q == 30, one) for q in range(40)] + [("brave", q, "q", False, one) for q in range(5)]
    df = spark.createDataFrame(rows, "provider string, q_ord bigint, query string, failed boolean, body string").repartition(3)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/responses-{id(df)}")
    df = spark.read.parquet(path)
    kept = candidates.before_first_failure(df)
    assert "Exchange hashpartitioning" not in plan(search.search_results(kept))
    assert by(kept.groupBy("provider").count(), "provider", "count") == {"serper": 30, "brave": 5}
    monkeypatch.setattr(candidates, "MOST_PROVIDERS", 0)
    other = candidates.before_first_failure(df)
    assert rows_of(other, "provider", "q_ord") == rows_of(kept, "provider", "q_ord") and "_salt" in plan(other)
