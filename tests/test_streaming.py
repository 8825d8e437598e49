"""Incremental jobs fed in two batches end where the batch operators do."""

from datetime import datetime, timedelta

from helpers import NOW, at, by, leads, log, rows_of

from prospectry import schemas
from prospectry.operators import replies
from prospectry.operators.receipts import final_receipts
from prospectry.rules import RuleSet
from prospectry.streaming import jobs

RULES = RuleSet(keywords=("peptide",))
GOOD = "<title>%s</title>peptide add to cart sku Texas"


def test_discovery_in_two_batches(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("pages", "leads", "check"))

    def feed(*rows):
        spark.createDataFrame(list(rows), schemas.PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.PAGES).parquet(source)
        jobs.discover_stream(stream, table, check, at(), RULES).awaitTermination()

    feed((1, "https://a.test/", GOOD % "A"), (2, "https://b.test/", "<p>nothing"))
    feed((3, "https://a.test/about", GOOD % "Again"), (4, "https://c.test/", GOOD % "C"))
    got = by(jobs.read_batches(spark, table, schemas.LEADS), "domain", "id", "company_name", "source")
    assert got == {"a.test": (1, "A", "page_stream"), "c.test": (2, "C", "page_stream")}


def test_replies_in_two_batches(spark, tmp_path):
    source, updates, check = (str(tmp_path / x) for x in ("inbox", "updates", "check"))
    table = leads(spark, {}, {"status": "contacted"}, {"replied_at": datetime(2026, 1, 1), "status": "replied"})
    sent = log(spark, {"lead_id": 1, "to_email": "s@a.test"}, {"lead_id": 2, "to_email": "s@b.test"},
               {"lead_id": 3, "to_email": "s@a.test"})
    parts = [[(1, NOW, "x@a.test", "", "hello"), (2, NOW, "x@none.test", "", "")],
             [(3, NOW, "y@a.test", "", "unsubscribe"), (4, NOW - timedelta(90), "z@b.test", "", "old")]]
    for rows in parts:
        spark.createDataFrame(rows, schemas.MESSAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.MESSAGES).parquet(source)
        jobs.reply_stream(stream, table, sent, updates, check, at(), 30).awaitTermination()
    merged = jobs.merged_updates(spark, updates)
    got = jobs.leads_with_replies(table, merged)
    inbox = spark.createDataFrame(sum(parts, [])[:3], schemas.MESSAGES)
    want = replies.apply_replies(table, sent, inbox, at()).table
    assert sorted(rows_of(got), key=str) == sorted(rows_of(want), key=str)
    assert by(got, "id", "opted_out") == {1: True, 2: False, 3: True}


def test_tick_repeats_without_second_message(spark, tmp_path):
    path = str(tmp_path / "log")
    table = leads(spark, {"email": "a@x.test"}, {"email": "b@x.test"})
    sender = {"sender_name": "P", "sender_email": "p@s.test"}

    def tick(n, moment):
        jobs.cadence_tick(table, path, n, at(moment), ("Hi", "{sender_name}"), ("Re", "x"), sender, 3, 4)
        return sorted(rows_of(jobs.read_batches(spark, path, schemas.OUTREACH).select("id", "lead_id", "step")))

    assert tick(0, NOW) == [(1, 1, 1), (2, 2, 1)]
    assert tick(0, NOW) == [(1, 1, 1), (2, 2, 1)]
    assert tick(1, NOW + timedelta(1)) == [(1, 1, 1), (2, 2, 1)]
    assert tick(2, NOW + timedelta(3)) == [(1, 1, 1), (2, 2, 1), (3, 1, 2), (4, 2, 2)]


def test_new_checkpoint_keeps_leads_of_earlier_runs(spark, tmp_path):
    table = str(tmp_path / "leads")
    older = leads(spark, {"domain": "z.test"})

    def run(n, *rows):
        source = str(tmp_path / f"pages{n}")
        spark.createDataFrame(list(rows), schemas.PAGES).coalesce(1).write.parquet(source)
        stream = spark.readStream.schema(schemas.PAGES).parquet(source)
        jobs.discover_stream(stream, table, str(tmp_path / f"check{n}"), at(), RULES, existing=older).awaitTermination()

    run(1, (1, "https://a.test/", GOOD % "A"), (2, "https://b.test/", GOOD % "B"), (3, "https://z.test/", GOOD % "Z"))
    run(2, (4, "https://b.test/", GOOD % "B"), (5, "https://c.test/", GOOD % "C"))
    got = sorted(rows_of(jobs.read_batches(spark, table, schemas.LEADS).select("domain", "id")))
    assert [d for d, _ in got] == ["a.test", "b.test", "c.test"] and len({i for _, i in got}) == 3


def test_new_checkpoint_keeps_opt_outs_of_earlier_runs(spark, tmp_path):
    updates, table = str(tmp_path / "updates"), leads(spark, {}, {})
    sent = log(spark, {"lead_id": 1, "to_email": "s@a.test"}, {"lead_id": 2, "to_email": "s@b.test"})
    for n, row in enumerate([(1, NOW, "x@a.test", "", "unsubscribe"), (2, NOW, "y@b.test", "", "hello")]):
        source = str(tmp_path / f"inbox{n}")
        spark.createDataFrame([row], schemas.MESSAGES).coalesce(1).write.parquet(source)
        stream = spark.readStream.schema(schemas.MESSAGES).parquet(source)
        jobs.reply_stream(stream, table, sent, updates, str(tmp_path / f"c{n}"), at(), 30).awaitTermination()
    got = jobs.leads_with_replies(table, jobs.merged_updates(spark, updates))
    assert by(got, "id", "opted_out", "status") == {1: (True, "replied"), 2: (False, "replied")}


def test_receipts_in_three_batches(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("receipts", "outcomes", "check"))

    def minute(i):
        return NOW + timedelta(minutes=i)

    parts = [[(1, 1, "failed", "full", minute(1)), (2, 1, "sent", None, minute(2)), (3, 1, "drafted", None, minute(2))],
             [(1, 1, "failed", "full", minute(1)), (2, 1, "failed", "late", minute(9)), (None, 1, "sent", None, minute(1))],
             [(1, 1, "sent", None, minute(4)), (3, 1, "sent", None, minute(3)), (2, 1, "sent", None, minute(2))]]
    for rows in parts:
        spark.createDataFrame(rows, schemas.RECEIPTS).coalesce(1).write.mode("append").parquet(source)
        jobs.receipt_stream(spark.readStream.schema(schemas.RECEIPTS).parquet(source), path, check).awaitTermination()
    written = jobs.read_batches(spark, path, schemas.RECEIPTS)
    assert written.count() == 5  # three, none, two: what is known already is not written again
    got = rows_of(jobs.merged_receipts(spark, path), "lead_id")
    whole = spark.createDataFrame(sum(parts, []), schemas.RECEIPTS)
    assert got == rows_of(final_receipts(whole), "lead_id")
    assert [r[2] for r in got] == ["sent", "sent", "sent"]


def test_a_site_over_three_batches_is_a_site_in_one(spark, tmp_path):
    parts = [
        [(5, "https://a.test/about", "<title>A</title>peptide Texas"), (6, "https://b.test/", GOOD % "B")],
        [(3, "https://a.test/", "<title>First</title>add to cart"), (7, "https://c.test/", "<p>nothing")],
        [(9, "https://a.test/contact", "sku <a href='mailto:x@a.test'>m</a>"), (2, "https://b.test/contact", "y@b.test"),
         (8, "https://b.test/", "<title>never read</title>")]]

    def run(name, batches):
        source, table, check = (str(tmp_path / name / x) for x in ("pages", "leads", "check"))
        for rows in batches:
            spark.createDataFrame(rows, schemas.PAGES).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schemas.PAGES).parquet(source)
            jobs.discover_stream(stream, table, check, at(), RULES).awaitTermination()
        assert jobs.read_batches(spark, table, schemas.LEADS).groupBy("domain").count().filter("count > 1").count() == 0
        return rows_of(jobs.discovered_leads(spark, table).drop("id", "website"), "domain")

    got, wanted = run("three", parts), run("one", [sum(parts, [])])
    assert got == wanted and [r[schemas.LEADS.names.index("domain") - 2] for r in got] == ["a.test", "b.test"]
    assert {"x@a.test", "y@b.test"} <= {v for r in got for v in r if isinstance(v, str)}
