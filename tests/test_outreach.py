"""Cadence, message log, replies, roster, resolution and lead management."""

import difflib
import random
from datetime import datetime, timedelta

import pytest
from helpers import NOW, at, by, leads, log, profile_rows, rows_of
from pyspark.sql import functions as F

from prospectry import schemas
from prospectry.operators import crm, funnels, matching, outreach, receipts, replies, roster
from prospectry.plans import outreach_cycle, roster_import
from prospectry.rules import RuleSet
from prospectry.sources.tables import recent_messages


def days(n):
    return NOW - timedelta(days=n)


@pytest.mark.parametrize("lead, history, cap, want", [
    ({}, [], 4, 1),
    ({}, [2], 4, None),
    ({}, [3], 4, 2),
    ({}, [9, 6, 3], 4, 4),
    ({}, [None], 4, 2),
    ({"replied_at": days(1)}, [], 4, None),
    ({"status": "Replied"}, [9], 4, None),
    ({"status": "qualified"}, [], 4, None),
    ({"opted_out": True}, [], 4, None),
    ({}, [12, 9, 6], 2, None),
])
def test_next_step(spark, lead, history, cap, want):
    rows = [{"lead_id": 1, "created_at": None if d is None else days(d)} for d in history]
    got = outreach.with_next_step(leads(spark, lead), log(spark, *rows), at(), 3, cap)
    assert got.first().next_step == want


def test_failed_messages_do_not_count(spark):
    failed = log(spark, {"lead_id": 1, "delivery": "failed", "created_at": days(1)})
    assert outreach.with_next_step(leads(spark, {}), failed, at()).first().next_step == 1


def test_plan(spark):
    table = leads(spark, {"email": None}, {"email": ""}, {"email": "c@x.test"},
                  {"email": "d@x.test", "manufactures": True, "created_at": datetime(2025, 1, 1)},
                  {"email": "e@x.test", "created_at": None})
    empty = log(spark)
    plan = lambda *a: [r.id for r in outreach.plan_outreach(table, empty, at(), *a).collect()]
    assert plan() == [5, 4, 3]
    assert plan(True) == [4]
    assert plan(False, 2) == [5, 4]
    assert rows_of(outreach.due_counts(table, empty, at())) == [(3, 3)]


SENDER = {"sender_name": "Pat", "sender_email": "pat@s.test", "sender_company": "S",
          "sender_postal_address": "1 St", "unsubscribe_line": "reply stop"}
FIRST, AGAIN = ("Hi", "Hello {sender_name}"), ("Re: Hi", "Again {sender_email}")


def rendered(spark, sender=SENDER):
    table = leads(spark, {"email": "a@x.test", "domain": "a.b.test"}, {"email": "b@x.test"})
    history = log(spark, {"lead_id": 2, "created_at": days(5)})
    plan = outreach.plan_outreach(table, history, at())
    return table, history, outreach.render_messages(plan, FIRST, AGAIN, sender)


def test_drafts(spark):
    _, _, messages = rendered(spark)
    got = by(outreach.draft_rows(messages, "Pat", "pat@s.test"), "lead_id",
             "to", "subject", "from", "reply_to", "body", "draft")
    assert got[1] == ("a@x.test", "Hi", "Pat <pat@s.test>", "pat@s.test", "Hello Pat",
                      "0001-step1-a_b_test.eml")
    assert got[2][1] == "Re: Hi" and got[2][5].startswith("0002-step2-")
    assert by(messages, "id", "label") == {1: "first", 2: "follow-up #1"}
    assert outreach.draft_rows(messages, "", "").first().reply_to is None


def test_log_and_status(spark):
    table, history, messages = rendered(spark)
    delivered = outreach.with_delivery(outreach.with_problems(messages, SENDER), True)
    delivered = delivered.withColumn(
        "delivery", F.when(F.col("id") == 2, "failed").otherwise(F.col("delivery")))
    new_leads, change = outreach.log_outreach(table, history, delivered, at())
    assert by(new_leads, "id", "status") == {1: "contacted", 2: "new"}
    assert by(new_leads, "id", "updated_at")[1] == NOW
    assert rows_of(change.table.select("id", "lead_id", "step", "delivery"), "id") == [
        (1, 2, 1, "sent"), (2, 1, 1, "sent"), (3, 2, 2, "failed")]
    assert by(outreach.outreach_funnel(delivered), "outcome", "n") == {
        "prepared": 2, "first_contact": 1, "followups": 0, "sent": 1, "drafted": 0, "failed": 1}


def test_incomplete_sender_may_draft_but_not_send(spark):
    bad = {**SENDER, "sender_postal_address": "", "unsubscribe_line": None}
    messages = outreach.with_problems(rendered(spark, bad)[2], bad)
    assert messages.first().problems == ["sender_postal_address", "unsubscribe_line"]
    assert {r.delivery for r in outreach.with_delivery(messages, False).collect()} == {"drafted"}
    with pytest.raises(Exception, match="sender settings missing"):
        outreach.with_delivery(messages, True).collect()


def inbox(spark, *rows):
    full = [(i, NOW, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        full, "msg_id bigint, received_at timestamp_ntz, sender string, subject string, body string")


def test_replies_by_mail_domain(spark):
    table = leads(spark, {}, {"status": "qualified"}, {}, {"replied_at": days(9), "status": "replied"})
    sent = log(spark, {"lead_id": 1, "to_email": "sales@acme.test"},
               {"lead_id": 1, "to_email": "info@www.acme.test"},
               {"lead_id": 2, "to_email": "x@bolt.test"},
               {"lead_id": 3, "to_email": "y@cog.test", "delivery": "failed"},
               {"lead_id": 4, "to_email": "z@acme.test"}, {"lead_id": 99, "to_email": "q@gone.test"})
    messages = inbox(spark, ("jane@acme.test", "hi", "hello"), ("bob@bolt.test", "", "Please unsubscribe me"),
                     ("w@cog.test", "", ""), ("v@gone.test", "", ""), ("jim@acme.test", "", "opt out"))
    contacted = replies.contacted_map(sent, table)
    assert sorted(rows_of(contacted)) == [("acme.test", 1), ("acme.test", 4), ("bolt.test", 2)]
    digest = replies.message_digest(messages)
    assert by(replies.reply_funnel(digest, contacted), "outcome", "n") == {
        "replies": 0, "opt_outs": 3, "unmatched": 2}
    assert by(replies.reply_funnel(digest, contacted, "first"), "outcome", "n") == {
        "replies": 2, "opt_outs": 1, "unmatched": 2}
    change = replies.apply_replies(table, sent, messages, at(), "first")
    got = by(change.table, "id", "status", "opted_out", "replied_at")
    assert got == {1: ("replied", False, NOW), 2: ("replied", True, NOW), 3: ("new", False, None),
                   4: ("replied", False, days(9))}
    again = replies.apply_replies(change.table, sent, messages, at(NOW + timedelta(1)), "first")
    assert sorted(rows_of(again.table), key=str) == sorted(rows_of(change.table), key=str)
    assert by(replies.apply_replies(table, sent, messages, at()).table, "id", "opted_out")[1] is True
    with pytest.raises(ValueError):
        replies.reply_updates(contacted, digest, "last")


def test_hot_mail_domain_stays_linear(spark):
    n = 3_000
    contacted = spark.range(n).select(F.lit("big.test").alias("mail_domain"), F.col("id").alias("lead_id"))
    messages = spark.range(n).select(
        F.col("id").alias("msg_id"), F.lit("a@big.test").alias("sender"), F.lit("").alias("subject"),
        F.when(F.col("id") == n - 1, "remove me").otherwise("").alias("body"))
    digest = replies.message_digest(messages)
    assert digest.count() == 1
    updates = replies.reply_updates(contacted, digest)
    assert updates.filter("opted_out AND first_msg_id = 0").count() == n


def test_recent_messages(spark):
    df = inbox(spark, ("A <a@x.test>", None, "x" * 3000), ("b@x.test", "s", None))
    df = df.withColumn("received_at", F.when(F.col("msg_id") == 1, at(datetime(2026, 7, 20))).otherwise(at()))
    got = recent_messages(df, at(), 30)
    assert [(r.sender, r.subject, len(r.body)) for r in got.collect()] == [("a@x.test", "", 2000)]
    assert recent_messages(df, at(), 31).count() == 2


def test_cycle_replies_before_planning(spark):
    table = leads(spark, {"email": "a@x.test"}, {"email": "b@y.test"})
    sent = log(spark, {"lead_id": 1, "to_email": "a@x.test", "created_at": days(5)},
               {"lead_id": 2, "to_email": "b@y.test", "created_at": days(5)})
    tick = outreach_cycle.run(
        table, sent, inbox(spark, ("z@x.test", "", "thanks")), at(), FIRST, AGAIN, SENDER)
    assert rows_of(tick.new_log_rows.select("id", "lead_id", "step")) == [(3, 2, 2)]
    assert by(tick.leads, "id", "status") == {1: "replied", 2: "contacted"}
    again = outreach_cycle.run(
        tick.leads, sent.unionByName(tick.new_log_rows), None, at(), FIRST, AGAIN, SENDER)
    assert again.new_log_rows.count() == 0


# --- roster and resolution --------------------------------------------------------------------


def roster_rows(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "ord bigint, name string, country string")


def map_rows(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "line_no bigint, name string, country string, domain string")


def test_roster_merge(spark):
    names = roster_rows(spark, ("Acme", "United States"), ("Bolt", "Canada"), ("Acme Two", "Canada"),
                        ("Nowhere", "Canada"), ("Known", "Canada"))
    known = map_rows(spark, ("Acme", "", "acme.test"), ("Bolt", "", "bolt.test"),
                     ("Acme Two", "", "acme.test"), ("Known", "", "known.test"))
    before = leads(spark, {"domain": "known.test", "source": "serper", "id": 3},
                   {"domain": "other.test", "id": 4})
    located = roster.located_roster(names, known)
    change = roster.merge_roster(before, located, at())
    assert by(change.outcomes, "name", "outcome") == {
        "Acme": "added", "Bolt": "added", "Acme Two": "updated", "Nowhere": "no_domain", "Known": "updated"}
    got = by(change.table, "domain", "id", "company_name", "source", "us_based")
    assert got == {"known.test": (3, "Lead 1", "serper+vendor_roster", False),
                   "other.test": (4, "Lead 2", "unknown", False),
                   "acme.test": (5, "Acme", "vendor_roster", True),
                   "bolt.test": (6, "Bolt", "vendor_roster", False)}
    assert by(change.table, "domain", "updated_at")["known.test"] == NOW
    again = roster.merge_roster(change.table, located, at(NOW + timedelta(1)))
    assert sorted(rows_of(again.table), key=str) == sorted(rows_of(change.table), key=str)
    assert by(funnels.roster_funnel(again.outcomes), "outcome", "n") == {
        "added": 0, "updated": 4, "no_domain": 1, "enriched": 0, "unreachable": 0}


def test_roster_parts(spark):
    names = roster_rows(spark, ("A", "Canada"), ("B", "canada"), ("C", "Latvia"), ("D", "CANADA"))
    assert [r.name for r in roster.roster_part(names, "CANADA", 2).orderBy("ord").collect()] == ["A", "B"]
    assert roster.roster_part(names).count() == 4
    known = map_rows(spark, ("A", "", "a.test"))
    assert sorted(r.name for r in roster.missing_names(names, known).collect()) == ["B", "C", "D"]


def test_domain_map_merge(spark):
    old = map_rows(spark, ("B", "x", "b.test"), ("A", "x", "a.test"))
    new = map_rows(spark, ("A", "y", "a2.test"), ("C", "z", "c.test"))
    assert rows_of(roster.merge_domain_map(old, new)) == [
        ("A", "y", "a2.test"), ("B", "x", "b.test"), ("C", "z", "c.test")]


def test_enrichment(spark):
    table = leads(spark, {"domain": "a.test", "phone": "1", "us_based": False, "manufactures": True},
                  {"domain": "b.test", "email": "has@b.test"}, {"domain": "c.test"}, {"domain": "d.test"})
    found = profile_rows(
        spark, {"domain": "a.test", "email": "e@a.test", "phone": "2", "state": "Texas", "us_based": True,
                "sells_direct": True, "company_type": "research_only"},
        {"domain": "b.test", "phone": "3"}, {"domain": "c.test", "n_pages": 0, "phone": "4"})
    got = by(roster.enrich_leads(table, found, at()), "domain",
             "email", "phone", "state", "us_based", "sells_direct", "manufactures")
    assert got["a.test"] == ("e@a.test", "1", "Texas", False, True, True)
    assert got["b.test"][1] is None and got["c.test"][1] is None and got["d.test"][1] is None
    names = roster_rows(spark, ("A", "x"), ("A2", "x"), ("B", "x"), ("C", "x"), ("D", "x"))
    known = map_rows(spark, *[(n, "", f"{n[0].lower()}.test") for n in ("A", "A2", "B", "C", "D")])
    out = roster.roster_outcomes(roster.located_roster(names, known), table, found)
    assert by(out, "name", "enrichment") == {
        "A": "enriched", "A2": None, "B": None, "C": "unreachable", "D": "unreachable"}


def lookups(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, position bigint, url string")


def test_official_domain(spark):
    name = "Blue Sky Peptide"
    good = lookups(spark, (name, 0, "https://reddit.com/r/x"), (name, 1, "https://www.trustpilot.com/x"),
                   (name, 2, "https://www.blueskypeptide.com/shop"), (name, 3, "https://blueskypeptide.com"),
                   ("Other", 0, "https://facebook.com/o"), ("Third", 0, "https://randomhealthblog.com/x"))
    got = rows_of(matching.official_domains(good))
    assert got == [(name, "blueskypeptide.com", 1.03)]
    names = roster_rows(spark, (name, "x"), ("Other", "x"), ("Third", "x"), ("Fourth", "x"))
    resolved = matching.resolve_names(names, good)
    assert rows_of(matching.resolution_totals(resolved)) == [(1, 3)]
    assert [r.name for r in matching.unresolved_sample(resolved, 2).collect()] == ["Other", "Third"]


def test_earlier_result_wins_ties(spark):
    tie = lookups(spark, ("Acme", 7, "https://acme.test"), ("Acme", 6, "https://acme.org"))
    assert matching.official_domains(tie).first().domain == "acme.org"


def test_roster_run(spark):
    names = roster_rows(spark, ("Acme", "United States"), ("Bolt Labs", "United States"))
    known = map_rows(spark, ("Acme", "United States", "acme.test"))
    run = roster_import.run(names, known, leads(spark), at(),
                            lookups(spark, ("Bolt Labs", 0, "https://boltlabs.test/")))
    assert rows_of(run.domain_map) == [
        ("Acme", "United States", "acme.test"), ("Bolt Labs", "United States", "boltlabs.test")]
    assert by(run.leads, "domain", "id", "us_based") == {"acme.test": (1, True), "boltlabs.test": (2, True)}
    assert by(run.funnel, "outcome", "n")["added"] == 2 and run.unresolved.count() == 0


# --- lead management --------------------------------------------------------------------------


def test_lists(spark):
    table = leads(spark, {"status": "contacted", "company_type": "research_only"},
                  {"status": "contacted", "created_at": None}, {"state": "", "created_at": datetime(2026, 5, 1)})
    assert [r.id for r in crm.list_leads(table).collect()] == [3, 1, 2]
    assert [r.id for r in crm.list_leads(table, "contacted").collect()] == [1, 2]
    assert [r.id for r in crm.list_leads(table, "contacted", "research_only").collect()] == [1]
    shown = by(crm.display_rows(table), "id", "email", "company_type", "state", "added")
    assert shown[1] == ("—", "research only", "—", "2026-01-01") and shown[2][3] == ""
    assert crm.lead_by_id(table, 9).count() == 0 and crm.lead_by_id(table, 2).count() == 1
    assert schemas.domain_violations(table).count() == 0


def test_history_and_delete(spark, monkeypatch):
    table = leads(spark, {}, {}, {})
    sent = log(spark, {"lead_id": 1, "created_at": days(2)}, {"lead_id": 2}, {"lead_id": 1, "created_at": days(1)})
    got = {(r.id, r.part): [h.id for h in r.history] for r in crm.lead_history(table, sent).collect()}
    assert got == {(1, 0): [1, 3], (2, 0): [2], (3, 0): []}
    monkeypatch.setattr(crm, "HISTORY_BITS", 1)
    got = {(r.id, r.part): [h.id for h in r.history] for r in crm.lead_history(table, sent).collect()}
    assert got == {(1, 0): [1, 3], (2, 0): [2], (3, 0): []}
    wide = log(spark, *[{"lead_id": 1 + (i == 4), "created_at": days(1)} for i in range(8)])
    wide = wide.withColumn("id", F.col("id") * (1 << 40))  # sparse ids give full pages
    got = {(r.id, r.part): [h.id >> 40 for h in r.history] for r in crm.lead_history(table, wide).collect()}
    assert got == {(1, 0): [1, 2], (1, 1): [3, 4], (1, 2): [6, 7], (1, 3): [8], (2, 0): [5], (3, 0): []}
    gone = spark.createDataFrame([(1,), (1,), (77,)], "lead_id bigint")
    left, log_left = crm.delete_leads(table, sent, gone)
    assert sorted(r.id for r in left.collect()) == [2, 3] and [r.id for r in log_left.collect()] == [2]


def test_edits(spark):
    table = leads(spark, {"company_type": "research_only"}, {"notes": "keep", "opted_out": True}, {},
                  {"status": "replied"})
    edits = spark.createDataFrame(
        [(1, 1, "replied", "", "n1", False), (2, 1, "qualified", None, None, True),
         (3, 2, None, "manufacturing_lab", None, False), (4, 99, "new", None, None, False),
         (5, 4, None, None, None, False)],
        "ord bigint, lead_id bigint, status string, company_type string, notes string, opted_out boolean")
    change = crm.apply_edits(table, edits, at())
    got = by(change.table, "id", "status", "company_type", "notes", "opted_out", "replied_at")
    assert got == {1: ("qualified", None, "n1", True, NOW), 2: ("new", "manufacturing_lab", "keep", False, None),
                   3: ("new", None, None, False, None), 4: ("replied", None, None, False, NOW)}
    later = crm.apply_edits(change.table, edits, at(NOW + timedelta(1)))
    assert by(later.table, "id", "replied_at")[1] == NOW and change.outcomes.count() == 4
    assert sorted(rows_of(later.table), key=str) == sorted(rows_of(change.table), key=str)


def test_history_has_one_shape_whatever_the_count(spark):
    table = leads(spark, {}, {})
    for n in (4_096, 4_097):
        sent = spark.range(10, 10 + n).selectExpr(
            "id", "1L AS lead_id", "'a@x.test' AS to_email", "'sent' AS delivery", "1 AS step",
            "CAST(NULL AS string) AS error", "CAST(NULL AS timestamp_ntz) AS created_at")
        got = {(r.id, r.part): len(r.history) for r in crm.lead_history(table, sent).collect()}
        rest = {(1, 1): n - 4_096} if n > 4_096 else {}  # pages are full, whatever the first id is
        assert got == {(1, 0): 4_096, (2, 0): 0, **rest}


def test_hosts_are_compared_only_where_it_can_matter(spark):
    """Bounds by letters drop hosts, equal slugs and repeated pairs cost no call, results stay."""
    rng = random.Random(4)
    words = ["acme", "peptide", "labs", "nova", "bio", "grand", "ridge", "xyz", "qq"]
    rows = []
    for i in range(60):
        name = " ".join(rng.sample(words, 2)).title()
        hosts = ["".join(rng.sample(words, rng.randint(1, 3))) for _ in range(5)] + [name.lower().replace(" ", ""), "0000"]
        rows += [(name, p, f"https://{h}.{rng.choice(['com', 'net', 'org'])}/x") for p, h in enumerate(hosts)]
    lookups = spark.createDataFrame(rows, "name string, position int, url string")
    scored = matching.scored_hosts(lookups).collect()

    def slug(x):
        return "".join(c for c in x.lower() if c.isascii() and c.isalnum())

    for r in scored:
        assert r.similarity == difflib.SequenceMatcher(None, slug(r.name), slug(r.host.split(".")[0])).ratio()
    best = {}
    for r in scored:
        if r.score > 0 and r.score >= matching.DEFAULT_RULES.match_threshold:
            best[r.name] = max(best.get(r.name, (0, 0, "")), (r.score, -r.position, r.host))
    got = {r.name: (r.score, r.domain) for r in matching.official_domains(lookups).collect()}
    assert got == {n: (b[0], b[2]) for n, b in best.items()} and len(got) > 20
    promising = matching.promising_hosts(lookups)
    calls = matching.pairs_to_compare(promising).count()
    uncertain = {(slug(r.name), slug(r.host.split(".")[0])) for r in scored if 0 < r.similarity < 1}
    assert promising.count() < len(scored) and calls < len(uncertain) < len(scored)


# --- receipts -------------------------------------------------------------------------------------

def receipt_frame(spark, *rows):
    """``(lead_id, step, delivery, error, minutes)``."""
    return spark.createDataFrame(
        [(i, n, d, e, NOW + timedelta(minutes=m)) for i, n, d, e, m in rows], schemas.RECEIPTS)


RECEIPTS = (
    (1, 1, "failed", "full", 1), (1, 1, "sent", None, 5), (1, 1, "sent", None, 3), (1, 1, "failed", "late", 9),
    (2, 1, "failed", "no host", 2), (2, 1, "failed", "still none", 4), (3, 2, "drafted", None, 1), (3, 2, "sent", None, 8),
    (4, 1, "bounced", "odd", 1), (9, 1, "sent", None, 0), (None, 1, "sent", None, 0), (5, None, "sent", None, 0))


def test_final_receipts_merge_in_any_order(spark):
    def final(rows):
        return rows_of(receipts.final_receipts(rows).withColumn("m", F.minute("delivered_at") - NOW.minute).select(
            "lead_id", "step", "delivery", "error", "m"), "lead_id")

    wanted = [(1, 1, "sent", None, 3), (2, 1, "failed", "still none", 4), (3, 2, "sent", None, 8),
              (4, 1, "failed", "odd", 1), (9, 1, "sent", None, 0)]
    whole = receipt_frame(spark, *RECEIPTS)
    assert final(whole) == wanted and final(whole.union(whole)) == wanted
    parts = receipts.final_receipts(receipt_frame(spark, *RECEIPTS[3:]))
    assert final(parts.union(receipts.final_receipts(receipt_frame(spark, *RECEIPTS[:5])))) == wanted
    assert final(whole.limit(0)) == []


def test_receipts_are_applied_once(spark):
    table = leads(spark, *[{"email": f"s@{i}.test"} for i in range(1, 6)])
    history = log(spark, {"lead_id": 3, "to_email": "s@3.test", "step": 1})
    planned = table.withColumn("step", F.when(F.col("id") == 3, 2).otherwise(1))
    messages = outreach.render_messages(planned, ("Hi", "a"), ("Re", "b"), {})
    done = receipts.apply_receipts(table, history, messages, receipt_frame(spark, *RECEIPTS), at())
    assert by(done.leads, "id", "status") == {1: "contacted", 2: "new", 3: "contacted", 4: "new", 5: "new"}
    rows = rows_of(done.log.filter("id > 1").select("id", "lead_id", "step", "delivery", "error", "subject"), "id")
    assert rows == [(2, 4, 1, "failed", "odd", "Hi"), (3, 1, 1, "sent", None, "Hi"), (4, 2, 1, "failed", "still none", "Hi"),
                    (5, 3, 2, "sent", None, "Re")]
    assert by(done.outcomes, "lead_id", "outcome") == {1: "logged", 2: "logged", 3: "logged", 4: "logged", 9: "unplanned"}
    again = receipts.apply_receipts(done.leads, done.log, messages, receipt_frame(spark, *RECEIPTS), at())
    assert rows_of(again.log, "id") == rows_of(done.log, "id") and rows_of(again.leads, "id") == rows_of(done.leads, "id")
    assert set(by(again.outcomes, "lead_id", "outcome").items()) == {(1, "known"), (2, "known"), (3, "known"), (4, "known"), (9, "unplanned")}
    retried = receipt_frame(spark, (2, 1, "sent", None, 30))
    last = receipts.apply_receipts(done.leads, done.log, messages, retried, at())
    assert by(last.leads, "id", "status")[2] == "contacted" and last.log.count() == done.log.count() + 1
    funnel = outreach.outreach_funnel(receipts.with_receipts(messages, receipt_frame(spark, *RECEIPTS)))
    assert by(funnel, "outcome", "n") == {"prepared": 4, "first_contact": 1, "followups": 1, "sent": 2, "drafted": 0, "failed": 2}


def test_lead_table_as_of_the_log(spark):
    table = leads(spark, {}, {"opted_out": True}, {"status": "qualified"}, {}, {"status": "disqualified"})
    later = NOW + timedelta(1)
    sent = log(spark, *[{"lead_id": i, "to_email": "x@y.test", "created_at": later} for i in (1, 2, 3, 5)],
               {"lead_id": 4, "to_email": "x@y.test", "delivery": "failed", "created_at": later})
    got = receipts.leads_as_logged(table, sent)
    assert by(got, "id", "status") == {1: "contacted", 2: "new", 3: "qualified", 4: "new", 5: "disqualified"}
    assert by(got, "id", "updated_at")[1] == later
    assert rows_of(receipts.leads_as_logged(got, sent), "id") == rows_of(got, "id")


def test_names_resolved_without_touching_leads(spark):
    names = spark.createDataFrame(
        [(1, "Acme Labs", "US"), (2, "Nova Bio", "us"), (3, "Grand Ridge", "DE"), (4, "No Match", "US")],
        "ord bigint, name string, country string")
    known = spark.createDataFrame(
        [(1, "Acme Labs", "US", "old.test"), (2, "Other", "US", "other.test")],
        "line_no bigint, name string, country string, domain string")
    lookups = spark.createDataFrame(
        [("Acme Labs", 0, "https://acmelabs.com/x"), ("Nova Bio", 0, "https://novabio.com"),
         ("Grand Ridge", 0, "https://grandridge.de"), ("No Match", 0, "https://zzz.test")],
        "name string, position int, url string")
    seeds = spark.createDataFrame([("https://novabio.com/",)], "url string")
    done = roster_import.resolve(names, known, lookups, seeds, country="us")
    assert by(done.domain_map, "name", "domain") == {"Acme Labs": "acmelabs.com", "Nova Bio": "novabio.com", "Other": "other.test"}
    assert [r.url for r in done.seed_additions.collect()] == ["https://acmelabs.com/"]
    assert tuple(done.totals.first()) == (2, 1, 1, 1)
    assert [tuple(r) for r in done.unresolved.collect()] == [(4, "No Match")]
