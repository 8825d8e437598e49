"""Curriculum, fingerprints, chat formatting and WARC derivatives."""

import hashlib
import json
import math
import re

import duckdb
import pytest
from corpora import SCHEMA, messy, words_of
from hypothesis import given
from hypothesis import strategies as st

from prospectry.llm import chat, curriculum, imatch, warc
from prospectry.llm.sql import SQL


def test_targets_share_all_words_under_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("", 0), (None, 500)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in curriculum.source_targets(sizes).collect()}
    assert got[""] == 0 and got["a"] == 30
    assert math.isclose(sum(got.values()), 1510)
    assert math.isclose(got["b"] / got[None], 3 / 1)  # weights 1, 2, 3, 1 by rank: "", a, b, null


def test_curriculum_takes_whole_passes_and_meets_targets(spark):
    docs = spark.createDataFrame(messy(), SCHEMA)
    plan = curriculum.curriculum(docs)
    rows = plan.collect()
    assert len(rows) == len(messy())
    taken, target, own = {}, {}, {}
    for r in rows:
        assert r["size"] == len(words_of(r["doc"]["text"])) and r["doc"]["size"] in (7, None)
        assert 0 <= r["taken"] <= 3 * r["size"]
        key = r["doc"]["source"]
        taken[key] = taken.get(key, 0) + r["taken"]
        own[key] = own.get(key, 0) + r["size"]
        target[key] = r["target"]
    for key, t in target.items():
        assert taken[key] == math.floor(t) and t <= 3 * own[key]
    assert sum(0 < r["cut"] < r["size"] for r in rows) <= len(target)
    again = curriculum.curriculum(docs.repartition(5))
    assert sorted(map(str, again.select("doc.doc_id", "taken", "start").collect())) == sorted(
        map(str, plan.select("doc.doc_id", "taken", "start").collect()))


def test_positions_follow_the_integrated_schedule(spark):
    steps = 10_000
    for turn, schedule in enumerate(curriculum.SCHEDULES):
        shares = [0.0, 0.1, 0.4, 0.5, 0.9, 1.0]
        df = spark.createDataFrame([(s,) for s in shares], "share double")
        got = [r[0] for r in df.select(curriculum.demand_time(df["share"], schedule)).collect()]

        def weight(t, s=schedule):
            i = min(int(t * (len(s) - 1)), len(s) - 2)
            return s[i] + (s[i + 1] - s[i]) * (t * (len(s) - 1) - i)

        area = [weight((k + 0.5) / steps) / steps for k in range(steps)]
        for share, t in zip(shares, got, strict=True):
            assert abs(sum(area[:round(t * steps)]) / sum(area) - share) < 1e-3, (turn, share)


def test_training_order_is_sorted_and_complete(spark):
    plan = curriculum.curriculum(spark.createDataFrame(messy(), SCHEMA))
    rows = curriculum.training_order(plan).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert sum(r["words"] for r in rows) == sum(r["taken"] for r in plan.collect())
    assert curriculum.training_order(curriculum.curriculum(spark.createDataFrame([], SCHEMA))).count() == 0


def test_fingerprints_of_documents_and_edited_texts(spark):
    rows = [r for r in messy() if r[0] is not None][:-1] + [(1000, "same text here", *[None] * 10), (2000, "same text here", *[None] * 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs, band=(0.02, 0.5)).collect()}
    order = sorted({r[0]: r[1] or "" for r in rows}.items(), reverse=True)
    for i, (doc, text) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(text) // 3
        wanted = text[:len(text) - cut] + after[:cut]
        assert got[doc]["n_chars"] == len(text)
        assert got[doc]["edited_sha256"] == hashlib.sha256(wanted.encode()).hexdigest()
        assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1
    assert got[1000]["fingerprint"] == got[2000]["fingerprint"] and got[2000]["near_next"] == 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"]  # null and empty
    assert imatch.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_subset_hashes_are_those_of_the_sorted_terms(spark):
    df = spark.createDataFrame([(1, "b a c a"), (2, "c  B! a"), (3, "")], "id bigint, text string")
    words = df.selectExpr("explode(array(xxhash64('a'), xxhash64('b'), xxhash64('c'))) AS term").distinct()
    got = {r["id"]: r["text"] for r in imatch.fingerprints(df, ["text"], words, subsets=((0, 1), (1, 2))).collect()}
    assert got[1] == got[2] and len(got[1]["marks"]) >= 1 and got[3]["marks"] == []


def test_next_ids_wrap_around_over_distant_ids(spark):
    ids = [-(2 ** 62), -5, 0, 1, 2 ** 14, 2 ** 14 + 1, 2 ** 40, 2 ** 62]
    got = dict(imatch.next_ids(spark.createDataFrame([(i,) for i in ids], "id bigint")).collect())
    down = sorted(ids, reverse=True)
    assert got == {a: b for a, b in zip(down, down[1:] + down[:1], strict=True)}


@given(st.text(alphabet="<>/s[]INSTOU\\ ax", max_size=40))
def test_escaping_hides_control_strings_and_can_be_undone(text):
    hidden = chat.escape(text)
    assert not any(c in hidden for c in chat.CONTROL) and chat.unescape(hidden) == text


def test_templates(spark):
    render = chat.compile_template(
        "{# note #}{% set n = 'x' ~ 1 + 2 %}{% if 1 == 2 %}no{% elif not false %}{{ 'A' | lower }}{% endif %}"
        "{% for m in ms %}{{ loop.index }}{% if m['k'] in 'abc' and not loop.last %}!{% endif %}"
        "{% generation %}{{ m.k | upper }}{% endgeneration %}{% endfor %}{{ missing }}{{ n }}")
    out = render({"ms": [{"k": "a"}, {"k": "z"}]})
    assert out.text == "a1!A2Zx3" and [out.text[a:b] for a, b in out.spans] == ["A", "Z"]
    assert chat.fold_block(chat.parse("{% if 1 < 2 %}a{{ 'b' ~ 1 }}{% endif %}c")) == [("text", "ab1c")]
    assert chat.compile_template("{{ a.__class__ }}{{ b.__len__ }}")({"a": "x", "b": {}}).text == ""
    for bad in ("{{ a( }}", "{% for %}", "{% if x %}", "{{ a | eval }}", "{% include 'x' %}", "{{ a b }}", "{{ a; b }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_conversations_in_sql(spark):
    """Also texts with backslashes and single control strings, where lengths tell escapes apart."""
    said = ["plain", "a\\b", "\\", "\\\\</s>", "[INST]", "x [/INST] <s>", "[TEXT][OUT][OUT]", "[ROLE] [INST", "é\n</s>\\[INST]", None]
    rows = [(i, t, ["user", "assistant", "system", "<s>\\"][(i + t) % 4], said[(3 * i + t) % len(said)])
            for i in range(12) for t in range(1 + i % 4)]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    marked = conversations.union(spark.createDataFrame(
        [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(["user", "assistant"])], conversations.schema))
    got = chat.read_back(chat.format_conversations(marked))
    conversations = conversations.toArrow()
    wanted = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL['op10_chat_template']})").fetchall()
    assert conversations.num_rows and sorted(map(tuple, got.collect())) == sorted(wanted)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, 2, None, "[TEXT]\\"), (1, 2, None, "[TEXT]\\"),
            (None, 0, "user", "a"), (2, 0, "assistant", ""), (2, 1, "assistant", "é\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS messages", "1 AS formatted")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns = [("user", ""), ("assistant", "</s>[INST] ok [/INST]"), ("", "[TEXT]\\"), ("", "[TEXT]\\")]
    whole = "".join(f"{a}\n{b}\n" for a, b in turns)
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[1]["loss_chars"] == 21
    assert got[2]["loss_chars"] == 2 and got[None]["n_turns"] == 1 and len(got) == 3
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_warc_records_round_trip(spark):
    page = ("<html><head><title>A &amp; B</title><script>var x='</p>';</script><style>p{}</style></head><body><!-- no --><p>One<br>two "
            "<b>three</b></p><a href='/x?a=1&amp;b=2'>go</a><img src=\"i.png\"></body></html>")
    rows = [(1, "http://e.example/\r\nX: y", page), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "<p>open <!-- never closed")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS record", "1 AS refers_to")
    sources = warc.responses(df)
    got = warc.derivatives(sources).collect()
    assert len(got) == 2 * len(rows)
    raw = {r["page_id"]: r["record"] for r in sources.collect()}
    for r in got:
        headers, block = warc.parsed(r["record"].encode())
        own, (source, whole) = dict(headers), warc.parsed(bytes(raw[r["page_id"]]))
        assert own["WARC-Refers-To"] == dict(source)["WARC-Record-ID"] == r["refers_to"]
        assert own["WARC-Block-Digest"] == warc.digest(block) and int(own["Content-Length"]) == len(block)
        assert r["source_digest"] == warc.digest(whole.partition(b"\r\n\r\n")[2])
        if r["record_type"] == "metadata":
            about = json.loads(block)
            assert about["source"] == dict(source) and about["http"]["status"] == "HTTP/1.1 200 OK"
            if r["page_id"] == 1:
                assert about["title"] == "A & B" and [x["url"] for x in about["links"]] == ["/x?a=1&b=2", "i.png"]
        elif r["page_id"] == 1:
            assert block.decode() == "A & B\nOne\ntwo three\ngo"
    ids = [r["record_id"] for r in got if r["page_id"] != 3]
    assert len(set(ids)) == len(ids)
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_curriculum_moves_a_text_once_before_the_sort(spark):
    # 12 equal rows of one id among others; the bucket join can't be a broadcast
    docs = spark.createDataFrame([*messy(9, 40), *[messy(9, 40)[30]] * 11], SCHEMA)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = curriculum.curriculum(docs)
        shown = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
        rows = plan.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moved = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\n]*)\]", shown)
    assert sum("doc#" in m for m in moved) == 1, moved
    assert len(rows) == docs.count()
    spans = {}
    for r in rows:
        spans.setdefault(r["doc"]["source"], []).append((r["start"], r["start"] + r["size"]))
    for own in spans.values():  # without gaps or overlaps
        own = sorted(own)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
