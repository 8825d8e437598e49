"""Filter interactions and source divergence against brute force and against SQL."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pyarrow as pa
import pytest
from corpora import SCHEMA, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from prospectry.llm import divergence, filter_audit
from prospectry.llm.sql import SQL

LABELS = "doc_id bigint, quality int, toxic int, text string"


def audit_rows():
    """Documents for every filter: long and short, repetitive, capitals, signs, copies."""
    rng, rows = random.Random(3), messy()
    for i in range(120):
        n = rng.choice([1, 30, 199, 200, 260])
        words = [f"w{rng.randrange(rng.choice([3, 900]))}" for _ in range(n)]
        if i % 5 == 0:
            words = [w.upper() for w in words]
        if i % 7 == 0:
            words.insert(0, rng.choice("#$%&*|"))
        text = " ".join(words)
        rows += [(1000 + i, text, rng.choice(["en", "fr", None, ""]), *[None] * 9)]
        if i % 4 == 0:
            rows += [(2000 - i, text, "en", *[None] * 9)] * rng.randint(1, 3)
    rows += [(7, "seven", "en", *[None] * 9), (7, "other seven", "en", *[None] * 9), (8, "other seven", "xx", *[None] * 9)]
    return rows


def label_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "t") for i in range(0, 2100, 2)]
    return rows + [(1004, 1, 1, "t"), (None, 1, 1, "t")]


def fails(rows):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    out = []
    for r in rows:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r[0] is not None and least[t] < r[0]})
    return out


def brute_interactions(rows, labels):
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    found, shapley = {}, Counter()
    judged = [(r[2] or "", r[0], f) for r, f in zip(rows, fails(rows), strict=True)]
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [j for j in left if j[2][letter]]
                redundant = sum(j[2][letter] for j in gone)
                unique = sum(j[0] == part and j[2][letter] and sum(j[2].values()) == 1 for j in judged)
                left = [j for j in left if not j[2][letter]]
                gone += removed
                shapley[part, letter] += len(removed)
                found[part, "".join(order), step] = [
                    len(left), len(removed), redundant, unique, sum(j[1] in good for j in removed), sum(j[1] in toxic for j in removed)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("group_bytes", [filter_audit.GROUP_BYTES, 2000])
def test_interactions_by_brute_force(spark, group_bytes):
    rows, labels = audit_rows(), label_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = filter_audit.audited(docs, spark.createDataFrame(labels, LABELS), group_bytes)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == brute_interactions(rows, labels)


def test_interactions_in_sql(spark):
    rows, labels = audit_rows(), label_rows()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    documents, labels = docs.toArrow(), marks.toArrow()
    found = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op11_filter_audit']})").fetchall()
    assert documents.num_rows and labels.num_rows
    assert sorted(found) == sorted(map(tuple, filter_audit.audited(docs, marks).select(*COLUMNS).collect()))


def test_no_documents_and_no_labels(spark):
    docs, labels = spark.createDataFrame(audit_rows(), SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audited(docs.limit(0), labels).count() == 0
    got = filter_audit.audited(docs, labels).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(got) == (0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé", max_size=12), st.integers(-9, 9)), max_size=40))
def test_tries_hold_least_ids(rows):
    trie, wanted = filter_audit.RadixTrie(), {}
    for text, number in rows:
        trie.insert(text.encode(), number)
        wanted[text.encode()] = min(wanted.get(text.encode(), number), number)
    assert dict(trie.items()) == wanted and len(list(trie.items())) == len(wanted)


def test_tries_of_long_and_nested_texts():
    base = b"0123456789abcdef" * 6000
    texts = [base[:n] for n in (0, 1, 4095, 4096, 4097, 96_000)] + [base[:n] + b"!" for n in (7, 5000, 95_999)]
    trie = filter_audit.RadixTrie()
    for i, t in enumerate(texts * 2):
        trie.insert(t, i)
    assert dict(trie.items()) == {t: i for i, t in enumerate(texts)}


def test_prefixes_grow_where_many_texts_begin_alike(spark):
    head = "The same long beginning of very many texts. " * 3
    rows = [(i, head + f"{i:05d} " + "x" * 40) for i in range(400)] + [(1000 + i, f"{i} short") for i in range(50)]
    rows += [(2000 + i, "one text with many copies " * 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hot, total = filter_audit.hot_prefixes(docs, 20_000)
    assert total == sum(len(r[1]) + filter_audit.ROW_BYTES for r in rows)
    below = defaultdict(set)
    for _, t in rows:
        below[filter_audit.adaptive_prefix(t.encode(), hot)].add(t)
    assert max(sum(len(t) + filter_audit.ROW_BYTES for t in texts) for texts in below.values()) <= 20_000
    assert len(max(below, key=len)) > len(head)
    assert len(hot) < 20
    firsts = filter_audit.first_documents(docs, 20_000)
    assert sorted(r[0] for r in firsts.select("doc_id").collect()) == [*range(400), *range(1000, 1050), 2000]


def test_copies_leave_a_task_once(spark):
    docs = spark.createDataFrame([(i, "the same text") for i in range(5000)], "doc_id bigint, text string").coalesce(4)
    plan = filter_audit.first_documents(docs)
    assert [r[0] for r in plan.select("doc_id").collect()] == [0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("rangepartitioning") == 1 and "hashpartitioning" not in text


# --- source divergence ----------------------------------------------------------------------------

def source_rows():
    """Documents of languages with many, few and no kept terms; a null source, empty texts, long ones."""
    rng, rows = random.Random(8), []
    for lang, size in (("en", 90), ("dé", 30), (None, 25), ("few", 9), ("none", 12)):
        words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(40)] + ["Ünder", "É", "中文", "UPPER"]
        for i in range(size):
            own = rng.randrange(4)
            picked = [rng.choice(words[own * 8:]) for _ in range(rng.randint(0, 60))]
            text = " ".join(picked) if lang != "none" else f"only{chr(97 + i)}here"
            if i % 9 == 0:
                text = text.replace(" ", "-7_")
            rows.append((len(rows), text, lang, ["s1", "s2", None, "Sé"][own], *[None] * 8))
    rows += [(9000, None, "en", "empty", *[None] * 8), (9001, "", "dé", "", *[None] * 8), (9002, "alone here", "single", "x", *[None] * 8)]
    return rows + rows[5:8] + [(9003, "abx " * 20_000, "en", "s1", *[None] * 8)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_divergence(rows, least=10):
    found = []
    for lang in {r[2] or "" for r in rows}:
        docs = [(r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))) for r in rows if (r[2] or "") == lang]
        df = Counter(t for _, terms in docs for t in set(terms))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter() for s, _ in docs}
        for s, terms in docs:
            counts[s].update(t for t in terms if t in kept)

        def shares(counter, kept=kept):
            n = sum(counter.values()) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 2) // n for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, *x, i) for i, x in enumerate(items, 1) if part == "pair" or i <= 10]
    return sorted(found)


@pytest.mark.parametrize("slice_terms, sampled", [(divergence.SLICE_TERMS, divergence.SAMPLED), (15, 1)])
def test_divergence_by_brute_force(spark, slice_terms, sampled):
    rows = source_rows()
    got = divergence.audited(spark.createDataFrame(rows, SCHEMA).repartition(3), slice_terms, sampled=sampled)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    wanted = brute_divergence(rows)
    assert sorted(map(tuple, got.collect())) == wanted
    assert {r[0] for r in wanted if r[2] == "term"} == {"en", "dé", ""}


def test_divergence_in_sql(spark):
    rows = source_rows()
    documents = spark.createDataFrame(rows, SCHEMA).toArrow()
    found = duckdb.sql(f"SELECT lang, source, part, item, value, rank FROM ({SQL['op12_source_divergence']})").fetchall()
    assert documents.num_rows and sorted(found) == brute_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame(source_rows()[:4], SCHEMA)
    assert {r["value"] for r in divergence.audited(few).collect()} == {0}


def test_terms_of_all_scripts():
    texts = ["ABC abc Äpfel ÄPFEL straße", "plain ASCII Text", "naïve É ÀB", "Ⅷ ⓐⒶ ΑΣ İi", "a-b_c1d", "", None, "x" * 9000 + "É",
             "ends", "starts", "123", "中文 и \U0001f600\x00z"]
    wanted = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    column = pa.array(texts, pa.string())
    assert divergence.terms_of(column).to_pylist() == wanted
    assert divergence.terms_of(column.slice(3, 7)).to_pylist() == wanted[3:10]
    assert divergence.terms_of(column.slice(0, 0)).to_pylist() == [] and divergence.terms_of(column.slice(5, 2)).to_pylist() == [[], []]


def test_sums_do_not_depend_on_how_many_are_held(spark, monkeypatch):
    rows = [(f"s{i % 7}", "term " * (i % 5) + f"w{chr(97 + i % 3)}") for i in range(200)]
    docs = spark.createDataFrame([(t, "en", s) for s, t in rows], "text string, lang string, source string").repartition(3)
    wanted = brute_divergence([(i, t, "en", s) for i, (s, t) in enumerate(rows)])
    assert sorted(map(tuple, divergence.audited(docs).collect())) == wanted
    monkeypatch.setattr(divergence, "CELLS", 3)
    assert sorted(map(tuple, divergence.audited(docs).collect())) == wanted


def test_shares_of_very_large_counts(spark):
    n, total, kept = 10**15 + 7, 3 * 10**15, 10**9
    row = spark.createDataFrame([(n, total, kept)], "n bigint, t bigint, k bigint")
    got = row.select(divergence.share(row["n"], row["t"], row["k"])).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
