"""Quality rules, languages, decontamination and the pipeline."""

import random

import numpy as np
import pyarrow as pa
from corpora import SCHEMA, edited, messy, vocabulary, words_of

import corpus_pipeline
from prospectry.llm import decontaminate, fuzzy_lines, language, quality, shingles

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_quality_rules_rank_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_of_odd_texts_and_without_labels(spark):
    docs = spark.createDataFrame(messy(), SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.scored(docs, none).collect()
    assert len(got) == len(messy()) and {r["score"] for r in got} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], none.schema)
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(messy()) and all(0 <= r["score"] <= 1 for r in got)
    one = quality.scored(docs, labels.filter("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_rules_are_the_paths_of_a_forest():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= -1.5E-4)
      Predict: 0.0
     Else (feature 1 > -1.5E-4)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
     Else (feature 0 > 0.25)
      Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0"""
    got = {r.bounds for r in quality.paths(text, ["a", "b"])}
    assert got == {(("a", False, 0.5),), (("a", False, 0.5), ("b", False, -0.00015)), (("a", False, 0.5), ("b", True, -0.00015)),
                   (("a", True, 0.5),), (("a", False, 0.25),), (("a", False, 0.5), ("a", True, 0.25))}


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = language.predicted(docs, ["doc_id"]).join(docs.select("doc_id", "lang"), "doc_id").filter(
        "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame(messy(), SCHEMA)
    got = language.predicted(docs, docs.columns, ("guess", "sure")).collect()
    assert len(got) == len(messy())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["guess"] == "und") == (not letters) and r["line"] in ("l", None)
    nothing = docs.withColumn("lang", docs["lang"].substr(100, 1)).replace("", None, ["lang"])
    assert {r["guess"] for r in language.predicted(nothing, ["doc_id"], ("guess", "sure")).collect()} == {"und"}
    assert language.predicted(docs.limit(0), ["doc_id"]).count() == 0


def _distance(item, text):
    """Least edit distance of ``item`` to a part of ``text``, in words."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table(spark):
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(lo, 14))] for lo in (1, 0))
        edits, start, end = decontaminate.best_match(np.array(a), np.array(b, dtype=np.int64))
        assert edits == _distance(a, b) == (_distance(a, b[start:end]) if b else len(a))


def test_decontamination_equals_brute_force(spark):
    rng, words = random.Random(2), vocabulary(2)
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 4, 7, 11, 13, 20, 45, 70] * 3)]
    rows = messy(6, 40)
    for i in range(120):
        _, text = rng.choice(items)
        around = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(2)]
        share = rng.choice([0, 0.05, 0.1, 0.15])
        rows.append((500 + i, f"{around[0]} {edited(rng, words, text.upper() if i % 5 == 0 else text, share)} {around[1]}", *[None] * 10))
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id bigint, text string")
    wanted = set()
    for r in rows:
        own = words_of(r[1])
        wanted |= {(r[0], i) for i, t in items if own and _distance(words_of(t), own) <= int(decontaminate.EDITS * len(t.split()))}
    got = decontaminate.contaminations(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= wanted and len(found) >= 0.98 * len(wanted)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        item = words_of(dict(items)[r["item_id"]])
        if r["doc_id"] is not None:
            assert _distance(item, words_of(texts[r["doc_id"]][r["start"]:r["stop"]])) == r["edits"]
    bad = {d for d, _ in found}
    assert {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()} == {r[0] for r in rows} - bad
    assert decontaminate.contaminations(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def test_items_in_blocks_give_the_same_rows(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, decontaminate.contaminations(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 5)
    assert sorted(map(str, decontaminate.contaminations(docs, bench).collect())) == whole


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    rows = messy(8, 30)
    texts = pa.array([r[1] for r in rows], pa.string())
    whole, begin = shingles.text_shingles(texts)
    for chunk in (1, 37, 1000):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        some, at = shingles.text_shingles(texts)
        assert (some == whole).all() and (at == begin).all()


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(messy(7, 50), SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "mixture":
            assert out.columns == docs.columns
        docs = corpus_pipeline.written(out)
        kept[name] = docs.collect()
    ids = [r["doc_id"] for r in kept["language"]]
    assert 0 not in ids and 1 not in ids and 2 not in ids and 6 not in ids and 3 in ids
    lines = [x for r in kept["lines"] for x in r["text"].split("\n") if x.strip()]
    assert len(set(lines)) == len(lines) or len({r["doc_id"] for r in kept["lines"]}) < len(kept["lines"])
    assert len(kept["near_duplicates"]) <= len(kept["lines"])
    assert {r["doc_id"] for r in kept["mixture"]} <= {r["doc_id"] for r in kept["decontamination"]}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_pipeline_over_the_small_tables(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    texts = {r["text"] for r in rows if r["epoch"] == 0}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts)


def test_short_items_are_found_at_every_number_of_edits():
    rng, words = random.Random(31), vocabulary(31, 3000)
    cases = [(n, e) for n in (1, 4, 5, 6, 8, 9, 10, 12, 14, 15, 16, 19, 20, 23) for e in range(int(0.2 * n) + 1)]
    items, texts = [], []
    for n, e in [c for c in cases for _ in range(20)]:
        item = [rng.choice(words) for _ in range(n)]
        copy = list(item)
        for at in rng.sample(range(n), e):
            copy[at] = "x" + rng.choice(words)
        items.append(" ".join(item))
        texts.append(" ".join(["before", *copy, "after"]))
    index = decontaminate.Index(list(range(len(items))), items)
    own, _, counts = shingles.word_hashes(*shingles.buffers(pa.array(texts, pa.string())))
    found = {(r, i) for r, i, *_ in decontaminate._hits(index, own, counts)}
    assert not [cases[k // 20] for k in range(len(items)) if (k, k) not in found]


def test_texts_that_share_an_id_are_told_apart(spark):
    rng, words = random.Random(41), vocabulary(41, 3000)

    def line():
        return " ".join(rng.choice(words) for _ in range(30))

    a, b, c, d, e = (line() for _ in range(5))
    rows = [(1, a), (None, f"{b}\n{a}"), (None, f"{c}\n{d}"), (7, f"{a}\n{e}"), (7, line()), (None, line())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc"]["doc_id"], r["text"]) for r in fuzzy_lines.deduplicated(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [rows[0], (None, b), rows[2], (7, e), *rows[4:]]))
    # near copies of whole documents: only the copies go
    rows = [(1, a + " " + b), (None, a + " " + b + " end"), (None, c), (None, d), (None, d + " end"), (7, e), (7, a + " " + b), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted(map(str, [tuple(r) for r in corpus_pipeline.dedup_documents(spark, docs, SMALL).collect()]))
    fixed = sorted(map(str, [rows[0], rows[2], rows[5], rows[7]]))
    assert left in [sorted([*fixed, str(rows[k])]) for k in (3, 4)]


def test_letters_of_all_planes():
    for text in ("", None, "123 ... !", "\U0001f600\U0001f600", "12 34 \U0001f600", "\U0001d7d8", "\u2603"):
        assert language.features(text) is None
    for text in ("a", "\U00010400", "\U00020000 \U0001f600", "\u4e2d"):
        assert language.features(text) is not None
