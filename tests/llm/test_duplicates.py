"""Lines, paragraphs and documents against brute force."""

import random

import numpy as np
import pyarrow as pa
from corpora import SCHEMA, edited, messy, prose, roots, shingles, similar, vocabulary, words_of

from prospectry.llm import components, fuzzy_lines, jaccard_join, paragraphs, store


def test_components_of_stars_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 300), (500, 400), (400, 500)]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = dict(components.components(df).collect())
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(50)}, 300: 300, 400: 400, 500: 400}
    assert components.components(df.limit(0)).count() == 0


def _line_shingles(line):
    return frozenset(line[i:i + 8] for i in range(max(len(line) - 7, 1)))


def test_fuzzy_lines_keep_one_line_of_each_group(spark):
    rows = messy(3, 80)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fuzzy_lines.deduplicated(docs).collect()
    assert len(got) == len(rows)
    ids = sorted({r[0] for r in rows if r[0] is not None}) + [None]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    lines, first = [], {}
    for doc in ids:
        for text in texts[doc] - {None}:
            for pos, line in enumerate(text.split("\n")):
                if line.strip(" \t\r\x0b\x0c"):
                    if line not in first:
                        first[line] = len(lines)
                        lines.append((line, []))
                    lines[first[line]][1].append((ids.index(doc), pos))
    sets = [_line_shingles(x) for x, _ in lines]
    root = roots(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if similar(sets[i], sets[j])])
    keeper = {}
    for k, (_, places) in enumerate(lines):
        keeper[root[k]] = min(keeper.get(root[k], (10 ** 9, 0)), min(places))
    missed = removed = 0
    for r in got:
        doc, text = r["doc"]["doc_id"], r["doc"]["text"]
        if text is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        kept = [x for pos, x in enumerate(text.split("\n"))
                if not x.strip(" \t\r\x0b\x0c") or keeper[root[first[x]]] == (ids.index(doc), pos)]
        own = r["text"].split("\n") if r["n_removed"] < r["n_lines"] else []
        assert r["n_removed"] == len(text.split("\n")) - len(own)
        missed += len(own) - len(kept)
        removed += r["n_removed"]
        assert set(kept) <= set(own), doc  # nothing goes that should stay
    assert missed <= 0.03 * removed
    assert fuzzy_lines.deduplicated(docs.limit(0)).count() == 0


def test_recall_of_line_bands_is_high(spark):
    rng, words = random.Random(5), vocabulary(5)
    pairs = []
    for i in range(300):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(12, 60)))
        other = edited(rng, words, base, 0.06)
        if similar(_line_shingles(base), _line_shingles(other)) and base != other:
            pairs.append((2 * i, base))
            pairs.append((2 * i + 1, other))
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string")
    got = sum(r["n_removed"] for r in fuzzy_lines.deduplicated(docs).collect())
    assert len(pairs) > 200 and got >= 0.97 * len(pairs) / 2


def test_components_of_documents_equal_brute_force(spark):
    rng, words = random.Random(9), vocabulary(9)
    base = prose(rng, words, 120)
    rows = messy(4, 90) + [(1000 + i, edited(rng, words, base, 0.03), *[None] * 10) for i in range(70)]
    passage = prose(rng, words, 60)
    rows += [(2000 + i, passage + " " + prose(rng, words, rng.randint(1, 45)), *[None] * 10) for i in range(60)]
    chain = prose(rng, words, 100)
    for i in range(20):  # neighbours are alike, the ends are not
        chain = edited(rng, words, chain, 0.02)
        rows.append((3000 + i, chain, *[None] * 10))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = [shingles(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    wanted = sorted(str((r[0], len(sets[i]), least.get(root[i]) if sets[i] else r[0])) for i, r in enumerate(rows))
    for small, pivots in ((32, 8), (2, 1)):  # the second way goes through pivots alone
        jaccard_join.SMALL_REGION, jaccard_join.PIVOTS = small, pivots
        got = jaccard_join.jaccard_components(docs).collect()
        assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == wanted
    jaccard_join.SMALL_REGION, jaccard_join.PIVOTS = 32, 8
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_repeated_paragraphs_and_pasted_passages(spark):
    rng, words = random.Random(11), vocabulary(11, 2000)

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, near = line(60), line(80)
    rows = [(1, line(30) + "\n" + near), (2, edited(rng, words, near, 0.02)), (3, line(20) + " " + passage + " " + line(15)),
            (4, passage.replace(" ", "\n", 26).replace("\n", " ", 25) + "\n" + line(50)), (5, line(100)), (6, None), (7, ""), (8, line(10)),
            (9, " É".join(["", *[line(1) for _ in range(70)]]))]
    rows.append((10, "ü " + rows[-1][1]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS doc", "2 AS start", "'k' AS kind", "3 AS key")
    texts = dict(rows)
    got = paragraphs.repeated(docs).collect()
    seen = {(r["kind"], r["doc_id"], r["kept_doc_id"]) for r in got}
    assert seen >= {("paragraph", 2, 1), ("passage", 4, 3), ("passage", 10, 9), ("paragraph", 10, 9)}
    assert {r["doc_id"] for r in got} | {r["kept_doc_id"] for r in got} == {1, 2, 3, 4, 9, 10}
    for r in got:
        if r["kind"] == "passage":
            copy = texts[r["doc_id"]][r["start"]:r["stop"]]
            assert len(words_of(copy)) == r["words"] >= 40
            assert words_of(texts[r["kept_doc_id"]][r["kept_start"]:])[:25] == words_of(copy)[:25]
    assert paragraphs.repeated(docs.limit(0)).count() == 0
    assert paragraphs.repeated(spark.createDataFrame(messy(2, 30), SCHEMA)).count() > 0


def line_roots(spark, lines):
    """Component of each of the (distinct) ``lines``."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = fuzzy_lines.lines_of(docs)
    members = fuzzy_lines.buckets(fuzzy_lines.signatures(found)).persist()
    texts = found.select("id", "line").distinct()
    groups = components.components(fuzzy_lines.links(members, lambda pairs: fuzzy_lines.verified(pairs, texts)))
    root = {r["node"]: r["root"] for r in groups.collect()}
    ids = {r["line"]: r["id"] for r in found.collect()}
    return [root.get(ids[x], ids[x]) for x in lines]


def test_edited_copies_are_joined_through_their_original(spark):
    rng, words = random.Random(21), vocabulary(21, 3000)
    stars = []
    for copies in (5, 20, 100):
        base = [rng.choice(words) for _ in range(30)]
        star = [" ".join(base)]
        while len(star) <= copies:
            copy = list(base)
            for at in rng.sample(range(30), 2):
                copy[at] = rng.choice(words)
            if similar(_line_shingles(star[0]), _line_shingles(" ".join(copy))):
                star.append(" ".join(copy))
        stars.append(star)
    root = line_roots(spark, [x for star in stars for x in star])
    at = 0
    for star in stars:
        own = root[at:at + len(star)]
        at += len(star)
        assert sum(r == own[0] for r in own[1:]) >= 0.9 * (len(star) - 1)


def test_no_link_is_lost_where_a_copy_leads(spark):
    rng = random.Random(22)
    sets = {"lead": set(range(100)), "mid": set(range(13, 113)), "far": set(range(26, 126))}
    for i in range(60):  # others of the bucket, alike to nothing
        sets[f"o{i}"] = {1000 + rng.randrange(10**6) for _ in range(100)}
    names = list(sets)
    sig = [0, 0, 0]
    # the leader meets more lines, in a second bucket
    rows = [("all", i, 100, sig) for i in range(len(names))] + [("two", i, 100, sig) for i in (0, 5)]
    members = spark.createDataFrame(rows, "key string, id bigint, n int, sig array<bigint>")

    def verify(pairs):
        rows = [(r["u"], r["v"]) for r in pairs.collect() if similar(sets[names[r["u"]]], sets[names[r["v"]]])]
        return spark.createDataFrame(rows, "u bigint, v bigint")

    root = {r["node"]: r["root"] for r in components.components(fuzzy_lines.links(members, verify)).collect()}
    assert root == {0: 0, 1: 0, 2: 0}


def test_few_pairs_of_a_crowd_are_verified(spark, monkeypatch):
    rng, words = random.Random(25), vocabulary(25, 3000)
    base = [rng.choice(words) for _ in range(60)]
    lines = [" ".join(base)]
    while len(lines) < 160:  # most are alike to the first line, hardly any to each other
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([3, 7])):
            copy[at] = rng.choice(words)
        lines.append(" ".join(copy))
    sets, asked, verified = [_line_shingles(x) for x in lines], [], fuzzy_lines.verified

    def counted(pairs, texts):
        asked.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(fuzzy_lines, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    root = roots(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if similar(sets[i], sets[j])])
    got = {r["doc"]["doc_id"]: r["n_removed"] for r in fuzzy_lines.deduplicated(docs).collect()}
    assert got == {i: int(root[i] != i) for i in range(len(lines))}
    assert 40 < len(set(root)) < 120 and sum(asked) < 1500, asked


def test_sketches_lose_no_similar_pair(spark):
    rng, words = random.Random(26), vocabulary(26, 3000)
    lines = ["a", "ab " * 40, "ü" * 30]
    for _ in range(40):
        base = " ".join(rng.choice(words) for _ in range(rng.choice([2, 10, 60, 400])))
        lines += [base, *[edited(rng, words, base, x) for x in (0.02, 0.03, 0.05, 0.1)]]
    sets = [_line_shingles(x) for x in lines]
    made = fuzzy_lines.sketches(spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")).persist()
    assert {r["id"]: r["k"] for r in made.collect()} == {i: len(x) for i, x in enumerate(sets)}
    pairs = made.crossJoin(made.toDF("id_v", "k_v", "odd_v")).filter(fuzzy_lines.possible())
    left = {(r["id"], r["id_v"]) for r in pairs.select("id", "id_v").collect()}
    every = [(i, j) for i in range(len(lines)) for j in range(len(lines))]
    assert left >= {(i, j) for i, j in every if similar(sets[i], sets[j])} and len(left) < 0.1 * len(every)


def test_lines_are_split_and_hashed_once(spark):
    lines = spark.createDataFrame([(1, "a b"), (2, "c d")], "id bigint, line string")
    pairs = spark.createDataFrame([(2, 1)], "u bigint, v bigint")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(fuzzy_lines.signatures(lines)).count("split(line") == 1
    assert plan(fuzzy_lines.verified(pairs, lines)).count("xxhash64(substring") == 2


def test_short_lines_with_one_changed_character_are_found(spark):
    rng, words = random.Random(23), vocabulary(23, 3000)
    pairs = {}
    for n in (3, 5, 8, 10, 12, 23, 24, 32):  # of 23 and 32 words the other has one word more
        while len(pairs.setdefault(n, [])) < 60:
            base = " ".join(rng.choice(words) for _ in range(n))
            other = base + " a" if n in (23, 32) else base[:-1] + "x"
            if base != other and similar(_line_shingles(base), _line_shingles(other)):
                pairs[n].append((base, other))
    root = line_roots(spark, [x for of in pairs.values() for pair in of for x in pair])
    found = {n: sum(root[2 * (60 * k + i)] == root[2 * (60 * k + i) + 1] for i in range(60)) for k, n in enumerate(pairs)}
    assert found[3] >= 48 and all(found[n] >= 57 for n in found if n > 3), found


def test_pasted_passages_with_changed_words_are_found(spark):
    rng, words = random.Random(24), vocabulary(24, 3000)

    def line(n):
        return [rng.choice(words) for _ in range(n)]

    rows, cases = [], [(n, e) for n, e in ((46, 0), (51, 0), (53, 0), (60, 1), (70, 1), (80, 2), (100, 2)) for _ in range(40)]
    for k, (n, e) in enumerate(cases):
        passage = line(n)
        copy = list(passage)
        for at in rng.sample(range(n), e):
            copy[at] = "x" + rng.choice(words)
        rows += [(k, " ".join(line(30) + passage + line(30))), (1000 + k, " ".join(line(17) + copy + line(40)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["kept_doc_id"]) for r in paragraphs.repeated(docs).collect() if r["kind"] == "passage"}
    assert got <= {(1000 + k, k) for k in range(len(cases))}
    share = {c: sum((1000 + k, k) in got for k, x in enumerate(cases) if x == c) / 40 for c in set(cases)}
    assert all(v == 1 for (n, e), v in share.items() if not e) and min(share.values()) >= 0.97, share


def test_short_paragraphs_are_reported(spark):
    rng, words = random.Random(25), vocabulary(25, 3000)
    shared = {n: " ".join(rng.choice(words) for _ in range(n)) for n in (4, 5, 12, 30, 39)}
    near = shared[39].rsplit(" ", 1)[0] + " other"
    rows = [(k, "\n".join([" ".join(rng.choice(words) for _ in range(9)), shared[n]])) for n in shared for k in (n, 100 + n)]
    rows.append((300, near))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    got = sorted((r["doc_id"], r["kept_doc_id"], texts[r["doc_id"]][r["start"]:r["stop"]])
                 for r in paragraphs.repeated(docs).collect() if r["kind"] == "paragraph")
    assert got == [*[(100 + n, n, shared[n]) for n in (5, 12, 30, 39)], (300, 39, near)]


def test_signatures_of_all_paragraphs_at_once_are_those_of_each(spark, monkeypatch):
    rng, words = random.Random(26), vocabulary(26, 50)
    texts = [r[1] for r in messy(12, 60)] + ["\n" + " ".join(["a b"] * 9) + "\n\nü é ß ö ä\n" + prose(rng, words, 50) + "\n", "x y z"]
    part = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc", "text"])
    wanted = []
    for doc, start, stop, own in paragraphs._paragraphs(part):
        data, at = paragraphs.buffers(part.column("text"))
        a, b = (len(bytes(data[int(at[doc]):x]).decode()) for x in (start, stop))
        least = [int((own ^ mask).min()) for mask in paragraphs._MASKS]
        wanted.append((doc, a, b, int(jaccard_join._class(own).view(np.int64)), len(own), bytes(x & 255 for x in least)))
    got = paragraphs._signed(part).to_pylist()
    assert [(r["doc"], r["start"], r["stop"], r["class"], r["n"], np.array(r["sig"]).tobytes()) for r in got] == wanted
    assert all(len(r["bands"]) == paragraphs.BANDS for r in got)
    assert paragraphs._signed(part.slice(0, 1)) is None


def test_signatures_do_not_stay_beside_the_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    found = paragraphs.repeated(spark.createDataFrame(messy(2, 30), SCHEMA))
    assert len(list(tmp_path.glob("llm-*"))) == 1, list(tmp_path.iterdir())  # the paragraphs reported
    assert found.count() > 0


def test_a_large_near_group_is_not_compared_with_itself(spark, monkeypatch):
    rng, words = random.Random(27), vocabulary(27, 4000)
    base = [rng.choice(words) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):  # about a half of them are alike to the original, hardly any to each other
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(2, 5)):
            copy[at] = "x" + rng.choice(words)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes, plain = [], jaccard_join.near_pairs

    def counted(pairs, sets, percent):
        sizes.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "near_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    sets = [shingles(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    assert [got[i] for i in range(len(rows))] == root
    assert sizes[-1] < len(rows) and sum(sizes) < 6 * len(rows), sizes
