"""Small corpora with the odd cases: nulls, empty texts, copies, repeated rows, clashing columns."""

import random
import re

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, doc string,"
          " hits string, class string, line string, _id string, score double")


def vocabulary(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    out = [rng.choice(words) for _ in range(n)]
    for i in range(9, n, 11):
        out[i] += "\n" if i % 3 == 0 else "."
    return " ".join(out)


def edited(rng, words, text, share):
    w = text.split(" ")
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


def messy(seed=1, n=60):
    """Rows with ids from 0, some null, repeated rows, exact and near copies, odd texts."""
    rng, words = random.Random(seed), vocabulary(seed)
    texts = [None, "", "  \n\t ", "one", "one", "Two words", "... --- 123", "x" * 5000, "é" * 300 + " ü", "\n\n"]
    for _ in range(n):
        texts.append(prose(rng, words, rng.randint(3, 160)))
    for _ in range(n // 2):
        base = rng.choice(texts[10:])
        texts.append(edited(rng, words, base, rng.choice([0, 0.02, 0.05, 0.1, 0.3])))
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None, ""]),
                     len(t or ""), 7, "d", "h", "c", "l", "i", 0.5))
    rows.append(rows[20])
    rows.append((None, rows[21][1], None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None))
    return rows


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def shingles(text, k=5):
    w = words_of(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def similar(a, b, percent=75):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)
