"""Language identification in two steps: the family first, then the language within it.

Texts are bags of hashed letter n-grams (one to three, lower case, words apart). Families, and the
languages of a family, are separated by one-versus-one linear support vector machines. Each machine
is fitted in a task of its own on a bounded sample of documents of either side.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import at_most_per_key
from .quality import held_out
from .store import written

#: Families of common languages (fixed values); a language not listed is in a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "celtic": ("ga", "gd", "cy", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky"), "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"), "malayic": ("id", "ms"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Documents of a language that machines are fitted on at most, the first by the hash of their ids.
FIT_ROWS = 1_000
DIMENSIONS = 1 << 12
PIECE = 1 << 20  # characters worked on at a time
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def family_of(language: str) -> str:
    return _FAMILY.get(language, language)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of n-gram shares, of length 1; None for a text without letters."""
    if not text:
        return None
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(at - 2, 0):at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters[0][c]
        if not letter.any():
            continue
        c = np.where(letter, c, np.uint32(32))
        mask = np.uint32(DIMENSIONS - 1)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] >> np.uint32(3)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] >> np.uint32(5)) * np.uint32(0xC2B2AE35) + one[2:]
        for grams, used in ((one, letter), (two, letter[:-1] | letter[1:]), (three, letter[1:-1])):
            counts += np.bincount(((grams[used] >> np.uint32(17)) & mask).astype(np.int64), minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else None


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (and the bias, last) of a linear machine with hinge loss, by dual coordinate descent;
    ``y`` is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a, norms = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = np.clip(a[i] - (y[i] * x[i].dot(w) - 1) / norms[i], 0, c) - a[i]
            if step:
                w += step * y[i] * x[i]
                a[i] += step
    return w


def training_rows(docs: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """``text, lang`` of at most ``limit`` documents of each language that are not held out."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("id"), "lang").filter(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = at_most_per_key(known.withColumn("_h", F.xxhash64("id")), ["lang"], ["_h", "id"], F.lit(limit), limit)
    chosen = written(chosen.select("id", "lang").distinct())
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(
        F.broadcast(chosen) if chosen.count() < 1_000_000 else chosen, "id").select("text", "lang")


def fit(rows: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """Machines by pair of names: two families, or two languages of one family; and, with two equal
    names, each language that is known. Positive values speak for the first name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            keep = [f is not None for f in found]
            yield pd.DataFrame({"lang": batch["lang"][keep], "x": [f.tobytes() for f in found if f is not None]})

    sample = written(rows.mapInPandas(run, "lang string, x binary"))
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in languages})
    tasks = [(a, b, x, 1 if family_of(x) == a else -1) for a, b in itertools.combinations(families, 2)
             for x in languages if family_of(x) in (a, b)]
    tasks = [(f"family:{a}", f"family:{b}", x, s) for a, b, x, s in tasks]
    for family in families:
        own = [x for x in languages if family_of(x) == family]
        tasks += [(a, b, x, s) for a, b in itertools.combinations(own, 2) for x, s in ((a, 1), (b, -1))]
    machines = {(x, x): np.zeros(0) for x in languages}
    if not tasks:
        return machines

    def train(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "x"])
        x = np.stack([np.frombuffer(v, np.float32) for v in group["x"]])
        w = fit_machine(x, group["side"].to_numpy())
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [w.tobytes()]})

    plan = rows.sparkSession.createDataFrame(tasks, "a string, b string, lang string, side int")
    for r in sample.join(F.broadcast(plan), "lang").groupBy("a", "b").applyInPandas(
            train, "a string, b string, w binary").collect():  # one row of fixed size for each pair
        machines[r["a"], r["b"]] = np.frombuffer(r["w"], np.float64)
    return machines


class Judge:
    """Decides by votes of the machines, families first; a stable order breaks ties."""

    def __init__(self, machines: dict[tuple[str, str], np.ndarray]):
        self.languages = sorted(a for a, b in machines if a == b)
        self.machines = {k: v for k, v in machines.items() if len(v)}
        self.weights = np.stack(list(self.machines.values()), axis=1) if self.machines else None
        self.families = sorted({family_of(x) for x in self.languages})

    def _won(self, names: list[str], margins: dict, mark: str = "") -> tuple[str, float]:
        votes, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in itertools.combinations(names, 2):
            m = margins[mark + a, mark + b]
            for name, own in ((a, m), (b, -m)):
                votes[name] += 1 if own > 0 else 0
                least[name] = min(least[name], own)
        best = max(names, key=lambda n: (votes[n], least[n]))
        return best, least[best]

    def decide(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.languages:
            return UNDETERMINED, 0.0
        margins = {}
        if self.weights is not None:
            values = x @ self.weights[:-1] + self.weights[-1]
            margins = dict(zip(self.machines, values, strict=True))
        family, sure = self._won(self.families, margins, "family:")
        language, within = self._won([x for x in self.languages if family_of(x) == family], margins)
        return language, float(1 / (1 + np.exp(-2 * np.clip(min(sure, within), -15, 15))))


def predicted(docs: DataFrame, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of ``docs`` (``doc_id, text, lang``) with the predicted language and a
    score (0 to 1), under ``names``.

    Learned from the texts and non-null ``lang`` of at most ``FIT_ROWS`` documents a language that
    are not held out. ``und`` with score 0 for null texts, texts without letters, and where nothing
    could be learned. Repeated rows are judged alike. No rows, no result.
    """
    machines = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs)))
    text = "_text"
    while text in keep:
        text += "_"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))

    def run(batches):
        import pyarrow as pa

        judge = Judge(machines.value)
        for batch in batches:
            found = [judge.decide(t.as_py()) for t in batch.column(text)]
            yield pa.record_batch(
                [batch.column(c) for c in keep]
                + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, *names])

    schema = rows.drop(text).schema.add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(run, schema)
