"""Quality classifier: a sparse ensemble of rules over text statistics.

A small random forest is grown on the statistics of labelled documents; every path from a root to a
node is a conjunctive rule. A lasso logistic regression over the rules keeps a few of them with
weights, and these are compiled into one Spark column expression, with which any table is scored
without Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import GAP

#: Labelled rows that a model is fitted on at most, the first by the hash of their ids.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.003


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)

    def share(pattern: str) -> Column:
        return F.when(chars > 0, F.regexp_count(t, F.lit(pattern)) / chars).otherwise(F.lit(0.0))

    words = F.filter(F.split(t, GAP), lambda w: w != "")
    lines = F.split(t, "\n")
    some = F.size(words) > 0
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_length": F.when(some, chars / F.size(words)).otherwise(F.lit(0.0)),
        "distinct_words": F.when(some, F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(0.0)),
        "distinct_lines": F.when(some, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0)),
        "line_length": F.log1p(chars / F.size(lines)),
        "upper": share(r"\p{Lu}"), "digits": share(r"\d"), "letters": share(r"\p{L}"),
        "symbols": share(r"[*#$%&@^~_+=<>{}\[\]\\/]"), "bangs": share(r"[!?]"), "bars": share(r"\|"),
    }


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above?, threshold) that all hold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.bounds:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1, over columns named like the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(forest: str, names: list[str]) -> list[Rule]:
    """The rules of all nodes of a printed forest, each once."""
    rules, open_nodes = {}, []
    for line in forest.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line)
        if m:
            depth = len(m[1])
            open_nodes = [x for x in open_nodes if x[0] < depth]
            open_nodes.append((depth, (names[int(m[2])], m[3] == ">", float(m[4]))))
            bounds: dict = {}
            for _, (name, above, at) in open_nodes:  # the tighter of two bounds on one side counts
                old = bounds.get((name, above))
                bounds[name, above] = at if old is None else max(at, old) if above else min(at, old)
            rules[Rule(tuple(sorted((n, a, v) for (n, a), v in bounds.items())))] = None
        elif "Tree" in line:
            open_nodes = []
    return list(rules)


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """A model from ``text, label`` (0 or 1). With no rows, or of one label only, its score is the
    share of label 1 (0.5 for no rows)."""
    stats = statistics(F.col("text"))
    rows = written(labelled.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in stats.items()]))
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.5)).alias("p")).first()
    if seen["n"] == 0 or seen["p"] in (0.0, 1.0):
        edge = {0.0: -10.0, 1.0: 10.0}.get(seen["p"], 0.0)
        return Model(edge, ())
    names = list(stats)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(vectors)
    rules = paths(forest.toDebugString, names)
    held = rows.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held)
    line = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=50).fit(vectors)
    kept = [(r, float(w)) for r, w in zip(rules, line.coefficients.toArray(), strict=True) if w != 0]
    return Model(float(line.intercept), tuple(kept))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of fitting: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """``text, label`` of at most ``limit`` labelled documents that are not held out."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))
    ).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(written(chosen)), "id").select("text", "label")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    Fitted on at most ``FIT_ROWS`` labelled rows that are not held out; only text statistics enter a
    score. Null and empty texts are scored like a text whose statistics are all 0; rows with a null
    id are not held out. Repeated rows are scored alike; other columns are not used.
    """
    model = fit(training_rows(docs, labels))
    stats = docs.select(
        F.col("doc_id").cast("bigint").alias("_doc_id"), *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return stats.select(
        F.col("_doc_id").alias("doc_id"), held_out(F.col("_doc_id")).alias("held_out"), model.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
