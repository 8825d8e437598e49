"""From raw documents to a training order, stage by stage.

Each stage reads what the one before has kept: language identification drops documents of no
determined language, fuzzy line deduplication takes repeated lines out, the Jaccard join leaves one
document of each group of near duplicates, decontamination drops documents that hold a benchmark
item, and the curriculum puts the rest in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectry.llm import curriculum, decontaminate, fuzzy_lines, jaccard_join, language
from prospectry.llm.store import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in which no language can be told go (null texts, texts without
    letters); all others stay as they are."""
    columns, names = docs.columns, ("lang_pred", "lang_score")
    while set(names) & set(columns):
        names = tuple(f"{n}_" for n in names)
    judged = language.predicted(docs, columns, names)
    return judged.filter(F.col(names[0]) != language.UNDETERMINED).select(*[f"`{c}`" for c in columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without their repeated lines. Documents that lose their last line with
    text go; those that had none stay."""
    done = fuzzy_lines.deduplicated(docs)
    some = F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""
    kept = done.filter((F.col("n_removed") == 0) | some)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint"))
    return kept.select(*[
        F.col("text").alias(c) if c == "text"
        else F.coalesce(n_chars, F.col("doc.n_chars")).alias(c) if c == "n_chars"
        else F.col("doc")[c].alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near duplicates the document with the smallest id stays. Rows
    that repeat an id and its words are one document, other words under the id, or without one,
    are others; documents without words all stay."""
    found, other, own = written(jaccard_join.jaccard_components(docs)), "gone_id", "own_class"
    while other in docs.columns or own in docs.columns:
        other, own = other + "_", own + "_"
    sets = written(found.filter("n_shingles > 0").select("doc_id", "class", "root").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "class")).alias("first")
    gone = written(sets.join(written(sets.groupBy("root").agg(first)), "root").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("class") == F.col("first.class")))
    ).select(F.col("doc_id").alias(other), F.col("class").alias(f"{own}_gone")))
    many = written(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(other)))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(other))
    kept = docs.join(gone.select(other).union(many).distinct(), same, "left_anti")
    if many.isEmpty():
        return kept
    # where rows share an id, or have none, the words tell them apart
    rows = jaccard_join.with_class(docs.join(many, same, "left_semi"), own)
    rows = written(rows.join(gone, same & (F.col(own) == F.col(f"{own}_gone")), "left_anti"))
    once = rows.filter(F.col(own) != 0).dropDuplicates(["doc_id", own])
    return kept.union(rows.filter(F.col(own) == 0).drop(own)).union(once.drop(own))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold an item of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every pass over a document in training order, with the words taken of it."""
    plan = curriculum.curriculum(docs)
    return curriculum.training_order(plan).select("doc.*", "epoch", "words", "position")


STAGES = [
    ("language", identify),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixture", mix),
]

#: Trained machines, MinHash and random walks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
