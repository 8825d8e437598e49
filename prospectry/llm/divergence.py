"""How far the sources of a language are apart, and by which terms.

For each language a ``CountVectorizer`` with a document minimum and the largest vocabulary size turns
documents into sparse vectors of exact counts. The vectors' entries are summed within each source; the
sums stay sparse. Of two sources only the terms that one of them has are looked at: a term that a
source lacks has the source's least share, so the sums over all terms follow from

* what each source's own terms contribute against the other's least share, worked out once for each
  distinct count,
* a correction for the terms that both have, and
* the number of terms that neither has.

Terms are written down once, in a folder for each language. Vocabularies pass through the driver, as
``CountVectorizer`` does it; where a language keeps more terms than a bound, its terms are dealt into
slices by hash with a vectorizer each, so that no vocabulary exceeds it and none is cut.

All arithmetic is on integers: counts as ``bigint``, numerators as ``decimal(38, 0)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import buffers, slices
from .store import shared_dir, written

MIN_DOCUMENTS = 10
#: Kept terms of one vectorizer, about; more are dealt into slices.
SLICE_TERMS = 1_000_000
#: One in so many terms is counted beforehand to tell how many will be kept.
SAMPLED = 64
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Each byte of a term as it is counted, A-Z in lower case; a space for all others. Terms are letters
#: a-z and whatever is not ASCII, so the bytes of UTF-8 tell them apart.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: File parts that one summing task reads.
TASK_PARTS = 4
#: Sums of a task that are held at once.
CELLS = 8 << 20
_KEY = ["lang", "slice", "i"]
_COUNTS = "lang string, source string, slice int, i int, n bigint"
_TERMS = "lang string, slice int, i int, item string"


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, A-Z in lower case and all else as it is; none for null."""
    data, at = buffers(texts)
    first, last = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    folded, at = _FOLDED[data[first:last]], at - first
    inside = folded != 32
    edge = np.zeros(len(folded) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    kept = np.concatenate(([0], np.cumsum(inside)))  # terms lie side by side once the rest is taken out
    ends = np.concatenate((kept[starts], kept[-1:])).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(folded[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), strings)


def _term_table(docs: DataFrame) -> DataFrame:
    """``lang, source, terms, folder``: terms of all documents, written in a folder a language."""
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch(
                    [part.column("lang"), part.column("source"), terms_of(part.column("text"))], names=["lang", "source", "terms"])

    found = rows.mapInArrow(run, "lang string, source string, terms array<string>")
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    found.withColumn("folder", F.concat(F.lit("l"), F.md5("lang"))).write.partitionBy("folder").parquet(path)
    return spark.read.schema("lang string, source string, terms array<string>, folder string").parquet(path)


def _summed(vectors: DataFrame) -> DataFrame:
    """``source, i, n``: the entries of sparse vectors (``source, vector``) summed within tasks; a
    source has a row for each task at least that has some of its documents."""
    flat = vectors.select("source", F.col("vector.size").alias("size"), F.col("vector.indices").alias("i"),
                          F.col("vector.values").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for source, own in sums.items():
                places = np.flatnonzero(own)
                yield pa.record_batch(
                    [pa.array([source]).take(pa.array(np.zeros(len(places), np.int32))), pa.array(places.astype(np.int32)),
                     pa.array(own[places].astype(np.int64))], names=["source", "i", "n"])
            sums.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size")[0].as_py()
            named = batch.column("source").dictionary_encode()
            codes = np.repeat(named.indices.to_numpy(zero_copy_only=False), batch.column("i").value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(codes, kind="stable")
            places = batch.column("i").flatten().to_numpy(zero_copy_only=False)[order]
            counts = batch.column("n").flatten().to_numpy(zero_copy_only=False)[order]
            ends = np.cumsum(np.bincount(codes, minlength=len(named.dictionary)))
            for k, source in enumerate(named.dictionary.to_pylist()):
                begin = int(ends[k - 1]) if k else 0
                if begin == ends[k]:
                    continue
                if source not in sums and (len(sums) + 1) * size > CELLS and sums:
                    yield from out()
                own = sums.setdefault(source, np.zeros(size))
                own += np.bincount(places[begin:ends[k]], counts[begin:ends[k]], size)
        yield from out()

    return flat.mapInArrow(run, "source string, i int, n bigint")


def _languages(terms: DataFrame, slice_terms: int, min_documents: int, sampled: int) -> list[tuple[str, int]]:
    """Folder and number of slices of each language that can have a kept term.

    Kept terms are estimated by those of one in ``sampled`` hash values, all of whose occurrences
    count; junk words that occur once or twice, which grow with the table, do not.
    """
    each = terms.select("folder", F.explode("terms").alias("term")).filter(F.pmod(F.xxhash64("term"), F.lit(sampled)) == 0)
    often = each.groupBy("folder", "term").count().filter(F.col("count") >= min_documents)
    kept = often.groupBy("folder").agg((F.count("*") * sampled).alias("kept"))
    documents = terms.groupBy("folder").count().filter(F.col("count") >= min_documents)
    rows = documents.join(kept, "folder", "left").select("folder", F.coalesce("kept", F.lit(0)).alias("kept")).collect()
    return sorted((r["folder"], max(1, -(-r["kept"] // slice_terms))) for r in rows)


def counted(
    terms: DataFrame, slice_terms: int = SLICE_TERMS, min_documents: int = MIN_DOCUMENTS, sampled: int = SAMPLED,
) -> tuple[DataFrame, DataFrame]:
    """``lang, source, slice, i, n`` (``n > 0`` occurrences of a kept term in a source) and
    ``lang, slice, i, item`` (the kept terms). Starts jobs for each language."""
    spark = terms.sparkSession
    sums, vocabularies = [], []
    for folder, slices in _languages(terms, slice_terms, min_documents, sampled):
        rows = terms.filter(F.col("folder") == folder)
        lang = rows.select("lang").first()[0]
        for number in range(slices):
            own = rows if slices == 1 else rows.withColumn("terms", F.expr(
                f"filter(terms, t -> pmod(xxhash64(t), {slices}L) = {number}L)"))
            model = CountVectorizer(
                inputCol="terms", outputCol="vector", minDF=float(min_documents), vocabSize=(1 << 31) - 1).fit(own)
            path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
            model.save(path)
            listed = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "item"))
            vocabularies.append(listed.select(F.lit(lang).alias("lang"), F.lit(number).alias("slice"), "i", "item"))
            # more documents a task: a term that many of a source's documents have is one row of each task
            tasks = max(1, own.rdd.getNumPartitions() // TASK_PARTS)
            vectors = model.transform(own.coalesce(tasks)).select("source", F.unwrap_udt("vector").alias("vector"))
            sums.append(_summed(vectors).groupBy("source", "i").agg(F.sum("n").alias("n")).select(
                F.lit(lang).alias("lang"), "source", F.lit(number).alias("slice"), "i", "n"))
    if not sums:
        return spark.createDataFrame([], _COUNTS), spark.createDataFrame([], _TERMS)
    return written(reduce(DataFrame.union, sums)), written(reduce(DataFrame.union, vocabularies))


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * kept))``, exact; without kept terms 1 + 2 * SCALE."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("bigint")


def group_shares(terms: DataFrame, counts: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, source, kept, total, least, own`` for each group (least share; number of own terms) and
    the counts with each group's ``p`` and ``least``."""
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = terms.select("lang", "source").distinct().join(kept, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[_zero(c).alias(c) for c in ("kept", "total", "own")])
    groups = written(groups.withColumn("least", share(F.lit(0), F.col("total"), F.col("kept"))))
    rows = counts.join(groups.select("lang", "source", "kept", "total", "least"), ["lang", "source"])
    return groups, written(rows.select(*_KEY, "source", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "least"))


def pair_distances(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language."""
    a = groups.select("lang", "source", "kept", "own", "least")
    b = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("own_b"), F.col("least").alias("least_b"))
    pairs = a.join(b, "lang").filter(F.col("source") != F.col("item"))
    spread = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    one_sided = spread.join(b, "lang").filter(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * distance(F.col("p"), F.col("least_b"))).alias("one"))
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in _KEY] + [F.col("x.source") < F.col("y.source")])
    p, q, r, s = F.col("x.p"), F.col("y.p"), F.col("x.least"), F.col("y.least")
    both = both.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(
        F.sum(distance(p, q) - distance(p, s) - distance(q, r) + distance(r, s)).alias("both"))
    turned = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("other"))
    keys = ["lang", "source", "item"]
    both = both.union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    joined = pairs.join(one_sided, keys, "left").join(turned, keys, "left").join(both, keys, "left")
    neither = (F.col("kept") - F.col("own") - F.col("own_b")) * distance(F.col("least"), F.col("least_b"))
    value = neither + _zero("one") + _zero("other") + _zero("both")
    return joined.select(*keys, F.when(F.col("kept") == 0, F.lit(0)).otherwise(value).cast("bigint").alias("value"))


def marking_terms(groups: DataFrame, rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the terms whose share in a source is most above that in its
    language, as many as have one of the ten largest distances."""
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    whole = rows.groupBy(*_KEY).agg(F.sum("n").alias("n")).join(langs, "lang")
    whole = whole.select(*_KEY, share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    above = rows.join(whole, _KEY).filter("p > q").select(*_KEY, "source", distance(F.col("p"), F.col("q")).alias("value"))
    # names are joined to what can be among the first, ties included, which names will break
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))
    return above.withColumn("place", place).filter(F.col("place") <= TOP_TERMS).join(vocabulary, _KEY).select(
        "lang", "source", "item", "value")


def audited(
    docs: DataFrame, slice_terms: int = SLICE_TERMS, min_documents: int = MIN_DOCUMENTS, sampled: int = SAMPLED,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` over ``docs`` (``text, lang, source``): distances of
    each source to all others of its language (``pair``), and its ten most marking terms (``term``).

    Nulls count as empty strings. A source without terms, or in a language that keeps none, has its
    pairs (value 0 where none is kept) and no terms. Ties follow the item's bytes. Repeated rows are
    documents of their own; other columns are not used. No rows, no result.
    """
    terms = _term_table(docs)
    counts, vocabulary = counted(terms, slice_terms, min_documents, sampled)
    groups, rows = group_shares(terms, counts, vocabulary)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(found: DataFrame, part: str) -> DataFrame:
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    top = ranked(marking_terms(groups, rows, vocabulary), "term").filter(F.col("rank") <= TOP_TERMS)
    return ranked(pair_distances(groups, rows), "pair").union(top)
