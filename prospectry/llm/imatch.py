"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band; each of several subsets keeps
a random share of it. A document's fingerprint is one hash for each subset: of its distinct terms
in that subset, sorted. Two documents are alike to the degree that these hashes agree.

Only DataFrame functions. Terms are known by their 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Share of documents that hold a term: below, rare terms and slips; above, words of the language.
BAND = (0.001, 0.02)
#: (bits, subsets): so many disjoint subsets that each keep 2^-bits of the lexicon. Documents of any
#: length have some subsets of which they hold a term or two; those tell small edits apart.
SUBSETS = ((3, 4), (4, 6), (5, 8), (6, 8), (7, 8), (8, 8), (9, 6), (10, 4))
#: Lexicons up to so many terms are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
_ROW = 0  # stands for the row itself among its terms, so that rows without band terms stay


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case terms of a text; none for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``term``s whose share of the documents lies in ``band``, counted over all of them.

    A term is in ``band[0]`` of the documents at least, so there are at most (distinct terms of a
    document, on average) / ``band[0]`` of them, however large the corpus.
    """
    n = docs.count()
    found = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    return found.filter((F.col("count") >= n * band[0]) & (F.col("count") <= n * band[1])).select("term")


def subsets_of(term: Column, subsets=SUBSETS) -> Column:
    """Numbers of the subsets that keep a term. Each size reads bits of its own of the term's hash
    as the number of a subset among 2^bits, of which the first few are used."""
    numbers, at, base = [], 0, 0
    for bits, many in subsets:
        nth = F.shiftright(term, at).bitwiseAND(F.lit((1 << bits) - 1))
        numbers.append(F.when(nth < many, nth + base))
        at, base = at + bits, base + many
    return F.array_compact(F.array(*numbers))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty on both sides; between texts
    without any band term, 1 for the same terms and 0 otherwise."""
    both, seen = a.getField("marks"), b.getField("marks")
    used = F.size(F.array_union(F.transform(both, lambda m: F.shiftright(m, 32)),
                                F.transform(seen, lambda m: F.shiftright(m, 32))))
    return F.when(used > 0, F.size(F.array_intersect(both, seen)) / used).otherwise(
        (a.getField("all") == b.getField("all")).cast("double"))


def as_text(mark: Column) -> Column:
    """A fingerprint as text: subset and hash for each subset in hexadecimal, or the hash of all
    terms where no subset has any."""
    marks = mark.getField("marks")
    return F.when(F.size(marks) > 0, F.array_join(F.transform(marks, lambda m: F.lower(F.hex(m))), "."))\
        .otherwise(F.concat(F.lit("="), F.lower(F.hex(mark.getField("all")))))


def fingerprints(
    texts: DataFrame, names: list[str], words: DataFrame, subsets=SUBSETS,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """``texts`` with each string column of ``names`` replaced by its fingerprint: a struct of
    ``marks`` (for each subset that keeps a term of the text, its number and the hash of the sorted
    terms, as one integer; ascending) and ``all`` (hash of all its terms).

    ``texts`` should come hash-partitioned by its first column: its terms are then joined and
    gathered again for each row without another shuffle. ``words`` is a lexicon; it is broadcast
    only if a count shows it to be small.
    """
    key, small = texts.columns[0], words.count() < broadcast_terms
    words = words.union(words.sparkSession.range(1).select(F.lit(_ROW).cast("bigint")))
    words = F.broadcast(words) if small else words
    keep = [c for c in texts.columns if c not in names]
    lists = texts.select(
        key, F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_keep"),
        *[terms(F.col(c)).alias(c) for c in names])
    entries = F.concat(
        F.array(F.struct(F.lit(-1).alias("of"), F.lit(_ROW).cast("bigint").alias("term"))),
        *[F.expr(f"transform(`{c}`, t -> struct({i} AS of, t AS term))")
          for i, c in enumerate(names)])
    wholes = F.struct(*[F.xxhash64(F.sort_array(F.col(c))).alias(c) for c in names])
    rows = lists.select(
        key, "_row", F.struct("_keep", wholes.alias("all")).alias("_keep"),
        F.explode(entries).alias("_e")
    ).select(key, "_row", F.when(F.col("_e.of") < 0, F.col("_keep")).alias("_keep"),
             F.col("_e.of").alias("_of"), F.col("_e.term").alias("term"))
    sorted_out = rows.join(words, "term").select(
        key, "_row", "_keep", "_of", "term",
        F.explode(F.when(F.col("_of") < 0, F.array(F.lit(0).cast("bigint")))
                  .otherwise(subsets_of(F.col("term"), subsets))).alias("_subset"))
    hashed = sorted_out.groupBy(key, "_row", "_of", "_subset").agg(
        F.hash(F.sort_array(F.collect_list("term"))).alias("_hash"),
        F.first("_keep", ignorenulls=True).alias("_keep"))
    mark = F.shiftleft("_subset", 32) + F.col("_hash").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    gathered = hashed.groupBy(key, "_row").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        *[F.sort_array(F.collect_list(F.when(F.col("_of") == i, mark))).alias(f"_marks_{i}")
          for i in range(len(names))])
    return gathered.select(*[F.col("_keep._keep")[c].alias(c) for c in keep], *[
        F.struct(F.col(f"_marks_{i}").alias("marks"), F.col("_keep.all")[c].alias("all")).alias(c)
        for i, c in enumerate(names)])


def next_ids(ids: DataFrame) -> DataFrame:
    """``id, next_id``: the next id in descending order, after the smallest the largest.

    ``ids`` has distinct ``id``s. They are compared within blocks of 2^14 ids; a block's smallest
    id is followed by the largest of the next block that has any, found in the same way among
    blocks and groups of blocks, so that no window sees more than 2^26 rows whatever the ids are.
    """
    block, group = F.shiftright("id", 14), F.shiftright("id", 38)
    inside = Window.partitionBy("block").orderBy(F.col("id").desc())
    within = ids.select("id", block.alias("block")).select(
        "id", F.lead("id").over(inside).alias("next_id")).filter(F.col("next_id").isNotNull())
    blocks = ids.groupBy(block.alias("block"), group.alias("group")).agg(
        F.max("id").alias("top"), F.min("id").alias("low"))
    groups = blocks.groupBy("group").agg(F.max("top").alias("group_top"))
    down = Window.orderBy(F.col("group").desc())
    groups = groups.select(
        "group", F.lead("group_top").over(down).alias("after_group"),
        F.max("group_top").over(Window.partitionBy()).alias("largest"))
    after = F.lead("top").over(Window.partitionBy("group").orderBy(F.col("block").desc()))
    crossing = blocks.withColumn("after_block", after).join(groups, "group").select(
        F.col("low").alias("id"),
        F.coalesce("after_block", "after_group", "largest").alias("next_id"))
    return within.union(crossing)


def edited_fingerprints(docs: DataFrame, band=BAND, subsets=SUBSETS) -> DataFrame:
    """Each row of ``docs`` (``doc_id, text``; other columns are not used), fingerprinted as it is
    and with its last third replaced by the beginning of the next document: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document has the next smaller ``doc_id``, after the last the largest. A null id comes
    after all others (it stands where the smallest bigint would); of rows with one id, the smallest text is what precedes or replaces. Null
    texts count as empty; a text without terms has the fingerprint of the empty term list.
    No rows, no result.
    """
    lowest = F.lit(-(1 << 63)).cast("bigint")
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"))
    words = written(lexicon(base, band))
    sizes = base.groupBy("id").agg(F.max(F.floor(F.length("text") / 3)).alias("want"))
    links = written(next_ids(sizes.select("id")).join(sizes, "id"))
    heads = base.join(
        links.select(F.col("id").alias("to"), F.col("next_id").alias("id"), "want"), "id"
    ).select(F.col("to").alias("id"), F.substring(F.col("text"), F.lit(1), F.col("want").cast("int")).alias("head")
             ).groupBy("id").agg(F.min("head").alias("head"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third),
                      F.substring("head", F.lit(1), third))
    both = base.join(heads, "id").select(
        "id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "text", edited.alias("edited"))
    marks = written(fingerprints(both, ["text", "edited"], words, subsets))
    after = marks.groupBy(F.col("id").alias("next_id")).agg(F.min("text").alias("next_mark"))
    return marks.join(links.select("id", "next_id"), "id").join(after, "next_id").select(
        F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("text")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("next_mark")).alias("near_next"))
