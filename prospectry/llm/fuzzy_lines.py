"""Fuzzy line deduplication by MinHash.

Lines are sets of character shingles (eight code points; a shorter line is one shingle). A signature
of 24 minima, in 8 bands of 3, finds lines that may be alike; pairs that collide are verified by the
exact Jaccard similarity of all their shingles; connected components of the verified pairs keep one
line, the first of the corpus by ``(doc_id, position)``. A document is an id and a text: rows that
share an id, or have none, but hold other texts are other documents.

Minima are taken over the shingles that begin a word (after a space), a sixth of all, which have the
same similarity on average; lines of few words or few spaces use all shingles. Lines in between, up to a
third more words than that, have both kinds of signature, so that similar lines meet in one of them.
Minimum number m is the hash that is least after an exclusive or with a mask of its own.

Only DataFrame functions. Lines are known by 64-bit hashes; equal lines are one line from the start,
so a line that a third of all documents share is one row in all but the last step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import scratch, written

SHINGLE = 8
SIMILAR = 75  # percent
BANDS, ROWS = 8, 3
#: Tables of keys up to so many rows are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Lines with fewer words, or fewer words for their characters, have too few shingles that begin one.
FEW_WORDS, LONG_WORDS = 24, 24
SMALL_BUCKET, LEADERS = 32, 8
AGREEING = 10  # of the 24 minima
WORDS = 16  # of 64 cells each in a sketch
_LAST = (1 << 63) - 1


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc, tag`` (hash of the text), ``pos, line, id`` of all lines that are not blank; a null id is
    the largest."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc")
    blank = F.btrim(F.col("line"), F.lit(" \t\r\x0b\x0c")) == ""
    # the tag first, else each line would work it out again
    return docs.select(doc, "text", F.xxhash64("text").alias("tag")).select(
        "doc", "tag", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(~blank).withColumn("id", F.xxhash64("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """``id, copies, n`` (code points), ``bands`` (keys) and ``sig`` (the last byte of
    each minimum, eight in one integer) of each distinct line, for each kind of signature that it
    has; ``main`` marks one row of each line."""
    # exploded, so that a line is split once, not in each place that names its words
    units = lines.select("id", "line", F.length("line").alias("n"), F.explode(F.array(F.split("line", " "))).alias("w"))
    size, n = F.size("w"), F.col("n")
    begun = (size >= FEW_WORDS) & (size * LONG_WORDS >= n)
    every = ~begun | (size * 3 <= FEW_WORDS * 4) | (size * LONG_WORDS * 3 <= n * 4)
    units = units.select("id", "n", "w", F.when(every, F.encode("line", "UTF-32")).alias("raw"), begun.alias("begun"),
                         F.explode(F.array(F.lit(True), F.lit(False))).alias("few"))
    units = units.filter(F.when(F.col("few"), F.col("raw").isNotNull()).otherwise(F.col("begun"))).withColumn(
        "main", F.col("few") | F.col("raw").isNull()).withColumn(
        "m", F.when(F.col("few"), F.greatest(n - (SHINGLE - 1), F.lit(1))).otherwise(size))
    places = units.select("*", F.expr("explode(sequence(0, m - 1)) AS i"))
    hashed = places.select("id", "n", "few", "main", "i", F.expr(
        f"if(few, hash(substring(raw, 4 * i + 1, {4 * SHINGLE})),"
        f" hash(left(concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)), {SHINGLE})))").alias("h"))
    # the masks of one band lie far apart, so that even a short line gives it different shingles
    masks = [((r * BANDS + b) << 27) - (1 << 31) for b in range(BANDS) for r in range(ROWS)]
    minima = hashed.groupBy("id", "few", "main").agg(
        F.count_if(F.col("i") == 0).alias("copies"), F.max("n").alias("n"),
        *[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(masks)])
    bands = [F.xxhash64(F.lit(b), "few", *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    sig = F.array(*[reduce(Column.bitwiseOR, [
        F.shiftleft(F.col(f"m{at + i}").bitwiseAND(F.lit(255)).cast("bigint"), 8 * i) for i in range(8)])
        for at in range(0, BANDS * ROWS, 8)])
    return minima.select("id", "main", "copies", "n", F.array(*bands).alias("bands"), sig.alias("sig"))


def probable(mine: str, other: str) -> Column:
    """Whether enough minima agree by their last bytes. Of two lines at the least similarity fewer do
    once in some hundred pairs; of unlike lines that share a band hardly any do."""
    bytes_ = [F.shiftright(F.expr(f"`{mine}`[{k}] ^ `{other}`[{k}]"), 8 * i).bitwiseAND(F.lit(255)) == 0
              for k in range(BANDS * ROWS // 8) for i in range(8)]
    return reduce(lambda a, b: a + b, [b.cast("int") for b in bytes_]) >= AGREEING


def buckets(lines: DataFrame) -> DataFrame:
    """``key, id, n, sig`` of the bands that several distinct lines share."""
    keys = lines.select(F.explode("bands").alias("key"), "id", "n", "sig")
    # a line has each of its keys once
    several = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    return keys.join(_bounded(written(several.select("key"))), "key", "left_semi")


def _shingle_hashes(line: str) -> Column:
    count = f"greatest(length(`{line}`) - {SHINGLE - 1}, 1)"
    return F.expr(f"transform(array(encode(`{line}`, 'UTF-32')), _raw -> transform("
                  f"sequence(1, 4 * {count} - 3, 4), _i -> xxhash64(substring(_raw, _i, {4 * SHINGLE}))))[0]")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (``u, v``) whose lines have a Jaccard similarity of 0.75 or more."""
    sides = pairs.join(texts.select(F.col("id").alias("u"), F.col("line").alias("a")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("line").alias("b")), "v")
    # exploded, so that the hashes of a pair are worked out once, not in each place that names them
    both = F.explode(F.array(F.struct(_shingle_hashes("a").alias("a"), _shingle_hashes("b").alias("b")))).alias("both")
    return sides.select("u", "v", both).filter(
        F.expr(f"size(array_intersect(both.a, both.b)) * 100 >= size(array_union(both.a, both.b)) * {SIMILAR}")
    ).select("u", "v")


def sketches(texts: DataFrame) -> DataFrame:
    """``id, k`` (number of shingles) and ``odd`` of each line: for each of 1,024 cells of hashes
    whether an odd number of its shingles falls into it."""
    cells = texts.select("id", F.explode(F.array_distinct(_shingle_hashes("line"))).alias("h"))
    bit, word = F.expr("shiftleft(1L, cast(shiftright(h, 8) & 63 AS int))"), F.col("h").bitwiseAND(F.lit(WORDS - 1))
    return cells.groupBy("id").agg(
        F.count("*").alias("k"), *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0))).alias(f"w{i}") for i in range(WORDS)]
    ).select("id", "k", F.array(*[F.col(f"w{i}") for i in range(WORDS)]).alias("odd"))


def possible() -> Column:
    """Whether the sketches ``k, odd`` and ``k_v, odd_v`` leave room for a similarity of 0.75: cells that
    differ are not more than the shingles that only one of the lines has. No such pair is lost."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.expr(f"odd[{i}] ^ odd_v[{i}]")) for i in range(WORDS)])
    return differ * (100 + SIMILAR) <= (F.col("k") + F.col("k_v")) * (100 - SIMILAR)


def links(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``u, v``: verified pairs that join what ``joined`` joins."""
    return joined(members, verify)[0]


def joined(members: DataFrame, verify: Callable[[DataFrame], DataFrame],
           sketched: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``u, v``: verified pairs of ``members`` (``key, id, n, sig``, n a length) that join all members
    of a bucket that are alike, or alike by others; and ``id, root``, the components of these
    pairs. In each bucket all are compared with one leader, by
    signature and then by ``verify``. Where the links so far leave members of a bucket apart, these
    are compared among themselves if they are few, and else with ever more leaders, one of a
    number of roots each. ``sketched`` gives the sketches (``id, k, odd``) of a table of ids,
    which tell apart most of the pairs that need no verifying."""
    # an original meets more lines in its buckets than its edited copies do, so it leads
    crowds = written(members.groupBy("key").agg(F.count("*").alias("m")))
    met = written(members.join(_bounded(crowds), "key").groupBy("id").agg(F.sum("m").alias("met")))
    rest = written(members.join(_bounded(met), "id").select("key", "id", F.struct(-F.col("met"), "n").alias("n"), "sig"))
    extra, found, roots, turn = [], None, None, 0
    while True:
        known = ["id", "sig", *extra]
        large, met_by = rest, probable("sig", "sig_v")
        direct = None
        if turn:
            met_by = (F.col("root") != F.col("root_v")) & met_by
            met_by = met_by & possible() if sketched else met_by
            sized = written(rest.groupBy("key").agg(F.count("*").alias("m")))
            few = F.col("m") <= SMALL_BUCKET * 8 ** (turn - 1)
            small = rest.join(sized.filter(few), "key", "left_semi")
            large = written(rest.join(sized.filter(~few), "key", "left_semi"))
            others = small.select(F.col("key").alias("of"), *[F.col(c).alias("v" if c == "id" else f"{c}_v") for c in known])
            direct = small.join(others, (F.col("key") == F.col("of")) & (F.col("v") < F.col("id")) & met_by).select(
                F.col("id").alias("u"), "v")
        part = F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(LEADERS * 4 ** (turn - 1))) if turn else F.lit(0)
        leaders = written(large.groupBy("key", part.alias("part")).agg(F.min(F.struct("n", *known)).alias("lead")).select(
            F.col("key").alias("of"), *[F.col(f"lead.{c}").alias("v" if c == "id" else f"{c}_v") for c in known]))
        pairs = large.join(leaders, (F.col("key") == F.col("of")) & (F.col("id") != F.col("v")) & met_by).select(
            F.col("id").alias("u"), "v")
        pairs = written((pairs.union(direct) if turn else pairs).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        alike = written(verify(pairs))
        found = alike if found is None else found.union(alike)
        # a leader has met all of its bucket
        rest = large.join(leaders.select(F.col("of").alias("key"), F.col("v").alias("id")), ["key", "id"], "left_anti")
        roots = written(merged(roots, alike) if turn else components(alike).withColumnRenamed("node", "id"))
        rest = written(rest.drop("root").join(_bounded(roots), "id", "left").withColumn("root", F.coalesce("root", "id")))
        split = written(rest.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key"))
        rest = written(rest.join(_bounded(split), "key", "left_semi"))
        if rest.isEmpty():
            return found, roots
        if sketched and not turn:
            rest = written(rest.join(written(sketched(rest.select("id").distinct())), "id"))
        extra = ["root", "k", "odd"] if sketched else ["root"]
        turn += 1


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``id, root`` after ``more`` links; no links are worked through but those between roots."""
    def of(side: str) -> DataFrame:
        return roots.select(F.col("id").alias(side), F.col("root").alias(f"of_{side}"))

    between = written(more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")))
    to = written(components(between)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    every = roots.union(between.select("u", "u")).union(between.select("v", "v")).distinct()
    return every.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root"))


def removals(docs: DataFrame) -> DataFrame:
    """``doc, tag, removed``: the positions (from 0) of the lines to take out of each document."""
    lines = lines_of(docs)
    known = written(signatures(lines))
    members = written(buckets(known))
    wanted = written(members.select("id").distinct().withColumn("met", F.lit(True)))
    copied = known.filter("main AND copies > 1").select("id")
    # all places of lines that are copied or have met others, with the texts of those
    held = _bounded(written(copied.join(wanted, "id", "full")))
    held = written(lines.join(held, "id").select("id", "doc", "tag", "pos", F.when(F.col("met"), F.col("line")).alias("line")))
    texts = written(held.filter(F.col("line").isNotNull()).groupBy("id").agg(F.min("line").alias("line")))
    _, groups = joined(
        members, lambda pairs: verified(pairs, texts), lambda ids: sketches(texts.join(ids, "id", "left_semi")))
    plural = written(copied.join(groups, "id", "full").select("id", F.coalesce("root", "id").alias("root")))
    places = written(held.select("id", "doc", "tag", "pos").join(_bounded(plural), "id").select("root", "doc", "tag", "pos"))
    keepers = written(places.groupBy("root").agg(F.min(F.struct("doc", "tag")).alias("keeper")))
    # a document's own first line of each group: only in its keeper does it stay
    firsts = written(places.groupBy("doc", "tag", "root").agg(F.min("pos").alias("first"), F.collect_list("pos").alias("all")))
    gone = F.when(F.struct("doc", "tag") == F.col("keeper"), F.array_except("all", F.array("first"))).otherwise(F.col("all"))
    return firsts.join(_bounded(keepers), "root").select("doc", "tag", gone.alias("gone")).filter(
        F.size("gone") > 0).groupBy("doc", "tag").agg(F.flatten(F.collect_list("gone")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text`` and any others) as ``doc``, a struct of their columns,
    with ``text``, their remaining lines, ``n_lines`` and ``n_removed``.

    Of each group of lines that are equal or alike (and of chains of them) the first line of the
    corpus stays, by ``doc_id``, a hash of the text, then position. Blank lines stay and are alike to
    nothing. Rows with one id and one text count as one document and lose the same positions; other
    texts under the id, or without one, are documents of their own; a null id comes last. A null text
    stays null and has no lines. No rows, no result.
    """
    with scratch(docs.sparkSession):
        gone = written(removals(docs.select("doc_id", "text")).toDF("_doc", "_of", "removed"), lasting=True)
    # positions count, not rows alone: one row may have any number of them
    size = gone.agg(F.count("*") + F.sum(F.size("removed"))).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_ROWS else gone
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_id"), F.xxhash64("text").alias("_tag"))
    whole = F.split("doc.text", "\n")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), coalesce(removed, array())),"
                  " i -> _lines[i]), '\n')")
    return rows.join(gone, (F.col("_id") == F.col("_doc")) & (F.col("_tag") == F.col("_of")), "left").withColumn("_lines", whole).select(
        "doc", F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(kept).alias("text"),
        F.greatest(F.size("_lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))
