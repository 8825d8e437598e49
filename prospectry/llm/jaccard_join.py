"""Exact Jaccard join of documents on 5-word shingles, as a join in a metric space.

Jaccard distance is a metric. Documents with one shingle set are one class. A class is known in the
regions of its prefix shingles: of a set of n, the first n - ceil(0.75 n) + k, k a tenth of n, in an order
of all shingles; two sets with a similarity of 0.75 share k regions, k that of the smaller set. The
order puts shingles that are frequent in the corpus last, so common passages open few regions, and
classes that share fewer than k regions with all others are told from the rest at once.

In each region pivots are chosen and every member's exact distance to them is taken. Members within
the radius of a pivot are linked to it and leave the region; the others are joined recursively with
new pivots. A document linked to one that left with pivot p is, by the triangle inequality, within
twice the radius of p: only such boundary documents are compared with the pivot's ball, and only
with those members whose distances to p differ from its own by the radius at most, and only if the
links so far have not joined them. So no link between different texts is lost, and a group of
thousands of near copies costs a few comparisons for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shingles import as_long, mixed, slices, text_shingles
from .store import scratch, written

SIMILAR = 75  # percent
SHARED = 10  # percent of a set by which prefixes are longer than they need be, to demand more of them
#: Cells of the table of shingle counts; its size is fixed, whatever the corpus.
CELL_BITS = 22
BLOCKS = 64
#: Regions of so many members are compared at once, larger ones through pivots.
SMALL_REGION = 32
PIVOTS = 8
#: So many ids are sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


# --- order of shingles ------------------------------------------------------------------------

def _sets(hashes: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
    for d in range(len(begin) - 1):
        yield np.unique(hashes[begin[d]:begin[d + 1]])


def _class(own: np.ndarray) -> np.uint64:
    """Hash of a set of hashes; 0 for the empty set."""
    return mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))


def scanned(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: ``doc_id, n`` (set size), ``class`` (hash of the set) for each document,
    and ``block, cells``: for each task, how many shingles fell into each of 2^22 cells."""
    width = (1 << CELL_BITS) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, held = np.zeros(1 << CELL_BITS, dtype=np.int64), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, begin = text_shingles(part.column("text"))
                sizes = np.zeros(part.num_rows, dtype=np.int64)
                marks = np.zeros(part.num_rows, dtype=np.uint64)
                for d, own in enumerate(_sets(hashes, begin)):
                    sizes[d], marks[d] = len(own), _class(own)
                waiting.append((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                held += len(hashes)
                if held > 1 << 21:
                    cells += np.bincount(np.concatenate(waiting), minlength=1 << CELL_BITS)
                    waiting, held = [], 0
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(sizes), as_long(marks),
                     pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())],
                    names=["doc_id", "n", "class", "block", "cells"])
        if waiting:
            cells += np.bincount(np.concatenate(waiting), minlength=1 << CELL_BITS)
        for block in range(BLOCKS):
            part = np.minimum(cells[block * width:(block + 1) * width], (1 << 32) - 1).astype(np.uint32)
            if part.any():
                planes = part.view(np.uint8).reshape(-1, 4).T.tobytes()  # zeros together pack well
                yield pa.record_batch(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                     pa.array([block], pa.int32()), pa.array([planes], pa.binary())],
                    names=["doc_id", "n", "class", "block", "cells"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, class bigint, block int, cells binary")


def shingle_levels(scan: DataFrame) -> np.ndarray:
    """For each cell 0, or, where it holds clearly more than its even share of all shingles, the
    logarithm of its count (in quarters of a power of two).

    Counts cover all documents: each task counted in a table of fixed size, and tables are summed by
    block. What reaches the driver has a fixed size as well.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, planes in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                part = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                sums[block] = sums.get(block, 0) + part.astype(np.int64)
        if sums:
            yield pa.record_batch([
                pa.array(list(sums), pa.int32()),
                pa.array([np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in sums.values()],
                         pa.binary())], names=["block", "cells"])

    rows = scan.filter("block IS NOT NULL").select("block", "cells").repartition(
        BLOCKS, "block").mapInArrow(add, "block int, cells binary").collect()  # 64 blocks
    width = (1 << CELL_BITS) // BLOCKS
    blocks = {r["block"]: np.frombuffer(r["cells"], np.uint32) for r in rows}
    often = 2 * sum(int(x.sum(dtype=np.int64)) for x in blocks.values()) / (1 << CELL_BITS) + 16
    levels = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    for block, x in blocks.items():
        levels[block * width:(block + 1) * width] = np.where(x > often, 4 * np.log2(np.maximum(x, 1)), 0)
    return levels


def _share(n):
    """Shingles that two similar sets must share in their prefixes: a tenth of the smaller set."""
    return (n * SHARED + 99) // 100


def prefix_length(n: int) -> int:
    """The first k common shingles of two similar sets, k = ``_share`` of the smaller one, lie
    within so many of either set."""
    return n - (SIMILAR * n + 99) // 100 + _share(n) if n else 0


def regions(docs: DataFrame, levels) -> DataFrame:
    """``region, class, z, hot`` for the prefix shingles of every document, where a region has two
    classes or more: ``z`` counts the infrequent shingles of the prefix, ``hot`` says that the
    region's own shingle is a frequent one."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, marks, sizes, rare = [], [], [], []
                for own in _sets(*text_shingles(part.column("text"))):
                    if not len(own):
                        continue
                    p = prefix_length(len(own))
                    level = table[own >> np.uint64(64 - CELL_BITS)]
                    first = np.flatnonzero(level == 0)[:p]
                    rare.append(len(first))
                    if len(first) < p:
                        late = np.flatnonzero(level)
                        late = late[np.lexsort((own[late], level[late]))[:p - len(first)]]
                        first = np.concatenate((first, late))
                    found.append(own[first])
                    marks.append(_class(own))
                    sizes.append(p)
                if found:
                    yield pa.record_batch(
                        [as_long(np.concatenate(found)), as_long(np.repeat(np.array(marks, np.uint64), sizes)),
                         pa.array(np.repeat(np.array(rare, np.int32), sizes))],
                        names=["region", "class", "z"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether its region has been given out
        table = levels.value
        for batch in batches:
            if not batch.num_rows:
                continue
            r, c, z = (np.asarray(batch.column(i)) for i in (0, 1, 2))
            if last is not None:
                r, c, z = (np.concatenate(([v], x)) for v, x in zip((last[0], last[1], last[3]), (r, c, z), strict=True))
            new = np.ones(len(r), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
            out = last is not None and last[2]
            r, c, z = r[new], c[new], z[new]
            same = r[1:] == r[:-1]
            several = np.zeros(len(r), dtype=bool)
            several[1:] |= same
            several[:-1] |= same
            last = (r[-1], c[-1], bool(several[-1]) or (out and r[-1] == r[0] and len(r) == 1), z[-1])
            if out:
                several[0] = False
            if several.any():
                r, c, z = r[several], c[several], z[several]
                hot = table[r.view(np.uint64) >> np.uint64(64 - CELL_BITS)] > 0
                yield pa.record_batch([pa.array(r), pa.array(c), pa.array(z.astype(np.int32)), pa.array(hot)],
                                      names=["region", "class", "z", "hot"])

    return docs.select("text").mapInArrow(prefixes, "region bigint, class bigint, z int").repartition("region")\
        .sortWithinPartitions("region", "class").mapInArrow(
            shared, "region bigint, class bigint, z int, hot boolean")


def crowded(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``region, class, n, s`` without classes that share too few of their prefix shingles with any
    other to be similar to it, and without regions that have one class; and ``class, n, s, full``.

    ``s`` bounds what a class has in common with any other class of the region. Where the region's
    shingle is frequent, the prefixes of all its classes hold all their infrequent shingles: common
    ones among these are regions too, so ``s`` is their number and that of the frequent shingles.
    Elsewhere ``s`` is the size of the set. In the second table ``full`` marks the classes of such
    regions; what two of them have in common is bounded by ``s`` wherever they meet.
    """
    least = F.floor((F.floor((F.col("n") * SIMILAR + 99) / 100) * SHARED + 99) / 100)
    counts = lists.groupBy("class").agg(
        F.count("*").alias("c"), F.count_if(~F.col("hot")).alias("c0"), F.first("n").alias("n"), F.first("z").alias("z"))
    counts = written(counts.filter(F.col("c") >= least).select(
        "class", "n", (F.col("n") - F.col("z") + F.col("c0")).alias("common"), (F.col("c0") < F.col("c")).alias("full")))
    kept = lists.select("region", "class", "n", "hot").join(counts.select("class", "common"), "class").withColumn(
        "s", F.when(F.col("hot"), F.col("common")).otherwise(F.col("n")))
    kept = kept.filter(F.col("s") * 100 >= F.col("n") * SIMILAR)
    stats = written(region_stats(kept).filter("many > 1"))
    bounds = counts.select("class", "n", F.when(F.col("full"), F.col("common")).otherwise(F.col("n")).alias("s"), "full")
    return written(kept.join(stats, "region").filter(_met()).select("region", "class", "n", "s")), bounds


def _possible(percent: int) -> Column:
    """Whether classes with sizes n, m and at most s, r shingles in common with others can have a
    similarity of ``percent``."""
    most = F.least("s", "r")
    return most * 100 >= (F.col("n") + F.col("m") - most) * percent


def _reach(n: str = "n", s: str = "s") -> Column:
    """A class of size n, with at most s shingles in common with others, can be similar to those of
    SIMILAR times their size up to this only."""
    return F.col(s) * (100 + SIMILAR) - F.col(n) * SIMILAR


def _alone(n: str = "n", s: str = "s") -> Column:
    """Whether a class can be similar to one of its own size. Of two classes that can be similar one
    at least can: if neither could, each would have to be larger than the other."""
    return _reach(n, s) >= F.col(n) * SIMILAR


def region_stats(lists: DataFrame) -> DataFrame:
    """``region, many`` (classes), and of those that are ``_alone`` the ``least`` size and the
    greatest ``_reach``, ``far``."""
    return lists.groupBy("region").agg(
        F.count("*").alias("many"), F.min(F.when(_alone(), F.col("n"))).alias("least"),
        F.max(F.when(_alone(), _reach())).alias("far"))


def _met() -> Column:
    """Whether a class is ``_alone`` or can be similar to one of a group with ``least, far``."""
    return _alone() | F.coalesce(
        (_reach() >= F.col("least") * SIMILAR) & (F.col("far") >= F.col("n") * SIMILAR), F.lit(False))


# --- exact distances --------------------------------------------------------------------------

def set_columns(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Class and size of each set."""
    return as_long(np.array([_class(own) for own in sets], np.uint64)), pa.array([len(own) for own in sets], pa.int64())


def set_rows(sets: list[np.ndarray]) -> pa.RecordBatch:
    tokens, parity = [], []
    for own in sets:
        bits = 4 << max(len(own) - 1, 15).bit_length()
        odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        tokens.append(own.tobytes())
    return pa.record_batch([*set_columns(sets), pa.array(parity, pa.binary()), pa.array(tokens, pa.binary())],
                           names=["class", "n", "parity", "tokens"])


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``class, n, parity, tokens`` of the documents in ``ids`` (``doc_id``): the sorted hashes as
    bytes, and a bit for each of about four cells a shingle: whether its count is odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield set_rows(list(_sets(*text_shingles(part.column("text")))))

    small = ids.count() <= BROADCAST_IDS
    ids = ids.select(F.col("doc_id").alias("_id"))
    ids = F.broadcast(ids) if small else ids
    chosen = docs.join(ids, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi")
    return chosen.select("text").mapInArrow(run, "class bigint, n bigint, parity binary, tokens binary")


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, p, shared, united`` of the ``pairs`` (``x, p``) with a similarity of ``percent`` or more.

    Cells with odd counts on one side only are at most as many as the shingles of one side only:
    pairs that have too many are told apart by their bits, and only the others' sets are moved.
    """

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, both in zip(batch["a"], batch["b"], batch["both"].to_pylist(), strict=True):
                a, b = a.as_py(), b.as_py()
                if len(a) < len(b):
                    a, b = b, a
                bits = int.from_bytes(a, "little")
                while len(a) > len(b):  # fold to the coarser one's cells
                    half = len(a) // 2
                    bits = (bits >> (8 * half)) ^ (bits & ((1 << (8 * half)) - 1))
                    a = a[:half]
                differ = (bits ^ int.from_bytes(b, "little")).bit_count()
                keep.append(differ * (100 + percent) <= both * (100 - percent))
            yield batch.select(["x", "p"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, united = [], []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                shared.append(both)
                united.append(len(a) + len(b) - both)
            yield pa.record_batch([batch["x"], batch["p"], pa.array(shared, pa.int64()), pa.array(united, pa.int64())],
                                  names=["x", "p", "shared", "united"])

    def sides(of: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
        return (of.select(F.col("class").alias("x"), F.col("n").alias("nx"), F.col(value).alias("a")),
                of.select(F.col("class").alias("p"), F.col("n").alias("np"), F.col(value).alias("b")))

    left, right = sides(sets, "parity")
    likely = written(
        pairs.join(left, "x").join(right, "p").filter(
            (F.col("nx") * 100 >= F.col("np") * percent) & (F.col("np") * 100 >= F.col("nx") * percent)
        ).select("x", "p", "a", "b", (F.col("nx") + F.col("np")).alias("both")
                 ).mapInArrow(plausible, "x bigint, p bigint"))
    used = written(likely.select(F.explode(F.array("x", "p")).alias("class")).distinct())
    left, right = sides(sets.join(F.broadcast(used) if used.count() <= BROADCAST_IDS else used, "class", "left_semi"), "tokens")
    return likely.join(left, "x").join(right, "p").select("x", "p", "a", "b").mapInArrow(
        exact, "x bigint, p bigint, shared bigint, united bigint").filter(
        F.col("shared") * 100 >= F.col("united") * percent)


def _linked() -> Column:
    return F.col("shared") * 100 >= F.col("united") * SIMILAR


def _rounds(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, p, shared, united`` of all pairs within twice the radius that were compared, x > p,
    until no region is open."""
    known, turn, near = None, 0, 2 * SIMILAR - 100
    while True:
        # those that none of the region's classes can be similar to are done with here
        sized = written(region_stats(lists))
        most = 2 if turn == 0 else SMALL_REGION
        members = lists.join(sized, "region").filter(_met()).select("region", "class", "n", "s", "many")
        small = members.filter(F.col("many") <= most).drop("many")
        large = members.filter(F.col("many") > most).drop("many")
        direct = small.withColumnRenamed("class", "x").join(
            small.select(F.col("region").alias("of"), F.col("class").alias("p"), F.col("n").alias("m"), F.col("s").alias("r")),
            (F.col("region") == F.col("of")) & (F.col("p") < F.col("x")) & _possible(SIMILAR)).select("x", "p")
        # an original shares more of its shingles than its edited copies do, so it comes first;
        # one pivot at first, which settles groups of copies, then one for each of ever more parts
        order = F.struct(-F.col("s") / F.col("n"), F.xxhash64("class", F.lit(turn)), "class")
        part = F.pmod(F.xxhash64("class", F.lit(-turn)), F.lit(1 if turn == 0 else PIVOTS * 4 ** (turn - 1)))
        pivots = written(large.groupBy("region", part.alias("part")).agg(
            F.min(F.struct(order.alias("o"), F.col("class").alias("p"), F.col("n").alias("m"), F.col("s").alias("r"))).alias("v")
        ).select(F.col("region").alias("of"), "v.p", "v.m", "v.r"))

        def rivals(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
            pairs = members.withColumnRenamed("class", "x").join(
                pivots, (F.col("region") == F.col("of")) & (F.col("x") != F.col("p")) & _possible(percent))
            return written(pairs.select("region", "x", "p", F.greatest("x", "p").alias("a"), F.least("x", "p").alias("b")))

        def pairs_of(found: DataFrame) -> DataFrame:
            return found.select(F.col("a").alias("x"), F.col("b").alias("p"))

        tried = rivals(large, pivots, SIMILAR)
        linked = written(near_pairs(direct.union(pairs_of(tried)).distinct(), sets, SIMILAR))
        balls = written(tried.join(linked.select(F.col("x").alias("a"), F.col("p").alias("b")), ["a", "b"]))
        gone = written(balls.select("region", F.col("x").alias("class")).union(
            pivots.select("of", F.col("p").alias("class"))).distinct())
        rest = large.join(gone, ["region", "class"], "left_anti")
        # only where members have left with a pivot can others, those that leave with another pivot
        # and other pivots among them, be at the boundary of its ball
        centres = pivots.join(written(balls.select(F.col("region").alias("of"), "p").distinct()), ["of", "p"])
        around = pairs_of(rivals(large, centres, near)).distinct().join(linked.select("x", "p"), ["x", "p"], "left_anti")
        edges = near_pairs(around, sets, near)
        fresh = linked.union(edges)
        known = written((fresh if known is None else known.union(fresh)).distinct())
        open_regions = written(rest.groupBy("region").count().filter("count > 1").select("region"))
        lists = written(rest.join(open_regions, "region", "left_semi"))
        turn += 1
        if lists.isEmpty():
            return known


def _boundaries(known: DataFrame, roots: DataFrame, sets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Comparisons of boundary documents with the balls of pivots that they are not yet joined to.
    ``bounds`` has ``class, n, s, full``, with which most are told apart: first each document from a
    whole ball and each ball's member from all the documents around it, then pairs."""
    both = written(known.union(known.select(F.col("p").alias("x"), F.col("x").alias("p"), "shared", "united")))
    distance = 1 - F.col("shared") / F.col("united")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    outside = both.filter(~_linked()).select("x", "p", distance.alias("d")).join(
        root("x"), "x", "left").join(root("p"), "p").filter(
        ~F.coalesce("x_root", "x").eqNullSafe(F.col("p_root"))).select("p", F.col("x").alias("class"), "d")
    outside = written(outside.join(bounds, "class"))
    ball = written(both.filter(_linked()).select("p", F.col("x").alias("class"), distance.alias("d")).join(
        outside.select("p").distinct(), "p", "left_semi").join(bounds, "class"))

    def meeting(mine: DataFrame, others: DataFrame) -> DataFrame:
        stats = others.groupBy("p").agg(
            F.min(F.when(_alone(), F.col("n"))).alias("least"), F.max(F.when(_alone(), _reach())).alias("far"),
            F.min("n").alias("any_least"), F.max(_reach()).alias("any_far"), F.bool_or(~F.col("full")).alias("open"))
        some = (_reach() >= F.col("any_least") * SIMILAR) & (F.col("any_far") >= F.col("n") * SIMILAR)
        return mine.join(written(stats), "p").filter(
            F.col("open") | ~F.col("full") | (some & _met())).select(mine.columns)

    outside = written(meeting(outside, ball))
    ball = meeting(ball, outside).select(
        F.col("p").alias("of"), F.col("class").alias("x"), F.col("d").alias("e"),
        F.col("n").alias("m"), F.col("s").alias("r"), F.col("full").alias("whole"))
    either = F.col("n") + F.col("m")
    alike = F.when(F.col("full") & F.col("whole"), _possible(SIMILAR)).otherwise(
        F.least("n", "m") * (100 + SIMILAR) >= either * SIMILAR)
    pairs = outside.withColumnRenamed("class", "y").join(
        ball, (F.col("p") == F.col("of")) & (F.col("x") != F.col("y")) & alike
        & (F.abs(F.col("d") - F.col("e")) <= (100 - SIMILAR) / 100 + 1e-9)
    ).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("p")).distinct()
    return near_pairs(pairs, sets, SIMILAR)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, class, root`` (of the component's classes) for each row of ``docs`` (``doc_id, text``).

    Documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more;
    ``component_id`` is the smallest ``doc_id`` that links reach. Texts of fewer words have their
    whole sequence as the one shingle; null texts and texts without words have no set and link with
    nothing. Rows with a null id take part; alone, their ``component_id`` is null. Repeated rows
    stay rows. Other columns are not used. Exact but for collisions of 64-bit hashes. No rows, no
    result.
    """
    with scratch(docs.sparkSession):
        return written(_components(docs.select("doc_id", "text")), lasting=True)


def _components(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    scan = written(scanned(docs))
    levels = spark.sparkContext.broadcast(shingle_levels(scan))
    sets = scan.filter("block IS NULL").select("doc_id", "n", "class")
    classes = sets.groupBy("class").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    lists = written(regions(docs, levels))
    lists = lists.join(written(classes), "class").select("region", "class", "n", "z", "hot")
    lists, bounds = crowded(lists)
    candidates = written(classes.join(lists.select("class").distinct(), "class", "left_semi"))
    whole = written(whole_sets(docs, candidates.select("doc_id")))
    known = _rounds(lists, whole)
    links = known.filter(_linked()).select(F.col("x").alias("u"), F.col("p").alias("v"))
    roots = written(components(links))
    late = written(_boundaries(known, roots, whole, bounds).select(
        F.col("x").alias("u"), F.col("p").alias("v")))
    if not late.isEmpty():
        roots = written(components(links.union(late)))
    placed = sets.select("doc_id", "n", "class").join(
        roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    least = written(placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return written(placed).join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "class", "root")


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` (all columns) and the class of each text as ``name``; 0: it has no words."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                marks = [_class(own) for own in _sets(*text_shingles(part.column("text")))]
                yield pa.record_batch([*part.columns, as_long(np.array(marks, np.uint64))], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
