"""How filters overlap: what each removes alone, after others, and in every order.

Rules over one text give a mask of failed filters where the text is read. Duplicates need all texts:

1. Bytes below text prefixes of 4, 16, 64, ... bytes are counted. A prefix with more bytes below it
   than a group may have is hot, and its texts are told apart by the next length, up to the whole
   text. So each text has a prefix of its own length, and no prefix has too many texts below it.
2. Each task inserts its texts whole into a compressed trie whose terminals hold the least id, and
   hands on one row for each distinct text: a text with millions of copies leaves a task once.
3. These rows are range-partitioned and sorted by prefix; each prefix is one trie again. What its
   traversal yields are the first documents of all texts; all others are duplicates.

Masks, duplicate flags and labels meet on ids, narrow, and are reduced to counts for each mask. Masks
are few, so all orders of the filters are evaluated on those counts alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
DUPLICATE = "E"
GROUP_BYTES = 8 << 20  # of texts below one prefix
#: So many hot prefixes of one length at most; with more text, groups grow instead.
HOT_PREFIXES = 1 << 18
FIRST_LENGTH, FACTOR = 4, 4
CHUNK_BYTES = 32 << 20  # of distinct texts in the trie of a reading task
PARTITION_BYTES = 64 << 20
ROW_BYTES = 256  # what a row takes besides its text
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"


# --- tries --------------------------------------------------------------------------------------

class _Node:
    __slots__ = ("label", "below", "least")

    def __init__(self, label: bytes, least: int | None = None):
        self.label, self.below, self.least = label, {}, least


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b`` from ``at`` on share."""
    n, k, step = min(len(a), len(b) - at), 0, 4096
    while step:
        while k + step <= n and a[k:k + step] == b[at + k:at + k + step]:
            k += step
        step //= 8
    return k


class RadixTrie:
    """Compressed trie of byte strings whose terminals hold the least id inserted there."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.bytes = 0

    def insert(self, text: bytes, number: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = _Node(text[at:])
                self.bytes += len(child.label) + ROW_BYTES
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                k = _common(child.label, text, at)
                upper = node.below[text[at]] = _Node(child.label[:k])
                child.label = child.label[k:]
                upper.below[child.label[0]] = child
                node, at = upper, at + k
        node.least = number if node.least is None else min(node.least, number)

    def items(self) -> Iterator[tuple[bytes, int]]:
        """All texts with their least ids."""
        open_ = [(b"", self.root)]
        while open_:
            before, node = open_.pop()
            text = before + node.label
            if node.least is not None:
                yield text, node.least
            open_.extend((text, child) for child in node.below.values())


# --- adaptive prefixes --------------------------------------------------------------------------

def _lengths(size: int) -> Iterator[int]:
    """Lengths of the prefixes of a text of ``size`` bytes, up to the whole."""
    length = FIRST_LENGTH
    while length < size:
        yield length
        length *= FACTOR
    yield size


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").fill_null("").cast(pa.binary()).to_pylist()


def _prefix_bytes(docs: DataFrame) -> DataFrame:
    """``length, head, bytes``: bytes of text below each prefix, a prefix being a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            return pa.record_batch(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array(list(sums.values()), pa.int64())], names=["length", "head", "bytes"])

        for batch in batches:
            for text in _texts(batch):
                weight = len(text) + ROW_BYTES
                for length in _lengths(len(text)):
                    key = (length, xxhash.xxh3_64_intdigest(text[:length]) >> 1)
                    sums[key] = sums.get(key, 0) + weight
            if len(sums) > 200_000:
                yield out()
                sums.clear()
        yield out()

    parts = docs.select("text").mapInArrow(run, "length bigint, head bigint, bytes bigint")
    return parts.groupBy("length", "head").agg(F.sum("bytes").alias("bytes"))


def hot_prefixes(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[frozenset, int]:
    """The prefixes (length, hash) below which more than ``group_bytes`` bytes of ``docs.text`` lie,
    and all bytes. Starts a job.

    Their number has a bound whatever the size of the table: at most ``HOT_PREFIXES`` of one length
    can be over the limit, which grows where the table is too large for that.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + ROW_BYTES
    total = docs.agg(F.sum(size)).first()[0] or 0
    limit = max(group_bytes, total // HOT_PREFIXES)
    if total <= limit:
        return frozenset(), total
    hot = _prefix_bytes(docs).filter(F.col("bytes") > limit).select("length", "head")
    return frozenset(map(tuple, hot.collect())), total


def adaptive_prefix(text: bytes, hot: frozenset) -> bytes:
    """The shortest prefix of ``text`` that is not hot, or the whole."""
    for length in _lengths(len(text)):
        if (length, xxhash.xxh3_64_intdigest(text[:length]) >> 1) not in hot:
            break
    return text[:length]


# --- duplicates ---------------------------------------------------------------------------------

def first_documents(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, digest``: for each distinct text of ``docs`` (``doc_id, text``) its least id, with a
    digest of the text.

    Null texts are empty texts. Rows without an id are left out: they are no smaller and no larger
    than others. Repeated rows are one. No rows, no result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    hot, total = hot_prefixes(rows, group_bytes)
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(hot)
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
            prefixes, texts, ids, size = [], [], [], 0
            for text, least in trie.items():
                prefixes.append(adaptive_prefix(text, shared.value))
                texts.append(text)
                ids.append(least)
                size += len(text)
                if size > CHUNK_BYTES // 8:
                    yield _columns(prefixes, texts, ids)
                    prefixes, texts, ids, size = [], [], [], 0
            yield _columns(prefixes, texts, ids)

        trie = RadixTrie()
        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                trie.insert(text, number)
                if trie.bytes > CHUNK_BYTES:
                    yield from out(trie)
                    trie = RadixTrie()
        yield from out(trie)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(trie: RadixTrie) -> pa.RecordBatch:
            found = [(least, xxhash.xxh3_128_digest(text)) for text, least in trie.items()]
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()),
                                    pa.array([d for _, d in found], pa.binary())], names=["doc_id", "digest"])

        trie, prefix = RadixTrie(), None
        for batch in batches:
            for own, text, number in zip(*(batch.column(c).to_pylist() for c in ("prefix", "text", "doc_id")), strict=True):
                if own != prefix and trie.bytes > CHUNK_BYTES // 8:
                    yield out(trie)
                    trie = RadixTrie()
                prefix = own
                trie.insert(text, number)
        yield out(trie)

    ranged = rows.mapInArrow(collapse, "prefix binary, text binary, doc_id bigint")
    return ranged.repartitionByRange(n, "prefix").sortWithinPartitions("prefix").mapInArrow(
        reduce, "doc_id bigint, digest binary")


def _columns(prefixes: list, texts: list, ids: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(prefixes, pa.binary()), pa.array(texts, pa.binary()), pa.array(ids, pa.int64())],
                           names=["prefix", "text", "doc_id"])


# --- masks --------------------------------------------------------------------------------------

def failed_rules(text: bytes) -> int:
    """Bits of the rules over one text that it fails: A (1) fewer than 200 words, B (2) under half of
    the words distinct, C (4) over 3 % capital letters, D (8) one of the signs ``#$%&*|``."""
    words = text.split()  # bytes: exactly the ASCII white space
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, _SIGNS)) < len(text)) << 3)


def failed_masks(docs: DataFrame, rules: Callable[[bytes], int] = failed_rules, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs`` (``doc_id, text, lang``): the language (null:
    empty) and the failed filters; the highest bit (16) marks texts that a smaller id has too.

    Null texts are empty. Rows without an id have no duplicate bit. Repeated rows and rows that share
    an id are judged one by one. Other columns are not used. No rows, no result.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("part"), pa.array([int(rules(t)) for t in texts], pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())],
                names=["doc_id", "part", "mask", "digest"])

    judged = narrow.mapInArrow(judge, "doc_id bigint, part string, mask int, digest binary")
    firsts = first_documents(docs, group_bytes).withColumn("first", F.lit(True))
    again = judged.filter("doc_id IS NOT NULL").join(firsts, ["doc_id", "digest"], "left").select(
        "doc_id", "part", F.when(F.col("first").isNull(), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    return again.union(judged.filter("doc_id IS NULL").select("doc_id", "part", "mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents for each part and mask, and how many of them are
    labelled (``labels``: ``doc_id, quality, toxic``) as good or toxic.

    A document with several labels is good, or toxic, if one of them says so; one without is neither.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    some = masks.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").select("part", "mask", "good", "toxic")
    none = masks.filter("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    flags = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("good", "toxic")]
    return some.union(none).groupBy("part", "mask").agg(F.count("*").alias("n"), *flags)


def _effects(filters: str) -> list[tuple]:
    """What each step of each order does to a document with each mask; a table of fixed size."""
    rows = []
    for order in permutations(filters):
        bits = [1 << filters.index(letter) for letter in order]
        for mask in range(1 << len(filters)):
            before = 0
            for step, bit in enumerate(bits, 1):
                fails, gone = bool(mask & bit), bool(mask & before)
                rows.append((mask, "".join(order), step, order[step - 1], int(not (fails or gone)), int(fails and not gone),
                             int(fails and gone), int(mask == bit)))
                before |= bit
    return rows


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``mask_counts``: documents kept,
    removed, redundant, failing this filter only, good and toxic ones lost, and removals of the step's
    filter summed over all orders (``shapley``). Zeros are rows too; no counts, no rows."""
    session = counts.sparkSession
    effects = session.createDataFrame(
        _effects(filters), "mask int, filter_order string, step int, letter string, kept int, removed int, redundant int, alone int")
    joined = counts.join(F.broadcast(effects), "mask")  # of fixed size: orders x masks x steps

    def total(column: str, of: str, alias: str):
        return F.sum(F.col(column) * F.col(of)).cast("bigint").alias(alias)

    steps = joined.groupBy("part", "filter_order", "step", "letter").agg(
        total("kept", "n", "kept"), total("removed", "n", "removed"), total("redundant", "n", "redundant"),
        total("alone", "n", "unique_fails"), total("removed", "good", "good_lost"), total("removed", "toxic", "toxic_lost"))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audited(docs: DataFrame, labels: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The interactions of all five filters over ``docs`` within each language."""
    return interactions(mask_counts(failed_masks(docs, group_bytes=group_bytes), labels))
