"""Substring deduplication: paragraphs that repeat, whole or pasted into other text.

Paragraphs (lines of 5 words or more) are sets of 5-word shingles. Signatures of 24 minima in 8
bands of 3 are tuned for a recall above 0.98 at a similarity of 0.75; colliding paragraphs are
verified by exact Jaccard similarity, components of the verified pairs keep their first paragraph.

A passage pasted into a longer line, or over several lines, is not a line of its own. So every text
also has windows of 8 words at the places that winnowing picks: the least 5-word hash of every 4
consecutive ones, the same places in every copy. Windows whose whole word sequences agree are copies
of the first one. They are seeds: overlapping ones join to exact runs, and runs that follow each other
in one pair of documents join over gaps, where what lies in the gaps, counted as edits on the longer
side, is at most a quarter of the words. That bounds the edit distance from above, so no text is
read again. Passages of 40 words or more are reported. A run of 11 words or more has a seed, and all of a
run but 3 words at each end is covered: an exact passage of 46 words or more is always found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .fuzzy_lines import links
from .jaccard_join import BROADCAST_IDS, SIMILAR, near_pairs
from .shingles import (
    _BASE, _INVERSE, _PLACES, WORDS, as_long, buffers, list_column, mixed, shingle_hashes, slices, word_hashes)
from .store import scratch, written

BANDS, ROWS = 8, 3
LEAST_PARAGRAPH, LEAST_WORDS = WORDS, 40  # words of a paragraph, of a pasted passage
WINDOW, WINNOW = 8, 4
#: Words between two exact runs of a passage at most, and percent of its words that gaps may hold.
GAP, GAPS = 24, 25
_MASKS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def _word_ends(data: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte after each word that begins at ``first``."""
    low, high = int(at[0]), int(at[-1])
    b = data[low:high]
    stop = (b == 32) | ((b >= 9) & (b <= 13))
    gaps = np.union1d(np.flatnonzero(stop) + low, at)
    return gaps[np.searchsorted(gaps, first, "right")]


# --- paragraphs -------------------------------------------------------------------------------

def _paragraphs(part: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, first byte, byte after, shingle hashes) of each line of ``LEAST_PARAGRAPH`` words or more."""
    data, at = buffers(part.column("text"))
    low, high = int(at[0]), int(at[-1])
    breaks = np.flatnonzero(data[low:high] == 10) + low
    cuts = np.unique(np.concatenate((at, breaks)))  # a line begins at a text or at a line feed
    words, _, counts = word_hashes(data, cuts)
    hashes, begin = shingle_hashes(words, counts)
    for k in np.flatnonzero(np.diff(counts) >= LEAST_PARAGRAPH):
        row = int(np.searchsorted(at, cuts[k], "right")) - 1
        start = int(cuts[k]) + (1 if cuts[k] < high and data[cuts[k]] == 10 else 0)
        yield row, start, int(cuts[k + 1]), np.unique(hashes[begin[k]:begin[k + 1]])


def _signed(part: pa.RecordBatch) -> pa.RecordBatch | None:
    """A row for each paragraph of ``part``, all of them worked out at once."""
    data, at = buffers(part.column("text"))
    low, high = int(at[0]), int(at[-1])
    cuts = np.unique(np.concatenate((at, np.flatnonzero(data[low:high] == 10) + low)))
    words, _, counts = word_hashes(data, cuts)
    hashes, begin = shingle_hashes(words, counts)
    lines = np.flatnonzero(np.diff(counts) >= LEAST_PARAGRAPH)
    if not len(lines):
        return None
    sizes = np.diff(begin)
    long = np.zeros(len(sizes), dtype=bool)
    long[lines] = True
    own = hashes[np.repeat(long, sizes)]
    of = np.repeat(np.arange(len(lines)), sizes[lines])
    # a shingle that a line repeats counts once: the places of the distinct pairs of line and shingle
    _, first = np.unique(mixed(own ^ mixed(of.astype(np.uint64) + _BASE)), return_index=True)
    once = np.zeros(len(own), dtype=bool)
    once[first] = True
    own, of = own[once], of[once]
    n = np.bincount(of, minlength=len(lines))
    starts = np.concatenate(([0], np.cumsum(n[:-1])))
    marks = np.add.reduceat(mixed(own ^ np.uint64(0x5851F42D4C957F2D)), starts) + n.astype(np.uint64)
    least = np.stack([np.minimum.reduceat(own ^ mask, starts) for mask in _MASKS], axis=1)
    rows = least.reshape(-1, BANDS, ROWS)
    bands = mixed(mixed(rows[:, :, 0]) + rows[:, :, 1] * _PLACES[0] + rows[:, :, 2] * _PLACES[1]
                  + np.arange(BANDS, dtype=np.uint64) * _BASE)
    sig = np.ascontiguousarray((least & np.uint64(255)).astype(np.uint8)).view(np.int64)  # a byte of each minimum
    chars = np.concatenate(([0], np.cumsum((data[low:high] & 0xC0) != 0x80)))
    head, row = cuts[lines], np.searchsorted(at, cuts[lines], "right") - 1
    head = head + (data[head] == 10)
    base = chars[at[row] - low]

    def listed(values: np.ndarray) -> pa.Array:
        return list_column(values.ravel().view(np.uint64), np.arange(len(values) + 1) * values.shape[1])

    return pa.record_batch(
        [part.column("doc").take(pa.array(row)), pa.array(chars[head - low] - base),
         pa.array(chars[cuts[lines + 1] - low] - base), as_long(marks), pa.array(n), listed(bands), listed(sig)],
        names=["doc", "start", "stop", "class", "n", "bands", "sig"])


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc, start, stop`` (code points), ``class`` (hash of the shingle set), ``n``, ``bands``, ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                signed = _signed(part)
                if signed is not None:
                    yield signed

    return docs.mapInArrow(run, "doc bigint, start bigint, stop bigint, class bigint, n bigint,"
                                " bands array<bigint>, sig array<bigint>")


def paragraph_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``class, n, parity, tokens`` of the paragraphs of the documents in ``places`` (``doc``)."""
    from .jaccard_join import set_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield set_rows([own for _, _, _, own in _paragraphs(part)])

    small = places.count() <= BROADCAST_IDS
    places = places.select(F.col("doc").alias("_doc"))
    chosen = docs.join(F.broadcast(places) if small else places, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    return chosen.select("text").mapInArrow(run, "class bigint, n bigint, parity binary, tokens binary")


def paragraph_removals(docs: DataFrame) -> DataFrame:
    found = written(paragraphs(docs))
    classes = written(found.groupBy("class").agg(F.count("*").alias("copies"), F.min("doc").alias("doc")))
    keys = found.select(F.explode("bands").alias("key"), F.col("class").alias("id"), "n", "sig")
    several = written(keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key"))
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    members = written(keys.join(several, "key", "left_semi").dropDuplicates(["key", "id"]))
    wanted = written(members.select(F.col("id").alias("class")).distinct())
    places = written(classes.join(wanted, "class", "left_semi").select("doc").distinct())
    sets = written(paragraph_sets(docs, places).join(wanted, "class", "left_semi").dropDuplicates(["class"]))

    def verify(pairs: DataFrame) -> DataFrame:
        near = near_pairs(pairs.select(F.col("u").alias("x"), F.col("v").alias("p")), sets, SIMILAR)
        return near.select(F.col("x").alias("u"), F.col("p").alias("v"))

    groups = written(components(links(members, verify)))
    rooted = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")).select("class", "root", "copies")
    plural = written(rooted.groupBy("root").agg(F.sum("copies").alias("all")).filter("all > 1").select("root"))
    rooted = written(rooted.join(plural, "root", "left_semi").select("class", "root"))
    members = written(found.join(rooted, "class").select("root", "doc", "start", "stop", "n"))
    kept = written(members.groupBy("root").agg(F.min(F.struct("doc", "start")).alias("kept")))
    return members.join(kept, "root").filter(
        ~(F.col("doc").eqNullSafe(F.col("kept.doc")) & (F.col("start") == F.col("kept.start")))
    ).select("doc", "start", "stop", (F.col("n") + (WORDS - 1)).alias("words"),
             F.col("kept.doc").alias("kept_doc"), F.col("kept.start").alias("kept_start"), F.lit("paragraph").alias("kind"))


# --- passages ---------------------------------------------------------------------------------

def _least_of_run(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` (a power of two) consecutive values."""
    step = 1
    while step < width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return v


def windows(docs: DataFrame) -> DataFrame:
    """``key`` (hash of the words), ``doc, word, start, stop`` of the winnowed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = buffers(part.column("text"))
                words, first, counts = word_hashes(data, at)
                n = len(words)
                if n < WINDOW + WINNOW:
                    continue
                power, inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base)))) for base in (_BASE, _INVERSE))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n])))
                rolled = mixed((sums[WORDS:] - sums[:-WORDS]) * inverse[:n - WORDS + 1])
                places = np.arange(len(rolled), dtype=np.uint64)
                least = _least_of_run((rolled & np.uint64(0xFFFFFFFF00000000)) | places, WINNOW)
                anchors = np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
                row = np.searchsorted(counts, anchors, "right") - 1
                inside = anchors + WINDOW <= counts[row + 1]
                anchors, row = anchors[inside], row[inside]
                if not len(anchors):
                    continue
                keys = mixed((sums[anchors + WINDOW] - sums[anchors]) * inverse[anchors] + np.uint64(WINDOW))
                ends = _word_ends(data, at, first)
                low = int(at[0])
                chars = np.concatenate(([0], np.cumsum((data[low:int(at[-1])] & 0xC0) != 0x80)))
                base = chars[at[row] - low]
                ids = part.column("doc").take(pa.array(row))
                yield pa.record_batch(
                    [as_long(keys), ids, pa.array((anchors - counts[row]).astype(np.int32)),
                     pa.array((chars[first[anchors] - low] - base).astype(np.int32)),
                     pa.array((chars[ends[anchors + WINDOW - 1] - low] - base).astype(np.int32))],
                    names=["key", "doc", "word", "start", "stop"])

    return docs.mapInArrow(run, "key bigint, doc bigint, word int, start int, stop int")


def copies(found: DataFrame) -> DataFrame:
    """``doc, word, start, stop, kept_doc, kept_word, kept_start`` of all windows but the first of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, doc, start and word of the first window of the key that was read last
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch["key"])
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            if last is not None and last[0] == key[0]:
                new[0] = False
            group = np.cumsum(new)  # 0: goes on from the last batch
            leads = np.flatnonzero(new)
            docs = pa.concat_arrays([pa.array([last[1] if last else None], pa.int64()), batch["doc"].take(pa.array(leads))])
            starts = np.concatenate(([last[2] if last else 0], np.asarray(batch["start"])[leads]))
            places = np.concatenate(([last[3] if last else 0], np.asarray(batch["word"])[leads]))
            copy = np.flatnonzero(~new)
            if len(copy):
                of = group[copy]
                part = batch.take(pa.array(copy))
                yield pa.record_batch(
                    [part["doc"], part["word"], part["start"], part["stop"], docs.take(pa.array(of)),
                     pa.array(places[of].astype(np.int32)), pa.array(starts[of].astype(np.int32))],
                    names=["doc", "word", "start", "stop", "kept_doc", "kept_word", "kept_start"])
            last = (key[-1], docs[int(group[-1])].as_py(), int(starts[group[-1]]), int(places[group[-1]]))

    return found.repartition("key").sortWithinPartitions("key", "doc", "word").mapInArrow(
        run, "doc bigint, word int, start int, stop int, kept_doc bigint, kept_word int, kept_start int")


class _Run:
    """A stretch of a document: words ``at`` to ``end``, of which ``gaps`` lie between copied windows.
    ``kept`` is the first window's source (document, start), ``source`` the last one's (document, word
    after it); ``head`` is the first window's (document, word)."""

    __slots__ = ("at", "end", "start", "stop", "gaps", "kept", "head", "source")

    def __init__(self, at, start, stop, doc, word, kept_start):
        self.at, self.end, self.start, self.stop, self.gaps = at, at + WINDOW, start, stop, 0
        self.kept, self.head, self.source = (doc, kept_start), (doc, word), (doc, word + WINDOW)

    def gap(self, other: _Run) -> int | None:
        """Edits at most between this run and a later one of the same pair of documents, None if
        they do not follow each other there."""
        if self.source[0] != other.head[0]:
            return None
        mine, theirs = other.at - self.end, other.head[1] - self.source[1]
        if theirs < 0:  # words taken twice are edits as well
            mine, theirs = mine - theirs, 0
        most = max(mine, theirs)
        return most if most <= GAP else None

    def take(self, other: _Run, gap: int) -> None:
        self.gaps += gap + other.gaps
        if other.end >= self.end:
            self.end, self.source = other.end, other.source
        self.stop = max(self.stop, other.stop)


def joined(runs: list[_Run]) -> list[_Run]:
    """``runs`` in order, joined over gaps, smallest first, as long as gaps stay a small part."""
    while True:
        best = None
        for k in range(len(runs) - 1):
            a, b = runs[k], runs[k + 1]
            gap = a.gap(b)
            if gap is not None and (a.gaps + gap + b.gaps) * 100 <= (b.end - a.at) * GAPS and (best is None or gap < best[0]):
                best = gap, k
        if best is None:
            return runs
        runs[best[1]].take(runs.pop(best[1] + 1), best[0])


def passages(found: DataFrame) -> DataFrame:
    """Copies of one document joined; passages of ``LEAST_WORDS`` words or more."""
    names = ["doc", "start", "stop", "words", "kept_doc", "kept_start", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, runs = None, []  # exact runs with small gaps between them
        out: list[tuple] = []

        def close() -> None:
            for r in joined(runs):
                if r.end - r.at >= LEAST_WORDS:
                    out.append((doc, r.start, r.stop, r.end - r.at, *r.kept, "passage"))
            runs.clear()

        def given() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for d, w, start, stop, kept, word, kept_start in zip(*[batch[c].to_pylist() for c in (
                    "doc", "word", "start", "stop", "kept_doc", "kept_word", "kept_start")], strict=True):
                seed = _Run(w, start, stop, kept, word, kept_start)
                if runs and (doc != d or w > runs[-1].end + GAP):
                    close()
                doc = d
                if runs and w <= runs[-1].end:
                    runs[-1].take(seed, 0)
                else:
                    runs.append(seed)
            if out:
                yield given()
                out.clear()
        close()
        if out:
            yield given()

    return found.repartition("doc").sortWithinPartitions("doc", "word").mapInArrow(
        run, "doc bigint, start bigint, stop bigint, words bigint, kept_doc bigint, kept_start bigint, kind string")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, start, stop`` (code points, from 0, end excluded), ``words, kept_doc_id,
    kept_start, kind``: every repeated stretch of ``docs`` (``doc_id, text``) but the first of its
    kind by ``(doc_id, start)``, which ``kept_*`` name (for a passage, where its first window was
    met first). ``kind`` is ``paragraph`` or ``passage``; both may report one stretch. For a
    paragraph ``words`` counts its distinct shingles and four.

    Null texts and lines of fewer than five words repeat nothing unless a passage holds them. Rows with one id are one document
    whose repeated rows repeat each other's text at equal places, which is not reported for whole
    paragraphs; a null id counts as the smallest. Other columns are not used. No rows, no result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    with scratch(docs.sparkSession):
        lines = paragraph_removals(docs)
        kept = written(lines, lasting=True)  # the signatures need not lie beside the windows
    return kept.union(passages(copies(windows(docs)))).select(
        F.col("doc").alias("doc_id"), "start", "stop", "words", F.col("kept_doc").alias("kept_doc_id"),
        "kept_start", "kind")
