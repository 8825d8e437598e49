"""Benchmark decontamination by a random-walk embedding of edit distance.

Texts and items are sequences of words. The CGK embedding walks along a sequence: at each step it
notes the word it stands on and moves on or stays, as a random bit of (step, word) says; sequences at
a small edit distance get walks that agree at most steps, so edit distance becomes Hamming distance.
Bit sampling makes that a hash: a few steps of a walk, drawn at random, are one key. Several walks
with several samples each give the tables; two texts that agree in any table are compared by exact
edit distance.

Short items leave a walk no room between their edits. They are cut into one piece more than the edits
they are allowed, so that one piece stays whole, and the pieces' words are keys as they are: no place
of a short item is lost.

Every word of every document begins a window. Long items are walked from several places, so that windows
of any item's size are met by some part of it, and a hit is verified over the whole item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import buffers, mixed, slices, word_hashes

EDITS = 0.2  # of an item's words
WALKS, SAMPLES, DRAWN = 3, 3, 6
STEPS = 12  # of a walk
SHORT = 24  # items of fewer words are found by their pieces
STRIDE = 4
#: Items sent to every executor at once; larger benchmarks are worked off in blocks.
BLOCK_ITEMS = 20_000
FILTER_BITS = 18
_SEED = 20240229


class Index:
    """The items' words and, for each table, the sorted keys of their walks."""

    def __init__(self, ids: list, texts: list):
        words, _, counts = word_hashes(*buffers(pa.array(texts, pa.string())))
        self.ids, self.words = [], []
        for i, item in enumerate(ids):
            own = words[counts[i]:counts[i + 1]]
            if len(own):
                self.ids.append(item)
                self.words.append(own)
        self.lists = [w.tolist() for w in self.words]
        rng = np.random.default_rng(_SEED)
        self.tables = []  # (steps, walk, [(drawn steps, multipliers, filter, keys, item, offset)])
        sizes = [len(w) for w in self.words]
        walked = [(i, o) for i, n in enumerate(sizes) if n >= SHORT
                  for o in sorted({*range(0, n - STEPS + 1, STRIDE), n - STEPS})]
        seeds = rng.integers(1, 1 << 63, WALKS, dtype=np.uint64)
        drawn = [[np.sort(rng.choice(STEPS, DRAWN, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        factors = rng.integers(1, 1 << 63, (WALKS, SAMPLES, STEPS), dtype=np.uint64) | np.uint64(1)
        for w in range(WALKS):
            self._add(STEPS, seeds[w], [(drawn[w][s], factors[w, s]) for s in range(SAMPLES)], walked)
        lengths = [n // (int(EDITS * n) + 1) if n < SHORT else 0 for n in sizes]
        for steps in sorted(set(lengths) - {0}):
            pieces = [(i, o * steps) for i, n in enumerate(lengths) if n == steps for o in range(int(EDITS * sizes[i]) + 1)]
            self._add(steps, None, [(np.arange(steps), factors[0, 0])], pieces)

    def _add(self, steps: int, seed, plan: list, starts: list[tuple[int, int]]) -> None:
        """A table for each (drawn steps, multipliers) of ``plan`` of the walks from ``starts`` (item, offset)."""
        if not starts:
            return
        base = np.cumsum([0] + [len(w) for w in self.words])
        at = np.array([base[i] + o for i, o in starts])
        item = np.array([i for i, _ in starts])
        offset = np.array([o for _, o in starts])
        found = []
        for (d, f), keys in zip(plan, walk_keys(np.concatenate(self.words), seed, steps, plan, at), strict=True):
            order = np.argsort(keys, kind="stable")
            cells = np.zeros(1 << FILTER_BITS, dtype=bool)
            cells[keys >> np.uint64(64 - FILTER_BITS)] = True
            found.append((d, f, cells, keys[order], item[order], offset[order]))
        self.tables.append((steps, seed, found))


def walk_keys(words, seed, steps: int, plan, at: np.ndarray | None = None) -> list[np.ndarray]:
    """For each (drawn steps, multipliers) of ``plan`` the keys of the walks that start at every word
    (or at the places ``at``): sums of the drawn words, each times its step's multiplier. Without a
    ``seed`` every step moves on."""
    n = len(words)
    padded = np.concatenate((words, np.zeros(steps, np.uint64)))
    bits = None if seed is None else mixed(padded ^ seed)
    here = np.arange(n) if at is None else np.array(at)
    keys = [np.zeros(len(here), dtype=np.uint64) for _ in plan]
    for step in range(steps):
        seen = padded[here] if any(step in d for d, _ in plan) else None
        for key, (drawn, factors) in zip(keys, plan, strict=True):
            if step in drawn:
                key += seen * factors[step]
        here += 1 if bits is None else ((bits >> np.uint64(step)) & np.uint64(1)).astype(np.int8)[here]
    return [mixed(k) for k in keys]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance in words between ``item`` and any part of ``text``, and that part
    (start, end): bit-parallel, in Python integers of the item's length."""

    def run(pattern, words, most=None):
        masks: dict[int, int] = defaultdict(int)
        for i, w in enumerate(pattern):
            masks[w] |= 1 << i
        m = len(pattern)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, at = full, 0, m, m, 0
        for j, w in enumerate(words):
            eq = masks.get(w, 0)
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            hp, hm = (minus | ~(d | plus)) & full, plus & d
            score += 1 if hp & top else -1 if hm & top else 0
            hp, hm = ((hp << 1) | (most is not None)) & full, (hm << 1) & full
            plus, minus = (hm | ~(x | hp)) & full, hp & x
            if score < best:
                best, at = score, j + 1
                if most is not None and best <= most:
                    break
        return best, at

    forward, backward = item.tolist(), item[::-1].tolist()
    edits, end = run(forward, text.tolist())
    _, length = run(backward, text[:end][::-1].tolist(), most=edits)
    return edits, end - length, end


def _hits(index: Index, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word) of every verified place."""
    found = []
    for steps, seed, tables in index.tables:
        for (_, _, cells, keys, item, offset), own in zip(
                tables, walk_keys(words, seed, steps, [(t[0], t[1]) for t in tables]), strict=True):
            at = np.flatnonzero(cells[own >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(keys, own[at]), np.searchsorted(keys, own[at], "right")
            hit = np.flatnonzero(high > low)
            for k in hit:
                span = slice(low[k], high[k])
                found.append(np.stack([np.full(high[k] - low[k], at[k]), item[span], offset[span]]))
    if not found:
        return []
    place, item, offset = np.concatenate(found, axis=1)
    row = np.searchsorted(counts, place, "right") - 1
    begin = place - offset
    order = np.lexsort((begin, item, row))
    out, last = [], None
    for k in order:
        r, i, b = int(row[k]), int(item[k]), int(begin[k])
        if last is not None and last[:2] == (r, i) and b <= last[2]:
            continue  # the same place, reached from another part of the item
        n = len(index.words[i])
        slack = int(EDITS * n)
        low, high = max(int(counts[r]), b - slack), min(int(counts[r + 1]), b + n + 2 * slack)
        text = words[low:high]
        seen = set(text.tolist())
        if sum(w in seen for w in index.lists[i]) < n - slack:  # more words are missing than may be edited
            last = (r, i, b)
            continue
        edits, start, end = best_match(index.words[i], text)
        if edits <= slack:
            out.append((r, i, edits, low + start, low + end))
            last = (r, i, low + end - 1)
        else:
            last = (r, i, b)
    return sorted(set(out))


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size, each of which may be sent to the executors."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(
        F.col("text").isNotNull())
    many = max(1, -(-items.count() // BLOCK_ITEMS))
    for block in range(many):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == block).collect()
        rows.sort(key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"]))
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def _marked(docs: DataFrame, ids: list, texts: list, keep: list[str], hits: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
    schema = docs.select(*[f"`{c}`" for c in keep]).schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = buffers(part.column("text"))
                words, first, counts = word_hashes(data, at)
                per: list[list] = [[] for _ in range(part.num_rows)]
                for r, i, edits, start, end in _hits(index, words, counts):
                    to = int(first[end - 1])
                    rest = data[to:int(at[r + 1])]
                    gap = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
                    to += int(gap[0]) if len(gap) else len(rest)
                    chars = [int(((data[int(at[r]):x] & 0xC0) != 0x80).sum()) for x in (int(first[start]), to)]
                    per[r].append({"item_id": index.ids[i], "edits": edits, "start": chars[0], "stop": chars[1]})
                yield pa.record_batch(
                    [part.column(c) for c in keep] + [pa.array(per, kind)], names=[*keep, hits])

    found = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
                          T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    return docs.mapInArrow(run, schema.add(hits, T.ArrayType(found)))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, stop``: every place (code points, from 0, end excluded) of
    ``docs`` (``doc_id, text``) that lies within an edit distance, in words, of a fifth of the words
    of an item of ``benchmark`` (``item_id, text``); ASCII case and white space do not count.

    A place is reported once for each item, at its best alignment; repeated rows report each for
    itself. Null texts, texts and items without words match nothing; items of fewer than five words
    must match exactly. Other columns are not used. No rows on either side, no result. Items of fewer
    than 24 words are found wherever they are; for longer ones tables are chosen for a recall above
    0.95 at the limit of edits and of about 1 for few edits.
    """
    out = None
    for ids, texts in _blocks(benchmark):
        part = _marked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids, texts, ["doc_id"], "hits")
        part = part.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item of ``benchmark``."""
    columns, hits = docs.columns, "hits"
    while hits in columns:
        hits += "_"
    for ids, texts in _blocks(benchmark):
        docs = _marked(docs, ids, texts, columns, hits).filter(F.size(hits) == 0).drop(hits)
    return docs
