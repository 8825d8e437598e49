"""Word shingles of whole texts as sorted 64-bit hashes, with numpy inside tasks.

Words are runs of anything but ASCII white space, compared with A-Z in lower case. Texts are read
straight from Arrow buffers in chunks of a few megabytes cut between words, so memory stays bounded
for texts of any length but for eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Odd multipliers for the places in a shingle.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                    0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 65536)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


def is_gap(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of each word, and for each text the number of words before it."""
    hashes, firsts, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + CHUNK, end)
        while stop < end:  # on to the next gap or the next text
            limit = int(offsets[np.searchsorted(offsets, stop)])
            gaps = np.flatnonzero(is_gap(data[stop:min(limit, stop + 65536)]))
            if len(gaps):
                stop += int(gaps[0])
                break
            stop = min(limit, stop + 65536)
            if stop == limit:
                break
        b = data[at:stop]
        n, word = len(b), ~is_gap(b)
        power, inverse = _power_tables(n + 1)
        edge = np.zeros(n + 1, dtype=bool)
        inner = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop, "right")] - at
        edge[inner] = True
        edge[0] = edge[n] = True
        before = np.concatenate(([False], word[:-1]))
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate((word[1:], [False]))
        last = np.flatnonzero(word & (~after | edge[1:])) + 1
        low = b + np.where((b >= 65) & (b <= 90), np.uint8(32), np.uint8(0))
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        h = (sums[last] - sums[start]) * inverse[start]
        hashes.append(mixed(h + (last - start).astype(np.uint64)))
        firsts.append(start + at)
        at = stop
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), first, np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and where each text's begin (repeats included). A text
    of fewer words has one shingle, its whole sequence."""
    n = len(words)
    rolled = np.zeros(max(n - WORDS + 1, 0), dtype=np.uint64)
    for i in range(WORDS):
        rolled += words[i:i + len(rolled)] * _PLACES[i]
    rolled = mixed(rolled + np.uint64(WORDS))
    size = np.diff(counts)
    many = np.where(size >= WORDS, size - WORDS + 1, (size > 0).astype(size.dtype))
    begin = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(int(begin[-1]), dtype=np.uint64)
    long = size >= WORDS
    if long.any():
        take = np.ones(n + 1, dtype=np.int8)  # a word starts a shingle unless its text ends too soon
        for i in range(1, WORDS):
            ends = counts[1:][size >= i] - i
            take[ends] = 0
        take[n] = 0
        picked = rolled[np.flatnonzero(take[:len(rolled)])] if len(rolled) else rolled
        out[np.repeat(long, many)] = picked
    for d in np.flatnonzero((size > 0) & ~long):
        w = words[counts[d]:counts[d + 1]]
        out[begin[d]] = mixed(np.array([(w * _PLACES[:len(w)]).sum(dtype=np.uint64)], dtype=np.uint64) + np.uint64(len(w)))[0]
    return out, begin


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of ``column``, one row at least."""
    _, at = buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(int(np.searchsorted(at, at[row] + most)), row + 1)
        yield batch.slice(row, min(stop, batch.num_rows) - row)
        row = stop


def text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a column of texts and where each text's begin."""
    hashes, _, counts = word_hashes(*buffers(texts))
    return shingle_hashes(hashes, counts)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), type=pa.int64())


def list_column(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, type=pa.int32()), as_long(values))
