"""Byte-level BPE: texts to token ids and back.

A text is cut into pre-tokens by a pattern, and each distinct pre-token is looked up twice at most:

1. A minimal perfect hash over the vocabulary (levels of bit arrays in which each key that stands alone
   in its cell keeps it, the others going on to the next level; the rank of the bit is the slot)
   resolves pre-tokens that are tokens as a whole, a batch of them at once.
2. The others are merged from single bytes: neighbouring parts are linked, a heap gives the pair of
   the least rank, leftmost first, and a merge puts the two pairs around it back on the heap.

The vocabulary is a file of fixed size, read by the driver and broadcast. Texts are worked off in
slices of a few megabytes. Most text repeats, so the ids of what stands between two spaces are
remembered; what is remembered is bounded, and forgetting it changes no result.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mixed, slices
from .store import packed

SLICE = 1 << 21  # bytes of text, or ids, worked off at once
REMEMBERED = 1 << 18  # chunks, and 64 times as many characters of them
_LEVEL = 0x9E3779B97F4A7C15


class PerfectHash:
    """A slot of its own in ``0 .. n - 1`` for each of ``n`` distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.size = len(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits, slot of each bit that is set
        slots, left = 0, keys
        while len(left):
            cells = self._cells(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(cells, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, (slots - 1 + np.cumsum(alone)).astype(np.int32)))
            slots += int(alone.sum())
            left = left[~alone[cells]]

    @staticmethod
    def _cells(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mixed(keys + np.uint64(_LEVEL * (level + 1) % (1 << 64))) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for what is no key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, slot) in enumerate(self.levels):
            cells = self._cells(keys[open_], level, len(bits))
            here = bits[cells]
            out[open_[here]] = slot[cells[here]]
            open_ = open_[~here]
        return out


class Vocabulary:
    """Tokens as bytes with their ids, which are their merge ranks too. All single bytes are tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        lacking = [i for i in range(256) if bytes([i]) not in ranks]
        if lacking or len(set(ranks.values())) != len(ranks) or min(ranks.values()) < 0:
            raise ValueError("a vocabulary needs all single bytes and one id from 0 for each token")
        self.ranks = ranks
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.two = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.following, self.preceding = list(range(1, 257)), list(range(-1, 255))  # links of a fresh piece
        tokens = list(ranks)
        for self.seed in range(64):  # another seed where two tokens share a hash
            keys = self._keys(tokens)
            if len(np.unique(keys)) == len(keys):
                break
        self.hash = PerfectHash(keys)
        slots = self.hash.slots(keys)
        self.tokens: list[bytes] = [b""] * len(tokens)
        self.ids = np.zeros(len(tokens), dtype=np.int32)
        for token, slot in zip(tokens, slots.tolist(), strict=True):
            self.tokens[slot] = token
            self.ids[slot] = ranks[token]
        most = max(ranks.values()) + 1  # for decoding: the bytes of all ids in a row
        sizes = np.full(most, -1, dtype=np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        self.sizes = sizes
        self.starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
        by_id = {i: token for token, i in ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), dtype=np.uint8)

    def _keys(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(p, self.seed) for p in pieces), np.uint64, len(pieces))

    def whole(self, pieces: list[bytes]) -> list[int]:
        """The id of each piece that is a token as a whole; -1 for the others."""
        if not pieces:
            return []
        found = []
        for piece, slot in zip(pieces, self.hash.slots(self._keys(pieces)).tolist(), strict=True):
            found.append(int(self.ids[slot]) if slot >= 0 and self.tokens[slot] == piece else -1)
        return found

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece by merges of least rank, leftmost first."""
        rank_of, two, pop, push = self.ranks.get, self.two, heapq.heappop, heapq.heappush
        n = len(piece)
        if n > len(self.following):
            self.following, self.preceding = list(range(1, 2 * n)), list(range(-1, 2 * n - 2))
        ids = [self.single[b] for b in piece]  # of the part that begins at each byte
        after, before = self.following[:n], self.preceding[:n]
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of a part with the next one
        heap = [rank * n + i for i, rank in enumerate(pair) if rank >= 0]
        pair.append(-1)
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(pop(heap), n)
            if pair[i] != rank:
                continue  # a part of this pair has been merged since
            gone = after[i]
            stop = after[i] = after[gone]
            ids[i], pair[gone] = rank, -1
            if stop < n:
                before[stop] = i
                rank = pair[i] = rank_of(piece[i:after[stop]], -1)
                if rank >= 0:
                    push(heap, rank * n + i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                rank = pair[left] = rank_of(piece[left:stop], -1)
                if rank >= 0:
                    push(heap, rank * n + left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class _Chunks(dict):
    """Number of each chunk met so far, and their ids in a row; new chunks wait to be resolved.

    A chunk is the text between two single spaces that stand between other than white space. A
    pattern match never goes on over such a space, and the space begins the next match, so a chunk
    has the same pre-tokens wherever it stands. The first chunk of a text lacks the space; its key
    is a tuple.
    """

    def __init__(self, pattern: str, vocabulary: Vocabulary):
        super().__init__()
        self.find, self.vocabulary = regex.compile(pattern).findall, vocabulary
        others, found, _ = pattern.partition(r"| ?\p{L}+|")
        self.words = bool(found) and all(x.startswith("'") for x in others.split("|"))
        self.new: list[str] = []
        self.chars = 0
        self.flat, self.begin = array("i"), array("q", [0])
        self.ids: dict[str, list[int]] = {}  # of pre-tokens

    def __missing__(self, chunk) -> int:
        number = self[chunk] = len(self)
        text = chunk[0] if isinstance(chunk, tuple) else " " + chunk
        self.new.append(text)
        self.chars += len(text)
        return number

    def _pieces(self, text: str) -> list[str]:
        if self.words and text.isascii() and text[0] == " ":
            if text[1:].isalpha():  # a space and letters: one match
                return [text]
            if text[-1] in ",.;:!?" and text[1:-1].isalpha():  # and a sign: two
                return [text[:-1], text[-1]]
        return self.find(text)

    def resolve(self) -> None:
        known, split = self.ids, [self._pieces(text) for text in self.new]
        fresh = list({p for pieces in split for p in pieces if p not in known})
        raw = [p.encode() for p in fresh]
        for piece, data, found in zip(fresh, raw, self.vocabulary.whole(raw), strict=True):
            known[piece] = [found] if found >= 0 else self.vocabulary.merged(data)
        flat, begin = self.flat, self.begin
        for pieces in split:
            for piece in pieces:
                flat.extend(known[piece])
            begin.append(len(flat))
        self.new = []

    def full(self) -> bool:
        return len(self) > REMEMBERED or self.chars > 64 * REMEMBERED


_cut = re.compile(r"(?<=\S) (?=\S)")
_odd = re.compile(r" \s|\s |\A | \Z")


def _chunk_keys(text: str) -> Iterator[list]:
    """Keys of all chunks of a text, in stretches of bounded size."""
    at = 0
    while at < len(text):
        stretch = _cut.search(text, at + SLICE) if len(text) - at > SLICE else None
        part = text[at:stretch.start()] if stretch else text[at:]
        keys = _cut.split(part) if _odd.search(part) else part.split(" ")
        if at == 0:
            keys[0] = (keys[0],)
        yield keys
        at += len(part) + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` of all ``i`` in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _encoded(texts: pa.Array, chunks: _Chunks) -> pa.Array:
    number, none = chunks.__getitem__, np.zeros(0, np.int64)
    places = [np.concatenate([none, *(np.fromiter(map(number, keys), np.int64, len(keys)) for keys in _chunk_keys(t or ""))])
              for t in texts.to_pylist()]
    chunks.resolve()
    flat, begin = np.array(chunks.flat, dtype=np.int32), np.array(chunks.begin, dtype=np.int64)
    offsets, parts = [0], []
    for own in places:  # text by text, so that working arrays stay small
        ids = flat[_spread(begin[own], begin[own + 1] - begin[own])]
        parts.append(ids)
        offsets.append(offsets[-1] + len(ids))
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file (a token in base64 and its rank on each line), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``doc, ids``: all (or the kept) columns of ``docs`` and the token ids of column ``text``.

    Null and empty texts have no ids. Rows stay as they are, repeated ones too; no rows, no result.
    Control strings in a text are ordinary text. A text may be of any length; it needs four bytes a
    token beside itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    rows = docs.select(packed(docs, keep), F.col("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(pattern, shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if chunks.full():
                    chunks = _Chunks(pattern, shared.value)
                ids = _encoded(part.column("text"), chunks)
                yield pa.record_batch([part.column("doc"), ids], names=["doc", "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (any columns and ``ids``) with column ``bytes``, the bytes of the ids in a row.

    Null ids count as none at all, an empty list. An id that no token has is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    names = [c for c in encoded.columns if c != "bytes"]
    rows = encoded.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            out = []
            for ids in batch.column(batch.schema.get_field_index("ids")):
                ids = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.sizes)):
                    raise ValueError("an id that no token has")
                parts = []
                for at in range(0, len(ids), SLICE):
                    own = ids[at:at + SLICE]
                    sizes = vocabulary.sizes[own]
                    if len(sizes) and sizes.min() < 0:
                        raise ValueError("an id that no token has")
                    parts.append(vocabulary.bytes[_spread(vocabulary.starts[own], sizes)].tobytes())
                out.append(b"".join(parts))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*names, "bytes"])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs`` (``doc_id, text``):
    its ids are worked out, and its bytes are read back from them."""
    back = decode(encode(docs, ranks, pattern, keep=["doc_id"]), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select(
        F.col("doc.doc_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
