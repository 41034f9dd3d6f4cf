"""Byte-level BPE encoding and decoding (operator 3).

Two tiers. A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash (hash,
displace, verify the bytes), for a whole piece at once. Only the others are merged: a heap of pairs by rank
over a linked list of bytes, O(n log n) for a pre-token of n bytes, once per different pre-token of a piece (told
apart by their bytes) that is not among those remembered, a table of fixed size.

Pre-tokens follow the pattern published with the vocabulary,
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; their borders are
computed from character classes rather than by running the expression.

The vocabulary is a file of ranks given by path; workers load it once. Everything is per row, so there is
no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quadrille.llm.npx import U, column_bytes, mix, pieces, ragged, span_names
from quadrille.llm.remote import remote

SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SLOTS = 1 << 18  # merged pre-tokens to remember, of this many bytes and ids each
LONGEST, MOST_IDS = 32, 12
PIECE = 1 << 18  # bytes of texts to encode at once


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, everything):
            table[points[m.start()] : points[m.end() - 1] + 1] = value
    table[0xD800:0xE000] = OTHER
    table[SPACES] = SPACE
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of the pre-tokens of UTF-8 texts laid end to end, and how many each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b0 = data[at].astype(np.int32)
    point = b0.copy()
    size = np.diff(np.append(at, n))
    for k, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        some = np.flatnonzero(size == k)
        value = b0[some] & mask
        for j in range(1, k):
            value = (value << 6) | (data[at[some] + j] & 0x3F)
        point[some] = value
    kind = classes()[np.minimum(point, 0x10FFFF)]
    m = len(at)
    border = np.zeros(m + 1, bool)
    border[np.searchsorted(at, offsets)] = True  # a text begins here, or the last one ends
    run = border[:m].copy()
    run[1:] |= kind[1:] != kind[:-1]
    solid = kind != SPACE
    blank = np.zeros(m, bool)  # after a U+0020 of the same text
    blank[1:] = (point[:-1] == 32) & ~border[1:m]
    start = run & ~(solid & blank)
    ends_blank = np.zeros(m, bool)  # the last white space before something else in the same text
    ends_blank[:-1] = ~solid[:-1] & solid[1:] & ~border[1:m]
    start |= ends_blank
    quote = np.flatnonzero((point == 39) & run & ~blank)
    quote = quote[(quote + 1 < m) & ~border[np.minimum(quote + 1, m)]]
    if len(quote):
        one = point[quote + 1]
        two = np.where((quote + 2 < m) & ~border[np.minimum(quote + 2, m)], point[np.minimum(quote + 2, m - 1)], 0)
        length = np.zeros(len(quote), np.int64)
        length[np.isin(one, [ord(c) for c in "stmd"])] = 1
        for a, b in ("re", "ve", "ll"):
            length[(one == ord(a)) & (two == ord(b))] = 2
        found = quote[length > 0]
        length = length[length > 0]
        start[found + 1] = False
        rest = found + 1 + length
        start[rest[rest < m]] = True
    where = at[start]
    return where, np.diff(np.searchsorted(where, offsets))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = after[i]
        if end[i] < 0 or j >= n or end[j] != e:
            continue  # one of its symbols was merged meanwhile
        end[i], end[j] = e, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:e])) is not None:
            heappush(heap, (r, h, e))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class PerfectHash:
    """Minimal perfect hash of n keys given by two 64-bit hashes: hash and displace.

    Buckets are placed from the largest; each stores the displacement that puts its keys on free slots, and
    a bucket of one key stores its slot itself (as -1 - slot).
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray) -> None:
        self.n, self.buckets = len(h1), max(1, len(h1) // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        self.key = np.zeros(self.n, np.int64)
        bucket = (h1 % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(first)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            # all buckets of one size at once: each tries its next displacement until its slots are free
            open_ = np.flatnonzero(sizes == size)
            d = 0
            while len(open_):
                members = order[first[open_][:, None] + np.arange(size)]
                slots = self.slots(h2[members], d)
                flat = slots.ravel()
                _, seen = np.unique(flat, return_index=True)
                new = np.zeros(len(flat), bool)
                new[seen] = True
                good = (new & ~taken[flat]).reshape(slots.shape).all(axis=1)
                self.shift[open_[good]] = d
                taken[slots[good].ravel()] = True
                self.key[slots[good].ravel()] = members[good].ravel()
                open_ = open_[~good]
                d += 1
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.shift[single] = -1 - free
        self.key[free] = order[first[single]]

    def slots(self, h2: np.ndarray, d) -> np.ndarray:
        moved = mix(h2 + np.asarray(d).astype(U) * U(0x9E3779B97F4A7C15))
        return (moved % U(self.n)).astype(np.int64)

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The only key that each can be."""
        d = self.shift[(h1 % U(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self.slots(h2, np.maximum(d, 0)))
        return self.key[slot]


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each content, and which of those each span equals. Names propose, bytes decide."""
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    lengths, like = end - start, first[which]
    same = lengths == lengths[like]
    some = np.flatnonzero(same & (like != np.arange(len(start))))
    if len(some):
        sizes = lengths[some]
        inner = ragged(sizes)
        differ = data[np.repeat(start[some], sizes) + inner] != data[np.repeat(start[like[some]], sizes) + inner]
        same[some] = np.add.reduceat(differ, np.cumsum(sizes) - sizes) == 0
    odd = np.flatnonzero(~same)
    if len(odd):  # two contents of one name
        places: dict[bytes, int] = {}
        more = []
        for k, s, e in zip(odd.tolist(), start[odd].tolist(), end[odd].tolist()):
            piece = data[s:e].tobytes()
            if piece not in places:
                places[piece] = len(first) + len(more)
                more.append(k)
            which[k] = places[piece]
        first = np.append(first, more)
    return first, which


class Merged:
    """Ids of pre-tokens merged before, in arrays that never grow. The name chooses the slot, bytes decide; the last one stays."""

    def __init__(self) -> None:
        self.size = np.zeros(SLOTS, np.uint8)  # bytes; none are free slots
        self.count = np.zeros(SLOTS, np.uint8)
        self.piece = np.zeros((SLOTS, LONGEST // 8), np.uint64)
        self.ids = np.zeros((SLOTS, MOST_IDS), np.int32)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray, ranks: dict[bytes, int]):
        """All ids of the different pre-tokens of ``data``, and how many each has."""
        reach = start[:, None] + np.arange(LONGEST)
        padded = np.where(reach < end[:, None], data[np.minimum(reach, len(data) - 1)], 0).astype(np.uint8).view(np.uint64)
        slot, length = (names % U(SLOTS)).astype(np.int64), end - start
        found = (self.size[slot] == length) & (self.piece[slot] == padded).all(axis=1)
        sizes = np.where(found, self.count[slot], 0).astype(np.int64)
        rest = np.flatnonzero(~found)
        merged = [merge(data[s:e].tobytes(), ranks) for s, e in zip(start[rest].tolist(), end[rest].tolist())]
        sizes[rest] = np.fromiter(map(len, merged), np.int64, len(merged))
        flat, to = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for some, values in ((np.flatnonzero(found), None), (rest, [i for ids in merged for i in ids])):
            inner = ragged(sizes[some])
            flat[np.repeat(to[some], sizes[some]) + inner] = self.ids[np.repeat(slot[some], sizes[some]), inner] if values is None else values
        new = rest[(length[rest] <= LONGEST) & (sizes[rest] <= MOST_IDS)]
        new = new[np.unique(slot[new], return_index=True)[1]]
        self.size[slot[new]], self.count[slot[new]], self.piece[slot[new]] = length[new], sizes[new], padded[new]
        inner = ragged(sizes[new])
        self.ids[np.repeat(slot[new], sizes[new]), inner] = flat[np.repeat(to[new], sizes[new]) + inner]
        return flat, sizes


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in tokens], np.int32)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum([0, *map(len, tokens)])
        self.size = np.diff(self.at)
        self.place = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(tokens))
        self.hash = PerfectHash(*self._hashes(self.blob, self.at[:-1], self.at[1:]))
        self.merged = Merged()

    @staticmethod
    def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(span_names(data, start, end, k) for k in range(2))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, and how many each has. Copies that follow one another are encoded once."""
        if len(column) > 1:
            same = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            if same.any():
                new = np.append(True, ~same)
                ids, sizes = self.encode(column.filter(pa.array(new)))
                which = np.cumsum(new) - 1
                counts = sizes[which]
                return ids[np.repeat((np.cumsum(sizes) - sizes)[which], counts) + ragged(counts)], counts
        data, offsets = column_bytes(column)
        start, per_text = pretokens(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), per_text
        end = np.append(start[1:], len(data))
        h1, h2 = self._hashes(data, start, end)
        key = self.hash.lookup(h1, h2)
        known = self.size[key] == end - start
        # compare the bytes of those whose length fits
        fit = np.flatnonzero(known)
        lengths = self.size[key[fit]]
        inner = ragged(lengths)
        same = data[np.repeat(start[fit], lengths) + inner] == self.blob[np.repeat(self.at[key[fit]], lengths) + inner]
        known[fit] = np.add.reduceat(~same, np.cumsum(lengths) - lengths) == 0 if len(fit) else True
        miss = np.flatnonzero(~known)
        counts = np.ones(len(start), np.int64)
        if len(miss):
            first, which = _distinct(data, start[miss], end[miss], h1[miss])
            one = miss[first]
            flat, sizes = self.merged.encode(data, start[one], end[one], h1[one], self.ranks)
            counts[miss] = sizes[which]
        to = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[to[known]] = self.ids[key[known]]
        if len(miss):
            lengths = counts[miss]
            inner = ragged(lengths)
            source = (np.cumsum(sizes) - sizes)[which]
            out[np.repeat(to[miss], lengths) + inner] = flat[np.repeat(source, lengths) + inner]
        total = np.append(0, np.cumsum(counts))
        text = np.append(0, np.cumsum(per_text))
        return out, total[text[1:]] - total[text[:-1]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids laid end to end, and the length of each id's bytes."""
        place = self.place[ids]
        if (place < 0).any():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.size[place]
        return self.blob[np.repeat(self.at[place], lengths) + ragged(lengths)], lengths


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(batches, path: str, text: str, proof: bool):
    words = vocabulary(path)
    for batch in pieces(batches, text, PIECE):
        ids, counts = words.encode(batch.column(text))
        at = np.append(0, np.cumsum(counts))
        # copies, as a slice would hold the memory of all the texts that it came with
        arrays = {c: batch.column(c).take(pa.array(np.arange(batch.num_rows))) for c in batch.schema.names if c != text}
        del batch
        arrays["token_ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
        if proof:
            arrays["n_tokens"] = pa.array(counts, pa.int64())
            arrays["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in _texts(words, ids, at)])
        yield pa.RecordBatch.from_pydict(arrays)


def _texts(words: Vocabulary, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw, lengths = words.decode(ids)
    where = np.append(0, np.cumsum(lengths))[at]
    raw = raw.tobytes()
    return [raw[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]


def _decode(batches, path: str):
    words = vocabulary(path)
    for batch in batches:
        column = batch.column("token_ids")
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        arrays = dict(zip(batch.schema.names, batch.columns))
        arrays["decoded"] = pa.array(_texts(words, column.flatten().to_numpy(), np.append(0, np.cumsum(counts))), pa.binary())
        yield pa.RecordBatch.from_pydict(arrays)


def _round_trip(batches, path: str):
    words = vocabulary(path)
    for batch in pieces(batches, "text", PIECE):
        ids, counts = words.encode(batch.column("text"))
        at = np.append(0, np.cumsum(counts))
        stored = ids.astype("<u4").tobytes()
        spans = zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(stored[a:b]).hexdigest() for a, b in spans]),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in _texts(words, ids, at)]),
            }
        )


def _schema(df: DataFrame, drop: str, *extra: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != drop]
    return ", ".join([*kept, *extra])


def encode(docs: DataFrame, path: str, text_col: str = "text", proof: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) in place of the text column; a null text has no ids.

    With ``proof`` also n_tokens, and decoded_sha256 of the bytes that the ids decode to. Texts are encoded as ordinary
    text, without special tokens. Rows are independent: repeated rows and empty tables need no care. Existing columns of
    those names are replaced.
    """
    new = ["token_ids array<int>", *(["n_tokens long", "decoded_sha256 string"] if proof else [])]
    rows = docs.drop(*({x.split()[0] for x in new} - {text_col}))
    return rows.mapInArrow(remote(__name__, "_encode", path=path, text=text_col, proof=proof), _schema(rows, text_col, *new))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with the decoded bytes (``decoded``, binary) of ``token_ids``; null ids decode to nothing."""
    rows = tokens.drop("decoded")
    return rows.mapInArrow(remote(__name__, "_decode", path=path), _schema(rows, "decoded", "decoded binary"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids (little-endian, 32 bits) and of the bytes they decode to.

    Encodes and decodes in one pass, so the ids of a partition are never held together.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts.mapInArrow(remote(__name__, "_round_trip", path=path), shape)
