"""Suffix-array dedup by the interval tree of common prefixes (operator 6).

A repeated string of ``size`` bytes is found in the suffixes that start with it. Those suffixes are put into
one bucket without comparing all with all: by the string's minimizer, its n-gram of least hash, which equal
strings have at the same place. Only minimizers that occur twice need a suffix array at all.

1. Every text's minimizers, (gram, doc_id, pos), are shuffled once; a stream over the sorted rows keeps
   the grams seen twice.
2. Each kept occurrence sends its context (all windows that it is the minimizer of) to the gram's bucket.
   Equal contexts lie side by side after the sort and collapse to the first.
3. In a bucket, the suffixes that share their first ``size`` bytes are sorted to an enhanced suffix array
   (suffixes and the lengths of common prefixes). A stack scan yields the intervals of common prefixes, that is the
   nodes of the suffix tree; those whose members have different bytes on their left are the maximal repeats.
   Each gives its whole group of occurrences, and all but the earliest lose the repeat.
4. A bucket with more different contexts than fit in a block is split by what its strings have in common besides the
   gram: those with the gram in their first half share the bytes that follow it, the others the bytes before it. The
   parts are buckets like any other and go through 3 again, at most seven times over.

Texts that equal a smaller doc_id's collapse before this.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.npx import POLY, U, column_bytes, grams, mix, pieces, ragged, signed, sliding_argmin
from quadrille.llm.remote import remote
from quadrille.llm.rows import shuffled_once
from quadrille.session import ensure_checkpoint_dir

GRAM = 24
BLOCK = 1 << 20  # bytes of contexts to gather for suffix arrays
PIECE = 1 << 19


def _facts(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(list(map(len, texts)), pa.int64()),
                "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            }
        )


class _Anchored:
    """The byte windows of a batch of texts and their minimizers."""

    def __init__(self, column: pa.Array, size: int) -> None:
        self.data, self.offsets = column_bytes(column)
        gram = min(GRAM, size)
        self.grams = grams(self.data, gram)
        self.best = sliding_argmin(self.grams, size - gram + 1)
        row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(self.offsets))
        self.inside = row[: len(self.best)] == row[size - 1 :] if len(self.best) else np.zeros(0, bool)
        self.row = row


def _occurrences(batches, size: int):
    for batch in pieces(batches, "text", PIECE):
        found = _Anchored(batch.column("text"), size)
        best = found.best[found.inside]
        at = best[np.append(True, best[1:] != best[:-1])] if len(best) else best
        rows = found.row[at]
        yield pa.RecordBatch.from_pydict(
            {
                "gram": pa.array(signed(found.grams[at])),
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "pos": pa.array((at - found.offsets[rows]).astype(np.int32)),
            }
        )


def _repeated(batches):
    """(doc_id, pos) of grams that occur twice or more; rows come sorted by gram. State: the row before."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, ids, pos = (batch.column(c).to_numpy() for c in ("gram", "doc_id", "pos"))
        if held is not None:
            gram, ids, pos = np.append(held[0], gram), np.append(held[1], ids), np.append(held[2], pos)
        same = gram[1:] == gram[:-1]
        keep = np.append(same, False) | np.append(False, same)
        if held is not None:
            keep[0] &= not held[3]  # sent already with its predecessor
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[keep]), "pos": pa.array(pos[keep])})
        sent = bool(keep[-1]) or (len(gram) == 1 and held is not None and held[3])
        held = gram[-1], ids[-1], pos[-1], sent


def _contexts(batches, size: int):
    """Per kept occurrence: the gram, its place among the context's windows, and the context."""
    for batch in pieces(batches, "text", PIECE):
        found = _Anchored(batch.column("text"), size)
        places = batch.column("places")
        lengths = places.value_lengths().to_numpy(zero_copy_only=False)
        wanted = np.zeros(len(found.grams) + 1, bool)
        wanted[places.flatten().to_numpy(zero_copy_only=False) + np.repeat(found.offsets[:-1], lengths)] = True
        at = np.flatnonzero(found.inside & wanted[found.best])
        if not len(at):
            continue
        best = found.best[at]
        new = np.append(True, (best[1:] != best[:-1]))
        lo, hi = at[new], at[np.append(new[1:], True)]
        rows = found.row[lo]
        raw = found.data.tobytes()
        yield pa.RecordBatch.from_pydict(
            {
                "gram": pa.array(signed(found.grams[best[new]])),
                "lead": pa.array((best[new] - lo).astype(np.int32)),
                "context": pa.array([raw[a : b + size] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()),
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "start": pa.array((lo - found.offsets[rows]).astype(np.int32)),
            }
        )


def suffix_array(data: np.ndarray, suffix: np.ndarray, end: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """The order of suffixes by bucket, then by their bytes (to ``end``, ``width`` at most)."""
    words = -(-width // 8)
    reach = suffix[:, None] + np.arange(8 * words)
    block = np.where(reach < end[:, None], data[np.minimum(reach, len(data) - 1)], 0).astype(np.uint8)
    keys = block.reshape(len(suffix), words, 8).view(">u8")[:, :, 0].astype(np.uint64)
    return np.lexsort([*(keys[:, k] for k in range(words - 1, -1, -1)), bucket])


def common_prefixes(data: np.ndarray, suffix: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before; 0 for the first."""
    out = np.zeros(len(suffix), np.int64)
    if len(suffix) < 2:
        return out
    most = np.minimum(np.minimum(end[1:] - suffix[1:], end[:-1] - suffix[:-1]), width)
    reach = np.arange(width)
    last = len(data) - 1
    differ = data[np.minimum(suffix[1:, None] + reach, last)] != data[np.minimum(suffix[:-1, None] + reach, last)]
    out[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), most)
    return out


def intervals(lcp: np.ndarray, least: int):
    """(length, lo, hi): the nodes of the interval tree with common prefix ``least`` or more, by a stack scan.

    Members are lo..hi (inclusive) of the suffix array, and ``length`` is the longest prefix they share.
    """
    stack: list[tuple[int, int]] = []
    values = lcp.tolist()
    values.append(0)
    for i in range(1, len(values)):
        lo, now = i - 1, values[i]
        while stack and stack[-1][0] > now:
            length, lo = stack.pop()
            yield length, lo, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, lo))


def maximal_repeats(data: np.ndarray, suffix: np.ndarray, end: np.ndarray, left: np.ndarray, bucket: np.ndarray, least: int, width: int):
    """(length, members) of the maximal repeats among suffixes; members index ``suffix``, all occurrences.

    ``left`` is the byte before each suffix, or -1 where it is not known, which counts as different from any.
    """
    order = suffix_array(data, suffix, end, bucket, width)
    lcp = common_prefixes(data, suffix[order], end[order], width)
    lcp[1:][bucket[order][1:] != bucket[order][:-1]] = 0
    lcp[lcp < least] = 0
    byte = left[order]
    for length, lo, hi in intervals(lcp, least):
        sides = byte[lo : hi + 1]
        if sides[0] < 0 or (sides != sides[0]).any():
            yield length, order[lo : hi + 1]


def _lengths(context: pa.Array) -> np.ndarray:
    return pc.binary_length(context).to_numpy(zero_copy_only=False).astype(np.int64)


def _block_repeats(rows: pa.RecordBatch, size: int):
    """(length, members, owner, inner) of the maximal repeats of buckets of different contexts.

    ``rows`` come sorted by gram. Members index the suffixes, which are given by the row that owns them and the place in it.
    """
    gram, lead, context = rows.column("gram").to_numpy(), rows.column("lead").to_numpy().astype(np.int64), rows.column("context")
    lengths = _lengths(context)
    data = np.frombuffer(b"".join(context.to_pylist()), np.uint8)
    base = np.cumsum(lengths) - lengths
    count = lengths - size + 1
    owner = np.repeat(np.arange(len(lengths)), count)
    inner = ragged(count)
    suffix = base[owner] + inner
    group = np.cumsum(np.append(True, gram[1:] != gram[:-1]))
    # equal strings have their minimizer at the same place, so gram and place make the bucket
    place = (group[owner] << 32) + (lead[owner] - inner)
    poly = POLY[0]
    prefix = poly.prefix(data.astype(U) + U(1))
    name = mix(poly.spans(prefix, suffix, suffix + size) ^ mix(place.astype(U)))
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    twice = np.zeros(len(name), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    some = np.flatnonzero(twice)
    if not len(some):
        return
    _, bucket = np.unique(place[some], return_inverse=True)
    by_bucket = np.argsort(bucket, kind="stable")
    some, bucket = some[by_bucket], bucket[by_bucket]
    cuts = [0]
    firsts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for f in firsts[1:].tolist():  # whole buckets, about 16,000 suffixes at a time
        if f - cuts[-1] >= 1 << 14 or f == len(bucket):
            cuts.append(f)
    for lo, hi in zip(cuts, cuts[1:]):
        part = some[lo:hi]
        own, at = owner[part], suffix[part]
        end = base[own] + lengths[own]
        left = np.where(inner[part] > 0, data[np.maximum(at - 1, 0)].astype(np.int16), -1)
        for length, members in maximal_repeats(data, at, end, left, bucket[lo:hi], size, int((end - at).max())):
            yield length, own[members], inner[part][members]


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined spans of each document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    shift = np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 32
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, (lo + shift)[1:] > reach[:-1])
    return doc[new], lo[new], (reach - shift)[np.append(new[1:], True)]


SPANS = "doc_id long, `from` int, `to` int, gram long, low int, high int, lead int, context binary, start int"


def _span_rows(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    doc, lo, hi = _merged(doc, lo, hi)
    found = {"doc_id": pa.array(doc, pa.int64()), "from": pa.array(lo, pa.int32()), "to": pa.array(hi, pa.int32())}
    none = {"gram": pa.int64(), "low": pa.int32(), "high": pa.int32(), "lead": pa.int32(), "context": pa.binary(), "start": pa.int32()}
    return pa.RecordBatch.from_pydict({**found, **{c: pa.nulls(len(doc), t) for c, t in none.items()}})


def _parts(rows: pa.RecordBatch, low: int, high: int, size: int) -> pa.RecordBatch:
    """The contexts of a bucket whose strings have the gram at the places ``low`` to ``high``, as rows of two smaller ones."""
    mid = (low + high) // 2
    out: dict[str, list] = {c: [] for c in ("doc_id", "gram", "low", "high", "lead", "context", "start")}
    for g, lead, context, doc_id, start in zip(*(rows.column(c).to_pylist() for c in ("gram", "lead", "context", "doc_id", "start"))):
        for a, b in ((low, mid), (mid + 1, high)):
            first, last = max(0, lead - b), min(len(context) - size, lead - a)
            if first > last:
                continue
            common = context[lead - a : lead + size - b]  # what all strings with the gram at these places hold
            key = hashlib.blake2b(b"%d,%d,%d;" % (g, a, b) + common, digest_size=8).digest()
            values = (doc_id, int.from_bytes(key, "little", signed=True), a, b, lead - first, context[first : last + size], start + first)
            for column, value in zip(out.values(), values):
                column.append(value)
    types = {"doc_id": pa.int64(), "gram": pa.int64(), "low": pa.int32(), "high": pa.int32(), "lead": pa.int32(), "context": pa.binary(), "start": pa.int32()}
    found = {c: pa.array(out[c], t) for c, t in types.items()}
    nothing = pa.nulls(len(out["gram"]), pa.int32())
    return pa.RecordBatch.from_pydict({"doc_id": found.pop("doc_id"), "from": nothing, "to": nothing, **found})


class _Buckets:
    """Buckets from a stream of rows sorted by gram, lead, context, doc_id and start.

    Subclasses say what becomes of a row that repeats the context before it, of the different contexts of whole
    buckets, and of the rows of a bucket with over ``most`` bytes of them.
    """

    def __init__(self, size: int, most: int, low: int, high: int) -> None:
        self.size, self.most, self.range = size, most, (low, high)

    def range_of(self, rows: pa.RecordBatch) -> tuple[int, int]:
        return (rows.column("low")[0].as_py(), rows.column("high")[0].as_py()) if "low" in rows.schema.names else self.range

    def run(self, batches):
        held = large = None
        waiting: list[pa.RecordBatch] = []
        weight = 0

        def whole(rows: pa.RecordBatch):
            gram = rows.column("gram").to_numpy()
            new = np.append(True, gram[1:] != gram[:-1])
            sizes = np.diff(np.append(np.flatnonzero(new), len(gram)))
            several = rows.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if several.num_rows:
                yield from self.buckets(several)

        for batch in batches:
            if not batch.num_rows:
                continue
            gram, lead, context = batch.column("gram").to_numpy(), batch.column("lead").to_numpy(), batch.column("context")
            n = len(gram)
            same = np.zeros(n, bool)
            same[1:] = (gram[1:] == gram[:-1]) & (lead[1:] == lead[:-1])
            same[1:] &= pc.equal(context.slice(1), context.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same[0] = held is not None and held == (gram[0], lead[0], context[0].as_py())
            held = gram[-1], lead[-1], context[-1].as_py()
            if same.any():
                yield from self.copies(batch.filter(pa.array(same)))
            rows = batch.filter(pa.array(~same))
            if large is not None and rows.num_rows:
                more = rows.column("gram").to_numpy() == large
                if more.any():
                    yield from self.oversize(rows.filter(pa.array(more)))
                    rows = rows.filter(pa.array(~more))
                if rows.num_rows:
                    large = None
            if not rows.num_rows:
                continue
            waiting.append(rows)
            weight += int(_lengths(rows.column("context")).sum())
            if weight < min(BLOCK, self.most):
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            gram = rows.column("gram").to_numpy()
            cut = int(np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))[-1])
            if cut:
                yield from whole(rows.slice(0, cut))
            rest = rows.slice(cut)
            weight = int(_lengths(rest.column("context")).sum())
            waiting = [rest]
            low, high = self.range_of(rest)
            if weight > self.most and low < high:
                yield from self.oversize(rest)
                large, waiting, weight = gram[-1], [], 0
        if waiting:
            yield from whole(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])


class _Spans(_Buckets):
    """What goes, as spans; and the parts of buckets that are too large."""

    def copies(self, rows):
        start = rows.column("start").to_numpy()
        yield _span_rows(rows.column("doc_id").to_numpy(), start, start + _lengths(rows.column("context")))

    def buckets(self, rows):
        ids, start = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        for length, own, inner in _block_repeats(rows, self.size):
            d, w = ids[own], start[own] + inner
            first = np.lexsort((w, d))[0]
            later = (d != d[first]) | (w != w[first])
            found.append((d[later], w[later], w[later] + length))
        yield _span_rows(*(np.concatenate(c) for c in zip(*found)))

    def oversize(self, rows):
        yield _parts(rows, *self.range_of(rows), self.size)


class _Groups(_Buckets):
    """Repeats as (repeat, length, copy, offset), and the rows (copy, doc_id, start) of each context, by its number."""

    def rows(self, **columns):
        shape = {"repeat": pa.binary(), "length": pa.int32(), "copy": pa.binary(), "offset": pa.int32(), "doc_id": pa.int64(), "start": pa.int32()}
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in shape.items()})

    @staticmethod
    def numbers(rows):
        names = zip(*(rows.column(c).to_pylist() for c in ("gram", "lead", "context")))
        return [hashlib.blake2b(b"%d,%d;" % (g, lead) + context, digest_size=16).digest() for g, lead, context in names]

    def run(self, batches):
        # every occurrence is told of; a context with copies is itself a repeat of them
        def told():
            for batch in batches:
                names = self.numbers(batch)
                self.out.append(self.rows(copy=names, doc_id=batch.column("doc_id").to_numpy(), start=batch.column("start").to_numpy()))
                yield batch

        self.out: list[pa.RecordBatch] = []
        for found in super().run(told()):
            yield from self.out
            self.out = []
            yield found
        yield from self.out

    def copies(self, rows):
        names = self.numbers(rows)
        yield self.rows(repeat=names, length=_lengths(rows.column("context")), copy=names, offset=[0] * len(names))

    def buckets(self, rows):
        names, contexts = self.numbers(rows), rows.column("context").to_pylist()
        for length, own, inner in _block_repeats(rows, self.size):
            text = contexts[own[0]][inner[0] : inner[0] + length]
            name = hashlib.blake2b(text, digest_size=16).digest()
            yield self.rows(repeat=[name] * len(own), length=[length] * len(own), copy=[names[k] for k in own.tolist()], offset=inner)

    def oversize(self, rows):
        yield from self.buckets(rows)


def _repeats(batches, size: int, most: int, high: int):
    """Spans to remove, and parts of buckets of over ``most`` bytes of different contexts."""
    return _Spans(size, most, 0, high).run(batches)


def _repeat_groups(batches, size: int, most: int, high: int):
    return _Groups(size, most, 0, high).run(batches)


def _cut(batches):
    for batch in pieces(batches, "text"):
        texts, removed, runs, total = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw = text.as_buffer().to_pybytes()
            out, at, gone, n = [], 0, 0, 0
            found = spans.as_py() or ()
            lows, highs = (np.array([x[c] for x in found], np.int64) for c in ("from", "to"))
            for lo, hi in zip(*(c.tolist() for c in _merged(np.zeros(len(found), np.int64), lows, highs)[1:])):
                out.append(raw[at:lo])
                gone, n, at = gone + hi - lo, n + 1, hi
            out.append(raw[at:])
            texts.append(b"".join(out))
            removed.append(gone)
            runs.append(n)
            total.append(len(raw))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
                "kept": pa.array(texts, pa.binary()),
            }
        )


def _texts(docs: DataFrame, size: int, id_col: str, text_col: str):
    """(The facts of every row with the first doc_id of the same text, the texts that can hold or lose a string by doc_id,
    which facts are theirs, the number of partitions)."""
    ensure_checkpoint_dir(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = every.mapInArrow(remote(__name__, "_facts"), "doc_id long, n_bytes long, sha string").checkpoint()
    firsts = facts.groupBy("sha").agg(F.min("doc_id").alias("first"))
    facts = facts.join(firsts, "sha").checkpoint()
    able = F.coalesce((F.col("doc_id") == F.col("first")) & (F.col("n_bytes") >= size), F.lit(False))
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = every.filter("doc_id IS NOT NULL").repartition(width, "doc_id")
    texts = texts.join(facts.filter(able).select("doc_id").distinct(), "doc_id").select("doc_id", "text")
    return facts, shuffled_once(texts), able, width


CONTEXTS = "gram long, lead int, context binary, doc_id long, start int"


def _sorted_contexts(texts: DataFrame, size: int, width: int) -> DataFrame:
    """The contexts of grams that occur twice, by bucket."""
    places = (
        texts.mapInArrow(remote(__name__, "_occurrences", size=size), "gram long, doc_id long, pos int")
        .repartition(width, "gram")
        .sortWithinPartitions("gram")
        .mapInArrow(remote(__name__, "_repeated"), "doc_id long, pos int")
        .groupBy("doc_id")
        .agg(F.collect_list("pos").alias("places"))
    )
    contexts = texts.join(places, "doc_id").mapInArrow(remote(__name__, "_contexts", size=size), CONTEXTS)
    return contexts.repartition(width, "gram").sortWithinPartitions("gram", "lead", "context", "doc_id", "start")


def repeat_groups(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, length, doc_id, start): the maximal repeats of ``size`` bytes or more, each with all its occurrences.

    A repeat is maximal within the strings that share a minimizer, so a longer passage is told of as a chain of
    overlapping ones. Texts that equal a smaller doc_id's, null and short ones are left out.
    """
    _, texts, _, width = _texts(docs, size, id_col, text_col)
    shape = "repeat binary, length int, copy binary, offset int, doc_id long, start int"
    rows = _sorted_contexts(texts, size, width).mapInArrow(
        remote(__name__, "_repeat_groups", size=size, most=1 << 62, high=size - min(GRAM, size)), shape
    ).checkpoint()
    repeats = rows.filter("repeat IS NOT NULL").select("repeat", "length", "copy", "offset").distinct()
    where = rows.filter("repeat IS NULL").select("copy", "doc_id", "start")
    return repeats.join(where, "copy").select(
        F.hex("repeat").alias("repeat"), "length", "doc_id", (F.col("start") + F.col("offset")).alias("start")
    ).distinct()


def suffix_dedup(
    docs: DataFrame, size: int = 100, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left).

    A byte goes if a string of ``size`` bytes that covers it also starts earlier: in a smaller doc_id, or before in
    the same text. A null text is empty. Texts without a doc_id lose nothing and take nothing. Rows that
    repeat a doc_id are expected to repeat its text, and get the same result each. Other columns are ignored; an
    empty table gives an empty result. ``kept`` may be null where nothing was removed; then ``sha`` is the whole text's.

    Texts are shuffled by doc_id once; gathering contexts and cutting are jobs that read the same exchange.
    """
    facts, texts, able, width = _texts(docs, size, id_col, text_col)
    repeats = remote(__name__, "_repeats", size=size, most=block_bytes, high=size - min(GRAM, size))
    found = _sorted_contexts(texts, size, width).mapInArrow(repeats, SPANS).checkpoint()
    spans = found.filter("gram IS NULL").select("doc_id", "from", "to")
    parts = found.filter("gram IS NOT NULL")
    while not parts.isEmpty():  # of buckets that were too large; their range of places halves each time
        by_gram = parts.drop("from", "to").repartition(width, "gram").sortWithinPartitions("gram", "lead", "context", "doc_id", "start")
        found = by_gram.mapInArrow(repeats, SPANS).checkpoint()
        spans = spans.unionByName(found.filter("gram IS NULL").select("doc_id", "from", "to"))
        parts = found.filter("gram IS NOT NULL")
    per_text = spans.groupBy("doc_id").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    cut = texts.join(per_text, "doc_id", "left").mapInArrow(
        remote(__name__, "_cut"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= size), F.lit(False))
    whole = facts.filter(~able).select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        copy.cast("long").alias("n_spans"),
        F.when(copy, F.lit("").cast("binary")).alias("kept"),
        "sha",
    )
    return cut.withColumn("sha", F.lit(None).cast("string")).unionByName(whole)


def suffix_dedup_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``suffix_dedup``."""
    rows = suffix_dedup(docs, **options)
    digest = F.when(F.col("kept").isNull(), F.col("sha")).otherwise(F.sha2("kept", 256))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"))
