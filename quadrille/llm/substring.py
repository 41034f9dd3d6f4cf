"""Substring dedup of word windows with a count-min prefilter (operator 4).

A window is ``size`` consecutive words. Each is counted by a cell that is chosen by content alone: the window's
minimizer, the n-gram of least hash within it. Equal windows have equal minimizers at equal places, so a
cell's count is never below a window's, and neighbouring windows share a cell: the sketch takes
one count per minimizer, about 5 % of the words.

1. Each partition sketches its own texts: (row of the sketch, cell, count), with counts added up
   before they leave it. The partial sketches are merged by adding.
2. A window is estimated by the least of its cells over the sketch's rows. Minimizers estimated once are
   dropped; nothing that repeats can be.
3. Only windows estimated repeated are grouped, by 128-bit names of their words, and lose to the smallest doc_id.

The sketch's width follows the number of words, so its error rate doesn't grow with the corpus; it is
kept as rows and joined, never broadcast. Documents with the same words collapse before all this.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.npx import U, Words, mix, pieces, signed, sliding_argmin, windows
from quadrille.llm.remote import remote
from quadrille.session import ensure_checkpoint_dir

GRAM = 10
DEPTH = 2


def _facts(batches):
    for batch in pieces(batches, "text"):
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([len(w) for w in texts], pa.int64()),
                "sha": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in texts]),
            }
        )


class _Anchored:
    """The windows of a batch and their minimizers: ``inside`` marks the windows that lie in one text."""

    def __init__(self, column: pa.Array, size: int) -> None:
        self.words = Words(column)
        h = self.words.hashes()
        gram = min(GRAM, size)
        self.grams = windows(h, gram)
        self.best = sliding_argmin(self.grams, size - gram + 1)
        row = self.words.row
        self.inside = row[: len(self.best)] == row[size - 1 :] if len(self.best) else np.zeros(0, bool)
        self.anchors = np.unique(self.best[self.inside])
        self.rows = row[self.anchors]


def _cells(grams: np.ndarray, row: int, width: int) -> np.ndarray:
    return signed(mix(grams + U((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(width)) + row * width


def _sketch(batches, size: int, width: int):
    """Partial sketches: cell and count, added up over each piece of the partition."""
    for batch in pieces(batches, "text", 4 << 20):
        grams = []
        for part in pieces([batch], "text"):
            found = _Anchored(part.column("text"), size)
            grams.append(found.grams[found.anchors])
        grams = np.concatenate(grams)
        for row in range(DEPTH):
            cells, counts = np.unique(_cells(grams, row, width), return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(counts.astype(np.int64))})


def _occurrences(batches, size: int, width: int):
    for batch in pieces(batches, "text"):
        found = _Anchored(batch.column("text"), size)
        grams = found.grams[found.anchors]
        columns = {f"cell{row}": pa.array(_cells(grams, row, width)) for row in range(DEPTH)}
        columns["doc_id"] = batch.column("doc_id").take(pa.array(found.rows))
        columns["pos"] = pa.array((found.anchors - found.words.first[found.rows]).astype(np.int32))
        yield pa.RecordBatch.from_pydict(columns)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), lengths


def _windows(batches, size: int):
    """Names of the windows whose minimizer is among the document's ``places``."""
    for batch in pieces(batches, "text"):
        found = _Anchored(batch.column("text"), size)
        places, lengths = _flat(batch.column("places"))
        wanted = np.zeros(len(found.grams) + 1, bool)
        wanted[places + np.repeat(found.words.first[:-1], lengths)] = True
        at = np.flatnonzero(found.inside & wanted[found.best])
        names = [windows(found.words.hashes(k), size, k)[at] for k in range(2)]
        rows = found.words.row[at]
        # a window that repeats within its document goes once; _cut finds the others
        _, once = np.unique(mix(names[0] + mix(names[1] + rows.astype(U))), return_index=True)
        once.sort()
        at, rows, names = at[once], rows[once], [n[once] for n in names]
        yield pa.RecordBatch.from_pydict(
            {
                "name_a": pa.array(signed(names[0])),
                "name_b": pa.array(signed(names[1])),
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "start": pa.array((at - found.words.first[rows]).astype(np.int32)),
            }
        )


def _later(batches):
    """(doc_id, start) of windows that a smaller doc_id has too; rows come sorted by name and doc_id."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids, start = (batch.column(c).to_numpy() for c in ("name_a", "name_b", "doc_id", "start"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if held is not None and held[:2] == (a[0], b[0]):
            new[0] = False
        first = np.append(ids[new], held[2] if held is not None else 0)[np.cumsum(new) - 1]
        later = ids > first
        held = a[-1], b[-1], first[-1]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[later]), "start": pa.array(start[later])})


def _cut(batches, size: int):
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"))
        names = [windows(words.hashes(k), size, k) for k in range(2)]
        starts, lengths = _flat(batch.column("starts"))
        ends = np.cumsum(lengths)
        raw = words.data.tobytes()
        texts, removed = [], []
        for r, (lo, hi) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
            first, n = int(words.first[r]), int(words.counts[r])
            gone = np.zeros(n, bool)
            if hi > lo:
                a, b = (x[first : first + n - size + 1] for x in names)
                order = starts[lo:hi][np.argsort(a[starts[lo:hi]])]
                at = np.minimum(np.searchsorted(a[order], a), len(order) - 1)
                same = (a[order][at] == a) & (b[order][at] == b)
                same[starts[lo:hi]] = True
                cover = np.zeros(n + 1, np.int32)
                found = np.flatnonzero(same)
                np.add.at(cover, found, 1)
                np.add.at(cover, found + size, -1)
                gone = np.cumsum(cover[:-1]) > 0
            kept = np.flatnonzero(~gone) + first
            texts.append(b" ".join([raw[i:j] for i, j in zip(words.start[kept].tolist(), words.end[kept].tolist())]).decode())
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(words.counts.astype(np.int64)),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(texts, pa.string()),
            }
        )


def substring_dedup(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Null and blank texts have no words. A document whose words all equal those of a smaller doc_id loses all of
    them if it has a window at all. Texts without a doc_id, which have no place in the order, lose nothing and take
    nothing. Rows that repeat a doc_id are expected to repeat its text, and get the same result each. Other columns
    are ignored; an empty table gives an empty result.

    Texts are shuffled by doc_id once; all passes over them read that one exchange.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = every.mapInArrow(remote(__name__, "_facts"), "doc_id long, n_words long, sha string").checkpoint()
    firsts = facts.groupBy("sha").agg(F.min("doc_id").alias("first"))
    facts = facts.join(firsts, "sha").checkpoint()
    words = facts.agg(F.sum("n_words")).first()[0] or 0
    width = 1 << max(16, int(words * 8 // max(1, size - GRAM) * 2).bit_length())
    able = F.coalesce((F.col("doc_id") == F.col("first")) & (F.col("n_words") >= size), F.lit(False))
    texts = every.join(facts.filter(able).select("doc_id").distinct(), "doc_id").select("doc_id", "text")

    partial = texts.mapInArrow(remote(__name__, "_sketch", size=size, width=width), "cell long, n long")
    merged = partial.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell")
    shape = ", ".join([*(f"cell{r} long" for r in range(DEPTH)), "doc_id long", "pos int"])
    seen = texts.mapInArrow(remote(__name__, "_occurrences", size=size, width=width), shape)
    for r in range(DEPTH):
        seen = seen.join(merged.withColumnRenamed("cell", f"cell{r}"), f"cell{r}", "left_semi")
    places = seen.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    named = texts.join(places, "doc_id").mapInArrow(
        remote(__name__, "_windows", size=size), "name_a long, name_b long, doc_id long, start int"
    )
    later = (
        named.repartition(parts, "name_a")
        .sortWithinPartitions("name_a", "name_b", "doc_id")
        .mapInArrow(remote(__name__, "_later"), "doc_id long, start int")
    )
    starts = later.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    cut = texts.join(starts, "doc_id", "left").mapInArrow(
        remote(__name__, "_cut", size=size), "doc_id long, n_words long, n_removed long, kept_text string"
    )
    cut = cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= size), F.lit(False))
    whole = facts.filter(~able).select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return cut.unionByName(whole)
