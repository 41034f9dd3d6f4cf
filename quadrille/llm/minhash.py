"""MinHash near-dedup with tensored banding (operator 1).

Each set of word shingles gets two collections of m small min-hash groups, A and B. The m * m table keys are
the pairs (A_i, B_j), so m * m tables of 2 r hash functions each cost 2 m r functions rather than 2 m^2 r.
Sets of similarity s share a table unless no A or no B agrees: about 2 (1 - s^r)^m.

1. Equal sets collapse to their smallest doc_id before anything else (a combined aggregation).
2. Rows (key, document) are shuffled once and sorted; a stream over each bucket pairs its members with the
   smallest: as many candidates as members, whatever the bucket's size.
3. Candidates are confirmed on full shingle sets, and links merge into components.
4. Members of buckets that are not one component yet are joined by the prefix filter, which is exact: two sets can
   only be similar if they share one of their rarest shingles, early enough in both (rare ones first) that what
   follows it can still make up the overlap that their sizes ask for. Only such pairs of different components are
   confirmed. Documents of one template whose similarity is below the threshold differ in more shingles than the
   prefix is long, so their prefixes have nothing in common and their number of pairs doesn't grow.

Sets are collected only for documents that share a bucket with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.components import connected_components
from quadrille.llm.npx import U, Words, mix, pieces, ragged, signed, windows
from quadrille.llm.remote import remote
from quadrille.session import ensure_checkpoint_dir

ROWS = 3
MISS = 4e-4


def groups_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """The least m that loses a pair at the threshold with probability ``miss`` at most."""
    m = 1
    while 2 * (1 - (percent / 100) ** rows) ** m > miss:
        m += 1
    return m


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text and sorted within, and how many each text has.

    Words are lower-cased (A-Z) runs outside ASCII white space. A text of fewer than ``size`` words has its
    whole sequence as the only shingle; one without words has none.
    """
    words = Words(column, lower=True)
    h, counts = words.hashes(), words.counts
    grams = windows(h, size)
    inside = np.zeros(0, bool)
    if len(grams):
        inside = words.row[: len(grams)] == words.row[size - 1 :]
    rows, values = words.row[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(size - 1):
            some = counts[short] > k
            whole[some] = mix(whole[some] * U(0x9E3779B97F4A7C15) + h[words.first[short[some]] + k] + U(k + 1))
        rows, values = np.concatenate((rows, short)), np.concatenate((values, whole))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.bincount(rows, minlength=len(column)).astype(np.int64)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def _signatures(batches, size: int, m: int, rows: int):
    factors, join = _odd(2 * m * rows, 1), _odd(rows, 2)
    for batch in pieces(batches, "text"):
        values, counts = shingle_sets(batch.column("text"), size)
        some = np.flatnonzero(counts)
        out = np.zeros((batch.num_rows, 2 * m), U)
        mark = np.zeros((2, batch.num_rows), U)
        if len(some):
            at = (np.cumsum(counts) - counts)[some]
            for k in range(2):
                mark[k, some] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D * (k + 1) & ((1 << 64) - 1))), at)
            for g in range(2 * m):
                total = np.zeros(len(some), U)
                for r in range(rows):
                    total += mix(np.minimum.reduceat(values * factors[g * rows + r], at)) * join[r]
                out[some, g] = mix(total)
        flat = pa.array(signed(out.ravel()))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array(counts),
                "mark_a": pa.array(signed(mark[0])),
                "mark_b": pa.array(signed(mark[1])),
                "parts": pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * 2 * m, pa.int32()), flat),
            }
        )


def _table_keys(batches, m: int):
    tables = mix(np.arange(1, m * m + 1, dtype=U)).reshape(m, m)
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            parts = batch.column("parts").flatten().to_numpy().view(U).reshape(batch.num_rows, 2 * m)
            keys = mix(parts[:, :m, None] * U(0x9E3779B97F4A7C15) + parts[:, None, m:] + tables)
            ids = np.repeat(batch.column("doc_id").to_numpy(), m * m)
            yield pa.RecordBatch.from_pydict({"key": pa.array(signed(keys.reshape(-1))), "doc_id": pa.array(ids)})


def _buckets(batches):
    """Members of buckets of two or more, each with the bucket's first; rows come sorted by key and doc_id."""
    last_key = last_id = None
    last_alone = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        group = np.cumsum(new) - 1  # -1: goes on from the batch before
        first = np.append(ids[new], last_id if last_id is not None else 0)[group]
        joined = ~new
        opened = np.flatnonzero(new)
        size_two = np.append(joined[1:], False) & new  # a first with a follower
        rows = joined | size_two
        out_key, out_first, out_id = key[rows], first[rows], ids[rows]
        if joined[0] and last_alone:  # its first row ended the batch before
            out_key, out_first, out_id = np.append(last_key, out_key), np.append(last_id, out_first), np.append(last_id, out_id)
        last_key = key[-1]
        if len(opened):
            last_id = int(ids[opened[-1]])
        last_alone = bool(new[-1])
        yield pa.RecordBatch.from_pydict({"key": pa.array(out_key), "first": pa.array(out_first), "doc_id": pa.array(out_id)})


def _sets(batches, size: int):
    for batch in pieces(batches, "text"):
        values, counts = shingle_sets(batch.column("text"), size)
        at = np.append(0, np.cumsum(counts))
        raw = values.tobytes()
        sets = [raw[a:b] for a, b in zip((8 * at[:-1]).tolist(), (8 * at[1:]).tolist())]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "shingles": pa.array(sets, pa.binary())})


def _confirm(batches, percent: int):
    for batch in batches:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                keep.append(k)
        yield pa.RecordBatch.from_pydict({c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")})


def _prefixes(batches, percent: int):
    """Tokens (shingle, size, most, doc_id, component) of each document's prefix.

    ``shared`` holds the shingles that other open documents have too, as (count, shingle) in ascending order; the
    rest come before them. A set x can be similar to y only if they have ``percent (|x| + |y|) / (100 + percent)`` shingles
    in common; if the first of them is at place p of x, then |x| + |y| is at most ``most`` = (|x| - p) (100 + percent) / percent.
    """
    for batch in batches:
        sizes = batch.column("n_shingles").to_numpy()
        lists = batch.column("shared")
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        place = np.repeat(sizes - counts, counts) + ragged(counts)
        size = np.repeat(sizes, counts)
        most = (size - place) * (100 + percent) // percent
        # the smallest partner has percent of the size
        some = np.flatnonzero(100 * (most - size) >= percent * size)
        row = np.repeat(np.arange(len(sizes)), counts)[some]
        yield pa.RecordBatch.from_pydict(
            {
                "shingle": lists.flatten().field("s").take(pa.array(some)),
                "size": pa.array(size[some]),
                "most": pa.array(most[some]),
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "component": batch.column("component").take(pa.array(row)),
            }
        )


def _plausible(batches):
    """Pairs of different components that share a token early enough; rows come sorted by shingle and size.

    Each row meets the smaller ones before it that may still be similar to it. Those are held by component, in order
    of size, and let go once nothing later can be similar to them: time and memory follow the pairs that are made.
    """
    a: list[int] = []
    b: list[int] = []
    shingle, open_ = None, {}  # component: rows (size, largest partner, doc_id), and the size of its first
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shingle", "size", "most", "doc_id", "component"))
        for token, size, most, doc_id, component in zip(*columns):
            if token != shingle:
                shingle, open_ = token, {}
            reach = most - size
            gone = []
            for other, (least, held) in open_.items():
                if least > reach:
                    break
                if other == component:
                    continue
                k, late = 0, False
                for n, until, partner in held:
                    if n > reach:
                        break
                    k += 1
                    if until < size:
                        late = True
                    else:
                        a.append(min(doc_id, partner))
                        b.append(max(doc_id, partner))
                if late:
                    held[:k] = [x for x in held[:k] if x[1] >= size]
                    if not held:
                        gone.append(other)
            for other in gone:
                del open_[other]
            if reach >= size:  # may meet one of its size or more
                open_.setdefault(component, (size, []))[1].append((size, reach, doc_id))
        if len(a) > 10_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _members(batches):
    """(doc_id, s) for each shingle of a set."""
    for batch in batches:
        raw = [x.as_buffer() for x in batch.column("shingles")]
        counts = np.array([len(x) for x in raw], np.int64) // 8
        values = np.frombuffer(b"".join(raw), np.int64)
        ids = np.repeat(batch.column("doc_id").to_numpy(), counts)
        for at in range(0, len(values), 1 << 17):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at : at + (1 << 17)]), "s": pa.array(values[at : at + (1 << 17)])})


def _crossing(open_: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of open documents (doc_id, component, n_shingles) in different components that may be similar."""
    members = sets.join(open_.select("doc_id"), "doc_id", "left_semi").mapInArrow(remote(__name__, "_members"), "doc_id long, s long")
    counts = members.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = members.join(counts, "s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("shared"))
    tokens = shared.join(open_, "doc_id").select("doc_id", "component", "n_shingles", "shared")
    shape = "shingle long, size long, most long, doc_id long, component long"
    return (
        tokens.mapInArrow(remote(__name__, "_prefixes", percent=percent), shape)
        .repartition(width, "shingle")
        .sortWithinPartitions("shingle", "size")
        .mapInArrow(remote(__name__, "_plausible"), "a long, b long")
        .distinct()
    )


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    rows = pairs.join(right, "b").join(left, "a")
    return rows.mapInArrow(remote(__name__, "_confirm", percent=percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents whose sets' intersection is at least ``percent`` hundredths of their union are linked;
    component_id is the smallest doc_id of the component and that row is kept. Null and blank texts have no
    shingles and link with nothing. A null doc_id gets a null component and is kept. Repeated rows get the same
    result each. Other columns are ignored; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    m = groups_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shape = "doc_id long, n_shingles long, mark_a long, mark_b long, parts array<long>"
    marked = texts.mapInArrow(remote(__name__, "_signatures", size=shingle, m=m, rows=ROWS), shape).checkpoint()
    usable = marked.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("mark_a", "mark_b").agg(F.min("doc_id").alias("first_id"))
    heads = usable.join(classes.withColumnRenamed("first_id", "doc_id"), ["mark_a", "mark_b", "doc_id"], "left_semi")
    keys = heads.select("doc_id", "parts").mapInArrow(remote(__name__, "_table_keys", m=m), "key long, doc_id long")
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = (
        keys.repartition(width, "key")
        .sortWithinPartitions("key", "doc_id")
        .mapInArrow(remote(__name__, "_buckets"), "key long, first long, doc_id long")
        .filter("key IS NOT NULL")
        .checkpoint()
    )
    members = buckets.select("doc_id").distinct()
    sets = (
        texts.join(members, "doc_id", "left_semi")
        .mapInArrow(remote(__name__, "_sets", size=shingle), "doc_id long, shingles binary")
        .dropDuplicates(["doc_id"])
        .checkpoint()
    )
    stars = buckets.filter("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _links(stars, sets, percent).checkpoint()
    found = connected_components(links)

    sizes = heads.select("doc_id", "n_shingles").distinct()
    placed = (
        buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .select("key", "doc_id", "component")
    )
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    split = split.filter("lo < hi AND n > 2").select("key")
    open_ = placed.join(split, "key", "left_semi").select("doc_id", "component").distinct().join(sizes, "doc_id").checkpoint()
    if not open_.isEmpty():
        more = _links(_crossing(open_, sets, percent, width), sets, percent).checkpoint()
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))

    by_class = (
        classes.join(found.withColumnRenamed("node", "first_id"), "first_id", "left")
        .select("mark_a", "mark_b", F.coalesce("component", "first_id").alias("component_id"))
    )
    linked = usable.join(by_class, ["mark_a", "mark_b"]).select("doc_id", "n_shingles", "component_id")
    alone = marked.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
