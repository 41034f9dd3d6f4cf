"""Exact, near, window and suffix dedup against brute force, with the cases that tables bring."""

import hashlib
import random
import re
import string

import pyarrow as pa
import pytest

from quadrille.llm import components, exact_dedup, minhash, substring, suffixes

SHAPE = "doc_id long, text string, name string, h long, key string, pos int, start int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, docs):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "n", 1, "k", 2, 3) for i, t in docs], SHAPE)


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéß漢", k=rnd.randint(1, 7))) for _ in range(300)]
    passage = rnd.choices(vocabulary, k=80)
    docs = []
    for i in range(n):
        words = rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 5, 60, 150, 400]))
        if i % 4 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        if i % 5 == 0 and docs:
            words = (docs[rnd.randrange(len(docs))][1] or "").split()
            for _ in range(rnd.randint(0, 2)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        docs.append((i * 3, rnd.choice([" ", "  ", "\n", "\t "]).join(words)))
    docs += [(1001, None), (1002, ""), (1003, " \n\t"), (1004, "a " * 3000), (1005, "ab" * 900), (1006, "x" * 99), (1007, "x" * 99)]
    docs += [docs[5], (2000, docs[8][1]), (2001, docs[8][1].upper()), (None, docs[12][1]), (3000, "b " * 40 + "c\x0bd")]
    rnd.shuffle(docs)
    return docs


DOCS = corpus()
EMPTY: list = []


def brute_exact(docs):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in docs]
    groups = {}
    for (i, _), t in zip(docs, norm):
        groups.setdefault(t, []).append(i)
    return sorted(
        (str(i), min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for (i, _), t in zip(docs, norm)
    )


@pytest.mark.parametrize("size", [7, 2048])
def test_exact(spark, size):
    rows = exact_dedup.exact_dedup(frame(spark, DOCS), block_size=size).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute_exact(DOCS)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_tells_equal_hashes_apart(spark, monkeypatch):
    """With a hash of one value all blocks collide; contents still decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = exact_dedup.exact_dedup(frame(spark, DOCS[:40]), block_size=16).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute_exact(DOCS[:40])


def shingles(text, k):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_near(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_near(spark, k, percent):
    rows = minhash.near_duplicates(frame(spark, DOCS), percent=percent, shingle=k).collect()
    want = brute_near(DOCS, k, percent)
    assert len(rows) == len(DOCS)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_completes_buckets_of_several_components(spark):
    """A chain: neighbours are similar, its ends are not, and each bucket's first member sees few of the others."""
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(50)]
    want = brute_near(docs, 1, 85)
    rows = minhash.near_duplicates(frame(spark, docs), percent=85, shingle=1).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in want.items()}


def test_components(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 500), (7, 7), (900, 700), (900, 800)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500, 700: 700, 800: 700, 900: 700}


def brute_windows(docs, size):
    first, out = {}, {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if first.setdefault(tuple(words[k : k + size]), i) < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [50, 12])
def test_windows(spark, size):
    rows = substring.substring_dedup(frame(spark, DOCS), size=size).collect()
    want = brute_windows(DOCS, size)
    assert len(rows) == len(DOCS)
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def brute_bytes(docs, size):
    seen, out = set(), {}
    for i, t in sorted(((d for d in docs if d[0] is not None)), key=lambda d: d[0]):
        if i in out:
            continue
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            piece = raw[k : k + size]
            if piece in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [2 << 20, 300])
def test_suffixes(spark, most):
    """Also with every larger bucket split, over and over."""
    rows = suffixes.suffix_dedup_report(frame(spark, DOCS), block_bytes=most).collect()
    want = brute_bytes(DOCS, 100)
    assert len(rows) == len(DOCS)
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_suffixes_shuffle_texts_once(spark, tmp_path):
    rnd = random.Random(8)
    letters = string.ascii_letters + string.digits
    docs = [(i, "".join(rnd.choices(letters, k=50_000))) for i in range(40)]
    docs.append((40, docs[0][1][:200] + docs[1][1][-200:]))
    frame(spark, docs).write.parquet(f"{tmp_path}/documents")
    before, kept = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = suffixes.suffix_dedup_report(spark.read.parquet(f"{tmp_path}/documents")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {r.doc_id: r.n_removed for r in got} == {i: 400 * (i == 40) for i in range(41)}
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert written < 2 * sum(len(t) for _, t in docs)  # texts, and 0.6 of them for their minimizers


def stream(rows, size):
    """Rows in the order of the buckets, in batches of ``size``."""
    rows = sorted(rows, key=lambda r: (r["gram"], r["lead"], r["context"], r["doc_id"], r["start"]))
    shape = pa.schema([("gram", pa.int64()), ("lead", pa.int32()), ("context", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
    return [pa.RecordBatch.from_pylist(rows[k : k + size], schema=shape) for k in range(0, len(rows), size)]


@pytest.mark.parametrize("batch", [1, 7, 1000])
@pytest.mark.parametrize("most", [1, 300, 10**9])
def test_split_buckets_lose_nothing(monkeypatch, batch, most):
    """One gram with many surroundings: the spans are the same however its bucket is split."""
    monkeypatch.setattr(suffixes, "BLOCK", 1)
    rnd, size, gram = random.Random(batch), 12, b"GRAM"
    rows = []
    for d in range(120):
        left, right = (bytes(rnd.choices(b"ab", k=8)) for _ in range(2))
        first, last = rnd.randint(0, 3), rnd.randint(4, 8)
        rows.append({"gram": 5, "lead": 8 - first, "context": (left + gram + right)[first : last + size], "doc_id": d // 2, "start": 100 * (d % 2) + first, "low": 0, "high": 8})
    seen, want = {}, set()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        for k in range(len(r["context"]) - size + 1):
            key = r["context"][k : k + size]
            if seen.setdefault((key, r["lead"] - k), (r["doc_id"], r["start"])) != (r["doc_id"], r["start"]):
                want |= {(r["doc_id"], r["start"] + k + j) for j in range(size)}
    got, rounds = set(), 0
    while rows:
        out = [r for b in suffixes._repeats(iter(stream(rows, batch)), size, most, 8) for r in b.to_pylist()]
        got |= {(r["doc_id"], j) for r in out if r["gram"] is None for j in range(r["from"], r["to"])}
        rows = [r for r in out if r["gram"] is not None]
        rounds += 1
    assert got == want and rounds <= 5 and (rounds > 1) == (most < 10**9)


def test_repeat_groups(spark):
    """Each string that repeats lies in a group, and a group holds all of its places."""
    docs = [d for d in DOCS if d[0] is not None][:60]
    texts = {}
    for i, t in sorted(docs):
        if (t or "").encode() not in texts.values():
            texts.setdefault(i, (t or "").encode())
    places = {}
    for i, raw in texts.items():
        for k in range(len(raw) - 99):
            places.setdefault(raw[k : k + 100], set()).add((i, k))
    groups = {}
    for r in suffixes.repeat_groups(frame(spark, docs)).collect():
        groups.setdefault((r["repeat"], r.length), set()).add((r.doc_id, r.start))
    told = {}
    for (_, n), members in groups.items():
        pieces = {texts[d][s : s + n] for d, s in members}
        assert len(pieces) == 1 and len(members) > 1
        piece = pieces.pop()
        for k in range(n - 99):
            told.setdefault(piece[k : k + 100], set()).update((d, s + k) for d, s in members)
    assert told == {piece: at for piece, at in places.items() if len(at) > 1}


def test_maximal_repeats_give_all_occurrences():
    import numpy as np

    text = b"xxABCDEFyyABCDEFzzABCDqqABCDEF"
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    left = np.append(-1, data[:-1].astype(np.int16))
    found = suffixes.maximal_repeats(data, np.arange(n), np.full(n, n), left, np.zeros(n, int), 3, n)
    got = {(bytes(data[m[0] : m[0] + length]), tuple(sorted(m.tolist()))) for length, m in found}
    assert (b"ABCDEF", (2, 10, 24)) in got and (b"ABCD", (2, 10, 18, 24)) in got
    assert not any(piece in (b"BCD", b"BCDEF") for piece, _ in got)


def test_repeated_stream_keeps_state_between_batches():
    rows = [(1, 5, 0), (2, 6, 1), (2, 7, 2), (2, 8, 3), (3, 9, 4), (4, 1, 5), (4, 2, 6)]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows[i : i + size]]) for k, c in enumerate(("gram", "doc_id", "pos"))}) for i in range(0, len(rows), size)]
        got = [x for b in suffixes._repeated(iter(batches)) for x in b.column("doc_id").to_pylist()]
        assert sorted(got) == [1, 2, 6, 7, 8]
        keys = [pa.RecordBatch.from_pydict({"key": b.column("gram"), "doc_id": b.column("doc_id")}) for b in batches]
        got = [tuple(x.values()) for b in minhash._buckets(iter(keys)) for x in b.to_pylist()]
        assert sorted(got) == [(2, 6, 6), (2, 6, 7), (2, 6, 8), (4, 1, 1), (4, 1, 2)]


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, minhash.near_duplicates, substring.substring_dedup, suffixes.suffix_dedup_report])
def test_empty_table(spark, run):
    assert run(frame(spark, EMPTY)).count() == 0


def twins(n=1024):
    """Two different words of two letters that every polynomial modulo 2^64 hashes alike."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_names_tell_twins_apart(spark):
    x, y = twins()
    tail = " ".join(f"t{i}" for i in range(60))
    docs = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, x), (4, y), (5, f"{x} {y}"), (6, f"{x} {x}")]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), percent=99, shingle=1).collect()}
    assert near == {1: (61, 1), 2: (61, 2), 3: (1, 3), 4: (1, 4), 5: (2, 5), 6: (1, 3)}
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(frame(spark, docs)).collect()}
    assert cut == brute_windows(docs, 50)


def template(n, own=17, shared=100):
    """Documents of one template, each pair just too different for 0.85."""
    text = [f"t{k}" for k in range(shared)]
    return [(i, " ".join(text + [f"d{i}x{k}" for k in range(own)])) for i in range(n)]


def test_near_pairs_of_a_template_do_not_grow(spark, monkeypatch):
    counts = []
    links = minhash._links

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return links(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_links", counted)
    for n in (100, 400):
        counts.clear()
        rows = minhash.near_duplicates(frame(spark, template(n)), percent=85, shingle=1).collect()
        assert all(r.component_id == r.doc_id for r in rows)
        # each table's buckets pair with their first; between components nothing is plausible
        assert counts[0] <= 81 * n and sum(counts[1:]) == 0


def test_near_joins_across_components_of_a_template(spark):
    """Documents that do link, among many of the same template that don't."""
    docs = template(150)
    for k in range(0, 150, 10):
        docs.append((1000 + k, docs[k][1] + " extra"))
    docs += [(2000 + k, docs[k][1].replace(f"d{k}x3 ", "changed ")) for k in range(0, 150, 15)]
    want = brute_near(docs, 1, 85)
    rows = minhash.near_duplicates(frame(spark, docs), percent=85, shingle=1).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in want.items()}


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_prefix_filter_is_exact(percent):
    """Every pair at the threshold is among the plausible ones, whatever the sizes."""
    import collections

    rnd = random.Random(percent)
    base = rnd.sample(range(1000), 60)
    sets = []
    for _ in range(80):
        kept = rnd.sample(base, rnd.randint(20, 60))
        sets.append(sorted({*kept, *rnd.sample(range(1000, 1100), rnd.randint(0, 15))}))
    count = collections.Counter(x for s in sets for x in s)
    shared = [sorted(({"n": count[x], "s": x} for x in s if count[x] > 1), key=lambda e: (e["n"], e["s"])) for s in sets]
    shape = pa.list_(pa.struct([("n", pa.int64()), ("s", pa.int64())]))
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(range(80)), "component": pa.array([k // 4 for k in range(80)]), "n_shingles": pa.array(list(map(len, sets))), "shared": pa.array(shared, shape)}
    )
    tokens = [r for b in minhash._prefixes([batch], percent) for r in b.to_pylist()]
    tokens.sort(key=lambda r: (r["shingle"], r["size"]))
    stream = [pa.RecordBatch.from_pylist(tokens[k : k + 50]) for k in range(0, len(tokens), 50)]
    got = {(r["a"], r["b"]) for b in minhash._plausible(stream) for r in b.to_pylist()}
    for j in range(80):
        for i in range(j):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and i // 4 != j // 4:
                assert (i, j) in got
