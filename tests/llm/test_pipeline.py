"""The whole pipeline against brute force, stage by stage in plain Python."""

import base64
import collections
import hashlib
import random
import re

import pytest

pytest.importorskip("public_tokenizers")


def rank(row):
    return row[0] is None, row[0] or 0


def brute(rows):
    rows = [r for r in rows if re.search("[a-z]", r[1] or "")]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub("[ \t-\r]+", " ", r[1])].append(r)
    rows = sorted((min(g, key=rank) for g in groups.values()), key=rank)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (r[1].split() for r in rows)]
    head = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(head[i], head[j]), min(head[i], head[j])
                head = [new if h == old else h for h in head]
    rows = [r for k, r in enumerate(rows) if head[k] == k]
    out = collections.Counter()
    for i, text in rows:  # one source: a rate of 1.5
        key = hashlib.md5(text.encode()).hexdigest() if i is None else i
        coin = int(hashlib.md5(f"7:{key}".encode()).hexdigest()[:8], 16) / 2**32
        out[i, hashlib.sha256(text.encode()).hexdigest()] += 1 + (coin < 0.5)
    return out


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, rows, folder, extra=""):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *([0] * extra.count(" long"))) for i, t in rows], SHAPE + extra)
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def fixture():
    rnd = random.Random(12)
    words = [f"word{i}" for i in range(500)]
    a, b, c, d, e, f = (" ".join(rnd.choices(words, k=60)) for _ in range(6))
    rows = [(1, a), (1, a), (7, a), (2, b), (3, b + " more"), (3, c), (4, d), (None, d), (None, e), (None, e), (8, e + " tail"), (None, f), (None, f), (5, "12 34 !!"), (6, None)]
    return rows + [(9, ""), (10, " \n\t"), (11, " ".join(rnd.choices(words, k=200_000))), (12, "short"), (13, "short "), (14, "short\tone")]


# clashing with names that the operators use inside
EXTRA = ", _row long, row long, component_id long, token_ids long, n_tokens long, language long, key long"


@pytest.mark.parametrize("extra", ["", EXTRA])
def test_run(spark, tmp_path, extra):
    import corpus_pipeline as cp

    place = stored(spark, fixture(), tmp_path, extra)
    out = cp.run(spark, place)
    rows = out.collect()
    got = collections.Counter((r.doc_id, r.decoded_sha256) for r in rows)
    assert got == brute(fixture()) and {i for i, _ in got} == {1, 2, 3, 4, 8, 11, 12, 14, None}
    import tiktoken

    import public_tokenizers

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t for _, t in fixture()}
    assert all(list(r.token_ids) == plain.encode_ordinary(texts[r.decoded_sha256]) and r.n_tokens == len(r.token_ids) for r in rows)


def test_run_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:1] == ["doc_id"]


def test_run_leaves_one_stage_behind(spark, tmp_path):
    import os

    import corpus_pipeline as cp
    from quadrille.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    cp.run(spark, stored(spark, fixture()[:8], tmp_path)).collect()
    new = [x for x in set(os.listdir(root)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{root}/{new[0]}") == ["3_mixing"]
