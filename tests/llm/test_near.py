import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import components, simhash_index
from docloom.llm.simhash_index import _join
from tests.conftest import DATA
from tests.llm.fixtures import TEXTS, documents, saved


def brute_print(text, words):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones += np.array([h >> i & 1 for i in range(64)])
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_roots(fps, limit):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit)
    return _join(np.arange(len(fps)), a, b)


@pytest.mark.parametrize("n", [1, 2, 9, 60, 900])
def test_tree_loses_no_link(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, max(1, n // 6)).astype(np.uint64)
    f = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    f = np.unique(f)
    group = np.sort(rng.integers(0, 3, len(f)))
    order = simhash_index.gray_order(f[:, None], group)
    f = f[order]
    a, b = np.nonzero((np.bitwise_count(f[:, None] ^ f[None, :]) <= 4) & (group[:, None] == group[None, :]))
    assert (simhash_index.links(f[:, None], group, 4, 500) == _join(np.arange(len(f)), a, b)).all()


@pytest.mark.parametrize(("most", "k"), [(20_000, None), (40, None), (20_000, 2), (20_000, 4)])
def test_hot_top_nodes_are_salted_without_loss(spark, most, k):
    rng = np.random.default_rng(5)
    f = np.full(600, 0x123456789ABCDEF, np.uint64)
    for _ in range(5):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64))
    f = np.unique(np.r_[f, rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    stars = components.components(simhash_index.near_links(df, 4, most, k)).collect()
    root = {r.key: r.root for r in stars}
    signed = f.view(np.int64)
    want = brute_roots(f, 4)
    ours = [root.get(int(x), int(x)) for x in signed]
    groups = lambda xs: {frozenset(np.flatnonzero(np.array(xs) == v).tolist()) for v in set(xs)}
    assert groups(ours) == groups(want.tolist())


def test_wide_tree_loses_no_link():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    f = base[rng.integers(0, 40, 400)]
    for _ in range(14):
        f = f.copy()
        f[np.arange(400), rng.integers(0, 4, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, 400))
    f = f[simhash_index.gray_order(f, group)]
    d = np.bitwise_count(f[:, None] ^ f[None, :]).sum(axis=2)
    a, b = np.nonzero((d <= 20) & (group[:, None] == group[None, :]))
    assert (simhash_index.links(f, group, 20) == _join(np.arange(400), a, b)).all()


def test_similar_texts_link_and_others_do_not(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        w = [f"w{k}x{i}" for i in range(400)]
        rows.append((2 * k, " ".join(w), "en", "a"))
        for at in rng.choice(400, 5, replace=False):  # five words of 400: a similarity of about 0.88
            w[at] = f"new{k}"
        rows.append((2 * k + 1, " ".join(w), "en", "a"))
    kept = {r.doc_id for r in simhash_index.one_of_each(documents(spark, rows)).collect()}
    assert {d for d in range(0, 120, 2)} <= kept and len(kept) <= 63


def test_keys_grow_with_the_table():
    of = simhash_index.bands_for
    assert [of(n, 4, 20_000) for n in (10, 10**7, 10**8, 10**10, 10**13)] == [1, 1, 2, 3, 4]
    for k in (1, 2, 3, 4):
        choices = simhash_index.bands(4, k)
        assert len(choices) == math.comb(4 + k, k) and all(len(x) == k for x in choices)
    assert [simhash_index.turns_for(n, 0.1515) for n in (1000, 1 << 18, 12_000_000, 4 * 10**10)] == [(14, 60), (14, 60), (17, 98), (23, 263)]


@pytest.mark.parametrize("count", [1_000, 12_000_000])  # as many as 30 GB have
def test_links_do_not_depend_on_the_size_of_the_table(spark, count):
    rng = np.random.default_rng(12)
    pairs, share = 1500, simhash_index.different_share(0.8)
    limit = simhash_index.bits_of_similarity(0.8, 256)
    left = rng.integers(0, 256, (pairs, 32), dtype=np.uint8)
    flips = rng.random((pairs, 256)) < share
    right = left ^ np.packbits(flips, axis=1)
    names = simhash_index.WIDE
    words = np.concatenate([left, right]).view(np.int64)
    df = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "id long, " + ", ".join(f"{n} long" for n in names))
    found = {(min(r), max(r)) for r in simhash_index.similar_links(df, names, limit, share, count=count).distinct().collect()}
    within = {(i, pairs + i) for i in np.flatnonzero(flips.sum(axis=1) <= limit).tolist()}
    assert found <= within and len(within) > 0.99 * pairs and len(found) >= 0.97 * pairs


def jaccard_components(texts, words=5, least=0.8):
    def cut(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [cut(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (len(a & b) / len(a | b) if a | b else 1) >= least]
    return _join(np.arange(len(sets)), np.array([i for i, _ in near]), np.array([j for _, j in near]))


@pytest.mark.parametrize("most", [2_000, 6])
def test_similarity_is_told_from_the_shingles(spark, most):
    rng, texts = np.random.default_rng(14), []
    for k in range(40):  # copies with some words changed: from about 0.6 to 0.9
        w = [f"w{k}x{i}" for i in range(300)]
        texts.append(" ".join(w))
        for n in (3, 5, 7, 8, 12):
            v = list(w)
            for at in rng.choice(300, n, replace=False):
                v[at] = f"new{k}n{n}a{at}"
            texts.append(" ".join(v))
    line = " ".join(f"notice{i}" for i in range(12))
    texts += [" ".join([line] * 20 + [f"own{k}y{i}" for i in range(60)]) for k in range(20)]  # one short line, often
    got = {r.doc_id: r.root for r in simhash_index.similar_components(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), most=most).collect()}
    groups = lambda xs: {frozenset(np.flatnonzero(np.array(xs) == v).tolist()) for v in set(xs)}
    assert groups([got[i] for i in range(len(texts))]) == groups(jaccard_components(texts).tolist())


def test_components_of_a_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (200, 201)], "a long, b long")
    got = {r.key: r.root for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[201] == got[200] == 200


@pytest.mark.parametrize("where", ["edge", "table"])
def test_op2(spark, tmp_path, where):
    folder = DATA if where == "table" else saved(spark, tmp_path / "d")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    fps = np.array([brute_print(t, 4) for _, t in rows], np.uint64)
    root = brute_roots(fps, 4)
    least = {k: min((d for (d, _), x in zip(rows, root, strict=True) if x == k and d is not None), default=None) for k in set(root.tolist())}
    want = sorted(((d, f"{int(f):016x}", least[k]) for (d, _), f, k in zip(rows, fps, root.tolist(), strict=True)), key=str)
    assert sorted(map(tuple, simhash_index.op2_simhash(spark, folder).collect()), key=str) == want


def test_one_stays(spark):
    kept = simhash_index.one_of_each(documents(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(1) == 1 and 7 not in ids and 2 in ids and None in ids
    assert len([i for i in ids if i in (3, 4, 5)]) == 1
    assert simhash_index.one_of_each(documents(spark, [])).count() == 0
    assert len(TEXTS) > len(kept) and "range" in kept[0].asDict()


def test_clashing_columns(spark):
    docs = documents(spark)
    for c in ("_t", "_n", "_x", "_d", "_h", "id", "n", "root", "row", "w0", "one", "turn", "top"):
        docs = docs.withColumn(c, F.lit("own"))
    got = simhash_index.one_of_each(docs)
    assert got.columns == docs.columns and {(r._t, r._n, r.row) for r in got.collect()} == {("own",) * 3}


def test_empty(spark, tmp_path):
    assert simhash_index.op2_simhash(spark, saved(spark, tmp_path / "d", [])).count() == 0
