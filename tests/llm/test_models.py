import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from docloom.llm import additive_ann, language_id, lm_automaton, quartile_digest, toxicity
from tests.conftest import DATA
from tests.llm.fixtures import TEXTS, documents, saved


def brute_lm(rows):
    train = [zlib.crc32(str("" if d is None else d).encode()) % 5 != 1 for d, _ in rows]
    docs = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    c, c2 = collections.Counter(), collections.Counter()
    for k, x in zip(train, docs, strict=True):
        if k:
            c.update(x)
            c2.update(zip([b"", *x[:-1]], x, strict=True))
    n, v, out = sum(c.values()), len(c), []
    for (d, _), k, x in zip(rows, train, docs, strict=True):
        base = score = 0.0
        h = b""
        for w in x:
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            prior = lm_automaton.GROWTH * c[h] ** lm_automaton.POWER
            score += math.log10((c2[h, w] + prior * p) / (c[h] + prior) if c[h] else p)
            h = w
        out.append((d, not k, len(x), sum(c[w] > 0 for w in x), n, round(base, 4), round(score, 4)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("where", "block"), [("edge", None), ("edge", 60), ("table", None), ("table", 900)])
def test_op4(spark, tmp_path, monkeypatch, where, block):
    if block:  # many blocks, and many parts for each
        monkeypatch.setattr(lm_automaton, "BLOCK", block)
        monkeypatch.setattr(lm_automaton, "PART", 20_000)
    folder = DATA if where == "table" else saved(spark, tmp_path / "d")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(((*r[:5], round(r[5], 4), round(r[6], 4)) for r in lm_automaton.op4_lm_automaton(spark, folder).collect()), key=str)
    assert got == brute_lm(rows)


def test_automaton_is_a_distribution():
    words, counts = 4, np.array([2, 3, 2, 1])
    a = lm_automaton.Automaton(words, counts, np.array([0 * 4 + 1, 1 * 4 + 2]), np.array([2, 3]), 8, 4)
    for state in (0, 1, 2):
        _, p = a.step(np.full(4, state), np.arange(4))
        unknown = 0.5 / (8 + 2.5) * (1 if state == 0 else 10 ** a.failure[state - 1])
        assert abs((10**p).sum() + unknown - 1) < 1e-9


def test_counts_over_a_byte():
    x = np.array([0, 254, 255, 256, 1 << 40])
    assert (lm_automaton._large(lm_automaton._small(x), 5) == x).all()


@functools.cache
def plain_digest(data):
    """Triplet by triplet, bucket by bucket."""
    mixed = [np.random.RandomState(90 + i).permutation(256).tolist() for i in range(5)]
    held = [0] * 256
    for k, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
        for x, y, z in zip(data, data[i:], data[j:], strict=False):
            held[mixed[0][x] ^ mixed[i][y] ^ mixed[j][z] ^ 17 * k] += 1
    if len(data) < 3:
        held = [0] * 256
    ranked = sorted(held)
    q = ranked[63], ranked[127], ranked[191]
    bits = sum(sum(n > x for x in q) << 2 * at for at, n in enumerate(held))
    top = max(q[2], 1)
    head = [1, min(255, round(7.2 * math.log2(len(data) + 1))), 15 * q[0] // top * 16 + 15 * q[1] // top]
    return bytes(head).hex() + bits.to_bytes(64, "little").hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    off = abs(x[1] - y[1]) + abs(x[2] // 16 - y[2] // 16) + abs(x[2] % 16 - y[2] % 16)
    for s, t in zip(x[3:], y[3:], strict=True):
        off += sum([0, 1, 2, 6][abs(s // 4**k % 4 - t // 4**k % 4)] for k in range(4))
    return 1 - min(off, 480) / 480


@pytest.mark.parametrize("where", ["edge", "table", "one"])
def test_op9(spark, tmp_path, where):
    folder = DATA if where == "table" else saved(spark, tmp_path / "d", TEXTS[:1] if where == "one" else [r for i, r in enumerate(TEXTS) if i != 7])
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        third = len(t) // 3
        e = "".join([*list(t)[: len(t) - third], *list(nxt)[:third]])
        f, g, h = (plain_digest(x.encode()) for x in (t, e, nxt))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)))
    got = quartile_digest.op9_quartile_digest(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_digests():
    x = np.frombuffer(hashlib.shake_256(b"x").digest(3_000_000), np.uint8)
    assert (quartile_digest._counted(x) == quartile_digest.counts(x)).all()
    assert quartile_digest.edited("abcdefghi", "xy") == "abcdefxy" and quartile_digest.edited("ab", "xy") == "ab"
    assert quartile_digest.likeness(quartile_digest.digest(b""), quartile_digest.digest(b"")) == 1


def test_op9_empty_and_repeated(spark, tmp_path):
    assert quartile_digest.op9_quartile_digest(spark, saved(spark, tmp_path / "e", [])).count() == 0
    assert quartile_digest.op9_quartile_digest(spark, saved(spark, tmp_path / "d")).count() == len(TEXTS)


def brute_languages(rows, size=400):
    """Rank-order profiles with dictionaries; rows: (doc_id, text, lang)."""

    def ranked(counts):
        order = sorted(counts, key=lambda g: (-counts[g], len(g), [1 if c == "_" else ord(c) for c in g]))
        return {g: place for place, g in enumerate(order[:size])}

    def grams(text):
        out = collections.Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            w = f"_{word}_"
            out.update([*word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))])
        return out

    learnt = collections.defaultdict(collections.Counter)
    held = [zlib.crc32(str("" if d is None else d).encode()) % 4 == 2 for d, _, _ in rows]
    counts = [grams(t) for _, t, _ in rows]
    for out, (_, text, lang), c in zip(held, rows, counts, strict=True):
        if not out and text is not None and lang is not None and c:
            learnt[lang].update(c)
    profiles = {k: ranked(v) for k, v in sorted(learnt.items())}
    want = []
    for out, (d, _, _), c in zip(held, rows, counts, strict=True):
        if not c:
            want.append((d, out, "und", 0.0))
            continue
        own = ranked(c)
        away = sorted((sum(abs(p[g] - i) if g in p else size for g, i in own.items()), k) for k, p in profiles.items())
        first, second = away[0][0], away[1][0]
        want.append((d, out, away[0][1], round(second / (first + second), 9)))
    return sorted(want, key=str)


@pytest.mark.parametrize("where", ["edge", "table"])
def test_op8_by_brute_force(spark, tmp_path, where):
    folder = DATA if where == "table" else saved(spark, tmp_path / "d")
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.op8_language_id(spark, folder).collect()]
    assert sorted(got, key=str) == brute_languages(rows)


def test_op8(spark, tmp_path):
    rows = language_id.op8_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in language_id.op8_language_id(spark, saved(spark, tmp_path / "d")).collect()}
    assert [got[i] for i in (3, 4, 5, 8)] == ["und"] * 4 and got[2] != "und"
    assert language_id.op8_language_id(spark, saved(spark, tmp_path / "e", [])).count() == 0


def test_grams_by_hand():
    own, gram, n = language_id.grams(["Ab a", None, "1", "漢字" * 3])
    b = language_id._BITS
    code = lambda s: sum((1 if c == "_" else ord(c)) << b * (len(s) - 1 - i) for i, c in enumerate(s))
    counts = {(int(o), int(g)): int(k) for o, g, k in zip(own, gram, n, strict=True)}
    assert {g: k for (o, g), k in counts.items() if o == 0} == {code(s): k for s, k in {"a": 2, "b": 1, "_a": 2, "ab": 1, "b_": 1, "a_": 1, "_ab": 1, "ab_": 1, "_a_": 1}.items()}
    assert set(own.tolist()) == {0, 3}


def brute_toxicity(model, text):
    """The forward pass, window by window and filter by filter."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    zero = np.zeros(model.emb.shape[1])
    x = [zero, *(model.emb[model.slot[zlib.crc32(w.encode()) % model.settings.buckets]].astype(float) for w in words), zero, zero]
    pooled = [max(sum(float(x[p + j] @ f[j, :, c]) for j in range(width)) for p in range(len(x) - 2)) for width, f in model.filters.items() for c in range(f.shape[2])]
    z = sum(max(r + float(b), 0) * float(o) for r, b, o in zip(pooled, model.bias, model.out, strict=True)) + model.shift
    votes = {k: sum(w in v.split() for w in words) for k, v in toxicity.MARKERS.items()}
    best = max(votes.values())
    language = next(k for k in votes if votes[k] == best) if best else ""
    return 1 / (1 + math.exp(-(z - model.thresholds.get(language, model.thresholds[""]))))


def test_op10_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    few = [*sorted((r.text for r in docs.select("text").collect()), key=lambda t: hashlib.md5(t.encode()).digest())[:40], None, "", "12 34", "damn " * 3]
    got = toxicity.score(documents(spark, [(i, t, "en", "a") for i, t in enumerate(few)]).drop("score"), model).collect()
    for r in got:
        assert abs(r.score - brute_toxicity(model, few[r.doc_id])) < 1e-4


def test_op10(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.op10_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op10_toxicity(spark, saved(spark, tmp_path / "d", labels=labels)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id in (1, 7)}
    assert len(same) == 1
    assert toxicity.op10_toxicity(spark, saved(spark, tmp_path / "e", [], labels=labels)).count() == 0


def test_whole_text_is_scored(spark):
    clean, foul = "plain words here", "badword"
    rows = [(i, f"{clean} {foul if i % 3 == 0 else 'fine'} {i}", "en", "a") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    long = f"{clean} " * 20_000
    got = toxicity.score(documents(spark, [(1, long + foul, "en", "a"), (2, long, "en", "a")]).drop("score"), model).collect()
    assert got[0].score >= 0.5 > got[1].score
    kept = toxicity.score(documents(spark, [(1, long + foul, "en", "a"), (2, long, "en", "a")]), model, keep_below=0.5).collect()
    assert [r.doc_id for r in kept] == [2]


def brute_near(rows, k):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in x:
        if q % 50 == 0:
            c = sorted(((-float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), i) for i in x if i != q))
            out[q] = [i for _, i in c[:k]]
    return out


def test_op1(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute_near(rows, 5)
    got: dict = {}
    for r in additive_ann.op1_additive_ann(spark, DATA).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) / (5 * len(want)) >= 0.9


def test_op1_edges(spark, tmp_path):
    n = float("nan")
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [n, 1.0], "x"), (7, [None, 1.0], "x"), (8, [1.0], "x"), (None, [1.0, 0.0], "x"), (50, [0.0, 1.0], "x"), (50, [0.0, 1.0], "x"), (100, [float("inf"), 1.0], "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").write.parquet(f"{tmp_path}/d/embeddings.parquet")
    got = [tuple(r) for r in additive_ann.op1_additive_ann(spark, f"{tmp_path}/d").orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got[:5]] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (0, 5, 50)]
    assert [r[2] for r in got if r[0] == 50] == [3, 0, 1, 2]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e/embeddings.parquet")
    assert additive_ann.op1_additive_ann(spark, f"{tmp_path}/e").count() == 0


def test_op1_of_extreme_vectors(spark, tmp_path):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1.0, 1.0]), (50, [0.0, -1e308]), (51, [1e300, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/d/embeddings.parquet")
    got = additive_ann.op1_additive_ann(spark, f"{tmp_path}/d").orderBy("query_id", "rank").collect()
    near = sorted(((r.query_id, r.vec_id, round(r.score, 9)) for r in got), key=lambda r: (r[0], -r[2], r[1]))
    h = round(0.5**0.5, 9)
    assert near == [(0, 2, 1.0), (0, 1, h), (0, 51, h), (0, 50, -h), (50, 1, 0.0), (50, 51, 0.0), (50, 0, -h), (50, 2, -h)]


def test_index_is_stored_and_scores_are_exact(spark):
    v, dims = additive_ann.valid(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    s = additive_ann.Settings(books=6, words=16, rounds=1)
    index = additive_ann.indexed(v, additive_ann.fitted(v, s))
    assert index.columns == ["vec_id", "embedding", "codes", "norm"] and index.count() == v.count() and {len(r.codes) for r in index.collect()} == {6}
    x = {r.vec_id: np.array(r.embedding) for r in v.collect()}
    for r in additive_ann.search(v, v.where("vec_id % 100 = 0"), 5, s).collect():
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_query_batches_agree(spark):
    v, _ = additive_ann.valid(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    q = v.where("vec_id % 20 = 0")
    s = additive_ann.Settings(books=4, words=16, rounds=1)
    small = additive_ann.Settings(books=4, words=16, rounds=1, query_rows=16)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(additive_ann.search(v, q, 5, s)) == key(additive_ann.search(v, q, 5, small))


def test_op4_empty(spark, tmp_path):
    assert lm_automaton.op4_lm_automaton(spark, saved(spark, tmp_path / "d", [])).count() == 0


def test_op9_one_id(spark, tmp_path):
    """All rows hold one id: they are cut into ranges by their texts, and each still has one successor."""
    rows = [(5, f"text {i % 150} of many, " * (1 + i % 7), "en", "a") for i in range(400)]
    folder = saved(spark, tmp_path / "d", rows)
    got = quartile_digest.op9_quartile_digest(spark, folder).collect()
    texts = [r[1] for r in rows]
    assert sorted(r.fingerprint for r in got) == sorted(plain_digest(t.encode()) for t in texts) and {r.doc_id for r in got} == {5}
    # the order of equal ids, over all rows: signed XXH64 falling, equal texts together
    ties = {r.text: r.h for r in spark.read.parquet(f"{folder}/documents.parquet").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(texts, key=lambda t: -ties[t])
    want = []
    for t, n in zip(order, [*order[1:], order[0]], strict=True):
        want.append(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
