"""Edge rows and rules that the tables do not hold."""

import difflib
import itertools
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vector as V
from docloom.operators import changes, chunking, evaluation, extract, graph, retrieval
from docloom.plans import catalog
from docloom.sources import readers, sinks
from docloom.streaming import feeds
from tests.conftest import DATA


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "severe"),
    [(None, True), ("short", True), ("(cid:12) (cid:13) word and more words", True), ("A fine sentence of words.", False), ("�� still a fine sentence", False), ("��� no fine sentence", True), ("中" * 30, True)],
)
def test_severe_corruption(spark, text, severe):
    assert one(spark, text, X.severely_corrupted) is severe


def test_cleaning(spark):
    assert one(spark, "aaaaaaaaaaaaaaaa b(cid:7)\x01 c", X.cleaned) == "aaa b c"
    assert one(spark, "Chapter one ............ 12", X.cleaned) == "Chapter one ............ 12"
    assert one(spark, "Hello•  world . . again,,, yes", X.without_gibberish) == "Hello world . again, yes"


@pytest.mark.parametrize(("text", "ok"), [(None, None), ("", False), ("1234567890123", False), ("[a list of things]", False), ("eleven chars", True)])
def test_usable(spark, text, ok):
    assert (one(spark, text, X.usable) or False) is (ok or False)


def test_tokens_and_windows(spark):
    assert one(spark, "  a \n b  ", X.whitespace_tokens) == ["a", "b"]
    assert one(spark, "   ", X.whitespace_tokens) == []
    assert one(spark, "A b. C d! E f? G", lambda c: X.sentence_windows(c)) == ["A b. C d! E f?", "E f? G"]
    assert one(spark, "one two", lambda c: X.ngrams(c, 3)) == ["one two"]
    assert one(spark, "NOTE this", X.verdict) == "NO"
    assert one(spark, "NOTE this, YES", lambda c: X.verdict(c, whole_word=True)) == "YES"
    assert one(spark, 'say {"a": {"b": 1}} end', X.json_object) == '{"a": {"b": 1}}'


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.7071, 0.0]
    assert one(spark, [0.12345, -0.5], V.quantised, "array<double>") == [1234, -5000]


def test_uuid5(spark):
    names = ["a", "https://example.org/x.pdf", "é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(changes.uuid5(str(uuid.NAMESPACE_URL), F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_diff_duplicates_and_nulls(spark):
    old = spark.createDataFrame([("u1", "a", 1), ("u2", None, 1), ("u3", "c", 1)], "url string, title string, v int")
    new = spark.createDataFrame([("u1", "x", 1), ("u1", "a", 2), ("u2", None, 1), ("u4", "d", 1)], "url string, title string, v int")
    got = {r.url: r.change for r in changes.diff(old, new, "url", ["title"], "v").collect()}
    assert got == {"u1": "unchanged", "u2": "unchanged", "u3": "removed", "u4": "new"}


def test_ordered_union_keeps_rows_without_key(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n")], "id int, x string")
    b = spark.createDataFrame([(1, "b"), (2, "c"), (None, "m")], "id int, x string")
    assert sorted(r.x for r in changes.ordered_union([a, b], "id", "x").collect()) == ["a", "c", "m", "n"]


def test_upsert_clears_only_changed(spark):
    old = spark.createDataFrame([(1, "a", "e1"), (2, "b", "e2"), (3, "c", "e3")], "id int, t string, e string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id int, t string")
    assert {tuple(r) for r in changes.upsert(old, new, "id", "t", ["e"]).collect()} == {(1, "a", "e1"), (2, "B", None), (3, "c", "e3"), (4, "d", None)}


def test_cascade(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    chunks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "chunk_id string, doc_id int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    left = changes.cascade_delete(docs, chunks, edges, docs.where("doc_id = 1"))
    assert [f.count() for f in left] == [1, 2, 1]


def test_chunker():
    s = [f"Sentence number {i} has a good many words in it, it does." for i in range(12)]
    chunks = chunking.accumulate([("Title", "Head"), ("Text", " ".join(s)), ("Text", "  ")], 200, 2)
    assert chunks[0] == "Head"
    assert all(len(c) >= 200 for c in chunks[1:-1])
    assert chunks[2].startswith(s[2]) and chunks[-1].endswith(s[-1])
    assert chunking.merge_short(["a", "b" * 30, "c"], 20) == ["a " + "b" * 30, "c"]
    assert chunking.split_long("A. " * 400, 1000)[0].startswith("A. A.")


def test_paragraphs_restart_on_every_turn_of_page(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([1, 1, 2, 1, 1, 1])], "d int, i int, page int")
    assert [r.paragraph for r in chunking.paragraph_numbers(df, "d", "i", "page").orderBy("i").collect()] == [1, 2, 1, 1, 2, 3]


def test_graph_rules(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "n long")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 0, 0.9), (0, 1, 0.9), (3, 3, 0.9)], "source long, target long, confidence double")
    assert {r.n: r.degree for r in graph.degree(edges, nodes, "n").collect()}[0] == 0.5
    ranks = {r.n: r.pagerank for r in graph.pagerank(edges, nodes, "n", 20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-4
    path = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5)], "source long, target long, confidence double")
    assert {r.n: r.betweenness for r in graph.betweenness(path, nodes.where("n < 3"), "n").collect()} == {0: 0.0, 1: 0.5, 2: 0.0}
    two = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0)], "source long, target long, confidence double")
    found = {r.n: r.community for r in graph.communities(two, nodes, "n").collect()}
    assert found[0] == found[1] == found[2] != found[3] == found[4]


def test_communities_of_more_than_a_thousand_nodes(spark):
    nodes = spark.range(1200).select(F.col("id").alias("n"))
    pairs = nodes.where("n % 3 > 0").select((F.col("n") - 1).alias("source"), F.col("n").alias("target"), F.lit(1.0).alias("confidence"))
    found = {r.n: r.community for r in graph.communities(pairs, nodes, "n").collect()}
    assert found == {i: i // 3 for i in range(1200)}


@pytest.mark.parametrize("name", ["betweenness", "communities"])
def test_graph_queries_take_every_node(spark, tmp_path, name):
    spark.read.parquet(f"{DATA}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    e.withColumn("vec_id", F.col("vec_id") + 250).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.queries()[name](spark, str(tmp_path)).count() == e.count()


def test_walk_has_no_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (2, 3, 0.9)], "source long, target long, confidence double")
    seeds = spark.createDataFrame([(1, 1.0)], "id long, rel double")
    got = {(r.node, r.hops): r.confidence for r in graph.multi_hop(edges, seeds, "id", "rel", 3).collect()}
    assert got == {(1, 0): 1.0, (2, 1): 0.81, (3, 2): 0.6561}


def test_relation_prefers_strength(spark):
    df = spark.createDataFrame([("by 2030 reach 40% cut", "our target is clear")], "a string, b string")
    from docloom.lexicons import RELATIONS

    r = df.select(graph.relation(F.col("a"), F.col("b"), RELATIONS).alias("r")).first().r
    assert (r.type, r.strength) == ("SUPPORTS", 0.8)


def test_label_rules(spark):
    df = spark.createDataFrame([(1, "The net zero scenario for the electricity grid", 0.9), (2, "net zero power by mid-century", 0.5)], "id int, t string, s double")
    got = {(r.id, r.label): r.answer for r in extract.labels_of(df, "id", "t", "s").collect()}
    assert got[1, "electricity_net_zero"] == "soft_yes" and got[1, "net_zero_target"] == "yes" and got[2, "net_zero_target"] == "low_confidence"
    assert df.select(extract.entity_tags(F.col("t"))["years"]).collect()[1][0] == ["2050"]


def test_page_markdown():
    html = '<nav><ul><li>One <b>two</b></li></ul></nav><script>var a = "</p>";</script><h3 id="x">Head</h3><h3>Sub</h3><p>Text &amp; more</p>'
    assert extract.markdown_lines(html) == ["- One **two**", "## Head", "### Sub", "Text & more"]


def test_answer_blocks(spark):
    md = "# T\n### Q one?\nBody a\nSource URL: http://x/y\n### Q two?\nBody b"
    rows = extract.answer_blocks(spark.createDataFrame([(md,)], "t string"), "t").orderBy("nth").collect()
    assert [(r.question, r.url) for r in rows] == [("Q one?", "http://x/y"), ("Q two?", "")]


def test_prf_matches_golden_counts(spark):
    rows = [(t, p, lab) for lab, (tp, fp, fn) in {"net_zero": (9, 0, 0), "sector": (8, 1, 0), "efficiency": (7, 0, 1), "electricity": (1, 0, 6), "carbon": (2, 0, 3)}.items() for t, p in [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn]
    got = {r.value or "all": r for r in evaluation.precision_recall(spark.createDataFrame(rows, "t int, p int, label string"), "t", "p", ["label"]).collect()}
    assert (round(got["all"].precision, 2), round(got["all"].recall, 2), round(got["all"].f1, 4)) == (0.96, 0.73, 0.8308)
    assert round(got["electricity"].f1, 2) == 0.25


def test_ratio(spark):
    df = spark.createDataFrame([("carbon tax", "carbon taxes")], "a string, b string")
    assert df.select(retrieval.ratio_udf()("a", "b")).first()[0] == difflib.SequenceMatcher(None, "carbon tax", "carbon taxes").ratio()


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, s double")
    assert [r.s for r in retrieval.min_max(df, "s").collect()] == [0.0, 0.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"a": {"b": 1, "c": "x"}}')
    (tmp_path / "j" / "n.json").write_text("null")
    df = readers.json_documents(spark, str(tmp_path / "j"))
    assert "a.b" in readers.flattened(df.select("a")).columns
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "p" / "y.txt").write_bytes(b"text")
    assert {r.is_pdf for r in readers.binary_files(spark, str(tmp_path / "p")).collect()} == {True, False}
    out = spark.createDataFrame([(1, 'a "q"', "x")], "id int, t string, c string")
    sinks.quoted_csv(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 1
    sinks.json_by(out, str(tmp_path / "js"), "c")
    good, bad = sinks.parted(out, F.col("id") > 1)
    assert (good.count(), bad.count()) == (0, 1)


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    q = feeds.apply_each(feeds.deduplicated(feeds.files(spark, str(tmp_path / "in"), rows.schema), "event_id"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    assert sum(seen) == 1
    stream = feeds.event_windows(feeds.files(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("win").count() == 1


def test_embedder_is_called_in_batches(spark):
    from docloom.operators import embedding

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], "id int, t string")
    got = embedding.embedded(df, "t", lambda: lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=2).orderBy("id").collect()
    assert [r.embedding[0] for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0] and max(r.embedding[1] for r in got) <= 2


def test_projection_keeps_rows(spark):
    from docloom.operators import embedding

    df = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(6)], "id int, v array<double>")
    assert {len(r.projected) for r in embedding.projected(df, "v").collect()} == {2}


def test_nearest_of_edge_vectors(spark):
    from docloom.operators import knn

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [None, 1.0])], "id long, v array<double>")
    got = [(r.source, r.target, r.score) for r in knn.nearest(df, df.where("id = 1"), 5, "id", "v").orderBy("rank").collect()]
    assert got == [(1, 3, 0.707107), (1, 2, 0.0)]


def test_nearest_of_unlike_lengths(spark):
    from docloom.operators import knn

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 1.0, 0.0])], "id long, v array<double>")
    got = [(r.source, r.target, r.score) for r in knn.nearest(df, df, 5, "id", "v").orderBy("source", "rank").collect()]
    assert got == [(1, 3, 0.707107), (2, 6, 0.0), (3, 1, 0.707107), (6, 2, 0.0)]


@pytest.mark.parametrize("f", [lambda c: X.ngrams(c, 3), X.sentence_windows])
def test_windows_take_linear_time(spark, f):
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"word{i}." for i in range(n)),)], "x string").cache()
        df.count()
        began = time.time()
        assert df.select(F.size(f(F.col("x")))).first()[0] > n / 3
        return time.time() - began

    seconds(1_000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.25)


def test_betweenness_of_any_size(spark):
    nodes = spark.range(1200).select(F.col("id").alias("n"))
    ring = nodes.select(F.col("n").alias("source"), ((F.col("n") + 1) % 1200).alias("target"), F.lit(1.0).alias("confidence"))
    ring = ring.where("source % 100 < 99")  # twelve paths of a hundred nodes
    got = {r.n: r.betweenness for r in graph.betweenness(ring, nodes, "n").collect()}
    assert len(got) == 1200 and all(got[i] == round((i % 100) * (99 - i % 100) / (1199 * 1198), 6) for i in range(1200))
    assert {r.betweenness for r in graph.betweenness(ring, nodes, "n", below=1200).collect()} == {0.0}


def test_pagerank_is_the_fixed_point(spark):
    import numpy as np

    rng, n = np.random.default_rng(3), 60
    links = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 50, 200), rng.integers(0, n, 200), rng.uniform(0.5, 1, 200), strict=True)}
    m = np.full((n, n), 1 / n)  # nodes that lead nowhere give to all
    for s in {a for a, _ in links}:
        m[:, s] = 0
    for (a, b), w in links.items():
        m[b, a] = w / sum(x for (c, _), x in links.items() if c == a)
    want = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "source long, target long, confidence double")
    nodes = spark.range(n).select(F.col("id").alias("n"))
    got = {r.n: r.pagerank for r in graph.pagerank(edges, nodes, "n", tolerance=1e-8).collect()}
    assert max(abs(got[i] - want[i]) for i in range(n)) < 2e-6
    few = {r.n: r.pagerank for r in graph.pagerank(edges, nodes, "n").collect()}
    assert sum(abs(few[i] - want[i]) for i in range(n)) < 1e-6 * n / 0.15 + n * 1e-6


def test_communities_against_plain_merging(spark):
    import random

    random.seed(5)
    links = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(90)})
    groups, m = [{v} for v in range(40)], len(links)
    deg = lambda g: sum((a in g) + (b in g) for a, b in links)
    while True:
        gains = [(2 * m * sum((a in p and b in q) or (a in q and b in p) for a, b in links) - deg(p) * deg(q), -min(p), -min(q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if min(p) < min(q)]
        gain, _, _, i, j = max(gains)
        if gain <= 0:
            break
        groups[i] |= groups[j]
        del groups[j]
    want = {v: k for k, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))) for v in g}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "source long, target long, confidence double")
    got = {r.n: r.community for r in graph.communities(edges, spark.range(40).select(F.col("id").alias("n")), "n").collect()}
    assert got == want


def test_fuzzy_patterns_against_difflib(spark):
    import re

    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()} | {-1: "with a the", -2: "", -3: "with the end with the"}

    def score(t):
        hits = len(re.findall(r"\bwith\s+the\b", t))
        w = t.split()
        grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        best = max(difflib.SequenceMatcher(None, "with the and", g).ratio() for g in grams)
        return float(hits) or (best if best >= 0.6 else 0.0)

    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {r.id: r.score for r in retrieval.fuzzy_pattern_score(df, "t", r"\bwith\s+the\b", ["with", "the", "and"], "id").collect()}
    assert got == {i: score(t) for i, t in texts.items()}


def test_bm25_of_several_terms(spark):
    import math

    texts = ["a b b c", "b c", "d", "a d d", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.score for r in retrieval.bm25(df, ["b", "a", "zz"], "id", "t").collect()}
    docs = [(t or "").split() for t in texts]
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w in "abcd" for n in [sum(w in d for d in docs)]}
    mean, avg = sum(idf.values()) / 4, sum(map(len, docs)) / len(docs)
    want = {i: round(sum((idf[w] if idf[w] >= 0 else 0.25 * mean) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in "ab"), 6) for i, d in enumerate(docs) if set("ab") & set(d)}
    assert got == want


def test_entry_point_without_the_subpackage(spark):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, globals_=None, locals_=None, fromlist=(), level=0):
        if name.startswith("docloom.llm") or (name == "docloom.llm"):
            raise ImportError(name)
        return real(name, globals_, locals_, fromlist, level)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("docloom.llm") or k == "__spark_entry__"}
    builtins.__import__ = blocked
    try:
        entry = importlib.import_module("__spark_entry__")
        assert not any(k.startswith("op") and k[2].isdigit() for k in entry.queries()) and "vector_topk" in entry.queries()
    finally:
        builtins.__import__ = real
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(kept)


def plain_gibberish(x):
    """The cleaned text or None, by plain string steps."""
    words, cids = x.split(), len(re.findall(r"\(cid:[0-9]+\)", x))
    if len(x) < 10 or (words and cids / len(words) > 0.3) or x.count("�") >= 3:
        return None
    if len(x) > 20 and len(re.findall(X.LEGITIMATE, x, re.ASCII)) / len(x) < 0.4:
        return None
    y = re.sub(r"\(cid:[0-9]+\)", " ", x)
    if not re.search(r"^[^.]*\.{10,}[^.]*$", y):
        y = "".join(c * (3 if n > 10 else n) for c, n in ((c, len(list(g))) for c, g in itertools.groupby(y)))
    y = re.sub(r"[\x00-\x08\x0e-\x1f\x7f]", " ", y.replace("�", " "))
    y = re.sub(r"\s+", " ", y, flags=re.ASCII).strip(" ")
    for mark in "•|¦":
        y = y.replace(mark, "")
    for c in ".,;:!?":
        y = y.replace(c * 3, c).replace(f"{c} {c}", c)
    y = y.strip(" ")
    return y if len(y) > 5 else None


def test_chunks_and_gibberish_by_brute_force(spark):
    odd = ["a" * 30 + " bb plain words", "Contents ............ 12", "(cid:1) (cid:2) x", "Wait... what; ; no!!!", "��� some words here", "漢字" * 20, "one two\x07three  four", "• | item list", None, ""]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(odd, 10_000_000)), "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r.t for r in docs.select("doc_id", X.without_gibberish(F.col("text")).alias("t")).collect()}
    assert got == {k: plain_gibberish(t) for k, t in rows}
    want = set()
    for k, t in rows:
        merged = chunking.merge_short(chunking.accumulate([("NarrativeText", line) for line in t.split("\n")]))
        parts = [p for c in merged for p in chunking.split_long(c)]
        want |= {(k, i, plain_gibberish(p)) for i, p in enumerate(parts) if plain_gibberish(p) is not None}
    assert {tuple(r) for r in chunking.cleaned_chunks(docs).collect()} == want


def test_neighbours_in_parts_against_plain_distances(spark):
    import numpy as np

    from docloom.operators import knn

    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(4500, 12)), np.repeat(r.normal(size=(3, 12)), 100, axis=0), np.zeros((5, 12))])
    ids = r.permutation(len(x))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    asked = rows.where("id % 7 = 0")
    # the rows, which come in one part, are dealt out to many queries
    assert "Repartition" in knn.nearest(rows.coalesce(1), asked, 4, "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    u = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)
    for measure in ("cosine", "euclidean"):
        got = {}
        for s in knn.nearest(rows, asked, 4, "id", "v", measure, batch=500).orderBy("source", "rank").collect():
            got.setdefault(s.source, []).append((s.target, round(s.score, 6)))
        for n in np.flatnonzero(ids % 7 == 0):
            away = -np.round(u @ u[n], 6) if measure == "cosine" else np.round(np.sqrt(((x - x[n]) ** 2).sum(axis=1)), 6)
            best = [i for i in np.lexsort((ids, away)) if i != n][:4]
            assert got[int(ids[n])] == [(int(ids[i]), pytest.approx(abs(away[i]) if measure == "euclidean" else -away[i], abs=1e-6)) for i in best]


@pytest.mark.parametrize("name", ["unit_vectors", "pooled_vectors"])
def test_rounded_vectors_keep_the_sign_of_zero(spark, tmp_path, name):
    import duckdb

    rows = [(1, [-1e-9] + [0.5] * 63), (2, [0.5, -1e-9, 0.25, -3e-8] * 16), (3, [1e-9, -0.5] * 32)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: [repr(x) for x in r[1]] for r in con.execute(catalog.oracle_sql()[name]).fetchall()}
    assert {r[0]: [repr(x) for x in r[1]] for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == want
    assert any("-0.0" in v for v in want.values())


def test_dropped_gibberish_is_cleaned_once(spark):
    texts = ["short", "a  b c d e f", "ab cd ef", "word " * 9, "(cid:1)(cid:2) ab cd ef gh", "�" * 4 + " with the and more", "zzzzzzzzzzzzzzzzzz ab ab", "12 34 56 78 9", "•|¦ . . . ,,, ok then that", "##########################", "tab\tand\n\nline  end", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {r.id: r.c for r in df.select("id", X.without_gibberish(F.col("t")).alias("c")).collect() if r.c is not None}
    dropped = X.gibberish_dropped(df, "t", "c").select("id", "c")
    assert {r.id: r.c for r in dropped.collect()} == want and 0 < len(want) < len(texts)
    assert "isnotnull(CASE" not in catalog.queries()["gibberish_removed"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_grams_stay_where_they_are_read(spark):
    assert "explode(" not in catalog.queries()["ngrams"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_folds_hold_few_rows_at_a_time():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(10)), pa.array(["x"] * 9 + [None])], names=["k", "v"])
    schema = pa.schema([("k", pa.int64()), ("i", pa.int32()), ("v", pa.string())])
    out = list(chunking.in_slices(lambda k, v: [(k, i, v) for i in range(k % 3)], schema, 4)(iter([batch])))
    assert max(b.num_rows for b in out) <= 4 and len(out) == 3
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(k, i, None if k == 9 else "x") for k in range(10) for i in range(k % 3)]


def test_ratios_by_bounds_are_difflibs(monkeypatch):
    import random

    random.seed(3)
    plain, made = difflib.SequenceMatcher, []
    word = lambda: "".join(random.choices("abtheinwd", k=random.randint(1, 7)))
    pairs = [("with the and", " ".join(word() for _ in range(3))) for _ in range(300)]
    texts = [" ".join(random.choices(["the", "and", "from", "ouen", *(word() for _ in range(80))], k=random.choice([1, 5, 300]))) for _ in range(60)]

    def whole(a, b):
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
        return 1.0 if both and (x <= y or y <= x) else max(plain(None, p, q).ratio() for p, q in ((both, left), (both, right), (left, right)))

    want = [r if (r := plain(None, x, y).ratio()) >= 0.6 else 0.0 for x, y in pairs], [whole(t, catalog.QUERY) for t in texts]
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a: made.append(1) or plain(*a))
    assert [retrieval.ratio_of(x, y, 0.6) for x, y in pairs] == want[0] and len(made) < 250
    del made[:]
    assert [retrieval.token_set_ratio(t, catalog.QUERY) for t in texts] == want[1] and len(made) < 150


def test_one_row_group_is_chunked_by_many_tasks(spark):
    docs = spark.createDataFrame([(n, f"This is sentence number {n} of them. It is followed by another one.") for n in range(200)], "doc_id long, text string").coalesce(1)
    got = chunking.cleaned_chunks(docs)
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and got.count() == 200
