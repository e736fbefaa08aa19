import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup, mixing
from tests.conftest import DATA
from tests.llm.fixtures import TEXTS, documents, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(rows, least=50):
    """(doc, text) -> (lines, deleted, digest): windows of `least` words that stood earlier."""
    seen, out = {}, []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            continue
        lines = t.split("\n")
        s = [(i, x, len(WORD.findall(x))) for i, x in enumerate(lines)]
        s = [x for x in s if x[2]]
        windows = set()
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += s[b][2]
                if n >= least:
                    windows.add((a, b))
                    break
        for b in range(len(s)):
            n = 0
            for a in range(b, -1, -1):
                n += s[a][2]
                if n >= least:
                    windows.add((a, b))
                    break
        dead = set()
        for a, b in sorted(windows):
            k = tuple(x[1] for x in s[a : b + 1])
            if k in seen and (seen[k][0] != d or seen[k][1] < a):
                dead.update(range(s[a][0], s[b][0] + 1))
            seen.setdefault(k, (d, a))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in dead)
        out.append((d, len(lines), len(dead), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("where", ["edge", "table"])
def test_op3(spark, tmp_path, where):
    folder = DATA if where == "table" else saved(spark, tmp_path / "d", [r for r in TEXTS if r[1] is not None])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted({tuple(r) for r in line_dedup.op3_line_dedup(spark, folder).collect()}, key=str)
    assert got == brute_lines(rows)


def test_runs(spark):
    p = "\n".join(f"{c} " + " ".join(f"w{i}" for i in range(9)) for c in "abcdef")  # 60 words on six lines
    rows = [(1, "own one\n" + p + "\nown two", "en", "s"), (2, "other\n\n" + p + "\nmore", "en", "s"), (3, p.rsplit("\n", 2)[0], "en", "s"), (4, p + "\n" + p, "en", "s"), (5, None, "en", "s")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "other\n\nmore" and got[3] == rows[2][1] and got[4] == "" and got[5] is None
    assert line_dedup.deduplicated(documents(spark, [])).count() == 0


def test_selected_positions_are_few_and_runs_grow(spark):
    """Fewer positions than lines are selected; a match is found from any of them and reaches to both its ends."""
    text = "\n".join(f"five words on line {i}" for i in range(2000))  # ten lines a window: 2 of 11 positions are expected
    lines = line_dedup.selections(documents(spark, [(1, text, "en", "s")]))
    assert lines.count() == 2000 and 250 < lines.where("ahead is not null").count() < 500
    body = [f"line {i} " + " ".join(f"w{i}x{j}" for j in range(i % 7)) for i in range(40)]
    for cut in range(0, 12, 3):  # the second text holds a part of the first, between lines of its own
        rows = [(1, "\n".join(body), "en", "s"), (2, "\n".join(["before"] * 3 + body[cut : cut + 20] + ["after"] * 2), "en", "s")]
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
        assert got == {1: rows[0][1], 2: "before\nbefore\nbefore\nafter\nafter"}


def test_clashing_columns(spark):
    p = "\n".join(f"{c} " + " ".join(f"w{i}" for i in range(9)) for c in "abcdef")
    docs = documents(spark, [(1, p, "en", "s"), (2, p + "\nown", "en", "s")])
    for c in ("runs", "_t", "_k", "_d", "_runs", "shards", "target", "source_size", "block", "copy", "x", "h", "row", "part", "rest", "_n", "n", "t", "root", "id"):
        docs = docs.withColumn(c, F.lit("own"))
    out = line_dedup.deduplicated(docs)
    assert set(out.columns) == set(docs.columns) and {r.text for r in out.collect()} == {p, "own"}
    assert {r._t for r in out.collect()} == {"own"}
    mix = mixing.mixed(docs)
    assert mix.count() == 2 and {(r.block, r.x, r.row) for r in mix.collect()} == {("own",) * 3}


def test_removing_runs_takes_linear_time(spark):
    import time

    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        runs = [(i, i) for i in range(0, n, 10)]
        df = spark.createDataFrame([(text, runs)], "text string, runs array<struct<first:int,last:int>>").cache()
        df.count()
        began = time.time()
        assert len(df.select(line_dedup.without_runs(F.col("text"), F.col("runs"))).first()[0].split("\n")) == n - len(runs)
        return time.time() - began

    seconds(2_000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.25)


def water_fill(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        whole = sum(w[s] for s in open_)
        over = [s for s in open_ if total * w[s] / whole > 3 * sizes[s]]
        if not over:
            return out | {s: total * w[s] / whole for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.remove(s)
        total -= sum(3 * sizes[s] for s in over)
    return out


@pytest.mark.parametrize("where", ["edge", "table"])
def test_op5(spark, tmp_path, where):
    folder = DATA if where == "table" else saved(spark, tmp_path / "d")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = mixing.op5_mixing(spark, folder).collect()
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs if r.doc_id is not None)
    assert len(got) == len(docs) and all(r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0 for r in got)
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    goal = water_fill(sizes)
    source = {r.doc_id: r.source for r in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    most = {s: max(len(WORD.findall(r.text or "")) for r in docs if r.source == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op5_mixing(spark, folder).collect()), key=str)


def test_shards_get_their_quota_and_disjoint_draws(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own, blocks = mixing.plan(docs, shards=8)
    mix = mixing.mixed(docs, shards=8).select("doc_id", "copy", "shard", "size").collect()
    assert len({(r.doc_id, r.copy) for r in mix}) == len(mix)
    draws = blocks.select(F.explode("shards").alias("s")).groupBy("s").count().collect()
    assert len(draws) == 8 and max(r["count"] for r in draws) - min(r["count"] for r in draws) <= 8
    taken = {r.doc_id: r.taken for r in mixing.op5_mixing(spark, DATA).collect()}
    total = {}
    for r in mix:
        total[r.doc_id] = total.get(r.doc_id, 0) + r["size"]
    assert all(total.get(d, 0) == t for d, t in taken.items())
    assert mixing.mixed(documents(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["one text", "own texts", "no id"])
def test_repeated_ids_meet_the_target(spark, tmp_path, kind):
    rows = [(None if kind == "no id" else 5, "ten words " * 5 + ("" if kind == "one text" else str(i % 150)), "en", "a") for i in range(300)]
    rows += [(1000 + i, "ten words " * 5 + str(i), "en", "b") for i in range(300)]
    folder = saved(spark, tmp_path / "d", rows)
    got = mixing.op5_mixing(spark, folder).collect()
    assert len(got) == 600 and all(r.taken <= 3 * r["size"] and r.taken % r["size"] == 0 for r in got)
    size = 10 if kind == "one text" else 11
    goal = water_fill({"a": 300 * size, "b": 300 * 11})
    taken = {"a": 0, "b": 0}
    for r in got:
        taken["b" if (r.doc_id or 0) >= 1000 else "a"] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 11 for s in taken)
    mix = mixing.mixed(spark.read.parquet(f"{folder}/documents.parquet")).groupBy("source").agg(F.sum("size").alias("n")).collect()
    assert {r.source: r.n for r in mix} == taken


def test_blocks_follow_the_source(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n_blocks = mixing.spread(docs, 4, 2)
    counts = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    given = {r.source: r.n for r in docs.select("source", n_blocks.alias("n")).distinct().collect()}
    assert given == {s: (1 << (-(-n // 4) - 1).bit_length() if n > 8 else 2) for s, n in counts.items()}
    own, blocks = mixing.plan(docs, n_blocks=n_blocks)
    got = mixing.placed(own, blocks, 17).groupBy("source").agg(F.sum(F.size("shards") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in got)


def test_shards_are_runs_of_partitions(spark):
    mix = mixing.in_shards(mixing.mixed(spark.read.parquet(f"{DATA}/documents.parquet"), shards=4), 6).select(F.spark_partition_id().alias("part"), "shard", "position").collect()
    order = [(r.shard, r.position) for r in sorted(mix, key=lambda r: r.part)]
    assert order == sorted(order) and len({r.part for r in mix}) > 3
