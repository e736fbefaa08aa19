import random
import re

import pytest

from docloom.llm import licence_scan, licences
from docloom.llm.licence_scan import Scanner, SuffixAutomaton
from tests.conftest import DATA
from tests.llm.fixtures import TEXTS, documents, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(words):
    out = []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out, key=lambda x: (x[1], x[0]))


def plain_row(doc_id, text):
    words = plain_words(text)
    places = plain_places(words)
    starts = [i for _, i in places]
    return doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p for p, _ in places}))


@pytest.mark.parametrize("seed", range(30))
def test_automaton_gives_matching_statistics(seed):
    r = random.Random(seed)
    seqs = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
    a, text = SuffixAutomaton(seqs), [r.randrange(4) for _ in range(60)]
    state = matched = 0
    for i, w in enumerate(text):
        state, matched = a.step(state, matched, w)
        runs = [text[i + 1 - n : i + 1] for n in range(1, i + 2)]
        held = [x for x in runs if any(s[k : k + len(x)] == x for s in seqs for k in range(len(s)))]
        assert matched == max(map(len, held), default=0)
        if matched:
            x = text[i + 1 - matched : i + 1]
            assert set(a.ends[state]) == {(n, k + len(x) - 1) for n, s in enumerate(seqs) for k in range(len(s) - len(x) + 1) if s[k : k + len(x)] == x}


def test_base_places_overlap_and_cross_blocks(monkeypatch):
    monkeypatch.setattr(licence_scan, "BLOCK", 7)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC-BY", "é", "İ", " . ", "\x00", "x" * 20]
    r = random.Random(5)
    scanner = Scanner(licences.TEMPLATES, {**licences.BASE, "by": "by", "public license": "own"})
    monkeypatch.setattr(licences, "BASE", {**licences.BASE, "by": "by", "public license": "own"})
    for _ in range(400):
        t = " ".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        n, places, _ = scanner.scan(t.encode())
        assert (n, places) == (len(plain_words(t)), plain_places(plain_words(t)))


def labels(text):
    return [s[0] for s in Scanner(licences.TEMPLATES, licences.BASE).scan(text.encode())[2]]


def test_spans():
    long_mit = next(t for label, t in licences.TEMPLATES if label == "mit" and len(t) > 200)
    assert labels("Some text. Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("x Released under the MIT License. y") == ["mit"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("Licensed under CC BY") == []
    assert labels(long_mit) == ["mit"]
    words = long_mit.split()
    assert labels(" ".join(w for i, w in enumerate(words) if i % 17)) == ["mit"]  # words left out
    assert labels(" ".join(w + (" other" if i % 19 == 5 else "") for i, w in enumerate(words))) == ["mit"]  # words put in
    assert labels(" ".join(words[: len(words) // 2])) == []
    gpl2, gpl3 = (next(t for label, t in licences.TEMPLATES if label == x and len(t) > 100) for x in ("gpl-2.0", "gpl-3.0"))
    assert labels(gpl2) == ["gpl-2.0"] and labels(gpl3) == ["gpl-3.0"]
    spans = Scanner(licences.TEMPLATES, licences.BASE).scan(f"a b {gpl3} c {gpl3}".encode())[2]
    n = len(plain_words(gpl3))
    assert [(s[1], s[2], s[3], s[4]) for s in spans] == [(2, n + 1, n, 1.0), (n + 3, 2 * n + 2, n, 1.0)]


@pytest.mark.parametrize("seed", range(40))
def test_chains_are_the_best_ones(seed):
    """Words of the best chain against all chains of single template words that stand in runs of two or more."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(24)]
    text = [w for i, w in enumerate(template) for w in ([w] if r.random() < 0.93 else [] if r.random() < 0.5 else [w, "x"])]
    scanner = Scanner([("own", " ".join(template))], {}, least=0.5, gap=2, shortest=2)
    spans = scanner.scan(" ".join(["z", *text]).encode())[2]
    best = {}
    at = {w: i for i, w in enumerate(template)}
    joined = [k > 0 and at.get(text[k]) == at.get(text[k - 1], -9) + 1 for k in range(len(text))] + [False]
    runs = {k for k in range(len(text)) if joined[k] or joined[k + 1]}
    for i, w in enumerate(text):
        if i in runs:
            earlier = [best[j] for j in range(max(0, i - 3), i) if j in runs and 0 < at[w] - at[text[j]] <= 3]
            best[i] = 1 + max(earlier, default=0)
    most = max(best.values(), default=0)
    assert (max((s[3] for s in spans), default=0) == most) if most >= 12 else not spans


def test_op11(spark, tmp_path):
    own = [(20, "CC by cc BY. All rights; reserved! General public LICENSE", "en", "a"), (20, "CC by cc BY. All rights; reserved! General public LICENSE", "en", "a"), (21, "Licensed under the Apache License, Version 2.0.", "en", "a")]
    rows = TEXTS + own
    got = licence_scan.op11_licence_scan(spark, saved(spark, tmp_path / "d", rows)).collect()
    want = [plain_row(r[0], r[1]) for r in rows]
    assert sorted((tuple(g)[:6] for g in got), key=str) == sorted(want, key=str)
    apache = next(g for g in got if g.doc_id == 21)
    assert (apache.labels, apache.score, apache.base_labels) == ("apache-2.0", 1.0, "")
    assert all(g.labels.split(",") == sorted(set(g.labels.split(","))) and set(g.base_labels.split(",")) <= {*g.labels.split(","), ""} for g in got)
    assert next(g for g in got if g.doc_id == 3).score == 0.0
    assert licence_scan.op11_licence_scan(spark, saved(spark, tmp_path / "e", [])).count() == 0


def test_all_documents(spark):
    got = licence_scan.op11_licence_scan(spark, DATA).collect()
    want = [plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted((tuple(g)[:6] for g in got), key=str) == sorted(want, key=str)


def test_columns_stay(spark):
    out = licence_scan.scanned(documents(spark).withColumnRenamed("size", "spans"))
    assert {"doc_id", "lang", "fp", "n_words", "places", "spans"} <= set(out.columns) and out.columns.count("spans") == 1
    assert out.count() == len(TEXTS)
