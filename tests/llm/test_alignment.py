import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import token_alignment as ta
from tests.conftest import DATA
from tests.llm.fixtures import TEXTS, documents, saved
from tests.llm.test_tokens import random_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters():
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def plain(texts):
    """Rows of the contract, token by token."""
    a_side, b_side, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a_side.encode_special_tokens = True
    docs = []
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = []
        for side in (a_bytes, b_bytes):
            at, out = 0, []
            for x in side:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < hi:
                links.append((a[i], b[k]))
                k += 1
        ends = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        cut = []
        for ids, side in zip((a, b), spans, strict=True):
            cut.append([[]])
            for i, (_, e) in zip(ids, side, strict=True):
                cut[-1][-1].append(i)
                if e in ends:
                    cut[-1].append([])
        docs.append((a, b, list(zip(cut[0][:-1], cut[1][:-1], strict=True)), links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for a, b, groups, links in docs:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(spelled.encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return rows, docs


def held_against(got, keys, texts):
    want, _ = plain(texts)
    got = sorted(map(tuple, got), key=str)
    want = sorted([(k, *w) for k, w in zip(keys, want, strict=True)], key=str)
    assert got == want


def test_op13(spark, tmp_path):
    got = ta.op13_token_alignment(spark, saved(spark, tmp_path / "d")).collect()
    held_against(got, [r[0] for r in TEXTS], [r[1] for r in TEXTS])
    assert len(got) == len(TEXTS) and ta.op13_token_alignment(spark, saved(spark, tmp_path / "e", [])).count() == 0


def test_random_texts(spark, tmp_path):
    texts = random_texts(1500, seed=11)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    held_against(ta.op13_token_alignment(spark, saved(spark, tmp_path / "d", rows)).collect(), range(len(texts)), texts)


def test_all_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    held_against(ta.op13_token_alignment(spark, DATA).collect(), [r.doc_id for r in rows], [r.text for r in rows])


@pytest.mark.parametrize("words, run, block", [(3, 40, 200), (1, 1, 1), (50, 100, 10**6)])
def test_cuts_dont_matter(spark, monkeypatch, words, run, block):
    """Documents that go on over runs, in blocks of any size."""
    texts = [t for _, t, *_ in TEXTS if len(t or "") < 1000] + random_texts(12, seed=2)[:12] + ["a word " * 8 + "end"] * 3
    monkeypatch.setattr(ta, "WORDS", words)
    monkeypatch.setattr(ta, "RUN", run)
    monkeypatch.setattr(ta, "BLOCK", block)
    batches = [documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).select("doc_id", "text").toArrow()]
    pair, counts, tallies, rows = ta.Pair(A, B), {}, {}, []
    class Frame:
        """Runs the functions of the operator on one batch, in this process."""

        schema = documents(spark, []).schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return list(run(batches[0].to_batches()))

    monkeypatch.setattr(ta, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("D", (), {"partitionId": lambda self: 0})())}))
    events = ta.end_events(Frame(), A, B, "doc_id", "text")
    for block_id, s, keys in ta._runs(ta._rows(events), pair):
        tallies.setdefault(block_id, ta._Tally()).add(s)
        rows += keys
    for t in tallies.values():
        for k, n in zip(*t.done(), strict=True):
            counts[int(k)] = counts.get(int(k), 0) + int(n)
    _, docs = plain(texts)
    want = Counter(p for *_, links in docs for p in set(links))
    assert counts == {x * pair.wide + y: n for (x, y), n in want.items()}
    assert rows == list(range(len(texts)))
    assert block > 1 or len(tallies) > 5


def test_groups(spark):
    texts = [t for _, t, *_ in TEXTS if len(t or "") < 1000]
    out = ta.groups(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), A, B).collect()
    _, docs = plain(texts)
    for i, (_, _, groups, _) in enumerate(docs):
        mine = sorted((r.group, r.a, r.b) for r in out if r.doc_id == i)
        assert [(a, b) for _, a, b in mine] == [(x, y) for x, y in groups] and [g for g, _, _ in mine] == list(range(len(groups)))


def test_quick_library_is_the_same():
    pair = ta.Pair(A, B)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    words = [w for t in random_texts(3000, seed=4) for w in pair.words(t)]
    words += [chr(c) * n + x for c in range(32, 256) for n in (1, 2) for x in ("", "a", " ", "'s")]
    assert pair.a.quick is not None and pair.a.cuts and pair.b.cuts
    assert [pair.a.encode(w) for w in words] == [library.encode(" " + w, add_special_tokens=False).ids for w in words]


def test_words_learned_together_are_words_alone():
    together, alone = ta.Pair(A, B), ta.Pair(A, B, cache=1)
    words = sorted({w for t in random_texts(2000, seed=9) for w in together.words(t)})
    assert together.ids(words) == [alone.ids([w])[0] for w in words]
    assert any(h[2] == 0 for h in together.ids(words)) and sum(h[2] > 0 for h in together.ids(words)) > 1000
