import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import piece_codec, token_file
from tests.conftest import DATA
from tests.llm.fixtures import TEXTS, documents, saved

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "B", "the", "Ing", " ", "  ", "\n", "▁", "é", "É", "ß", "漢", "\t", "\r", ".", "'s", "'LL", "é", "\x00", "😀", "<s>", "<|endoftext|>", "\x1c", "3", "½", "İ", "Σ", "\xa0", "!!", "ﬁ", "​", "ª"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)] + [t or "" for _, t, *_ in TEXTS]


def test_agenda_is_the_library():
    c, sp, texts = piece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random_texts(4000)
    assert c.agenda.splits
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == sp.encode(texts, add_bos=True, add_eos=True)
    assert c.agenda.encode("▁whatsoever") == sp.encode("whatsoever")


def test_small_cache_gives_the_same():
    a, b, texts = piece_codec.PieceCodec(MODEL), piece_codec.PieceCodec(MODEL, cache=3), random_texts(300)
    assert a.encode(texts) == [y for i in range(0, len(texts), 7) for y in b.encode(texts[i : i + 7])]


def test_op7(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, piece_codec.op7_sentencepiece(spark, saved(spark, tmp_path / "d")).collect()), key=str)
    want = []
    for d, t, *_ in TEXTS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_columns(spark):
    out = piece_codec.encode_column(documents(spark), MODEL, same="same")
    assert {"ids", "same", "text", "size"} <= set(out.columns)
    assert piece_codec.decode_column(out, MODEL).where("doc_id = 1").first().decoded == TEXTS[0][1]
    assert piece_codec.encode_column(documents(spark, []), MODEL).count() == 0


def test_ids_are_the_agendas(monkeypatch):
    """Ids come from the agenda; one that is wrong can't pass for the library's."""
    monkeypatch.setattr(piece_codec.AgendaEncoder, "encode_many", lambda self, segments: {s: b"\1\0\0\0" for s in segments})
    with pytest.raises(piece_codec.AgendaError):
        piece_codec.PieceCodec(MODEL).encode(["some text"])
    c = piece_codec.PieceCodec(MODEL)
    monkeypatch.setattr(piece_codec.PieceCodec, "_check", lambda self, *_: None)
    assert np.frombuffer(c.encode(["some text"])[0], "<u4").tolist() == [c.sp.bos_id(), 1, 1, c.sp.eos_id()]


def test_whole_texts_by_the_agenda(monkeypatch):
    """As for a vocabulary whose pieces don't keep to segments."""
    c, sp, texts = piece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random_texts(500)
    c.agenda.splits = False
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == sp.encode(texts, add_bos=True, add_eos=True)


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 65_536])
def test_blocks(planes, n):
    ids = np.array([random.Random(n + i).randrange(1 << 32) for i in range(n)], "<u4")
    assert (token_file.unpack_block(token_file.pack_block(ids, planes)) == ids).all()


CAPITALS = "".join(c for c in map(chr, range(0x250)) if c.lower() != c)


def test_words_are_the_library():
    r = random.Random(5)
    e = token_file.WordEncoder(WORDS)
    texts = [*random_texts(3000), CAPITALS, "x".join(CAPITALS), "ƏLİ GƏLDİ", "Ɛwe ƉƆ", *(f"a{c}b {c}{c} 1{c}" for c in map(chr, range(0x20, 0x2100)))]
    texts += ["".join(r.choice(token_file._LATIN + " ") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    assert e.fast
    kind = "<u2" if e.width == 2 else "<u4"
    assert [np.frombuffer(x, kind).tolist() for x in e.encode(texts)] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    small = token_file.WordEncoder(WORDS, cache=3)
    assert [y for i in range(0, 500, 7) for y in small.encode(texts[i : i + 7])] == e.encode(texts[:504])


def test_op6_capitals_and_repeated_ids(spark, tmp_path):
    """Capitals whose small letters lie elsewhere; a third of all rows under one id, and as many under none."""
    lib = Tokenizer.from_file(WORDS)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"ƏLİ GƏLDİ Ɛwe ƉƆ number {i % 40}", "en", "a") for i in range(300)]
    got = sorted(token_file.op6_token_file(spark, saved(spark, tmp_path / "d", rows)).collect(), key=lambda r: r.start)
    ids = {t: [*lib.encode(t, add_special_tokens=False).ids, 1] for _, t, *_ in rows}
    digest = lambda t: (len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), *digest(t)) for d, t, *_ in rows)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


def test_ranges_part_a_repeated_id():
    from docloom.llm.common import Ranges

    r = Ranges([3, 7, 7, 7, 9])
    ties = np.array([0, 1 << 62, 1 << 63, (1 << 64) - 1], np.uint64)
    assert r.of(np.full(4, 7), ties).tolist() == [2, 2, 3, 4]
    assert r.of(np.array([1, 3, 4, 8, 9, 10]), np.zeros(6, np.uint64)).tolist() == [0, 0, 1, 5, 5, 6]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_op6(spark, tmp_path, planes):
    lib = Tokenizer.from_file(WORDS)
    got = token_file.op6_token_file(spark, saved(spark, tmp_path / "d"), planes=planes).collect()
    rows = sorted(((d, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for d, ids in rows:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op6_empty(spark, tmp_path):
    assert token_file.op6_token_file(spark, saved(spark, tmp_path / "d", [])).count() == 0


def test_op6_whole_table(spark):
    rows = sorted(token_file.op6_token_file(spark, DATA).collect())
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
