import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from docloom.llm.simhash_index import _join
from tests.llm.fixtures import saved

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def rows():
    out = []
    for i in range(120):
        own = " ".join(f"w{i}x{j}" for j in range(40))
        text = f"Doc {i} begins with {own}."
        if i % 4 == 0:
            text += f"\n{PASSAGE}\nend of {i}"
        if i % 3 == 0:
            text += "\nwhat a badword this is"
        out.append((i, text, "en", f"s{i % 3}"))
    out += [(200 + k, out[1][1], "en", "s1") for k in range(3)]
    return out


def test_stages(spark, tmp_path):
    data = rows()
    labels = spark.createDataFrame([(d, 1, int("badword" in t)) for d, t, *_ in data], "doc_id long, quality int, toxic int")
    folder = saved(spark, tmp_path / "d", data, labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append([r.asDict() for r in docs.collect()])
        if name != "SentencePiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {d for d, t, *_ in data if "badword" not in t}
    assert {r["doc_id"] for r in seen[0]} == clean
    with_passage = sorted(r["doc_id"] for r in seen[1] if PASSAGE in (r["text"] or ""))
    assert with_passage == [min(d for d in clean if d % 4 == 0 and d < 200)]
    assert {r["doc_id"] for r in seen[1]} == clean and all(r["n_chars"] == len(r["text"]) for r in seen[1])
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = sorted((r["doc_id"], shingles(r["text"])) for r in seen[1])
    near = [(i, j) for i, (_, a) in enumerate(sets) for j, (_, b) in enumerate(sets) if i < j and (len(a & b) / len(a | b) if a | b else 1) >= 0.8]
    root = _join(np.arange(len(sets)), np.array([i for i, _ in near]), np.array([j for _, j in near]))
    assert sorted(r["doc_id"] for r in seen[2]) == sorted({sets[i][0] for i in root.tolist()})
    assert {r["doc_id"] for r in seen[3]} <= {r["doc_id"] for r in seen[2]}
    assert max(sum(r["doc_id"] == d for r in seen[3]) for d in {r["doc_id"] for r in seen[3]}) <= 3
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in seen[3]}
    assert len(seen[4]) == len(seen[3])
    assert all(r["ids"] == sp.encode(text[r["doc_id"]], add_bos=True, add_eos=True) and r["round_trip"] for r in seen[4])


def test_run(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "e", [], labels=labels)).count() == 0
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "d", labels=labels)).count() > 0
