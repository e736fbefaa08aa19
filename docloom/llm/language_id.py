"""Language ID by rank-order profiles.

A document's most frequent character n-grams (orders 1 to 3 over lower-cased letters, words set off by a boundary) are ranked by count, and
compared to each language's profile by out-of-place distance: how far each n-gram's rank is from its rank in the profile, with a fixed
penalty for n-grams that the profile lacks. The nearest language is taken; score is second distance / (first + second), so 0.5 means a tie
and 1 an exact match. Profiles come from the counts of all learning documents, summed by (language, n-gram) before anything is kept.

Defined cases: null text and text without a letter give `und` and score 0; without learning documents all others give `und` and 0 as well; ties
go to the language that sorts first; a repeated row repeats its result; a very long text is counted whole; a null doc_id counts as the empty text
in the held-out rule; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import remainder, table

_BITS = 21  # of a code point
_BOUNDARY = 1
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else the boundary."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else _BOUNDARY for c in range(0x110000)], np.int64)
    return _LETTER


def grams(texts: list[str | None], owners: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of all texts, sorted; an owner is a text's place, or what owners says. An n-gram is up to three code points of 21
    bits, the last one lowest. For sorting, the letters that occur get numbers of few bits in the order of their code points."""
    lowered = [(t or "").lower() for t in texts]
    flat = _letters()[np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), "<u4")]
    own = np.repeat(np.arange(len(texts)) if owners is None else np.array(owners), [len(t) + 1 for t in lowered])
    own = np.r_[own[:1], own] if len(own) else np.zeros(len(flat), np.int64)
    keep = np.r_[True, (flat[1:] != _BOUNDARY) | (flat[:-1] != _BOUNDARY)]  # one boundary between words
    flat, own = flat[keep], own[keep]
    if len(flat) < 3:
        return (np.zeros(0, np.int64),) * 3
    used = np.zeros(0x110000, bool)
    used[flat] = True
    letters = np.flatnonzero(used)  # the boundary is the first
    small = np.zeros(0x110000, np.int64)
    small[letters] = np.arange(1, len(letters) + 1)
    c = small[flat]
    k = int(len(letters)).bit_length()
    if 3 * k + int(own.max()).bit_length() > 62:  # many scripts: a text at a time
        half = len(texts) // 2
        if not half:
            raise ValueError("an owner's number is too large")
        o = list(range(len(texts))) if owners is None else owners
        x, y = grams(texts[:half], o[:half]), grams(texts[half:], o[half:])
        joined = [np.concatenate(z) for z in zip(x, y, strict=True)]
        order = np.lexsort((joined[1], joined[0]))
        own, gram, n = (z[order] for z in joined)
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])]) if len(own) else np.zeros(0, np.int64)
        return own[first], gram[first], np.add.reduceat(n, first) if len(own) else n
    letter = c > 1
    left = letter[:-1]
    two_own = np.where(left, own[:-1], own[1:])
    mid = letter[1:-1]
    keys = np.concatenate(
        [own[letter] << 3 * k | c[letter], two_own << 3 * k | c[:-1] << k | c[1:], own[1:-1][mid] << 3 * k | c[:-2][mid] << 2 * k | c[1:-1][mid] << k | c[2:][mid]]
    )
    keys, n = _counted(keys)
    real = np.r_[0, letters]
    low = (1 << k) - 1
    gram = real[keys >> 2 * k & low] << 2 * _BITS | real[keys >> k & low] << _BITS | real[keys & low]
    return keys >> 3 * k, gram, n


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.r_[first, len(s)])


def _parts(texts: list, chars: int = 500_000):
    at = have = 0
    for i, t in enumerate(texts):
        have += len(t or "")
        if have >= chars:
            yield at, i + 1
            at, have = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def profiles(docs: DataFrame, size: int = 400, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, rank (from 0): the `size` most frequent n-grams of each language, ties to the smaller n-gram. docs: the learning documents."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        total: dict[str, dict] = {}

        def flush():
            for k, held in total.items():
                g = np.concatenate([x for x, _ in held["parts"]])
                n = np.concatenate([x for _, x in held["parts"]])
                u, inverse = np.unique(g, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(u), pa.string()), pa.array(u), pa.array(np.bincount(inverse, n).astype(np.int64))], names=schema.names)
            total.clear()

        for b in batches:
            texts, langs = b.column(text).to_pylist(), b.column(lang).to_pylist()
            for lo, hi in _parts(texts):
                names = sorted(set(langs[lo:hi]))
                code, gram, n = grams(texts[lo:hi], [names.index(x) for x in langs[lo:hi]])
                for k, name in enumerate(names):
                    own = code == k
                    if own.any():
                        held = total.setdefault(name, {"parts": [], "n": 0})
                        held["parts"].append((gram[own], n[own]))
                        held["n"] += int(own.sum())
                        if held["n"] > 2_000_000:
                            yield from flush()
        yield from flush()

    counts = docs.select(text, lang).mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


class Ranker:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), size, np.int32)  # the last column: in no profile
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.grams, gram)] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        for lo, hi in _parts(texts):
            doc, gram, n = grams(texts[lo:hi])
            if not len(doc):
                continue
            order = np.lexsort((-n, doc))  # stable: ties stay by n-gram
            doc, gram = doc[order], gram[order]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            place = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
            top = place < self.size
            doc, gram, place = doc[top], gram[top], place[top]
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            at = np.where(self.grams[at] == gram, at, len(self.grams))
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            away = np.stack([np.add.reduceat(np.where(r[at] == self.size, self.size, np.abs(r[at] - place)), starts) for r in self.ranks])
            best = away.argmin(axis=0)
            ordered = np.sort(away, axis=0)
            d1 = ordered[0].astype(float)
            d2 = ordered[1].astype(float) if len(self.langs) > 1 else np.diff(np.r_[starts, len(doc)]) * float(self.size)
            both = d1 + d2
            score = np.where(both > 0, d2 / np.maximum(both, 1), 0.5)
            for i, b, s in zip(doc[starts].tolist(), best.tolist(), score.tolist(), strict=True):
                names[lo + i], scores[lo + i] = self.langs[b], s
        return names, scores


def predict(docs: DataFrame, profile: DataFrame, size: int = 400, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score. The profiles have `size` rows a language."""
    ranker = Ranker([tuple(r) for r in profile.select("lang", "gram", "rank").collect()], size)
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            names, scores = shared.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(docs, profiles(learn))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
