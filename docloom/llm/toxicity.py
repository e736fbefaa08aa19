"""Toxicity: a convolutional text classifier.

Words (runs of letters, lower-cased) are hashed to embeddings; filters of several widths slide over the whole text, each keeps its largest
response (max pooling), and a logistic layer gives the probability. All of it is trained here in numpy, on a bounded sample of labelled rows
(`Settings.sample`, by the hash of doc_id). The embeddings' first dimension starts from how surely a word tells the classes apart; words of
fewer than two documents of the sample share the zero embedding. A quarter of the sample is kept from training and sets a threshold for each
language, which is told from the text alone by function words; the score is shifted in log-odds so that 0.5 is that threshold.

Defined cases: null text counts as empty; texts without words get the score of an empty text; a very long text is scored whole; rows with equal
text get equal scores; without labelled rows every score is 0; documents that repeat a doc_id, or have none, are each scored; a label counts
as 1 if any of its rows says so, and labels without doc_id or value count for nothing; an empty table gives an empty result; extra columns
are kept.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import remainder, table

_WORDS = re.compile(r"[^\W\d_]+").findall
#: Function words that tell languages apart.
MARKERS = {
    "en": "the and of to in is was for that with",
    "de": "der die und das den von ist nicht mit ein",
    "fr": "le les des et une du est pour dans qui",
    "es": "el los las y para por con del como más",
}


@dataclass(frozen=True)
class Settings:
    sample: int = 16_384
    buckets: int = 1 << 20
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 3
    rate: float = 0.05
    least_positives: int = 20


class _Hashes(dict):
    """Bucket of a word; forgets everything when it is full."""

    def __init__(self, buckets: int, limit: int = 400_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = zlib.crc32(word.encode()) % self.buckets
        return h


def language_of(words: list[str]) -> str:
    """The language most of whose function words occur, or '' if none does."""
    best, most = "", 0
    for name, markers in _MARKER_SETS.items():
        n = sum(1 for w in words if w in markers)
        if n > most:
            best, most = name, n
    return best


_MARKER_SETS = {k: frozenset(v.split()) for k, v in MARKERS.items()}


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


@dataclass
class Model:
    settings: Settings
    slot: np.ndarray  # of a bucket: row of emb
    emb: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, dims, filters)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)  # language -> log-odds; '' for all others

    def responses(self, slots: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter on each document."""
        lengths = np.array([len(s) + 3 for s in slots])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        flat = np.zeros(int(lengths.sum()) + 2, np.int64)  # a zero word before each text, two after it
        for s, at in zip(slots, starts.tolist(), strict=True):
            flat[at + 1 : at + 1 + len(s)] = s
        x = self.emb[flat]
        ends = starts + lengths
        pads = np.r_[ends - 1, ends - 2]
        pooled = []
        n = len(flat) - 2
        for w, f in self.filters.items():
            r = x[:n] @ f[0]
            for j in range(1, w):
                r += x[j : n + j] @ f[j]
            r[pads] = -np.inf
            pooled.append(np.maximum.reduceat(r, starts, axis=0))
        return np.concatenate(pooled, axis=1)

    def logits(self, slots: list[np.ndarray]) -> np.ndarray:
        if not slots:
            return np.zeros(0)
        return np.maximum(self.responses(slots) + self.bias, 0).astype(np.float64) @ self.out + self.shift

    def scores(self, texts: list[str | None], hashes: _Hashes) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            slots, offs, have, to = [], [], 0, at
            while to < len(texts) and have < 200_000:
                words = words_of(texts[to])
                have += len(words)
                slots.append(self.slot[np.fromiter((hashes[w] for w in words), np.int64, len(words))])
                offs.append(self.thresholds.get(language_of(words), self.thresholds.get("", 0.0)))
                to += 1
            z = self.logits(slots) - np.array(offs)
            out[at:to] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            at = to
        return out


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, label: str, key_ok) -> tuple[list[np.ndarray], np.ndarray, list[str], np.ndarray]:
    """Bucket ids, label, language and fold of at most `sample` labelled documents. Only bucket ids come to the driver."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & key_ok).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    marked = marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(settings.sample)
    schema = "h long, y int, language string, ids binary"

    def run(batches):
        hashes = _Hashes(settings.buckets)
        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            ids = [np.fromiter((hashes[w] for w in x), "<i4", len(x)).tobytes() for x in words]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array([language_of(x) for x in words], pa.string()), pa.array(ids, pa.binary())], names=["h", "y", "language", "ids"])

    # the sample has at most `sample` rows, whatever the input's size
    held = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("h", "y", "text").mapInArrow(run, schema).orderBy("h", "ids").limit(settings.sample).toArrow()
    y, fold = held.column("y").to_numpy().astype(np.float64), held.column("h").to_numpy() % 4
    lengths = [len(x) // 4 for x in held.column("ids").combine_chunks().to_numpy(zero_copy_only=False)] if len(y) else []
    flat = np.frombuffer(b"".join(x.as_py() for x in held.column("ids")), "<i4")  # one piece of memory
    return _views(flat, lengths), y, held.column("language").to_pylist(), fold


def _views(flat: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    cuts = [0, *np.cumsum(lengths, dtype=np.int64).tolist()]
    return [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _start(ids: list[np.ndarray], y: np.ndarray, s: Settings) -> Model:
    """Embeddings from document frequencies: first dimension log-odds over their standard error, the others small and random."""
    rng = np.random.RandomState(10)
    hot = np.zeros(s.buckets, np.int32)
    cold = np.zeros(s.buckets, np.int32)
    for x, t in zip(ids, y, strict=True):
        (hot if t else cold)[np.unique(x)] += 1
    kept = np.flatnonzero(hot + cold >= 2)
    slot = np.zeros(s.buckets, np.int32)
    slot[kept] = np.arange(1, len(kept) + 1)
    a, b = hot[kept] + 0.5, cold[kept] + 0.5
    n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
    sure = (np.log(a / n1) - np.log(b / n0)) / np.sqrt(1 / a + 1 / b)
    emb = (rng.randn(len(kept) + 1, s.dims) * 0.05).astype(np.float32)
    emb[0] = 0
    emb[1:, 0] = np.clip(sure / 3, -1, 2.5)
    filters, out = {}, []
    for w in s.widths:
        f = (rng.randn(w, s.dims, s.filters) * 0.1).astype(np.float32)
        f[0, 0, 0] = f[0, 0, 1] = 1
        filters[w] = f
        out.append(np.r_[0.5, 0.5, rng.randn(s.filters - 2) * 0.1])
    return Model(s, slot, emb, filters, np.full(len(s.widths) * s.filters, -0.1, np.float32), np.concatenate(out), -2.0)


def fit(ids: list[np.ndarray], y: np.ndarray, languages: list[str], fold: np.ndarray, s: Settings) -> Model | None:
    learn = np.flatnonzero(fold != 0)
    if not len(learn) or not 0 < y[learn].sum() < len(learn):
        return None
    m = _start([ids[i] for i in learn], y[learn], s)
    slots = _views(m.slot[np.concatenate(ids)], [len(x) for x in ids])
    rng = np.random.RandomState(11)
    grown = {k: np.full(v.shape, 1e-6, np.float32) for k, v in (("emb", m.emb), ("bias", m.bias), ("out", m.out), *((w, f) for w, f in m.filters.items()))}
    shift_grown = 1e-6
    nf = s.filters
    for _ in range(s.epochs):
        for at in range(0, len(learn), 32):
            pick = learn[rng.permutation(len(learn))[:32]] if at else learn[:32]
            # positions of the largest responses
            xs, where, vals = [], [], []
            for i in pick:
                z = np.r_[0, slots[i], 0, 0]
                x = m.emb[z]
                n = len(z) - 2
                p, v = [], []
                for w, f in m.filters.items():
                    r = x[:n] @ f[0]
                    for j in range(1, w):
                        r += x[j : n + j] @ f[j]
                    k = r.argmax(axis=0)
                    p.append(k)
                    v.append(r[k, np.arange(nf)])
                xs.append(z)
                where.append(np.concatenate(p))
                vals.append(np.concatenate(v))
            act = np.stack(vals) + m.bias
            feat = np.maximum(act, 0)
            logit = feat @ m.out + m.shift
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / len(pick)
            g_out = feat.T @ err + 1e-4 * m.out
            g_act = (err[:, None] * m.out) * (act > 0)
            g_bias = g_act.sum(axis=0)
            rows, grads = [], []
            for fi, (w, f) in enumerate(m.filters.items()):
                g = g_act[:, fi * nf : (fi + 1) * nf].astype(np.float32)  # (docs, filters)
                g_f = np.zeros_like(f)
                for j in range(w):
                    r = np.stack([z[p[fi * nf : (fi + 1) * nf] + j] for z, p in zip(xs, where, strict=True)])  # (docs, filters)
                    e = m.emb[r]  # (docs, filters, dims)
                    g_f[j] = np.einsum("bf,bfd->df", g, e)
                    rows.append(r.ravel())
                    grads.append((g[:, :, None] * f[j].T[None]).reshape(-1, s.dims))
                grown[w] += g_f**2
                f -= s.rate * g_f / np.sqrt(grown[w])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            real = rows > 0
            u, inverse = np.unique(rows[real], return_inverse=True)
            g_e = np.zeros((len(u), s.dims), np.float32)
            np.add.at(g_e, inverse, grads[real])
            grown["emb"][u] += g_e**2
            m.emb[u] -= 0.4 * s.rate * g_e / np.sqrt(grown["emb"][u])
            grown["out"] += g_out.astype(np.float32) ** 2
            m.out -= s.rate * g_out / np.sqrt(grown["out"])
            grown["bias"] += g_bias.astype(np.float32) ** 2
            m.bias -= (s.rate * g_bias / np.sqrt(grown["bias"])).astype(np.float32)
            shift_grown += err.sum() ** 2
            m.shift -= s.rate * err.sum() / np.sqrt(shift_grown)
    held = np.flatnonzero(fold == 0)
    if not len(held) or not 0 < y[held].sum() < len(held):
        held = learn
    z = np.concatenate([m.logits([slots[i] for i in held[k : k + 200]]) for k in range(0, len(held), 200)])
    m.thresholds[""] = overall = _cut(z, y[held])
    lang = np.array([languages[i] for i in held])
    for name in MARKERS:
        own = lang == name
        if (y[held][own & (z > overall)]).sum() >= s.least_positives:
            m.thresholds[name] = _cut(z[own], y[held][own])
    return m


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds that parts the classes with the fewest errors, in the middle of its gap; the highest of equals."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[(1 - y).sum(), (1 - y).sum() - np.cumsum(1 - y)]  # cut before position i
    i = len(wrong) - 1 - int(wrong[::-1].argmin())
    if i == 0:
        return float(z[0] - 1)
    if i == len(z):
        return float(z[-1] + 1)
    return float((z[i - 1] + z[i]) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key_ok=None, settings: Settings | None = None) -> Model | None:
    settings = settings or Settings()
    return fit(*_sample(docs, labels, settings, label, F.lit(True) if key_ok is None else key_ok), settings)


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score", keep_below: float | None = None, drop_text: bool = False) -> DataFrame:
    """docs' columns and the score. With keep_below only rows with a smaller score are kept, and the score column isn't added."""
    kept = [f.name for f in docs.schema.fields if (f.name != into or keep_below is not None) and not (drop_text and f.name == text)]
    schema = T.StructType([docs.schema[k] for k in kept])
    if keep_below is None:
        schema = schema.add(into, T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        hashes = _Hashes(m.settings.buckets if m else 1)
        for b in batches:
            texts = b.column(text).to_pylist()
            z = m.scores(texts, hashes) if m else np.zeros(len(texts))
            if keep_below is not None:
                yield b.select(kept).filter(pa.array(z < keep_below))
            else:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(z)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, "toxic", remainder("doc_id", 5) != 0)
    scored = score(docs.select("doc_id", "text"), model, drop_text=True)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
