"""Language-model scoring with a weighted backoff automaton.

Learning counts words and word pairs of all learning documents. The model is smoothed by a Dirichlet prior: the pair (h, w) has the
probability (c(h, w) + K P(w)) / (c(h) + K), K = GROWTH * c(h) ** POWER, and P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); an unknown word has c = 0. Every
text ends with an end token, which is also the context it begins in.

As an automaton: each known context is a state; a seen pair is an arc to the state of its second word, weighted with the log-probability; a
state's failure arc leads to the root with weight log K / (c(h) + K), and the root has an arc for every word. Texts are traversed once from left
to right, each carrying its state and its sum; a failure arc is followed where the state has no arc for the word.

Spread over the cluster: documents are cut once into blocks of about BLOCK tokens, which are written as a table (word numbers, the words' 64-bit
XXH64 keys, lengths). A block sends its distinct words and pairs, with their learning counts, to parts by hash, as packed columns, so that only
sums by block are shuffled, and nothing to a part that none of its keys falls into; a part adds up the counts and sends each block the totals
of the keys that the block asked for. The number of parts follows the corpus (PART characters of text each), so a part's size doesn't. The
totals are the part of the automaton which the block's texts can reach; it is built and traversed there. What is gathered grows with the
corpus, and no count is dropped.

Defined cases: null text counts as empty and has the end token alone; documents without words likewise; a very long text is a block of its own;
rows that repeat are scored (and learned) each; without learning documents N and V are 0 and every token has base probability 1; a null doc_id
counts as the empty text in the held-out rule; equal texts have equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import parts, remainder, table, written

BLOCK, PART = 200_000, 16_000_000
GROWTH, POWER = 3.0, 0.9
END = 0  # the end token's key; words have XXH64 keys that are never 0


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) or 1


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of keys."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x7F4A7C15F39CC060)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _packed(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _keys_sent(keys: np.ndarray, part: int, n: int) -> bytes:
    """Rising keys of a part: the steps between their quotients by n, whose upper bytes are zero."""
    return _packed(np.diff((keys - np.uint64(part)) // np.uint64(n), prepend=np.uint64(0)))


def _keys_got(x: bytes, part: int, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(x, "<u8"), dtype=np.uint64) * np.uint64(n) + np.uint64(part)


class Block:
    """Documents as local word numbers; the end token is number 0. flat has all their tokens, ends where each document stops."""

    def __init__(self, flat: np.ndarray, keys: np.ndarray, held: np.ndarray, ends: np.ndarray):
        self.flat, self.keys, self.held, self.ends = flat.astype(np.int64), keys, held, ends
        before = np.r_[0, self.flat[:-1]]  # the end token of the text before, or 0 again: the context of a text's first word
        self.codes = before * len(keys) + self.flat
        self.pairs = np.unique(self.codes)

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(_unpacked(row["flat"], "<i4"), np.frombuffer(row["keys"], np.uint64), np.array(row["held"], bool), np.array(row["ends"], np.int64))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """In learning documents, of the words by number and of the pairs."""
        learn = np.repeat(~self.held, np.diff(np.r_[0, self.ends]))
        pair_counts = np.bincount(np.searchsorted(self.pairs, self.codes[learn]), minlength=len(self.pairs))
        return np.bincount(self.flat[learn], minlength=len(self.keys)), pair_counts


_TEXTS = "block long, flat binary, keys binary, ids array<long>, held array<boolean>, ends array<long>"


def blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) as a written table of blocks."""
    schema = pa.schema([("block", pa.int64()), ("flat", pa.binary()), ("keys", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        numbers, flat, ids, held, ends, size = {b"": 0}, [], [], [], [], 0

        def close():
            keys = np.fromiter((word_key(w) if w else END for w in numbers), np.uint64, len(numbers))
            row = {"block": number, "flat": _packed(np.concatenate(flat)), "keys": keys.tobytes(), "ids": ids, "held": held, "ends": ends}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for i, t, h in zip(*(batch.column(k) for k in ("doc_id", "text", "held_out")), strict=True):
                words = (t.as_py() or "").encode().lower().split()
                for w in set(words).difference(numbers):
                    numbers[w] = len(numbers)
                words.append(b"")
                flat.append(np.fromiter(map(numbers.__getitem__, words), "<i4", len(words)))
                size += len(words)
                ids.append(i.as_py())
                held.append(h.as_py())
                ends.append(size)
                if size >= BLOCK:
                    yield close()
                    number += 1
                    numbers, flat, ids, held, ends, size = {b"": 0}, [], [], [], [], 0
        if ids:
            yield close()

    source = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return written(source.mapInArrow(run, _TEXTS), "blocks")


def _asked(b: Block, n: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """For each part that the block has keys of: (part, word numbers, pair places), in the order of their keys; and the pairs' keys."""
    pair = pair_keys(b.keys[b.pairs // len(b.keys)], b.keys[b.pairs % len(b.keys)])
    out, wp, pp = [], (b.keys % np.uint64(n)).astype(np.int64), (pair % np.uint64(n)).astype(np.int64)
    wo, po = np.lexsort((b.keys, wp)), np.lexsort((pair, pp))
    wc, pc = np.searchsorted(wp[wo], np.arange(n + 1)), np.searchsorted(pp[po], np.arange(n + 1))
    for p in np.flatnonzero((np.diff(wc) > 0) | (np.diff(pc) > 0)).tolist():
        out.append((p, wo[wc[p] : wc[p + 1]], po[pc[p] : pc[p + 1]]))
    return out, pair


def _small(x: np.ndarray) -> bytes:
    """Counts: a byte each, 255 and an 8-byte count behind all for the large ones."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def _large(x: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(x, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(x, "<i8", offset=n)
    return out


_SENT = "part int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"
_BACK = "block long, part int, words binary, pairs binary, tokens long, kinds long"


def _rows(batches):
    """Rows of batches as dicts, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def totals(texts: DataFrame, n: int) -> DataFrame:
    """What each part sends to each block, as a table: counts in the order of the block's keys in the part, and the part's own sums."""

    def send(batches):
        for row in _rows(batches):
            b = Block.of(row)
            word_counts, pair_counts = b.counts()
            asked, pair = _asked(b, n)
            rows = [(p, row["block"], _keys_sent(b.keys[w], p, n), _small(word_counts[w]), _keys_sent(pair[q], p, n), _small(pair_counts[q])) for p, w, q in asked]
            for lo in range(0, len(rows), 64):
                cols = list(zip(*rows[lo : lo + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["part", "block", "words", "word_counts", "pairs", "pair_counts"])

    def add(key, group):
        part = key[0].as_py()

        def summed(keys, counts):
            keys = [_keys_got(x, part, n) for x in keys]
            counts = [_large(c, len(k)) for k, c in zip(keys, counts, strict=True)]
            distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64)
            back, at = [], 0
            for k in keys:
                back.append(_small(total[where[at : at + len(k)]]))
                at += len(k)
            return back, total

        words, sums = summed(group.column("words").to_pylist(), group.column("word_counts").to_pylist())
        pairs, _ = summed(group.column("pairs").to_pylist(), group.column("pair_counts").to_pylist())
        first = [1] + [0] * (len(words) - 1)
        return pa.table(
            {"block": group.column("block"), "part": pa.array([part] * len(words), pa.int32()), "words": pa.array(words, pa.binary()), "pairs": pa.array(pairs, pa.binary()), "tokens": pa.array([int(sums.sum()) * f for f in first], pa.int64()), "kinds": pa.array([int((sums > 0).sum()) * f for f in first], pa.int64())}
        )

    sent = texts.select("block", "flat", "keys", "held", "ends").mapInArrow(send, _SENT)
    return written(sent.groupBy("part").applyInArrow(add, _BACK), "counts")


class Automaton:
    """States are contexts: state 0 is the root, state 1 + w the word w. Arcs by (state, word)."""

    def __init__(self, words: int, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, tokens: int, kinds: int):
        self.words = words
        whole = tokens + 0.5 * (kinds + 1)
        self.unigram = np.log10((counts + 0.5) / whole)
        prior = GROWTH * np.maximum(counts, 1) ** POWER
        self.failure = np.where(counts > 0, np.log10(prior / (counts + prior)), 0.0)  # of state 1 + w, to the root
        self.known = counts > 0
        seen = pair_counts > 0
        self.arcs = pairs[seen]  # sorted: first * words + second
        h, w = self.arcs // words, self.arcs % words
        self.weight = np.log10((pair_counts[seen] + prior[h] * 10 ** self.unigram[w]) / (counts[h] + prior[h]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-probabilities) of texts in these states that read these words."""
        gained = np.zeros(len(state))
        inner = state > 0
        at = np.zeros(len(state), np.int64)
        found = np.zeros(len(state), bool)
        if len(self.arcs):
            key = (state - 1) * self.words + word
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = inner & (self.arcs[at] == key)
        gained[found] = self.weight[at[found]]
        fails = inner & ~found
        gained[fails] = self.failure[state[fails] - 1]
        root = ~found
        gained[root] += self.unigram[word[root]]
        return np.where(self.known[word], word + 1, 0), gained

    def traverse(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each text. All texts of the block step together, the longest ones last; texts are found by `ends`."""
        starts = np.r_[0, ends[:-1]]
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        total = np.zeros(len(order))
        state = np.full(len(order), 1 if self.known[0] else 0, np.int64)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for t, n in enumerate(active.tolist()):
            state[:n], gained = self.step(state[:n], flat[starts[:n] + t])
            total[:n] += gained
        out = np.zeros(len(order))
        out[order] = total
        return out


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scores(docs: DataFrame) -> DataFrame:
    """docs: doc_id long, text, held_out (learn from the others). One row per document, as _RESULT."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(spark), -(-chars // PART))
    texts = blocks(docs)
    back = totals(texts, n)
    sums = back.agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = sums[0] or 0, sums[1] or 0
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("held", "array<boolean>"), ("ends", "array<long>"))]
    own = texts.select("block", F.lit(-1).alias("part"), F.col("flat").alias("words"), F.col("keys").alias("pairs"), "ids", "held", "ends")
    answers = back.select("block", "part", "words", "pairs", *none)

    def score(key, group):
        rows = {p: i for i, p in enumerate(group.column("part").to_pylist())}
        at = lambda c, p: group.column(c)[rows[p]].as_py()
        ids, held = at("ids", -1), at("held", -1)
        b = Block.of({"flat": at("words", -1), "keys": at("pairs", -1), "held": held, "ends": at("ends", -1)})
        counts, pair_counts = np.zeros(len(b.keys), np.int64), np.zeros(len(b.pairs), np.int64)
        for p, w, q in _asked(b, n)[0]:
            counts[w] = _large(at("words", p), len(w))
            pair_counts[q] = _large(at("pairs", p), len(q))
        a = Automaton(len(b.keys), counts, b.pairs, pair_counts, tokens, kinds)
        starts = np.r_[0, b.ends[:-1]]
        base = np.add.reduceat(a.unigram[b.flat], starts)
        known = np.add.reduceat((counts[b.flat] > 0).astype(np.int64), starts)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(b.ends - starts),
                "n_known": pa.array(known),
                "train_tokens": pa.array([tokens] * len(ids), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(a.traverse(b.flat, b.ends)),
            }
        )

    return own.unionByName(answers).groupBy("block").applyInArrow(score, _RESULT)


def op4_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", 5) == 1).alias("held_out")))
