"""Licence scans by a generalised suffix automaton.

All templates (and base phrases) go into one automaton over their words. A text is streamed through it, which gives matching statistics: at every
word the longest run of words, ending there, that stands in some template. Runs that can't be extended are anchors; anchors of a template that
follow each other in text and template alike, with at most `gap` words left out on either side, are chained, and a chain that covers `least` of
its template's words or more is a span. Templates of fewer than `notice` words must be there whole and in one run. A span is dropped where one of
another label overlaps it that covers as many words and a greater share (version 2 of a notice beside version 3). A base phrase is found wherever
the matched run ends with it, whole.

Words that no template has, and neighbours that stand together in none, end every run, so numpy passes over them; only runs of known neighbours
walk the automaton. Templates and their automaton are a parameter of bounded size that goes to the tasks with the function; documents are
scanned where they are read, without a shuffle.

Defined cases: null text counts as empty: no words, no labels, score 0; rows that repeat are judged each, alike; a null id stays; very long texts
are streamed in blocks that end between words, with the state carried over; of chains that cover as much the earlier and then the shorter one
stands; an empty table gives an empty result; extra columns are kept by scanned(), ignored by the query.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import licences
from docloom.llm.common import table

#: ASCII that is neither digit nor letter parts words; A-Z is lower-cased; bytes of other characters stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 4_000_000


def words_of(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(_WORDS).split()


class SuffixAutomaton:
    """Of several word sequences; a state stands for the runs of words that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for s, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].add((s, at))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            ends[self.link[v]] |= ends[v]
        ends[0] = set()
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, length: int, ends: list, clone: int | None = None) -> int:
        self.next.append({} if clone is None else dict(self.next[clone]))
        self.link.append(0 if clone is None else self.link[clone])
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        """The state of p's longest run and w, parted from q."""
        c = self._state(self.length[p] + 1, ends, clone=q)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier sequence has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, ends)
        new, p = self._state(self.length[last] + 1, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, ends)
        return new

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """State and length of the longest run that ends with w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)


class Scanner:
    """Places of base phrases and template spans of a text."""

    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str], least: float = 0.8, gap: int = 4, shortest: int = 3, notice: int = 20):
        texts = [*base, *(t for _, t in templates)]
        self.labels = [*base.values(), *(label for label, _ in templates)]
        self.n_base, self.shortest = len(base), shortest
        self.vocabulary: dict[bytes, int] = {}
        cut = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)] for t in texts]
        self.sizes = [len(c) for c in cut]
        if not all(self.sizes):
            raise ValueError("licence_scan: a template without words")
        self.needed = [n if n < notice else least * n for n in self.sizes]
        self.gaps = [0 if n < notice else gap for n in self.sizes]
        self.automaton = SuffixAutomaton(cut)
        n = len(self.vocabulary)
        self.known = np.zeros((n + 1, n + 1), bool)  # neighbours in a template; the last row and column stand for other words
        for c in cut:
            self.known[c[:-1], c[1:]] = True
        self.single = {w: [s for s in range(len(base)) if cut[s] == [w]] for w in {c[0] for c in cut[: len(base)] if len(c) == 1}}
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]  # base phrases that a state's runs end with
        for p in range(len(base)):
            state = matched = 0
            for w in cut[p]:
                state, matched = self.automaton.step(state, matched, w)
            self.whole[state].append((p, matched))
        for v in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            self.whole[v] += self.whole[self.automaton.link[v]]

    def ids(self, text: bytes) -> np.ndarray:
        """The text's words as numbers, block by block."""
        other, out, at = len(self.vocabulary), [], 0
        while at < len(text) or not out:
            end = at + BLOCK
            if end < len(text):
                block = text[at:end].translate(_WORDS)
                space = block.rfind(b" ")
                while space < 0 and end < len(text):  # one word of a block's length
                    end += BLOCK
                    block = text[at:end].translate(_WORDS)
                    space = block.rfind(b" ")
                if end < len(text):
                    block, end = block[:space], at + space + 1
            else:
                block = text[at:].translate(_WORDS)
            words = block.split()
            get = self.vocabulary.get
            out.append(np.fromiter((get(w, other) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(out)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
        """Words; (label, start) of base phrases; (label, first word, last word, covered words, share) of spans."""
        ids = self.ids(text)
        near = self.known[ids[:-1], ids[1:]]
        places = [(self.labels[s], int(i)) for w, phrases in self.single.items() for i in np.flatnonzero(ids == w) for s in phrases]
        edges = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        chains = Chains(self)
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            self._walk(ids[lo : hi + 1].tolist(), lo, places, chains)
        return len(ids), sorted(places, key=lambda p: (p[1], p[0])), chains.done()

    def _walk(self, run: list[int], first: int, places: list, chains: Chains) -> None:
        a, state, matched = self.automaton, 0, 0
        for i, w in enumerate(run, first):
            to, longer = a.step(state, matched, w)
            if matched >= self.shortest and longer != matched + 1:
                chains.anchor(i - 1, matched, a.ends[state])
            state, matched = to, longer
            for s, size in self.whole[state]:
                if matched >= size > 1:
                    places.append((self.labels[s], i - size + 1))
        if matched >= self.shortest:
            chains.anchor(first + len(run) - 1, matched, a.ends[state])


class Chains:
    """Chains of anchors, template by template. An anchor continues one whose end lies at most `gap` words before its own start (in text and
    template), or inside it, so only those of the last words are held; a template's chains that overlap in the text leave their best."""

    def __init__(self, scanner: Scanner):
        self.scanner = scanner
        self.longest = max(scanner.sizes)
        self.live: dict[int, deque] = {}
        self.best: dict[int, list[tuple[int, int, int]]] = {}

    def anchor(self, last: int, matched: int, ends) -> None:
        for s, t_last in ends:
            if s < self.scanner.n_base:
                continue
            live, gap = self.live.setdefault(s, deque()), self.scanner.gaps[s]
            while live and live[0][0] < last - self.longest - gap:
                live.popleft()
            covered, start = matched, last - matched + 1
            for p_last, p_t_last, p_covered, p_start in reversed(live):
                d, t = last - p_last, t_last - p_t_last
                if d > matched + gap:
                    break
                if d > 0 and t > 0:
                    fresh = min(matched, d, t)
                    if d - fresh <= gap and t - fresh <= gap and (p_covered + fresh, p_start) > (covered, start):
                        covered, start = p_covered + fresh, p_start
            live.append((last, t_last, covered, start))
            self._keep(s, start, last, covered)

    def _keep(self, s: int, start: int, last: int, covered: int) -> None:
        if covered < self.scanner.needed[s]:
            return
        kept = self.best.setdefault(s, [])
        while kept and kept[-1][1] >= start:
            if kept[-1][2] >= covered:
                return
            kept.pop()
        kept.append((start, last, covered))

    def done(self) -> list[tuple[str, int, int, int, float]]:
        """Spans in the order of the text, without those that one of another label beats."""
        sizes, labels, out, near = self.scanner.sizes, self.scanner.labels, [], []
        for a, b, c, label, share in sorted((a, b, c, labels[s], c / sizes[s]) for s, kept in self.best.items() for a, b, c in kept):
            near = [x for x in near if x["last"] >= a]  # one of each template at most
            new = {"first": a, "last": b, "covered": c, "label": label, "share": share, "stands": True}
            for x in near:
                if x["label"] != label and x["covered"] >= c and x["share"] > share:
                    new["stands"] = False
                elif x["label"] != label and c >= x["covered"] and share > x["share"]:
                    x["stands"] = False
            near.append(new)
            out.append(new)
        return [(x["label"], x["first"], x["last"], x["covered"], x["share"]) for x in out if x["stands"]]


_PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())]))
_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("covered", T.LongType()),
            T.StructField("share", T.DoubleType()),
        ]
    )
)


def scanned(df: DataFrame, text: str = "text", templates=None, base=None, least: float = 0.8, gap: int = 4) -> DataFrame:
    """df's columns but the text, with n_words, places (of base phrases) and spans (of templates); columns of these names are replaced."""
    made = [T.StructField("n_words", T.LongType()), T.StructField("places", _PLACES), T.StructField("spans", _SPANS)]
    kept = [f for f in df.schema.fields if f.name not in {text, *(m.name for m in made)}]
    schema = T.StructType([*kept, *made])
    names = [f.name for f in kept]
    chosen, phrases = licences.TEMPLATES if templates is None else templates, licences.BASE if base is None else base

    def run(batches):
        scanner = Scanner(chosen, phrases, least, gap)
        places, spans = _arrow(scanner)
        for b in batches:
            found = [scanner.scan(x.as_py() or b"") for x in b.column(text).cast(pa.binary())]
            n, p, s = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(n, pa.int64()), places(p), spans(s)], names=schema.names)

    return df.mapInArrow(run, schema)


def _arrow(scanner: Scanner):
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))

    def rows(kind):
        names = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
        return lambda found: pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], kind)

    return rows(place), rows(span)


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is the greatest share of a template that a span covers; a base phrase, found whole, counts 1."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_distinct(F.col("places.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("spans.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"], s["last_word"])), ",").alias("spans"),
    )
