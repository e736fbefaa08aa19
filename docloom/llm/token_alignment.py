"""Cross-tokenizer alignment by an event sweep.

Every token of tokenizer A or B is an event at the byte where it ends. The events of both sides go as one relation to their block of documents and
are put in the order of their offsets; a sweep then goes over them with a state that doesn't grow: the tokens since the last common end, and the
counters of the open document. Where both sides end a group closes; every distinct end gives one link (the two tokens that reach over it), so links
cost time in proportion to tokens. Two sweeps are made over the same shuffled events: the first counts, for each id pair, the documents of a block
that hold it linked; the counts are summed over all blocks by pair, compared within each A id, and go back to the blocks that asked; the second
gives each document's groups and its links' counts.

What travels. A block is about BLOCK characters of whole documents (one longer text is a block alone) laid end to end on a tape of bytes. A row
holds a run of end events of one side: ids alone, since an id's bytes tell how far it reaches, packed by zstandard. Runs of both sides are cut at the
same places, so the tokens since the last common end never outlive a run.

Texts are cut before a space that follows a character other than white space: neither a byte-level pattern nor a merge vocabulary without pieces
that go on into a space can join what stands on both sides (checked when the tokenizers are loaded; others get whole texts). Cut words are encoded
once and remembered. A word whose tokens' bytes aren't its own bytes leaves its document without tokens.

Defined cases: texts that are null, empty or whose bytes a side doesn't give back have no tokens: zeros and ''; repeated rows are documents each,
with equal results, and count each; a null id stays; ties for an A id's highest count all count as best; very long texts are cut into runs and
swept run by run; an empty table gives no rows; extra columns are ignored. Rows must come in an order that a second read repeats (files do).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Generations, parts, table

BLOCK = 4_000_000
RUN, WORDS = 400_000, 50_000
SPACE = "▁"
#: White space of any library's reckoning.
_WHITE = "\\s\u180e\u200b\ufeff"
#: What a word has in place of ids if its bytes don't come back.
_FOREIGN = (b"", b"", 0)
_CUT, _ODD, _ENDS_WHITE = re.compile(f"(?<=[^{_WHITE}]) "), re.compile(f"^ |[{_WHITE}] "), re.compile(f"[{_WHITE}]$")
#: Characters that all versions of Unicode put in the same classes.
_PLAIN = re.compile("[\\n\\t -~\u00a1-\u00ac\u00ae-\u00ff]*")
#: Fixed value: the pattern of byte-level vocabularies of this kind.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes: printable Latin-1 for themselves, the others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class ByteSide:
    """A byte-level vocabulary: ids of " " + word, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as f:
            model = json.load(f)
        letters, vocabulary = _byte_letters(), self.library.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pre = model.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"].get("merges", [])]
        in_order = all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
        self.cuts = plain
        self.quick = None
        if plain and in_order:  # ids are ranks: the same merges by a quicker library, for characters on which all agree
            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.quick = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of " " + text."""
        if self.quick is not None and _PLAIN.fullmatch(text):
            return self.quick.encode_ordinary(" " + text)
        return self.library.encode(" " + text, add_special_tokens=False).ids


class PieceSide:
    """A SentencePiece merge vocabulary, which puts a space first itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain) and sp.normalize(" é  éﬁ\n x ") == f"{SPACE}{SPACE}é{SPACE}{SPACE}éﬁ\n{SPACE}x{SPACE}"

    def encode(self, text: str) -> list[int]:
        """Ids of " " + text. Nothing (behind a space that ends a text) is the space alone, which the library doesn't put before nothing."""
        return self.sp.encode(text) or [self.sp.piece_to_id(SPACE)]


class Pair:
    """Two tokenizers: words' ids by both, remembered."""

    def __init__(self, a_path: str, b_path: str, cache: int = 200_000):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.kind = np.dtype("<u2" if max(len(self.a.bytes), len(self.b.bytes)) <= 1 << 16 else "<u4")
        self.seen = Generations(cache)
        self.reach = tuple(np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.wide = len(self.b.bytes)
        self.names = [str(i).encode() for i in range(max(len(self.a.bytes), self.wide))]
        self.spelled = [n + x for x in (b",", b"|", b";") for n in self.names]

    def words(self, text: str) -> list[str]:
        if not (self.a.cuts and self.b.cuts):
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def ids(self, words: list[str]) -> list[tuple[bytes, bytes, int]]:
        """Ids of both sides for each word, and its bytes; no bytes where a side doesn't give the word's own back."""
        held = list(map(self.seen.young.get, words))
        if None in held:
            full = len(self.seen.young) > self.seen.limit or self.seen.held > self.seen.chars
            self._learn(self.seen.missing(set(words) if full else {w for w, h in zip(words, held, strict=True) if h is None}))
            held = list(map(self.seen.young.__getitem__, words))
        return held

    def _learn(self, words: list[str]) -> None:
        """New words. Those that may be cut apart again are encoded in one text: of characters that all libraries class alike, and others."""
        alike = [w for w in words if w and _PLAIN.fullmatch(w) and not w[-1].isspace()]
        other = [w for w in set(words).difference(alike) if w and not _ENDS_WHITE.search(w)]
        for group in (alike, other) if self.a.cuts and self.b.cuts else ():
            self._learn_joined(group)
        for w in words:
            if w not in self.seen.young:
                raw = b" " + w.encode()
                a, b = self.a.encode(w), self.b.encode(w)
                same = b"".join([self.a.bytes[i] for i in a]) == raw and b"".join([self.b.bytes[i] for i in b]) == raw
                self.seen.young[w] = (np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes(), len(raw)) if same else _FOREIGN

    def _learn_joined(self, words: list[str]) -> None:
        text = " ".join(words)
        raw = b" " + text.encode()
        sizes = [1 + len(w.encode()) for w in words]
        ends = np.cumsum(sizes)
        sides = []
        for side, reach in zip((self.a, self.b), self.reach, strict=True):
            ids = side.encode(text) if words else []
            if b"".join([side.bytes[i] for i in ids]) != raw:
                return  # some word's bytes don't come back: word by word
            ids = np.array(ids, self.kind)
            last = np.cumsum(reach[ids])
            at = np.searchsorted(last, ends)
            if not (last[np.minimum(at, len(last) - 1)] == ends).all():
                return
            cut = [0, *((at + 1) * self.kind.itemsize).tolist()]
            flat = ids.tobytes()
            sides.append([flat[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)])
        self.seen.young.update(zip(words, zip(*sides, sizes, strict=True), strict=True))


@functools.cache
def _pair(a_path: str, b_path: str) -> Pair:
    """One a Python worker; it stays between tasks."""
    return Pair(a_path, b_path)


class Swept:
    """The events of one run: at each distinct end, the places of the two tokens that reach over it, whether both end, and the document."""

    def __init__(self, pair: Pair, first: int, a: np.ndarray, b: np.ndarray, ends: np.ndarray):
        self.pair, self.a, self.b, self.n_docs = pair, a, b, len(ends)
        reach_a, reach_b = np.cumsum(pair.reach[0][a]), np.cumsum(pair.reach[1][b])
        size = int(reach_a[-1]) if len(a) else 0
        if size != (int(reach_b[-1]) if len(b) else 0):
            raise ValueError("token_alignment: the sides of a run reach different bytes")
        mark = np.zeros(size + 1, np.uint8)
        mark[reach_a] = 1
        mark[reach_b] += 2
        at = np.flatnonzero(mark)
        mark = mark[at]
        self.ends_a, self.ends_b, self.both = (mark & 1).astype(bool), mark >= 2, mark == 3
        self.ia = np.cumsum(self.ends_a) - self.ends_a
        self.ib = np.cumsum(self.ends_b) - self.ends_b
        self.offset = at + first
        self.doc = np.searchsorted(ends, self.offset, side="left")  # n_docs: the document goes on in the next run

    def pairs(self) -> np.ndarray:
        return self.a[self.ia].astype(np.int64) * self.pair.wide + self.b[self.ib]

    def per_doc(self, which=None, weights=None) -> np.ndarray:
        return np.bincount(self.doc if which is None else self.doc[which], None if weights is None else weights, minlength=self.n_docs + 1)

    def spelled(self) -> tuple[list[bytes], np.ndarray]:
        """Decimal ids with what follows each (a comma, a bar behind A's last of a group, a semicolon behind B's), and each document's first one."""
        group = np.cumsum(self.both) - self.both
        n = int(group[-1]) + 1 if len(group) else 0
        ga, gb = group[self.ends_a], group[self.ends_b]
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        width = len(self.pair.names)
        code = np.empty(len(ga) + len(gb), np.int64)
        at_a = np.arange(len(ga)) + (np.cumsum(nb) - nb)[ga]
        at_b = np.arange(len(gb)) + np.cumsum(na)[gb]
        code[at_a], code[at_b] = self.a, self.b
        last = np.cumsum(na + nb)
        code[last - nb - 1] += width
        code[last - 1] += 2 * width
        tokens = self.per_doc(self.ends_a) + self.per_doc(self.ends_b)
        return list(map(self.pair.spelled.__getitem__, code.tolist())), np.r_[0, np.cumsum(tokens)]


def end_events(df: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """Runs of end events of both sides: block, first (the run's first byte on the block's tape), side, ids; with side 0 the keys of the documents
    that end in the run and the bytes where they do."""
    kind = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("first", T.LongType()),
            T.StructField("side", T.ByteType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("ends", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pair, zip_ = to_arrow_schema(schema), _pair(a_path, b_path), zstandard.ZstdCompressor(level=1)
        block, first, at, chars, keys, ends, sides = TaskContext.get().partitionId() << 32, 0, 0, 0, [], [], ([], [])

        def rows():
            packed = [zip_.compress(b"".join(s)) for s in sides]
            held = [[block] * 2, [first] * 2, [0, 1], packed, [keys, None], [ends, None]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow, strict=True)], schema=arrow)

        def taken(waiting):
            """Documents of one run: their words are looked up together."""
            nonlocal at
            words = [w for _, ws in waiting for w in ws]
            held, start = pair.ids(words), 0
            for doc, ws in waiting:
                own, start = held[start : start + len(ws)], start + len(ws)
                xs, ys, ns = zip(*own, strict=True) if own else ((), (), ())
                if all(ns):
                    sides[0].extend(xs)
                    sides[1].extend(ys)
                    at += sum(ns)
                keys.append(doc)
                ends.append(at)

        waiting, size = [], 0
        for b in batches:
            texts, ids = b.column(text), b.column(key)
            for i in range(b.num_rows):
                whole, doc = texts[i].as_py() or "", ids[i].as_py()
                new_block = bool(whole) and chars and chars + len(whole) > BLOCK
                if waiting and (new_block or size + len(whole) > RUN or len(waiting) >= 4096):
                    taken(waiting)
                    yield rows()
                    first, keys, ends, sides, waiting, size = at, [], [], ([], []), [], 0
                if new_block:
                    block, first, at, chars = block + 1, 0, 0, 0
                chars, size = chars + len(whole), size + len(whole)
                words = pair.words(whole) if whole else []
                if len(words) <= WORDS:
                    waiting.append((doc, words))
                    continue
                # a long document is a run for every WORDS words; foreign bytes are looked for before the first one is written
                if waiting:
                    taken(waiting)
                    yield rows()
                    first, keys, ends, sides, waiting = at, [], [], ([], []), []
                spans = range(0, len(words), WORDS)
                if all(n for k in spans for _, _, n in pair.ids(words[k : k + WORDS])):
                    for k in spans:
                        xs, ys, ns = zip(*pair.ids(words[k : k + WORDS]), strict=True)
                        sides = (list(xs), list(ys))
                        at += sum(ns)
                        if k + WORDS < len(words):
                            yield rows()
                            first = at
                keys, ends = [doc], [at]
                yield rows()
                first, keys, ends, sides, size = at, [], [], ([], []), 0
        if waiting:
            taken(waiting)
            yield rows()

    return df.select(key, text).mapInArrow(run, schema)


def _runs(rows, pair: Pair):
    """(block, Swept, keys) from rows in the order of block, first, side."""
    held, unzip = None, zstandard.ZstdDecompressor()
    for row in rows:
        if row["side"] == 0:
            held = row
            continue
        a, b = (np.frombuffer(unzip.decompress(x["ids"]), pair.kind).astype(np.int64) for x in (held, row))
        yield held["block"], Swept(pair, held["first"], a, b, np.array(held["ends"], np.int64)), held["keys"]


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


class _Tally:
    """Documents of a block that hold each pair."""

    def __init__(self):
        self.held, self.waiting, self.size, self.open = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0, None

    def add(self, s: Swept) -> None:
        span = len(s.pair.names) * s.pair.wide
        found = np.unique(s.doc * span + s.pairs())
        cut = np.searchsorted(found, [span, s.n_docs * span])
        if self.open is not None:  # a document that began in an earlier run
            first = np.union1d(self.open, found[: cut[0]])
            found = found[cut[0] :]
            cut = cut - cut[0]
            if s.n_docs:
                self._take(first)
                self.open = None
            else:
                self.open = first
                return
        rest = found[cut[1] :] - s.n_docs * span
        self.open = rest if len(rest) else None
        self._take(found[: cut[1]] % span)

    def _take(self, pairs: np.ndarray) -> None:
        self.waiting.append(pairs)
        self.size += len(pairs)
        if self.size > 4_000_000:
            self._merge()

    def _merge(self) -> None:
        new, n = np.unique(np.concatenate([np.empty(0, np.int64), *self.waiting]), return_counts=True)
        keys, back = np.unique(np.concatenate([self.held[0], new]), return_inverse=True)
        self.held = keys, np.bincount(back, np.concatenate([self.held[1], n]), minlength=len(keys)).astype(np.int64)
        self.waiting, self.size = [], 0

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self.held


def _counted(events: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """block, a, b, docs: how many documents of a block hold the pair linked."""

    def run(batches):
        pair, tally, block = _pair(a_path, b_path), _Tally(), None

        def rows():
            keys, docs = tally.done()
            for k in range(0, len(keys), 100_000):
                x = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), block)), pa.array((x // pair.wide).astype(np.int32)), pa.array((x % pair.wide).astype(np.int32)), pa.array(docs[k : k + 100_000])],
                    names=["block", "a", "b", "docs"],
                )

        for at, swept, _ in _runs(_rows(batches), pair):
            if at != block:
                if block is not None:
                    yield from rows()
                tally, block = _Tally(), at
            tally.add(swept)
        if block is not None:
            yield from rows()

    in_order = events.sortWithinPartitions("block", "first", "side")
    return in_order.mapInArrow(run, "block long, a int, b int, docs long")


def aligned(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = df.sparkSession
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("groups_sha256", T.StringType())])
    events = end_events(df, a_path, b_path, key, text).repartition(parts(spark), "block")
    # a pair has at most one row a block, so a hot id has as many rows as blocks, not as texts hold it
    by_id = _counted(events, a_path, b_path).repartition(parts(spark), "a")
    total = by_id.withColumn("total", F.sum("docs").over(Window.partitionBy("a", "b")))
    counts = total.select(F.col("block"), "a", "b", "total", (F.col("total") == F.max("total").over(Window.partitionBy("a"))).alias("best"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        pair, arrow = _pair(a_path, b_path), to_arrow_schema(schema)
        known = right.column("a").to_numpy().astype(np.int64) * pair.wide + right.column("b").to_numpy()
        order = np.argsort(known)
        known, total, best = known[order], right.column("total").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        keys, numbers, digests = [], [], []
        open_numbers, open_digest = np.zeros(6, np.int64), hashlib.sha256()
        for _, s, ids in _runs(_rows(left.sort_by([("first", "ascending"), ("side", "ascending")]).to_batches(1)), pair):
            where = np.searchsorted(known, s.pairs())
            # float sums of counts below 2^53 are exact
            columns = (s.per_doc(s.ends_a), s.per_doc(s.ends_b), s.per_doc(s.both), s.per_doc(), s.per_doc(best[where]), s.per_doc(weights=total[where]))
            held = np.array([c.astype(np.int64) for c in columns]).T
            held[0] += open_numbers
            spelled, bounds = s.spelled()
            for d in range(s.n_docs):
                open_digest.update(b"".join(spelled[bounds[d] : bounds[d + 1]])[:-1])
                keys.append(ids[d])
                numbers.append(held[d])
                digests.append(open_digest.hexdigest() if held[d][0] else "")
                open_digest = hashlib.sha256()
            open_numbers = held[s.n_docs]
            open_digest.update(b"".join(spelled[bounds[s.n_docs] :]))
        out = np.array(numbers, np.int64).reshape(-1, 6)
        return pa.Table.from_arrays([pa.array(keys, arrow.field(0).type), *(pa.array(out[:, k]) for k in range(6)), pa.array(digests, pa.string())], schema=arrow)

    return events.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)


def groups(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment itself, a row for each group: key, group (from 0), end (its last byte, from the document's start), a and b (ids)."""
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("group", T.LongType()), T.StructField("end", T.LongType()), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        pair, arrow, begins, block, open_groups = _pair(a_path, b_path), to_arrow_schema(schema), 0, None, []
        for at, s, ids in _runs(_rows(batches), pair):
            if at != block:
                block, begins, open_groups = at, 0, []
            number = np.cumsum(s.both) - s.both
            starts_a, starts_b = (np.searchsorted(number[e], np.arange(int(s.both.sum()) + 1)) for e in (s.ends_a, s.ends_b))
            cols, docs = [[], [], [], [], []], s.doc[s.both].tolist()
            for g, (d, end) in enumerate(zip(docs, s.offset[s.both].tolist(), strict=True)):
                open_groups.append((end - begins, s.a[starts_a[g] : starts_a[g + 1]].tolist(), s.b[starts_b[g] : starts_b[g + 1]].tolist()))
                if d < s.n_docs and (g + 1 == len(docs) or docs[g + 1] != d):
                    for k, (e, a, b) in enumerate(open_groups):
                        for c, v in zip(cols, (ids[d], k, e, a, b), strict=True):
                            c.append(v)
                    open_groups, begins = [], end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    events = end_events(df, a_path, b_path, key, text).repartition(parts(df.sparkSession), "block")
    return events.sortWithinPartitions("block", "first", "side").mapInArrow(run, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
