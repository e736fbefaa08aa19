"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose merged piece has the best score (leftmost on ties) is merged
first, its new neighbours enter the agenda, stale entries are skipped; symbols without a piece fall back to bytes. Where no piece continues
from a non-space into a space, nor holds a line feed, and texts aren't normalised, a text falls into segments (a run of spaces with what
follows it, or a line feed) that are encoded alone and remembered; otherwise whole normalised texts are. Every Arrow batch holds what it
encodes for the first time against the sentencepiece library in one call. The ids are the agenda's; where the library's differ, the task ends
with an AgendaError that names the segment. A vocabulary that isn't of the merge type is refused.

Defined cases: null text counts as empty and gives begin and end ids only; rows that repeat, and equal texts, give equal results; the order of
rows has no part in them; a null id stays; a very long text is encoded whole, segment by segment; an empty table gives an empty result; extra
columns are ignored, or kept by the column functions.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import Generations, table

SPACE = "▁"
_SEGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class AgendaError(ValueError):
    """The agenda's ids aren't the library's."""


class AgendaEncoder:
    """Ids of a segment by the agenda."""

    def __init__(self, processor):
        self.sp = processor
        size = processor.get_piece_size()
        plain = [i for i in range(size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        self.ids = {processor.id_to_piece(i): i for i in plain}
        scores = {p: processor.get_score(i) for p, i in self.ids.items()}
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[scores[p]] for p in scores}
        ids = self.ids
        pairs = {ids[p[:k]] << 32 | ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids} or {-1: 0}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.never = len(order)
        self.rank_of = np.full(size + 1, self.never, np.int64)
        self.char_ids = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            self.rank_of[i] = self.ranks[p]
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.closed = all(c in ids for p in ids for c in p)
        self.bytes = {}
        for i in range(size):
            if processor.is_byte(i):
                self.bytes[int(processor.id_to_piece(i)[3:5], 16)] = i
        self.unknown = processor.unk_id()
        self.merge_type = bool(self.ids) and len(self.bytes) == 256
        self.splits = self.merge_type and not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.splits = self.splits and processor.normalize(" é  éﬁ\n x ") == f"{SPACE}{SPACE}é{SPACE}{SPACE}éﬁ\n{SPACE}x{SPACE}"

    def encode(self, segment: str) -> list[int]:
        """The agenda holds rank and place of a pair in one number; a smaller rank is a better score, equal scores share one."""
        ranks, n = self.ranks, len(segment)
        symbols = list(segment)
        agenda = [ranks[segment[i : i + 2]] << 32 | i for i in range(n - 1) if segment[i : i + 2] in ranks]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                best = heappop(agenda)
                i = best & 0xFFFFFFFF
                left, j = symbols[i], after[i]
                if left is None or j >= n or ranks.get(piece := left + symbols[j]) != best >> 32:
                    continue
                symbols[i], symbols[j] = piece, None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    r = ranks.get(piece + symbols[k])
                    if r is not None:
                        heappush(agenda, r << 32 | i)
                h = before[i]
                if h >= 0:
                    r = ranks.get(symbols[h] + piece)
                    if r is not None:
                        heappush(agenda, r << 32 | h)
        out, ids = [], self.ids
        for x in symbols:
            if x is not None:
                i = ids.get(x)
                if i is not None:
                    out.append(i)
                else:
                    out.extend(self.bytes[b] for b in x.encode())
        return out

    def encode_many(self, segments: list[str]) -> dict[str, bytes]:
        """Segments of one length at a time: a row of the agenda for each, of which every round takes the best pair and renews the pairs beside
        it. Long segments, and those with characters that fall back to bytes, go through encode()."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        for n, group in by_length.items():
            if n > 40 or not self.closed:
                out |= {s: array("I", self.encode(s)).tobytes() for s in group}
                continue
            symbols = self.char_ids[np.frombuffer("".join(group).encode("utf-32-le"), "<u4")].reshape(-1, n)
            known = symbols.min(axis=1) >= 0
            if not known.all():
                out |= {s: array("I", self.encode(s)).tobytes() for s, k in zip(group, known, strict=True) if not k}
                group, symbols = [s for s, k in zip(group, known, strict=True) if k], symbols[known]
            rows = np.arange(len(group))
            made = self._made(symbols[:, :-1], symbols[:, 1:])
            agenda = self.rank_of[made]
            while len(rows):
                best = agenda.argmin(axis=1) if n > 1 else np.zeros(len(rows), int)
                ends = agenda[np.arange(len(rows)), best] == self.never if n > 1 else np.ones(len(rows), bool)
                if ends.any():
                    flat = symbols[ends].astype("<u4").tobytes()
                    out.update((group[r], flat[k * 4 * n : (k + 1) * 4 * n]) for k, r in enumerate(rows[ends]))
                    go = ~ends
                    rows, symbols, made, agenda, best = rows[go], symbols[go], made[go], agenda[go], best[go]
                    if not len(rows):
                        break
                i = np.arange(len(rows))
                symbols[i, best] = made[i, best]
                keep = np.ones(symbols.shape, bool)
                keep[i, best + 1] = False
                symbols = symbols[keep].reshape(len(rows), n - 1)
                keep = np.ones(made.shape, bool)
                keep[i, best] = False
                made, agenda = made[keep].reshape(len(rows), n - 2), agenda[keep].reshape(len(rows), n - 2)
                n -= 1
                for at in (best - 1, best):
                    has = (at >= 0) & (at < n - 1)
                    r, c = i[has], at[has]
                    made[r, c] = new = self._made(symbols[r, c], symbols[r, c + 1])
                    agenda[r, c] = self.rank_of[new]
        return out

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or the last row of rank_of, which is never taken."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], len(self.rank_of) - 1)


class PieceCodec:
    """Encodes lists of texts to ids (as little-endian 32-bit bytes) and decodes them."""

    def __init__(self, model: str, cache: int = 300_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.agenda = AgendaEncoder(self.sp)
        if not self.agenda.merge_type:
            raise ValueError(f"piece_codec: {model} has no merge-type vocabulary with bytes")
        self.seen = Generations(cache)
        self.head = np.array([self.sp.bos_id()], "<u4").tobytes()
        self.tail = np.array([self.sp.eos_id()], "<u4").tobytes()

    def _segments(self, text: str) -> list[str]:
        """Segments with their spaces as they stand in the text; the space that the library puts first is there too."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        out, first = [], SPACE
        for line in text.split("\n"):
            if first == "":
                out.append("\n")
            words = line.split(" ")
            tail = words.pop() if words[-1] == "" and len(words) > 1 else None
            if words[0] or first:
                out.append(first + words[0])
            out.extend([SPACE + w for w in words[1:]])
            if tail is not None:
                out.append(SPACE)
            first = ""
        return out

    def _learn(self, segments: list[str]) -> None:
        """New segments by the agenda, held against the library in one call."""
        ours, asked, skip = self.agenda.encode_many(segments), [], []
        for s in segments:
            if s.startswith(SPACE) and s != SPACE:
                asked.append(s[1:])
                skip.append(0)
            else:  # without the library's first space: behind a line feed
                asked.append("\n" + s)
                skip.append(-1)
        lead = self.sp.encode("\n") if -1 in skip else []
        for s, k, theirs in zip(segments, skip, self.sp.encode(asked, num_threads=1), strict=True):
            self._check(s, ours[s], theirs[len(lead) :] if k else theirs)
        self.seen.young.update(ours)

    def _check(self, what: str, ours: bytes, theirs: list[int]) -> None:
        if ours != array("I", theirs).tobytes():
            raise AgendaError(f"the agenda's ids of {what[:200]!r} aren't the library's")

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for t, theirs in zip(texts, self.sp.encode(texts, num_threads=1), strict=True):
            ours = array("I", self.agenda.encode(self.sp.normalize(t)) if t else []).tobytes()
            self._check(t, ours, theirs)
            out.append(ours)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.agenda.splits:
            return [self.head + x + self.tail for x in self._whole(texts)]
        cut = [self._segments(t) for t in texts]
        new = self.seen.missing(set().union(*cut))
        if new:
            self._learn(new)
        get = self.seen.young.__getitem__
        return [self.head + b"".join(map(get, x)) + self.tail for x in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


_codecs: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """One a Python worker; it stays between tasks."""
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def _slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000):
    """Parts of a batch of about so many characters, so that memory doesn't follow the number of long texts in it."""
    texts = batch.column(column).to_pylist()
    at = have = 0
    for i, t in enumerate(texts):
        have += len(t or "")
        if have >= chars:
            yield at, i + 1, texts[at : i + 1]
            at, have = i + 1, 0
    if at < len(texts):
        yield at, len(texts), texts[at:]


def encode_column(df: DataFrame, model: str, text: str = "text", ids: str = "ids", same: str | None = None, drop_text: bool = False) -> DataFrame:
    """df's columns and ids: array<int>, begin and end ids with it; with `same`, a column of that name tells whether decoding gives the text."""
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name not in (ids, same) and not (drop_text and f.name == text)]
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(same, T.BooleanType())] if same else [])])

    def run(batches):
        c = codec(model)
        for b in batches:
            for lo, hi, texts in _slices(b, text):
                out = c.encode([t or "" for t in texts])
                lens = np.array([len(x) // 4 for x in out], "i4")
                flat = pa.array(np.frombuffer(b"".join(out), "<i4"))
                cols = [*(b.column(k).slice(lo, hi - lo) for k in kept), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype("i4")), flat)]
                if same:
                    cols.append(pa.array([x == (t or "") for x, t in zip(c.decode(out), texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df's columns and the text that the library decodes from ids; null ids give the empty text."""
    from pyspark.sql import types as T

    kept = [f.name for f in df.schema.fields if f.name != text]
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField(text, T.StringType())])

    def run(batches):
        c = codec(model)
        for b in batches:
            out = [c.sp.decode(x) if x else "" for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(out, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256. Encoding, decoding and digests in one pass over a batch, so that no ids are moved."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(model)
        for b in batches:
            for lo, hi, texts in _slices(b, text):
                ids = c.encode([t or "" for t in texts])
                back = c.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(key).slice(lo, hi - lo),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(key, text).mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
