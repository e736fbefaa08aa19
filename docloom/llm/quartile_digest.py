"""Document fingerprints: a quartile bucket digest.

Every window of five bytes gives six byte triplets (the first byte with two of the four after it); each is hashed to one of 256 buckets and
counted. The digest has the length on a logarithmic scale, two quartile ratios and, for each bucket, the quarter its count falls into (two
bits). The difference of two digests adds the buckets' distances (0, 1, 2 or 6) and the header's, is bounded by LIMIT, and likeness is
1 - difference / LIMIT.

Defined cases: null and empty texts have the digest of no bytes (likeness 1 with each other); texts under three bytes have empty buckets and
differ by length alone; equal texts have equal digests. For the successor of a document, rows go by descending doc_id (null last, equal ids
by text), and the last one is followed by the first; a table of one row is followed by itself. A very long text is counted whole, a megabyte at a time; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import LEAST_LONG, Ranges, parts, range_bounds, table

BUCKETS, LIMIT = 256, 480
_PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_TABLES = np.stack([np.random.RandomState(90 + i).permutation(256).astype(np.uint8) for i in range(5)])
_STEP = np.array([[(0, 1, 2, 6)[abs(a - b)] for b in range(4)] for a in range(4)], np.int64)


def counts(data: np.ndarray) -> np.ndarray:
    """Triplets in each bucket."""
    n = len(data)
    if n < 3:
        return np.zeros(BUCKETS, np.int64)
    hashed = [t[data] for t in _TABLES]
    return np.bincount(np.concatenate([hashed[0][: n - j] ^ hashed[i][i : n - j + i] ^ hashed[j][j:] ^ np.uint8(17 * k) for k, (i, j) in enumerate(_PAIRS) if n > j]), minlength=BUCKETS)


def _pieces(data: np.ndarray, size: int = 1 << 20):
    for at in range(0, max(len(data) - 2, 1), size):
        yield at, data[at : at + size + 4]


def _counted(data: np.ndarray) -> np.ndarray:
    """As counts(), a megabyte at a time: a piece counts the windows that begin in it."""
    if len(data) <= 1 << 20:
        return counts(data)
    total = np.zeros(BUCKETS, np.int64)
    for at, piece in _pieces(data):
        total += counts(piece)
        if at + (1 << 20) < max(len(data) - 2, 1):
            total -= counts(piece[1 << 20 :])  # these begin in the next piece
    return total


def digest(data: bytes) -> str:
    """Hex: kind, length, ratios, 64 bytes of quarters."""
    c = _counted(np.frombuffer(data, np.uint8))
    q = np.partition(c, (63, 127, 191))[[63, 127, 191]]
    quarters = (c[:, None] > q).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    body = quarters[:, 0] | quarters[:, 1] << 2 | quarters[:, 2] << 4 | quarters[:, 3] << 6
    length = min(255, round(16 * math.log2(len(data) + 1) * 0.45))
    top = max(int(q[2]), 1)
    return bytes([1, length, int(15 * q[0] / top) << 4 | int(15 * q[1] / top)]).hex() + body.tobytes().hex()


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    off = abs(int(x[1]) - int(y[1])) + abs(int(x[2] >> 4) - int(y[2] >> 4)) + abs(int(x[2] & 15) - int(y[2] & 15))
    for shift in (0, 2, 4, 6):
        off += int(_STEP[x[3:] >> shift & 3, y[3:] >> shift & 3].sum())
    return 1.0 - min(off, LIMIT) / LIMIT


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """df's columns and the digest of each whole text."""
    kept = [f.name for f in df.schema.fields if f.name != into]
    schema = T.StructType([*(f for f in df.schema.fields if f.name != into), T.StructField(into, T.StringType())])

    def run(batches):
        for b in batches:
            out = [digest((t or "").encode()) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(out, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


_NONE = LEAST_LONG


def with_successor(docs: DataFrame, each, schema: T.StructType) -> DataFrame:
    """Rows of each(doc_id, text, next doc's text, memory) for every document. Rows are dealt by ranges of doc_id (one shuffle, of texts packed with
    zstandard) and sorted; an id that holds many rows has several ranges, by the hash of its texts. The last of a range finds its successor in a
    copy of the first row of the next range, sent along with it. A task holds two documents at a time. memory: a dict that is handed from a row to
    the next in order."""
    import zstandard

    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", 4 * parts(spark))
    cuts = Ranges(bounds)
    tie = F.xxhash64(F.coalesce("text", F.lit(""))) if cuts.own.any() else F.lit(0).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), tie.alias("tie"), "text")

    def places(b):
        """Ties as longs rise like unsigned ones with the other first bit."""
        return cuts.of(b.column("doc_id").to_numpy(), (b.column("tie").to_numpy() ^ np.int64(_NONE)).view(np.uint64)).astype("i4")

    def ranged(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(b)), b.column("doc_id"), b.column("tie")], names=["range", "doc_id", "tie"])

    # as many rows as ranges: the first one of each that has rows
    firsts = keyed.select("doc_id", "tie").mapInArrow(ranged, "range int, doc_id long, tie long").groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("top")).collect()
    tops = sorted((r["range"], tuple(r["top"])) for r in firsts)
    follows = {}  # first (id, tie) of a range -> the range before which it is wanted
    for (_, low), (high_range, _) in zip(tops, tops[1:], strict=False):
        follows.setdefault(low, []).append(high_range)
    if tops:
        follows.setdefault(tops[-1][1], []).append(tops[0][0])
    packed = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("copy", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("text", T.BinaryType())])

    def pack(batches):
        compress, copied = zstandard.ZstdCompressor(level=3).compress, {}
        for b in batches:
            ids, ties, texts, ranges = b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), b.column("text").to_pylist(), places(b).tolist()
            for lo in range(0, len(texts), 500):
                rows = []
                for r, i, h, t in zip(*(c[lo : lo + 500] for c in (ranges, ids, ties, texts)), strict=True):
                    x = compress((t or "").encode())
                    rows.append((r, 0, i, h, x))
                    # of the rows that a range may begin with, a task sends the least packed text so far
                    if (i, h) in follows and x < copied.get((i, h), x + b"\0"):
                        copied[i, h] = x
                        rows += [(to, 1, i, h, x) for to in follows[i, h]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=packed.names)

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        names, kinds = schema.names, [T_ARROW[type(f.dataType)] for f in schema.fields]
        before, memory, wanted, rows = None, {}, False, []
        for b in batches:
            for r, copy, i, _, x in zip(*(b.column(k).to_pylist() for k in packed.names), strict=True):
                if copy and not wanted:
                    continue  # a second row with the id of the range's last
                text = unpack(x).decode()
                if before is None or before[0] != r:
                    memory.clear()
                else:
                    rows.append(each(before[1], before[2], text, memory))
                before, wanted = (None, False) if copy else ((r, None if i == _NONE else i, text), True)
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # equal ids: by tie and packed text, which equal texts share; the copy that is taken is the first of its range in the same order
    dealt = keyed.mapInArrow(pack, packed)
    return dealt.repartition(parts(spark), "range").sortWithinPartitions("range", "copy", F.desc("doc_id"), F.desc("tie"), "text").mapInArrow(run, schema)


T_ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64()}


def edited(text: str, following: str) -> str:
    """The last third of text (code points, rounded down) gives way to the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def op9_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    )

    def each(doc_id, text, following, memory):
        own = memory.get("next") or digest(text.encode())
        memory["next"] = after = digest(following.encode())
        changed = edited(text, following).encode()
        other = digest(changed)
        return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, after)

    return with_successor(table(spark, sf_dir, "documents"), each, schema)
