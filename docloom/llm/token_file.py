"""Token-id output by bit-plane shuffling.

File format. Ids are written in ascending doc_id order. A file is a table (Parquet without a codec, so any store that Spark writes to holds
it) of chunks; a chunk is a run of whole documents of one doc_id range. Its `blob` is a sequence of blocks of BLOCK ids each (the last one may
be shorter); a block is transposed into byte planes (or bit planes), low plane first, and each plane is compressed alone with zstandard.
The other columns are the chunk index: range, first id of the chunk in its range, ids, the place and ids of every block in the blob, the
documents with their lengths. Planes that are zero throughout take no bytes.

Defined cases: null text counts as empty, and its document holds the end id alone; a null doc_id comes first; rows of one doc_id stand in the
order of the XXH64 of their texts, and one doc_id that holds many rows is spread over ranges by it; a very long text is one chunk, of many
blocks; an empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import LEAST_LONG, Generations, Ranges, parts, range_bounds, table

BLOCK = 65_536


def _stay(chars) -> str:
    """Those of the characters whose lower case is among them: what Python and the library lower-case and cut alike."""
    held = set(chars)
    return "".join(c for c in chars if set(c.lower()) <= held)


def _class(chars: str) -> str:
    return "[" + re.escape(chars) + "]"


#: Characters for which Python and the library surely agree: printable Latin ones. None of them changes under NFC.
_LATIN = _stay([chr(c) for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC)) for c in range(lo, hi + 1)])
_LETTERS, _DIGITS = "".join(c for c in _LATIN if c.isalpha() and c == c.lower()), "".join(c for c in _LATIN if c.isnumeric())
_PLAIN = re.compile(f"{_class(_LATIN + ' ' + chr(9) + chr(10) + chr(13))}*").fullmatch
#: The vocabulary's cut into words, over lower-cased plain text.
_CUT = re.compile(f"{_class(_LETTERS)}+|'s|'t|'re|'ve|'m|'ll|'d|{_class(_DIGITS)}|[^\\s{re.escape(_LETTERS + _DIGITS)}]+").findall
_WHOLE = "\0"  # in front of chunks that go to the library whole


class WordEncoder:
    """Ids of whole texts as the library gives them, in `width` bytes each. Plain texts are lower-cased and cut into words here; each word that
    is new goes to the library's model once and is remembered. Other texts fall at white space into chunks, of which the plain ones are treated
    so and the others go to the library whole; texts with special tokens, or with characters that Python alone takes for white space, go there
    as they are. A vocabulary that cuts otherwise is the library's altogether."""

    def __init__(self, file: str, cache: int = 150_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.model = self.library.model
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("[\x00\x1c-\x1f\x85]").search
        self.seen = Generations(cache)
        pool = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: printable bytes stand for themselves
        rest = iter(range(256, 512))
        self.alphabet = [chr(b) if b in pool else chr(next(rest)) for b in range(256)]
        probe = ["Hello, World's 42 fine-days!", "Ça n'était ÉTÉ; größer «ñandú» 3½", "it're I'LL 'd''s x2y", _LATIN, " ".join(_LATIN), "a".join(_LATIN)]
        self.fast = self.encode(probe, True) == self.encode(probe, False)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _keys(self, text: str) -> list[str] | None:
        for t in self.special:
            if t in text:
                return None
        if _PLAIN(text):
            return _CUT(text.lower())
        if self.odd(text):
            return None
        out = []
        for c in text.split():
            if _PLAIN(c):
                out += _CUT(c.lower())
            else:
                out.append(_WHOLE + c)
        return out

    def _learn(self, words: list[str]) -> None:
        known, tokenize, alphabet = self.seen.young, self.model.tokenize, self.alphabet
        for w in words:
            known[w] = self._bytes([t.id for t in tokenize(w if w.isascii() else "".join([alphabet[b] for b in w.encode()]))])

    def encode(self, texts: list[str], fast: bool | None = None) -> list[bytes]:
        """Little-endian ids of `width` bytes, without special ones."""
        if not (self.fast if fast is None else fast):
            return [self._bytes(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = [self._keys(t) for t in texts]
        new = self.seen.missing(set().union(*[x for x in cut if x]))
        young = self.seen.young
        hard = [k for k in new if k[0] == _WHOLE]
        if hard:
            for k, e in zip(hard, self.library.encode_batch([k[1:] for k in hard], add_special_tokens=False), strict=True):
                young[k] = self._bytes(e.ids)
        self._learn([k for k in new if k[0] != _WHOLE] if hard else new)
        get = young.__getitem__
        return [b"".join(map(get, x)) if x is not None else self._bytes(self.library.encode(t, add_special_tokens=False).ids) for x, t in zip(cut, texts, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    if file not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


def pack_block(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    """One block: kind, ids, planes, each plane's size, the planes."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == "bit":
        raw = np.packbits(np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little").reshape(4, -1, 8).transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=level).compress
    out = [pack(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in raw]
    head = np.array([planes == "bit", len(ids), len(out), *map(len, out)], "<u4").tobytes()
    return head + b"".join(out)


def unpack_block(blob: bytes) -> np.ndarray:
    import zstandard

    bit, n, count = np.frombuffer(blob, "<u4", 3).tolist()
    sizes = np.frombuffer(blob, "<u4", count, 12).tolist()
    width, at, rows = (n + 7) // 8 if bit else n, 12 + 4 * count, []
    for size in sizes:
        rows.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at : at + size], max_output_size=width), np.uint8) if size else np.zeros(width, np.uint8))
        at += size
    raw = np.stack(rows)
    if bit:
        bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :n].reshape(4, 8, n).transpose(0, 2, 1)
        raw = np.packbits(bits, axis=2, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _slices(batch: pa.RecordBatch, chars: int = 1_000_000):
    """Parts of a batch of about so many characters, so that memory doesn't follow the number of long texts in it."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    at = have = 0
    for i, t in enumerate(texts):
        have += len(t)
        if have >= chars or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, have = i + 1, 0


def encode_documents(docs: DataFrame, file: str, end: int | None = 1, bounds: list[int] | None = None) -> DataFrame:
    """doc_id, its range and tie (the hash of its text), and its ids (with the end id) as little-endian bytes: 16 bits each where the vocabulary
    allows, else 32."""
    ranges = Ranges(bounds or [])
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import xxhash

        e = encoder(file)
        tail = b"" if end is None else e._bytes([end])
        for b in batches:
            for part, texts in _slices(b):
                out = [x + tail for x in e.encode(texts)]
                ties = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
                ids = part.column("doc_id")
                at = ranges.of(ids.fill_null(LEAST_LONG).to_numpy(zero_copy_only=False), ties).astype("i4")
                # the order of signed longs is that of the unsigned hashes
                yield pa.RecordBatch.from_arrays([pa.array(at), ids, pa.array((ties ^ np.uint64(1 << 63)).view(np.int64)), pa.array(out, pa.binary())], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_CHUNK = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("block_at", T.ArrayType(T.LongType())),
        T.StructField("block_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ]
)


def chunks(encoded: DataFrame, width: int = 2, planes: str = "byte", chunk_ids: int = 4 * BLOCK) -> DataFrame:
    """Chunk rows of sorted partitions. A task holds one chunk (or one long document) at a time."""

    def run(batches):
        held: list = []
        have = first = 0
        now = None

        def flush():
            nonlocal held, have, first
            ids = np.frombuffer(b"".join(x for _, x in held), f"<u{width}").astype("<u4")
            blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
            packed = [pack_block(x, planes) for x in blocks]
            at = np.cumsum([0, *map(len, packed)])[:-1].tolist()
            row = {"range": now, "first": first, "n_ids": len(ids), "block_at": at, "block_ids": [len(x) for x in blocks], "doc_ids": [d for d, _ in held], "lengths": [len(x) // width for _, x in held], "blob": b"".join(packed)}
            first += len(ids)
            held, have = [], 0
            return pa.RecordBatch.from_pylist([row], schema=chunk_schema)

        for b in batches:
            for r, d, x in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if held and (r != now or have >= chunk_ids):
                    yield flush()
                if r != now:
                    now, first = r, 0
                held.append((d, x))
                have += len(x) // width
        if held:
            yield flush()

    chunk_schema = pa.schema(
        [("range", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block_at", pa.list_(pa.int64())), ("block_ids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blob", pa.binary())]
    )
    dealt = encoded.repartition(parts(encoded.sparkSession), "range").sortWithinPartitions(F.col("range"), F.col("doc_id").asc_nulls_first(), "tie", "ids")
    return dealt.mapInArrow(run, _CHUNK)


def write(docs: DataFrame, file: str, path: str, end: int | None = 1, planes: str = "byte") -> None:
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", 4 * parts(spark))
    encoded = encode_documents(docs, file, end, bounds)
    chunks(encoded, encoder(file).width, planes).write.option("compression", "uncompressed").parquet(path)


def _documents(spark: SparkSession, path: str, schema: T.StructType, of) -> DataFrame:
    """Rows of the file's documents: doc_id, start, and of(ids as little-endian 32-bit bytes), a column a name. Chunks decode alone; a range's
    place among all ids comes from the sums of the ranges before it, of which there are at most 16384."""
    rows = spark.read.schema(_CHUNK).parquet(path)
    sums = rows.groupBy("range").agg(F.sum("n_ids").alias("n"))
    base = sums.select("range", (F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long").alias("base"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a chunk at a time
                r = b.slice(i, 1).to_pylist()[0]
                at = [*r["block_at"], len(r["blob"])]
                flat = b"".join(unpack_block(r["blob"][x:y]).tobytes() for x, y in zip(at, at[1:], strict=False))
                ends = np.cumsum(r["lengths"]).tolist()
                starts = [0, *ends[:-1]]
                place = r["base"] + r["first"]
                found = of([flat[4 * s : 4 * e] for s, e in zip(starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([place + s for s in starts], pa.int64()), *found], names=schema.names)

    return rows.join(F.broadcast(base), "range").mapInArrow(run, schema)


_PLACE = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType())]


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from a file: doc_id, start, ids as little-endian 32-bit bytes."""
    return _documents(spark, path, T.StructType([*_PLACE, T.StructField("ids", T.BinaryType())]), lambda ids: [pa.array(ids, pa.binary())])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from a file: doc_id, start, n_tokens, ids_crc32. The ids stay in the task that reads them."""
    schema = T.StructType([*_PLACE, T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return _documents(spark, path, schema, lambda ids: [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())])


def op6_token_file(spark: SparkSession, sf_dir: str, file: str | None = None, planes: str = "byte") -> DataFrame:
    import uuid

    import public_tokenizers

    from docloom.llm.common import shared_folder

    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), file or public_tokenizers.path("word_bpe_49k.json"), path, 1, planes)
    return digests(spark, path)
