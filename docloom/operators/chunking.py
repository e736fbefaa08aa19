"""Chunking. Order within a document is semantic, so a document is one row: its elements are an array, folded in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions import text as X
from docloom.sources.readers import dealt

HEADINGS = ("Title", "Heading", "Header", "SubHeading")
_END = re.compile(r"([.!?])\s+")


def split_sentences(text: str) -> list[str]:
    return [s for s in _END.sub("\\1\x01", text.strip()).split("\x01") if s]


def accumulate(elements: list[tuple[str, str]], most: int = 512, overlap: int = 2) -> list[str]:
    """elements: (type, text) in order. Blank ones are skipped, headings end a chunk and stand alone. Sentences are added until the chunk has
    `most` characters and more than overlap + 1 sentences; the next one begins with its last `overlap` sentences. What remains is a chunk."""
    out, held = [], []
    for kind, text in elements:
        if not (text or "").strip():
            continue
        if kind in HEADINGS:
            if held:
                out.append(" ".join(held))
            out.append(text.strip())
            held = []
            continue
        for s in split_sentences(text):
            held.append(s)
            if len(" ".join(held)) >= most and len(held) > overlap + 1:
                out.append(" ".join(held))
                held = held[-overlap:] if overlap else []
    if held:
        out.append(" ".join(held))
    return out


def merge_short(chunks: list[str], least: int = 20) -> list[str]:
    """While a chunk is shorter than `least`, the next one joins it."""
    out, held = [], None
    for c in chunks:
        held = c if held is None else f"{held} {c}"
        if len(held) >= least:
            out.append(held)
            held = None
    return out if held is None else [*out, held]


def split_long(chunk: str, most: int = 1000) -> list[str]:
    """Greedy by sentences, no overlap; a longer sentence stays whole."""
    if len(chunk) <= most:
        return [chunk]
    out, held = [], ""
    for s in split_sentences(chunk):
        if held and len(held) + 1 + len(s) > most:
            out.append(held)
            held = s
        else:
            held = f"{held} {s}" if held else s
    return [*out, held] if held else out


def _by_row(df: DataFrame, key: str, source: str, fold) -> DataFrame:
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    return df.select(key, source).mapInArrow(in_slices(lambda k, x: [(k, i, c) for i, c in enumerate(fold(x))], to_arrow_schema(schema)), schema)


def in_slices(rows, schema: pa.Schema, size: int = 64):
    """A function over Arrow batches: rows(key, value) gives a row's results. As Python objects stand only `size` rows and what they give."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                out = [r for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows(k, x)]
                columns = zip(*out, strict=True) if out else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 512, overlap: int = 2) -> DataFrame:
    """key, chunk_index, content; a text's lines are its elements."""
    return _by_row(docs, key, text, lambda t: accumulate([("NarrativeText", x) for x in (t or "").split("\n")], most, overlap))


def element_chunks(elements: DataFrame, key: str, order: str, kind: str, text: str, most: int = 512, overlap: int = 2) -> DataFrame:
    """From element rows: a document's elements come together once, in order."""
    docs = elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(kind, F.lit("")).alias("k"), F.coalesce(text, F.lit("")).alias("t")))).alias("elements"))
    return _by_row(docs, key, "elements", lambda es: accumulate([(e["k"], e["t"]) for e in es], most, overlap))


def cleaned_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Accumulate, merge short, split long, then drop gibberish."""

    def fold(t):
        merged = merge_short(accumulate([("NarrativeText", x) for x in (t or "").split("\n")]))
        return [p for c in merged for p in split_long(c)]

    return X.gibberish_dropped(_by_row(dealt(docs.select(key, text), key), key, text, fold), "content", "content")


def merged_short_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    return _by_row(docs, key, text, lambda t: merge_short((t or "").split("\n"), least))


def split_long_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000) -> DataFrame:
    return _by_row(docs, key, text, lambda t: split_long(t or "", most))


def sentence_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, overlap: int = 1) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(X.sentence_windows(F.col(text), size, overlap)).alias("chunk_index", "content"))


def paragraph_numbers(elements: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """paragraph: counted from 1 anew whenever the page changes, also back to an earlier one."""
    doc = Window.partitionBy(key).orderBy(order)
    turned = F.coalesce(~F.lag(page).over(doc).eqNullSafe(F.col(page)), F.lit(True)).cast("int")
    out = elements.withColumn("_turn", turned).withColumn("_run", F.sum("_turn").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("paragraph", F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))).drop("_turn", "_run")


def simulated_pages(elements: DataFrame, key: str, order: str, size: int = 20) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return elements.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / size).cast("int") + 1).withColumn("paragraph", (F.col("_n") % size + 1).cast("int")).drop("_n")


def merged_metadata(elements: DataFrame, chunk: str, order: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """A chunk's metadata from its elements: distinct values in first-seen order, first value that isn't empty."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *lists, *scalars)))
    g = elements.groupBy(chunk).agg(rows.alias("r"))
    many = [F.array_distinct(F.array_compact(F.col(f"r.{c}"))).alias(c) for c in lists]
    one = [F.get(F.filter(F.col(f"r.{c}"), lambda v: v.isNotNull() & (v.cast("string") != "")), F.lit(0)).alias(c) for c in scalars]
    return g.select(chunk, *many, *one)


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first row of each content: content_hash is the SHA-256 of the text."""
    h = df.withColumn("content_hash", F.sha2(F.col(text), 256))
    first = h.groupBy("content_hash").agg(F.min(key).alias(key))
    return h.join(first, ["content_hash", key], "left_semi")


def first_strategy(texts: dict, placeholder: str = "No text could be extracted."):
    """struct(strategy, content): the first strategy, as named in order, whose text isn't blank; else a placeholder."""
    out = F.struct(F.lit("placeholder").alias("strategy"), F.lit(placeholder).alias("content"))
    for name, text in reversed(texts.items()):
        out = F.when(F.trim(text) != "", F.struct(F.lit(name).alias("strategy"), text.alias("content"))).otherwise(out)
    return out


def needs_ocr(elements: DataFrame, key: str, text: str, corrupted, few: int = 5) -> DataFrame:
    """key, retry: no element with text, or fewer than `few` and one of them corrupted."""
    n, bad = F.sum((F.trim(text) != "").cast("int")), F.sum(corrupted.cast("int"))
    return elements.groupBy(key).agg(((n == 0) | ((n < few) & (bad > 0))).alias("retry"))
