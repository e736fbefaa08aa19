"""Chunks as a table function: a document's elements stream through in order, and chunks come out with the metadata of what they hold. Nothing of a
document is collected; what is held is the chunk that is being filled.

    chunk_table.register(spark)
    spark.sql("SELECT * FROM chunks(TABLE(elements) PARTITION BY (doc_id) ORDER BY (element_index), 'doc_id', 512, 2)")

Elements have element_type, page_number and text beside the key; further columns are ignored. Blank elements are skipped, headings stand alone,
null types and pages are left out of the metadata, and a table without rows gives no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

from docloom.operators.chunking import HEADINGS, split_sentences


class Chunks:
    """One instance for each partition of the table, which is one document."""

    @staticmethod
    def analyze(elements: AnalyzeArgument, key: AnalyzeArgument, most: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not elements.isTable or not isinstance(elements.dataType, T.StructType):
            raise ValueError("chunks: the first argument is a table")
        fields = {f.name: f.dataType for f in elements.dataType.fields}
        lacks = sorted({key.value, "element_type", "page_number", "text"} - set(fields))
        if lacks:
            raise ValueError(f"chunks: the table has no {', '.join(lacks)}")
        if most.value < 1 or overlap.value < 0:
            raise ValueError("chunks: most is 1 at least, overlap 0 at least")
        out = [T.StructField(key.value, fields[key.value]), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())]
        return AnalyzeResult(T.StructType([*out, T.StructField("element_types", T.ArrayType(T.StringType())), T.StructField("pages", T.ArrayType(T.IntegerType()))]))

    def __init__(self):
        self.key, self.held, self.at = None, [], 0

    def eval(self, row: Row, key: str, most: int, overlap: int) -> Iterator[tuple]:
        self.key, text = row[key], row["text"] or ""
        if not text.strip():
            return
        of = row["element_type"], row["page_number"]
        if of[0] in HEADINGS:
            yield from self._chunk()
            self.held = [(text.strip(), *of)]
            yield from self._chunk()
            return
        for s in split_sentences(text):
            self.held.append((s, *of))
            if sum(len(h[0]) + 1 for h in self.held) - 1 >= most and len(self.held) > overlap + 1:
                last = self.held[-overlap:] if overlap else []
                yield from self._chunk()
                self.held = last

    def terminate(self) -> Iterator[tuple]:
        yield from self._chunk()

    def _chunk(self) -> Iterator[tuple]:
        if self.held:
            kinds, pages = (list(dict.fromkeys(h[i] for h in self.held if h[i] is not None)) for i in (1, 2))
            yield self.key, self.at, " ".join(h[0] for h in self.held), kinds, pages
            self.at, self.held = self.at + 1, []


def register(spark: SparkSession, name: str = "chunks") -> None:
    spark.udtf.register(name, F.udtf(Chunks))


def chunked(elements: DataFrame, key: str = "doc_id", order: str = "element_index", most: int = 512, overlap: int = 2) -> DataFrame:
    """key, chunk_index, content, element_types, pages."""
    return F.udtf(Chunks)(elements.asTable().partitionBy(key).orderBy(order), F.lit(key), F.lit(most), F.lit(overlap))
