"""DOCX and XLSX files as rows. Files are read by Spark's binary reader, so any store that Spark reads will do, and a task streams through the XML
of one file at a time.

Defined cases: a file that isn't a zip archive, lacks the parts that a document of its kind has, or breaks off gives what came before the fault and a
row with the error; empty paragraphs and rows count in positions but give no element; several runs of a paragraph are one text, tabs and line
breaks in it included; a column without a header is named by its letters; a header that repeats gets its letters added; an empty folder gives no
rows (its path must exist).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PARAGRAPHS_A_PAGE = 20

# The name spaces of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

_FAULTS = (zipfile.BadZipFile, KeyError, ParseError, EOFError, NotImplementedError, ValueError, IndexError, OSError)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def _read(files: DataFrame, parse, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                        for row in parse(archive):
                            rows.append((file, *row, None))
                            if len(rows) >= 1000:
                                yield _batch(rows, names, kinds)
                                rows = []
                except _FAULTS as e:
                    rows.append((file, *([None] * (len(names) - 2)), f"{type(e).__name__}: {e}"))
                if rows:
                    yield _batch(rows, names, kinds)

    return files.mapInArrow(run, schema)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def paragraphs(archive: zipfile.ZipFile) -> Iterator[tuple[int, int, str, str]]:
    """(index, page, kind, text) of the body's paragraphs that hold text, tables' paragraphs included."""
    with archive.open("word/document.xml") as xml:
        index, kind, text, depth = -1, "NarrativeText", [], 0
        for event, node in iterparse(xml, ("start", "end")):
            if event == "start":
                if node.tag == _W + "p":
                    depth += 1
                    if depth == 1:
                        index, kind, text = index + 1, "NarrativeText", []
                continue
            if node.tag == _W + "pStyle" and depth == 1:
                style = (node.get(_W + "val") or "").lower()
                kind = "Title" if style.startswith(("heading", "title")) else "ListItem" if style.startswith("list") else "NarrativeText"
            elif node.tag == _W + "t":
                text.append(node.text or "")
            elif node.tag == _W + "tab":
                text.append("\t")
            elif node.tag in (_W + "br", _W + "cr"):
                text.append("\n")
            elif node.tag == _W + "p":
                depth -= 1
                whole = "".join(text).strip()
                if depth == 0 and whole:
                    yield index, index // PARAGRAPHS_A_PAGE + 1, kind, whole
                node.clear()


def docx(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """file, element_index, page_number (20 paragraphs each), element_type, text, error."""
    schema = "file string, element_index int, page_number int, element_type string, text string, error string"
    return _read(_files(spark, path, glob), paragraphs, schema, ["file", "element_index", "page_number", "element_type", "text", "error"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()])


def _column(reference: str) -> str:
    return re.match("[A-Z]*", reference or "").group()


def _number(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out = []
    with archive.open("xl/sharedStrings.xml") as xml:
        text = []
        for _, node in iterparse(xml):
            if node.tag == _S + "t":
                text.append(node.text or "")
            elif node.tag == _S + "rPh":  # a reading aid, no text
                text = text[: len(text) - len(node.findall(_S + "t"))]
            elif node.tag == _S + "si":
                out.append("".join(text))
                text = []
                node.clear()
    return out


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) in the workbook's order."""
    with archive.open("xl/_rels/workbook.xml.rels") as xml:
        targets = {n.get("Id"): n.get("Target") for _, n in iterparse(xml) if n.tag.endswith("}Relationship")}
    with archive.open("xl/workbook.xml") as xml:
        names = [(n.get("name"), targets[n.get(_R + "id")]) for _, n in iterparse(xml) if n.tag == _S + "sheet"]
    return [(name, target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))) for name, target in names]


def cells(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, {header: value}) of the rows below each sheet's first row that holds anything."""
    words = _shared(archive)
    for name, member in _sheets(archive):
        header, row_number = None, 0
        with archive.open(member) as xml:
            held: dict[str, str] = {}
            at = 0
            for event, node in iterparse(xml, ("start", "end")):
                if event == "start":
                    if node.tag == _S + "row":
                        row_number = int(node.get("r") or row_number + 1)
                        held, at = {}, 0
                    continue
                if node.tag == _S + "c":
                    at = _number(_column(node.get("r"))) or at + 1
                    value = node.find(_S + "v")
                    kind = node.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in node.iter(_S + "t"))
                    elif value is None or value.text is None:
                        text = None
                    else:
                        text = words[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text, value.text) if kind == "b" else value.text
                    if text is not None:
                        held[_letters(at)] = text
                elif node.tag == _S + "row":
                    if held and header is None:
                        header = {}
                        for column, title in held.items():
                            header[column] = f"{title} {column}" if title in header.values() else title
                    elif held:
                        yield name, row_number, {header.get(c, c): v for c, v in held.items()}
                    node.clear()


def xlsx(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """file, sheet, row_number, cells (by the sheet's header), error."""
    schema = "file string, sheet string, row_number int, cells map<string,string>, error string"
    kinds = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]

    def parse(archive):
        for sheet, n, held in cells(archive):
            yield sheet, n, list(held.items())

    return _read(_files(spark, path, glob), parse, schema, ["file", "sheet", "row_number", "cells", "error"], kinds)
