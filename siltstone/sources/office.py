"""Spreadsheets and Word files, read from their zipped XML: nothing beyond the standard library on the workers.

Files come from Spark's binary reader, so they may lie in any store that Spark reads, and each is parsed in the task that reads it, row by
row. A file that isn't a readable archive, or whose XML is broken, gives one row with its ``error`` and no others; callers count or skip these.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import segment

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELLS, _PARTS = "sheet string, row int, cells array<string>", "n int, kind string, level int, text string"


def _parsed(spark: SparkSession, path: str, parse: Callable[[zipfile.ZipFile], Iterator[tuple]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows = [(file, *r, None) for r in parse(archive)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    rows = [(file, *[None] * len(names), f"{type(e).__name__}: {e}"[:200])]
                for at in range(0, len(rows), 4096):
                    yield pd.DataFrame(rows[at : at + 4096], columns=["path", *names, "error"]).astype({c: "Int32" for c in ("row", "n", "level") if c in names})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def _said(element: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter(tag))


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _cell(c: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _said(c, f"{_MAIN}t")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    return {"0": "False", "1": "True"}[v.text] if kind == "b" else v.text


def _sheets(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """The filled rows of all sheets in their order. Of merged cells the first has the value; numbers are as they are stored."""
    names = set(archive.namelist())
    shared = [_said(si, f"{_MAIN}t") for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(_LINK)]
        with archive.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
            at = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                at, cells = int(row.get("r", at + 1)), []
                for c in row.iter(f"{_MAIN}c"):
                    column = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (column - len(cells)) + [_cell(c, shared)]
                row.clear()
                if any(x is not None for x in cells):
                    yield sheet.get("name"), at, cells


def _words(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs with the level of their heading (0: none), and tables' rows with their cells joined by a pipe."""
    levels = {}
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_WORD}style"):
            name = style.find(f"{_WORD}name")
            found = re.fullmatch(r"heading ([1-9])", (name.get(f"{_WORD}val") or "").lower()) if name is not None else None
            levels[style.get(f"{_WORD}styleId")] = int(found[1]) if found else 0

    def text(p: ElementTree.Element) -> str:
        marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
        return "".join((e.text or "") if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter())

    body, n = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body"), 0
    for block in body if body is not None else ():
        if block.tag == f"{_WORD}p":
            style = block.find(f"{_WORD}pPr/{_WORD}pStyle")
            yield n, "paragraph", levels.get(style.get(f"{_WORD}val"), 0) if style is not None else 0, text(block)
            n += 1
        elif block.tag == f"{_WORD}tbl":
            for row in block.iter(f"{_WORD}tr"):
                yield n, "row", 0, " | ".join("\n".join(text(p) for p in cell.iter(f"{_WORD}p")) for cell in row.findall(f"{_WORD}tc"))
                n += 1


def spreadsheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Path, sheet, row (from 1), cells by column, error."""
    return _parsed(spark, path, _sheets, _CELLS)


def spreadsheets(spark: SparkSession, path: str) -> DataFrame:
    """The first two filled cells of each row of all sheets, as question and answer; zeros and false count as empty."""
    filled = F.filter("cells", lambda x: x.isNotNull() & ~x.isin("", "0", "False"))
    rows = spreadsheet_rows(spark, path).where("error IS NULL").withColumn("_f", filled).where(F.size("_f") >= 2)
    return rows.select(F.get("_f", F.lit(0)).alias("question"), F.get("_f", F.lit(1)).alias("answer"))


def document_parts(spark: SparkSession, path: str) -> DataFrame:
    """Path, n, kind (paragraph or row of a table), level of the heading, text, error."""
    return _parsed(spark, path, _words, _PARTS)


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs under their headings as questions and answers."""
    parts = document_parts(spark, path).where("error IS NULL AND kind = 'paragraph'")
    line = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text"))
    # A file is parsed and put together in one task as it is.
    whole = parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return segment.per_document(whole, lambda t: segment.markdown_questions(t), "question string, answer string", key="path").select("question", "answer")
