"""Readers and writers of files: JSON lists, strict JSON lines, office documents, HTML tables."""

from __future__ import annotations

import html as entities
import io
import json
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT_LIST = "type string, text string, text_level int, page_idx int, bbox array<double>, table_body string, table_caption array<string>, table_footnote array<string>, image_caption array<string>, image_footnote array<string>, img_path string"


def content_list(spark: SparkSession, path: str) -> DataFrame:
    """A parser's list of page items with an explicit schema; ``path`` may name many files."""
    return spark.read.schema(CONTENT_LIST).json(path, multiLine=True)


def json_problem(line: str | None) -> str | None:
    """Why a line isn't strict JSON: repeated keys, NaN and infinities are errors too."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name: str):
        raise ValueError(f"{name} is not allowed")

    def number(text: str) -> float:
        if math.isinf(value := float(text)):
            raise ValueError("number out of range")
        return value

    try:
        json.loads(line or "", object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except ValueError as error:
        return str(error)
    return None


@F.pandas_udf(T.StringType())
def _problems(lines: pd.Series) -> pd.Series:
    return lines.map(json_problem)


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(value, record, problem): every line, parsed, with what is wrong with it; records that don't fit the schema are wrong too."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.withColumn("problem", _problems("value")).withColumn("record", F.from_json("value", schema))
    misfit = F.to_json("record") == "{}"
    return rows.withColumn("problem", F.coalesce("problem", F.when(misfit, "no field of the schema")))


def canonical_json(df: DataFrame) -> DataFrame:
    """(value): each row as compact JSON with its fields in alphabetical order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "path string, kind string, place string, text string"


def _docx(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for i, block in enumerate(body):
        texts = block.iter(f"{W}tc") if block.tag == f"{W}tbl" else [block]
        for j, part in enumerate(texts):
            yield f"{'table' if block.tag == f'{W}tbl' else 'paragraph'} {i}.{j}", "".join(t.text or "" for t in part.iter(f"{W}t"))


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    for name in sorted(names, key=lambda n: int(re.findall(r"\d+", n)[0])):
        for j, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{A}p")):
            yield f"{name.split('/')[-1][:-4]} {j}", "".join(t.text or "" for t in p.iter(f"{A}t"))


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for c in ElementTree.fromstring(z.read(name)).iter(f"{S}c"):
            if c.get("t") == "s" and (v := c.find(f"{S}v")) is not None:
                yield f"{name.split('/')[-1][:-4]} {c.get('r')}", shared[int(v.text)]
            elif c.get("t") == "inlineStr":
                yield f"{name.split('/')[-1][:-4]} {c.get('r')}", "".join(t.text or "" for t in c.iter(f"{S}t"))


def office_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, place, text): texts of docx, pptx and xlsx files with where they stand; empty ones are left out.

    Files are read by Spark and dealt to tasks; a task holds one file at a time.
    """
    files = spark.read.format("binaryFile").load(path).where("lower(path) rlike '[.](docx|pptx|xlsx)$'").select("path", "content")
    readers = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                kind = name.rsplit(".", 1)[-1].lower()
                rows = [(name, kind, place, text.strip()) for place, text in readers[kind](zipfile.ZipFile(io.BytesIO(content))) if text.strip()]
                yield pd.DataFrame(rows, columns=["path", "kind", "place", "text"])

    return files.mapInPandas(run, OFFICE)


def distinct_cells(texts: DataFrame) -> DataFrame:
    """The first place of every distinct text of a file."""
    return texts.groupBy("path", "text").agg(F.min("place").alias("place"))


ROW = re.compile(r"<tr\b[^>]*>", re.I)
CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dhr]\s*>|</table\s*>|\Z)", re.I | re.S)
SPAN = re.compile(r"\b(col|row)span\s*=\s*[\"']?\s*([1-9][0-9]*)", re.I)
BREAK, TAG = re.compile(r"<br\b[^>]*>", re.I), re.compile(r"<[^>]*>")


def cells_of(row: str) -> list[tuple[str, int, int]]:
    """(text, columns, rows) of the cells between two row tags."""
    out = []
    for attributes, inner in CELL.findall(row):
        span = {kind.lower(): int(n) for kind, n in SPAN.findall(attributes)}
        text = entities.unescape(TAG.sub("", BREAK.sub("\n", inner))).strip()
        out.append((text, span.get("col", 1), span.get("row", 1)))
    return out


def table_grid(html: str | None) -> list[list[str]]:
    """Tables as rows of equal meaning: a spanning cell's text stands at its upper left, the rest of its area is empty."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, cells in enumerate(map(cells_of, ROW.split(html or "")[1:])):
        row: dict[int, str] = {}
        col = 0
        for text, wide, tall in cells:
            while (r, col) in taken:
                col += 1
            row[col] = text
            taken |= {(r + i, col + j) for i in range(tall) for j in range(wide)}
            col += wide
        width = 1 + max((c for i, c in taken if i == r), default=-1)
        line = [row.get(c, "") for c in range(width)]
        if any(line):
            out.append(line)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_grids(html: pd.Series) -> pd.Series:
    """The grid of each page's tables."""
    return html.map(table_grid)


def rectangular(grid: Column) -> Column:
    """Whether all rows of a grid have the same number of cells."""
    return F.size(F.array_distinct(F.transform(grid, F.size))) <= 1
