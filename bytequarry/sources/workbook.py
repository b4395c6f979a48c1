"""Workbooks (zipped spreadsheets) read on the executors, whatever store they are in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet int, name string, row int, cells array<string>, fault string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def column_number(reference: str) -> int:
    """The column of a cell name, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_sheets(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet, its name, row, cells as text) of every row that is not empty; a sheet is read row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = set(z.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        for number, sheet in enumerate(sheets):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with z.open(part) as f:
                at = -1
                for _, row in ElementTree.iterparse(f):
                    if _local(row.tag) != "row":
                        continue
                    at = int(row.get("r", at + 2)) - 1
                    cells: dict[int, str] = {}
                    for cell in row:
                        column = column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                        value = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
                        kind = cell.get("t", "n")
                        if kind == "s":
                            value = shared[int(value)] if value else ""
                        elif kind == "inlineStr":
                            value = _text(cell)
                        elif kind == "b":
                            value = "True" if value == "1" else "False"
                        cells[column] = value
                    if cells:
                        yield number, sheet.get("name", ""), at, [cells.get(i, "") for i in range(max(cells) + 1)]
                    row.clear()


def scan_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every sheet of the workbooks at ``path`` (a file, a folder or a pattern), in the order of ``path, sheet, row``.

    A workbook that cannot be read is one row with its ``fault``; its bytes go to one task,
    and rows leave it one after the other.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CELLS.split(", ")]
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for found in read_sheets(content):
                        rows.append((name, *found, ""))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, IndexError) as e:
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
                out = pd.DataFrame(rows, columns=columns)
                for c in ("sheet", "row"):
                    out[c] = pd.array(out[c], dtype="Int32")
                yield out

    return files.mapInPandas(run, CELLS)


def scan_table(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """One sheet of a workbook as columns of text named by its first row (which comes to the driver); blanks are ''."""
    rows = scan_workbook(spark, path)
    if bad := rows.where("fault <> ''").select("path", "fault").first():
        raise ValueError(f"{bad['path']}: {bad['fault']}")
    own = rows.where(F.col("sheet") == sheet)
    head = own.groupBy().agg(F.min_by("cells", "row").alias("cells"), F.min("row").alias("row")).first()
    names: list[str] = []
    for i, c in enumerate(head["cells"] or []):
        plain = c.strip() or f"column {i + 1}"
        names.append(plain if plain not in names else f"{plain}.{i + 1}")
    return own.where(F.col("row") > (head["row"] or 0)).select(*[F.coalesce(F.get("cells", i), F.lit("")).alias(n) for i, n in enumerate(names)])
