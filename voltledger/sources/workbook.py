"""Workbooks: a folder of Parquet or CSV tables with metadata (the form that scales), or .xlsx files (read on the executors; written, as small results, on the driver)."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger import schemas

META_SHEET, EMPTY = "_faturas_meta", "(sem dados)"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def ordered(sheets: dict) -> list[str]:
    return [s for s in schemas.SHEETS if s in sheets] + [s for s in sheets if s not in schemas.SHEETS]


def write_folder(sheets: dict[str, DataFrame], path: str, meta: dict | None = None, fmt: str = "parquet", partition_by: dict[str, list[str]] | None = None) -> None:
    """One table a sheet and ``_meta`` (JSON), written by the executors to any file system that Spark knows."""
    spark = next(iter(sheets.values())).sparkSession
    for name in ordered(sheets):
        writer = sheets[name].write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.save(f"{path}/{name}")
    body = {"sheets": ordered(sheets), "format": fmt, "meta": meta}
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def read_folder(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict | None]:
    body = json.loads(spark.read.text(f"{path}/_meta").first().value)
    reader = spark.read.format(body["format"])
    if body["format"] == "csv":
        reader = reader.option("header", True)
    return {s: reader.load(f"{path}/{s}") for s in body["sheets"]}, body["meta"]


def widths(df: DataFrame) -> dict[str, int]:
    """Characters of the widest text of each column, its heading included: one aggregate over all columns."""
    row = df.agg(*(F.max(F.length(F.col(schemas.quoted(c)).cast("string"))).alias(f"w{i}") for i, c in enumerate(df.columns))).first()
    return {c: max(len(c), row[i] or 0) for i, c in enumerate(df.columns)}


def _ref(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet_xml(rows, columns: list[int] = ()) -> str:
    """``columns``: their widths in characters."""
    out = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>']
    if columns:
        out.append(f'<cols>{"".join(f"""<col min="{i}" max="{i}" width="{w}" customWidth="1"/>""" for i, w in enumerate(columns, 1))}</cols>')
    out.append("<sheetData>")
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row, 1):
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{_ref(c)}{r}"><v>{v!r}</v></c>')
            else:
                text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
                cells.append(f'<c r="{_ref(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return "".join(out) + "</sheetData></worksheet>"


def write_xlsx(sheets: dict[str, DataFrame], path: str, meta: dict | None = None, max_rows: int = 1_000_000, widest: int = 50) -> None:
    """One file with all sheets and the metadata in a hidden one. For results that fit a workbook: more than ``max_rows`` rows are refused. Columns are as wide as their text, up to ``widest``."""
    names = ordered(sheets)
    bodies = []
    for n in names:
        rows = sheets[n].limit(max_rows + 1).toLocalIterator()
        head = sheets[n].columns
        first = next(rows, None)

        def every(first=first, rows=rows, head=head):
            yield [EMPTY] if first is None else head
            for i, r in enumerate([] if first is None else [first, *rows]):
                if i >= max_rows:
                    raise ValueError(f"{n} has more than {max_rows} rows: write a folder instead")
                yield list(r)

        bodies.append(_sheet_xml(every(), [min(w + 2, widest) for w in widths(sheets[n]).values()]))
    bodies.append(_sheet_xml([[json.dumps(meta, ensure_ascii=False)]]))
    tabs = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"{" state=" + chr(34) + "hidden" + chr(34) if n == META_SHEET else ""}/>' for i, n in enumerate([*names, META_SHEET], 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(bodies) + 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(bodies) + 1))
    top = '<?xml version="1.0" encoding="UTF-8"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{top}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{top}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{top}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, body in enumerate(bodies, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", body)


def _cells(row) -> list[tuple[int, str, str | None]]:
    """(column from 1, kind, text) of a row's cells that have a value."""
    out = []
    for c in row.iterfind("m:c", _NS):
        at = 0
        for ch in re.match("[A-Z]+", c.get("r"))[0]:
            at = at * 26 + ord(ch) - 64
        value = c.find("m:v", _NS)
        if c.get("t") == "inlineStr":
            out.append((at, "inline", "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))))
        elif value is not None:
            out.append((at, c.get("t") or "n", value.text))
    return out


def _parse(content: bytes, only: str | None, heads: bool) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of all sheets or one; ``heads``: first rows only. Row by row: what is held is one row and the shared texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = None
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for tab in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS):
            if only is not None and tab.get("name") != only:
                continue
            n = 0
            with z.open("xl/" + links[tab.get(_REL)].removeprefix("/xl/")) as xml:
                for _, row in ElementTree.iterparse(xml):
                    if row.tag != f"{{{_NS['m']}}}row":
                        continue
                    n += 1
                    found = {}
                    for at, kind, text in _cells(row):
                        if kind == "s":
                            if strings is None:
                                strings = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
                            text = strings[int(text)]
                        found[at] = text
                    yield tab.get("name"), n, [found.get(i) for i in range(1, max(found, default=0) + 1)]
                    row.clear()
                    if heads:
                        break
            if not n:
                yield tab.get("name"), 1, []


def xlsx_rows(spark: SparkSession, path: str, only: str | None = None, heads: bool = False) -> DataFrame:
    """path, sheet, n, cells array<string>: the rows of workbooks (one file, a folder or a pattern), parsed on the executors, a file a task."""

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                held = []
                for found in _parse(content.as_py(), only, heads):
                    held.append((name.as_py(), *found))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(("path", "sheet", "n", "cells"), r, strict=True)) for r in held], kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "sheet", "n", "cells"), r, strict=True)) for r in held], kind)

    kind = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("n", pa.int64()), ("cells", pa.list_(pa.string()))])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, sheet string, n bigint, cells array<string>")


def read_xlsx(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict | None]:
    """Every sheet with text columns (cast by ``schemas.conform``), and the metadata; bad metadata is none; a placeholder sheet is empty.

    Only headings and metadata come to the driver; rows keep their order within the one partition of a file."""
    meta, out = None, {}
    for r in xlsx_rows(spark, path, heads=True).collect():  # a row a sheet
        if r.sheet == META_SHEET:
            try:
                meta = json.loads(r.cells[0])
            except (ValueError, TypeError, IndexError):
                meta = None
            continue
        head = [str(h) for h in r.cells]
        if head in ([], [EMPTY]):
            out[r.sheet] = spark.createDataFrame([], schemas.schema(r.sheet) if r.sheet in schemas.SHEETS else "empty string")
            continue
        rows = xlsx_rows(spark, path, only=r.sheet).where("n > 1")
        out[r.sheet] = rows.select(*(F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(head)))
    return out, meta
