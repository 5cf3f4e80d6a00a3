"""XLSX sheets through the standard library: safety checks, sheet list, typed cells."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .csv import PER_FILE, ROW, Scan, clean_headers, located, named

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
MAX_RATIO, MAX_BYTES = 100, 10 * 1024 * 1024
# Number formats that the file format reserves for dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def check(raw: bytes) -> zipfile.ZipFile:
    """An opened workbook, or ValueError with what is unsafe about it."""
    if len(raw) > MAX_BYTES:
        raise ValueError("FILE_TOO_LARGE")
    if raw[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError("ENCRYPTED_OR_LEGACY")
    if raw[:2] != b"PK":
        raise ValueError("NOT_A_WORKBOOK")
    z = zipfile.ZipFile(io.BytesIO(raw))
    for i in z.infolist():
        parts = i.filename.replace("\\", "/").split("/")
        if ".." in parts or i.filename.startswith("/") or ":" in parts[0]:
            raise ValueError("PATH_TRAVERSAL")
        if i.flag_bits & 1:
            raise ValueError("ENCRYPTED_OR_LEGACY")
        if i.file_size > MAX_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20:
            raise ValueError("ZIP_BOMB")
        if i.filename.lower().endswith("vbaproject.bin"):
            raise ValueError("MACROS")
        if "externallinks/" in i.filename.lower():
            raise ValueError("EXTERNAL_LINKS")
    if "xl/workbook.xml" not in z.namelist():
        raise ValueError("NOT_A_WORKBOOK")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.namelist():
        return None
    raw = z.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("XML_ENTITIES")
    return ET.fromstring(raw)


def sheets(raw: bytes) -> list[tuple[str, bool]]:
    """(name, visible) in order."""
    book = _xml(check(raw), "xl/workbook.xml")
    return [(s.get("name", ""), s.get("state", "visible") == "visible") for s in book.iterfind("m:sheets/m:sheet", NS)]


def _date(serial: float, since_1904: bool) -> str:
    day = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
    return (day + dt.timedelta(seconds=round(serial * 86400))).isoformat(sep=" ")


def read(raw: bytes, sheet: str | None = None) -> tuple[list[str], list[tuple[int, list[str | None]]], list[tuple[int, str]]]:
    """(headers, rows with their numbers, issues).  Formulas and error cells are null with an issue; dates are ISO
    text; a format of zeros keeps leading zeros."""
    z = check(raw)
    book = _xml(z, "xl/workbook.xml")
    rels = {r.get("Id"): r.get("Target", "") for r in _xml(z, "xl/_rels/workbook.xml.rels").iter(_REL)}
    listed = list(book.iterfind("m:sheets/m:sheet", NS))
    chosen = next((s for s in listed if sheet is None or s.get("name") == sheet), None)
    if chosen is None:
        raise ValueError("SHEET_NOT_FOUND")
    target = rels[chosen.get(f"{{{NS['r']}}}id")].lstrip("/")
    root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
    props = book.find("m:workbookPr", NS)
    since_1904 = props is not None and props.get("date1904") in ("1", "true")
    shared = _xml(z, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in shared.iterfind("m:si", NS)] if shared is not None else []
    styles = _xml(z, "xl/styles.xml")
    formats: list[int] = []
    custom: dict[int, str] = {}
    if styles is not None:
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iterfind("m:numFmts/m:numFmt", NS)}
        formats = [int(x.get("numFmtId", "0")) for x in styles.iterfind("m:cellXfs/m:xf", NS)]
    rows, issues = [], [(0, "HIDDEN_SHEET")] if chosen.get("state", "visible") != "visible" else []
    for row in root.iterfind("m:sheetData/m:row", NS):
        number, cells = int(row.get("r", len(rows) + 1)), {}
        for c in row.iterfind("m:c", NS):
            ref = re.match("[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for ch in ref:
                at = at * 26 + ord(ch) - 64
            kind, v = c.get("t", "n"), c.find("m:v", NS)
            text = v.text if v is not None else None
            if c.find("m:f", NS) is not None:
                issues.append((number, "FORMULA_CELL"))
                value = None
            elif kind == "e":
                issues.append((number, "ERROR_CELL"))
                value = None
            elif kind == "s":
                value = strings[int(text)] if text is not None else None
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif kind == "b":
                value = "true" if text == "1" else "false"
            elif text is None or kind != "n":
                value = text
            else:
                code = formats[int(c.get("s", "0"))] if formats else 0
                pattern = custom.get(code, "")
                if code in DATE_FORMATS or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", pattern), re.I):
                    value = _date(float(text), since_1904)
                elif re.fullmatch("0+", pattern):
                    value = text.split(".")[0].zfill(len(pattern))
                else:
                    value = text
            cells[at - 1] = value
        rows.append((number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
    if not rows:
        raise ValueError("HEADER_EMPTY")
    headers = clean_headers([x or "" for x in rows[0][1]])
    width = len(headers)
    body = [(n, (r + [None] * width)[:width]) for n, r in rows[1:] if any(x not in (None, "") for x in r)]
    return headers, body, issues


def scan(spark: SparkSession, path: str, sheet: str | None = None) -> Scan:
    """Rows, issues and files of one workbook or a folder of workbooks with one header; :data:`MAX_BYTES` bounds each."""
    return scan_files(spark.read.format("binaryFile").load(path), sheet)


def scan_files(files: DataFrame, sheet: str | None = None) -> Scan:
    """Rows, issues and files of the workbooks in ``files`` (path, content), each parsed by one task.

    A row's number is unique over all of them, as of CSV files.  The first by path gives the header.  A workbook with other names, or an unsafe one, gives an issue and no rows.
    """
    first = files.orderBy("path").select("content").first()
    if first is None:
        raise ValueError("FILE_EMPTY")
    ordinals = {r["path"]: i for i, r in enumerate(files.select("path").orderBy("path").collect())}  # names alone
    headers = read(bytes(first["content"]), sheet)[0]

    def lines(raw: bytes) -> Iterator[tuple[int, list[str | None] | None, str | None]]:
        try:
            names, rows, issues = read(raw, sheet)
        except ValueError as e:
            yield 0, None, str(e)
            return
        if sorted(names) != sorted(headers):
            yield 1, None, "HEADER_MISMATCH"
            return
        order = [names.index(h) for h in headers]
        for n, cells in rows:
            yield n, [cells[i] for i in order], None
        for n, code in issues:
            yield n, None, code

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                found = [(ordinals[path] * PER_FILE + n, cells, code) for n, cells, code in lines(bytes(raw))]
                yield pd.DataFrame(found, columns=["row_number", "cells", "code"])

    cells = files.select("path", "content").mapInPandas(parse, ROW)
    file_table = files.sparkSession.createDataFrame([(i, p) for p, i in ordinals.items()], "ordinal int, file string")
    issues = located(cells.where("code is not null").select("row_number", "code"), file_table)
    return Scan(named(cells, headers), issues.select("row_number", "code", "file", "line"), file_table)


# The kinds of file that an import takes, and the media types they come with.
MEDIA = {
    "csv": ("text/csv", "application/csv", "application/vnd.ms-excel", "text/plain", "application/octet-stream"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip", "application/octet-stream"),
}


def source_kind(name: str, head: bytes, media: str | None = None) -> str:
    """``csv`` or ``xlsx`` by extension, or ValueError where the media type or the first bytes say otherwise."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind not in MEDIA:
        raise ValueError("EXTENSION_NOT_ALLOWED")
    if media and media.split(";")[0].strip().lower() not in MEDIA[kind]:
        raise ValueError("MEDIA_TYPE_NOT_ALLOWED")
    if kind == "xlsx" and head[:2] != b"PK" or kind == "csv" and (head[:2] == b"PK" or head[:4] == b"\xd0\xcf\x11\xe0" or b"\0" in head):
        raise ValueError("CONTENT_MISMATCH")
    return kind
