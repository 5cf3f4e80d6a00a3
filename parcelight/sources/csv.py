"""CSV scans and exports: encoding, delimiter, ragged rows, safe cells."""

from __future__ import annotations

import csv as _csv
import io
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import escape_cell
from .shared import stored

# Encodings that a file may have, and their other names.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk")
ALIASES = {"cp936": "gbk", "gb2312": "gbk", "utf8": "utf-8", "utf-8-bom": "utf-8-sig"}
DELIMITERS = ",\t;|"
PROBE = 64 * 1024
MAX_COLUMNS = 200


def detect_encoding(head: bytes) -> tuple[str | None, tuple[str, ...]]:
    """(encoding, choices): a BOM or strict UTF-8 decides, else the user has to choose."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig", ()
    try:
        head[:PROBE].decode("utf-8")
    except UnicodeDecodeError as e:
        if len(head) < PROBE or e.start < PROBE - 4:  # a character cut by the end of the probe is no error
            return None, ("gb18030", "gbk")
    return "utf-8", ()


def encoding(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in ENCODINGS:
        raise ValueError(f"no encoding {name}")
    return name


def sniff_delimiter(line: str) -> str:
    """The delimiter that stands most often outside quotes; the first of equals."""
    quoted, seen = False, Counter()
    for ch in line:
        quoted ^= ch == '"'
        if not quoted and ch in DELIMITERS:
            seen[ch] += 1
    return max(DELIMITERS, key=lambda d: (seen[d], -DELIMITERS.index(d)))


def clean_headers(names: list[str]) -> list[str]:
    out = [unicodedata.normalize("NFKC", n).strip() for n in names]
    if not out or any(not n for n in out):
        raise ValueError("HEADER_EMPTY")
    if len({n.casefold() for n in out}) < len(out):
        raise ValueError("HEADER_DUPLICATE")
    if len(out) > MAX_COLUMNS:
        raise ValueError("TOO_MANY_COLUMNS")
    return out


ROW = "row_number long, cells array<string>, code string"
#: A row's number is its file's place among the files by path, times this, plus its record's place in the file.
PER_FILE = 1 << 40
SPAN = "file long, block long, end_out boolean, n_out long, end_in boolean, n_in long, head binary"
PIECE = "row_number long, cells array<string>, code string, block long, text string"


@dataclass
class Scan:
    """rows: row_number and the columns as text.  issues: row_number, code, file, line.  files: ordinal, file."""

    rows: DataFrame
    issues: DataFrame
    files: DataFrame

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.rows, self.issues))

    def located(self, df: DataFrame) -> DataFrame:
        """``df`` (with row_number) and the file and line of each of its rows."""
        return located(df, self.files)


def located(df: DataFrame, files: DataFrame) -> DataFrame:
    at = df.withColumn("ordinal", F.shiftright("row_number", 40).cast("int")).withColumn("line", F.col("row_number").bitwiseAND(F.lit(PER_FILE - 1)))
    return at.join(files, "ordinal").drop("ordinal")


def after(line: str | bytes, inside: bool, sep: str | bytes) -> tuple[bool, int, int]:
    """Whether a quoted cell is open after ``line`` (without its line feed), how many records begin within it, after a
    carriage return, and where the last of them does.  A quote opens a cell only at the cell's start, and two within it are one."""
    quote, cr = ('"', "\r") if isinstance(line, str) else (b'"', b"\r")
    at, more, begun, last = 0, 0, 0, len(line) - 1
    if not inside and line[:1] == quote:
        inside, at = True, 1
    while True:
        if inside:
            q = line.find(quote, at)
            if q < 0:
                return True, more, begun
            if line[q + 1 : q + 2] == quote:
                at = q + 2
                continue
            inside, at = False, q + 1
        s, r = line.find(sep, at), line.find(cr, at)
        if r >= 0 and (s < 0 or r < s):
            if r == last:
                return False, more, begun
            more, at, begun = more + 1, r + 1, r + 1
        elif s >= 0:
            at = s + 1
        else:
            return False, more, begun
        if line[at : at + 1] == quote:
            inside, at = True, at + 1


def _special(lines: pa.Array) -> np.ndarray:
    """Places of lines with a quote, or with a carriage return before their end."""
    crs = pc.subtract(pc.count_substring(lines, "\r"), pc.cast(pc.ends_with(lines, "\r"), pa.int32()))
    return np.flatnonzero(pc.or_(pc.match_substring(lines, '"'), pc.greater(crs, 0)).to_numpy(zero_copy_only=False))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """Stretches of lines of one block: ((file, block), lines)."""
    for b in batches:
        keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), b.num_rows]):
            if hi > lo:
                yield (int(keys[0, lo]), int(keys[1, lo])), b.column(2).slice(lo, hi - lo)


def _span(sep: bytes):
    """Of each block, for either state at its start: the state at its end and how many records begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in itertools.groupby(_runs(batches), key=lambda x: x[0]):
            inside, count, head, size = [False, True], [0, 0], [], 0
            for _, lines in group:
                at = 0
                for i in [*_special(lines).tolist(), len(lines)]:
                    for k in (0, 1):
                        count[k] += 0 if inside[k] else i - at
                    if i < len(lines):
                        raw = lines[i].as_py()
                        for k in (0, 1):
                            count[k] += not inside[k]
                            inside[k], more, _ = after(raw, inside[k], sep)
                            count[k] += more
                    at = i + 1
                for x in lines if key[1] == 0 and size < PROBE else ():
                    head.append(x.as_py()[: PROBE - size])
                    size += len(head[-1]) + 1
                    if size >= PROBE:
                        break
            yield pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "end_out": inside[0], "n_out": count[0], "end_in": inside[1], "n_in": count[1], "head": b"\n".join(head)}], _arrow(SPAN))

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _records(text: str, sep: str) -> Iterator[list[str]]:
    return _csv.reader(io.StringIO(text, newline=""), delimiter=sep)


def _pieces(sep: str, enc: str, width: int, held: dict[tuple[int, int], tuple[bool, int]], files: dict[int, tuple[int, list[int] | None]]):
    """Records of each block as cells; of a record that goes on in the next block, or came from the one before, its text."""
    raw_sep = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        _csv.field_size_limit((1 << 31) - 1)

        def put(n: int, row: list[str]) -> None:
            if n > 1 and any(c.strip() for c in row):
                out.append(_cells(first + n, row, width, order))

        for key, group in itertools.groupby(_runs(batches), key=lambda x: x[0]):
            (inside, n), (ordinal, order), block = held[key], files[key[0]], key[1]
            first = ordinal * PER_FILE
            if block == 0 and order is None:
                out.append({"row_number": first + 1, "code": "HEADER_MISMATCH"})
            open_: list[bytes] = []
            carried = inside  # the open record began in an earlier block
            for _, lines in group:
                if order is None:
                    continue
                at = 0
                for i in [*_special(lines).tolist(), len(lines)]:
                    plain = lines.slice(at, i - at).to_pylist()
                    if inside:
                        open_ += plain
                    elif plain:
                        for row in _csv.reader([x.decode(enc) for x in plain], delimiter=sep):
                            n += 1
                            put(n, row)
                    if i < len(lines):
                        raw = lines[i].as_py()
                        n += not inside
                        inside, more, begun = after(raw, inside, raw_sep)
                        for cut, done in ((raw[:begun], more > 0), (raw[begun:], not inside)):
                            if cut or done:
                                open_.append(cut)
                            if done:
                                text = b"\n".join(open_).decode(enc) + "\n"
                                if carried:
                                    out.append({"row_number": first + n, "block": block, "text": text})
                                else:
                                    for j, row in enumerate(_records(text, sep)):
                                        put(n + j, row)
                                n, more, open_, carried = n + more, 0, [], False
                    at = i + 1
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, _arrow(PIECE))
                    out.clear()
            if open_:
                out.append({"row_number": first + n, "block": block, "text": b"\n".join(open_).decode(enc) + "\n"})
        if out:
            yield pa.RecordBatch.from_pylist(out, _arrow(PIECE))

    return run


def _cells(number: int, row: list[str], width: int, order: list[int]) -> dict:
    cells = (row + [""] * width)[:width]
    return {"row_number": number, "cells": [cells[i] for i in order], "code": "COLUMN_COUNT_MISMATCH" if len(row) != width else None}


@contextmanager
def _steady_splits(spark: SparkSession, block_bytes: int | None) -> Iterator[None]:
    """Both passes must cut files alike, also where executors come or go between them."""
    wanted = {"spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism)}
    if block_bytes:
        wanted["spark.sql.files.maxPartitionBytes"] = str(block_bytes)
    held = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _head(lines: DataFrame, first: str, enc: str | None) -> tuple[str, str, list[str]]:
    """Encoding, delimiter and header names by the first file's first lines."""
    rows = lines.where((F.col("path") == first) & (F.col("block") == 0)).select(F.substring("line", 1, PROBE).alias("line")).limit(100).collect()
    head = b"\n".join(bytes(r["line"]) for r in rows) + b"\n"
    enc = encoding(enc) if enc else detect_encoding(head[:PROBE])[0]
    if enc is None:
        raise ValueError("ENCODING_REQUIRED")
    if not rows or len(rows[0]["line"]) == PROBE:
        raise ValueError("HEADER_TOO_LONG")
    text = head[:PROBE].decode(enc, "ignore")
    sep = sniff_delimiter(text.partition("\n")[0])
    return enc, sep, clean_headers(next(_records(text, sep), []))


def scan(spark: SparkSession, path: str, enc: str | None = None, block_bytes: int | None = None) -> Scan:
    """One CSV file or a folder of files with one header.

    Rows that are short are padded, long ones cut, both with an issue; blank rows are skipped but counted.  Every file's
    header is checked: the same names in another order are put in order, other names make the file an issue
    (HEADER_MISMATCH) without rows.  A row's number is unique over all files and rises with the file's path and the row's place.

    Files are split into blocks of lines.  Whether a block begins within a quoted cell, and how many records stand before it, depends
    on all blocks before, so a first pass tells for either state at a block's start the state at its end and the records in it; these
    are chained by file, and the second pass reads each block from its true state.  Only a record that crosses blocks is put
    together after a shuffle.  The driver holds a number and a state for each block, and the files' names.  A block has at most
    ``block_bytes``, by default as Spark cuts files.
    """
    named_files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("_metadata.file_path").alias("file"))
    found = sorted((r["file"], r["id"]) for r in named_files.select("file", F.xxhash64("file").alias("id")).collect())
    if not found:
        raise ValueError("FILE_EMPTY")
    with _steady_splits(spark, block_bytes):
        m = F.col("_metadata")
        lines = spark.read.option("lineSep", "\n").text(path).select(m["file_path"].alias("path"), m["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))
        enc, sep, headers = _head(lines, found[0][0], enc)
        split = lines.select(F.xxhash64("path").alias("file"), "block", "line")
        spans = {(r["file"], r["block"]): r for r in split.mapInArrow(_span(sep.encode()), SPAN).collect()}
        held, files = {}, {}
        for ordinal, (_, file) in enumerate(found):
            names = [unicodedata.normalize("NFKC", x).strip().lstrip("\ufeff") for x in next(_records(bytes(spans[file, 0]["head"]).decode(enc, "ignore"), sep), [])]
            files[file] = (ordinal, [names.index(h) for h in headers] if sorted(names) == sorted(headers) else None)
        inside, before, last = False, 0, None
        for key in sorted(spans):
            if key[0] != last:
                inside, before, last = False, 0, key[0]
            held[key] = (inside, before)
            s = spans[key]
            inside, before = (s["end_in"], before + s["n_in"]) if inside else (s["end_out"], before + s["n_out"])
        pieces = stored(split.mapInArrow(_pieces(sep, enc, len(headers), held, files), PIECE), "csv")
    orders = {ordinal: order for ordinal, order in files.values()}
    width = len(headers)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _csv.field_size_limit((1 << 31) - 1)
        for pdf in batches:
            out = [
                _cells(number + j, row, width, orders[number // PER_FILE])
                for number, text in zip(pdf["row_number"].tolist(), pdf["text"], strict=True) for j, row in enumerate(_records(text, sep))
                if number % PER_FILE + j > 1 and any(c.strip() for c in row)
            ]
            yield pd.DataFrame(out, columns=["row_number", "cells", "code"])

    # a record that lies in several blocks, in their order
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    crossing = pieces.where("text is not null").groupBy("row_number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    cells = pieces.where("text is null").select("row_number", "cells", "code").unionByName(crossing.mapInPandas(whole, ROW))
    file_table = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(found)], "ordinal int, file string")
    issues = located(cells.where("code is not null").select("row_number", "code"), file_table)
    return Scan(named(cells, headers), issues.select("row_number", "code", "file", "line"), file_table)


def named(cells: DataFrame, headers: list[str]) -> DataFrame:
    """Parsed lines as rows under their headers."""
    return cells.where("cells is not null").select("row_number", *(F.col("cells")[i].alias(h) for i, h in enumerate(headers)))


def line(*cells: Column | str) -> Column:
    """One CSV line of guarded, quoted cells."""
    text = [F.coalesce(escape_cell(c), F.lit("")) for c in cells]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(t, '"', '""'), F.lit('"'))).otherwise(t) for t in text]
    return F.concat_ws(",", *quoted)


def write(df: DataFrame, path: str) -> None:
    """A folder of CSV parts (UTF-8 with BOM, CRLF lines), each with the header, every cell guarded against spreadsheet formulas.

    Lines are built here, as Spark's CSV writer would turn a line feed within a cell into its own line end.
    """
    head = F.lit("\ufeff" + ",".join(df.columns))
    # the first row of a partition, which becomes a part, brings the header with it
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text = df.select(line(*(F.col(f"`{c}`") for c in df.columns)).alias("line"), first.alias("first"))
    text.select(F.explode(F.when(F.col("first"), F.array(head, F.col("line"))).otherwise(F.array("line")))).write.option("lineSep", "\r\n").text(path)


def export_bytes(df: DataFrame, most: int = 100_000) -> bytes:
    """One small CSV document: BOM, CRLF lines.  More than ``most`` rows are an error, not a cut."""
    rows = df.select(line(*(F.col(f"`{c}`") for c in df.columns)).alias("line")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for one document; use write()")
    return ("\ufeff" + "".join(x + "\r\n" for x in [",".join(df.columns), *(r["line"] for r in rows)])).encode()
