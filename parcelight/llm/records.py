"""Token ids in length-delimited binary records, with an index file for shuffled reads.

Data file ``part-*.rec``: for each sequence

    uint64  payload bytes          uint32  masked checksum of those 8 bytes
    payload                        uint32  masked checksum of the payload

    payload = uint8 flags (1: has a doc_id, 2: ids are uint32, else uint16), int64 doc_id, ids

Index file ``part-*.idx``: the 8 bytes :data:`MAGIC`, then for each record uint64 place of its frame,
uint64 ids before it in the file, uint64 its ids.  All numbers are little-endian.  A checksum c (CRC-32)
is stored masked, as rotate-right(c, 15) + 0xa282ead8, so that a checksum of data that holds checksums stays
meaningful.  A file takes its final name only when it is whole, and only files named by the manifest
that Spark commits are read: a task that is lost or runs twice leaves nothing that counts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, take
from .tokens import tokenizer

MAGIC = b"PLIX0001"
#: Characters of a text by which rows of one doc_id are dealt to files.
HEAD = 64
MANIFEST = "part int, path string, n_records long, n_tokens long"
RECORD = "doc_id long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """One record; ``ids`` are little-endian uint32."""
    body = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = struct.pack("<Bq", (doc_id is not None) | 2 * wide, doc_id or 0) + body
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(raw: bytes) -> tuple[int | None, bytes]:
    """doc_id and uint32 ids of one record's bytes; ValueError if a checksum fails."""
    n, check = struct.unpack_from("<QI", raw)
    if masked(raw[:8]) != check or len(raw) != n + 16:
        raise ValueError("the length of a record is damaged")
    payload = raw[12 : 12 + n]
    if masked(payload) != struct.unpack_from("<I", raw, 12 + n)[0]:
        raise ValueError("the payload of a record is damaged")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = payload[9:]
    return doc_id if flags & 1 else None, ids if flags & 2 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class Records:
    """Random reads of one data file through its index."""

    def __init__(self, path: str):
        fs, p = _fs(path)
        with fs.open_input_stream(p[: -len(".rec")] + ".idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{path}: no index")
        self.index = np.frombuffer(raw[8:], "<u8").reshape(-1, 3)
        self.file = fs.open_input_file(p)
        self.size = self.file.size()

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, k: int) -> tuple[int | None, bytes]:
        end = int(self.index[k + 1, 0]) if k + 1 < len(self) else self.size
        at = int(self.index[k, 0])
        return unframe(self.file.read_at(end - at, at))

    def close(self) -> None:
        self.file.close()


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Encode every document, append ``end_id`` and write the ids in ascending doc_id order.

    Returns the manifest: part (ascending in doc_id), path, n_records, n_tokens.  Null text counts as
    empty, a null doc_id comes first, rows of one doc_id follow the order of their texts, over several files where they are many.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = tokenizer(tokenizer_path)
        wide = enc.lib.get_vocab_size(with_added_tokens=True) > 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, base = _fs(name)
        fs.create_dir(base.rpartition("/")[0], recursive=True)
        at = tokens = 0
        index: list[tuple[int, int, int]] = []
        with fs.open_output_stream(base + ".tmp") as out:
            for pdf in batches:
                for d, raw in zip(pdf["doc_id"].tolist(), enc.encode(pdf["text"].tolist()), strict=True):
                    raw += end
                    rec = frame(None if d == "" else int(d), raw, wide)
                    out.write(rec)
                    index.append((at, tokens, len(raw) // 4))
                    at, tokens = at + len(rec), tokens + len(raw) // 4
        if not index:
            fs.delete_file(base + ".tmp")
            return
        with fs.open_output_stream(base + ".idx") as out:
            out.write(MAGIC + np.array(index, "<u8").tobytes())
        fs.move(base + ".tmp", base + ".rec")
        yield pd.DataFrame({"part": [part], "path": [name + ".rec"], "n_records": [len(index)], "n_tokens": [tokens]})

    # doc_id travels as text to Python: a null among longs would turn them into floats
    rows = take(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # rows of one id, or of none, are dealt out by the head of their texts, which is in the order of the texts
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return stored(rows.mapInPandas(write, MANIFEST), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record: doc_id, start (ids of all records before it), n_tokens, ids (uint32).

    The manifest has one small row per file, so the driver may sum the files' ids before each.
    """
    rows, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["path"], before))
        before += r["n_tokens"]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"], strict=True):
                held = Records(path)
                for lo in range(0, len(held), 256):
                    some = [held[k] for k in range(lo, min(lo + 256, len(held)))]
                    idx = held.index[lo : lo + 256].astype("int64")
                    yield pd.DataFrame({"doc_id": pd.array([d for d, _ in some], dtype="Int64"), "start": idx[:, 1] + base, "n_tokens": idx[:, 2], "ids": [b for _, b in some]})
                held.close()

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInPandas(load, RECORD)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write to a new shared folder and read back from its files."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, tokenizer_path, new_path(spark, "records"), end_id))
