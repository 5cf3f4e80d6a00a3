"""URL filters over a sorted digest array.

The rule list is kept as one array of 64-bit xxhash keys in ascending order, with offsets into the
stored rule strings.  Executors map the array into memory and probe it by vectorised binary search
with the digests of every (host suffix, path prefix) that a rule could have; a digest that is found is
confirmed against the stored string, so a collision cannot give a verdict.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take

MAGIC = b"PLUF0001"


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"))


def build_index(rules: Iterable[tuple[str, str]], path: str) -> None:
    """Write the array for ``rules``, pairs of verdict ("block" or "allow") and "host/path".

    Layout: magic, number of rules n, bytes of text; n uint64 digests in order; n+1 uint64 offsets of the
    strings; n bytes with 1 for block; the lengths that occur as path and as host labels, then the strings.
    A rule given twice keeps its last verdict.
    """
    last = {r: v for v, r in rules}
    rows = sorted((digest(r), r, v) for r, v in last.items())
    text = [r.encode("utf-8", "surrogatepass") for _, r, _ in rows]
    lengths = sorted({len(r) - len(r.partition("/")[0]) for _, r, _ in rows})
    labels = sorted({r.partition("/")[0].count(".") + 1 for _, r, _ in rows})
    ends = np.concatenate(([0], np.cumsum([len(t) for t in text], dtype="<u8"))).astype("<u8")
    with open(path, "wb") as f:
        f.write(MAGIC + np.array([len(rows), len(lengths), len(labels)], "<u8").tobytes())
        f.write(np.array([d for d, _, _ in rows], "<u8").tobytes())
        f.write(ends.tobytes())
        f.write(np.array(lengths + labels, "<u8").tobytes())
        f.write(np.array([v == "block" for _, _, v in rows], np.uint8).tobytes())
        f.write(b"".join(text))


class UrlIndex:
    """The array of :func:`build_index`, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{path}: not a rule array")
        n, k, m = raw[8:32].view("<u8").tolist()
        at = 32
        self.digests, at = raw[at : at + 8 * n].view("<u8"), at + 8 * n
        self.ends, at = raw[at : at + 8 * (n + 1)].view("<u8"), at + 8 * (n + 1)
        self.path_lengths, at = raw[at : at + 8 * k].view("<u8").tolist(), at + 8 * k
        self.label_counts, at = raw[at : at + 8 * m].view("<u8").tolist(), at + 8 * m
        self.block, at = raw[at : at + n], at + n
        self.text = raw[at:]

    def rule(self, k: int) -> str:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes().decode("utf-8", "surrogatepass")

    def suffixes(self, host: str) -> list[str]:
        """The host's ends of as many labels as some rule has: no other can fit."""
        out, at, labels = [], len(host), 0
        for n in self.label_counts:
            while labels < n and at >= 0:
                at, labels = host.rfind(".", 0, at), labels + 1
            if labels < n:
                break
            out.append(host[at + 1 :])
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Rule and verdict for each URL, None where no rule fits; the longest rule wins."""
        rows: list[int] = []
        texts: list[str] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffixes = self.suffixes(host)
            for n in self.path_lengths:
                if n <= len(path):
                    for s in suffixes:
                        rows.append(i)
                        texts.append(s + path[:n])
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        if not texts or not len(self.digests):
            return rules, verdicts
        keys = np.fromiter(map(digest, texts), "<u8", len(texts))
        place = np.searchsorted(self.digests, keys)
        hit = (place < len(self.digests)) & (self.digests[np.minimum(place, len(self.digests) - 1)] == keys)
        for j in np.flatnonzero(hit).tolist():
            k = int(place[j])
            while k < len(self.digests) and self.digests[k] == keys[j]:  # equal digests stand together
                if self.rule(k) == texts[j]:
                    i = rows[j]
                    if rules[i] is None or len(texts[j]) > len(rules[i]):
                        rules[i], verdicts[i] = texts[j], "block" if self.block[k] else "allow"
                    break
                k += 1
        return rules, verdicts


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict for every row.

    A rule fits its host and all subdomains if the path starts with the rule's.  Without a rule the
    verdict is ``default``: a URL that the array does not list passes.  Null URLs, and those without
    ``://``, have an empty host and path.  The array goes to executors as a file of the session.
    """
    spark = pages.sparkSession
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp()
    build_index(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = UrlIndex(SparkFiles.get(name))
        for pdf in batches:
            rule, verdict = index.judge(pdf["host"].tolist(), pdf["path"].tolist())
            yield pdf.assign(rule=pd.Series(rule, index=pdf.index, dtype=object), verdict=pd.Series([v or default for v in verdict], index=pdf.index, dtype=object))

    url = F.col("url")
    rows = take(pages, "page_id", "url").select(F.col("page_id").cast("string").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"))
    out = rows.mapInPandas(judge, "page_id string, url string, host string, path string, rule string, verdict string")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
