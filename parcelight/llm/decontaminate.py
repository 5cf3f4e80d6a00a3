"""Benchmark decontamination as a prefix-filtered set join with exact windows.

Every item is cut into windows of ``width`` words (a shorter item is one window).  To occur in a
document a window needs all its words, so the overlap it needs is its size and the necessary prefix
is one word: its rarest by the counts over all documents.  The join runs on these prefix words.  A
hit of the word at place p of a document, standing at offset k of the window, fixes where the
window would lie: it must begin at 0 or later and end within the document (length and position
bounds), and is then compared word by word.

The benchmark's windows are dealt to blocks of bounded size; each block's index is broadcast alone, so what
an executor holds does not grow with the benchmark, and every block sees all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotated, position, positional, restored, stored, take

# ASCII digits, letters (upper case as lower) and all bytes of other characters form words.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the longest runs of [0-9a-z] and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _word_counts(docs: DataFrame, vocabulary: DataFrame) -> dict[bytes, int]:
    """How often each word of one block's vocabulary occurs in all documents."""
    wanted = {bytes(r["word"]) for r in vocabulary.collect()}
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                total.update(filter(held.value.__contains__, words(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    found = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


def _index(items: list[tuple[str, str | None]], width: int, counts: dict[bytes, int]) -> dict[bytes, list[tuple[int, int, tuple[bytes, ...]]]]:
    """Prefix word to (item number, offset of the word, window)."""
    out: dict[bytes, list[tuple[int, int, tuple[bytes, ...]]]] = {}
    for number, (_, text) in enumerate(items):
        w = words(text)
        m = min(width, len(w))
        for window in {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else ():
            k = min(range(m), key=lambda i: (counts.get(window[i], 0), window[i], i))
            if all(x in counts for x in window):  # a word that no document has: no document has the window
                out.setdefault(window[k], []).append((number, k, window))
    return out


def overlap(text: str | None, index: dict[bytes, list[tuple[int, int, tuple[bytes, ...]]]]) -> tuple[int, list[int], list[int], list[int]]:
    """Words of a text, item numbers that occur, and hit stretches as starts and ends (words, merged)."""
    w = words(text)
    n, found, stretches = len(w), set(), set()
    for p, x in enumerate(w) if not index.keys().isdisjoint(w) else ():
        for number, k, window in index.get(x, ()):
            a = p - k
            if a >= 0 and a + len(window) <= n and tuple(w[a : a + len(window)]) == window:
                found.add(number)
                stretches.add((a, a + len(window)))
    starts, ends = [], []
    for a, b in sorted(stretches):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    return n, sorted(found), starts, ends


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, block_chars: int = 8_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (distinct item ids as strings, sorted),
    hit_starts and hit_ends (word places of the hit stretches), contaminated (n_hit > 0 and
    share * n_hit >= n_words).

    Null texts have no words on either side; null item ids count as the string "null"; items of
    equal id are one; repeated documents keep a row each.  ``block_chars`` bounds the text of the items
    that one broadcast index covers.
    """
    items, n_blocks = _items(benchmark, block_chars)
    texts = take(docs, "doc_id", "text")
    if n_blocks > 1:  # rows need a name of their own to bring the blocks' answers together
        texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    else:
        texts = texts.withColumn("row", F.lit(0).cast("long"))
    return _judged(texts, items, n_blocks, width, share).drop("row")


def _judged(texts: DataFrame, items: DataFrame, n_blocks: int, width: int, share: int) -> DataFrame:
    """:func:`decontaminate` for ``texts`` (row, doc_id, text), with ``row``, which names a row if there are several blocks."""
    spark = texts.sparkSession
    parts = [_one_block(texts, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else items, width, spark) for b in range(n_blocks)]
    out = parts[0]
    if n_blocks > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        span = F.arrays_zip("hit_starts", "hit_ends")
        out = out.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list(span))).alias("spans"))
        none = F.array().cast("array<struct<hit_starts:int,hit_ends:int>>")
        last = lambda acc: F.element_at(acc, -1)

        def merge(acc, s):
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["hit_starts"].alias("hit_starts"), F.greatest(last(acc)["hit_ends"], s["hit_ends"]).alias("hit_ends"))))
            return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["hit_ends"] >= s["hit_starts"]), joined).otherwise(F.concat(acc, F.array(s)))

        out = out.withColumn("spans", F.aggregate("spans", none, merge)).select("row", "doc_id", "n_words", "items", F.col("spans.hit_starts").alias("hit_starts"), F.col("spans.hit_ends").alias("hit_ends"))
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    out = out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "items", "hit_starts", "hit_ends")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs``, columns as they were, that :func:`decontaminate` does not call contaminated.

    Every row is judged by its own text, whatever its id and however large the benchmark; a null or empty text is clean, and so is
    all against an empty benchmark.  Columns of any name pass through.
    """
    items, n_blocks = _items(benchmark, block_chars)
    if n_blocks > 1:  # the blocks' hits have to be brought together first
        rows = stored(positional(docs).withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        texts = rows.select("row", F.col(f"_c{position(docs, 'doc_id')}").alias("doc_id"), F.col(f"_c{position(docs, 'text')}").alias("text"))
        bad = _judged(texts, items, n_blocks, width, share).where("contaminated").select("row")
        return restored(rows.join(bad, "row", "left_anti"), docs.columns)
    held = _broadcast_index(take(docs, "text"), items, width, docs.sparkSession)

    def clean(text: str | None) -> bool:
        n, _, starts, ends = overlap(text, held.value[1])
        hit = sum(ends) - sum(starts)
        return not (hit > 0 and share * hit >= n)

    return restored(annotated(docs, "text", lambda: lambda texts: [clean(t) for t in texts], "_keep boolean").where("_keep"), docs.columns)


def _items(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """Items with a text, and into how many blocks their text goes."""
    items = take(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return items, 1 + int(total) // block_chars


def _broadcast_index(texts: DataFrame, items: DataFrame, width: int, spark):
    def vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": list({w for t in pdf["text"] for w in words(t)})})

    counts = _word_counts(texts, items.select("text").mapInPandas(vocabulary, "word binary").distinct())
    listed = sorted((r["item_id"], r["text"]) for r in items.collect())
    return spark.sparkContext.broadcast((np.array([i for i, _ in listed], dtype=object), _index(listed, width, counts)))


def _one_block(texts: DataFrame, items: DataFrame, width: int, spark) -> DataFrame:
    held = _broadcast_index(texts, items, width, spark)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, index = held.value
        for pdf in batches:
            rows = [overlap(t, index) for t in pdf["text"]]
            yield pd.DataFrame({
                "row": pdf["row"], "doc_id": pdf["doc_id"], "n_words": [r[0] for r in rows], "items": [sorted({names[i] for i in r[1]}) for r in rows],
                "hit_starts": [r[2] for r in rows], "hit_ends": [r[3] for r in rows],
            })

    # doc_id travels as text: a null among longs would turn them into floats
    rows = texts.select("row", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(find, "row long, doc_id string, n_words long, items array<string>, hit_starts array<int>, hit_ends array<int>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
