"""Interaction of filters that remove documents, over all orders in which they can be applied.

With filters ABCDE an order is a path through the lattice of their subsets: each step is an edge from the set of filters
already applied to that set and one more.  There are 80 edges and 120 paths of 5 edges.  What a step keeps and
removes depends on its edge alone, so documents are counted by edge and the 600 steps look their counts up.
The edges that a document contributes to, and how, follow from the set of filters that it fails, so documents are first counted
by (part, set): at most 32 rows a part meet the edges, whatever the corpus.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, take

FILTERS = "ABCDE"
#: What separates words beside the space.
WHITE = "\t\n\x0b\x0c\r"
#: Rows without an id meet the labels in so many places.
SALTS = 1024
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for what a text fails by itself: under 50 words; 100 * distinct words < 65 * words;
    100 * capitals A-Z > 5 * code points; any of ``#$%&*|``."""
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    many = lambda arr: F.size(arr).cast("long")
    wordy = lambda w: F.when(F.size(w) < 50, 1).otherwise(0) + F.when(100 * many(F.array_distinct(w)) < 65 * many(w), 2).otherwise(0)
    n = F.length(text).cast("long")
    capitals = n - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    once = F.element_at(F.transform(F.array(words), wordy), 1)  # the words are cut once for both
    return once + F.when(100 * capitals > 5 * n, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, good, bad (0 or 1) of each labelled document: 1 where any of its rows says quality, or toxic, 1."""
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    return take(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("bad"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits in the order of FILTERS), docs, good, toxic: documents counted by what they fail.

    A text repeats (E) where a document of a smaller id has it, wherever in the table.  Rows without an id come after all
    others, have no label and do not make each other repeat, nor do rows that share an id; each row counts.  A null text is
    empty, a null source the empty part.  Copies are counted before they are moved, so a group of any size is a few rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = take(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("name"), text_failures(text).alias("own"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("name", "part"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    alike = rows.groupBy("name", "part", "own", "doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", salt)
    told = marked(labels).withColumn("salt", F.lit(0).cast("long"))
    judged = alike.join(told, ["doc_id", "salt"], "left").withColumns({"good": F.coalesce("good", F.lit(0)), "bad": F.coalesce("bad", F.lit(0))})
    grouped = judged.groupBy("name", "part", "own", "good", "bad").agg(F.sum("n").alias("n"), F.min_by("n", "doc_id").alias("n_first"), F.min("doc_id").alias("first"))
    grouped = stored(grouped, "audit-texts")  # met twice below; the texts are read once
    least = grouped.groupBy("name").agg(F.min("first").alias("least"))
    # the rows of a text's smallest id do not repeat; a text of which no row has an id repeats nowhere
    free = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    parts = F.array(F.struct(F.lit(0).alias("e"), free.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - free).alias("n")))
    split = grouped.join(least, "name").select("part", "own", "good", "bad", F.explode(parts).alias("x")).select("part", (F.col("own") + F.col("x.e")).alias("fails"), "good", "bad", F.col("x.n").alias("n"))
    return split.where("n > 0").groupBy("part", "fails").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def edges() -> list[tuple[int, int, int]]:
    """(bits applied, bit of the next filter, number of orders that pass here)."""
    k = len(FILTERS)
    size = int.bit_count
    return [(s, 1 << f, math.factorial(size(s)) * math.factorial(k - 1 - size(s))) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, bits applied before it, bit of its filter) of every order."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), i + 1, sum(bit[g] for g in p[:i]), bit[p[i]]) for p in itertools.permutations(FILTERS) for i in range(len(FILTERS))]


def lattice(counted: DataFrame) -> DataFrame:
    """part, applied, filter and the counts of every edge in every part, with its share of its filter's Shapley sum."""
    edge = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges()))
    each = counted.select("*", F.explode(edge).alias("edge")).select("part", "fails", "docs", "good", "toxic", "edge.*")
    hit, before = F.col("fails").bitwiseAND(F.col("filter")) != 0, F.col("fails").bitwiseAND(F.col("applied")) != 0
    total = lambda cond, name, alias: F.sum(F.when(cond, F.col(name)).otherwise(0)).alias(alias)
    by_edge = each.groupBy("part", "applied", "filter", "orders").agg(
        total(~hit & ~before, "docs", "kept"), total(hit & ~before, "docs", "removed"), total(hit & before, "docs", "redundant"),
        total(F.col("fails") == F.col("filter"), "docs", "unique_fails"), total(hit & ~before, "good", "good_lost"), total(hit & ~before, "toxic", "toxic_lost"),
    )
    return by_edge.withColumn("weighted", F.col("orders") * F.col("removed"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and :data:`MEASURES` (longs) for each of the 600 steps in each part, zeros included.

    What counts as failing, and null, repeated and unlabelled rows: :func:`failures`.  An empty table has no part and gives
    no row; columns other than doc_id, text and source, and of labels other than doc_id, quality and toxic, are not read.
    """
    by_edge = lattice(stored(failures(docs, labels), "audit-sets"))  # at most 32 rows a part
    shapley = by_edge.groupBy("part", "filter").agg(F.sum("weighted").alias("shapley"))
    # 600 rows by rule
    path = F.broadcast(docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, filter int"))
    return by_edge.join(path, ["applied", "filter"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *(F.col(m).cast("long").alias(m) for m in MEASURES))
