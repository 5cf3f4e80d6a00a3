"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text form a group, which stays whole.  Groups sorted by size enter the bin with the tightest
remaining capacity, found in a balanced tree; the capacity is the smallest at which that rule needs no more
than the wanted number of shards, so the shards' bytes are as near equal as whole groups allow.  A group
larger than an even share has a shard of its own, and the rest is packed into the others.

Groups of one size are interchangeable, so the driver packs counts per distinct size: n distinct sizes need a
corpus of n * n / 2 bytes at least, so their number is at most the square root of twice the volume.  A bin that is
the tightest for a size remains so until it is too small, so it takes all it can of that size in one step.
Groups take their places by their rank within their size.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, take

Run = tuple[int, int, int, int]  # size, first and end of the ranks within that size, bin


class Rooms:
    """Open bins in a balanced tree (a treap) by remaining capacity, then by number."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.rng = random.Random(0)

    def _split(self, t: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def put(self, room: int, number: int) -> None:
        key = (room, number)
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.rng.random(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin of room ``size`` or more, the first of equals."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        least = right
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(right, (least[0][0], least[0][1] + 1))
        self.root = self._merge(left, rest)
        return least[0]


def best_fit_decreasing(counts: list[tuple[int, int]], capacity: int, most: int) -> list[Run] | None:
    """Runs of equal items per bin from (size, count) in descending order of size, or None if more than ``most``
    bins of ``capacity`` are needed."""
    rooms, runs, n = Rooms(), [], 0
    for size, count in counts:
        done = 0
        while done < count:
            got = rooms.take(size)
            if got is None:
                if n == most or size > capacity:
                    return None
                got, n = (capacity, n), n + 1
            room, b = got
            k = min(count - done, room // size)
            runs.append((size, done, done + k, b))
            done += k
            rooms.put(room - k * size, b)
    return runs


def pack_shards(counts: list[tuple[int, int]], n_shards: int) -> list[Run]:
    """Runs under the smallest sufficient capacity; a group above an even share of what is left stands alone."""
    counts = sorted(((s, c) for s, c in counts if c), reverse=True)
    volume, alone = sum(s * c for s, c in counts), []
    while counts and counts[0][0] > math.ceil(volume / (n_shards - len(alone))):
        size, count = counts[0]
        taken = sum(r[0] == size for r in alone)
        alone.append((size, taken, taken + 1, len(alone)))
        volume -= size
        counts[:1] = [(size, count - 1)] if count > 1 else []
    if not counts:
        return alone
    # ranks of a size that lost some to shards of their own go on from there
    lost = {s: sum(r[0] == s for r in alone) for s in {r[0] for r in alone}}
    left = n_shards - len(alone)
    low = max(counts[0][0], math.ceil(volume / left))
    high, step, best = low, 1, best_fit_decreasing(counts, low, left)
    while best is None:
        low, high, step = high + 1, high + step, step * 2
        best = best_fit_decreasing(counts, high, left)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(counts, mid, left)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return alone + [(s, a + lost.get(s, 0), b + lost.get(s, 0), k + len(alone)) for s, a, b, k in best]


def shard(docs: DataFrame, n_shards: int = 40, split_above: float | None = None, overhead: int = 16, slot_rows: int = 50_000, hot: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    ``size`` is the UTF-8 bytes of the text plus ``overhead``; a null text has none and is a group with
    the empty ones.  Repeated rows are documents of their own, of one group.  Groups are whole unless ``split_above`` is
    given: then a group of more than so many even shares is dealt, by row, into parts of a quarter of a share, each a
    group.  An empty table gives an empty result; other columns are not read.  Slots follow no order of the data:
    each (shard, chunk) numbers its rows after those of the chunks before it.  Groups of at least a ``hot``-th
    of all rows, of which there are at most ``hot``, meet their rows by broadcast.
    """
    text = F.col("text")
    raw = F.coalesce(text, F.lit(""))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size")
    rows = take(docs, "doc_id", "text").select("doc_id", size, F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("grp"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "sizes")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    n = total["n"]
    if split_above is not None:
        rows = stored(_split_up(rows, max(1, math.ceil((total["size"] or 0) / n_shards)), split_above), "sizes")
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    placed = stored(_placed(groups, n_shards, slot_rows), "placed")
    # a hot group's rows do not meet in one task
    few = F.broadcast(placed.where(F.col("n") >= max(2, math.ceil(n / hot))).select("grp", "shard"))  # at most ``hot`` rows
    rest = rows.join(few.select("grp"), "grp", "left_anti").join(placed.select("grp", "shard"), "grp")
    chunks = max(1, math.ceil(n / (n_shards * slot_rows)), min(8, math.ceil(n / n_shards / 200)))
    chunk = F.pmod(F.xxhash64(F.lit(4), "row"), F.lit(chunks)).cast("int")
    out = rows.join(few, "grp").unionByName(rest).select("doc_id", "size", "text_crc32", "row", "shard", chunk.alias("chunk"))
    out = _numbered(stored(out, "shards"), ["shard"], "row")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("place").alias("slot"))


def _split_up(rows: DataFrame, share: int, split_above: float) -> DataFrame:
    """``rows`` with groups above the limit as parts under names of their own; such groups are fewer than shards / limit."""
    big = rows.groupBy("grp").agg(F.sum("size").alias("all")).where(F.col("all") > split_above * share)
    part = F.pmod(F.xxhash64(F.lit(3), "row"), F.ceil(F.col("all") * 4 / share))
    named = rows.join(F.broadcast(big), "grp", "left")
    return named.withColumn("grp", F.when(F.col("all").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", part))).drop("all")


def _placed(groups: DataFrame, n_shards: int, slot_rows: int) -> DataFrame:
    """grp, n and shard of every group: packed by counts per size, dealt by rank within the size."""
    counts = groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).collect()
    by_size: dict[int, list[tuple[int, int]]] = {}
    for s, _, end, b in pack_shards([(r["size"], r["groups"]) for r in counts], n_shards):
        by_size.setdefault(s, []).append((end, b))
    plan = groups.sparkSession.createDataFrame([(s, sorted(v)) for s, v in by_size.items()], "size long, runs array<struct<end:long,shard:int>>")
    chunks = max(1, math.ceil(sum(r["groups"] for r in counts) / slot_rows))
    chunk = F.pmod(F.xxhash64(F.lit(6), "grp"), F.lit(chunks)).cast("int").alias("chunk")
    ranked = _numbered(groups.select("grp", "size", "n", chunk), ["size"], "grp")
    at = F.filter("runs", lambda r: r["end"] > F.col("place"))
    return ranked.join(plan, "size").select("grp", "n", F.element_at(at, 1)["shard"].alias("shard"))


def _numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``place``: gapless from 0 within ``keys``.  Each (keys, chunk) is numbered alone, after the chunks before it,
    so that no task holds all rows of a key."""
    held = Window.partitionBy(*keys, "chunk").orderBy(order)
    past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("k"))
    starts = counts.select(*keys, "chunk", F.coalesce(F.sum("k").over(past), F.lit(0)).alias("before"))
    return df.withColumn("at", F.row_number().over(held) - 1).join(starts, [*keys, "chunk"]).withColumn("place", (F.col("before") + F.col("at")).cast("long")).drop("at", "before")
