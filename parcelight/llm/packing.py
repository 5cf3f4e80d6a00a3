"""Best-fit packing by a grouping genetic algorithm on islands.

A chromosome is a set of bins.  Crossover injects whole well-filled bins of one parent into the
other, drops the bins that now hold an item twice, and best-fits the items so displaced.  Pieces are
dealt to islands of bounded size by a hash of a row number, and each island evolves alone.  Then its
well-filled bins are closed, and the pieces of the others migrate to fewer islands, together with the best
bin patterns (multisets of lengths, the elites) of a ring neighbour, which are realised with local pieces
and join the population there.  Rounds follow one another until one island is left or a round closes too little.

Island size does not depend on the input, so memory and time per task are constant and the number of
islands grows with the corpus.  The row number is given to the stored pieces, so neither a hot source nor repeated or
missing ids gather in an island.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, take
from .tokens import tokenizer

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of every document: ids of the whole text, then ``end_id``.

    Only documents of more than ``capacity`` ids are cut; the first piece takes the remainder and all
    others are full.  ``ids`` holds little-endian uint32.  Null text counts as empty (one piece that
    holds ``end_id``); a null doc_id stays null; repeated rows are separate documents.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(tokenizer_path)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                some = pdf.iloc[lo : lo + 512]
                doc, piece, start, length, ids = [], [], [], [], []
                for d, raw in zip(some["doc_id"].array, enc.encode(some["text"].tolist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    at = 0
                    for k in range(1 + (n - first) // capacity):
                        m = first if k == 0 else capacity
                        doc.append(d), piece.append(k), start.append(at), length.append(m)
                        ids.append(raw[4 * at : 4 * (at + m)])
                        at += m
                yield pd.DataFrame({"doc_id": pd.array(doc, dtype="Int64"), "piece": piece, "start": start, "length": length, "ids": ids})

    return take(docs, "doc_id", "text").mapInPandas(cut, PIECE_SCHEMA)


class Bins:
    """Bins of one capacity with best fit: a bit set of the remaining capacities finds the tightest bin."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room, self.by_room, self.mask = capacity, [], [], {}, 0

    def _file(self, b: int) -> None:
        r = self.room[b]
        self.by_room.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def open(self, items: list[int], used: int) -> None:
        self.items.append(items), self.room.append(self.capacity - used)
        self._file(len(self.items) - 1)

    def best_fit(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.open([item], length)
            return
        r = length + (fits & -fits).bit_length() - 1
        same = self.by_room[r]
        b = same.pop()
        if not same:
            self.mask &= ~(1 << r)
        self.items[b].append(item)
        self.room[b] = r - length
        self._file(b)


def best_fit_decreasing(lengths: list[int], order: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for b in kept:
        bins.open(list(b), sum(lengths[i] for i in b))
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.items


def lower_bound(lengths: list[int], capacity: int) -> int:
    return max(math.ceil(sum(lengths) / capacity), sum(2 * n > capacity for n in lengths))


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's sum of squared fills: it rewards full bins beside empty ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    ranked = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    injected = [x for x in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    held = {i for x in injected for i in x}
    kept, displaced = list(injected), []
    for x in a:
        if held.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in held]
    return best_fit_decreasing(lengths, sorted(displaced, key=lambda i: -lengths[i]), capacity, kept)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolve the emptiest bin and a few others at random."""
    worst = min(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = {worst, *rng.integers(0, len(bins), 2).tolist()}
    loose = [i for k in gone for i in bins[k]]
    rng.shuffle(loose)
    return best_fit_decreasing(lengths, loose, capacity, [x for k, x in enumerate(bins) if k not in gone])


def realised(patterns: list[tuple[int, ...]], lengths: list[int], capacity: int) -> list[list[int]]:
    """A chromosome that holds each pattern that the items can fill, with best fit decreasing for the rest."""
    shelf: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        shelf.setdefault(n, []).append(i)
    kept = []
    for pattern in patterns:
        need = Counter(pattern)
        if all(len(shelf.get(n, ())) >= c for n, c in need.items()):
            kept.append([shelf[n].pop() for n in pattern])
    rest = sorted((i for held in shelf.values() for i in held), key=lambda i: -lengths[i])
    return best_fit_decreasing(lengths, rest, capacity, kept)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[tuple[int, ...]] = (), population: int = 6, generations: int = 24, full: float = 0.995) -> list[list[int]]:
    """Bins (lists of item numbers) for one island.

    Best fit decreasing starts, or ``elites``, where these make the better packing: they are patterns of a neighbour, lengths
    that fill a bin together, realised over all items.  Where the start meets the lower bound nothing is left to gain.
    Otherwise its bins filled below ``full`` evolve, all of them; the others stay whole.
    """
    n = len(lengths)
    if not n:
        return []
    best = best_fit_decreasing(lengths, sorted(range(n), key=lambda i: -lengths[i]), capacity)
    if elites and len(best) > lower_bound(lengths, capacity):
        best = max(best, realised(elites, lengths, capacity), key=lambda b: fitness(b, lengths, capacity))
    if len(best) <= lower_bound(lengths, capacity):
        return best
    fill = [sum(lengths[i] for i in b) for b in best]
    done = [b for b, f in zip(best, fill, strict=True) if f >= full * capacity]
    loose = [b for b, f in zip(best, fill, strict=True) if f < full * capacity]
    items = [i for b in loose for i in b]
    sub = [lengths[i] for i in items]
    bound = lower_bound(sub, capacity)
    rng = np.random.default_rng(seed)
    number = {i: k for k, i in enumerate(items)}
    pop = [[[number[i] for i in b] for b in loose]]
    while len(pop) < population:
        noise = rng.normal(0, 0.05 * capacity, len(sub))
        pop.append(best_fit_decreasing(sub, sorted(range(len(sub)), key=lambda i: -(sub[i] + noise[i])), capacity))
    rated = sorted(((fitness(x, sub, capacity), x) for x in pop), key=lambda r: r[0], reverse=True)
    for _ in range(generations):
        if -rated[0][0][0] <= bound:
            break
        i, j = sorted(rng.integers(0, len(rated), 2).tolist())
        child = mutate(crossover(rated[i][1], rated[j][1], sub, capacity, rng), sub, capacity, rng)
        rate = fitness(child, sub, capacity)
        if rate > rated[-1][0]:
            rated[-1] = (rate, child)
            rated.sort(key=lambda r: r[0], reverse=True)
    return done + [[items[k] for k in b] for b in rated[0][1]]


def _islands(df: DataFrame, capacity: int, first_number: int, close_at: float, n_elites: int) -> DataFrame:
    """Evolve each island.  Adds sequence_id, offset, and ``open`` for pieces in bins below ``close_at``.
    Rows with ``elite`` set are patterns on arrival, and on leaving the patterns for the next island."""
    payload = [f for f in df.schema.fields if f.name not in ("island", "elite")]
    schema = T.StructType([*payload, *T._parse_datatype_string("island long, elite array<int>, sequence_id long, offset long, open boolean").fields])

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        island = key[0].as_py()
        is_elite = pc.is_valid(table["elite"])
        elites = [tuple(p) for p in table.filter(is_elite)["elite"].to_pylist()]
        table = table.filter(pc.invert(is_elite))
        lengths = table["length"].to_pylist()
        bins = evolve(lengths, capacity, island, elites, full=close_at)
        seq, off, still = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), np.zeros(len(lengths), bool)
        patterns: dict[tuple[int, ...], None] = {}
        for b, held in enumerate(bins):
            at = 0
            used = sum(lengths[i] for i in held)
            for i in held:
                seq[i], off[i], still[i] = ((first_number + island) << 31) + b, at, used < close_at * capacity
                at += lengths[i]
            if 1 < len(held) and used == capacity and len(patterns) < n_elites:
                patterns[tuple(sorted((lengths[i] for i in held), reverse=True))] = None
        n, k = len(lengths), len(patterns)
        own = {f.name: pa.concat_arrays([*table[f.name].chunks, pa.nulls(k, table.schema.field(f.name).type)]) for f in payload}
        return pa.table(own | {
            "island": pa.array([island] * (n + k), pa.int64()),
            "elite": pa.array([None] * n + [list(p) for p in patterns], pa.list_(pa.int32())),
            "sequence_id": pa.array([*seq.tolist(), *[None] * k], pa.int64()),
            "offset": pa.array([*off.tolist(), *[None] * k], pa.int64()),
            "open": pa.array([*still.tolist(), *[None] * k], pa.bool_()),
        })

    return df.groupBy("island").applyInArrow(solve, schema)


def pack(pieces: DataFrame, capacity: int = 1024, island_size: int = 4096, close_at: float = 0.995, n_elites: int = 32) -> DataFrame:
    """Place pieces (rows with ``length`` from 1 to ``capacity``) in as few sequences as the method finds.

    Adds ``sequence_id`` (any numbers) and ``offset`` (gapless from 0 in each sequence) to all columns
    of ``pieces``; ``elite``, ``island``, ``open`` and ``row`` are reserved names.  Equal lengths are
    interchangeable; repeated rows, and rows without an id, are placed each; an empty input gives an empty result.
    Islands hold seven eighths of ``island_size`` on average, so that the largest stays below it.
    """
    cols = pieces.columns
    left = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    elites: DataFrame | None = None
    closed, first_number, before = [], 0, None
    while True:
        size = left.count()
        n = max(1, math.ceil(size / (island_size * 7 / 8)))
        last = before is not None and n > before / 2  # the round before closed less than half
        spread = left.select(*cols, "row", F.pmod(F.xxhash64(F.lit(first_number), "row"), F.lit(n)).alias("island"), F.lit(None).cast("array<int>").alias("elite"))
        if elites is not None:  # on to the next island of the ring
            spread = spread.unionByName(elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(n))))
        now = stored(_islands(spread, capacity, first_number, close_at, n_elites), "islands")
        placed = now.where("elite is null")
        if n == 1 or last:
            closed.append(placed.select(*cols, "sequence_id", "offset"))
            return reduce(DataFrame.unionByName, closed)
        closed.append(placed.where("not open").select(*cols, "sequence_id", "offset"))
        left = placed.where("open").select(*cols, "row")
        elites = now.where("elite is not null").select(*cols, "row", "island", "elite")
        first_number, before = first_number + n, n


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents to placed pieces with their ids: the operator's full output."""
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, end_id), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its ids as one binary value, pieces in offset order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"), F.sum("length").alias("length"))
