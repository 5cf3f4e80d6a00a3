"""Exact quantiles by rank: no task holds a group, and no value is listed.

Rows are counted per distinct value.  The counts are dealt out in ranges of (keys, value), so each stored partition, a chunk, is
one stretch of the whole order, also of a group larger than a task.  Sums per chunk tell in which chunk a rank lies; running
counts are taken in those chunks alone.  For one key against all others the order is that of the values of all keys, and the
others' running count is the total's less the key's own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys, v and c: how often each value that is not null occurs under them."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def chunked(counted: DataFrame, order: list[str]) -> DataFrame:
    """``counted`` stored in the given order, with the number of the chunk that holds each row."""
    ranges = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranges.withColumn("chunk", F.spark_partition_id()), "counted")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where a null equals a null; columns of both, the keys once."""
    named = right.toDF(*(f"r_{c}" if c in keys else c for c in right.columns))
    on = [left[k].eqNullSafe(named[f"r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*(f"r_{k}" for k in keys))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Type-7 quantiles of ``value`` per key, one column for each of ``wanted`` (name to share); keys without a value have
    no row.  Without keys there is one row, or none."""
    return of_counts(counts(df, keys, value), keys, wanted)


def of_counts(counted: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    by = keys or ["_all"]
    rows = chunked(counted if keys else counted.withColumn("_all", F.lit(0)), [*by, "v"])
    group = Window.partitionBy(*by)
    # a row per key and chunk
    chunks = rows.groupBy(*by, "chunk").agg(F.sum("c").alias("t")).withColumns({"n": F.sum("t").over(group), "before": F.sum("t").over(group.orderBy("chunk")) - F.col("t")})

    def ranks(name: str, q: float) -> list[Column]:
        at = (F.col("n") - 1) * F.lit(float(q))
        return [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), r.cast("long").alias("rank"), (at - F.floor(at)).alias("share")) for side, r in ((0, F.floor(at)), (1, F.ceil(at)))]

    each = F.explode(F.array(*(s for name, q in wanted.items() for s in ranks(name, q)))).alias("w")
    at = chunks.select(*by, "chunk", "before", "t", each).where("w.rank >= before and w.rank < before + t").select(*by, "chunk", "before", "w.*")
    held = _joined(rows, at.select(*by, "chunk").distinct(), [*by, "chunk"], "left_semi")
    running = held.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "chunk").orderBy("v")))
    hit = _joined(running, at, [*by, "chunk"], "inner").where("rank >= before + upto - c and rank < before + upto")
    pick = lambda name, side, col: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(col)))
    low = {name: pick(name, 0, "v") for name in wanted}
    out = hit.groupBy(*by).agg(*((low[n] + pick(n, 0, "share") * (pick(n, 1, "v") - low[n])).alias(n) for n in wanted))
    return out if keys else out.drop("_all")


def with_quantiles(grouped: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``grouped`` with the columns of ``found``; null where a key has no value."""
    if keys:
        return _joined(grouped, found, keys, "left")
    return grouped.join(found, F.lit(True), "left")  # one row, and one or none


def others_quantile(df: DataFrame, key: str, value: str, q: float, name: str = "peer_p90") -> DataFrame:
    """For each key the type-7 quantile of the values of all other keys; keys whose others have no value are left out.

    One order of (value, key) for all.  Of a chunk a key's others have its total less the key's own, so each key finds its chunk from
    sums, one per chunk that it occurs in; within a chunk each rank is a binary search in running counts.
    """
    counted = counts(df.where(F.col(key).isNotNull()), [key], value)
    rows = chunked(counted, ["v", key])
    # a number per chunk, of which there are as many as partitions
    totals = [(r["chunk"], r["t"]) for r in rows.groupBy("chunk").agg(F.sum("c").alias("t")).orderBy("chunk").collect()]
    if not totals:
        return df.sparkSession.createDataFrame([], df.select(key).schema.add(name, "double"))
    all_ = sum(t for _, t in totals)
    own = rows.groupBy(key, "chunk").agg(F.sum("c").alias("o")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("chunk", "o"))).alias("own"), F.sum("o").alias("n_own"))
    steps = F.array(*(F.struct(F.lit(p).alias("chunk"), F.lit(t).cast("long").alias("t")) for p, t in totals))

    def place(rank: Column) -> Column:
        """The chunk of the others' rank, and how many of them stand before it."""
        none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("long").alias("before"))

        def step(acc: Column, s: Column) -> Column:
            after = acc["seen"] + s["t"] - F.coalesce(F.try_element_at("own", s["chunk"]), F.lit(0))
            here = acc["chunk"].isNull() & (rank < after)
            return F.struct(after.alias("seen"), F.when(here, s["chunk"]).otherwise(acc["chunk"]).alias("chunk"), F.when(here, acc["seen"]).otherwise(acc["before"]).alias("before"))

        return F.aggregate(steps, none, step)

    at = (F.lit(all_) - F.col("n_own") - 1) * F.lit(float(q))
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), r.cast("long").alias("rank"), (at - F.floor(at)).alias("share")) for side, r in ((0, F.floor(at)), (1, F.ceil(at))))))
    wanted = own.where(F.col("n_own") < all_).select(key, "own", sides.alias("w")).select(key, F.col("w.side").alias("side"), F.col("w.rank").alias("rank"), F.col("w.share").alias("share"), place(F.col("w.rank")).alias("p"))
    wanted = wanted.select(F.col(key).alias("k"), "side", "share", (F.col("rank") - F.col("p.before")).alias("rank"), F.col("p.chunk").alias("chunk"))
    held = rows.select(F.col(key).alias("k"), "v", "c", "chunk").join(wanted.select("chunk").distinct(), "chunk", "left_semi")
    kind = df.schema[key].dataType.simpleString()
    hit = held.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInPandas(_search, f"k {kind}, side int, share double, v double")
    pick = lambda side, col: F.max(F.when(F.col("side") == side, F.col(col)))
    return hit.groupBy(F.col("k").alias(key)).agg((pick(0, "v") + pick(0, "share") * (pick(1, "v") - pick(0, "v"))).alias(name))


def _search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Values at ranks among the other keys of one chunk, by its running counts in total and per key."""
    rows = rows.sort_values(["v", "k"], ignore_index=True)
    v, total = rows["v"].to_numpy(float), rows["c"].to_numpy().cumsum()
    places = rows.groupby("k", sort=False).indices
    out = []
    for k, side, share, rank in wanted[["k", "side", "share", "rank"]].itertuples(index=False):
        mine = np.sort(places.get(k, np.zeros(0, int)))
        own = rows["c"].to_numpy()[mine].cumsum()
        # how many of the others stand at or before each of the key's own rows
        j = int(np.searchsorted(total[mine] - own, rank, "right"))
        i = int(np.searchsorted(total, rank + (own[j - 1] if j else 0), "right"))
        out.append((k, side, share, v[i]))
    return pd.DataFrame(out, columns=["k", "side", "share", "v"])


def array_quantile(values: Column, q: float) -> Column:
    """Type-7 quantile of a short array of numbers; null of an empty one."""

    def of(arr: Column) -> Column:
        at = (F.size(arr) - 1) * F.lit(float(q))
        low, high = F.get(arr, F.floor(at).cast("int")), F.get(arr, F.ceil(at).cast("int"))
        return low + (at - F.floor(at)) * (high - low)

    held: Callable[[Column], Column] = lambda arr: F.element_at(F.transform(F.array(arr), of), 1)
    return held(F.array_sort(F.filter(values, lambda x: x.isNotNull())))
