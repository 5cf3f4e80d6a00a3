"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are turned into integers, floor(scale * x).  Candidates come in blocks; a block holds one list
per dimension, sorted by that dimension.  A query reads all its lists in step (from the top for a
positive weight, from the bottom for a negative one), scores each vector when it is first seen by
looking up its other dimensions, and stops when the sum of the weighted values at the current depth is
below its kth result: nothing unseen can then enter.  Equal scores go to the smaller id, so
equality does not stop it.  The kth result is carried from block to block within a task.

Queries are dealt into sets of at most ``query_block`` rows; each set is broadcast alone and passes
over all candidates, so memory does not grow with the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, take


LONG = 2**63


def saturated(scores: np.ndarray) -> np.ndarray:
    """Exact integers beyond a long as the nearest one that it holds."""
    return np.clip(scores, -LONG, LONG - 1) if scores.dtype == object else scores


class Block:
    """Sorted lists over a block of integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")  # ascending, one column per dimension
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int, int]], first: int = 32) -> list[tuple[int, int, int]]:
        """``best`` (-score, id and row, ascending, at most k) improved by this block."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        used = np.concatenate((up, down))
        seen = np.zeros(n, bool)
        depth, step = 0, first
        while depth < n:
            to = min(n, depth + step)
            read = np.concatenate((self.order[n - to : n - depth][:, up].ravel(), self.order[depth:to][:, down].ravel())) if len(used) else np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[read] = True
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh & (self.ids != query_id))
            if len(at):
                scores = saturated(self.vectors[at] @ query)
                if len(best) == k:
                    keep = scores >= -best[-1][0]
                    at, scores = at[keep], scores[keep]
                if len(at) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = scores >= kth
                    at, scores = at[keep], scores[keep]
                more = [(-int(s), int(i), int(r)) for s, i, r in zip(scores, self.ids[at], self.rows[at], strict=True)]
                best = sorted(best + more)[:k]
            depth, step = to, step * 2
            if depth < n and len(best) == k:
                bound = self.sorted[n - depth, up] @ query[up] + self.sorted[depth - 1, down] @ query[down]
                if max(-LONG, min(LONG - 1, bound)) < -best[-1][0] or not len(used):
                    break
        return best


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """row, id and array<long> of floor(scale * x); rows go whose id is null or whose vector is null, empty or holds null or
    non-finite components, or one that a long does not hold once scaled."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= float(LONG)))
    rows = take(df, id_col, vec_col).toDF("id", "raw").select("id", F.col("raw").cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad).select(F.monotonically_increasing_id().alias("row"), "id", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, query_block: int = 4096, block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), the candidate's id as ``vec_id``, score: each query's ``k`` highest inner products.

    Every row of ``vectors`` is a candidate but those of the query's own id, so rows that repeat another id count each.  Every
    row of ``queries`` is a query: one that repeats an id has an answer of its own.  Fewer than k candidates give fewer
    rows; equal scores go to the smaller id.  Products are exact; a score beyond a long is the nearest that it holds.  Vectors of a length other than the query's take no part in its
    answer.  Other columns are not read; an empty table on either side gives an empty result.
    """
    spark = vectors.sparkSession
    cand = stored(quantised(vectors, id_col, vec_col, scale), "vectors")
    asked = stored(quantised(queries, id_col, vec_col, scale), "queries")
    n_sets = max(1, math.ceil(asked.count() / (query_block * 7 / 8)))
    parts = [_one_set(cand, asked.where(F.pmod(F.xxhash64("row"), F.lit(n_sets)) == s) if n_sets > 1 else asked, k, block, spark) for s in range(n_sets)]
    # a candidate row is read by one task of a set alone, so no task's answers repeat another's
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_set(cand: DataFrame, asked: DataFrame, k: int, block: int, spark) -> DataFrame:
    rows = [(r["id"], np.array(r["vec"], "int64"), r["row"]) for r in asked.collect()]  # at most query_block rows
    held = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = held.value
        best: list[list[tuple[int, int, int]]] = [[] for _ in queries]

        def work(ids: list, own: list, vecs: list) -> None:
            for d in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == d]
                m = np.stack([vecs[i] for i in at]).astype("int64")
                # float64 holds every integer that a score of realistic vectors can reach; else longs, else integers of any size
                most = int(np.abs(m).max()) * d * max((int(np.abs(q).max()) for _, q, _ in queries if len(q) == d), default=0)
                kind = "float64" if most < 2**52 and int(np.abs(m).max()) < 2**52 else "int64" if most < LONG else object
                b = Block(np.array([ids[i] for i in at], "int64"), np.array([own[i] for i in at], "int64"), m.astype(kind))
                for j, (qid, q, _) in enumerate(queries):
                    if len(q) == d:
                        best[j] = b.search(qid, q.astype(b.vectors.dtype), k, best[j])

        ids: list = []
        own: list = []
        vecs: list = []
        for pdf in batches:
            ids += pdf["id"].tolist()
            own += pdf["row"].tolist()
            vecs += pdf["vec"].tolist()
            if len(ids) >= block:
                work(ids, own, vecs)
                ids, own, vecs = [], [], []
        if ids:
            work(ids, own, vecs)
        out = [(qrow, qid, i, r, -s) for (qid, _, qrow), b in zip(queries, best, strict=True) for s, i, r in b]
        yield pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "row", "score"]).astype("int64")

    return cand.mapInPandas(run, "query_row long, query_id long, vec_id long, row long, score long")
