"""Near duplicates by Order MinHash, with banded alignment of every candidate pair.

A text is its words (:func:`.decontaminate.words`), its k-mers are shingles of five words, each
labelled with its occurrence number.  One table of the sketch takes the ``depth`` k-mers with the
smallest hashes under that table's permutation and keeps them in text order, so that two texts agree
in a table when they share those k-mers in the same order: a probe for edit similarity.  Texts that
agree in a table meet in a bucket.

Equal texts are one node.  A bucket is not expanded into pairs: its members are compared with a few
leaders of other components, those that meet most texts in their buckets first, the links so found are closed into
components, and the leaders retire.  The next rounds take twice as many leaders, of nodes that have links (hubs) alone, first one of each component, as
long as a good share of the compared pairs links.  A bucket is then open while members that never led lie
in several components.  All members of open buckets are joined at last by their rarest k-mers: of two similar
texts the shared k-mers are so many that one stands early in both when each text's k-mers are ordered by rarity,
and its places and the two sizes bound what they can share.  So each pair of a bucket is linked, tested,
or excluded by an exact bound, and edited copies that share no more than a common passage are never paired.
Pairs are verified on whole texts by a banded alignment of their labelled k-mers: a match scores one, a gap
nothing, and cells farther from the diagonal than the threshold allows are never visited.  As a labelled k-mer
stands once in a text, the matrix has at most one match in a row and in a column, so the best path
through the band is the longest chain of matches that rises in both texts.  Two texts link if
aligned / (k-mers of both - aligned) is at least ``least``, counted with labels or over distinct k-mers.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import position, positional, restored, stored, take
from .decontaminate import words

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, "<u8"), np.ones(1, "<u8")]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            t = np.full(m, base, "<u8")
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def word_hashes(w: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each word, for all words of a text at once."""
    if not w:
        return np.zeros(0, "<u8")
    raw = np.frombuffer(b"".join(w), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)))
    starts = np.concatenate(([0], ends[:-1]))
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, "<u8"), np.cumsum((raw.astype("<u8") + np.uint64(1)) * power[: len(raw)])))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text is one run."""
    n = len(h)
    if not n:
        return h
    m = min(k, n)
    out = np.zeros(n - m + 1, "<u8")
    for i in range(m):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - m + 1 + i])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number, so that each is unique in its text."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
    if first.all():
        return s
    run = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
    label = np.empty(len(t), "<u8")
    label[order] = (np.arange(len(t)) - run).astype("<u8")
    return np.where(label > 0, mix(s + label * np.uint64(_P)), s)


@lru_cache
def _seeds(tables: int) -> np.ndarray:
    return mix(np.arange(1, tables + 1, dtype="<u8") * np.uint64(_P)) | np.uint64(1)


def _smallest(s: np.ndarray, tables: int, depth: int) -> np.ndarray:
    """The k-mers of smallest hashes in text order, one row per table."""
    seeds, n = _seeds(tables), len(s)
    d = min(depth, n)
    if d == n:
        return np.broadcast_to(s, (tables, n))
    out = np.empty((tables, d), "<u8")
    step = max(1, 2_000_000 // n)
    for lo in range(0, tables, step):
        rank = s[None, :] * seeds[lo : lo + step, None]
        rank ^= rank >> np.uint64(32)
        at = np.argpartition(rank, d - 1, axis=1)[:, :d]
        at.sort(axis=1)  # text order
        out[lo : lo + step] = s[at]
    return out


def _keyed(drawn: np.ndarray, tag: int = 0) -> np.ndarray:
    key = _seeds(len(drawn)) + np.array([tag], "<u8")
    for i in range(drawn.shape[1]):
        key = mix(key * np.uint64(_P) + drawn[:, i])
    return key


def order_minhash(s: np.ndarray, tables: int, depth: int) -> np.ndarray:
    """One 64-bit key per table from labelled k-mers ``s``."""
    return _keyed(_smallest(s, tables, depth))


def sketch_keys(s: np.ndarray, tables: int, depth: int, short: int = 16) -> tuple[np.ndarray, int]:
    """Bucket keys of a text's k-mers ``s``, so that both measures of :func:`similarity` have candidates; how many k-mers differ.

    Labelled k-mers serve the labelled measure.  A text that repeats k-mers also has keys over its first
    occurrences, which meet those of a text without repeats, and keys over the same k-mers in the order of their
    values, as a chain of two texts with repeats need not follow their first occurrences.  Texts of at most
    ``short`` k-mers also have keys of half the depth: among so few, ``depth`` shared ones are rarely all smallest.
    """
    lab, half = labelled(s), max(1, depth // 2)
    once = s[lab == s]  # in the order in which they first occur
    out = [order_minhash(lab, tables, depth)]
    if len(s) <= short:
        out.append(_keyed(_smallest(lab, tables, half), 1))
    if len(once) < len(s):
        for d in (depth, half) if len(once) <= short else (depth,):
            drawn = _smallest(once, tables, d)
            out += [_keyed(drawn, d != depth), _keyed(np.sort(drawn, axis=1), 2 + (d != depth))]
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0], len(once)


def similarity(a: np.ndarray, b: np.ndarray, k: int, least: float) -> float:
    """Similarity of two texts given as word hashes; 0 as soon as it must be below ``least``."""
    return aligned(prepared(a, k), prepared(b, k), least)


def prepared(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-mers of a text, with labels, and those that differ."""
    s = shingles(a, k)
    return s, labelled(s), np.unique(s)


def aligned(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> float:
    """:func:`similarity` of prepared texts, in either order: of equally good paths the one found may hold fewer distinct k-mers."""
    found = _banded(x, y, least)
    repeats = all(len(s) > len(d) for s, _, d in (x, y))
    return max(found, _banded(y, x, least)) if repeats and 0 < found < least else found


def _banded(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> float:
    (sa, la, da), (_, lb, db) = x, y
    both = len(la) + len(lb)
    shared = len(np.intersect1d(da, db, assume_unique=True))
    _, ia, ib = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    if len(ia) < least * (both - len(ia)) and shared < least * (len(da) + len(db) - shared):
        return 0.0
    # matches within the band, by their row; a path that leaves it has too many gaps
    band = (1 - least) / (1 + least) * both
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order].tolist()
    # best path: the least column at which a path of each length ends
    tails: list[int] = []
    tail_at: list[int] = []
    before = [-1] * len(ib)
    for i, j in enumerate(ib):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j), tail_at.append(i)
        else:
            tails[p], tail_at[p] = j, i
        before[i] = tail_at[p - 1] if p else -1
    if not tails:
        return 0.0
    chain, i = [], tail_at[-1]
    while i >= 0:
        chain.append(i)
        i = before[i]
    n = len(chain)
    distinct = len(np.unique(sa[ia[chain]]))
    return max(n / (both - n), distinct / (len(da) + len(db) - distinct))


def _node(w: list[bytes], text: str) -> int:
    raw = b" ".join(w) if w else b"\0" + text.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.md5(raw).digest()[:8], "little", signed=True)


def _hash(c: Column | str) -> Column:
    return F.xxhash64(F.lit(5), c)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node that it reaches) for all nodes of ``edges`` (a, b).

    Each pass lets every node point to its least neighbour, follows the pointers to their ends and contracts the edges to
    those ends, so that later passes see the edges that are left between trees alone.  Hubs are summed before the shuffle.
    """
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "pointers")
        while True:
            up = to.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            step = stored(to.join(up, "comp").select("node", F.col("comp").alias("old"), F.col("top").alias("comp")), "pointers")
            to = step.select("node", "comp")
            if step.where("old <> comp").isEmpty():
                break
        labels = to if labels is None else _relabelled(labels, to)
        tops = lambda c: to.select(F.col("node").alias(c), F.col("comp").alias(f"top_{c}"))  # noqa: B023, E731
        left = left.join(tops("a"), "a").join(tops("b"), "b").where("top_a <> top_b")
        left = stored(left.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels


def _relabelled(labels: DataFrame, tops: DataFrame) -> DataFrame:
    """``labels`` with each component under the name that ``tops`` (node, comp) gives it, if any."""
    named = tops.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return labels.join(named, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``labels`` (node, comp) after more ``links`` (a, b): only components that a link joins are closed again."""
    if labels is None:
        return components(links)
    comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = links.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return _relabelled(labels.unionByName(new), components(between))


#: What names a row's document and text wherever it is read again: the id, whether it has none, 128 bits of its text.
NAME = ("d", "nameless", "t1", "t2")


def _name(doc_id: str, text: str) -> list[Column]:
    d = F.col(doc_id).cast("long")
    return [F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("nameless"), F.xxhash64(F.lit(5), text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2")]


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, tables: int = 20, depth: int = 4) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size.

    Texts of equal words are one class.  Texts without a word are a class if they are equal, the empty
    ones too.  A null text is always alone.  A text of fewer than ``k`` words is one shingle.  A null
    doc_id stays null, and a class of such documents alone has a null class_id.
    """
    texts = take(docs, "doc_id", "text")
    prep, member = _classes(texts, k, least, tables, depth)
    heads = member.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    classes = member.select("node", "comp").join(heads, "comp").select("node", "class_id", "class_size")
    out = prep.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "class_size")
    return out.unionByName(texts.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def _classes(texts: DataFrame, k: int, least: float, tables: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a text (doc_id, its name, node), and nodes with their class (node, first_id, n, comp)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes, keys, sizes, kinds = [], [], [], []
            for text in pdf["text"]:
                w = words(text)
                s = shingles(word_hashes(w), k)
                found, n = sketch_keys(s, tables, depth) if w else (s, 0)
                nodes.append(_node(w, text)), sizes.append(len(s)), kinds.append(n), keys.append(found.view("<i8"))
            yield pd.DataFrame({c: pdf[c] for c in NAME} | {"node": nodes, "keys": keys, "size": sizes, "kinds": kinds})

    drawn = texts.where("text is not null").select(*_name("doc_id", "text"), "text")
    drawn = drawn.mapInPandas(sketch, "d long, nameless boolean, t1 long, t2 long, node long, keys array<long>, size long, kinds long")
    prep = stored(drawn.withColumn("doc_id", F.when(~F.col("nameless"), F.col("d"))), "sketches")
    first_row = F.min(F.struct(*NAME)).alias("row")
    nodes = stored(prep.groupBy("node").agg(F.min("doc_id").alias("first_id"), first_row, F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("keys", "size", "kinds"))), "nodes")
    bucketed = nodes.select("node", "size", "kinds", F.explode(F.array_distinct("keys")).alias("bucket"))
    # only buckets with company matter; a text that many others are edited from meets most of them in its buckets
    crowd = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stored(bucketed.join(crowd, "bucket"), "buckets")
    met = rows.groupBy("node").agg(F.sum("n").alias("met"))
    rows = stored(rows.drop("n").join(met, "node"), "buckets")
    hashed = _word_table(texts, rows, nodes, k)
    found: DataFrame | None = None
    tried: DataFrame | None = None
    labels: DataFrame | None = None
    active, n_leaders, fruitful = rows, 2, True
    within = lambda c: F.least(c, f"lead_{c}") >= least * F.greatest(c, f"lead_{c}") - 1e-6
    while True:
        if labels is None:
            named = active.withColumns({"comp": F.col("node"), "degree": F.lit(0).cast("long")})
        else:
            named = active.join(labels, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "degree": F.coalesce("degree", F.lit(0))})
        bounds = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        named = stored(named.join(bounds, "bucket"), "open")
        if named.isEmpty():
            break
        if fruitful:
            order = (F.desc("degree"), F.desc("met"), _hash("node"), "node")
            hubs = named if labels is None else named.where("degree > 0")
            lead = hubs.withColumn("turn", F.row_number().over(Window.partitionBy("bucket", "comp").orderBy(*order))).where(F.col("turn") <= n_leaders)
            lead = lead.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("turn", *order))).where(F.col("place") <= n_leaders)
            lead = stored(lead.select("bucket", *(F.col(c).alias(f"lead_{c}") for c in ("node", "comp", "size", "kinds"))), "leaders")
            pairs = named.join(lead, "bucket").where("comp <> lead_comp").where(within("size") | within("kinds"))
            pairs = pairs.select(F.least("node", "lead_node").alias("a"), F.greatest("node", "lead_node").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
        else:
            pairs = _rare_pairs(named.select("node", "comp").distinct(), hashed, k, least)
        pairs = stored(pairs, "pairs")
        links = stored(_verified(pairs, hashed, k, least), "links")
        n_links = links.count()
        if n_links:
            found = links if found is None else found.unionByName(links)
            degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
            closed = merged(None if labels is None else labels.select("node", "comp"), links)
            labels = stored(closed.join(degree, "node"), "labels")
        if not fruitful:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        active = named.select(*rows.columns).join(lead.select("bucket", F.col("lead_node").alias("node")), ["bucket", "node"], "left_anti")
        # what follows finds the same links; this only chooses the cheaper way to the next ones
        n_leaders, fruitful = n_leaders * 2, n_links > 0 and (n_leaders == 2 or n_links > 0.1 * pairs.count())
    member = nodes.select("node", "first_id", "n")
    if labels is None:
        return prep, member.withColumn("comp", F.col("node"))
    return prep, member.join(labels.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _word_table(texts: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Word hashes of the nodes that share a bucket with another, each from one row that it names: rows that share a
    doc_id, or have none, meet only where their texts are equal too."""
    wanted = rows.select("node").distinct().join(nodes.select("node", "row.*"), "node")

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            nodes_, out = [], []
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                if node == last:  # a row repeated with its id: the join brings its copies one after another
                    continue
                last, w = node, words(text)
                if _node(w, text) == node:  # should two texts share a name
                    nodes_.append(node)
                    out.append((word_hashes(w) >> np.uint64(32)).astype("<u4").tobytes())
            yield pd.DataFrame({"node": nodes_, "hashes": out})

    held = texts.where("text is not null").select(*_name("doc_id", "text"), "text").join(wanted, list(NAME)).select("node", "text")
    return stored(held.mapInPandas(hashes, "node long, hashes binary").dropDuplicates(["node"]), "hashes")


def _loaded(raw: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return prepared(mix(np.frombuffer(raw, "<u4").astype("<u8")), k)


def _rare_pairs(nodes: DataFrame, hashed: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, comp) of different components that may be similar: every similar pair, by a
    prefix-filtered set join, once over labelled and once over distinct k-mers.

    Of sizes m and n at least r * (m + n) k-mers must be shared, r = least / (1 + least).  If the rarest shared one
    stands at place i of a text of m, at most m - i are shared, so n is at most ``reach`` = (m - i) / r - m; the
    same holds the other way round.  A k-mer that one component alone holds can be shared by no pair: such ones come
    first in the order and need no place in the join.
    """
    r = least / (1 + least)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, comp, raw in zip(pdf["node"], pdf["comp"], pdf["hashes"], strict=True):
                _, lab, kinds = _loaded(raw, k)
                both = [lab.view("<i8"), kinds.view("<i8")]
                yield pd.DataFrame({"node": node, "comp": comp, "side": [0, 1], "size": [len(x) for x in both], "held": both})

    rows = nodes.join(hashed, "node").select("node", "comp", "hashes").mapInPandas(sets, "node long, comp long, side int, size long, held array<long>")
    rows = stored(rows.select("node", "comp", "side", "size", F.explode("held").alias("gram")), "grams")
    often = rows.groupBy("side", "gram").agg(F.count(F.lit(1)).alias("often"), (F.min("comp") != F.max("comp")).alias("meets"))
    place = F.row_number().over(Window.partitionBy("side", "node").orderBy("meets", "often", "gram")) - 1
    posts = rows.join(often, ["side", "gram"]).withColumn("place", place).where("meets")
    posts = posts.withColumn("reach", (F.col("size") - F.col("place")) / r - F.col("size") + 1e-6).where(F.col("reach") >= least * F.col("size"))
    posts = stored(posts.select("side", "gram", "node", "comp", "size", "reach"), "posts")
    # the larger text looks for smaller ones that reach up to it
    low = posts.where("reach >= size").groupBy("side", "gram").agg(F.min("size").alias("least_size"), F.max("reach").alias("most_reach"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    large = posts.join(low, ["side", "gram"]).where("(lo <> comp or hi <> comp) and least_size <= reach and most_reach >= size")
    large = large.select("side", "gram", *(F.col(c).alias(f"large_{c}") for c in ("node", "comp", "size", "reach")))
    meets = (F.col("comp") != F.col("large_comp")) & (F.col("size") <= F.col("large_size")) & (F.col("size") <= F.col("large_reach")) & (F.col("large_size") <= F.col("reach"))
    named = posts.withColumnsRenamed({"side": "s", "gram": "g"}).where("reach >= size")
    found = large.join(named, (F.col("side") == F.col("s")) & (F.col("gram") == F.col("g")) & meets)
    return found.select(F.least("node", "large_node").alias("a"), F.greatest("node", "large_node").alias("b")).distinct()


def _verified(pairs: DataFrame, hashed: DataFrame, k: int, least: float) -> DataFrame:
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lru_cache(32)(lambda raw: _loaded(raw, k))
        for pdf in batches:
            good = [aligned(load(x), load(y), least) >= least for x, y in zip(pdf["ha"], pdf["hb"], strict=True)]
            yield pdf.loc[good, ["a", "b"]]

    ha = hashed.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    hb = hashed.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(ha, "a").join(hb, "b").select("a", "b", "ha", "hb").mapInPandas(check, "a long, b long")


def keep_one(docs: DataFrame, k: int = 5, least: float = 0.8, tables: int = 20, depth: int = 4) -> DataFrame:
    """One row of each near-duplicate class, with all its columns: the one of the smallest doc_id (a row without an id
    only where no row of the class has one), and of those the one whose text's hash is smallest.

    Every row is a document, whatever its id: rows that share a doc_id go only where their texts are of one class.
    A null text is a class of its own, so such a row always stays.  An empty table stays empty; columns of any
    name, clashing ones too, pass through.
    """
    names, at, text = docs.columns, f"_c{position(docs, 'doc_id')}", f"_c{position(docs, 'text')}"
    rows = positional(docs)
    prep, member = _classes(take(docs, "doc_id", "text"), k, least, tables, depth)
    best = F.min(F.struct("nameless", "d", "t1", "t2")).alias("h")
    heads = prep.select(*NAME, "node").join(member.select("node", "comp"), "node").groupBy("comp").agg(best).select("h.*")
    # repeats of a row collapse before the shuffle; the join then finds its keys where they are
    one = rows.where(F.col(text).isNotNull()).select("*", *_name(at, text)).dropDuplicates(list(NAME))
    kept = one.join(heads, list(NAME), "left_semi").select(*rows.columns)
    return restored(kept.unionByName(rows.where(F.col(text).isNull())), names)
