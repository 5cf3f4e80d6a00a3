"""Secret scans with DataFrame functions alone.

Three fixed patterns give the base spans.  Beside them, two character Markov models (bigrams) of
random strings and of ordinary identifiers are compared: a token whose log-likelihood ratio per
step is at least ``threshold`` is a secret.  Both models are counted from labelled samples by
DataFrame operations; the tables have one entry per pair of alphabet characters, whatever the corpus.

Null texts count as empty and have no spans; texts are scanned whole; spans are code points, end
exclusive; repeated rows are scanned each.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import position, positional, restored, take

# The contract's patterns, with the letters of keywords in either case.
KINDS = ("assign", "access", "hex", "markov")
KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
# a run of fewer characters holds no match that starts later in it either, so the length can stand in the pattern
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"

#: Stems of the ordinary identifiers that the default samples are built from by rule.
STEMS = (
    "account action address agent array batch block buffer cache call channel check class client code column config content context count create current cursor data date "
    "default delete device document element entry error event field file filter format function group handler header image index input item key label layer length level "
    "list load local lock manager map matrix memory message method model module name network node number object offset option order output page parent parse path pattern "
    "player point policy process product queue range record region request resource response result route sample schema screen script search select server service session "
    "shard signal source stage state status storage stream string system table target task template text thread time title total trace type unit update user value vector version view widget window worker"
).split()


def sample_rows(n: int = 3000, seed: int = 7) -> list[tuple[str, bool]]:
    """Labelled samples (text, random boolean) from a seeded rule: strings drawn evenly from usual key
    alphabets, and identifiers, paths and constants joined from :data:`STEMS`."""
    rng = random.Random(seed)
    keys = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:36] + "234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    rows = [("".join(rng.choices(rng.choice(keys), k=rng.randint(20, 48))), True) for _ in range(n)]
    joins = (lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "_".join(w).upper(), lambda w: "".join(w), lambda w: "_".join(w) + str(rng.randint(0, 2030)))
    rows += [(rng.choice(joins)(rng.choices(STEMS, k=rng.randint(2, 5))), False) for _ in range(n)]
    return rows


def default_samples(spark: SparkSession, n: int = 3000, seed: int = 7) -> DataFrame:
    return spark.createDataFrame(sample_rows(n, seed), "text string, random boolean")


def train(samples: DataFrame, add: float = 0.5) -> list[int]:
    """Log-likelihood ratios of random against ordinary, in thousandths, one for each pair of :data:`ALPHABET`.

    Pairs of each label are counted with DataFrame functions; at most two rows per pair come back.
    Characters outside the alphabet are left out; ``add`` smooths unseen pairs.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2))))
    counts = samples.where("text is not null and random is not null and length(text) > 1").select("random", pair.alias("pair")).groupBy("random", "pair").count()
    return ratios({(r["random"], r["pair"]): r["count"] for r in counts.collect()}, add)


def ratios(counts: dict[tuple[bool, str], int], add: float = 0.5) -> list[int]:
    """The table of :func:`train` from counts per label and pair."""
    k, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    seen = {True: [0.0] * (k * k), False: [0.0] * (k * k)}
    for (y, pair), n in counts.items():
        a, b = (at.get(c) for c in pair)
        if a is not None and b is not None:
            seen[y][a * k + b] += n
    out = []
    for a in range(k):
        rows = {y: seen[y][a * k : a * k + k] for y in seen}
        total = {y: sum(rows[y]) + add * k for y in rows}
        out += [round(1000 * (math.log((rows[True][b] + add) / total[True]) - math.log((rows[False][b] + add) / total[False]))) for b in range(k)]
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(values: Column, block: int = 512) -> Column:
    """An array cut into arrays of ``block`` elements; none of an empty one."""
    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda i: F.slice(values, i * block + 1, F.lit(block)))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(values), 1, 0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of the associative ``op`` over integers.  An array that grows by one is copied each time, so
    blocks are folded alone and then moved on by the result of the blocks before: n times the block's size, not n squared."""
    last = lambda arr: F.get(arr, F.size(arr) - 1)
    none = F.array().cast("array<int>")
    fold = lambda arr: F.aggregate(arr, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(last(acc), x)).otherwise(x))))

    def moved(parts: Column) -> Column:
        return _let(fold(F.transform(parts, last)), lambda heads: F.flatten(F.transform(parts, lambda part, i: F.transform(part, lambda x: F.when(i > 0, op(F.get(heads, i - 1), x)).otherwise(x)))))

    return _let(F.transform(_blocks(values), fold), moved)


def _spans(kind: str, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Spans of the leftmost non-overlapping matches in ``text``.  The pieces between matches give the places."""
    rank, found = KINDS.index(kind), F.col(f"m_{kind}")
    gaps = F.slice(F.split("text", pattern, -1), 1, F.size(found))
    ends = _running(F.zip_with(gaps, found, lambda g, h: F.length(g) + F.length(h)), lambda x, y: x + y)

    def span(end: Column, hit: Column) -> Column:
        return F.when(keep(hit), F.struct((end - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return F.when(F.size(found) > 0, F.array_compact(F.zip_with(ends, found, span))).otherwise(none)


def _ratio(token: Column, table: Column) -> Column:
    """Sum of the table over a token's pairs, in thousandths."""
    k = len(ALPHABET)
    code = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    step = lambda acc, c: F.struct((acc["sum"] + F.when(acc["prev"] > 0, F.get(table, (acc["prev"] - 1) * k + c - 1)).otherwise(0)).alias("sum"), c.alias("prev"))
    return F.aggregate(code, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("prev")), step, lambda acc: acc["sum"])


def _clear_of(spans: Column, base: Column) -> Column:
    """The ``spans`` that touch none of ``base`` (by start): whole blocks of it are passed over by their bounds."""
    bound = lambda b: F.struct(b[0]["start"].alias("lo"), F.array_max(F.transform(b, lambda x: x["end"])).alias("hi"), b.alias("held"))
    meets = lambda m, b: (b["lo"] < m["end"]) & (m["start"] < b["hi"]) & F.exists(b["held"], lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"]))
    return _let(F.transform(_blocks(base, 64), bound), lambda blocks: F.filter(spans, lambda m: ~F.exists(blocks, lambda b: meets(m, b))))


def scan(docs: DataFrame, table: list[int], threshold: float = 0.4) -> DataFrame:
    """Adds to doc_id and text the spans: array of (start, rank, end, kind), by start, then kind as listed.

    A token that touches a base span gives no span of its own.  A null text counts as empty and has no span; repeated rows are
    scanned each; other columns are not read; an empty table gives an empty result.  Work grows with a text's length, also for a
    token or a number of spans as long as the text.
    """
    df = take(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return _scanned(df, table, threshold)


def _scanned(df: DataFrame, table: list[int], threshold: float) -> DataFrame:
    """``df`` with ``spans`` of its column ``text``; names that begin with ``m_``, ``base`` and ``more`` are taken."""
    own, model = df.columns, F.lit(table)
    df = df.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)))
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    always = lambda hit: F.lit(True)
    odd = lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (_ratio(hit, model) >= F.lit(round(1000 * threshold)) * (F.length(hit) - 1))
    base = F.array_sort(F.concat(_spans("assign", ASSIGN, long_enough), _spans("access", ACCESS, always), _spans("hex", HEX, always)))
    df = df.select(*own, base.alias("base"), _spans("markov", TOKEN, odd).alias("more"))
    free = F.when((F.size("base") > 0) & (F.size("more") > 0), _clear_of(F.col("more"), F.col("base"))).otherwise(F.col("more"))
    return df.select(*own, F.array_sort(F.concat("base", free)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", page: int = 4096) -> Column:
    """``text`` with each span, or run of spans that overlap, replaced by ``mark``; ``spans`` are in order of their starts.

    A place in a text is found by counting from its start, so the text is cut into pages once and each kept
    piece is taken from the pages that it lies on.
    """
    n = F.length(text)
    pages = F.transform(F.sequence(F.lit(0), F.floor(n / page).cast("int")), lambda i: F.substring(text, i * page + 1, F.lit(page)))

    def piece(held: Column, start: Column, end: Column) -> Column:
        a, b = F.floor(start / page).cast("int"), F.floor(end / page).cast("int")
        first = F.get(held, a)
        one = F.substring(first, start % page + 1, end - start)
        more = F.concat(F.substring(first, start % page + 1, F.lit(page)), F.array_join(F.slice(held, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.get(held, b), F.lit(1), end % page))
        return F.when(end <= start, "").when(a == b, one).otherwise(more)

    def cut(reach: Column) -> Column:
        """Starts and ends of the pieces that stay: before each run of spans, and after the last."""
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        opens = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.struct(before(i).alias("start"), s["start"].alias("end"))))
        tail = F.struct(F.get(reach, F.size(reach) - 1).alias("start"), n.alias("end"))
        return F.concat(F.array_compact(opens), F.array(tail))

    reach = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    kept = _let(reach, cut)
    joined_ = _let(pages, lambda held: F.array_join(F.transform(kept, lambda k: piece(held, k["start"], k["end"])), mark))
    return F.when(F.size(spans) == 0, text).otherwise(joined_)


def redact(docs: DataFrame, table: list[int], threshold: float = 0.4, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, and ``n_chars``, if there, counted anew for
    texts that changed.  All rows and other columns stay as they are; a null text stays null."""
    names, text = docs.columns, f"_c{position(docs, 'text')}"
    df = _scanned(positional(docs).withColumn("text", F.coalesce(F.col(text), F.lit(""))), table, threshold)
    found = F.size("spans") > 0
    df = df.withColumn(text, F.when(found, redacted(F.col("text"), F.col("spans"), mark)).otherwise(F.col(text)))
    if "n_chars" in names:
        count = f"_c{names.index('n_chars')}"
        df = df.withColumn(count, F.when(found, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(count)))
    return restored(df, names)
