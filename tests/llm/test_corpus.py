"""Sharding, records, top-k, near duplicates and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from parcelight.llm import neardup, queries, records, sharding, topk
from parcelight.llm.common import new_path
from parcelight.llm.decontaminate import words

SF = "/root/testdata/sf0.001"


def test_shards(spark):
    rng = random.Random(1)
    texts = ["t" * rng.randint(0, 900) + str(i) for i in range(1500)] + [None, "", "é" * 20] + ["same words"] * 40 + ["big" * 3000]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], 1, 2), (None, "no id", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, size int")
    got = sharding.shard(df, 8).collect()
    assert len(got) == len(rows)
    held = {}
    for r in got:
        t = texts[r["doc_id"]] if r["doc_id"] is not None else "no id"
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode())
        held.setdefault(t or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in held.values())
    by = {s: [r for r in got if r["shard"] == s] for s in range(8)}
    size = [sum(r["size"] for r in x) for x in by.values()]
    assert max(size) - min(size) <= 0.01 * sum(size) / 8 + 16
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))


def test_groups_are_whole_unless_a_split_is_asked_for(spark):
    rows = [(i, "copy" * 50) for i in range(300)] + [(1000 + i, f"other {i}" * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sharding.shard(df, 5).collect()
    home = {r["shard"] for r in whole if r["doc_id"] < 1000}
    assert len(whole) == 500 and len(home) == 1 and home.isdisjoint(r["shard"] for r in whole if r["doc_id"] >= 1000)
    load = [sum(r["size"] for r in whole if r["shard"] == s) for s in set(range(5)) - home]
    assert max(load) - min(load) <= 250
    got = sharding.shard(df, 5, split_above=1.0).collect()
    size = [sum(r["size"] for r in got if r["shard"] == s) for s in range(5)]
    assert len(got) == 500 and max(size) <= 1.15 * sum(size) / 5
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [(r["shard"], r["slot"]) for r in sharding.shard(one, 40).collect()] == [(0, 0)]
    assert sharding.shard(one.limit(0), 40).count() == 0


def plain_best_fit(sizes, capacity, most):
    """Bin of each item of a descending list, one item at a time, by looking at every bin."""
    rooms, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if not fits:
            if len(rooms) == most or s > capacity:
                return None
            rooms.append(capacity)
            fits = [(capacity, len(rooms) - 1)]
        b = min(fits)[1]
        rooms[b] -= s
        out.append(b)
    return out


def spread(runs, sizes):
    """Runs as a bin for each item of the descending list."""
    by = {}
    for s, first, end, b in runs:
        by.setdefault(s, {}).update(dict.fromkeys(range(first, end), b))
    seen, out = {}, []
    for s in sizes:
        out.append(by[s][seen.get(s, 0)])
        seen[s] = seen.get(s, 0) + 1
    return out


def test_runs_equal_plain_best_fit_decreasing():
    rng = random.Random(4)
    for top, n in ((99, 400), (9, 300), (5000, 60), (3, 50)):
        sizes = sorted((rng.randint(1, top) for _ in range(n)), reverse=True)
        counts = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        for capacity in (top, 2 * top + 1, sum(sizes) // 7 + 5):
            want = plain_best_fit(sizes, capacity, 10**6)
            assert spread(sharding.best_fit_decreasing(counts, capacity, 10**6), sizes) == want
            assert sharding.best_fit_decreasing(counts, capacity, max(want)) is None
        bins = spread(sharding.pack_shards(counts, 7), sizes)
        load = [sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(7)]
        assert max(load) - min(load) <= max(10, sizes[6])
    assert sharding.pack_shards([(50, 2), (3, 4)], 4) == [(50, 0, 1, 0), (50, 1, 2, 1), (3, 0, 2, 2), (3, 2, 4, 3)]
    assert sharding.pack_shards([], 3) == []


def test_shard_equals_plain_best_fit_decreasing(spark):
    rng = random.Random(9)
    texts = ["x" * rng.choice((3, 50, 50, 400)) + f"{rng.randrange(150):04d}" for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {}
    for t in texts:
        group[t] = group.get(t, 0) + len(t) + 16
    sizes = sorted(group.values(), reverse=True)
    got = {}
    for r in sharding.shard(df, 6, slot_rows=40, hot=20).collect():
        got.setdefault(r["shard"], set()).add(texts[r["doc_id"]])
    capacity = max(max(sizes), -(-sum(sizes) // 6))
    while (want := plain_best_fit(sizes, capacity, 6)) is None:
        capacity += 1
    bins = [sorted(s for s, b in zip(sizes, want, strict=True) if b == k) for k in range(6)]
    assert sorted(sorted(group[t] for t in held) for held in got.values()) == sorted(bins)


def test_records_round_trip(spark):
    texts = [None, "", "Hello, World", "naïve café " * 40, "日本語", "a" * 5000]
    rows = [(10 - i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (8, "tie", 1), (2**60, "large id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = tokenizer = queries.tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(tokenizer)
    got = sorted(records.round_trip(df, path).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for d, t in sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got] == want
    assert records.round_trip(df.limit(0), path).count() == 0


def test_records_random_access_and_damage(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    m = records.write_records(df, queries.tokenizer_file("word_bpe_49k.json"), new_path(spark, "records")).collect()
    file = records.Records(m[0]["path"])
    for k in random.Random(1).sample(range(len(file)), len(file)):
        d, ids = file[k]
        assert len(ids) // 4 == file.index[k, 2] and d is not None
    raw = bytearray(records.frame(7, np.array([1, 70000], "<u4").tobytes(), True))
    assert records.unframe(bytes(raw)) == (7, np.array([1, 70000], "<u4").tobytes())
    for k in range(len(raw)):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [list(map(float, rng.normal(0, 0.3, 6))) for _ in range(300)]
    vecs[10] = vecs[20] = vecs[30]
    rows = [(i, v, 1) for i, v in enumerate(vecs)] + [(400, None, 1), (401, [], 1), (402, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (403, [float("nan")] + [0.0] * 5, 1), (404, [float("inf")] + [0.0] * 5, 1), (405, [1.0, 2.0], 1), (406, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for qblock in (4096, 4):
        got = topk.top_k(df, df.where("vec_id % 10 = 0 or vec_id = 405 or vec_id = 406"), 5, query_block=qblock, block=64).collect()
        want = []
        for q in ok:
            if q % 10 == 0 or q in (405, 406):
                s = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
                want += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_counts_every_row_of_a_repeated_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 9, [float(x) for x in rng.integers(-9, 9, 3) / 256], i) for i in range(40)] + [(0, [0.0, 0.0, 0.0], 40), (1, [1 / 256, 0.0, 0.0], 41)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, RANK int").repartition(4)
    asked = spark.createDataFrame([rows[0], rows[9], rows[4]], "vec_id long, embedding array<double>, query_id int")
    q = lambda v: [int(np.floor(256 * x)) for x in v]
    want = []
    for i, v, _ in (rows[0], rows[9], rows[4]):
        best = sorted((-sum(a * b for a, b in zip(q(v), q(w), strict=True)), j) for j, w, _ in rows if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    for block in (4, 8192):
        assert sorted(tuple(r) for r in topk.top_k(df, asked, 5, block=block).collect()) == sorted(want)


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    v = np.zeros((5000, 4))
    v[:, 0] = rng.integers(-100, 100, 5000)
    v[7] = [5000, 0, 0, 0]
    b = topk.Block(np.arange(5000), np.arange(5000), v)
    calls = []
    b.vectors = type("Counting", (np.ndarray,), {"__getitem__": lambda self, k: (calls.append(np.size(k)), np.asarray(self)[k])[1]})(v.shape, v.dtype, v.copy())
    assert b.search(-1, np.array([1.0, 0, 0, 0]), 1, []) == [(-5000, 7, 7)]
    assert sum(calls) < 200


def lcs_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1]) if a or b else 0


def grams(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocab, k=rng.randint(8, 160)) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for k in (1, 2, 4):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].upper() + "!!", "", "", "...", "!!!", "one", "one two", "one two", None, None, "long " + " ".join(rng.choices(vocab, k=20000))]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "nobody here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    cls = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if a is None or b is None:
                continue
            ga, gb = grams(a), grams(b)
            same = ga == gb if ga or gb else a == b
            sa, sb = set(ga), set(gb)
            if same or (sa and sb and len(sa & sb) >= 0.8 * len(sa | sb) and lcs_similarity(ga, gb) >= 0.8):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    assert cls == {i: top(i) for i in range(len(texts))}
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(cls.values()))
    assert neardup.near_duplicates(df.limit(0)).count() == 0 == neardup.keep_one(df.limit(0)).count()


def test_one_row_of_a_class_stays_whatever_its_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(None, near, 1), (None, text, 2), (7, text, 3), (7, other, 4), (7, other, 5), (7, None, 6), (7, None, 7), (None, "all alone here", 8), (None, "all alone here", 9), (9, other, 10), (None, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, T1 int")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(df).collect())
    assert got == sorted([(7, text), (7, other), (7, ""), (7, ""), (0, "all alone here"), (0, "")])


def test_texts_without_an_id_meet_only_their_own_rows(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choices(vocab, k=30)) for _ in range(2000)]
    df = spark.createDataFrame([(None, t) for t in base] + [(None, t + " tail") for t in base], "doc_id long, text string")
    texts = df.select("doc_id", "text")
    prep, member = neardup._classes(texts, 5, 0.8, 20, 4)
    rows = member.select("node").withColumn("bucket", neardup.F.lit(1))
    nodes = prep.groupBy("node").agg(neardup.F.min(neardup.F.struct(*neardup.NAME)).alias("row"))
    wanted = rows.join(nodes.select("node", "row.*"), "node")
    assert texts.select(*neardup._name("doc_id", "text"), "text").join(wanted, list(neardup.NAME)).count() == 4000
    assert member.select("comp").distinct().count() == 2000


def test_a_star_of_edited_copies_is_one_class(spark):
    rng = random.Random(11)
    original = [f"o{i}" for i in range(100)]
    texts = [" ".join(original)]
    for i in range(3000):  # two edits cost ten k-mers of 96: 0.81 to the original, about 0.66 to another copy
        c = list(original)
        p = rng.randrange(5, 85)
        c[p], c[rng.randrange(p + 5, 95)] = f"x{i}", f"y{i}"
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = [neardup.similarity(*(neardup.word_hashes(words(texts[i])) for i in pair), 5, 0.0) for pair in ((0, 1), (0, 2), (1, 2))]
    assert min(near[:2]) >= 0.8 > near[2]
    assert {r["class_id"] for r in neardup.near_duplicates(df).collect()} == {0}


def test_repeated_passages_and_short_texts_equal_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for g in range(12):
        passage = [f"p{g}x{i}" for i in range(20)]
        texts += [" ".join(passage * n) for n in (1, 2, 10, 40)]
        texts.append(" ".join((passage[10:] + passage[:10]) * 5))
        texts.append(" ".join(passage[:-1] + ["edited"]) + " " + " ".join(passage * 20))
    for g in range(400):  # four and five k-mers
        short = [f"s{g}x{i}" for i in range(9)]
        texts += [" ".join(short), " ".join(short[:8])]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    made = [neardup.word_hashes(words(t)) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            # other families share no word
            if texts[i].split("x")[0] == texts[j].split("x")[0] and want[i] != want[j] and neardup.similarity(made[i], made[j], 5, 0.8) >= 0.8:
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert got == dict(enumerate(want))


def test_similarity_respects_order():
    h = lambda t: neardup.word_hashes(words(t))
    a = " ".join(f"w{i}" for i in range(100))
    b = " ".join(f"w{i}" for i in [*range(50, 100), *range(50)])
    assert neardup.similarity(h(a), h(a), 5, 0.8) == 1.0
    assert neardup.similarity(h(a), h(b), 5, 0.8) < 0.8
    assert len(set(neardup.word_hashes([b"a", b"b", b"ab", b"ba", b"a" * 9]).tolist())) == 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 5), (5, 21), *((100, 100 + i) for i in range(1, 40))]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[4] == 1 and got[11] == 10 and got[21] == 5 and got[139] == 100


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
            docs = corpus_pipeline.stored(out, f"test-{name}")
            sizes.append(docs.count())
    ids = {r["doc_id"] for r in docs.collect()}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == ids


def test_pipeline_equals_brute_force_and_holds_edges(spark):
    """Rows chosen so that each stage's decision is known: what goes, what stays, and what becomes of the text."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 300").first()["text"]
    plain = docs.collect()
    text = max((r["text"] for r in plain if r["text"]), key=len)[:4000]
    secret = "here the api_key = abcdEFGH12345678 and the end of it"
    extra = [(None, None), (None, ""), (1000, "12345 !!"), (1001, text), (1002, text + " tail"), (None, text), (1003, item), (None, item + " x"), (1004, secret), (1004, "the of and to a in is it that was for on with as his"), (None, secret), (1005, "word " * 200_000)]
    rows = [(i, t, "en", "s", None, f"row {k}") for k, (i, t) in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, DOC_ID_ string").withColumnRenamed("DOC_ID_", "Text ")
    trained = df.unionByName(docs.withColumn("Text ", neardup.F.lit("plain")).select(*(neardup.F.col(f"`{c}`").cast(df.schema[c].dataType) for c in df.columns)))
    names = [r["Text "] for r in corpus_pipeline.language_id(spark, trained, SF).collect()]
    assert {f"row {k}" for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)} <= set(names) and not {"row 0", "row 1", "row 2"} & set(names)
    named = lambda out: sorted(r["Text "] for r in out.collect())
    kept = corpus_pipeline.near_dedup(spark, df, SF)
    assert kept.columns == df.columns and named(kept) == sorted(f"row {k}" for k in (0, 1, 2, 3, 6, 8, 9, 11))
    clean = corpus_pipeline.decontamination(spark, df, SF)
    assert clean.columns == df.columns and named(clean) == sorted(f"row {k}" for k in range(12) if k not in (6, 7))
    safe = corpus_pipeline.secret_scans(spark, df, SF)
    assert safe.columns == df.columns and named(safe) == sorted(f"row {k}" for k in range(12))
    assert {r["Text "] for r in safe.collect() if "[SECRET]" in (r["text"] or "")} == {"row 8", "row 10"}
    packed = corpus_pipeline.best_fit_packing(spark, df, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in extra} and sum(r["piece"] == 0 for r in packed) == 12
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_top_k_of_components_beyond_doubles_and_longs(spark):
    rows = [(1, [2.0**44 + 1, 1.0]), (2, [2.0**44, 1.0]), (3, [5.0, 0.0]), (4, [1e300, 0.0]), (50, [1.0, 1.0]), (100, [2.0**50, 0.0]), (6, [-(2.0**50), 0.0]), (7, [2.0**49, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = {i: [int(256 * x) for x in v] for i, v in rows if i != 4}
    for q in (50, 100):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v)))), i) for i, v in ints.items() if i != q)
        assert got[q] == {k: (i, -s) for k, (s, i) in enumerate(scores[:4], 1)}


def test_records_of_many_rows_without_an_id(spark):
    df = spark.createDataFrame([(None if i % 10 else i, f"{i * 7919 % 40_000:05d} text") for i in range(40_000)], "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = records.write_records(df, queries.tokenizer_file("word_bpe_49k.json"), new_path(spark, "records"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_records"] for r in m.collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 20_000 and len(sizes) >= 4
    got = records.read_records(spark, m).orderBy("start").select("doc_id").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[:36_000] == [None] * 36_000 and ids[36_000:] == sorted(ids[36_000:])
