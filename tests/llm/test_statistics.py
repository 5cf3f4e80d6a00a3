"""Whitening and the filter audit against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from parcelight.llm import audit, whitening


def brute_whitening(vectors, k):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, vec = np.linalg.eigh(c.T @ c / n)
    values, vec = values[::-1], vec[:, ::-1]
    white = (x - s / n) @ (vec[:, :k] / np.sqrt(values[:k]))
    return n, ((n * x - s) ** 2).sum(1), white, values[:k] / values.sum()


@pytest.mark.parametrize("flat", [False, True])
def test_whitening_equals_a_whole_eigendecomposition(spark, flat):
    rng = np.random.default_rng(3)
    scale = np.ones(40) if flat else 0.6 ** np.arange(40) + 0.01
    vectors = (rng.standard_normal((500, 40)) * scale).astype("float32")
    vectors[100:160] = vectors[0]  # repeats count once in the statistics
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(900, None, "x"), (901, [], "x"), (902, [float("nan")] * 40, "x"), (903, [1.0, None] * 20, "x"), (904, [float("inf")] * 40, "x"), (905, [1e300] * 40, "x"), (906, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, Component string").repartition(6)
    n, deviation, white, explained = brute_whitening(vectors, 4)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(got) == list(range(500))
    sign = [np.sign(got[0][j + 1]["whitened"]) * np.sign(white[0, j]) for j in range(4)]
    for i, by in got.items():
        assert sorted(by) == [1, 2, 3, 4]
        for j, r in by.items():
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert r["whitened"] == pytest.approx(sign[j - 1] * white[i, j - 1], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[j - 1], rel=1e-9)
            assert r["identity_error"] < 1e-9
    model = whitening.fit_whitener(whitening.quantized(df).select("x").distinct())
    assert model.whole == flat


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [-0.001, 0.0])], schema)).collect()
    assert {r["component"] for r in line} == {1, 2} and sum(r["vec_id"] is None for r in line) == 2
    same = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in same} == {1} and same[0]["explained"] == pytest.approx(1)


def test_exact_sums_and_deviations_beyond_doubles(spark):
    x = [[2**61 + 1, -3], [2**61 + 7, 5], [-(2**60) - 1, 1]] * 3
    n, sums = whitening.exact_sums(spark.createDataFrame([(v,) for v in x], "x array<long>"))
    assert (n, sums) == (9, [sum(v[0] for v in x), sum(v[1] for v in x)])
    assert whitening.deviations(np.array([[2**61, 0], [5, 7]]), 2, [10, 13]) == [None, 1]
    assert whitening.deviations(np.array([[5, 7]]), 2, [9, 13]) == [2]


def brute_audit(docs, labels):
    good, bad = {}, {}
    for i, q, t in labels:
        if i is not None:
            good[i], bad[i] = good.get(i, False) or q == 1, bad.get(i, False) or t == 1
    fails = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in docs)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller})
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(f, d[0]) for f, d in zip(fails, docs, strict=True) if (d[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = mine, []
            for k, f in enumerate(order, 1):
                here = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                removed[f] += len(here)
                row = [len(left), len(here), sum(m[0][f] for m in gone), sum(m[0][f] and sum(m[0].values()) == 1 for m in mine)]
                out[part, "".join(order), k] = [*row, sum(good.get(m[1], False) for m in here), sum(bad.get(m[1], False) for m in here)]
                gone = gone + here
        for (p, order, k), row in out.items():
            if p == part:
                row.append(removed[order[k - 1]])
    return out


def test_filter_audit_equals_every_order_applied(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "g#mma", "DELTA", "épsilon", "zeta eta", "&", "theta"] + [f"w{i}" for i in range(60)]
    texts = [None, "", "A" * 30, "\t\n\x0b plain"] + [rng.choice([" ", "\n", " \t"]).join(rng.choices(words[: rng.choice([3, 8, 68])], k=rng.choice([5, 49, 50, 51, 70]))) for _ in range(40)]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2", "S1"])) for _ in range(150)]
    docs += [(None, texts[9], "hot")] * 40 + [(7, texts[9], "hot")] * 5
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(50)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n long, PART string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in audit.MEASURES] for r in audit.filter_audit(df, lab).collect()}
    assert got == brute_audit(docs, labels)
    assert audit.filter_audit(df.limit(0), lab).count() == 0
    assert audit.filter_audit(df, lab.limit(0)).where("good_lost > 0").count() == 0


def test_lattice_has_80_edges_and_600_steps():
    assert len(audit.edges()) == 80 and len(audit.steps()) == 600
    through = {}
    for _, _, applied, f in audit.steps():
        through[applied, f] = through.get((applied, f), 0) + 1
    assert through == {(s, f): w for s, f, w in audit.edges()}


def test_long_text_is_judged_whole(spark):
    text = "word " * 200_000 + "#"
    row = audit.failures(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    assert row["fails"] == 2 + 8
