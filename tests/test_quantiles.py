"""Quantiles by rank over several chunks, against numpy; all dimensions in one go."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelight.operators import metrics
from parcelight.operators.facts import Facts
from parcelight.operators.quantiles import array_quantile, chunked, counts, others_quantile, quantiles

SHARES = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


@pytest.fixture()
def many_chunks(spark):
    """Ranges stay apart, so that groups lie across several chunks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_quantiles_equal_numpy(spark, many_chunks):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.gauss(0, 50), float(rng.randint(0, 5)), None])) for _ in range(3000)] + [("one", 7.5), ("none", None), ("ties", 3.0), ("ties", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    held = chunked(counts(df, ["k"], "v"), ["k", "v"])
    assert held.select("chunk").distinct().count() >= 5 and held.where("k = 'a'").select("chunk").distinct().count() >= 2
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", SHARES).collect()}
    assert set(got) == {"a", "b", None, "one", "ties"}
    for k, r in got.items():
        values = [v for key, v in rows if key == k and v is not None]
        for name, q in SHARES.items():
            assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-9)
    assert got["ties"]["p90"] == 3.0
    whole = quantiles(df, [], "v", SHARES).collect()
    assert len(whole) == 1 and whole[0]["p99"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.99))
    assert quantiles(df.where("v is null"), [], "v", SHARES).count() == 0


def test_others_quantile_equals_numpy(spark, many_chunks):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaaabcd"), rng.choice([round(rng.gauss(0, 9), 1), 4.0, None])) for _ in range(4000)] + [("e", 1e6), ("f", -1e6), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.37, 0.9, 1.0):
        got = {r["k"]: r["x"] for r in others_quantile(df, "k", "v", q, "x").collect()}
        assert set(got) == set("abcdef")
        for k, x in got.items():
            assert x == pytest.approx(np.quantile([v for key, v in rows if key not in (k, None) and v is not None], q), abs=1e-9)
    assert others_quantile(df.where("k = 'a'"), "k", "v", 0.5).count() == 0
    assert others_quantile(df.limit(0), "k", "v", 0.5).count() == 0


def test_array_quantile(spark):
    df = spark.createDataFrame([([3.0, None, 1.0, 2.0],), ([],), ([5.0],)], "a array<double>")
    assert [r[0] for r in df.select(array_quantile(F.col("a"), 0.9)).collect()] == [pytest.approx(2.8), None, 5.0]


def test_breakdowns_equal_each_breakdown(spark):
    rng = random.Random(3)
    orders = [(f"O{i}", rng.choice(["delivered", "delivered", "cancelled", "unmapped"]), rng.choice(["W1", "W2"]), rng.choice(["C1", None]), rng.choice(["true", "false", "pending"]), rng.choice(["true", "not_computable"]), rng.choice([None, rng.random() * 90]), rng.random() < 0.2) for i in range(300)]
    o = spark.createDataFrame(orders, "order_id string, order_status string, warehouse_id string, carrier_id string, ot string, in_full string, duration_hours double, anomaly boolean").withColumn("otif", F.col("ot"))
    spans = spark.createDataFrame([(f"O{rng.randrange(300)}", rng.choice(["picking", "packing"]), rng.choice([None, rng.random()])) for _ in range(500)], "order_id string, interval_code string, hours double")
    f = Facts(o, spans, spans.select("order_id", "interval_code").distinct(), None, None, None, None)
    dims = ["warehouse_id", "carrier_id"]
    cols = ["group_key", *metrics.LONG, "warnings"]
    key = lambda r: (r["group_key"], r["code"])
    both = metrics.breakdowns(f, dims)
    for d in dims:
        want = sorted(metrics.breakdown(f, d).select(*cols).collect(), key=key)
        got = sorted(both.where(F.col("dimension") == d).select(*cols).collect(), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True)), (a, b)


def test_all_dimensions_are_summed_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "o")
    spark.range(100).selectExpr("cast(id % 3 as string) a", "cast(id % 2 as string) b", "id v").write.parquet(path)
    plan = metrics._sets(spark.read.parquet(path), ["a", "b"], [], [F.sum("v").alias("s")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
