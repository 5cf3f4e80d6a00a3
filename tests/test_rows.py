"""Row identity, scenarios, status words, capabilities, and queries beside their SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelight.operators import browser, browser_mapping, facts, ingest, metrics, prep, simulate
from parcelight.plans import oracle, queries

SF = "/root/testdata/sf0.001"


def test_a_value_under_another_column_is_a_conflict(spark):
    rows = [("A", "T", None, 1), ("A", None, "T", 2), ("B", "T", None, 3), ("B", "T", None, 4), ("C", None, None, 5)]
    df = spark.createDataFrame(rows, "id string, promised string, actual string, source_index long")
    got = {r["id"]: (r["n"], r["conflict"], r["source_index"]) for r in prep.deduplicated(df, "id").collect()}
    assert got == {"A": (2, True, 1), "B": (2, False, 3), "C": (1, False, 5)}
    text = spark.createDataFrame([(2, "S", "2024-01-02 03:04", "x", None), (3, "S", "2024-01-02 03:04", None, "x")], "row_number long, s string, t string, loc string, car string")
    rows = text.withColumns({"raw": F.lit("已签收"), "id": F.lit("E1")})
    v = ingest.validate(rows, ingest.CONTRACTS["tracking_events"], {"id": "tracking_event_id", "s": "shipment_id", "t": "event_time", "raw": "raw_status", "loc": "location_code", "car": "carrier_id"})
    assert {(r["row_number"], r["code"]) for r in v.issues.collect()} == {(2, "DUPLICATE_KEY_CONFLICT"), (3, "DUPLICATE_KEY_CONFLICT")}
    assert v.valid.isEmpty() and not v.can_confirm()


def test_status_tiers(spark):
    texts = ["已签收", "POD_OK", "in_transit", "Mine", "？", "ｄｅｌｉｖｅｒｅｄ"]
    df = spark.createDataFrame([(i, t, "退件完成" if i == 4 else None) for i, t in enumerate(texts)], "i int, raw string, aux string")
    c = ingest.normalize_status("tracking_events", "raw", {"mine": "exception"}, auxiliary=("aux",))
    got = [tuple(r["s"]) for r in df.select("i", c.alias("s")).orderBy("i").collect()]
    assert got == [
        ("delivered", "builtin_exact", 0.98), ("delivered", "builtin_keyword_raw", 0.96), ("in_transit", "standard_code", 1.0), ("exception", "project_user", 1.0),
        ("returned", "auxiliary_keyword:aux", 0.96), ("delivered", "standard_code", 1.0),
    ]


def test_improvement_equals_a_full_evaluation(spark):
    """Moving events of evaluated facts gives what evaluating moved raw events gives."""
    tables = queries.registered(spark, SF)
    f = facts.evaluated(*tables)
    imp = simulate.Improvement("picking", 50, percent=True)
    moved, adjusted = simulate.improve(f, imp, True)
    cut = f.intervals.where("interval_code = 'picking'").groupBy("order_id").agg(F.min(F.struct("start_ts", "end_ts")).alias("i"))
    delta = adjusted.select("order_id", "reduction").join(cut, "order_id").select("order_id", "reduction", F.col("i.end_ts").alias("cutoff"))

    def back(df, time):
        late = F.coalesce(F.col(time).cast("timestamp") >= F.col("cutoff"), F.lit(False))
        return df.join(delta, "order_id", "left").withColumn(time, F.when(late, simulate.shift(F.col(time), -F.col("reduction"))).otherwise(F.col(time).cast("timestamp"))).select(*df.columns)

    again = facts.evaluated(back(tables[0], "actual_delivery_time"), back(tables[1], "event_time"), back(tables[2], "event_time"))
    rows = lambda x: sorted((r["code"], None if r["value"] is None else round(r["value"], 6), r["denominator"]) for r in metrics.build_metrics(x).collect())
    assert rows(moved) == rows(again)


def test_resample_draws_with_replacement_where_the_pool_is_small(spark):
    orders = spark.createDataFrame([(f"O{i}", "A" if i < 3 else "B", i) for i in range(23)], "order_id string, carrier_id string, source_index long")
    events = spark.createDataFrame([("e1", "O0", 1)], "event_id string, order_id string, source_index long")
    scans = events.withColumnRenamed("event_id", "tracking_event_id")
    out = simulate.resample_carriers((orders, events, scans), {"A": 60, "B": 40}, 5)[0]
    counts = {r["carrier_id"]: r["count"] for r in out.groupBy("carrier_id").count().collect()}
    assert counts == {"A": 14, "B": 9}
    b = [r["source_index"] for r in out.where("carrier_id = 'B'").collect()]
    assert len(set(b)) == 9 and {r["source_index"] for r in out.where("carrier_id = 'A'").collect()} <= {0, 1, 2}
    assert {r["carrier_id"] for r in simulate.small_pools(orders, 5).collect()} == {"A"}


def test_capabilities_name_what_is_missing(spark):
    o = spark.createDataFrame([("A", "unknown")], "order_id string, carrier_id string")
    t = spark.createDataFrame([("unmapped", "unknown")], "event_code string, location string")
    m = spark.createDataFrame([("ot_rate", None), ("anomaly_order_rate", 0.0)], "code string, value double")
    f = facts.Facts(o, None, None, None, None, None, t)
    got = {r["capability"]: (r["available"], r["reason"]) for r in browser.capabilities(m, f).collect()}
    assert got["anomaly"] == (True, None) and got["ot"][0] is False and got["carrier"] == (False, "needs a carrier") and len(got) == 9


def test_values_promote_and_cap_a_field():
    c = ingest.CONTRACTS["tracking_events"]
    best = lambda h, **p: browser_mapping.score(h, c, browser_mapping.Profile(**p))[0][:2]
    assert best("col7", n=50, distinct=50, date=0.9) == ("event_time", 0.91) and best("col7", n=50, distinct=5, date=0.9)[1] == 0.62
    assert best("扫描的时刻", n=50, distinct=5, date=0.9) == ("event_time", 0.94)
    row = dict((f, s) for f, s, _ in browser_mapping.score("row key", c, browser_mapping.Profile(n=9, distinct=4)))
    assert row["tracking_event_id"] <= 0.4
    assert dict((f, s) for f, s, _ in browser_mapping.score("预计扫描时间x", c, browser_mapping.Profile(n=9, distinct=9, date=1.0)))["event_time"] == 0.45


NAMES = ["csv_ragged", "csv_encodings", "xlsx_rows", "mapping_suggestions", "scalar_texts", "scalar_numbers", "wall_times", "warnings", "order_decisions", "intervals", "metrics_by_carrier", "findings", "sim_pickup", "fingerprints", "edge_scenario"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(oracle.sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    cell = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v
    norm = lambda d: sorted((tuple(map(cell, r)) for r in d[cols].astype(object).values.tolist()), key=str)
    assert norm(got) == norm(want)
