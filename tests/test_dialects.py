"""Edge dialect, teaching cases, file-wide date order and header mapping of the browser dialect."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelight.functions import dates
from parcelight.operators import browser_mapping as bm
from parcelight.operators import edge, facts, metrics
from parcelight.operators.ingest import CONTRACTS
from parcelight.sources import cases


def file_of(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


@pytest.mark.parametrize(
    ("texts", "order", "ambiguous", "counts"),
    [
        (("13/2/2026", "3/4/2026"), "DMY", False, (1, 0, 1)),
        (("2/13/2026 3:05 PM", "3/4/2026"), "MDY", False, (0, 1, 1)),
        (("3/4/2026 3:05 pm",), "MDY", False, (0, 1, 0)),
        (("13/2/2026", "2/13/2026"), None, True, (1, 1, 0)),
        (("3/4/2026", "5/5/2026"), None, True, (0, 0, 1)),
        (("2026-01-02", None, "", "5/5/2026", "3-4-2026"), None, False, (0, 0, 0)),
        ((), None, False, (0, 0, 0)),
    ],
)
def test_date_order_is_decided_over_the_file(spark, texts, order, ambiguous, counts):
    assert dates.infer_date_order(file_of(spark, *texts), "t") == dates.DateOrder(order, ambiguous, *counts)


def test_dates_of_a_file(spark):
    expect = {
        "3/4/2026": (None, dt.date(2026, 4, 3), "date", None), "3-4-2026 08:30": (dt.datetime(2026, 4, 3, 0, 30), None, "minute", None), "4/13/2026": (None, dt.date(2026, 4, 13), "date", None),
        "4/3/2026 12:05 AM": (dt.datetime(2026, 4, 2, 16, 5), None, "minute", None), "2026年6月1日 9:00": (dt.datetime(2026, 6, 1, 1, 0), None, "minute", None), "2026.6.1": (None, dt.date(2026, 6, 1), "date", None),
        "Mon 01-Jun-2026 10:00:05": (dt.datetime(2026, 6, 1, 2, 0, 5), None, "second", None), "2026-06-01T10:00:00+02:00": (dt.datetime(2026, 6, 1, 8), None, "second", None), "31/2/2026": (None, None, None, "INVALID_DATETIME"),
        "2026-02-30 10:00": (None, None, None, "INVALID_DATETIME"), "hello": (None, None, None, "INVALID_DATETIME"), "": (None, None, None, None), "  ": (None, None, None, None),
    }
    df = dates.with_import_dates(file_of(spark, *expect), "t", "Asia/Shanghai", "DMY", out="p")
    for r in df.select("t", F.date_format("p.value", "yyyy-MM-dd HH:mm:ss").alias("v"), "p.day", "p.precision", "p.error").collect():
        value, day, precision, error = expect[r["t"]]
        assert (r["v"], r["day"], r["precision"], r["error"]) == (value and value.strftime("%Y-%m-%d %H:%M:%S"), day, precision, error), r["t"]


def test_undecided_date_needs_the_order(spark):
    rows = dates.with_import_dates(file_of(spark, "3/4/2026", "5/5/2026", None), "t", "UTC", out="p").select("t", "p.day", "p.error").collect()
    assert {r["t"]: (r["day"], r["error"]) for r in rows} == {"3/4/2026": (None, "DATE_ORDER_REQUIRED"), "5/5/2026": (dt.date(2026, 5, 5), None), None: (None, None)}


@pytest.fixture(scope="module")
def promotion(spark):
    case = cases.customized("promotion_surge", orders=400)
    return case, tuple(t.cache() for t in cases.generate(spark, case))


def test_case_is_sound_and_repeats(spark, promotion):
    case, tables = promotion
    assert [t.count() for t in tables] == [400, 3600, 3600]
    assert cases.faults(tables).count() == 0
    again = cases.generate(spark, case)
    assert all(a.exceptAll(b).count() == 0 for a, b in zip(tables, again, strict=True))
    other = cases.generate(spark, cases.customized("promotion_surge", seed=1, orders=400))
    assert tables[0].exceptAll(other[0]).count() > 0


def test_case_keeps_its_ranges(promotion):
    case, tables = promotion
    rows = cases.range_check(case, metrics.build_metrics(facts.evaluate(*tables))).collect()
    assert {r["code"] for r in rows} == set(case.expected)
    assert all(r["within"] for r in rows), rows


def test_slow_carrier_has_exceptions(spark):
    orders, _, tracking = cases.generate(spark, cases.CASES["carrier_disruption"])
    hit = tracking.where("event_code = 'exception'").select("order_id", "carrier_id", "sequence_number").collect()
    assert hit and {r["carrier_id"] for r in hit} == {"CAR-SYN-SLOW"} and {r["sequence_number"] for r in hit} == {5}
    assert tracking.count() == 9 * orders.count() + len(hit)


def test_case_needs_orders(spark):
    with pytest.raises(ValueError, match="30"):
        cases.generate(spark, cases.customized("normal_operations", orders=29))


def test_edge_decisions_and_metrics(spark):
    T = dt.datetime(2026, 1, 1)
    h = lambda n: T + dt.timedelta(hours=n)
    rows = [
        ("a", 1, "delivered", T, h(70), h(60), 2.0, 2.0, "C1"), ("b", 2, "delivered", T, h(70), h(82), 2.0, 1.0, "Carrier-C"), ("c", 3, "returned", T, h(70), h(70), 2.0, 2.0, "C1"), ("d", 4, "shipped", T, h(70), None, 2.0, None, None), ("e", 5, "delivered", None, None, h(1), None, 2.0, "C1"),
    ]
    o = spark.createDataFrame(rows, "order_id string, source_index long, order_status string, created_ts timestamp, promised_ts timestamp, actual_ts timestamp, ordered double, delivered double, carrier_id string")
    d = edge.decided(o)
    got = {r["order_id"]: sorted(r["reasons"]) for r in d.collect()}
    assert got == {"a": [], "b": ["carrier_delay", "fulfillment_long_tail", "late_delivery", "partial_delivery"], "c": ["returned_order"], "d": [], "e": []}
    m = {r["code"]: r for r in edge.metrics(d).collect()}
    assert (m["ot_rate"]["value"], m["ot_rate"]["pending"], m["ot_rate"]["coverage"]) == (0.6667, 2, 0.6)
    assert (m["anomaly_order_rate"]["value"], m["fulfillment_duration_mean_hours"]["value"]) == (0.4, 70.67)
    assert {r["rule_id"]: r["affected"] for r in edge.findings(d).collect()} == {"FL-WH-001": 1, "FL-CR-001": 1, "FL-OT-001": 1}
    assert [r["order_id"] for r in edge.examples(d, "late_delivery").collect()] == ["b"]
    empty = {r["code"]: r["value"] for r in edge.metrics(d.where("false")).collect()}
    assert len(empty) == 7 and set(empty.values()) == {None}


def test_values_promote_headers(spark):
    rows = [(f"SF{100 + i // 4}", "2026-01-0%d 10:00" % (1 + i % 9), ("已揽收", "运输中", "派送中", "已签收")[i % 4], "顺丰" if i < 8 else "中通", "note") for i in range(16)]
    df = spark.createDataFrame(rows, "`运单 编号` string, `发生时间` string, `物流动态` string, `快递公司` string, `备注` string")
    known = bm.collected(df)
    assert known["运单 编号"].n == 16 and known["运单 编号"].distinct == 4 and known["物流动态"].status == 1.0 and known["发生时间"].date == 1.0
    got = {s.source: s for s in bm.suggest(df.columns, CONTRACTS["tracking_events"], known)}
    assert {k: s.field for k, s in got.items()} == {"运单 编号": "shipment_id", "发生时间": "event_time", "物流动态": "raw_status", "快递公司": "carrier_id", "备注": None}
    assert bm.detect_type(df.columns, CONTRACTS, known)[0][0] == "tracking_events"
    assert bm.ignorable(list(got.values()), {k: s.field for k, s in got.items() if s.field}, CONTRACTS["tracking_events"]) == ["备注"]


def test_promised_time_and_repeated_keys_are_held_down():
    c = CONTRACTS["tracking_events"]
    assert dict((f, s) for f, s, _ in bm.score("预计扫描时间 x", c, bm.Profile(9, 9, date=1.0)))["event_time"] <= 0.45
    assert dict((f, s) for f, s, _ in bm.score("事件编号x", c, bm.Profile(9, 3, id=1.0)))["tracking_event_id"] <= 0.4
    assert bm.edit_similarity("", "") == 1.0 and bm.edit_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7)


def test_profiles_of_an_empty_file(spark):
    r = bm.profiles(spark.createDataFrame([], "a string, b string")).collect()
    assert [(x["column"], x["n"], x["unique"]) for x in r] == [("a", 0, 0.0), ("b", 0, 0.0)]
