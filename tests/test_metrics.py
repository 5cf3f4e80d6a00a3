"""Hand-computed orders and events: decisions, intervals, metrics, filters."""

import datetime as dt

import pytest

from parcelight.contract import resolve_rules
from parcelight.operators import dashboard, diagnostics, facts, metrics, prep, simulate

T0 = "2026-01-0{}T{:02d}:00:00+08:00"


def order(i, status, promised, actual, q=10.0, d=10.0, unit="piece", wh="W1", car="C1", created="2026-01-01T08:00:00+08:00", place=None):
    return (i, created, promised, actual, q, d, unit, status, status, wh, car, "R", "S", place if place is not None else ord(i[-1]))


ORDERS = [
    order("A", "delivered", "2026-01-03T08:00:00+08:00", "2026-01-03T08:00:00+08:00"),  # equality is on time
    order("B", "delivered", "2026-01-03T08:00:00+08:00", "2026-01-03T09:00:00+08:00"),
    order("C", "delivered", "2026-01-03T08:00:00+08:00", "2026-01-02T08:00:00+08:00", d=9.0),
    order("D", "returned", "2026-01-03T08:00:00+08:00", "2026-01-02T20:00:00+08:00"),
    order("E", "delivered", None, "2026-01-02T08:00:00+08:00"),
    order("F", "delivered", "2026-01-03T08:00:00+08:00", "2026-01-02T08:00:00+08:00", unit=" "),
    order("G", "cancelled", None, None, car=None),
    order("H", "unmapped", None, None, wh=" "),
    order("I", "delivered", "2026-01-03T08:00:00", "2025-12-31T08:00:00Z"),  # no offset: no promise; negative duration
]
WH = [("w1", "A", "2026-01-01T09:00:00+08:00", "picking_started"), ("w2", "A", "2026-01-01T10:30:00+08:00", "picking_completed"), ("w3", "A", "2026-01-01T12:00:00+08:00", "ready_to_ship"), ("w4", "B", "2026-01-01T09:00:00+08:00", "picking_completed"),
      ("w5", "B", "2026-01-01T10:00:00+08:00", "picking_started"), ("w6", "B", "2026-01-01T11:00:00+08:00", "picking_completed"), ("w7", "X", "2026-01-01T11:00:00+08:00", "picking_started"), ("w8", "C", "2026-01-01T07:00:00+08:00", "picking_started"), ("w9", "C", "no time", "picking_started"), ("", "C", "2026-01-01T11:00:00+08:00", "picking_started")]
TR = [("t1", "A", "S1", "2026-01-01T13:00:00+08:00", "carrier_picked_up", "L"), ("t2", "A", "S1", "2026-01-01T20:00:00+08:00", "arrived_at_hub", "HUB"), ("t3", "A", "S1", "2026-01-01T22:00:00+08:00", "departed_hub", "HUB"), ("t4", "A", "S1", "2026-01-03T08:00:00+08:00", "delivered", "L"),
      ("t5", "D", None, "2026-01-01T13:00:00+08:00", "exception", None), ("t5", "D", None, "2026-01-01T13:00:00+08:00", "exception", None), ("t6", "B", "S2", "2026-01-01T13:00:00+08:00", "in_transit", "L"), ("t6", "B", "S2", "2026-01-01T14:00:00+08:00", "in_transit", "L")]


@pytest.fixture(scope="module")
def tables(spark):
    o = spark.createDataFrame(ORDERS, "order_id string, created_at string, promised_delivery_time string, actual_delivery_time string, ordered_quantity double, delivered_quantity double, quantity_unit string, order_status string, raw_order_status string, warehouse_id string, carrier_id string, destination_region string, sales_channel string, source_index long")
    w = spark.createDataFrame([(a, b, c, d, "W1", i) for i, (a, b, c, d) in enumerate(WH)], "event_id string, order_id string, event_time string, event_code string, warehouse_id string, source_index long")
    t = spark.createDataFrame([(*r, i) for i, r in enumerate(TR)], "tracking_event_id string, order_id string, shipment_id string, event_time string, event_code string, location_code string, source_index long").selectExpr("*", "cast(null as bigint) sequence_number")
    return o, w, t


@pytest.fixture(scope="module")
def f(tables):
    return facts.kept(facts.evaluate(*tables))


def test_decisions(f):
    got = {r["order_id"]: (r["ot"], r["in_full"], r["otif"], r["duration_hours"]) for r in f.orders.collect()}
    assert got["A"] == ("true", "true", "true", 48.0) and got["B"][:3] == ("false", "true", "false")
    assert got["C"][:3] == ("true", "false", "false") and got["E"][:3] == ("not_computable", "true", "not_computable")
    assert got["F"][:3] == ("true", "not_computable", "not_computable") and got["G"][:3] == ("excluded",) * 3
    assert got["H"][:3] == ("pending",) * 3 and got["I"][0] == "not_computable" and got["I"][3] is None


def test_intervals_and_warnings(f):
    got = {(r["order_id"], r["interval_code"]): r["hours"] for r in f.intervals.collect()}
    assert got[("A", "picking")] == 1.5 and got[("B", "picking")] == 1.0 and got[("A", "ready_to_pickup")] == 1.0
    assert got[("A", "hub_dwell")] == 2.0 and got[("A", "carrier_transit")] == 43.0
    codes = {(r["code"], r["order_id"], r["event_id"]) for r in f.warnings.collect()}
    for c in (("ORPHAN_EVENT", "X", "w7"), ("EVENT_BEFORE_ORDER_CREATED", "C", "w8"), ("INVALID_EVENT_TIME", "C", "w9"), ("EVENT_ID_MISSING", "C", None), ("EXACT_DUPLICATE_EVENT", None, "t5"), ("DUPLICATE_EVENT_CONFLICT", None, "t6"), ("NODE_END_BEFORE_START", "B", None), ("MULTIPLE_NODE_CYCLES", "B", None), ("NEGATIVE_FULFILLMENT_DURATION", "I", None)):
        assert c in codes, c


def test_metrics(f):
    m = {r["code"]: r for r in metrics.build_metrics(f).collect()}
    assert len(m) == 36 and m["order_count"]["value"] == 9 and m["ot_rate"]["value"] == 4 / 5 and m["ot_rate"]["coverage"] == 5 / 7
    assert m["otif_rate"]["value"] == 2 / 4 and m["anomaly_order_rate"]["numerator"] == 2 and m["cancellation_rate"]["value"] == 1 / 9
    assert m["node_duration_picking_mean_hours"]["value"] == 1.25 and m["node_duration_packing_mean_hours"]["value"] is None
    groups = metrics.breakdown(f, "warehouse_id").where("code = 'valid_order_count'").collect()
    assert {r["group_key"]: r["value"] for r in groups} == {"W1": 8.0, "unknown": 1.0}
    assert sum(r["n"] for r in metrics.histogram(f.orders.select("duration_hours"), "duration_hours", 4).collect()) == 6


def test_quantiles_and_single_bin(spark):
    one = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [(r["lower"], r["upper"], r["n"]) for r in metrics.histogram(one, "v", 5).collect()] == [(3.0, 3.0, 2)]
    assert metrics.histogram(one.where("v > 9"), "v", 5).collect() == []
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 100.0), ("b", 200.0), ("c", 5.0)], "k string, v double")
    got = {r["k"]: r["peer_p90"] for r in diagnostics.others_quantile(rows, "k", "v", 0.9).collect()}
    import numpy as np
    for k in "abc":
        assert got[k] == pytest.approx(np.quantile([r["v"] for r in rows.collect() if r["k"] != k], 0.9))


def test_order_duplicates(spark, tables):
    o = tables[0]
    more = o.unionByName(o.where("order_id = 'A'").selectExpr(*[c if c != "source_index" else "999L source_index" for c in o.columns])).unionByName(o.where("order_id = 'B'").selectExpr(*["7.0D ordered_quantity" if c == "ordered_quantity" else c for c in o.columns])).unionByName(o.where("order_id = 'C'").selectExpr(*["' ' order_id" if c == "order_id" else c for c in o.columns]))
    p = prep.prepare_orders(more)
    assert p.totals.first().asDict() == {"total": 10, "invalid": 2}
    assert {r["code"] for r in p.warnings.collect()} == {"ORDER_ID_MISSING", "DUPLICATE_ORDER_CONFLICT", "EXACT_DUPLICATE_ORDER"}
    assert "B" not in {r["order_id"] for r in p.valid.collect()}


def test_filters_and_sorting(f):
    assert dashboard.filtered(f, dashboard.Filters()) is f
    g = dashboard.filtered(f, dashboard.Filters(carrier_id=(" C1 ",), order_status=("delivered",), start=dt.date(2026, 1, 1)))
    assert g.totals.first()["total"] == 6
    assert {r["order_id"] for r in dashboard.filtered(f, dashboard.Filters(anomaly_types=("partial_delivery",))).orders.collect()} == {"C"}
    ids = [r["order_id"] for r in dashboard.sort_orders(f.orders, "duration_hours", True).collect()]
    assert ids[:2] == ["B", "A"] and ids[-3:] == ["G", "H", "I"]
    with pytest.raises(ValueError):
        dashboard.Filters(start=dt.date(2026, 1, 2), end=dt.date(2026, 1, 1))


def test_rules_and_rollups(f):
    rules = resolve_rules({"FL-PU-001": {"threshold_hours": 0.5}, "FL-WH-001": {"picking_threshold_hours": 1}})
    ev = diagnostics.analyze(f, rules)
    rows = {(r["rule_id"], r["finding"], r["order_id"]) for r in ev.collect()}
    assert ("FL-PU-001", "ready_to_pickup", "A") in rows and ("FL-WH-001", "picking", "A") in rows and ("FL-WH-001", "picking", "B") not in rows
    assert ("FL-DQ-001", "TERMINAL_EVENT_MISSING", "B") in rows and ("FL-DQ-001", "TERMINAL_EVENT_MISSING", "A") not in rows
    assert diagnostics.severity_summary(ev).count() == 4
    with pytest.raises(ValueError):
        resolve_rules({"FL-PU-001": {"threshold_hours": 9999}})


def test_scenarios(tables):
    same = simulate.run(tables, simulate.Scenario()).comparison.collect()
    assert len(same) == 7 and all(r["difference"] in (0, None) for r in same)
    r = simulate.run(tables, simulate.Scenario(pickup=simulate.Improvement("ready_to_pickup", 9)))
    assert [(x["order_id"], x["reduction"]) for x in r.adjustments.collect()] == [("A", 1.0)]
    assert {x["code"]: x["difference"] for x in r.comparison.collect()}["fulfillment_duration_mean_hours"] < 0
    assert simulate.allocate(7, {"a": 50, "b": 50}) == {"a": 4, "b": 3}
    o = simulate.resample_carriers(tables, {"C1": 100}, 3)[0]
    assert o.count() == 9 and o.where("order_id like 'SIM-%'").count() == 8
