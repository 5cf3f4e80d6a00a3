"""What is stored and what is moved: events once, tables by order, steps on an order without a shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from parcelight.contract import resolve_rules
from parcelight.functions.scalars import is_empty
from parcelight.operators import diagnostics, facts, prep
from parcelight.plans import more_queries, queries
from parcelight.sources import shared

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at(hours):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours)


def test_times_and_strings_are_the_same_when_read_again(spark):
    rows = [("A", dt.datetime(1200, 1, 1, 0, 0, 1), 1), ("B", dt.datetime(2026, 1, 2, 3, 4, 5, 678901), 2), (None, None, None)]
    df = spark.createDataFrame(rows, "order_id string, at timestamp, n long")
    want = sorted(map(str, df.collect()))
    one, two = shared.stored(df, "kept"), shared.stored(shared.dealt(df, "order_id"), "kept-by", "order_id")
    assert sorted(map(str, one.collect())) == want and sorted(map(str, two.collect())) == want and one.columns == two.columns == df.columns
    assert all(f.endswith(".zstd.parquet") for f in one.inputFiles())
    assert "Exchange" in plan(one.groupBy("order_id").count()) and "Exchange" not in plan(two.groupBy("order_id").count())


def test_events_are_stored_once_and_by_order(spark, monkeypatch):
    seen, held = [], facts.stored
    monkeypatch.setattr(facts, "stored", lambda df, *more: seen.append(held(df, *more)) or seen[-1])
    tables = queries.registered(spark, SF)
    assert not any("/warehouse-" in f or "/tracking-" in f for t in tables for f in t.inputFiles())
    f = facts.evaluated(*tables)
    for name, rows in (("event_id", f.warehouse), ("tracking_event_id", f.tracking)):
        n = rows.count()
        assert len([s for s in seen if name in s.columns and s.count() >= n]) == 1
        assert "Exchange" not in plan(rows.groupBy("order_id", "event_code").count())
    assert "Exchange" not in plan(f.eligible) and "Exchange" not in plan(f.orders.groupBy("order_id").count())


def test_an_end_between_the_first_and_the_last_is_found(spark):
    row = lambda key, start, h: (key, "x", start, at(h))
    rows = [row(k, s, h) for k in ("A", None) for s, h in ((True, 10), (True, 30), (False, 5), (False, 12), (False, 20))]
    rows += [row("B", True, 10), row("B", False, 5), row("B", False, 11), row("C", True, 10), row("C", False, 5), row("D", False, 5), row("E", True, 1), row("E", False, 1), row("E", False, 9)]
    df = spark.createDataFrame(rows, "order_id string, interval_code string, start boolean, event_ts timestamp")
    for keep in (prep.whole, lambda d, by=None: shared.stored(d, "pairs", by)):
        got = {r["order_id"]: (r["hours"], r["boundary_missing"], r["end_before_start"], r["many_cycles"]) for r in facts.pair(df, ["order_id"], keep).collect()}
        assert got == {"A": (2.0, False, True, True), None: (2.0, False, True, True), "B": (1.0, False, True, True), "C": (None, False, True, False), "D": (None, True, False, False), "E": (0.0, False, False, True)}
    assert "ObjectHashAggregate" not in plan(facts.pair(df, ["order_id"])) and "collect" not in plan(facts.pair(df, ["order_id"]))


def test_keys_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(prep.F, "xxhash64", lambda *c: F.lit(1).cast("long") + F.length(F.concat_ws("", *c)) * 0)
    df = spark.createDataFrame([("A", "x", 1), ("B", "x", 2), ("C", "x", 3), ("C", "y", 4), ("D", None, 5), ("D", None, 6)], "id string, v string, source_index long")
    for keep in (prep.whole, lambda d, by=None: shared.stored(d, "keys", by)):
        got = {r["id"]: (r["n"], r["conflict"], r["source_index"]) for r in prep.deduplicated(df, "id", keep).collect()}
        assert got == {"A": (1, False, 1), "B": (1, False, 2), "C": (2, True, 3), "D": (2, False, 5)}


def test_events_without_an_order_are_orphans_and_order_is_that_of_usable_events(spark):
    o = spark.createDataFrame([("A", at(0))], "order_id string, created_ts timestamp")
    rows = [("1", "A", at(5), 1), ("2", None, at(1), 2), ("3", "X", at(1), 3), ("4", "A", at(-9), 4), ("5", "A", at(4), 5), ("6", "A", at(6), 6)]
    e = spark.createDataFrame(rows, "event_id string, order_id string, event_time timestamp, source_index long").withColumn("event_code", F.lit("c"))
    for keep in (prep.whole, lambda d, by=None: shared.stored(d, "step", by)):
        kept, warnings = prep.prepare_events(e, "event_id", o, keep)
        assert {r["event_id"]: r["out_of_order"] for r in kept.collect()} == {"1": False, "5": True, "6": False}
        assert {(r["code"], r["event_id"]) for r in warnings.collect()} == {("ORPHAN_EVENT", "2"), ("ORPHAN_EVENT", "3"), ("EVENT_BEFORE_ORDER_CREATED", "4"), ("SOURCE_EVENT_OUT_OF_ORDER", "5")}


def test_evidence_is_by_order_and_transitions_are_taken_once(spark):
    f, evidence = queries._analysis(spark, SF)
    assert "Exchange" not in plan(diagnostics.affected_orders(evidence))
    assert plan(diagnostics.data_quality(f, resolve_rules()["FL-DQ-001"])).count("Window [") == 1


def test_blank_texts_are_told_by_their_first_character_or_in_full(spark):
    texts = ["a", " a", "", " ", "　\t", " x", "~", "!", "\x7f", "\x1f", "订", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(is_empty("t")).collect()] == [t is None or not t.strip() for t in texts]
    assert "ascii" in plan(df.where(~is_empty("t")))


def test_adjustments_alone_store_nothing_but_facts(spark, monkeypatch):
    queries._facts(spark, SF)
    monkeypatch.setattr(shared, "new_path", lambda *a: 1 / 0)
    monkeypatch.setattr(more_queries, "stored", lambda *a: 1 / 0)
    assert more_queries.pickup_by_carrier(spark, SF).count() > 0
