"""Registered queries of what works by ranks, grouping sets and keyed state."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import COMPLETED, UNKNOWN, resolve_rules
from ..functions.scalars import attach_zone, is_empty
from ..functions.text import unfolded
from ..operators import dashboard, diagnostics, ingest, metrics, report
from ..operators.quantiles import others_quantile
from ..sources import store
from ..sources.shared import new_path
from ..streaming import intervals
from ..streaming.sink import run_stream, state_store
from .queries import _analysis, _facts, _r

Query = Callable[[SparkSession, str], DataFrame]
LAST = "the last event"
DIMENSIONS = ["warehouse_id", "carrier_id", "destination_region", "sales_channel"]
#: Values at which the fixtures have several lanes below their peers.
CLOSE = {"otif_gap": 0.01, "p90_ratio": 1.01}


def breakdown_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 36 metrics of every value of the four dimensions in one go."""
    m = metrics.breakdowns(_facts(spark, sf_dir), DIMENSIONS)
    return m.select("dimension", "group_key", "code", *_r(*metrics.LONG[1:]), F.concat_ws(",", "warnings").alias("warnings"))


def peer_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P90 of the durations of all orders but those of one warehouse, carrier, region or channel."""
    done = _facts(spark, sf_dir).orders.where(F.col("order_status").isin(*COMPLETED))
    parts = []
    for d in DIMENSIONS:
        one = done.where(F.col(d) != UNKNOWN)
        parts.append(others_quantile(one, d, "duration_hours", 0.9).select(F.lit(d).alias("dimension"), F.col(d).alias("group_key"), *_r("peer_p90")))
    return reduce(DataFrame.unionByName, parts)


def close_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carrier rule over lanes, pairs of carrier and warehouse."""
    f = _facts(spark, sf_dir)
    lane = F.when(F.col("carrier_id") == UNKNOWN, UNKNOWN).otherwise(F.concat_ws("@", "carrier_id", "warehouse_id"))
    rows = diagnostics.carrier_relative(replace(f, orders=f.orders.withColumn("carrier_id", lane)), resolve_rules({"FL-CR-001": CLOSE})["FL-CR-001"])
    return rows.groupBy("finding", "severity").agg(F.count_distinct("order_id").alias("affected"), *(F.round(F.first(c), 6).alias(c) for c in ("observed", "threshold", "baseline", "coverage")))


def streamed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable events of both tables as streams of several files; a last event, in a file written after the others, closes all."""
    f = _facts(spark, sf_dir)
    streams = []
    for df, more in ((f.warehouse, []), (f.tracking, ["shipment", "location"])):
        path = new_path(spark, "events")
        rows = df.select("order_id", "event_ts", "event_code", *more)
        rows.write.parquet(path)  # a task a bucket, whatever their number
        none = [F.lit(None).cast("string").alias(c) for c in more]
        last = spark.range(1).select(F.lit(LAST).alias("order_id"), F.lit("2100-01-01").cast("timestamp").alias("event_ts"), F.lit("end").alias("event_code"), *none)
        some = max(2, math.ceil(len(spark.read.schema(rows.schema).parquet(path).inputFiles()) / 2))
        time.sleep(0.1)  # files are read in the order of their times
        last.write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", some).parquet(path))
    with state_store(spark, intervals.ROCKS):
        out = run_stream(intervals.intervals(*streams, delay="3650 days"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.where("code is null").select("order_id", "interval_code", blank("shipment"), blank("location"), *_r("hours"))


#: Texts that unfold to several characters, fold case in full or are blank, by an order's number.
ODD_TEXTS = ("\tﬁne\u3000", "Straße", "\u1112\u1161\u11ab글", "Ⅷ℃", "\u00a0\u2003\t", "ﷺ", "（ＡＢ　Ｃ）：", "İ", "①½", "  a \x1f b\u2028", "\n", "e\u0301t")


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.get(F.array(*map(F.lit, ODD_TEXTS)), (k % len(ODD_TEXTS)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("row_number"), text.alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("at"))


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the two normal forms, and whether they are blank."""
    rows = unfolded(_odd(spark, sf_dir), {"folded": ("text", "text"), "lookup": ("text", "lookup")})
    return rows.select("row_number", "folded", "lookup", is_empty("text").alias("blank"))


def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of orders whose unit or number is such a text: blank ones are missing values."""
    k = F.col("row_number")
    rows = _odd(spark, sf_dir).select("row_number", "at", F.when(k % 2 == 0, F.col("text")).otherwise("piece").alias("unit"), F.when(k % 2 == 1, F.col("text")).otherwise(F.concat(F.lit("O-"), k.cast("string"))).alias("id"))
    mapping = {"id": "order_id", "at": "created_at", "unit": "quantity_unit", "qty": "ordered_quantity", "state": "raw_order_status"}
    found = ingest.validate(rows.withColumns({"qty": F.lit("１，２００"), "state": F.lit("已签收")}), ingest.CONTRACTS["orders"], mapping)
    return found.issues.where("code <> 'DUPLICATE_KEY_CONFLICT'").select("row_number", "field", "code", "severity")


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells of each field of the contract, with how the field is resolved."""
    rows = _odd(spark, sf_dir).select("row_number", "at", "text")
    mapping = {"text": "order_id", "at": "created_at"}
    contract = ingest.CONTRACTS["orders"]
    how = spark.createDataFrame(ingest.resolutions(contract, mapping), "field string, source string, resolution string")
    return ingest.validate(rows, contract, mapping).nulls.join(how, "field").select("field", "nulls", "source", "resolution")


#: Zones with changes of the clock of 30 minutes, an hour, two hours and a day, each with a time near one.
CLOCKS = (
    ("Antarctica/Troll", "2024-03-31 01:00"), ("Antarctica/Troll", "2024-10-27 01:00"), ("Australia/Lord_Howe", "2024-04-07 01:30"), ("Australia/Lord_Howe", "2024-10-06 02:00"),
    ("Pacific/Apia", "2011-12-30 00:00"), ("Asia/Pyongyang", "2015-08-14 23:30"), ("Asia/Pyongyang", "2018-05-04 23:30"), ("America/New_York", "2024-11-03 01:00"), ("Asia/Shanghai", "2024-03-10 02:00"),
)


def clock_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall times around changes of several zones' clocks, ten minutes apart: skipped, shown twice, or neither."""
    k, n = F.col("o_orderkey"), len(CLOCKS)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), (F.floor(k / n) % 60).cast("int").alias("step"))
    out = []
    for i, (zone, near) in enumerate(CLOCKS):
        naive = F.lit(near).cast("timestamp") + F.make_dt_interval(mins=F.col("step") * 10 - 300)
        out.append(rows.where(F.col("k") % n == i).select("k", F.lit(zone).alias("zone"), F.date_format(naive, "yyyy-MM-dd HH:mm").alias("wall"), attach_zone(naive, zone)["error"].alias("error")))
    return reduce(DataFrame.unionByName, out)


def masked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events gathered under their orders, with identifiers in structs, lists and maps, after masking."""
    f = _facts(spark, sf_dir)
    event = F.struct("tracking_event_id", "event_code", F.create_map(F.lit("source_order_id"), F.col("order_id"), F.lit("code"), F.col("event_code")).alias("more"))
    rows = f.tracking.groupBy("order_id").agg(F.array_sort(F.collect_list(event), lambda a, b: F.when(a["tracking_event_id"] < b["tracking_event_id"], -1).otherwise(1)).alias("events"))
    rows = rows.select("order_id", F.struct("events", F.array("order_id", F.lit("abc")).alias("order_ids")).alias("body"), F.struct(F.col("order_id").alias("note")).alias("kept"))
    e = F.explode("body.events").alias("e")
    return report.masked(rows).select("order_id", "body.order_ids", "kept.note", e).select("order_id", F.array_join("order_ids", ",").alias("ids"), "note", F.col("e.tracking_event_id").alias("event"), "e.event_code", F.col("e.more")["source_order_id"].alias("source"), F.col("e.more")["code"].alias("code"))


def browser_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders by id as the browser sorts them: the number within an id counts as a number."""
    ordered = dashboard.sort_orders_as_text(_facts(spark, sf_dir).orders, "order_id", True)
    return dashboard.page(ordered, 3, 50).select("order_id", "order_status")


def browser_status_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = dashboard.sort_orders_as_text(_facts(spark, sf_dir).orders.where("order_status <> 'delivered'"), "order_status", False)
    return dashboard.page(ordered, 1, 100).select("order_id", "order_status")


def groups_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three carriers by rising OTIF as the browser and the edge sort them, one of them without a rate."""
    groups = metrics.breakdown(_facts(spark, sf_dir), "carrier_id").where("code = 'otif_rate'")
    groups = groups.withColumn("value", F.when(F.col("group_key") != "CAR-1", F.col("value")))
    return dashboard.sort_groups_by_number(groups, "value", "group_key", False).limit(3).select("group_key", *_r("value"))


def stored_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status letters of orders under words that a user has stored, one of them changed later: what each became."""
    s = store.Store(spark, new_path(spark, "store"))
    s.save_status_mappings("orders", {"f": "delivered", "Ｏ": "created"})
    s.save_status_mappings("orders", {"Ｏ": "processing"})
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_number"), F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderstatus").alias("state"))
    mapping = {"id": "order_id", "at": "created_at", "state": "raw_order_status"}
    return ingest.validate(rows, ingest.CONTRACTS["orders"], mapping, project_map=s.status_mappings("orders")).statuses


def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.evidence_list(*_analysis(spark, sf_dir), most=20)
    return rows.select("rule_id", "finding", "place", "order_id", "text", F.array_join("event_ids", ",").alias("events"))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown document's own lines of four sections, in order, with the mark where rows are left out."""
    f, evidence = _analysis(spark, sf_dir)
    wanted = ("metrics", "trend", "breakdown", "diagnostics")
    text = report.markdown("report", [s for s in report.document(f, evidence, resolve_rules()) if s[0] in wanted])
    out, section, place = [], "", 0
    for row in text.split("\n")[1:]:
        if row.startswith("## "):
            section, place = row[3:], 0
        elif row and not row.startswith("| ---") and not row.startswith("|" + " --- |"):
            out.append((section, place, row))
            place += 1
    return spark.createDataFrame(out, "section string, place int, line string")


def queries() -> dict[str, Query]:
    return {"breakdown_all": breakdown_all, "peer_quantiles": peer_quantiles, "fl_cr_001_lanes": close_lanes, "streamed_intervals": streamed_intervals,
        "folded_texts": folded_texts, "blank_cells": blank_cells, "null_counts": null_counts,
        "clock_changes": clock_changes, "masked_tree": masked_tree, "browser_order_page": browser_order_page, "browser_status_page": browser_status_page, "groups_by_number": groups_by_number,
        "report_markdown": report_markdown, "evidence_list": evidence_list, "stored_mappings": stored_mappings}
