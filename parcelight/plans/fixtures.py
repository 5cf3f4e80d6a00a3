"""Fulfilment tables as views over the star-schema tables, in SQL that Spark and DuckDB both run.

All arithmetic is integer, minutes are added to timestamps; faults are planted by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

SOURCES = ("orders", "lineitem", "customer", "nation", "region")

# Event codes of the generated order life, by step.
WAREHOUSE_STEPS = "order_received picking_started picking_completed quality_check_started quality_check_completed packing_started packing_completed ready_to_ship shipped_from_warehouse".split()
TRACKING_STEPS = "carrier_picked_up origin_departed in_transit arrived_at_hub departed_hub arrived_at_destination_city out_for_delivery delivered".split()
_WH_MINUTES = ("10 + k % 15", "30 + (k * 7) % 240", "40 + (k * 11) % 100", "20 + (k * 13) % 110", "20 + (k * 17) % 80", "5", "30 + (k * 19) % 100", "15", "5")
_TR_MINUTES = ("120 + (k * 23) % 720", "60", "60", "600 + (k * 29) % 900 + CASE WHEN s % 5 = 0 THEN 1440 ELSE 0 END", "60 + (k * 31) % 300", "300 + (k * 37) % 1200", "120 + (k * 41) % 1500", "60 + (k * 43) % 780")

#: Date text of five files, one per order priority: day first, month first, both, undecided days only, with AM and PM.
_D, _M, _Y = (f"CAST({f}(o_orderdate) AS VARCHAR(4))" for f in ("day", "month", "year"))
DATE_TEXT = f"""CASE WHEN o_orderpriority = '1-URGENT' OR (o_orderpriority = '3-MEDIUM' AND o_orderkey % 2 = 0) THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN o_orderpriority LIKE '4%' THEN
    CASE WHEN day(o_orderdate) <= 12 THEN {_D} || '/' || {_M} || '/' || {_Y} ELSE {_Y} || '年' || {_M} || '月' || {_D} || '日' END
    ELSE {_M} || '/' || {_D} || '/' || {_Y} || CASE WHEN o_orderpriority LIKE '5%' THEN ' 3:05 PM' ELSE '' END END"""


def _sum(parts, n: int) -> str:
    return " + ".join(f"({p})" for p in parts[:n])


def _ready() -> str:
    return _sum(_WH_MINUTES, 8)


def base_sql() -> str:
    """fx_base: keys, created_ts, supplier number and quantities of each order."""
    return """SELECT o.o_orderkey AS k, o.o_orderstatus AS st, o.o_orderdate + (o.o_orderkey % 1440) * INTERVAL '1' MINUTE AS created_ts,
    l.s AS s, l.q AS q, l.q - l.short AS dq, r.r_name AS region, c.c_mktsegment AS channel
FROM {orders} o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS short
    FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey"""


def orders_sql() -> str:
    status = "CASE WHEN k % 20 = 0 THEN 'cancelled' WHEN k % 29 = 0 THEN 'returned' WHEN k % 211 = 0 THEN 'unmapped' WHEN st = 'P' THEN 'shipped' ELSE 'delivered' END"
    promised = "CASE WHEN k % 61 = 0 THEN NULL ELSE created_ts + (72 + (k % 4) * 12) * INTERVAL '1' HOUR END"
    warehouse, carrier = "'WH-' || CAST(s % 8 AS VARCHAR(20))", "CASE WHEN k % 23 = 0 THEN NULL ELSE 'CAR-' || CAST(s % 5 AS VARCHAR(20)) END"

    def row(place: str, wh: str = warehouse, car: str = carrier, amount: str = "dq") -> str:
        return f"""SELECT 'ORD-' || CAST(k AS VARCHAR(20)) AS order_id, created_ts AS created_at, {promised} AS promised_delivery_time,
    CASE WHEN {status} IN ('delivered', 'returned') THEN created_ts + ({_ready()} + {_sum(_TR_MINUTES, 8)}) * INTERVAL '1' MINUTE END AS actual_delivery_time,
    q AS ordered_quantity, {amount} AS delivered_quantity, CASE WHEN k % 67 = 0 THEN '' ELSE 'piece' END AS quantity_unit, {status} AS order_status, 'raw-' || st AS raw_order_status,
    {wh} AS warehouse_id, {car} AS carrier_id, region AS destination_region, channel AS sales_channel, {place} AS source_index
FROM fx_base"""

    none = "CAST(NULL AS VARCHAR(20))"
    # repeats: alike; with a value under the other of two nullable columns; with another amount
    return f"""{row("k")}
UNION ALL {row("k + 1000000000")} WHERE k % 127 = 0
UNION ALL {row("k + 2000000000", none, warehouse)} WHERE k % 23 = 0 AND k % 3 = 0
UNION ALL {row("k + 3000000000", amount="dq - 1")} WHERE k % 131 = 0"""


def _steps(codes: list[str], minutes: tuple[str, ...], offset: str, held: str | None = None) -> str:
    values = ", ".join(f"({i}, '{c}')" for i, c in enumerate(codes, 1))
    at = f"{held}[step - 1]" if held else "CASE step " + " ".join(f"WHEN {i} THEN {offset}{_sum(minutes, i)}" for i in range(1, len(codes) + 1)) + " END"
    return f"SELECT b.*, v.step, v.code, {at} AS minutes FROM fx_base b CROSS JOIN (VALUES {values}) AS v(step, code)"


def warehouse_sql(held: str | None = None) -> str:
    """``held``: the column of fx_base, if any, that has the steps' minutes as an array."""
    row = lambda ident, order, at, code, place: f"SELECT {ident} AS event_id, {order} AS order_id, created_ts + ({at}) * INTERVAL '1' MINUTE AS event_time, {code} AS event_code, upper({code}) AS raw_status, 'WH-' || CAST(s % 8 AS VARCHAR(20)) AS warehouse_id, {place} AS source_index"
    k, own = "CAST(k AS VARCHAR(20))", "'ORD-' || CAST(k AS VARCHAR(20))"
    picked = _sum(_WH_MINUTES, 3)
    return f"""WITH e AS ({_steps(WAREHOUSE_STEPS, _WH_MINUTES, "", held)})
{row(f"'WE-' || {k} || '-' || CAST(step AS VARCHAR(20))", own, "minutes", "code", "k * 100 + step")} FROM e WHERE NOT (k % 31 = 0 AND step = 3)
UNION ALL {row(f"'WE-' || {k} || '-1'", own, "minutes", "code", "k * 100 + 30")} FROM e WHERE k % 97 = 0 AND step = 1
UNION ALL {row(f"'WE-' || {k} || '-10'", f"'ORPHAN-' || {k}", "60", "'order_received'", "k * 100 + 10")} FROM fx_base WHERE k % 103 = 0
UNION ALL {row(f"'WE-' || {k} || '-11'", own, "-60", "'order_received'", "k * 100 + 11")} FROM fx_base WHERE k % 107 = 0
UNION ALL {row(f"'WE-' || {k} || '-20'", own, f"{picked} + 10", "'picking_started'", "k * 100 + 20")} FROM fx_base WHERE k % 71 = 0
UNION ALL {row(f"'WE-' || {k} || '-21'", own, f"{picked} + 20", "'picking_completed'", "k * 100 + 21")} FROM fx_base WHERE k % 71 = 0"""


def tracking_sql(held: str | None = None) -> str:
    k, own = "CAST(k AS VARCHAR(20))", "'ORD-' || CAST(k AS VARCHAR(20))"

    by = "CASE WHEN k % 23 = 0 THEN NULL ELSE 'CAR-' || CAST(s % 5 AS VARCHAR(20)) END"

    def row(step: str, at: str, code: str, place: str, location: str, carrier: str = by) -> str:
        return f"""SELECT 'TE-' || {k} || '-' || CAST({step} AS VARCHAR(20)) AS tracking_event_id, {own} AS order_id, 'SHP-' || {k} AS shipment_id, created_ts + ({at}) * INTERVAL '1' MINUTE AS event_time, {code} AS event_code, upper({code}) AS raw_status,
    {carrier} AS carrier_id, {location} AS location_code, CAST({step} AS BIGINT) AS sequence_number, {place} AS source_index"""

    place = "k * 100 + CASE WHEN k % 41 = 0 AND step = 2 THEN 3 WHEN k % 41 = 0 AND step = 3 THEN 2 ELSE step END"
    code = "CASE WHEN k % 53 = 0 AND step = 3 THEN 'unmapped' ELSE code END"
    hub = _ready() + " + " + _sum(_TR_MINUTES, 3)
    spot = "CASE WHEN step IN (4, 5) THEN 'HUB-1' ELSE 'LOC-' || CAST(step AS VARCHAR(20)) END"
    return f"""WITH e AS ({_steps(TRACKING_STEPS, _TR_MINUTES, _ready() + " + ", held)})
{row("step", "minutes", code, place, spot)} FROM e WHERE NOT (k % 37 = 0 AND step = 8)
UNION ALL {row("2", "minutes", "code", "k * 100 + 50", "'LOC-X'")} FROM e WHERE k % 101 = 0 AND step = 2
UNION ALL {row("step", "minutes", code, "k * 100 + 60", "CAST(NULL AS VARCHAR(20))", spot)} FROM e WHERE k % 23 = 0 AND k % 4 = 1 AND step = 6
UNION ALL {row("9", hub + " + 30", "'exception'", "k * 100 + 9", "'LOC-E'")} FROM fx_base WHERE k % 12 = 0"""


def ctes() -> str:
    """The four views as the head of a WITH clause for DuckDB, over its registered tables."""
    base = base_sql().format(**{t: t for t in SOURCES})
    return f"WITH fx_base AS ({base}),\nfx_orders AS ({orders_sql()}),\nfx_warehouse AS ({warehouse_sql()}),\nfx_tracking AS ({tracking_sql()})"


def _running(base: DataFrame) -> DataFrame:
    """``base`` with the minutes of all steps as two arrays, ``warehouse_minutes`` and ``tracking_minutes``.

    They are added up once per order.  One expression per event with all sums in it is more code than the JVM compiles."""
    parts = {f"m{i}": F.expr(e).cast("int") for i, e in enumerate((*_WH_MINUTES, *_TR_MINUTES))}
    wh, tr = list(parts)[: len(_WH_MINUTES)], list(parts)[len(_WH_MINUTES) :]
    sums = lambda names: F.array(*(reduce(Column.__add__, map(F.col, names[:n])) for n in range(1, len(names) + 1)))
    ready = reduce(Column.__add__, map(F.col, wh[:8]))
    added = base.withColumns(parts).withColumns({"warehouse_minutes": sums(wh), "ready": ready, "own": sums(tr)})
    return added.withColumn("tracking_minutes", F.transform("own", lambda x: F.col("ready") + x)).drop(*parts, "ready", "own")


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders, warehouse events and tracking events as DataFrames over one stored table of orders."""
    joined = spark.sql(base_sql(), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES})
    base = stored(_running(joined), "base")  # three tables read it
    over = lambda text: spark.sql(text.replace("fx_base", "{fx_base}"), fx_base=base)
    return over(orders_sql()), over(warehouse_sql("warehouse_minutes")), over(tracking_sql("tracking_minutes"))
