"""Teaching cases: synthetic orders, warehouse events and tracking events of three stories.

Every value is a hash of seed, field and order number, so any number of orders is drawn in parallel, and the same
seed gives the same rows whatever the partitioning.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import ORDERS, TRACKING_EVENTS, WAREHOUSE_EVENTS
from ..functions.scalars import parse_time
from ..operators.simulate import allocate

ZONE, OFFSET = "Asia/Shanghai", "+08:00"
LEAST_ORDERS = 30

Range = tuple[float, float]


@dataclass(frozen=True)
class Case:
    code: str
    seed: int
    orders: int
    day_weights: tuple[float, ...]
    promise_hours: float
    partial_share: float
    carriers: tuple[tuple[str, float], ...]
    expected: dict[str, Range]
    start: dt.date = dt.date(2026, 6, 1)
    peak_days: tuple[int, ...] = ()
    slow_carrier: str = ""
    delay_share: float = 0.0


# The three cases, and the ranges in which their metrics must fall.
_USUAL = (("CAR-SYN-FAST", 0.45), ("CAR-SYN-STD", 0.35), ("CAR-SYN-ECON", 0.20))
_SLOW = (("CAR-SYN-SLOW", 0.40), ("CAR-SYN-FAST", 0.35), ("CAR-SYN-STD", 0.25))
CASES = {
    "normal_operations": Case("A", 20260801, 180, (1,) * 18, 72, 0.02, _USUAL, {"ot_rate": (0.90, 1.00), "if_rate": (0.95, 1.00), "otif_rate": (0.87, 1.00), "fulfillment_duration_mean_hours": (35, 65), "anomaly_order_rate": (0.01, 0.10)}, delay_share=0.04),
    "promotion_surge": Case("B", 20260802, 240, (1, 1, 1, 1, 1, 1, 1, 6, 5, 2, 1.5, 1.5), 60, 0.03, _USUAL, {"ot_rate": (0.25, 0.85), "if_rate": (0.94, 1.00), "otif_rate": (0.20, 0.82), "fulfillment_duration_mean_hours": (45, 80), "anomaly_order_rate": (0.01, 0.10)}, peak_days=(7, 8)),
    "carrier_disruption": Case("C", 20260803, 180, (1,) * 18, 72, 0.02, _SLOW, {"ot_rate": (0.45, 0.75), "if_rate": (0.95, 1.00), "otif_rate": (0.42, 0.72), "fulfillment_duration_mean_hours": (75, 115), "anomaly_order_rate": (0.10, 0.35)}, slow_carrier="CAR-SYN-SLOW"),
}

# Hours of each step, as ranges; shares of warehouses, regions and channels.
WAREHOUSES = (("WH-SYN-EAST", 0.72), ("WH-SYN-WEST", 0.28))
REGIONS = (("CN-SD-QD", 0.30), ("CN-JS-NJ", 0.27), ("CN-ZJ-HZ", 0.25), ("CN-HB-WH", 0.18))
CHANNELS = (("synthetic_marketplace", 0.55), ("synthetic_store", 0.30), ("synthetic_classroom", 0.15))
WAREHOUSE_STEPS = (  # code, usual hours since the step before, hours on a peak day
    ("order_received", (0.1, 0.4), (0.1, 0.4)), ("picking_started", (0.5, 0.9), (4.8, 7.0)), ("picking_completed", (0.7, 0.95), (2.8, 4.2)), ("quality_check_started", (0.35, 0.55), (2.2, 3.4)),
    ("quality_check_completed", (0.35, 0.55), (1.8, 2.7)), ("packing_started", (0.05, 0.2), (0.05, 0.2)), ("packing_completed", (0.5, 0.75), (2.5, 3.8)), ("ready_to_ship", (0.15, 0.5), (0.15, 0.5)), ("shipped_from_warehouse", (0.05, 0.2), (0.05, 0.2)),
)
LEGS = {  # usual hours, hours of a slow carrier
    "pickup": ((2.5, 8), (18, 30)), "first_leg": ((8, 15), (38, 52)), "hub": ((1, 4), (5, 10)), "second_leg": ((8, 16), (38, 55)), "destination": ((2, 9), (28, 42)), "attempt": ((1, 6), (14, 22)),
}
SHORT_STEP = (0.5, 1.5)
LATE_PICKUP, LATE_LEG = 14.0, 50.0


def customized(name: str, seed: int | None = None, orders: int | None = None) -> Case:
    case = CASES[name]
    return replace(case, seed=case.seed if seed is None else seed, orders=case.orders if orders is None else orders)


def _draw(case: Case, field: str) -> Column:
    """A number from 0 up to 1 of an order's field."""
    return F.pmod(F.xxhash64(F.lit(case.seed), F.lit(field), F.col("i")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _between(case: Case, field: str, bounds: Range) -> Column:
    return F.lit(float(bounds[0])) + _draw(case, field) * float(bounds[1] - bounds[0])


def _choice(case: Case, field: str, shares: tuple[tuple[str, float], ...]) -> Column:
    out, upto, total = F.lit(shares[-1][0]), 0.0, sum(w for _, w in shares)
    bounds = []
    for name, w in shares[:-1]:
        upto += w / total
        bounds.append((name, upto))
    for name, limit in reversed(bounds):
        out = F.when(_draw(case, field) < limit, name).otherwise(out)
    return out


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(OFFSET))


def _after(ts: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (hours * 3.6e9).cast("long"))


def _running(steps: str) -> Column:
    """Running sums of an array of hours."""
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.aggregate(F.slice(F.col(steps), F.lit(1), k), F.lit(0.0), lambda a, x: a + x))


def _lives(spark: SparkSession, case: Case) -> DataFrame:
    """One row per order: day, choices, and hours of every step since the order."""
    per_day = allocate(case.orders, {f"{i:06d}": 100 * w / sum(case.day_weights) for i, w in enumerate(case.day_weights)})
    ends, total = [], 0
    for day in sorted(per_day):
        total += per_day[day]
        ends.append(total)
    day = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("i")))
    slow = F.col("carrier_id") == case.slow_carrier
    late = _draw(case, "late") < case.delay_share
    leg = lambda n: F.when(slow, _between(case, n, LEGS[n][1])).otherwise(_between(case, n, LEGS[n][0]))
    odd = F.col("i") % 2 == 1
    df = spark.range(1, case.orders + 1).withColumnRenamed("id", "i").withColumn("day", day).withColumns({
        "peak": F.col("day").isin(*case.peak_days) if case.peak_days else F.lit(False), "warehouse_id": _choice(case, "warehouse", WAREHOUSES), "carrier_id": _choice(case, "carrier", case.carriers),
        "region": _choice(case, "region", REGIONS), "channel": _choice(case, "channel", CHANNELS), "quantity": F.floor(_draw(case, "quantity") * 5) + 1,
        "number": F.when(F.col("i") < 10_000, F.lpad(F.col("i").cast("string"), 4, "0")).otherwise(F.col("i").cast("string")),
    })
    clock = F.when(F.col("peak"), F.floor(_draw(case, "hour") * 6)).otherwise(F.floor(_draw(case, "hour") * 11)) * 60 + F.floor(_draw(case, "minute") * 60)
    midnight = F.to_utc_timestamp(F.timestamp_micros(F.unix_date(F.date_add(F.lit(case.start), F.col("day"))) * F.lit(86_400_000_000)), ZONE)
    wh = F.array(*(F.when(F.col("peak"), _between(case, c, p)).otherwise(_between(case, c, u)) for c, u, p in WAREHOUSE_STEPS))
    extra = lambda on, h: F.when(late & ~slow & on, h).otherwise(0.0)
    df = df.withColumns({"created": _after(midnight, clock / 60 + 9), "wh_steps": wh, "short_1": _between(case, "origin", SHORT_STEP), "short_2": _between(case, "transit", SHORT_STEP)}).withColumn("wh_at", _running("wh_steps"))
    steps = [F.element_at("wh_at", 8), leg("pickup") + extra(odd, LATE_PICKUP), F.col("short_1"), F.col("short_2"), leg("first_leg") - F.col("short_1") - F.col("short_2"), leg("hub"), leg("second_leg") + extra(~odd, LATE_LEG), leg("destination"), leg("attempt")]
    return df.withColumn("tr_steps", F.array(*steps)).withColumns({"tr_at": _running("tr_steps"), "excepted": slow & ~odd})


def generate(spark: SparkSession, case: Case) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, warehouse events and tracking events in the columns of the contract."""
    if case.orders < LEAST_ORDERS:
        raise ValueError(f"a case needs {LEAST_ORDERS} orders at least")
    lives = _lives(spark, case)
    order_id, shipment = F.concat(F.lit(f"ORD-SYN-{case.code}-"), "number"), F.concat(F.lit(f"SHP-SYN-{case.code}-"), "number")
    text = lambda c: F.col(c).cast("string")
    partial = _draw(case, "partial") < case.partial_share
    orders = lives.select(
        order_id.alias("order_id"), _iso(F.col("created")).alias("created_at"), _iso(_after(F.col("created"), F.lit(case.promise_hours))).alias("promised_delivery_time"), _iso(_after(F.col("created"), F.element_at("tr_at", -1))).alias("actual_delivery_time"),
        F.col("quantity").cast("double").alias("ordered_quantity"), (F.col("quantity") - partial.cast("int")).cast("double").alias("delivered_quantity"), F.lit("piece").alias("quantity_unit"), F.lit("delivered").alias("order_status"), F.lit("delivered").alias("raw_order_status"),
        "warehouse_id", "carrier_id", F.col("region").alias("destination_region"), F.col("channel").alias("sales_channel"), F.col("i").alias("source_index"),
    )
    point = lambda at, code, place, exc: F.struct(at.alias("at"), F.lit(code).alias("code"), place.alias("place"), F.lit(exc).cast("string").alias("exc"))
    wh_points = F.array(*(point(F.element_at("wh_at", k), c, F.lit(None).cast("string"), None) for k, (c, _, _) in enumerate(WAREHOUSE_STEPS, 1)))
    seq = F.col("step") + 1
    w = lives.select("*", F.posexplode(wh_points).alias("step", "p")).select(
        F.concat(F.lit(f"WHE-SYN-{case.code}-"), "number", F.lit("-"), F.lpad(seq.cast("string"), 2, "0")).alias("event_id"), order_id.alias("order_id"), _iso(_after(F.col("created"), F.col("p.at"))).alias("event_time"), F.col("p.code").alias("event_code"), F.col("p.code").alias("raw_status"),
        "warehouse_id", F.col("quantity").cast("double").alias("quantity"), F.lit("piece").alias("quantity_unit"), F.lit("synthetic_case_generator").alias("source_system"), (F.col("i") * 16 + seq).alias("source_index"),
    )
    origin, line, hub = F.concat(F.lit("ORIGIN-"), "warehouse_id"), F.lit("LINEHAUL-SYN-01"), F.lit("HUB-SYN-01")
    dest, site = F.concat(F.lit("DEST-"), "region"), F.concat(F.lit("SITE-"), "region")
    places = (("shipment_created", origin), ("carrier_picked_up", origin), ("origin_departed", origin), ("in_transit", line), ("arrived_at_hub", hub), ("departed_hub", hub), ("arrived_at_destination_city", dest), ("out_for_delivery", site), ("delivered", site))
    tr = [point(F.element_at("tr_at", k), c, p, None) for k, (c, p) in enumerate(places, 1)]
    middle = point((F.element_at("tr_at", 4) + F.element_at("tr_at", 5)) / 2, "exception", line, "SYNTHETIC_DELAY")
    all_points = F.when(F.col("excepted"), F.array(*tr[:4], middle, *tr[4:])).otherwise(F.array(*tr))
    t = lives.select("*", F.posexplode(all_points).alias("step", "p")).select(
        F.concat(F.lit(f"TRE-SYN-{case.code}-"), "number", F.lit("-"), F.lpad(seq.cast("string"), 2, "0")).alias("tracking_event_id"), order_id.alias("order_id"), shipment.alias("shipment_id"), _iso(_after(F.col("created"), F.col("p.at"))).alias("event_time"), F.col("p.code").alias("event_code"), F.col("p.code").alias("raw_status"),
        "carrier_id", F.col("p.place").alias("location_code"), F.col("region").alias("region_code"), F.col("p.exc").alias("exception_code"), seq.cast("long").alias("sequence_number"), (F.col("i") * 16 + seq).alias("source_index"),
    )
    return orders.select(*ORDERS.fieldNames()), w.select(*WAREHOUSE_EVENTS.fieldNames()), t.select(*TRACKING_EVENTS.fieldNames())


def faults(tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """table, fault and n: repeated keys, events without an order, times that run back in source order.  No row: the case is sound."""
    orders, w, t = tables
    ids = orders.select("order_id").distinct()
    parts = []
    for name, df, key in (("orders", orders, "order_id"), ("warehouse_events", w, "event_id"), ("tracking_events", t, "tracking_event_id")):
        parts.append(df.groupBy(key).count().where("count > 1").select(F.lit(name).alias("table"), F.lit("DUPLICATE_KEY").alias("fault")))
        if df is orders:
            continue
        parts.append(df.join(ids, "order_id", "left_anti").select(F.lit(name).alias("table"), F.lit("ORPHAN_EVENT").alias("fault")))
        ts = parse_time("event_time")
        back = df.select(ts.alias("ts"), F.lag(ts).over(Window.partitionBy("order_id").orderBy("source_index")).alias("before")).where("ts < before")
        parts.append(back.select(F.lit(name).alias("table"), F.lit("OUT_OF_ORDER").alias("fault")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table", "fault").agg(F.count(F.lit(1)).alias("n"))


def range_check(case: Case, metrics: DataFrame) -> DataFrame:
    """code, value, bounds and whether the value lies in them, of the metrics that the case promises."""
    bounds = F.create_map(*(x for k, (lo, hi) in case.expected.items() for x in (F.lit(k), F.struct(F.lit(float(lo)).alias("least"), F.lit(float(hi)).alias("most")))))
    rows = metrics.where(F.col("code").isin(*case.expected)).withColumn("b", bounds[F.col("code")])
    return rows.select("code", "value", "b.least", "b.most", F.col("value").between(F.col("b.least"), F.col("b.most")).alias("within"))


__all__ = ["CASES", "Case", "customized", "faults", "generate", "range_check"]
