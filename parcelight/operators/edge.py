"""The edge dialect: seven rounded metrics, a fixed bottleneck limit and three fixed rules.

An order without a decision is pending and leaves the rate's denominator; coverage is over all orders given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quantiles import quantiles, with_quantiles

# Limits of the dialect, in hours, and the carrier that its delay rule watches.
LONG_TAIL_HOURS = 82
BOTTLENECK_HOURS = 18
WATCHED_CARRIER = "Carrier-C"

# Rule, category, severity and priority by anomaly reason.
RULES = {
    "fulfillment_long_tail": ("FL-WH-001", "warehouse_delay", "high", 10),
    "carrier_delay": ("FL-CR-001", "carrier_relative", "high", 8),
    "late_delivery": ("FL-OT-001", "last_mile_backlog", "medium", 6),
}


def _half_up(c: Column, digits: int) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / F.lit(float(10**digits))


def decided(orders: DataFrame, watched: str = WATCHED_CARRIER) -> DataFrame:
    """on_time, in_full, otif, duration_hours and reasons of prepared orders (``order_decisions``): status plays no part.

    A null promise, delivery or amount gives a null decision; an order of the watched carrier above its limit is delayed by it.
    """
    on_time = F.col("actual_ts") <= F.col("promised_ts")
    full = F.col("delivered") >= F.col("ordered")
    hours = _half_up((F.unix_micros("actual_ts") - F.unix_micros("created_ts")) / F.lit(3.6e9), 2)
    df = orders.withColumns({"on_time": on_time, "full": full, "duration_hours": hours})
    tail = F.coalesce(F.col("duration_hours") >= LONG_TAIL_HOURS, F.lit(False))
    found = {
        "late_delivery": ~F.col("on_time"), "partial_delivery": ~F.col("full"), "returned_order": F.col("order_status") == "returned", "fulfillment_long_tail": tail,
        "carrier_delay": tail & (F.col("carrier_id") == watched),
    }
    return df.select(
        *(c for c in orders.columns if c not in ("ot", "in_full", "otif", "duration_hours")), "on_time", F.col("full").alias("in_full"),
        F.when(F.col("on_time").isNotNull() & F.col("full").isNotNull(), F.col("on_time") & F.col("full")).alias("otif"), "duration_hours",
        F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items()))).alias("reasons"),
    )


def metrics(orders: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """code, value, numerator, denominator, coverage and pending of the seven metrics; one aggregation."""
    keys = keys or []
    h = F.col("duration_hours")
    rates = {"ot_rate": F.col("on_time"), "if_rate": F.col("in_full"), "otif_rate": F.col("otif"), "anomaly_order_rate": F.size("reasons") > 0}
    hours = {"fulfillment_duration_mean_hours": F.avg(h)}
    tails = {"fulfillment_duration_median_hours": 0.5, "fulfillment_duration_p90_hours": 0.9}
    a = orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(h).alias("n_hours"), *(e.alias(c) for c, e in hours.items()),
        *(x for c, e in rates.items() for x in (F.count_if(F.coalesce(e, F.lit(False))).alias(f"{c}_yes"), F.count(e).alias(f"{c}_all"))),
    )
    a = with_quantiles(a, keys, quantiles(orders, keys, "duration_hours", tails))
    n, none = F.col("n"), F.lit(None).cast("long")

    def row(code: str, value: Column, yes: Column, total: Column, seen: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), value.alias("value"), yes.alias("numerator"), total.alias("denominator"), _half_up(ratio(seen, n), 4).alias("coverage"), (n - seen).alias("pending"))

    rows = [row(c, _half_up(ratio(F.col(f"{c}_yes"), F.col(f"{c}_all")), 4), F.col(f"{c}_yes"), F.col(f"{c}_all"), F.col(f"{c}_all")) for c in rates]
    rows += [row(c, _half_up(F.col(c), 2), none, none, F.col("n_hours")) for c in (*hours, *tails)]
    return a.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")


def node_summary(intervals: DataFrame, orders: DataFrame) -> DataFrame:
    """Mean, median and P90 of each interval; every node at or above the fixed limit is a bottleneck."""
    total = F.broadcast(orders.agg(F.count(F.lit(1)).alias("eligible")))  # one row
    h = F.col("hours")
    by = ["interval_code"]
    g = with_quantiles(intervals.groupBy(*by).agg(F.count(h).alias("n"), F.avg(h).alias("mean")), by, quantiles(intervals, by, "hours", {"median": 0.5, "p90": 0.9}))
    return g.crossJoin(total).withColumns({"coverage": _half_up(ratio(F.col("n"), F.col("eligible")), 4), "is_bottleneck": F.col("p90") >= BOTTLENECK_HOURS})


def findings(orders: DataFrame, sample: int = 8) -> DataFrame:
    """One row per rule that found an order: how many, its share of all orders and the first ids as examples."""
    total = F.broadcast(orders.agg(F.count(F.lit(1)).alias("n")))  # one row
    hits = orders.select("order_id", F.explode("reasons").alias("reason")).where(F.col("reason").isin(*RULES))
    counts = hits.groupBy("reason").agg(F.count(F.lit(1)).alias("affected"), F.min("order_id").alias("first_order"))
    table = F.create_map(*(x for k, v in RULES.items() for x in (F.lit(k), F.struct(*(F.lit(y).alias(n) for y, n in zip(v, ("rule_id", "category", "severity", "priority"), strict=True))))))
    return counts.crossJoin(total).withColumn("rule", table[F.col("reason")]).select("rule.*", "affected", "first_order", _half_up(ratio(F.col("affected"), F.col("n")), 4).alias("coverage"))


def examples(orders: DataFrame, reason: str, most: int = 8) -> DataFrame:
    """The first orders, in source order, that a rule found: the report's sample."""
    return orders.where(F.array_contains("reasons", reason)).orderBy("source_index").select("order_id", "duration_hours").limit(most)


def filter_coverage(kept: DataFrame, everything: DataFrame) -> DataFrame:
    """Orders left by a filter, orders there were, and their ratio."""
    a, b = kept.agg(F.count(F.lit(1)).alias("order_count")), everything.agg(F.count(F.lit(1)).alias("unfiltered_order_count"))
    return a.crossJoin(b).withColumn("data_coverage", _half_up(ratio(F.col("order_count"), F.col("unfiltered_order_count")), 4))  # one row on either side


def scenario(orders: DataFrame, intervals: DataFrame, warehouse: list[tuple[str, float, bool, tuple[str, ...]]], pickup: tuple[float, tuple[str, ...]] = (0, ()), promise_hours: float = 0, watched: str = WATCHED_CARRIER) -> DataFrame:
    """:func:`decided` orders after edits of their durations: no event moves in this dialect.

    ``warehouse``: (interval, hours or percent, whether percent, warehouses) one after another, each taken from the order's first such
    interval and from its duration; then ``pickup`` (hours, carriers); the delivery follows the duration, the promise moves
    by ``promise_hours``.  Empty warehouses or carriers mean all.  Durations are rounded to two places after each edit.
    """
    first = intervals.groupBy("order_id", "interval_code").agg(F.min(F.struct("start_ts", "end_ts", "hours")).alias("i"))
    codes = list(dict.fromkeys(code for code, *_ in warehouse))
    node = lambda c: F.max(F.when(F.col("interval_code") == c, F.col("i.hours"))).alias(f"n_{c}")
    df = decided(orders, watched)
    if codes:
        df = df.join(first.groupBy("order_id").agg(*(node(c) for c in codes)), "order_id", "left")
    before = F.col("duration_hours")
    for code, value, percent, places in warehouse:
        held = F.col(f"n_{code}")
        cut = F.least(held, held * value / 100 if percent else F.lit(float(value)))
        fits = held.isNotNull() & (cut > 0) & (F.col("warehouse_id").isin(*places) if places else F.lit(True))
        df = df.withColumns({"duration_hours": F.when(fits, _half_up(F.greatest(before - cut, F.lit(0.0)), 2)).otherwise(before), f"n_{code}": F.when(fits, _half_up(held - cut, 2)).otherwise(held)})
    hours, carriers = pickup
    if hours:
        fits = F.col("carrier_id").isin(*carriers) if carriers else F.lit(True)
        df = df.withColumn("duration_hours", F.when(fits, _half_up(before - F.least(before, F.lit(float(hours))), 2)).otherwise(before))
    micros = lambda h: F.round(h * 3.6e9).cast("long")
    moved = F.timestamp_micros(F.unix_micros("created_ts") + micros(F.col("duration_hours")))
    later = F.timestamp_micros(F.unix_micros("promised_ts") + micros(F.lit(float(promise_hours))))
    return decided(df.withColumns({"actual_ts": F.coalesce(moved, F.col("actual_ts")), "promised_ts": later}).select(*(c for c in orders.columns if c in df.columns)), watched)
