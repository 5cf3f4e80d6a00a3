"""Order decisions, process intervals and the facts that every metric is taken from.

``intervals`` pairs the first start with the first later end by aggregation alone: with starts in order the
first start that has a later end is the earliest start if any end is at or after it, so
min(start) and the least end at or after it are the pair.  The first end is that in nearly all groups; times are not listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import COMPLETED, DIMENSIONS, INTERVALS, TRACKING_ANOMALIES, WAREHOUSE_ANOMALIES, WAREHOUSE_INTERVALS
from ..functions.scalars import dimension, finite, hours_between, is_empty
from ..sources.shared import dealt, stored
from .prep import distinct_warnings, instant, prepare_events, prepare_orders, warning, whole


@dataclass
class Facts:
    """orders: one row per valid order.  intervals: one per instance.  eligible: (order_id, interval_code).
    warnings: distinct.  totals: one row.  warehouse, tracking: usable events."""

    orders: DataFrame
    intervals: DataFrame
    eligible: DataFrame
    warnings: DataFrame
    totals: DataFrame
    warehouse: DataFrame
    tracking: DataFrame


def kept(f: Facts) -> Facts:
    """The same facts as stored tables, for when several aggregations read them."""
    return Facts(stored(f.orders, "orders"), stored(f.intervals, "intervals"), stored(f.eligible, "eligible"), stored(f.warnings, "warnings"), f.totals, stored(f.warehouse, "warehouse"), stored(f.tracking, "tracking"))


def evaluated(orders: DataFrame, warehouse: DataFrame, tracking: DataFrame) -> Facts:
    """Stored facts; every intermediate table is computed once."""
    return evaluate(orders, warehouse, tracking, keep=lambda df, by=None: stored(df, "step", by))


def decide(value: Column, missing: Column, status: Column) -> Column:
    """true, false, not_computable, pending or excluded."""
    done = F.when(missing, "not_computable").when(value, "true").otherwise("false")
    return F.when(status.isin(*COMPLETED), done).when(status == "cancelled", "excluded").otherwise("pending")


def order_decisions(orders: DataFrame) -> DataFrame:
    """Instants, quantities, dimensions, the three decisions and the fulfilment duration of valid orders."""
    df = orders.select(
        "order_id", "source_index", F.coalesce(F.nullif(F.col("order_status"), F.lit("")), F.lit("unmapped")).alias("order_status"), instant(orders, "created_at").alias("created_ts"),
        instant(orders, "promised_delivery_time").alias("promised_ts"), instant(orders, "actual_delivery_time").alias("actual_ts"), finite("ordered_quantity").alias("ordered"), finite("delivered_quantity").alias("delivered"),
        "quantity_unit", *(dimension(d).alias(d) for d in DIMENSIONS),
    )
    return decide_orders(df)


def decide_orders(df: DataFrame) -> DataFrame:
    """The decisions and the duration, from instants, amounts and status as :func:`order_decisions` names them."""
    s = F.col("order_status")
    no_time = F.col("promised_ts").isNull() | F.col("actual_ts").isNull()
    no_amount = F.col("ordered").isNull() | F.col("delivered").isNull() | is_empty("quantity_unit")
    ot, full = F.col("actual_ts") <= F.col("promised_ts"), F.col("delivered") >= F.col("ordered")
    done = s.isin(*COMPLETED) & F.col("created_ts").isNotNull() & F.col("actual_ts").isNotNull()
    return df.withColumns({
        "ot": decide(ot, no_time, s), "in_full": decide(full, no_amount, s), "otif": decide(ot & full, no_time | no_amount, s),
        "duration_hours": F.when(done & (F.col("actual_ts") >= F.col("created_ts")), hours_between(F.col("created_ts"), F.col("actual_ts"))),
        "negative_duration": F.coalesce(done & (F.col("actual_ts") < F.col("created_ts")), F.lit(False)),
        "partial": F.coalesce(s.isin(*COMPLETED) & (F.col("delivered") < F.col("ordered")), F.lit(False)),
    })


def _roles(codes: tuple[str, ...]) -> Column:
    """event code to its (interval, is start) in ``codes``, as a literal map."""
    roles: dict[str, list[tuple[str, bool]]] = {}
    for c in codes:
        a, b = INTERVALS[c]
        roles.setdefault(a, []).append((c, True))
        roles.setdefault(b, []).append((c, False))
    entry = lambda rs: F.array(*(F.struct(F.lit(i).alias("interval_code"), F.lit(x).alias("start")) for i, x in rs))
    return F.create_map(*(x for e, rs in roles.items() for x in (F.lit(e), entry(rs))))


def _spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the first start and its end where first and last end tell it, else ``between``: the end lies among those between them."""
    ts, start = F.col("event_ts"), F.col("start")
    g = rows.groupBy(*keys, "interval_code").agg(
        F.min(F.when(start, ts)).alias("start_ts"), F.min(F.when(~start, ts)).alias("first_end"), F.max(F.when(~start, ts)).alias("last_end"), F.count_if(start).alias("n_start"), F.count_if(~start).alias("n_end"),
    )
    early = F.coalesce(F.col("first_end") < F.col("start_ts"), F.lit(False))
    between = early & F.coalesce(F.col("last_end") >= F.col("start_ts"), F.lit(False)) & (F.col("n_end") > 2)
    end = F.when(F.col("first_end") >= F.col("start_ts"), F.col("first_end")).when(~between & (F.col("last_end") >= F.col("start_ts")), F.col("last_end"))
    return g.select(
        *keys, "interval_code", "start_ts", end.alias("end_ts"), ((F.col("n_start") == 0) | (F.col("n_end") == 0)).alias("boundary_missing"),
        early.alias("end_before_start"), ((F.col("n_start") > 1) | (F.col("n_end") > 1)).alias("cycles"), between.alias("between"),
    )


def _ends_between(spans: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``later``, the first end at or after the start, of the spans whose end lies between first and last."""
    by = [*keys, "interval_code"]
    # keys may be null, and a null equals a null
    open_ = spans.where("between").select(*(F.col(k).alias(f"of_{k}") for k in by), "start_ts")
    ends = rows.where("not start").join(open_, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in by)))
    return ends.where("event_ts >= start_ts").groupBy(*(f"of_{k}" for k in by)).agg(F.min("event_ts").alias("later"))


def _paired(spans: DataFrame, found: DataFrame | None, keys: list[str]) -> DataFrame:
    if found is not None:
        spans = spans.join(found, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*keys, "interval_code"])), "left").withColumn("end_ts", F.coalesce("end_ts", "later"))
    return spans.select(
        *keys, "interval_code", "start_ts", "end_ts", hours_between(F.col("start_ts"), F.col("end_ts")).alias("hours"), "boundary_missing", "end_before_start", (F.col("end_ts").isNotNull() & F.col("cycles")).alias("many_cycles"),
    )


def pair(rows: DataFrame, keys: list[str], keep=whole) -> DataFrame:
    """First complete pair per key.  ``rows``: the keys, interval_code, start (boolean), event_ts."""
    return _resolved(keep(_spans(rows, keys), keys[0]), rows, keys, keep)


def _resolved(spans: DataFrame, rows: DataFrame, keys: list[str], keep) -> DataFrame:
    """Pairs from spans; ``rows`` are read again only for spans whose end lies between, if stored spans have any."""
    if keep is not whole and spans.where("between").isEmpty():
        return _paired(spans, None, keys)
    return _paired(spans, keep(_ends_between(spans, rows, keys)), keys)


def interval_events(warehouse: DataFrame, tracking: DataFrame) -> DataFrame:
    """Each event as the start or the end of the intervals that it bounds: order_id, shipment, location (null where the interval is
    not told apart by it), event_ts, interval_code, start.  Also over streams."""
    inside, pickup, moved = interval_parts(warehouse, tracking)
    none = F.lit(None).cast("string")
    return inside.unionByName(pickup).withColumns({"shipment": none, "location": none}).unionByName(moved)


def interval_parts(warehouse: DataFrame, tracking: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`interval_events` by what tells instances apart: intervals of an order from warehouse events, those of an order from both
    tables, and those of a shipment, or of a shipment and a location, from tracking events."""
    def rows(df: DataFrame, codes: tuple[str, ...], *more: Column | str) -> DataFrame:
        role = F.explode(F.try_element_at(_roles(codes), F.col("event_code"))).alias("r")
        return df.select("order_id", *more, "event_ts", role).select("order_id", *more, "event_ts", "r.*")

    inside = rows(warehouse, WAREHOUSE_INTERVALS)
    start, end = INTERVALS["ready_to_pickup"]
    pickup = rows(warehouse.where(F.col("event_code") == start), ("ready_to_pickup",)).where("start").unionByName(rows(tracking.where(F.col("event_code") == end), ("ready_to_pickup",)).where("not start"))
    moved = rows(tracking, ("carrier_transit", "hub_dwell"), "shipment", "location").withColumn("location", F.when(F.col("interval_code") == "hub_dwell", F.col("location")))
    return inside, pickup, moved


def interval_groups(warehouse: DataFrame, tracking: DataFrame, keep=whole) -> DataFrame:
    """All interval instances and their flags: per order, per shipment or per location.  Each aggregation groups by the order first,
    by which stored events are bucketed; ``keep`` may store the groups likewise."""
    keys, none = ["order_id", "shipment", "location"], F.lit(None).cast("string")
    inside, pickup, moved = interval_parts(warehouse, tracking)
    alone = lambda df: _spans(df, ["order_id"]).select("order_id", none.alias("shipment"), none.alias("location"), "*")
    one = lambda df: df.select(*keys, "interval_code", "start_ts", "end_ts", "boundary_missing", "end_before_start", "cycles", "between")
    spans = keep(one(alone(inside)).unionByName(one(alone(pickup))).unionByName(one(_spans(moved, keys))), "order_id")
    return _resolved(spans, interval_events(warehouse, tracking), keys, keep)


def instances(groups: DataFrame) -> DataFrame:
    """The groups that have a complete pair."""
    return groups.where("end_ts is not null").select("order_id", "shipment", "location", "interval_code", "start_ts", "end_ts", "hours")


def evaluate(orders: DataFrame, warehouse: DataFrame, tracking: DataFrame, keep=whole) -> Facts:
    """``keep`` may store the tables that several steps read, with a second argument bucketed by that column."""
    o = prepare_orders(orders, keep)
    created = o.valid.select("order_id", instant(o.valid, "created_at").alias("created_ts"))
    wh, wh_warnings = prepare_events(warehouse, "event_id", created, keep)
    tr, tr_warnings = prepare_events(tracking, "tracking_event_id", created, keep)
    decided = dealt(order_decisions(o.valid), "order_id")
    groups = interval_groups(wh, tr, keep)
    bad_wh = wh.where(F.col("event_code").isin(*WAREHOUSE_ANOMALIES)).select("order_id").distinct().withColumn("qc_failed", F.lit(True))
    bad_tr = tr.where(F.col("event_code").isin(*TRACKING_ANOMALIES)).groupBy("order_id").agg(F.array_sort(F.collect_set("event_code")).alias("tracking_anomalies"))
    facts = decided.join(bad_wh, "order_id", "left").join(bad_tr, "order_id", "left")
    codes = F.coalesce("tracking_anomalies", F.array().cast("array<string>"))
    reasons = F.array_compact(F.array(
        F.when(F.col("order_status") == "returned", "order_returned"), F.when(F.col("partial"), "partial_delivery"), F.when(F.col("qc_failed"), "quality_check_failed"), F.when(F.size(codes) > 0, F.concat(F.lit("tracking: "), F.array_join(codes, ", "))),
    ))
    # `returned` among tracking codes also makes a returned order; return_initiated does not
    returned = (F.col("order_status") == "returned") | F.array_contains(codes, "returned")
    kinds = F.array_compact(F.array(F.when(returned, "returned_order"), F.when(F.col("partial"), "partial_delivery"), F.when(F.col("qc_failed"), "quality_check_failed"), F.when(F.size(codes) > 0, "tracking_exception")))
    facts = keep(facts.withColumns({"anomaly_reasons": reasons, "anomaly_types": kinds, "anomaly": F.size(reasons) > 0}).drop("qc_failed", "tracking_anomalies"), "order_id")
    warnings = o.warnings.unionByName(wh_warnings).unionByName(tr_warnings).unionByName(warning(facts.where("negative_duration"), "NEGATIVE_FULFILLMENT_DURATION", "order_id"))
    for flag, code in (("boundary_missing", "NODE_BOUNDARY_MISSING"), ("end_before_start", "NODE_END_BEFORE_START"), ("many_cycles", "MULTIPLE_NODE_CYCLES")):
        warnings = warnings.unionByName(warning(groups.where(flag), code, "order_id", None, "interval_code"))
    eligible = groups.select("order_id", "interval_code").distinct()
    return Facts(facts, instances(groups), eligible, keep(distinct_warnings(warnings)), keep(o.totals), wh, tr)


def restrict(facts: Facts, ids: DataFrame) -> Facts:
    """Facts of the orders in ``ids`` (order_id).  The total is then their number and no order is invalid;
    warnings without an order stay."""
    keep = lambda df: df.join(ids, "order_id", "left_semi")
    orders = keep(facts.orders)
    totals = orders.agg(F.count(F.lit(1)).alias("total"), F.lit(0).cast("long").alias("invalid"))
    warnings = keep(facts.warnings).select(facts.warnings.columns).unionByName(facts.warnings.where("order_id is null"))
    return Facts(orders, keep(facts.intervals), keep(facts.eligible), warnings, totals, keep(facts.warehouse), keep(facts.tracking))


def last_mile(tracking: DataFrame, keep=whole) -> DataFrame:
    """Per order and shipment, as :func:`pair` gives them: ``destination_dwell`` from the first arrival in the destination city to the first
    later start of delivery or delivery, and ``delivery_attempt`` from the first start of delivery to the first later delivery."""
    code = F.col("event_code")
    role = lambda name, start: F.struct(F.lit(name).alias("interval_code"), F.lit(start).alias("start"))
    dwell, attempt = "destination_dwell", "delivery_attempt"
    roles = F.when(code == "arrived_at_destination_city", F.array(role(dwell, True))).when(code == "out_for_delivery", F.array(role(dwell, False), role(attempt, True))).when(code == "delivered", F.array(role(dwell, False), role(attempt, False)))
    rows = tracking.select("order_id", "shipment", "event_ts", F.explode(roles).alias("r")).select("order_id", "shipment", "event_ts", "r.*")
    return pair(rows, ["order_id", "shipment"], keep)
