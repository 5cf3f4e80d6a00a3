"""Deduplication and event preparation.

Each step is one aggregation or window on a key that the next step shares where it can: orders and events
meet on order_id, which is also the key of everything that follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import is_empty, parse_time
from ..sources.shared import dealt

WARNING = ("code", "order_id", "event_id", "interval_code")


@dataclass
class Orders:
    """``valid`` has one row per usable order, ``totals`` one row (total, invalid), ``warnings`` a row each."""

    valid: DataFrame
    totals: DataFrame
    warnings: DataFrame


def warning(df: DataFrame, code: str | Column, order_id: Column | str | None = None, event_id: Column | str | None = None, interval: Column | str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select((F.lit(code) if isinstance(code, str) else code).alias("code"), pick(order_id).alias("order_id"), pick(event_id).alias("event_id"), pick(interval).alias("interval_code"))


def instant(df: DataFrame, name: str) -> Column:
    """A time column as an instant: text is parsed, timestamps are taken as they are."""
    kind = df.schema[name].dataType.simpleString()
    return parse_time(name) if kind == "string" else F.col(name).cast("timestamp")


#: So many keys of 8 bytes are sent to every executor, whatever the planner's own limit; more are shuffled.
FEW = 2_000_000


def whole(df: DataFrame, by: str | None = None) -> DataFrame:
    """The ``keep`` that stores nothing."""
    return df


def small(df: DataFrame, keep) -> DataFrame:
    """``df`` as ``keep`` stores it, to be broadcast if it then has few rows."""
    held = keep(df)
    return held if keep is whole or held.count() > FEW else F.broadcast(held)


def split(df: DataFrame, key: str, keep=whole) -> tuple[DataFrame, DataFrame]:
    """The rows whose key stands alone, and one row for each other key: the first by source_index.  Both with ``n`` (rows) and
    ``conflict`` (rows that differ).

    Keys are counted by their hashes, which move 8 bytes a row; ``keep`` may store the hashes that repeat, and while they are few
    the table is not moved.  Only rows of such keys are grouped, by the key itself: where two keys share a hash, both are groups of
    one row.  Rows are compared as structs: a hash of the values would pass over nulls, so a value that moves from one column
    to another would look the same.
    """
    body = [c for c in df.columns if c not in ("source_index", key)]
    code = F.xxhash64(key)
    many = small(df.groupBy(code.alias("key_code")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key_code"), keep)
    alone = df.join(many, code == F.col("key_code"), "left_anti").select(key, *body, "source_index", F.lit(1).cast("long").alias("n"), F.lit(False).alias("conflict"))
    same = F.struct(*body)
    first = F.min_by(F.struct(*body, "source_index"), "source_index").alias("first")
    groups = df.join(many, code == F.col("key_code"), "left_semi").groupBy(key).agg(first, F.count(F.lit(1)).alias("n"), (F.min(same) != F.max(same)).alias("conflict"))
    return alone, keep(groups.select(key, "first.*", "n", "conflict"))


def deduplicated(df: DataFrame, key: str, keep=whole) -> DataFrame:
    """One row per key, as :func:`split` gives them."""
    alone, groups = split(df, key, keep)
    return alone.unionByName(groups)


def prepare_orders(orders: DataFrame, keep=whole) -> Orders:
    """Blank ids are invalid, identical repeats collapse to the first, conflicting ones are set aside."""
    blank = orders.where(is_empty("order_id"))
    one = deduplicated(orders.where(~is_empty("order_id")), "order_id", keep)
    valid = one.where(~F.col("conflict")).drop("n", "conflict")
    lost = blank.agg(F.count(F.lit(1)).alias("blank"))
    totals = one.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum(F.col("conflict").cast("long")), F.lit(0)).alias("conflicts")).crossJoin(lost)  # one row on either side
    totals = totals.select((F.col("ids") + F.col("blank")).alias("total"), (F.col("conflicts") + F.col("blank")).alias("invalid"))
    warnings = warning(blank, "ORDER_ID_MISSING").unionByName(warning(one.where("conflict"), "DUPLICATE_ORDER_CONFLICT", "order_id")).unionByName(warning(one.where("n > 1 and not conflict"), "EXACT_DUPLICATE_ORDER", "order_id"))
    return Orders(valid, totals, warnings)


def prepare_events(events: DataFrame, id_col: str, created: DataFrame, keep=whole) -> tuple[DataFrame, DataFrame]:
    """Usable events with ``event_ts``, and warnings.  ``created``: order_id and created_ts of valid orders.

    In order: blank ids go, repeats collapse or are set aside, then an event goes if its order is not valid,
    if its time is no instant, or if it precedes the order's creation.  An event earlier than the one before
    it in the source (same order and shipment, among those that stay) is only marked.  ``keep`` may store what several later steps read:
    each table moves and is written once, by order, and columns that follow from others are added when it is read.
    """
    blank = events.where(is_empty(id_col))
    alone, groups = split(events.where(~is_empty(id_col)), id_col, keep)
    one = alone.unionByName(groups.where("not conflict")).drop("n", "conflict")
    text = events.schema["event_time"].dataType.simpleString() == "string"
    one = one.withColumn("event_ts", instant(events, "event_time"))
    known = created.select("order_id", "created_ts", F.lit(True).alias("known"))
    has = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) if c in events.columns else F.lit("")
    shipment, location = has("shipment_id"), has("location_code")
    rows = dealt(one.where("order_id is not null"), "order_id").join(known, "order_id", "left")
    fault = F.when(F.col("known").isNull(), "ORPHAN_EVENT").when(F.col("event_ts").isNull(), "INVALID_EVENT_TIME").when(F.col("event_ts") < F.col("created_ts"), "EVENT_BEFORE_ORDER_CREATED")
    rows = rows.withColumn("fault", fault).withColumn("shipment", shipment)
    past = by_order("shipment").orderBy("source_index", id_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("fault").isNull(), F.col("event_ts")), ignorenulls=True).over(past)
    rows = rows.withColumn("out_of_order", F.col("fault").isNull() & F.coalesce(F.col("event_ts") < before, F.lit(False)))
    rows = keep(rows.select(*events.columns, *(["event_ts"] if text else []), "fault", "out_of_order"), "order_id")
    kept = rows.where("fault is null").drop("fault").withColumn("event_ts", F.col("event_ts") if text else instant(events, "event_time"))
    kept = kept.withColumn("shipment", shipment).withColumn("location", location)
    # scans are counted by a hash within their order, and only those of orders with a repeated one as they are
    scan = ["order_id", "event_code", "event_ts", "shipment", "location"]
    twice = kept.groupBy("order_id", F.xxhash64(*scan[1:]).alias("scan")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("order_id").distinct()
    again = kept.join(small(twice, keep), "order_id", "left_semi").groupBy(*scan).agg(F.count(F.lit(1)).alias("k"), F.min_by(id_col, "source_index").alias("first_id")).where("k > 1")
    parts = [
        warning(blank, "EVENT_ID_MISSING", "order_id"), warning(groups.where("conflict"), "DUPLICATE_EVENT_CONFLICT", None, id_col), warning(groups.where("n > 1 and not conflict"), "EXACT_DUPLICATE_EVENT", None, id_col),
        warning(one.where("order_id is null"), "ORPHAN_EVENT", "order_id", id_col), warning(rows.where("fault is not null"), F.col("fault"), "order_id", id_col),
        warning(kept.where("out_of_order"), "SOURCE_EVENT_OUT_OF_ORDER", "order_id", id_col), warning(again, "POSSIBLE_DUPLICATE_SCAN", "order_id", "first_id"),
    ]
    warnings = parts[0]
    for p in parts[1:]:
        warnings = warnings.unionByName(p)
    return kept, warnings


def by_order(*more: str) -> WindowSpec:
    """Windows of an order, or of its parts.  Ids of orders begin alike, so sorting compares their hashes first."""
    return Window.partitionBy(F.xxhash64("order_id"), "order_id", *more)


def event_order(id_col: str) -> list[Column]:
    """The order of events within an order: time, sequence number (0 if none), source place, id."""
    return [F.col("event_ts"), F.coalesce(F.col("sequence_number"), F.lit(0)) if id_col == "tracking_event_id" else F.lit(0), F.col("source_index"), F.col(id_col)]


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.dropDuplicates(list(WARNING))
