"""Diagnostic rules and their roll-ups.

Every rule returns evidence rows (rule_id, finding, severity, order_id, dimension, dimension_value, observed,
threshold, baseline); a finding is one (rule_id, finding).  ``coverage`` and ``sample_size`` of findings come
with them, so that roll-ups are plain aggregations of one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import COMPLETED, INTERVALS, SEVERITY_RANK, TRANSITIONS, UNKNOWN, WAREHOUSE_INTERVALS, Rule
from ..functions.scalars import close, hours_between, local_date, ratio, six_hour_bucket, variant_hash, weekday_label
from ..sources.shared import stored
from .facts import Facts, last_mile
from .metrics import count_if, node_aggregates
from .prep import by_order, event_order
from .quantiles import array_quantile, counts, of_counts, others_quantile, quantiles, with_quantiles

EVIDENCE = "rule_id string, category string, priority int, finding string, severity string, order_id string, dimension string, dimension_value string, observed double, threshold double, baseline double, coverage double, sample_size long"


def _evidence(df: DataFrame, rule: Rule, finding: Column | str, severity: Column | str, dimension: str | None = None, value: Column | None = None, observed: Column | None = None, threshold: Column | None = None, baseline: Column | None = None, coverage: Column | None = None, sample: Column | None = None) -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    cast = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return df.select(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"), F.lit(rule.priority).alias("priority"), lit(finding).alias("finding"), lit(severity).alias("severity"), "order_id", F.lit(dimension).cast("string").alias("dimension"), cast(value, "string").alias("dimension_value"),
        cast(observed, "double").alias("observed"), cast(threshold, "double").alias("threshold"), cast(baseline, "double").alias("baseline"), cast(coverage, "double").alias("coverage"), cast(sample, "long").alias("sample_size"),
    )


def warehouse_delay(f: Facts, rule: Rule) -> DataFrame:
    """Per interval: longer than its threshold, or than a multiple of the median of the same warehouse where its
    sample is large enough."""
    limit = F.element_at(F.create_map(*(x for c in WAREHOUSE_INTERVALS for x in (F.lit(c), F.lit(float(rule[f"{c}_threshold_hours"]))))), F.col("interval_code"))
    rows = f.intervals.where(F.col("interval_code").isin(*WAREHOUSE_INTERVALS)).join(f.orders.select("order_id", "warehouse_id"), "order_id")
    by = ["warehouse_id", "interval_code"]
    # an order has each of these intervals once at most, so counted hours tell samples, and which of them are hit
    hours = stored(counts(rows, by, "hours"), "counted")
    base = with_quantiles(hours.groupBy(*by).agg(F.sum("c").alias("n")), by, of_counts(hours, by, {"median": 0.5}))
    size = hours.groupBy("interval_code").agg(F.sum("c").alias("sample"))
    valid = f.orders.agg(F.count(F.lit(1)).alias("valid"))  # one row
    over = lambda h: (F.col(h) > F.col("limit")) | ((F.col("n") >= rule["minimum_baseline_sample"]) & (F.col(h) > rule["baseline_multiplier"] * F.col("median")))
    # a row for each warehouse and interval, and for each interval: small next to the rows
    worst = hours.join(base, by).withColumn("limit", limit).where(over("v")).groupBy("interval_code").agg(F.max(F.col("v") / F.col("limit")).alias("worst"))
    hit = rows.join(F.broadcast(base), by).withColumn("limit", limit).where(over("hours"))
    hit = hit.join(F.broadcast(worst), "interval_code").join(F.broadcast(size), "interval_code").crossJoin(F.broadcast(valid))  # five rows, five rows, one row
    severity = F.when(F.col("worst") > 2, "high").otherwise("medium")
    return _evidence(hit, rule, F.col("interval_code"), severity, "node", F.col("interval_code"), F.col("hours"), F.col("limit"), F.col("median"), ratio(F.col("sample"), F.col("valid")), F.col("sample"))


def _coverage(f: Facts, code: str) -> DataFrame:
    own = F.col("interval_code") == code
    got = f.intervals.where(own).agg(F.count("hours").alias("sample"), F.count_distinct("order_id").alias("computable"))
    may = f.eligible.where(own).agg(F.count(F.lit(1)).alias("eligible"))
    return got.crossJoin(may).select(ratio(F.col("computable"), F.col("eligible")).alias("coverage"), "sample")  # one row on either side


def pickup_delay(f: Facts, rule: Rule) -> DataFrame:
    limit = float(rule["threshold_hours"])
    rows = f.intervals.where(f"interval_code = 'ready_to_pickup' and hours > {limit}")
    worst = rows.agg(F.max("hours").alias("worst"))
    rows = rows.crossJoin(F.broadcast(worst)).crossJoin(F.broadcast(_coverage(f, "ready_to_pickup")))  # one row each
    severity = F.when(F.col("worst") > 3 * limit, "critical").otherwise("high")
    return _evidence(rows, rule, "ready_to_pickup", severity, "node", F.lit("ready_to_pickup"), F.col("hours"), F.lit(limit), None, F.col("coverage"), F.col("sample"))


def linehaul_tail(f: Facts, rule: Rule) -> DataFrame:
    limit = float(rule["threshold_hours"])
    rows = f.intervals.where("interval_code = 'carrier_transit'").join(f.orders.where("order_status <> 'cancelled'").select("order_id"), "order_id", "left_semi")
    hours = stored(counts(rows, [], "hours"), "counted")
    base = with_quantiles(hours.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("sample")), [], of_counts(hours, [], {"tail": rule["percentile"]}))
    rows = rows.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(_coverage(f, "carrier_transit").select("coverage")))  # one row each
    hit = rows.where((F.col("hours") > limit) | ((F.col("sample") >= rule["minimum_baseline_sample"]) & (F.col("hours") > F.col("tail"))))
    return _evidence(hit, rule, "carrier_transit", "high", "node", F.lit("carrier_transit"), F.col("hours"), F.lit(limit), F.col("tail"), F.col("coverage"), F.col("sample"))


def last_mile_backlog(f: Facts, rule: Rule) -> DataFrame:
    rows = last_mile(f.tracking, lambda df, by=None: stored(df, "last_mile", by)).where("start_ts is not null")
    limits = {"destination_dwell": float(rule["station_dwell_threshold_hours"]), "delivery_attempt": float(rule["delivery_attempt_threshold_hours"])}
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("interval_code"))
    # orders first, so that the count of distinct ones moves no row
    orders = rows.groupBy("interval_code", "order_id").agg(F.max(F.col("hours").isNotNull().cast("int")).alias("timed"))
    cover = orders.groupBy("interval_code").agg(F.sum("timed").alias("sample"), F.count(F.lit(1)).alias("all"))
    hit = rows.where(F.col("hours") > limit).join(F.broadcast(cover), "interval_code")  # two rows
    return _evidence(hit, rule, F.col("interval_code"), rule.severity, "node", F.col("interval_code"), F.col("hours"), limit, None, ratio(F.col("sample"), F.col("all")), F.col("sample"))


def carrier_relative(f: Facts, rule: Rule) -> DataFrame:
    """Each carrier against all others pooled.  Rates follow from totals by subtraction; the others' P90 is read
    from the running count of all durations less the carrier's own."""
    done = f.orders.where(F.col("order_status").isin(*COMPLETED) & (F.col("carrier_id") != UNKNOWN))
    own = done.groupBy("carrier_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("otif") == "true").alias("yes"), count_if(F.col("otif").isin("true", "false")).alias("known"), F.count("duration_hours").alias("n_d"),
    )
    own = with_quantiles(own, ["carrier_id"], quantiles(done, ["carrier_id"], "duration_hours", {"p90": 0.9}))
    totals = own.agg(F.sum("yes").alias("all_yes"), F.sum("known").alias("all_known"), F.sum("n_d").alias("all_d"))
    peers = others_quantile(done.select("carrier_id", "duration_hours"), "carrier_id", "duration_hours", 0.9)
    c = own.crossJoin(F.broadcast(totals)).join(peers, "carrier_id", "left")  # one row; a row per carrier
    rate, peer = ratio(F.col("yes"), F.col("known")), ratio(F.col("all_yes") - F.col("yes"), F.col("all_known") - F.col("known"))
    cover = ratio(F.col("known"), F.col("n"))
    least = rule["minimum_sample"]
    gap, step = peer - rate, F.lit(float(rule["otif_gap"]))
    rate_hit = (F.col("known") >= least) & (F.col("all_known") - F.col("known") >= least) & (cover >= rule["minimum_coverage"]) & ((gap > step) | close(gap, step))
    p90_hit = (F.col("n_d") >= least) & (F.col("all_d") - F.col("n_d") >= least) & (F.col("p90") >= F.col("peer_p90") * rule["p90_ratio"])
    c = c.withColumns({"rate": rate, "peer": peer, "coverage": cover, "rate_hit": F.coalesce(rate_hit, F.lit(False)), "p90_hit": F.coalesce(p90_hit, F.lit(False))}).where("rate_hit or p90_hit")
    rows = done.select("order_id", "carrier_id").join(c, "carrier_id")  # a row per carrier
    severity = F.when(F.col("rate_hit") & F.col("p90_hit"), "high").otherwise(rule.severity)
    pick = lambda a, b: F.when(F.col("rate_hit"), a).otherwise(b)
    return _evidence(rows, rule, F.col("carrier_id"), severity, "carrier", F.col("carrier_id"), pick(F.col("rate"), F.col("p90")), pick(step, F.col("peer_p90") * rule["p90_ratio"]), pick(F.col("peer"), F.col("peer_p90")), F.col("coverage"), F.col("n"))


def warehouse_congestion(f: Facts, rule: Rule, zone: str = "UTC") -> DataFrame:
    day = f.orders.where("created_ts is not null").withColumn("day", local_date("created_ts", zone)).where(F.col("warehouse_id") != UNKNOWN)
    inner = f.intervals.where(F.col("interval_code").isin(*WAREHOUSE_INTERVALS)).groupBy("order_id").agg(F.sum("hours").alias("inside"))
    timed, by = day.join(inner, "order_id", "left"), ["warehouse_id", "day"]
    days = with_quantiles(timed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("inside").alias("n_inside")), by, quantiles(timed, by, "inside", {"p90": 0.9}))
    past = Window.partitionBy("warehouse_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    days = days.withColumns({"days": F.count(F.lit(1)).over(past), "base_n": array_quantile(F.collect_list("n").over(past), 0.5), "p90_days": F.count("p90").over(past), "base_p90": array_quantile(F.collect_list("p90").over(past), 0.5)})
    need = rule["minimum_baseline_days"]
    hit = days.where((F.col("n") >= rule["minimum_daily_orders"]) & (F.col("days") >= need) & (F.col("p90_days") >= need) & (F.col("n") >= rule["volume_ratio"] * F.col("base_n")) & (F.col("p90") >= rule["duration_ratio"] * F.col("base_p90")))
    rows = day.select("order_id", "warehouse_id", "day").join(hit, ["warehouse_id", "day"])
    return _evidence(rows, rule, F.concat_ws(" ", "warehouse_id", F.col("day").cast("string")), rule.severity, "warehouse", F.col("warehouse_id"), F.col("p90"), rule["duration_ratio"] * F.col("base_p90"), F.col("base_p90"), ratio(F.col("n_inside"), F.col("n")), F.col("n"))


# Engine warnings that count as data-quality findings, with their severities.
QUALITY_CODES = {
    "DUPLICATE_ORDER_CONFLICT": "high", "DUPLICATE_EVENT_CONFLICT": "high", "ORPHAN_EVENT": "high", "INVALID_EVENT_TIME": "high", "EVENT_BEFORE_ORDER_CREATED": "high",
    "SOURCE_EVENT_OUT_OF_ORDER": "medium", "POSSIBLE_DUPLICATE_SCAN": "medium", "NODE_BOUNDARY_MISSING": "medium", "NODE_END_BEFORE_START": "high",
}


def transitions(tracking: DataFrame) -> DataFrame:
    """Adjacent tracking events per order and shipment: codes, hours between, and whether the change is allowed."""
    w = by_order("shipment").orderBy(*event_order("tracking_event_id"))
    rows = tracking.select("order_id", "shipment", F.col("event_code").alias("a"), F.lead("event_code").over(w).alias("b"), hours_between(F.col("event_ts"), F.lead("event_ts").over(w)).alias("gap_hours")).where("b is not null")
    allowed = F.create_map(*(x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    free = (F.col("a") == "unmapped") | (F.col("b") == "unmapped") | (F.col("a") == "exception")
    return rows.withColumn("allowed", free | F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("a")), F.col("b")), F.lit(False)))


def data_quality(f: Facts, rule: Rule, has_tracking: bool = True) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for kv in QUALITY_CODES.items() for x in kv))
    parts = [_evidence(f.warnings.where(F.col("code").isin(*QUALITY_CODES)), rule, F.col("code"), F.element_at(codes, F.col("code")))]
    limit = float(rule["long_interval_threshold_hours"])
    found = lambda when, code, severity, gap: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), gap.cast("double").alias("gap")))
    both = F.array_compact(F.array(found(~F.col("allowed"), "STATE_JUMP", "medium", F.lit(None)), found(F.col("gap_hours") > limit, "LONG_INTERVAL", "high", F.col("gap_hours"))))
    steps = transitions(f.tracking).where(~F.col("allowed") | (F.col("gap_hours") > limit)).select("order_id", F.explode(both).alias("x")).select("order_id", "x.*")
    parts.append(_evidence(steps, rule, F.col("code"), F.col("severity"), None, None, F.col("gap"), F.when(F.col("gap").isNotNull(), F.lit(limit))))
    for df in (f.warehouse, f.tracking):
        parts.append(_evidence(df.where("event_code = 'unmapped'"), rule, "UNMAPPED_EVENT", "medium"))
    if has_tracking:
        ended = f.tracking.where("event_code in ('delivered', 'returned')").select("order_id")
        parts.append(_evidence(f.orders.where(F.col("order_status").isin(*COMPLETED)).join(ended, "order_id", "left_anti"), rule, "TERMINAL_EVENT_MISSING", "medium"))
    return reduce(DataFrame.unionByName, parts)


def time_concentration(f: Facts, others: DataFrame, rule: Rule, zone: str = "UTC") -> DataFrame:
    """Orders hit by any other rule: the largest weekday and six-hour share.  Ties go to the first label."""
    hit = f.orders.join(others.where("order_id is not null").select("order_id").distinct(), "order_id", "left_semi").where("created_ts is not null")
    local = F.from_utc_timestamp("created_ts", zone)
    hit = hit.select("order_id", F.to_date(local).alias("day"), F.explode(F.array(F.struct(F.lit("weekday").alias("kind"), weekday_label(F.to_date(local)).alias("label")), F.struct(F.lit("six_hours").alias("kind"), six_hour_bucket(local).alias("label")))).alias("x")).select("order_id", "day", "x.*")
    # one sum per label, then a few labels per kind
    sums = hit.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    span = hit.where("kind = 'weekday'").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("day").alias("days"))
    top = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "label"))
    best = sums.withColumn("r", top).where("r = 1").crossJoin(span).where((F.col("total") >= rule["minimum_anomaly_orders"]) & (F.col("days") >= rule["minimum_distinct_dates"]) & (F.col("n") / F.col("total") >= rule["concentration_share"]))
    rows = hit.join(F.broadcast(best), ["kind", "label"])
    return _evidence(rows, rule, F.concat_ws(":", "kind", "label"), rule.severity, "time", F.col("label"), F.col("n") / F.col("total"), F.lit(float(rule["concentration_share"])), None, F.lit(1.0), F.col("total"))


def analyze(f: Facts, rules: dict[str, Rule], zone: str = "UTC", keep=None) -> DataFrame:
    """All evidence rows.  ``keep`` stores the first seven rules' rows, which the eighth reads again."""
    first = reduce(DataFrame.unionByName, (
        warehouse_delay(f, rules["FL-WH-001"]), pickup_delay(f, rules["FL-PU-001"]), linehaul_tail(f, rules["FL-LH-001"]), last_mile_backlog(f, rules["FL-LM-001"]),
        carrier_relative(f, rules["FL-CR-001"]), warehouse_congestion(f, rules["FL-WC-001"], zone), data_quality(f, rules["FL-DQ-001"]),
    ))
    first = keep(first) if keep else first
    return first.unionByName(time_concentration(f, first, rules["FL-TC-001"], zone))


def rank(severity: Column | str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv)), F.col(severity) if isinstance(severity, str) else severity)


def findings(evidence: DataFrame) -> DataFrame:
    """One row per finding, with its distinct orders; ordered by ``place``: severity, priority, orders."""
    g = evidence.groupBy("rule_id", "category", "priority", "finding", "severity", "dimension", "dimension_value").agg(F.count_distinct("order_id").alias("affected"), F.count(F.lit(1)).alias("evidence_rows"), F.first("coverage", True).alias("coverage"), F.first("sample_size", True).alias("sample_size"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(rank("severity").desc(), F.desc("priority"), F.desc("affected"), "rule_id", "finding")))  # findings are few


def pareto(evidence: DataFrame) -> DataFrame:
    """Distinct orders per category, running share of the sum over categories (orders of two count twice)."""
    g = evidence.where("order_id is not null").groupBy("category").agg(F.count_distinct("order_id").alias("affected"))
    w = Window.orderBy(F.desc("affected"), "category")  # at most eight rows
    run = F.sum("affected").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("cumulative", run).withColumn("cumulative_share", ratio(run, F.sum("affected").over(Window.partitionBy())))


def severity_summary(evidence: DataFrame) -> DataFrame:
    one = evidence.groupBy("severity").agg(F.count_distinct("rule_id", "finding").alias("findings"), F.count_distinct("order_id").alias("affected"))
    four = evidence.sparkSession.createDataFrame([(s, r) for s, r in SEVERITY_RANK.items()], "severity string, severity_rank int")
    return four.join(one, "severity", "left").select("severity", "severity_rank", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("affected", F.lit(0)).alias("affected"))


def bottlenecks(f: Facts, evidence: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    limits = {c: float(rules["FL-WH-001"][f"{c}_threshold_hours"]) for c in WAREHOUSE_INTERVALS} | {"ready_to_pickup": float(rules["FL-PU-001"]["threshold_hours"]), "carrier_transit": float(rules["FL-LH-001"]["threshold_hours"])}
    frame = f.orders.sparkSession.createDataFrame([(c, i, limits.get(c)) for i, c in enumerate(INTERVALS)], "interval_code string, declared int, threshold double")
    hit = evidence.where("dimension = 'node'").groupBy(F.col("dimension_value").alias("interval_code")).agg(F.count_distinct("order_id").alias("affected"))
    nodes = node_aggregates(f.intervals, f.eligible, [])
    out = frame.join(nodes, "interval_code", "left").join(hit, "interval_code", "left")
    affected = F.coalesce("affected", F.lit(0))
    return out.select("interval_code", "declared", "mean", "p90", "threshold", F.coalesce("n", F.lit(0)).alias("n"), affected.alias("affected"), "coverage", ((affected > 0) | F.coalesce(F.col("p90") > F.col("threshold"), F.lit(False))).alias("is_bottleneck"))


def dimension_insights(f: Facts, evidence: DataFrame) -> DataFrame:
    """Warehouse, carrier and region of affected orders: distinct findings and orders, highest severity, categories."""
    names, keys = ("warehouse_id", "carrier_id", "destination_region"), ["dimension_type", "dimension_key"]
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension_type"), F.col(d).alias("dimension_key")) for d in names))).alias("d")
    dims, hit = f.orders.select("order_id", *names), evidence.where("order_id is not null")

    def summed(rows: DataFrame, *more: str) -> DataFrame:
        """How many rows the values of the dimensions have together, then each value by itself."""
        some = rows.join(dims, "order_id").groupBy(*names, *more).agg(F.count(F.lit(1)).alias("k"))
        return some.select(each, *more, "k").select("d.*", *more, "k")

    orders = summed(hit.select("order_id").distinct()).groupBy(*keys).agg(F.sum("k").alias("affected"))
    rows = summed(hit, "rule_id", "finding", "category", "severity")
    found = rows.groupBy(*keys).agg(F.count_distinct("rule_id", "finding").alias("findings"), F.max_by("severity", rank("severity")).alias("severity"), F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("categories"))
    return found.join(orders, reduce(Column.__and__, (found[k].eqNullSafe(orders[k]) for k in keys))).select(found["dimension_type"], found["dimension_key"], "findings", "affected", "severity", "categories")


def affected_orders(evidence: DataFrame) -> DataFrame:
    """Per order: highest severity, categories, rules and findings."""
    rows = evidence.where("order_id is not null")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    severity = F.element_at(F.create_map(*(F.lit(x) for s, r in SEVERITY_RANK.items() for x in (r, s))), F.max(rank("severity")))
    # an order's findings are few: one set of them takes one aggregation, a distinct count takes two more
    return rows.groupBy("order_id").agg(severity.alias("severity"), joined("category").alias("categories"), joined("rule_id").alias("rules"), F.size(F.collect_set(F.struct("rule_id", "finding"))).cast("long").alias("findings"))


def context(f: Facts, evidence: DataFrame) -> DataFrame:
    """One row: orders, those that some finding affects and their share, findings, and rules that found something."""
    found = evidence.agg(
        F.count_distinct("order_id").alias("affected"), F.count_distinct("rule_id", "finding").alias("findings"), F.count_distinct("rule_id").alias("rules"),
    )
    orders = f.orders.agg(F.count(F.lit(1)).alias("orders"))
    return orders.crossJoin(found).withColumn("affected_share", ratio(F.col("affected"), F.col("orders")))  # one row on either side


def samples(evidence: DataFrame, most: int = 20) -> DataFrame:
    """Per finding its evidence rows and its first ``most`` orders by id, as a sorted array."""
    rows = evidence.groupBy("rule_id", "finding").agg(F.count(F.lit(1)).alias("evidence_rows"), F.count_distinct("order_id").alias("affected"))
    ids = evidence.where("order_id is not null").select("rule_id", "finding", "order_id").distinct()
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("rule_id", "finding").orderBy("order_id"))).where(F.col("r") <= most)
    held = first.groupBy("rule_id", "finding").agg(F.array_sort(F.collect_list("order_id")).alias("sample"))
    empty = F.array().cast("array<string>")
    return rows.join(held, ["rule_id", "finding"], "left").withColumn("sample", F.coalesce("sample", empty))


def evidence_list(f: Facts, evidence: DataFrame, most: int = 20) -> DataFrame:
    """Per finding its first ``most`` evidence rows by order and falling value, each with a text and the ids of the events that bound its
    interval: rule_id, finding, place, order_id, text, event_ids.

    The rank is cut to ``most`` a group before the shuffle already, so a finding of many rows moves few; events are looked up for
    the orders that are left.
    """
    by = Window.partitionBy("rule_id", "finding").orderBy(F.col("order_id").asc_nulls_last(), F.col("observed").desc_nulls_last(), F.col("threshold").asc_nulls_last())
    first = evidence.select("rule_id", "finding", "order_id", "dimension", "dimension_value", "observed", "threshold", F.row_number().over(by).alias("place")).where(F.col("place") <= most)
    span = f.intervals.select("order_id", F.col("interval_code").alias("dimension_value"), "start_ts", "end_ts", "hours")
    ends = F.create_map(*(x for c, (a, b) in INTERVALS.items() for x in (F.lit(c), F.array(F.lit(a), F.lit(b)))))
    # the findings of intervals are nine at most, so these rows are few
    timed = span.join(F.broadcast(first.where("dimension = 'node'")), ["order_id", "dimension_value"]).where("abs(hours - observed) < 1e-9")
    each = F.explode(F.array(F.struct(F.get(ends[F.col("dimension_value")], F.lit(0)).alias("event_code"), F.col("start_ts").alias("event_ts")), F.struct(F.get(ends[F.col("dimension_value")], F.lit(1)).alias("event_code"), F.col("end_ts").alias("event_ts"))))
    bounds = timed.select("rule_id", "finding", "place", "order_id", each.alias("b")).select("rule_id", "finding", "place", "order_id", "b.*")
    found = merged_events(f).select("order_id", "event_code", "event_ts", "id").join(F.broadcast(bounds), ["order_id", "event_code", "event_ts"])
    ids = found.groupBy("rule_id", "finding", "place").agg(F.array_sort(F.collect_set("id")).alias("event_ids"))
    number = lambda c: F.format_string("%.4f", F.col(c))
    text = F.when(F.col("observed").isNull(), F.col("finding")).otherwise(F.concat(F.col("finding"), F.lit(": "), number("observed"), F.lit(" against "), number("threshold")))
    out = first.join(ids, ["rule_id", "finding", "place"], "left")
    return out.select("rule_id", "finding", "place", "order_id", text.alias("text"), F.coalesce("event_ids", F.array().cast("array<string>")).alias("event_ids"))


def order_findings(evidence: DataFrame, order_id: str) -> DataFrame:
    """One order's findings and those without an order, merged per category: the primary is the one of highest
    severity, then priority; largest sample, least coverage."""
    rows = evidence.where((F.col("order_id") == order_id) | F.col("order_id").isNull())
    first = F.struct(rank("severity").alias("r"), F.col("priority"), F.col("rule_id"), F.col("severity"))
    return rows.groupBy("category").agg(F.max(first).alias("p"), F.concat_ws(",", F.array_sort(F.collect_set("finding"))).alias("findings"), F.max("sample_size").alias("sample_size"), F.min("coverage").alias("coverage")).select("category", F.col("p.rule_id").alias("rule_id"), F.col("p.severity").alias("severity"), "findings", "sample_size", "coverage")


def merged_events(f: Facts) -> DataFrame:
    one = lambda df, i, s: df.select("order_id", F.col(i).alias("id"), "event_ts", "event_code", "source_index", F.lit(s).alias("source"))
    return one(f.warehouse, "event_id", "warehouse").unionByName(one(f.tracking, "tracking_event_id", "tracking"))


def variants(f: Facts, top: int = 20) -> DataFrame:
    """The most frequent sequences of event codes; ties go to the smaller sequence."""
    seq = merged_events(f).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("event_ts", "source_index", "id", "event_code"))).alias("e")).select("order_id", F.col("e.event_code").alias("codes"))
    g = seq.groupBy("codes").agg(F.count(F.lit(1)).alias("n"))
    total = seq.agg(F.count(F.lit(1)).alias("total"))
    path = F.concat_ws("|", "codes")
    return g.crossJoin(F.broadcast(total)).select(variant_hash(F.col("codes")).alias("variant"), path.alias("path"), "n", ratio(F.col("n"), F.col("total")).alias("share")).orderBy(F.desc("n"), "path").limit(top)


def timeline(f: Facts, order_id: str) -> DataFrame:
    return merged_events(f).where(F.col("order_id") == order_id).orderBy("event_ts", "id")
