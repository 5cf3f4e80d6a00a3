"""Metrics, trends, breakdowns and distributions.

Every grouping is one pass: orders are summed once per key, intervals once per key and interval, and the
long form (one row per metric) is unpivoted from those few rows.  Groups are always taken from raw rows,
never from other groups' percentages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import COMPLETED, INTERVALS, LOW_COVERAGE, PENDING, SMALL_SAMPLE, UNKNOWN
from ..functions.scalars import local_date, ratio, week_start
from .facts import Facts
from .quantiles import of_counts, quantiles, with_quantiles

LONG = ("code", "value", "numerator", "denominator", "coverage", "eligible", "computable", "pending", "not_computable")
RATES = {"ot_rate": "ot", "if_rate": "in_full", "otif_rate": "otif"}


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


#: All metrics in the order in which a report lists them.
CODES = (
    "order_count", "valid_order_count", *RATES, *(f"fulfillment_duration_{s}_hours" for s in ("mean", "median", "p90")),
    "cancellation_rate", "return_rate", "anomaly_order_rate", "data_coverage_rate", *(f"node_duration_{i}_{s}_hours" for i in INTERVALS for s in ("mean", "median", "p90")),
)
P50_P90 = {"p50": 0.5, "p90": 0.9}


def order_sums() -> list[Column]:
    """The counts and sums that the order metrics need."""
    s, d = F.col("order_status"), F.col("duration_hours")
    aggs = [count_if(s.isin(*COMPLETED)).alias("n_completed"), count_if(s.isin(*PENDING)).alias("n_pending_status"), F.count(F.lit(1)).alias("n_valid")]
    for c in RATES.values():
        x = F.col(c)
        aggs += [count_if(x == v).alias(f"{c}_{v}") for v in ("true", "false", "not_computable", "pending")]
    done = s.isin(*COMPLETED)
    aggs += [
        F.avg(F.when(done, d)).alias("d_mean"), F.sum(F.when(done, d)).alias("d_sum"), F.count(F.when(done, d)).alias("d_n"),
        count_if(s == "cancelled").alias("n_cancelled"), count_if(s == "returned").alias("n_returned"), count_if(s != "unmapped").alias("n_mapped"), count_if((s != "cancelled") & F.col("anomaly")).alias("n_anomaly"), count_if(s != "cancelled").alias("n_live"),
        count_if(done & F.col("ot").isin("true", "false") & F.col("in_full").isin("true", "false") & d.isNotNull()).alias("n_covered"),
    ]
    return aggs


def completed_hours(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status").isin(*COMPLETED))


def order_aggregates(orders: DataFrame, keys: list[str]) -> DataFrame:
    """All counts, sums and quantiles that the order metrics need, one row per key."""
    found = quantiles(completed_hours(orders), keys, "duration_hours", {f"d_{n}": q for n, q in P50_P90.items()})
    return with_quantiles(orders.groupBy(*keys).agg(*order_sums()), keys, found)


def _row(code: str, value, numerator, denominator, coverage, eligible, computable, pending=None, not_computable=None) -> Column:
    num = lambda c: (F.lit(0) if c is None else F.col(c) if isinstance(c, str) else c).cast("double")
    cells = (F.lit(code), value.cast("double"), F.lit(None).cast("double") if numerator is None else num(numerator), num(denominator), coverage.cast("double"), num(eligible), num(computable), num(pending), num(not_computable))
    return F.struct(*(c.alias(n) for c, n in zip(cells, LONG, strict=True)))


def order_metrics(agg: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of :func:`order_aggregates`, which must also have ``total`` and ``invalid``."""
    c, one = F.col, F.lit(1.0)
    rows = [
        _row("order_count", c("total"), "total", "total", one, "total", "total"),
        _row("valid_order_count", c("n_valid"), "n_valid", "total", ratio(c("n_valid"), c("total")), "total", "n_valid", None, "invalid"),
    ]
    for code, d in RATES.items():
        yes, computable = c(f"{d}_true"), c(f"{d}_true") + c(f"{d}_false")
        eligible = computable + c(f"{d}_not_computable")
        rows.append(_row(code, ratio(yes, computable), yes, computable, ratio(computable, eligible), eligible, computable, f"{d}_pending", f"{d}_not_computable"))
    missing = c("n_completed") - c("d_n")
    cover = ratio(c("d_n"), c("n_completed"))
    rows.append(_row("fulfillment_duration_mean_hours", c("d_mean"), "d_sum", "d_n", cover, "n_completed", "d_n", "n_pending_status", missing))
    rows += [_row(f"fulfillment_duration_{n}_hours", c(v), None, "d_n", cover, "n_completed", "d_n", None, missing) for n, v in (("median", "d_p50"), ("p90", "d_p90"))]
    unmapped = c("n_valid") - c("n_mapped")
    rows += [_row(code, ratio(c(n), c("n_valid")), n, "n_valid", ratio(c("n_mapped"), c("n_valid")), "n_valid", "n_mapped", None, unmapped) for code, n in (("cancellation_rate", "n_cancelled"), ("return_rate", "n_returned"))]
    rows.append(_row("anomaly_order_rate", ratio(c("n_anomaly"), c("n_live")), "n_anomaly", "n_live", F.when(c("n_live") > 0, one), "n_live", "n_live"))
    rows.append(_row("data_coverage_rate", ratio(c("n_covered"), c("n_completed")), "n_covered", "n_completed", F.when(c("n_completed") > 0, one), "n_completed", "n_covered", None, c("n_completed") - c("n_covered")))
    return agg.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")


def node_aggregates(intervals: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and interval: sample, mean, median, P90, distinct computable and eligible orders."""
    by = [*keys, "interval_code"]
    found = quantiles(intervals, by, "hours", {"median": 0.5, "p90": 0.9})
    got = with_quantiles(intervals.groupBy(*by).agg(*interval_sums()), by, found)
    return _covered(eligible.groupBy(*by).agg(F.count(F.lit(1)).alias("eligible")), got, keys)


def interval_sums() -> list[Column]:
    h = F.col("hours")
    return [F.count(h).alias("n"), F.avg(h).alias("mean"), F.sum(h).alias("total"), F.count_distinct("order_id").alias("computable")]


def _covered(may: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    out = may.join(got, [*keys, "interval_code"], "left")
    return out.select(*keys, "interval_code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "computable")), "eligible", "mean", "total", "median", "p90", ratio(F.coalesce("computable", F.lit(0)), F.col("eligible")).alias("coverage"))


def node_metrics(nodes: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """24 rows for every row of ``groups`` (the keys): each interval's mean, median and P90."""
    code = F.explode(F.array(*map(F.lit, INTERVALS))).alias("interval_code")
    full = groups.select(*keys, code).join(nodes, [*keys, "interval_code"], "left") if keys else groups.select(code).join(nodes, "interval_code", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = [
        F.struct(F.concat(F.lit("node_duration_"), "interval_code", F.lit(f"_{s}_hours")).alias("code"), F.col(s).alias("value"), (F.col("total") if s == "mean" else F.lit(None).cast("double")).alias("numerator"), zero("n").cast("double").alias("denominator"),
                 F.col("coverage"), zero("eligible").cast("double").alias("eligible"), zero("computable").cast("double").alias("computable"), F.lit(0.0).alias("pending"), F.greatest(zero("eligible") - zero("computable"), F.lit(0)).cast("double").alias("not_computable"))
        for s in ("mean", "median", "p90")
    ]
    return full.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")


def sample_warnings(n: Column, coverage: Column) -> Column:
    return F.array_compact(F.array(F.when(n == 0, "NO_SAMPLE").when(n < SMALL_SAMPLE, "SMALL_SAMPLE"), F.when(coverage < LOW_COVERAGE, "LOW_COVERAGE")))


def build_metrics(facts: Facts) -> DataFrame:
    """The 36 metrics of a dataset, long form, with their warnings."""
    agg = order_aggregates(facts.orders, []).crossJoin(facts.totals)  # one row on either side
    nodes = node_aggregates(facts.intervals, facts.eligible, [])
    out = order_metrics(agg, []).unionByName(node_metrics(nodes, agg.select("total"), []))
    return out.withColumn("warnings", sample_warnings(F.col("denominator"), F.col("coverage")))


def group_metrics(facts: Facts, key: Column) -> DataFrame:
    """The 36 metrics for each value of ``key``, an expression over orders; one pass over all groups."""
    named = facts.orders.withColumn("group_key", F.coalesce(key, F.lit(UNKNOWN)))
    agg = order_aggregates(named, ["group_key"]).withColumns({"total": F.col("n_valid"), "invalid": F.lit(0).cast("long")})
    ids = named.select("order_id", "group_key")
    nodes = node_aggregates(facts.intervals.join(ids, "order_id"), facts.eligible.join(ids, "order_id"), ["group_key"])
    out = order_metrics(agg, ["group_key"]).unionByName(node_metrics(nodes, agg.select("group_key"), ["group_key"]))
    return out.withColumn("warnings", sample_warnings(F.col("denominator"), F.col("coverage")))


def trend(facts: Facts, grain: str = "date", zone: str = "Asia/Shanghai") -> DataFrame:
    if grain not in ("date", "week"):
        raise ValueError(f"no grain {grain}")
    key = (local_date if grain == "date" else week_start)("created_ts", zone)
    return group_metrics(facts, key.cast("string"))


def breakdown(facts: Facts, dimension: str) -> DataFrame:
    return group_metrics(facts, F.col(dimension))


def _sets(df: DataFrame, dimensions: list[str], more: list[str], sums: list[Column]) -> DataFrame:
    """``sums`` by each of ``dimensions`` and the columns ``more``: one Expand and one aggregation.  The dimension and its value
    are in ``dimension`` and ``group_key``."""
    cols = {c: F.col(c) for c in (*dimensions, *more)}
    grouped = df.groupingSets([[cols[d], *(cols[m] for m in more)] for d in dimensions], *cols.values())
    out = grouped.agg(*sums, *(F.grouping(d).alias(f"without_{d}") for d in dimensions))
    pick = lambda use: F.coalesce(*(F.when(F.col(f"without_{d}") == 0, use(d)) for d in dimensions))
    kept = [c for c in out.columns if c not in dimensions and not c.startswith("without_") and c not in more]
    return out.select(pick(F.lit).alias("dimension"), pick(F.col).alias("group_key"), *more, *kept)


def breakdowns(facts: Facts, dimensions: list[str]) -> DataFrame:
    """The 36 metrics for each value of each of ``dimensions``, columns of orders: orders are read once for all of them, and
    intervals meet their orders once."""
    keys = ["dimension", "group_key"]
    named = facts.orders.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in dimensions})
    one = F.count(F.lit(1))
    durations = completed_hours(named).where("duration_hours is not null")
    found = of_counts(_sets(durations, dimensions, ["duration_hours"], [one.alias("c")]).withColumnRenamed("duration_hours", "v"), keys, {f"d_{n}": q for n, q in P50_P90.items()})
    agg = with_quantiles(_sets(named, dimensions, [], order_sums()), keys, found).withColumns({"total": F.col("n_valid"), "invalid": F.lit(0).cast("long")})
    ids = named.select("order_id", *dimensions)
    spans = facts.intervals.select("order_id", "interval_code", "hours").join(ids, "order_id")
    counted = _sets(spans.where("hours is not null"), dimensions, ["interval_code", "hours"], [one.alias("c")]).withColumnRenamed("hours", "v")
    tails = of_counts(counted, [*keys, "interval_code"], {"median": 0.5, "p90": 0.9})
    got = with_quantiles(_sets(spans, dimensions, ["interval_code"], interval_sums()), [*keys, "interval_code"], tails)
    nodes = _covered(_sets(facts.eligible.join(ids, "order_id"), dimensions, ["interval_code"], [one.alias("eligible")]), got, keys)
    out = order_metrics(agg, keys).unionByName(node_metrics(nodes, agg.select(*keys), keys))
    return out.withColumn("warnings", sample_warnings(F.col("denominator"), F.col("coverage")))


def histogram(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with the last one closed; a single value makes one bin; empty bins are emitted.

    bin, lower, upper, n.
    """
    if not 1 <= bins <= 50:
        raise ValueError("bins must be 1 to 50")
    v = F.col(value)
    span = values.where(v.isNotNull()).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo is not null")  # one row or none
    span = span.withColumn("width", (F.col("hi") - F.col("lo")) / bins).withColumn("last", F.when(F.col("hi") == F.col("lo"), 0).otherwise(bins - 1))
    at = F.when(F.col("width") == 0, F.lit(0)).otherwise(F.least(F.floor((v - F.col("lo")) / F.when(F.col("width") != 0, F.col("width"))), F.col("last"))).cast("int")
    counts = values.where(v.isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = span.select("lo", "hi", "width", F.explode(F.sequence(F.lit(0), "last")).alias("bin"))
    upper = F.when(F.col("bin") == F.col("last"), F.col("hi")).otherwise(F.col("lo") + F.col("width") * (F.col("bin") + 1))
    frame = frame.join(span.select("last"), how="cross").select("bin", (F.col("lo") + F.col("width") * F.col("bin")).alias("lower"), upper.alias("upper"))
    return frame.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def duration_values(facts: Facts, code: str = "fulfillment") -> DataFrame:
    if code == "fulfillment":
        return facts.orders.where(F.col("order_status").isin(*COMPLETED)).select("order_id", F.col("duration_hours").alias("hours"))
    if code not in INTERVALS:
        raise ValueError(f"no interval {code}")
    return facts.intervals.where(F.col("interval_code") == code).select("order_id", "hours")


def distribution(facts: Facts, code: str = "fulfillment") -> DataFrame:
    h, values = F.col("hours"), duration_values(facts, code)
    sums = values.agg(F.count(h).alias("n"), F.min(h).alias("least"), F.max(h).alias("most"), F.avg(h).alias("mean"))
    return with_quantiles(sums, [], quantiles(values, [], "hours", {"median": 0.5, "p90": 0.9}))


def bottleneck(facts: Facts) -> DataFrame:
    """Interval metrics with the one of the largest P90 marked; ties go to the declared order."""
    nodes = node_aggregates(facts.intervals, facts.eligible, [])
    place = F.array_position(F.array(*map(F.lit, INTERVALS)), F.col("interval_code"))
    first = F.row_number().over(Window.orderBy(F.col("p90").desc_nulls_last(), place))  # eight rows
    return nodes.withColumn("is_bottleneck", (first == 1) & F.col("p90").isNotNull())
