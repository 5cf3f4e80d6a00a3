"""DuckDB SQL for the queries of :mod:`.more_queries` and for roll-ups of evidence, metrics and scenarios."""

from __future__ import annotations

from ..contract import RULES, WAREHOUSE_INTERVALS
from .metric_sql import ALL, ANOMALOUS, DAY, ROUNDED, TOTAL, WEEK, evidence, metrics, renamed, section
from .oracle import _WARN, HEAD

FILTERED = "carrier_id IN ('CAR-0', 'CAR-1') AND CAST(created_at + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'"
SEVEN = "('ot_rate', 'if_rate', 'otif_rate', 'fulfillment_duration_mean_hours', 'fulfillment_duration_median_hours', 'fulfillment_duration_p90_hours', 'anomaly_order_rate')"
RATES = "('ot_rate', 'if_rate', 'otif_rate')"
LABELS = "(order_status, warehouse_id, carrier_id)"
LONG = f"code, {ROUNDED}, warnings"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def more() -> dict[str, str]:
    q: dict[str, str] = {}
    m = lambda scope, **kw: f", {metrics(scope, **kw)}\n"
    by = lambda key: m(f"SELECT order_id, {key} AS g FROM oe")
    q["all_metrics"] = m(ALL, **TOTAL) + f"SELECT {LONG} FROM m"
    for name, key in (("date", DAY), ("week", WEEK), ("carrier", "carrier_id"), ("warehouse", "warehouse_id")):
        q[f"metrics_by_{name}"] = by(key) + f"SELECT g AS group_key, {LONG} FROM m"
    q["metrics_filtered"] = m(f"SELECT order_id, 'all' AS g FROM oe WHERE {FILTERED}") + f"SELECT {LONG} FROM m"
    q["date_range"] = f"SELECT min({DAY}) AS first_day, max({DAY}) AS last_day FROM oe"
    q["breakdown_sorted"] = by("carrier_id") + "SELECT g AS group_key, round(value, 6) AS value FROM m WHERE code = 'otif_rate' ORDER BY m.value IS NULL, m.value DESC, g DESC LIMIT 3"
    q["node_bottleneck"] = "SELECT code AS interval_code, round(p90, 6) AS p90 FROM (SELECT code, quantile_cont(hours, 0.9) AS p90 FROM iv GROUP BY code) ORDER BY iv_p90 DESC LIMIT 1".replace("iv_p90", "p90")
    returned = "order_status = 'returned' OR order_id IN (SELECT order_id FROM pt WHERE event_code = 'returned')"
    scans = "order_id IN (SELECT order_id FROM pt WHERE event_code IN ('delivery_failed', 'exception', 'return_initiated', 'returned'))"
    kinds = f"concat_ws(',', CASE WHEN {returned} THEN 'returned_order' END, CASE WHEN done AND delivered < ordered THEN 'partial_delivery' END, CASE WHEN {scans} THEN 'tracking_exception' END)"
    q["order_detail"] = f"SELECT order_id, order_status, ot, in_full, otif, round(hours, 6) AS duration_hours, {kinds} AS kinds FROM oe WHERE order_id = 'ORD-7'"
    stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    units = "SELECT order_id AS oid, quantity_unit FROM ov"
    q["order_csv"] = f"""SELECT order_id, order_status, {stamp("created_at")} AS created_ts, {stamp("promised")} AS promised_ts, {stamp("actual")} AS actual_ts, CAST(ordered AS VARCHAR) AS ordered,
    CAST(delivered AS VARCHAR) AS delivered, quantity_unit, warehouse_id, carrier_id, destination_region, sales_channel, ot, in_full, otif, round(hours, 6) AS duration_hours FROM oe JOIN ({units}) ON oid = order_id"""
    codes = "(SELECT order_id, string_agg(DISTINCT event_code, ', ' ORDER BY event_code) AS codes FROM pt WHERE event_code IN ('delivery_failed', 'exception', 'return_initiated', 'returned') GROUP BY 1)"
    reasons = "concat_ws('; ', CASE WHEN order_status = 'returned' THEN 'order_returned' END, CASE WHEN done AND delivered < ordered THEN 'partial_delivery' END, 'tracking: ' || codes)"
    q["anomaly_csv"] = f"SELECT order_id, order_status, {reasons} AS reasons, warehouse_id, carrier_id, otif, round(hours, 6) AS duration_hours FROM oe LEFT JOIN {codes} USING (order_id) WHERE {ANOMALOUS}"
    q |= _evidence_queries() | _scenarios()
    q["linkage"] = f"""SELECT {big("count(*) FILTER (WHERE o.order_id IS NOT NULL AND e.order_id IS NOT NULL)")} AS linked, {big("count(*) FILTER (WHERE o.order_id IS NULL)")} AS orphan, {big("count(*) FILTER (WHERE e.order_id IS NULL)")} AS unlinked,
    false AS error FROM (SELECT DISTINCT order_id FROM fx_orders) o FULL JOIN (SELECT DISTINCT order_id FROM fx_warehouse) e ON o.order_id = e.order_id"""
    q["entities"] = """, o AS (SELECT DISTINCT order_id AS e FROM fx_orders WHERE source_index % 3 <> 0),
    v AS (SELECT DISTINCT CASE WHEN source_index % 5 <> 0 THEN order_id ELSE shipment_id END AS e FROM fx_tracking WHERE source_index % 7 <> 0)
    SELECT coalesce(o.e, v.e) AS entity, o.e IS NOT NULL AS has_order, v.e IS NOT NULL AS has_events FROM o FULL JOIN v ON o.e = v.e"""
    q["tracking_spans"] = """, s AS (SELECT shipment_id, epoch_us(event_time - lag(event_time) OVER (PARTITION BY shipment_id ORDER BY event_time, source_index)) / 3.6e9 AS h FROM fx_tracking)
    SELECT shipment_id AS entity, round(sum(h), 6) AS span_hours FROM s WHERE h IS NOT NULL GROUP BY 1"""
    rate = lambda c: f"round(CAST(count(*) FILTER (WHERE {c} = 'true') AS DOUBLE) / nullif(count(*) FILTER (WHERE {c} IN ('true', 'false')), 0), 6)"
    q["browser_rates"] = f"SELECT {rate('ot')} AS ot_rate, {rate('in_full')} AS if_rate, {rate('otif')} AS otif_rate, {big('count(*)')} AS n, count(*) < 5 AS small_sample FROM oe WHERE order_status NOT IN ('cancelled', 'returned')"
    signal = "event_code IN ('delivery_failed', 'exception', 'return_initiated', 'returned')"
    share = "count(DISTINCT order_id) / CAST((SELECT count(*) FROM oe) AS DOUBLE)"
    q["browser_findings"] = f"""SELECT 'TRACKING-EXCEPTION-SIGNAL' AS rule_id, CASE WHEN {share} >= 0.15 THEN 'high' ELSE 'medium' END AS severity, {big("count(DISTINCT order_id)")} AS affected, round({share}, 6) AS share FROM pt WHERE {signal} HAVING count(*) > 0
    UNION ALL SELECT 'DQ-STATUS-UNMAPPED', 'medium', {big("count(DISTINCT order_id)")}, round(1 - count(*) / CAST((SELECT count(*) FROM pt) AS DOUBLE), 6) FROM pt WHERE event_code = 'unmapped' HAVING count(*) > 0"""
    q["capabilities"] = "SELECT unnest(['lead_time', 'percentiles', 'status', 'carrier', 'location', 'anomaly', 'ot', 'if', 'otif']) AS capability, true AS available, CAST(NULL AS VARCHAR) AS reason"
    q["carrier_shares"] = f"SELECT carrier_id, {big('count(*)')} AS n, round(count(*) / CAST((SELECT count(*) FROM oe WHERE carrier_id <> 'unknown') AS DOUBLE), 6) AS share FROM oe WHERE carrier_id <> 'unknown' GROUP BY 1"
    q["baseline_snapshot"] = m(ALL, **TOTAL) + f"SELECT code, round(value, 6) AS value, round(coverage, 6) AS coverage, warnings FROM m WHERE code IN {SEVEN}"
    q["metric_detail"] = f", {metrics(ALL, **TOTAL)}, {metrics('SELECT order_id, carrier_id AS g FROM oe', suffix='c')} SELECT g AS group_key, code, round(value, 6) AS value, round(coverage, 6) AS coverage FROM (FROM m UNION ALL FROM mc)"
    mask = lambda c: f"CASE WHEN {c} IS NOT NULL THEN '***' || right({c}, CASE WHEN length({c}) < 4 THEN 1 ELSE 4 END) END"
    q["data_quality_errors"] = f", {_WARN} SELECT code, {mask('order_id')} AS order_id, {mask('event_id')} AS event_id, interval_code FROM (SELECT code, order_id, event_id, iv AS interval_code FROM wn ORDER BY code, order_id NULLS LAST, event_id NULLS LAST, iv NULLS LAST LIMIT 100)"
    q["masked_events"] = f"SELECT {mask('tracking_event_id')} AS tracking_event_id, {mask('order_id')} AS order_id, {mask('shipment_id')} AS shipment_id, event_code, {big('source_index')} AS source_index FROM pt"
    local = "(created_at + INTERVAL 8 HOUR)"
    hours = f"printf('%02d:00–%02d:00', CAST(hour({local}) // 6 * 6 AS INTEGER), CAST(hour({local}) // 6 * 6 + 6 AS INTEGER))"
    q["time_labels"] = f"SELECT order_id, strftime({local}, '%a') AS weekday, {hours} AS hours, {DAY} AS day, {WEEK} AS week FROM oe"
    scoped = m(f"SELECT order_id, 'all' AS g FROM oe WHERE {FILTERED}") + ", " + metrics(f"SELECT order_id, {DAY} AS g FROM oe WHERE {FILTERED}", suffix="d") + ", " + metrics(f"SELECT order_id, carrier_id AS g FROM oe WHERE {FILTERED}", suffix="c")
    hist = f"""r AS (SELECT min(hours) AS lo, max(hours) AS hi, (max(hours) - min(hours)) / 10 AS w FROM oe WHERE {FILTERED}),
    bins AS (SELECT unnest(range(0, 10)) AS bin), hc AS (SELECT CAST(least(floor((hours - lo) / w), 9) AS BIGINT) AS bin, count(*) AS n FROM oe, r WHERE hours IS NOT NULL AND {FILTERED} GROUP BY 1)"""
    nodes = f"np AS (SELECT code, quantile_cont(iv.hours, 0.9) AS p90 FROM iv JOIN oe USING (order_id) WHERE {FILTERED} GROUP BY code)"
    q["overview"] = scoped + f""", {_WARN}, {hist}, {nodes}
    SELECT section, label, measure, round(CAST(value AS DOUBLE), 6) AS value FROM (
    SELECT 'context' AS section, '' AS label, 'order_count' AS measure, (SELECT count(*) FROM oe WHERE {FILTERED}) AS value
    UNION ALL SELECT 'context', '', 'unfiltered_order_count', (SELECT count(*) FROM oq)
    UNION ALL SELECT 'context', '', 'warning_count', (SELECT count(*) FROM wn WHERE order_id IS NULL OR order_id IN (SELECT order_id FROM oe WHERE {FILTERED}))
    UNION ALL SELECT 'context', '', code, value FROM m WHERE code IN ('valid_order_count', 'data_coverage_rate')
    UNION ALL SELECT 'metrics', '', code, value FROM m
    UNION ALL SELECT 'trend', g, code, value FROM md WHERE code IN {RATES}
    UNION ALL SELECT 'distribution', CAST(bins.bin AS VARCHAR), 'n', coalesce(n, 0) FROM bins LEFT JOIN hc ON hc.bin = bins.bin
    UNION ALL SELECT 'nodes', code, CASE WHEN p90 = (SELECT max(p90) FROM np) THEN 'bottleneck_p90' ELSE 'p90' END, p90 FROM np
    UNION ALL SELECT 'breakdown', g, code, value FROM mc WHERE code IN {RATES})"""
    q["browser_recommendations"] = _browser(m(ALL, **TOTAL))
    return {k: HEAD + v for k, v in q.items()} | _edge_scenario()


def _browser(head: str) -> str:
    up = lambda x: f"CAST(floor({x} + 0.5) AS INTEGER)"
    v = lambda c, code: f"max({c}) FILTER (WHERE code = '{code}')"
    rate = lambda x, target, base, by, capped: f"SELECT 'metric:{x}' AS fact_id, " + (f"CASE WHEN {x}_c < 0.8 THEN least(64, s) ELSE s END" if capped else "s") + f" AS score FROM (SELECT *, least(94, {up(f'{base} + ({target}e0 - {x}_v) * 180 + {x}_c * {by}')}) AS s FROM w) WHERE {x}_v < {target}"
    wide = ", ".join(f"{v('value', f'{x}_rate')} AS {x}_v, coalesce({v('coverage', f'{x}_rate')}, 0e0) AS {x}_c" for x in ("ot", "if", "otif"))
    return head + f""", w AS (SELECT {wide}, {v("value", "anomaly_order_rate")} AS an, {v("value", "data_coverage_rate")} AS dc, {v("value", "fulfillment_duration_median_hours")} AS p50,
    {v("value", "fulfillment_duration_p90_hours")} AS p90, count(*) FILTER (WHERE value IS NULL) AS missing FROM m),
    f AS ({rate("ot", 0.95, 45, 15, True)} UNION ALL {rate("if", 0.98, 45, 15, True)} UNION ALL {rate("otif", 0.95, 50, 12, False)}
    UNION ALL SELECT 'metric:fulfillment_long_tail', least(90, {up("58 + least(p90 - p50, 72e0) / 4")}) FROM w WHERE p90 - p50 > greatest(8e0, 0.35e0 * p50)
    UNION ALL SELECT 'metric:anomaly', least(92, {up("50 + an * 180")}) FROM w WHERE an >= 0.05
    UNION ALL SELECT 'data:coverage', CASE WHEN coalesce(dc < 0.6, true) THEN 82 ELSE 62 END FROM w WHERE coalesce(dc < 0.8, true) OR missing > 0)
    SELECT fact_id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'watch' END AS priority FROM f"""


def _edge_scenario() -> dict[str, str]:
    """The edge dialect's own SQL over orders whose durations were edited first."""
    from .oracle import _edge

    up = lambda x: f"floor(({x}) * 100 + 0.5) / 100.0e0"
    first = lambda code: f"(SELECT order_id, min({{'s': s, 'e': e, 'hours': hours}}).hours AS n FROM iv WHERE code = '{code}' GROUP BY 1)"
    base = _edge()["edge_metrics"]
    start = base.index("er AS (")
    edits = f""", es AS (SELECT od.*, {up("epoch_us(actual - created_at) / 3.6e9")} AS h0, pk.n AS pk, pa.n AS pa FROM od LEFT JOIN {first("picking")} pk USING (order_id) LEFT JOIN {first("packing")} pa USING (order_id)),
    e1 AS (SELECT *, CASE WHEN pk * 0.5e0 > 0 AND warehouse_id IN ('WH-1', 'WH-2') THEN {up("greatest(h0 - pk * 50 / 100, 0e0)")} ELSE h0 END AS h1 FROM es),
    e2 AS (SELECT *, CASE WHEN least(pa, 0.5e0) > 0 THEN {up("greatest(h1 - least(pa, 0.5e0), 0e0)")} ELSE h1 END AS h2 FROM e1),
    e3 AS (SELECT *, CASE WHEN carrier_id = 'CAR-1' THEN {up("h2 - least(h2, 2e0)")} ELSE h2 END AS h3 FROM e2),
    e4 AS (SELECT * REPLACE (coalesce(created_at + to_microseconds(CAST(round(h3 * 3.6e9) AS BIGINT)), actual) AS actual, promised + INTERVAL 12 HOUR AS promised) FROM e3),
    eo AS (SELECT *, actual <= promised AS a, delivered >= ordered AS b, {up("epoch_us(actual - created_at) / 3.6e9")} AS h FROM e4),
"""
    return {"edge_scenario": HEAD + edits + base[start:]}


def _evidence_queries() -> dict[str, str]:
    ee = f", {evidence()}"
    counts = lambda *keys: f"SELECT {', '.join(keys)}, {big('count(*)')} AS n FROM ee WHERE rule_id = 'FL-DQ-001' GROUP BY ALL"
    q = {"fl_dq_001": counts("finding", "severity")}
    q["fl_tc_001"] = f"SELECT finding, {big('count(DISTINCT order_id)')} AS affected FROM ee WHERE rule_id = 'FL-TC-001' GROUP BY 1"
    q["findings"] = f"SELECT rule_id, finding, severity, {big('affected')} AS affected, CAST(place AS INTEGER) AS place FROM fi"
    q["pareto"] = f"""SELECT category, {big("affected")} AS affected, {big("sum(affected) OVER w")} AS cumulative, sum(affected) OVER w / CAST((sum(affected) OVER ()) AS DOUBLE) AS cumulative_share
    FROM (SELECT category, count(DISTINCT order_id) AS affected FROM ee WHERE order_id IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY affected DESC, category ROWS UNBOUNDED PRECEDING)"""
    q["severity_summary"] = f"""SELECT v.severity, CAST(r AS INTEGER) AS severity_rank, {big("count(DISTINCT (rule_id, finding)) FILTER (WHERE rule_id IS NOT NULL)")} AS findings, {big("count(DISTINCT order_id)")} AS affected
    FROM (VALUES ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) AS v(severity, r) LEFT JOIN ee ON ee.severity = v.severity GROUP BY ALL"""
    wh = ", ".join(f"('{c}', {float(RULES['FL-WH-001'][f'{c}_threshold_hours'])}e0)" for c in WAREHOUSE_INTERVALS)
    q["bottlenecks"] = f""", li(code, threshold) AS (VALUES {wh}, ('ready_to_pickup', 12e0), ('carrier_transit', 72e0)), da AS (SELECT code, CAST(row_number() OVER () - 1 AS INTEGER) AS declared FROM defs),
    nd AS (SELECT code, count(hours) AS n, avg(hours) AS mean, quantile_cont(hours, 0.9) AS p90, count(DISTINCT order_id) AS c FROM iv GROUP BY code), ne AS (SELECT code, count(*) AS k FROM el GROUP BY code),
    na AS (SELECT dimension_value AS code, count(DISTINCT order_id) AS affected FROM ee WHERE dimension = 'node' GROUP BY 1)
    SELECT code AS interval_code, declared, mean, p90, threshold, {big("coalesce(n, 0)")} AS n, {big("coalesce(affected, 0)")} AS affected, coalesce(c, 0) / CAST(k AS DOUBLE) AS coverage,
    coalesce(affected, 0) > 0 OR coalesce(p90 > threshold, false) AS is_bottleneck FROM da LEFT JOIN nd USING (code) LEFT JOIN ne USING (code) LEFT JOIN na USING (code) LEFT JOIN li USING (code)"""
    top = "arg_max(severity, rnk) AS severity, string_agg(DISTINCT category, ',' ORDER BY category) AS categories"
    q["dimension_insights"] = f"""SELECT dimension_type, dimension_key, {big("count(DISTINCT (rule_id, finding))")} AS findings, {big("count(DISTINCT er.order_id)")} AS affected, {top} FROM er JOIN (
    SELECT order_id, 'warehouse_id' AS dimension_type, warehouse_id AS dimension_key FROM oe UNION ALL SELECT order_id, 'carrier_id', carrier_id FROM oe UNION ALL SELECT order_id, 'destination_region', destination_region FROM oe) d
    ON d.order_id = er.order_id GROUP BY 1, 2"""
    q["affected_orders"] = f"SELECT order_id, {top}, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, {big('count(DISTINCT (rule_id, finding))')} AS findings FROM er WHERE order_id IS NOT NULL GROUP BY 1"
    q["diagnostic_context"] = f"""SELECT {big("(SELECT count(*) FROM oe)")} AS orders, {big("count(DISTINCT order_id)")} AS affected, {big("count(DISTINCT (rule_id, finding))")} AS findings, {big("count(DISTINCT rule_id)")} AS rules,
    round(count(DISTINCT order_id) / CAST((SELECT count(*) FROM oe) AS DOUBLE), 6) AS affected_share FROM ee"""
    q["finding_samples"] = f"""SELECT rule_id, finding, {big("count(*)")} AS evidence_rows, {big("count(DISTINCT order_id)")} AS affected,
    array_to_string(list_sort(list_distinct(list(order_id) FILTER (WHERE order_id IS NOT NULL)))[1:20], ',') AS sample FROM ee GROUP BY 1, 2"""
    q["finding_samples"] = q["finding_samples"].replace("array_to_string(", "coalesce(array_to_string(").replace(", ',') AS sample", ", ','), '') AS sample")
    q["order_findings"] = """SELECT category, arg_max(rule_id, rnk * 1000 + priority) AS rule_id, arg_max(severity, rnk * 1000 + priority) AS severity, string_agg(DISTINCT finding, ',' ORDER BY finding) AS findings
    FROM er WHERE order_id = 'ORD-7' OR order_id IS NULL GROUP BY 1"""
    out = {k: ee + v for k, v in q.items()}
    facts = f"""{metrics(ALL, **TOTAL)}, nn AS (SELECT count(*) AS orders FROM oe),
    fw AS (SELECT max(value) FILTER (WHERE code = 'fulfillment_duration_median_hours') AS p50, max(value) FILTER (WHERE code = 'fulfillment_duration_p90_hours') AS p90,
        max(coverage) FILTER (WHERE code = 'fulfillment_duration_p90_hours') AS cov, max(value) FILTER (WHERE code = 'data_coverage_rate') AS data, count(*) FILTER (WHERE code IN {RATES} AND value IS NULL) AS missing FROM m),
    ft(code, target) AS (VALUES ('otif_rate', 0.95e0), ('ot_rate', 0.95e0), ('if_rate', 0.98e0)),
    cv AS (SELECT {_coverage()}),
    rf AS (SELECT 'metric:' || code AS fact_id, code AS topic, CASE WHEN coalesce(coverage, 0) < 0.8 THEN least(s, 64) ELSE s END AS score
        FROM (SELECT code, coverage, least(100, round_even(45 + 180 * (target - value) + 15 * coalesce(coverage, 0e0), 0)) AS s FROM m JOIN ft USING (code) WHERE target - value > 0.01)
    UNION ALL SELECT 'duration:long_tail', 'long_tail', least(90, round_even(55 + least(p90 - p50, 72e0) / 4 + 10 * coalesce(cov, 0e0), 0)) FROM fw WHERE p90 - p50 > greatest(8e0, 0.35 * p50)
    UNION ALL SELECT 'data:coverage', 'data_coverage', CASE WHEN coalesce(data < 0.8, true) THEN 82 ELSE 62 END FROM fw WHERE coalesce(data < 0.8, true) OR missing > 0
    UNION ALL SELECT 'diagnostic:' || rule_id || ':' || coalesce(dimension_value, 'all'), category, CASE WHEN cov < 0.6 THEN least(s, 64) ELSE s END
        FROM (SELECT *, least(100, round_even(0.65 * CASE severity WHEN 'critical' THEN 95 WHEN 'high' THEN 82 WHEN 'medium' THEN 62 ELSE 42 END + 25 * affected / CAST(greatest(orders, 1) AS DOUBLE) + 10 * cov, 0)) AS s
            FROM (SELECT fi.*, orders, {_finding_coverage()} AS cov FROM fi, nn, cv WHERE place <= 5))),
    rk AS (SELECT fact_id, topic, CAST(score AS INTEGER) AS score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS priority FROM rf)"""
    out["recommendations"] = f"{ee}, {facts} SELECT * FROM rk"
    out["brief"] = f"{ee}, {facts} SELECT CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, score DESC, fact_id) AS INTEGER) AS place, * FROM rk QUALIFY place <= 3"
    sizes = {
        "summary": "1", "metrics": "36", "trend": f"3 * (SELECT count(DISTINCT {WEEK}) FROM oe)", "distribution": "10", "nodes": "(SELECT count(DISTINCT code) FROM el)", "breakdown": "3 * (SELECT count(DISTINCT carrier_id) FROM oe)",
        "diagnostics": "(SELECT count(*) FROM fi)", "bottlenecks": "8", "recommendations": "(SELECT count(*) FROM rk)", "data_quality": "least(100, (SELECT count(*) FROM wn))",
        "order_samples": f"least(20, (SELECT count(*) FROM oe WHERE {ANOMALOUS}))",
    }
    out["report_sections"] = f"{ee}, {facts} " + " UNION ALL ".join(f"SELECT '{k}' AS section, {big(v)} AS rows" for k, v in sizes.items())
    return out


def _coverage() -> str:
    """One row: what the rules give as coverage, by node."""
    node = lambda c: f"(SELECT count(DISTINCT order_id) FROM iv WHERE code = '{c}') / CAST((SELECT count(*) FROM el WHERE code = '{c}') AS DOUBLE) AS {c}"
    wh = ", ".join(f"(SELECT count(DISTINCT order_id) FROM iv WHERE code = '{c}') / CAST((SELECT count(*) FROM oe) AS DOUBLE) AS {c}" for c in WAREHOUSE_INTERVALS)
    last = lambda start, ends, name: f"""(SELECT count(DISTINCT CASE WHEN e IS NOT NULL THEN order_id END) / CAST(count(DISTINCT order_id) AS DOUBLE) FROM (SELECT la.order_id, la.shipment_id, min(p.event_time) AS e FROM la LEFT JOIN pt p
        ON p.order_id = la.order_id AND p.shipment_id = la.shipment_id AND p.event_code IN ({ends}) AND p.event_time >= {start} WHERE {start} IS NOT NULL GROUP BY 1, 2)) AS {name}"""  # noqa: E731
    return ", ".join([wh, node("ready_to_pickup"), node("carrier_transit"), last("arr", "'out_for_delivery', 'delivered'", "destination_dwell"), last("ofd", "'delivered'", "delivery_attempt")])


def _finding_coverage() -> str:
    nodes = (*WAREHOUSE_INTERVALS, "ready_to_pickup", "carrier_transit", "destination_dwell", "delivery_attempt")
    by_node = " ".join(f"WHEN dimension = 'node' AND finding = '{c}' THEN cv.{c}" for c in nodes)
    return f"coalesce(CASE {by_node} WHEN rule_id = 'FL-TC-001' THEN 1e0 WHEN rule_id = 'FL-CR-001' THEN (SELECT kn / CAST(n AS DOUBLE) FROM cm WHERE k = finding) END, 0e0)"


def _scenarios() -> dict[str, str]:
    q = {}
    decide = lambda source, suffix: renamed(section("od", "oe"), {"od": f"od{suffix}", "oe": f"oe{suffix}", "ov": source})
    first = lambda code: f"(SELECT order_id, min({{'s': s, 'e': e, 'hours': hours}}) AS x FROM iv WHERE code = '{code}' GROUP BY 1)"
    back = lambda t: f"CASE WHEN {t} >= cutoff THEN {t} - to_microseconds(CAST(round(red * 3.6e9) AS BIGINT)) ELSE {t} END"
    names = {n: f"{n}p" for n in ("ev", "ie", "ig", "ip", "iv", "el")} | {"pt": "ptp"}
    both = f"{metrics(ALL, **TOTAL)}, {metrics(ALL.replace('FROM oe', 'FROM oep'), suffix='p', oe='oep', iv='ivp', el='elp', **TOTAL)}"
    compare = "b.code, round(b.value, 6) AS baseline, round(s.value, 6) AS scenario, round(s.value - b.value, 6) AS difference, round((s.value - b.value) / nullif(abs(b.value), 0), 6) AS relative"
    q["sim_pickup"] = f""", aj AS (SELECT order_id, x.e AS cutoff, least(x.hours, 1e0) AS red FROM {first("ready_to_pickup")} WHERE least(x.hours, 1e0) > 0),
    ovp AS (SELECT o.* REPLACE ({back("actual_delivery_time")} AS actual_delivery_time) FROM (SELECT ov.*, cutoff, red FROM ov LEFT JOIN aj USING (order_id)) o),
    ptp AS (SELECT p.* REPLACE ({back("event_time")} AS event_time) FROM (SELECT pt.*, cutoff, red FROM pt LEFT JOIN aj USING (order_id)) p),
    {decide("ovp", "p")}, {renamed(section("ev", "el"), names)}, {both}
    SELECT {compare} FROM m b JOIN mp s ON b.code = s.code WHERE b.code IN {SEVEN}"""
    saved = lambda code, red: f"SELECT '{code}' AS interval_code, {big('count(*)')} AS n, round(sum({red}), 4) AS hours_saved FROM {first(code)} WHERE {red} > 0"
    q["sim_warehouse"] = saved("picking", "x.hours * 50 / 100") + " UNION ALL " + saved("packing", "least(x.hours, 0.5e0)")
    shift = lambda h: f"ov{h} AS (SELECT * REPLACE (promised_delivery_time + INTERVAL {h} HOUR AS promised_delivery_time) FROM ov), {decide(f'ov{h}', str(h))}"
    scoped = lambda h: metrics(ALL.replace("FROM oe", f"FROM oe{h}"), suffix=str(h), oe=f"oe{h}", **TOTAL)
    q["simulation_comparison"] = f", {shift(12)}, {metrics(ALL, **TOTAL)}, {scoped(12)} SELECT {compare} FROM m b JOIN m12 s ON b.code = s.code WHERE b.code IN {SEVEN}"
    one = lambda h: f"SELECT {float(h)}e0 AS parameter, {compare.rsplit(', round', 1)[0]} FROM m b JOIN m{h} s ON b.code = s.code WHERE b.code IN ('ot_rate', 'otif_rate')"
    q["sensitivity_promise"] = f", {metrics(ALL, **TOTAL)}, " + ", ".join(f"{shift(h)}, {scoped(h)}" for h in (6, 12, 24)) + " " + " UNION ALL ".join(map(one, (6, 12, 24)))
    q["pickup_by_carrier"] = f"SELECT order_id, round(x.hours, 6) AS before_hours, round(x.hours * 25 / 100, 6) AS reduction FROM {first('ready_to_pickup')} JOIN oe USING (order_id) WHERE carrier_id IN ('CAR-1', 'CAR-3') AND x.hours > 0"
    q["sim_carrier_mix"] = f""", kn AS (SELECT count(*) AS n FROM oe WHERE carrier_id <> 'unknown'), al AS (SELECT c, row_number() OVER (ORDER BY c) AS r, CAST(floor(n * 0.25e0) AS BIGINT) AS f, n - 4 * CAST(floor(n * 0.25e0) AS BIGINT) AS rest
    FROM kn, (VALUES ('CAR-1'), ('CAR-2'), ('CAR-3'), ('CAR-4')) AS v(c)) SELECT c AS carrier_id, {big("f + CASE WHEN r <= rest THEN 1 ELSE 0 END")} AS n FROM al
    UNION ALL SELECT 'unknown', {big("count(*)")} FROM oe WHERE carrier_id = 'unknown' HAVING count(*) > 0"""
    from .more_queries import FINGERPRINTED

    def mark(table: str, name: str, columns: tuple[str, ...]) -> str:
        cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns)
        parts = " || '|' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS BIGINT)), 0) AS VARCHAR)" for k in range(4))
        return f"SELECT '{name}' AS name, sha256(CAST(count(*) AS VARCHAR) || '|' || {parts}) AS fingerprint FROM (SELECT sha256(concat_ws(chr(31), {cells})) AS h FROM {table})"

    q["fingerprints"] = " UNION ALL ".join(mark(f"fx_{n}", n, c) for n, c in zip(("orders", "warehouse", "tracking"), FINGERPRINTED, strict=True))
    return q
