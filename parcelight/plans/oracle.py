"""DuckDB SQL for the registered queries: shared CTEs and one SELECT each."""

from __future__ import annotations

from ..operators.browser_mapping import VALUE_PATTERNS
from .fixtures import ctes

_CODES = "('order_to_pick', 'order_received', 'picking_started', 'w'), ('picking', 'picking_started', 'picking_completed', 'w'), ('pick_to_qc', 'picking_completed', 'quality_check_started', 'w'), ('quality_check', 'quality_check_started', 'quality_check_completed', 'w'), ('packing', 'packing_started', 'packing_completed', 'w'), ('ready_to_pickup', 'ready_to_ship', 'carrier_picked_up', 'x'), ('carrier_transit', 'carrier_picked_up', 'delivered', 's'), ('hub_dwell', 'arrived_at_hub', 'departed_hub', 'l')"

HEAD = ctes() + f""",
oq AS (SELECT order_id, count(*) AS n, min(source_index) AS first,
    count(DISTINCT (created_at, promised_delivery_time, actual_delivery_time, ordered_quantity, delivered_quantity, quantity_unit, order_status, raw_order_status, warehouse_id, carrier_id, destination_region, sales_channel)) AS d FROM fx_orders GROUP BY order_id),
ov AS (SELECT o.* FROM fx_orders o JOIN oq ON o.order_id = oq.order_id AND o.source_index = oq.first WHERE oq.d = 1),
od AS (SELECT order_id, source_index, order_status, created_at, promised_delivery_time AS promised, actual_delivery_time AS actual, ordered_quantity AS ordered, delivered_quantity AS delivered,
    coalesce(warehouse_id, 'unknown') AS warehouse_id, coalesce(carrier_id, 'unknown') AS carrier_id, coalesce(destination_region, 'unknown') AS destination_region, coalesce(sales_channel, 'unknown') AS sales_channel,
    order_status IN ('delivered', 'returned') AS done,
    CASE WHEN promised_delivery_time IS NULL OR actual_delivery_time IS NULL THEN NULL ELSE actual_delivery_time <= promised_delivery_time END AS o1,
    CASE WHEN ordered_quantity IS NULL OR delivered_quantity IS NULL OR trim(quantity_unit) = '' THEN NULL ELSE delivered_quantity >= ordered_quantity END AS o2,
    CASE WHEN order_status IN ('delivered', 'returned') AND actual_delivery_time >= created_at THEN epoch_us(actual_delivery_time - created_at) / 3.6e9 END AS hours FROM ov),
oe AS (SELECT *, CASE WHEN NOT done THEN CASE WHEN order_status = 'cancelled' THEN 'excluded' ELSE 'pending' END WHEN o1 IS NULL THEN 'not_computable' WHEN o1 THEN 'true' ELSE 'false' END AS ot,
    CASE WHEN NOT done THEN CASE WHEN order_status = 'cancelled' THEN 'excluded' ELSE 'pending' END WHEN o2 IS NULL THEN 'not_computable' WHEN o2 THEN 'true' ELSE 'false' END AS in_full,
    CASE WHEN NOT done THEN CASE WHEN order_status = 'cancelled' THEN 'excluded' ELSE 'pending' END WHEN o1 IS NULL OR o2 IS NULL THEN 'not_computable' WHEN o1 AND o2 THEN 'true' ELSE 'false' END AS otif FROM od),
wd AS (SELECT event_id, count(*) AS n, count(DISTINCT (order_id, event_time, event_code, warehouse_id)) AS d, min(source_index) AS first FROM fx_warehouse GROUP BY event_id),
w1 AS (SELECT e.* FROM fx_warehouse e JOIN wd ON e.event_id = wd.event_id AND e.source_index = wd.first WHERE wd.d = 1),
w2 AS (SELECT w1.*, CASE WHEN o.order_id IS NULL THEN 'ORPHAN_EVENT' WHEN w1.event_time < o.created_at THEN 'EVENT_BEFORE_ORDER_CREATED' END AS fault FROM w1 LEFT JOIN ov o ON o.order_id = w1.order_id),
pw AS (SELECT * FROM w2 WHERE fault IS NULL),
td AS (SELECT tracking_event_id, count(*) AS n, count(DISTINCT (order_id, shipment_id, event_time, event_code, carrier_id, location_code, sequence_number)) AS d, min(source_index) AS first FROM fx_tracking GROUP BY tracking_event_id),
t1 AS (SELECT e.* FROM fx_tracking e JOIN td ON e.tracking_event_id = td.tracking_event_id AND e.source_index = td.first WHERE td.d = 1),
t2 AS (SELECT t1.*, CASE WHEN o.order_id IS NULL THEN 'ORPHAN_EVENT' WHEN t1.event_time < o.created_at THEN 'EVENT_BEFORE_ORDER_CREATED' END AS fault FROM t1 LEFT JOIN ov o ON o.order_id = t1.order_id),
pt AS (SELECT * FROM t2 WHERE fault IS NULL),
defs(code, a, b, kind) AS (VALUES {_CODES}),
ev AS (SELECT order_id, NULL AS sh, NULL AS loc, event_time, event_code, 'w' AS src FROM pw UNION ALL SELECT order_id, shipment_id, location_code, event_time, event_code, 't' FROM pt),
ie AS (SELECT order_id, CASE WHEN kind IN ('s', 'l') THEN sh END AS sh, CASE WHEN kind = 'l' THEN loc END AS loc, code, event_time, event_code = a AS is_start FROM ev JOIN defs ON event_code = a OR event_code = b
    WHERE (kind = 'w' AND src = 'w') OR (kind IN ('s', 'l') AND src = 't') OR (kind = 'x' AND ((src = 'w' AND event_code = a) OR (src = 't' AND event_code = b)))),
ig AS (SELECT order_id, coalesce(sh, '') AS sh, coalesce(loc, '') AS loc, code, min(event_time) FILTER (WHERE is_start) AS s, min(event_time) FILTER (WHERE NOT is_start) AS e1, count(*) FILTER (WHERE is_start) AS ns, count(*) FILTER (WHERE NOT is_start) AS ne FROM ie GROUP BY ALL),
ip AS (SELECT g.order_id, g.sh, g.loc, g.code, g.s, g.e1, g.ns, g.ne, min(i.event_time) AS e FROM ig g LEFT JOIN ie i ON i.order_id = g.order_id AND coalesce(i.sh, '') = g.sh AND coalesce(i.loc, '') = g.loc AND i.code = g.code AND NOT i.is_start AND i.event_time >= g.s GROUP BY ALL),
iv AS (SELECT *, epoch_us(e - s) / 3.6e9 AS hours FROM ip WHERE e IS NOT NULL),
el AS (SELECT DISTINCT order_id, code FROM ip)
"""


def _rate(c: str) -> str:
    return f"round(CAST(count(*) FILTER (WHERE {c} = 'true') AS DOUBLE) / nullif(count(*) FILTER (WHERE {c} IN ('true', 'false')), 0), 6)"


KPI = f"""CAST(count(*) AS BIGINT) AS n, {_rate('ot')} AS ot_rate, {_rate('in_full')} AS if_rate, {_rate('otif')} AS otif_rate,
round(avg(hours), 8) AS mean_hours, round(quantile_cont(hours, 0.5), 6) AS median_hours, round(quantile_cont(hours, 0.9), 6) AS p90_hours"""

NODES = """CAST(count(hours) AS BIGINT) AS n, CAST(count(DISTINCT order_id) AS BIGINT) AS computable, round(avg(hours), 6) AS mean, round(quantile_cont(hours, 0.5), 6) AS median, round(quantile_cont(hours, 0.9), 6) AS p90"""

_WARN = """wn AS (SELECT 'EXACT_DUPLICATE_ORDER' AS code, order_id, NULL AS event_id, NULL AS iv FROM oq WHERE n > 1 AND d = 1 UNION SELECT 'DUPLICATE_ORDER_CONFLICT', order_id, NULL, NULL FROM oq WHERE d > 1
UNION SELECT 'EXACT_DUPLICATE_EVENT' AS code, NULL AS order_id, event_id, NULL AS iv FROM wd WHERE n > 1 AND d = 1 UNION SELECT 'DUPLICATE_EVENT_CONFLICT', NULL, event_id, NULL FROM wd WHERE d > 1
UNION SELECT 'EXACT_DUPLICATE_EVENT', NULL, tracking_event_id, NULL FROM td WHERE n > 1 AND d = 1 UNION SELECT 'DUPLICATE_EVENT_CONFLICT', NULL, tracking_event_id, NULL FROM td WHERE d > 1
UNION SELECT fault, order_id, event_id, NULL FROM w2 WHERE fault IS NOT NULL UNION SELECT fault, order_id, tracking_event_id, NULL FROM t2 WHERE fault IS NOT NULL
UNION SELECT 'SOURCE_EVENT_OUT_OF_ORDER', order_id, id, NULL FROM (SELECT order_id, event_id AS id, event_time, lag(event_time) OVER (PARTITION BY order_id ORDER BY source_index) AS p FROM pw) WHERE event_time < p
UNION SELECT 'SOURCE_EVENT_OUT_OF_ORDER', order_id, id, NULL FROM (SELECT order_id, tracking_event_id AS id, event_time, lag(event_time) OVER (PARTITION BY order_id, shipment_id ORDER BY source_index) AS p FROM pt) WHERE event_time < p
UNION SELECT 'POSSIBLE_DUPLICATE_SCAN', order_id, arg_min(event_id, source_index), NULL FROM pw GROUP BY order_id, event_code, event_time HAVING count(*) > 1
UNION SELECT 'POSSIBLE_DUPLICATE_SCAN', order_id, arg_min(tracking_event_id, source_index), NULL FROM pt GROUP BY order_id, event_code, event_time, shipment_id, location_code HAVING count(*) > 1
UNION SELECT 'NODE_BOUNDARY_MISSING', order_id, NULL, code FROM ip WHERE ns = 0 OR ne = 0 UNION SELECT 'NODE_END_BEFORE_START', order_id, NULL, code FROM ip WHERE e1 < s
UNION SELECT 'MULTIPLE_NODE_CYCLES', order_id, NULL, code FROM ip WHERE e IS NOT NULL AND (ns > 1 OR ne > 1))
"""

_EVENTS = "me AS (SELECT order_id, event_id AS id, event_time, event_code, source_index FROM pw UNION ALL SELECT order_id, tracking_event_id, event_time, event_code, source_index FROM pt)"

_PICK = "SELECT order_id, 'x' AS finding, hours, 12e0 AS lim FROM iv WHERE code = 'ready_to_pickup' AND hours > 12"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["kpi_overall"] = f"SELECT {KPI} FROM oe"
    for name, key in (("otif_by_warehouse", "warehouse_id"), ("otif_by_carrier", "carrier_id"), ("otif_by_region", "destination_region"), ("otif_by_channel", "sales_channel")):
        q[name] = f"SELECT {key} AS group_key, {KPI} FROM oe GROUP BY 1"
    q["trend_date"] = f"SELECT CAST(CAST(created_at + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS group_key, {KPI} FROM oe GROUP BY 1"
    q["trend_week"] = f"SELECT CAST(CAST(date_trunc('week', created_at + INTERVAL 8 HOUR) AS DATE) AS VARCHAR) AS group_key, {KPI} FROM oe GROUP BY 1"
    q["order_decisions"] = "SELECT order_id, ot, in_full, otif, round(hours, 6) AS duration_hours FROM oe"
    q["prepared_warehouse_events"] = "SELECT event_id, order_id, event_code, CAST(source_index AS BIGINT) AS source_index FROM pw"
    q["prepared_tracking_events"] = "SELECT tracking_event_id, order_id, event_code, CAST(source_index AS BIGINT) AS source_index FROM pt"
    q["warning_counts"] = f", {_WARN} SELECT code, CAST(count(*) AS BIGINT) AS n FROM wn GROUP BY code"
    q["warnings"] = f", {_WARN} SELECT code, order_id, event_id, iv AS interval_code FROM wn"
    q["intervals"] = "SELECT order_id, code AS interval_code, sh AS shipment, loc AS location, round(hours, 6) AS hours FROM iv"
    q["node_metrics"] = f"SELECT code AS interval_code, n, computable, mean, median, p90, CAST(k AS BIGINT) AS eligible, round(CAST(computable AS DOUBLE) / k, 6) AS coverage FROM (SELECT code, {NODES} FROM iv GROUP BY code) JOIN (SELECT code, count(*) AS k FROM el GROUP BY code) USING (code)"
    q["node_metrics_by_carrier"] = f"SELECT o.carrier_id AS group_key, iv.code AS interval_code, {NODES.replace('DISTINCT order_id', 'DISTINCT iv.order_id').replace('hours', 'iv.hours')} FROM iv JOIN oe o ON o.order_id = iv.order_id GROUP BY 1, 2"
    for c in ("picking", "hub_dwell", "carrier_transit"):
        q[f"interval_{c}"] = f"SELECT order_id, sh AS shipment, round(hours, 6) AS hours FROM iv WHERE code = '{c}'"
    q["status_rates"] = """SELECT round(CAST(count(*) FILTER (WHERE order_status = 'cancelled') AS DOUBLE) / count(*), 6) AS cancellation_rate, round(CAST(count(*) FILTER (WHERE order_status = 'returned') AS DOUBLE) / count(*), 6) AS return_rate,
round(CAST(count(*) FILTER (WHERE order_status <> 'unmapped') AS DOUBLE) / count(*), 6) AS mapped_rate, round(CAST(count(*) FILTER (WHERE done AND ot IN ('true', 'false') AND in_full IN ('true', 'false') AND hours IS NOT NULL) AS DOUBLE) / count(*) FILTER (WHERE done), 6) AS data_coverage_rate FROM oe"""
    anomalous = "(order_status = 'returned' OR (done AND delivered < ordered) OR order_id IN (SELECT order_id FROM pt WHERE event_code IN ('delivery_failed', 'exception', 'return_initiated', 'returned')))"
    q["anomaly_rate"] = f"SELECT round(CAST(count(*) FILTER (WHERE {anomalous}) AS DOUBLE) / count(*), 6) AS anomaly_order_rate, CAST(count(*) AS BIGINT) AS denominator FROM oe WHERE order_status <> 'cancelled'"
    q["distribution_fulfillment"] = "SELECT CAST(count(hours) AS BIGINT) AS n, round(min(hours), 6) AS least, round(max(hours), 6) AS most, round(avg(hours), 6) AS mean, round(quantile_cont(hours, 0.5), 6) AS median, round(quantile_cont(hours, 0.9), 6) AS p90 FROM oe"
    q["duration_histogram"] = """, r AS (SELECT min(hours) AS lo, max(hours) AS hi, (max(hours) - min(hours)) / 10 AS w FROM oe),
b AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS bin), c AS (SELECT CAST(least(floor((hours - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM oe, r WHERE hours IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + w * b.bin, 6) AS lower, round(CASE WHEN b.bin = 9 THEN hi ELSE lo + w * (b.bin + 1) END, 6) AS upper, CAST(coalesce(n, 0) AS BIGINT) AS n FROM b CROSS JOIN r LEFT JOIN c ON c.bin = b.bin"""
    q["filtered_kpi"] = f"SELECT {KPI} FROM oe WHERE carrier_id IN ('CAR-0', 'CAR-1') AND order_status = 'delivered' AND CAST(created_at + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'"
    kinds = {"returned_order": f"(order_status = 'returned' OR order_id IN (SELECT order_id FROM pt WHERE event_code = 'returned'))", "partial_delivery": "(done AND delivered < ordered)",
             "quality_check_failed": "order_id IN (SELECT order_id FROM pw WHERE event_code = 'quality_check_failed')",
             "tracking_exception": "order_id IN (SELECT order_id FROM pt WHERE event_code IN ('delivery_failed', 'exception', 'return_initiated', 'returned'))"}
    q["filter_options"] = " UNION ALL ".join([f"SELECT '{c}' AS filter, {c} AS option, CAST(count(*) AS BIGINT) AS n FROM oe GROUP BY 2" for c in ("warehouse_id", "carrier_id", "destination_region", "order_status")]
                                              + [f"SELECT 'anomaly_types', '{k}', CAST(count(*) AS BIGINT) FROM oe WHERE {c} HAVING count(*) > 0" for k, c in kinds.items()])
    q["order_page"] = "SELECT order_id, order_status, otif, round(hours, 6) AS duration_hours FROM oe ORDER BY hours IS NULL, hours DESC, CASE WHEN hours IS NOT NULL THEN order_id END DESC, order_id LIMIT 50 OFFSET 50"
    q["status_mapping_union"] = """SELECT 'orders' AS data_type, raw_order_status AS raw, order_status AS normalized FROM fx_orders UNION SELECT 'warehouse_events', raw_status, event_code FROM fx_warehouse
UNION SELECT 'tracking_events', raw_status, event_code FROM fx_tracking"""
    q["distribution_transit"] = q["distribution_fulfillment"].replace("FROM oe", "FROM iv WHERE code = 'carrier_transit'")
    q["fl_wh_001"] = """, b AS (SELECT o.warehouse_id, code, quantile_cont(iv.hours, 0.5) AS med, count(*) AS n FROM iv JOIN oe o USING (order_id) WHERE code IN ('order_to_pick', 'picking', 'pick_to_qc', 'quality_check', 'packing') GROUP BY 1, 2),
l(code, lim) AS (VALUES ('order_to_pick', 4e0), ('picking', 2e0), ('pick_to_qc', 2e0), ('quality_check', 1.5e0), ('packing', 2e0))
SELECT order_id, code AS finding, round(iv.hours, 6) AS observed, lim AS threshold, round(med, 6) AS baseline FROM iv JOIN oe o USING (order_id) JOIN b USING (warehouse_id, code) JOIN l USING (code) WHERE iv.hours > lim OR (n >= 10 AND iv.hours > 1.5e0 * med)"""
    q["fl_pu_001"] = "SELECT order_id, code AS finding, round(hours, 6) AS observed, 12e0 AS threshold FROM iv WHERE code = 'ready_to_pickup' AND hours > 12"
    q["fl_lh_001"] = """, t AS (SELECT iv.* FROM iv JOIN oe o USING (order_id) WHERE code = 'carrier_transit' AND o.order_status <> 'cancelled'), p AS (SELECT quantile_cont(hours, 0.9) AS tail, count(*) AS n FROM t)
SELECT order_id, code AS finding, round(hours, 6) AS observed, 72e0 AS threshold, round(tail, 6) AS baseline FROM t, p WHERE hours > 72 OR (n >= 30 AND hours > tail)"""
    q["fl_lm_001"] = """, a AS (SELECT order_id, shipment_id, min(event_time) FILTER (WHERE event_code = 'arrived_at_destination_city') AS arr, min(event_time) FILTER (WHERE event_code = 'out_for_delivery') AS ofd FROM pt GROUP BY 1, 2),
d AS (SELECT a.order_id, epoch_us(min(e.event_time) - any_value(arr)) / 3.6e9 AS h, 'destination_dwell' AS finding, 24e0 AS lim FROM a JOIN pt e ON e.order_id = a.order_id AND e.shipment_id = a.shipment_id AND e.event_code IN ('out_for_delivery', 'delivered') AND e.event_time >= arr GROUP BY a.order_id, a.shipment_id
UNION ALL SELECT a.order_id, epoch_us(min(e.event_time) - any_value(ofd)) / 3.6e9, 'delivery_attempt', 12e0 FROM a JOIN pt e ON e.order_id = a.order_id AND e.shipment_id = a.shipment_id AND e.event_code = 'delivered' AND e.event_time >= ofd GROUP BY a.order_id, a.shipment_id)
SELECT order_id, finding, round(h, 6) AS observed, lim AS threshold FROM d WHERE h > lim"""
    q["fl_cr_001"] = """, c AS (SELECT * FROM oe WHERE done AND carrier_id <> 'unknown'), s AS (SELECT DISTINCT carrier_id AS k FROM c),
m AS (SELECT k, count(*) FILTER (WHERE carrier_id = k) AS n, count(*) FILTER (WHERE carrier_id = k AND otif = 'true') / CAST(nullif(count(*) FILTER (WHERE carrier_id = k AND otif IN ('true', 'false')), 0) AS DOUBLE) AS rate,
count(*) FILTER (WHERE carrier_id <> k AND otif = 'true') / CAST(nullif(count(*) FILTER (WHERE carrier_id <> k AND otif IN ('true', 'false')), 0) AS DOUBLE) AS peer, count(*) FILTER (WHERE carrier_id = k AND otif IN ('true', 'false')) AS kn, count(*) FILTER (WHERE carrier_id <> k AND otif IN ('true', 'false')) AS pn,
quantile_cont(CASE WHEN carrier_id = k THEN hours END, 0.9) AS p, quantile_cont(CASE WHEN carrier_id <> k THEN hours END, 0.9) AS pp, count(CASE WHEN carrier_id = k THEN hours END) AS dn, count(CASE WHEN carrier_id <> k THEN hours END) AS dpn FROM s CROSS JOIN c GROUP BY k),
h AS (SELECT *, coalesce(kn >= 30 AND pn >= 30 AND kn >= 0.8e0 * n AND peer - rate >= 0.1e0 - 1e-12, false) AS h1, coalesce(dn >= 30 AND dpn >= 30 AND p >= 1.25e0 * pp, false) AS h2 FROM m)
SELECT k AS finding, CASE WHEN h1 AND h2 THEN 'high' ELSE 'medium' END AS severity, CAST(n AS BIGINT) AS affected, round(CASE WHEN h1 THEN rate ELSE p END, 6) AS observed, round(CASE WHEN h1 THEN peer ELSE pp END, 6) AS baseline FROM h WHERE h1 OR h2"""
    q["fl_wc_001"] = """, x AS (SELECT order_id, sum(hours) AS inside FROM iv WHERE code IN ('order_to_pick', 'picking', 'pick_to_qc', 'quality_check', 'packing') GROUP BY 1),
d AS (SELECT warehouse_id, CAST(created_at AS DATE) AS day, count(*) AS n, quantile_cont(inside, 0.9) AS p FROM oe LEFT JOIN x USING (order_id) WHERE warehouse_id <> 'unknown' GROUP BY 1, 2),
y AS (SELECT a.warehouse_id, a.day, any_value(a.n) AS n, any_value(a.p) AS p, count(*) AS days, count(b.p) AS pdays, quantile_cont(b.n, 0.5) AS bn, quantile_cont(b.p, 0.5) AS bp FROM d a JOIN d b ON a.warehouse_id = b.warehouse_id AND b.day < a.day GROUP BY 1, 2)
SELECT warehouse_id || ' ' || CAST(day AS VARCHAR) AS finding, CAST(n AS BIGINT) AS affected, round(p, 6) AS observed, round(bp, 6) AS baseline FROM y WHERE n >= 3 AND days >= 3 AND pdays >= 3 AND n >= 1.25e0 * bn AND p >= 1.2e0 * bp"""
    q["transitions"] = """, s AS (SELECT event_code AS a, lead(event_code) OVER w AS b, epoch_us(lead(event_time) OVER w - event_time) / 3.6e9 AS gap FROM pt WINDOW w AS (PARTITION BY order_id, shipment_id ORDER BY event_time, sequence_number, source_index, tracking_event_id))
SELECT a, b, CAST(count(*) AS BIGINT) AS n, round(avg(gap), 6) AS mean_gap FROM s WHERE b IS NOT NULL GROUP BY a, b"""
    q["process_variants"] = f""", {_EVENTS}, s AS (SELECT order_id, string_agg(event_code, '|' ORDER BY event_time, source_index, id) AS path FROM me GROUP BY order_id)
SELECT 'V-' || upper(substr(sha256(path), 1, 8)) AS variant, path, CAST(count(*) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY path ORDER BY n DESC, path LIMIT 20"""
    q["order_timeline"] = f", {_EVENTS} SELECT id, event_code, CAST(event_time AS VARCHAR) AS at FROM me WHERE order_id = 'ORD-1'"
    q["sim_promise"] = "SELECT " + _rate("otif") + " AS base_otif, " + _rate("CASE WHEN NOT done THEN 'x' WHEN o1 IS NULL OR o2 IS NULL THEN 'x' WHEN actual <= promised + INTERVAL 12 HOUR AND o2 THEN 'true' ELSE 'false' END") + " AS scenario_otif FROM oe"
    q["browser_pairs"] = """, s AS (SELECT shipment_id, lag(event_code) OVER w AS a, event_code AS b, epoch_us(event_time - lag(event_time) OVER w) / 3.6e9 AS h FROM fx_tracking WINDOW w AS (PARTITION BY shipment_id ORDER BY event_time, source_index))
SELECT a || '_to_' || b AS code, CAST(count(h) AS BIGINT) AS n, CAST(count(DISTINCT shipment_id) AS BIGINT) AS entities, round(avg(h), 6) AS mean, round(quantile_cont(h, 0.5), 6) AS median, round(quantile_cont(h, 0.9), 6) AS p90 FROM s WHERE a IS NOT NULL GROUP BY a, b"""
    q["validated_orders"] = """, t AS (SELECT source_index AS k, order_status FROM fx_orders WHERE ordered_quantity IS NOT NULL AND source_index < 1000000000)
SELECT 'ERROR' AS severity, 'INVALID_TIME' AS code, CAST(count(*) AS BIGINT) AS n FROM t WHERE k % 17 = 0 HAVING count(*) > 0 UNION ALL SELECT 'ERROR', 'NEGATIVE_OR_INVALID_QUANTITY', CAST(count(*) AS BIGINT) FROM t WHERE k % 19 = 0 HAVING count(*) > 0
UNION ALL SELECT 'WARNING', 'UNKNOWN_STATUS', CAST(count(*) AS BIGINT) FROM t WHERE k % 23 = 0 OR order_status = 'unmapped' HAVING count(*) > 0"""
    q["orphan_events"] = "SELECT DISTINCT event_id, order_id FROM w2 WHERE fault = 'ORPHAN_EVENT' UNION SELECT tracking_event_id, order_id FROM t2 WHERE fault = 'ORPHAN_EVENT'"
    q |= _edge()
    from . import import_sql, scale_sql
    from .more_sql import more

    return {k: HEAD + v for k, v in q.items()} | plain() | more() | import_sql.sql() | scale_sql.sql()


def _edge() -> dict[str, str]:
    """The edge dialect's decisions, then its four results."""
    up = lambda x, d: f"floor(({x}) * {10**d} + 0.5) / {float(10**d)}"
    head = f""", eo AS (SELECT *, actual <= promised AS a, delivered >= ordered AS b, {up("epoch_us(actual - created_at) / 3.6e9", 2)} AS h FROM od),
er AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a AND b END AS c, coalesce(NOT a, false) AS late, coalesce(h >= 82, false) AS tail, coalesce(h >= 82 AND carrier_id = 'CAR-2', false) AS watched,
    coalesce(NOT a, false) OR coalesce(NOT b, false) OR order_status = 'returned' OR coalesce(h >= 82, false) AS bad FROM eo)
"""

    def metrics(key: str) -> str:
        by, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
        rate = lambda code, c: f"SELECT {by}'{code}' AS code, {up(f'CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) / nullif(count({c}), 0)', 4)} AS value, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS numerator, CAST(count({c}) AS BIGINT) AS denominator, {up(f'CAST(count({c}) AS DOUBLE) / count(*)', 4)} AS coverage, CAST(count(*) - count({c}) AS BIGINT) AS pending FROM er{group}"
        hours = lambda code, e: f"SELECT {by}'fulfillment_duration_{code}_hours', {up(e, 2)}, NULL, NULL, {up('CAST(count(h) AS DOUBLE) / count(*)', 4)}, CAST(count(*) - count(h) AS BIGINT) FROM er{group}"
        return " UNION ALL ".join([rate("ot_rate", "a"), rate("if_rate", "b"), rate("otif_rate", "c"), rate("anomaly_order_rate", "bad"), hours("mean", "avg(h)"), hours("median", "quantile_cont(h, 0.5)"), hours("p90", "quantile_cont(h, 0.9)")])

    rule = lambda rid, cat, sev, pri, c: f"SELECT '{rid}' AS rule_id, '{cat}' AS category, '{sev}' AS severity, {pri} AS priority, CAST(count(*) AS BIGINT) AS affected, min(order_id) AS first_order, {up('count(*) / CAST((SELECT count(*) FROM er) AS DOUBLE)', 4)} AS coverage FROM er WHERE {c} HAVING count(*) > 0"
    return {
        "edge_metrics": head + metrics(""), "edge_by_carrier": head + metrics("carrier_id"),
        "edge_findings": head + " UNION ALL ".join([rule("FL-WH-001", "warehouse_delay", "high", 10, "tail"), rule("FL-CR-001", "carrier_relative", "high", 8, "watched"), rule("FL-OT-001", "last_mile_backlog", "medium", 6, "late")]),
        "edge_nodes": f"""SELECT code AS interval_code, CAST(count(hours) AS BIGINT) AS n, round(avg(hours), 6) AS mean, round(quantile_cont(hours, 0.5), 6) AS median, round(quantile_cont(hours, 0.9), 6) AS p90, CAST((SELECT count(*) FROM od) AS BIGINT) AS eligible,
{up("count(hours) / CAST((SELECT count(*) FROM od) AS DOUBLE)", 4)} AS coverage, quantile_cont(hours, 0.9) >= 18 AS is_bottleneck FROM iv GROUP BY code""",
        "edge_filter_coverage": f"SELECT CAST(count(*) FILTER (WHERE f) AS BIGINT) AS order_count, CAST(count(*) AS BIGINT) AS unfiltered_order_count, {up('count(*) FILTER (WHERE f) / CAST(count(*) AS DOUBLE)', 4)} AS data_coverage FROM (SELECT carrier_id = 'CAR-2' AND warehouse_id IN ('WH-1', 'WH-2', 'WH-3') AS f FROM od)",
    }


def _profile(column: str) -> str:
    shares = ", ".join(f"""round(avg(CASE WHEN regexp_matches(v, '{p}') THEN 1e0 ELSE 0e0 END), 6) AS "{k}\"""" for k, p in VALUE_PATTERNS.items())
    return f"""SELECT '{column}' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS "distinct", {shares}, round(count(DISTINCT v) / CAST(count(*) AS DOUBLE), 6) AS "unique" FROM (SELECT trim(CAST({column} AS VARCHAR)) AS v FROM orders) WHERE v <> ''"""


def plain() -> dict[str, str]:
    """Queries over the driver's own tables."""
    d, m, both = "day(o_orderdate)", "month(o_orderdate)", "day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)"
    first = "(o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') OR (o_orderpriority = '3-MEDIUM' AND o_orderkey % 2 = 0))"
    count = lambda c, n: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {n}"
    return {
        "date_orders": f"""SELECT *, CASE WHEN dmy > 0 AND mdy = 0 THEN 'DMY' WHEN mdy > 0 AND dmy = 0 THEN 'MDY' END AS date_order, (dmy > 0 AND mdy > 0) OR (dmy = 0 AND mdy = 0 AND undecided > 0) AS ambiguous FROM (
SELECT o_orderpriority AS file, {count(f"{first} AND o_orderpriority NOT LIKE '4%' AND {d} > 12", "dmy")}, {count(f"NOT {first} AND ({d} > 12 OR (o_orderpriority LIKE '5%' AND {d} <> {m}))", "mdy")},
    {count(f"{both} AND o_orderpriority NOT LIKE '5%'", "undecided")} FROM orders GROUP BY o_orderpriority)""",
        "parsed_dates": f"SELECT o_orderkey, CASE WHEN e THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, CASE WHEN e THEN 'DATE_ORDER_REQUIRED' END AS error FROM (SELECT *, o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') AND {both} AS e FROM orders)",
        "column_profiles": " UNION ALL ".join(_profile(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")),
        "event_gaps": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(gap), 6) AS mean_gap_hours FROM (SELECT event_type, epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9 AS gap FROM events) WHERE gap IS NOT NULL GROUP BY event_type",
        "privacy_scan": "SELECT CAST(count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])')) AS BIGINT) AS mobile, CAST(count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])')) AS BIGINT) AS id_card, CAST(count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])[0-9]{11}($|[^0-9])')) AS BIGINT) AS eleven_digits FROM documents",
        "csv_escape": "SELECT o_orderkey, CASE WHEN regexp_matches(ltrim(v), '^[=+@-]') THEN '''' || v ELSE v END AS cell, '***' || right(CAST(o_orderkey AS VARCHAR), CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN 1 ELSE 4 END) AS masked FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 5 = 0 THEN '=' || o_orderpriority ELSE o_orderpriority END AS v FROM orders)",
        "first_interval_events": "SELECT user_id, round(epoch_us(min(e.ts) - s.ts) / 3.6e9, 6) AS hours FROM (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY user_id) s JOIN events e USING (user_id) WHERE e.event_type = 'purchase' AND e.ts >= s.ts GROUP BY user_id, s.ts",
    }
