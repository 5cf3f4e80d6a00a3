"""DuckDB SQL of the long metric tables, of evidence and of what is taken from them."""

from __future__ import annotations

import re

from ..contract import INTERVALS, RULES, TRANSITIONS, WAREHOUSE_INTERVALS
from .oracle import _WARN, HEAD

QC = "SELECT order_id FROM pw WHERE event_code = 'quality_check_failed'"
BAD_SCAN = "SELECT order_id FROM pt WHERE event_code IN ('delivery_failed', 'exception', 'return_initiated', 'returned')"
ANOMALOUS = f"(order_status = 'returned' OR (done AND delivered < ordered) OR order_id IN ({BAD_SCAN}) OR order_id IN ({QC}))"
DAY = "CAST(CAST(created_at + INTERVAL 8 HOUR AS DATE) AS VARCHAR)"
WEEK = "CAST(CAST(date_trunc('week', created_at + INTERVAL 8 HOUR) AS DATE) AS VARCHAR)"
COLUMNS = ("value", "numerator", "denominator", "coverage", "eligible", "computable", "pending", "not_computable")


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"{_d(a)} / nullif({b}, 0)"


def metrics(scope: str, suffix: str = "", total: str = "n_valid", invalid: str = "0", oe: str = "oe", iv: str = "iv", el: str = "el") -> str:
    """CTEs up to ``m{suffix}`` (g, code, the numbers, warnings) for the groups of ``scope`` (order_id, g)."""
    states = ("true", "false", "not_computable", "pending")
    rates = {"ot_rate": "ot", "if_rate": "in_full", "otif_rate": "otif"}
    sums = ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{v}" for c in rates.values() for v in states)
    known = "ot IN ('true', 'false') AND in_full IN ('true', 'false')"
    groups = f"""gk{suffix} AS ({scope}),
gx{suffix} AS (SELECT o.*, k.g, {ANOMALOUS} AS bad FROM {oe} o JOIN gk{suffix} k USING (order_id)),
ga{suffix} AS (SELECT *, {total} AS total, {invalid} AS invalid FROM (SELECT g, count(*) AS n_valid, count(*) FILTER (WHERE done) AS n_completed,
    count(*) FILTER (WHERE order_status IN ('created', 'confirmed', 'processing', 'shipped', 'unmapped')) AS n_pending_status, {sums},
    avg(hours) AS d_mean, sum(hours) AS d_sum, quantile_cont(hours, 0.5) AS d_p50, quantile_cont(hours, 0.9) AS d_p90, count(hours) AS d_n,
    count(*) FILTER (WHERE order_status = 'cancelled') AS n_cancelled, count(*) FILTER (WHERE order_status = 'returned') AS n_returned,
    count(*) FILTER (WHERE order_status <> 'unmapped') AS n_mapped, count(*) FILTER (WHERE order_status <> 'cancelled') AS n_live,
    count(*) FILTER (WHERE order_status <> 'cancelled' AND bad) AS n_anomaly,
    count(*) FILTER (WHERE done AND {known} AND hours IS NOT NULL) AS n_covered FROM gx{suffix} GROUP BY g))"""
    rows: list[tuple[str, ...]] = [
        ("order_count", "total", "total", "total", "1e0", "total", "total", "0", "0"),
        ("valid_order_count", "n_valid", "n_valid", "total", _ratio("n_valid", "total"), "total", "n_valid", "0", "invalid"),
    ]
    for code, c in rates.items():
        n = f"({c}_true + {c}_false)"
        all_ = f"({n} + {c}_not_computable)"
        rows.append((code, _ratio(f"{c}_true", n), f"{c}_true", n, _ratio(n, all_), all_, n, f"{c}_pending", f"{c}_not_computable"))
    seen, missing = _ratio("d_n", "n_completed"), "n_completed - d_n"
    head = "fulfillment_duration_"
    rows.append((f"{head}mean_hours", "d_mean", "d_sum", "d_n", seen, "n_completed", "d_n", "n_pending_status", missing))
    rows += [(f"{head}{n}_hours", c, "NULL", "d_n", seen, "n_completed", "d_n", "0", missing) for n, c in (("median", "d_p50"), ("p90", "d_p90"))]
    for code, n in (("cancellation_rate", "n_cancelled"), ("return_rate", "n_returned")):
        rows.append((code, _ratio(n, "n_valid"), n, "n_valid", _ratio("n_mapped", "n_valid"), "n_valid", "n_mapped", "0", "n_valid - n_mapped"))
    one = lambda n: f"CASE WHEN {n} > 0 THEN 1e0 END"
    rows.append(("anomaly_order_rate", _ratio("n_anomaly", "n_live"), "n_anomaly", "n_live", one("n_live"), "n_live", "n_live", "0", "0"))
    rows.append(("data_coverage_rate", _ratio("n_covered", "n_completed"), "n_covered", "n_completed", one("n_completed"), "n_completed", "n_covered", "0", "n_completed - n_covered"))
    one_row = lambda code, *cells: f"SELECT g, {code} AS code, " + ", ".join(f"{_d(x)} AS {c}" for x, c in zip(cells, COLUMNS, strict=True))
    selects = [one_row(f"'{r[0]}'", *r[1:]) + f" FROM ga{suffix}" for r in rows]
    codes = ", ".join(f"('{c}')" for c in INTERVALS)
    nodes = f"""gn{suffix} AS (SELECT g, code, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(k, 0) AS k, total, mean, p50, p90
    FROM (SELECT g, code FROM (SELECT DISTINCT g FROM gk{suffix}) CROSS JOIN (VALUES {codes}) AS v(code))
    LEFT JOIN (SELECT g, code, count(*) AS k FROM {el} JOIN gk{suffix} USING (order_id) GROUP BY ALL) USING (g, code)
    LEFT JOIN (SELECT g, code, count(i.hours) AS n, count(DISTINCT i.order_id) AS c, sum(i.hours) AS total, avg(i.hours) AS mean,
        quantile_cont(i.hours, 0.5) AS p50, quantile_cont(i.hours, 0.9) AS p90 FROM {iv} i JOIN gk{suffix} USING (order_id) GROUP BY ALL) USING (g, code))"""
    for s, c, num in (("mean", "mean", "total"), ("median", "p50", "NULL"), ("p90", "p90", "NULL")):
        selects.append(one_row(f"'node_duration_' || code || '_{s}_hours'", c, num, "n", _ratio("c", "k"), "k", "c", "0", "greatest(k - c, 0)") + f" FROM gn{suffix}")
    warn = "concat_ws(',', CASE WHEN denominator = 0 THEN 'NO_SAMPLE' WHEN denominator < 30 THEN 'SMALL_SAMPLE' END, CASE WHEN coverage < 0.8 THEN 'LOW_COVERAGE' END)"
    return f"{groups},\n{nodes},\nm{suffix} AS (SELECT *, {warn} AS warnings FROM ({' UNION ALL '.join(selects)}))"


ALL = "SELECT order_id, 'all' AS g FROM oe"
TOTAL = {"total": "(SELECT count(*) FROM oq)", "invalid": "(SELECT count(*) FROM oq WHERE d > 1)"}
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS)


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def evidence(daily: int = 3, share: float = 0.1) -> str:
    """CTEs up to ``ee``: the rows of all eight rules."""
    from ..operators.diagnostics import QUALITY_CODES

    rule = lambda r: f"'{r}' AS rule_id, '{RULES[r].category}' AS category, {RULES[r].priority} AS priority"
    inner = ", ".join(f"'{c}'" for c in WAREHOUSE_INTERVALS)
    limits = ", ".join(f"('{c}', {float(RULES['FL-WH-001'][f'{c}_threshold_hours'])}e0)" for c in WAREHOUSE_INTERVALS)
    allowed = ", ".join(f"('{a}', '{b}')" for a, bs in TRANSITIONS.items() for b in bs)
    return f"""{_WARN},
wb AS (SELECT o.warehouse_id, code, quantile_cont(iv.hours, 0.5) AS med, count(*) AS n FROM iv JOIN oe o USING (order_id) WHERE code IN ({inner}) GROUP BY ALL),
wl(code, lim) AS (VALUES {limits}),
wx AS (SELECT order_id, code, iv.hours, lim FROM iv JOIN oe o USING (order_id) JOIN wb USING (warehouse_id, code) JOIN wl USING (code)
    WHERE iv.hours > lim OR (n >= 10 AND iv.hours > 1.5e0 * med)),
ct AS (SELECT iv.* FROM iv JOIN oe o USING (order_id) WHERE code = 'carrier_transit' AND o.order_status <> 'cancelled'),
cp AS (SELECT quantile_cont(hours, 0.9) AS tail, count(*) AS n FROM ct),
la AS (SELECT order_id, shipment_id, min(event_time) FILTER (WHERE event_code = 'arrived_at_destination_city') AS arr,
    min(event_time) FILTER (WHERE event_code = 'out_for_delivery') AS ofd FROM pt GROUP BY ALL),
ld AS (SELECT la.order_id, epoch_us(min(e.event_time) - any_value(arr)) / 3.6e9 AS h, 'destination_dwell' AS f, 24e0 AS lim FROM la
    JOIN pt e ON e.order_id = la.order_id AND e.shipment_id = la.shipment_id AND e.event_code IN ('out_for_delivery', 'delivered') AND e.event_time >= arr
    GROUP BY la.order_id, la.shipment_id
    UNION ALL SELECT la.order_id, epoch_us(min(e.event_time) - any_value(ofd)) / 3.6e9, 'delivery_attempt', 12e0 FROM la
    JOIN pt e ON e.order_id = la.order_id AND e.shipment_id = la.shipment_id AND e.event_code = 'delivered' AND e.event_time >= ofd GROUP BY la.order_id, la.shipment_id),
cc AS (SELECT * FROM oe WHERE done AND carrier_id <> 'unknown'), cs AS (SELECT DISTINCT carrier_id AS k FROM cc),
cm AS (SELECT k, count(*) FILTER (WHERE carrier_id = k) AS n, count(*) FILTER (WHERE carrier_id = k AND otif IN ('true', 'false')) AS kn,
    count(*) FILTER (WHERE carrier_id <> k AND otif IN ('true', 'false')) AS pn,
    {_ratio("count(*) FILTER (WHERE carrier_id = k AND otif = 'true')", "count(*) FILTER (WHERE carrier_id = k AND otif IN ('true', 'false'))")} AS rate,
    {_ratio("count(*) FILTER (WHERE carrier_id <> k AND otif = 'true')", "count(*) FILTER (WHERE carrier_id <> k AND otif IN ('true', 'false'))")} AS peer,
    quantile_cont(CASE WHEN carrier_id = k THEN hours END, 0.9) AS p, quantile_cont(CASE WHEN carrier_id <> k THEN hours END, 0.9) AS pp,
    count(CASE WHEN carrier_id = k THEN hours END) AS dn, count(CASE WHEN carrier_id <> k THEN hours END) AS dpn FROM cs CROSS JOIN cc GROUP BY k),
ch AS (SELECT *, coalesce(kn >= 30 AND pn >= 30 AND kn >= 0.8e0 * n AND peer - rate >= 0.1e0 - 1e-12, false) AS h1,
    coalesce(dn >= 30 AND dpn >= 30 AND p >= 1.25e0 * pp, false) AS h2 FROM cm),
ci AS (SELECT order_id, sum(hours) AS inside FROM iv WHERE code IN ({inner}) GROUP BY 1),
cd AS (SELECT warehouse_id, CAST(created_at AS DATE) AS day, count(*) AS n, quantile_cont(inside, 0.9) AS p FROM oe LEFT JOIN ci USING (order_id)
    WHERE warehouse_id <> 'unknown' GROUP BY 1, 2),
cy AS (SELECT a.warehouse_id, a.day, any_value(a.n) AS n, any_value(a.p) AS p, count(*) AS days, count(b.p) AS pdays, quantile_cont(b.n, 0.5) AS bn,
    quantile_cont(b.p, 0.5) AS bp FROM cd a JOIN cd b ON a.warehouse_id = b.warehouse_id AND b.day < a.day GROUP BY 1, 2),
tr AS (SELECT order_id, event_code AS a, lead(event_code) OVER w AS b, epoch_us(lead(event_time) OVER w - event_time) / 3.6e9 AS gap FROM pt
    WINDOW w AS (PARTITION BY order_id, shipment_id ORDER BY event_time, sequence_number, source_index, tracking_event_id)),
ta(a, b) AS (VALUES {allowed}),
e7 AS (SELECT {rule("FL-WH-001")}, code AS finding, CASE WHEN max(hours / lim) OVER (PARTITION BY code) > 2 THEN 'high' ELSE 'medium' END AS severity,
    order_id, 'node' AS dimension, code AS dimension_value, hours AS observed, lim AS threshold FROM wx
  UNION ALL SELECT {rule("FL-PU-001")}, code, CASE WHEN max(hours) OVER () > 36 THEN 'critical' ELSE 'high' END, order_id, 'node', code, hours, 12e0
    FROM iv WHERE code = 'ready_to_pickup' AND hours > 12
  UNION ALL SELECT {rule("FL-LH-001")}, code, 'high', order_id, 'node', code, hours, 72e0 FROM ct, cp WHERE hours > 72 OR (n >= 30 AND hours > tail)
  UNION ALL SELECT {rule("FL-LM-001")}, f, 'high', order_id, 'node', f, h, lim FROM ld WHERE h > lim
  UNION ALL SELECT {rule("FL-CR-001")}, k, CASE WHEN h1 AND h2 THEN 'high' ELSE 'medium' END, order_id, 'carrier', k, CASE WHEN h1 THEN rate ELSE p END,
    CASE WHEN h1 THEN 0.1e0 ELSE 1.25e0 * pp END FROM ch JOIN cc ON carrier_id = k WHERE h1 OR h2
  UNION ALL SELECT {rule("FL-WC-001")}, cy.warehouse_id || ' ' || CAST(cy.day AS VARCHAR), 'medium', order_id, 'warehouse', cy.warehouse_id, cy.p, 1.2e0 * bp
    FROM cy JOIN oe o ON o.warehouse_id = cy.warehouse_id AND CAST(o.created_at AS DATE) = cy.day
    WHERE cy.n >= {daily} AND days >= 3 AND pdays >= 3 AND cy.n >= 1.25e0 * bn AND cy.p >= 1.2e0 * bp
  UNION ALL SELECT {rule("FL-DQ-001")}, f, s, order_id, NULL, NULL, o, t FROM (
    SELECT code AS f, {_case("code", QUALITY_CODES)} AS s, order_id, NULL AS o, NULL AS t FROM wn WHERE code IN ({", ".join(f"'{c}'" for c in QUALITY_CODES)})
    UNION ALL SELECT 'STATE_JUMP', 'medium', order_id, NULL, NULL FROM tr WHERE b IS NOT NULL AND NOT (a = 'unmapped' OR b = 'unmapped' OR a = 'exception')
        AND NOT EXISTS (SELECT 1 FROM ta WHERE ta.a = tr.a AND ta.b = tr.b)
    UNION ALL SELECT 'LONG_INTERVAL', 'high', order_id, gap, 720e0 FROM tr WHERE gap > 720
    UNION ALL SELECT 'UNMAPPED_EVENT', 'medium', order_id, NULL, NULL FROM pw WHERE event_code = 'unmapped'
    UNION ALL SELECT 'UNMAPPED_EVENT', 'medium', order_id, NULL, NULL FROM pt WHERE event_code = 'unmapped'
    UNION ALL SELECT 'TERMINAL_EVENT_MISSING', 'medium', order_id, NULL, NULL FROM oe WHERE done
        AND order_id NOT IN (SELECT order_id FROM pt WHERE event_code IN ('delivered', 'returned')))),
hx AS (SELECT o.order_id, CAST(o.created_at AS DATE) AS day, unnest([('weekday', strftime(o.created_at, '%a')), ('six_hours',
    printf('%02d:00–%02d:00', CAST(hour(o.created_at) // 6 * 6 AS INTEGER), CAST(hour(o.created_at) // 6 * 6 + 6 AS INTEGER)))]) AS x
    FROM oe o WHERE o.order_id IN (SELECT order_id FROM e7)),
hl AS (SELECT order_id, day, x[1] AS kind, x[2] AS label FROM hx),
ht AS (SELECT count(*) AS total, count(DISTINCT day) AS days FROM hl WHERE kind = 'weekday'),
hb AS (SELECT kind, label, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS r FROM (SELECT kind, label, count(*) AS n FROM hl GROUP BY kind, label)), ht
    WHERE r = 1 AND total >= 10 AND days >= 3 AND n / CAST(total AS DOUBLE) >= {share}e0),
ee AS (SELECT * FROM e7 UNION ALL SELECT {rule("FL-TC-001")}, kind || ':' || label, 'medium', order_id, 'time', label, n / CAST(total AS DOUBLE), {share}e0
    FROM hl JOIN hb USING (kind, label), ht),
er AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rnk FROM ee),
fi AS (SELECT *, row_number() OVER (ORDER BY rnk DESC, priority DESC, affected DESC, rule_id, finding) AS place FROM (
    SELECT rule_id, category, priority, finding, severity, any_value(rnk) AS rnk, dimension, dimension_value, count(DISTINCT order_id) AS affected, count(*) AS evidence_rows
    FROM er GROUP BY rule_id, category, priority, finding, severity, dimension, dimension_value))
"""


def renamed(section: str, names: dict[str, str]) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[1]], section)


def section(first: str, last: str) -> str:
    """The CTEs of the head from ``first`` to ``last``."""
    starts = {m[1]: m.start() for m in re.finditer(r"(?m)^(\w+)(?:\([^)]*\))? AS \(", HEAD)}
    names = list(starts)
    after = names.index(last) + 1
    return HEAD[starts[first] : starts[names[after]] if after < len(names) else len(HEAD)].rstrip().rstrip(",")
