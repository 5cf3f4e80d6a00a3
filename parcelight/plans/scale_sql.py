"""DuckDB SQL of :mod:`.scale_queries`."""

from __future__ import annotations

from ..operators.metrics import CODES
from .metric_sql import ALL, ROUNDED, TOTAL, WEEK, evidence, metrics
from .oracle import HEAD
from .scale_queries import CLOCKS, CLOSE, DIMENSIONS


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


def breakdown_all() -> str:
    parts = [f"{metrics(f'SELECT order_id, {d} AS g FROM oe', suffix=str(i))}" for i, d in enumerate(DIMENSIONS)]
    rows = " UNION ALL ".join(f"SELECT '{d}' AS dimension, g AS group_key, code, {ROUNDED}, warnings FROM m{i}" for i, d in enumerate(DIMENSIONS))
    return f", {', '.join(parts)}\n{rows}"


def peer_quantiles() -> str:
    one = "SELECT '{d}' AS dimension, k AS group_key, round(quantile_cont(hours, 0.9), 6) AS peer_p90 FROM (SELECT DISTINCT {d} AS k FROM oe WHERE done AND {d} <> 'unknown' AND hours IS NOT NULL) JOIN oe ON {d} <> k AND {d} <> 'unknown' WHERE done AND hours IS NOT NULL GROUP BY k"
    return " UNION ALL ".join(one.format(d=d) for d in DIMENSIONS)


def close_lanes() -> str:
    gap, times = CLOSE["otif_gap"], CLOSE["p90_ratio"]
    known = "otif IN ('true', 'false')"
    return f""", c AS (SELECT * EXCLUDE (carrier_id), carrier_id || '@' || warehouse_id AS carrier_id FROM oe WHERE done AND carrier_id <> 'unknown'), s AS (SELECT DISTINCT carrier_id AS k FROM c),
m AS (SELECT k, count(*) FILTER (WHERE carrier_id = k) AS n, count(*) FILTER (WHERE carrier_id = k AND {known}) AS kn, count(*) FILTER (WHERE carrier_id <> k AND {known}) AS pn,
    {_ratio("count(*) FILTER (WHERE carrier_id = k AND otif = 'true')", f"count(*) FILTER (WHERE carrier_id = k AND {known})")} AS rate,
    {_ratio("count(*) FILTER (WHERE carrier_id <> k AND otif = 'true')", f"count(*) FILTER (WHERE carrier_id <> k AND {known})")} AS peer,
    quantile_cont(CASE WHEN carrier_id = k THEN hours END, 0.9) AS p, quantile_cont(CASE WHEN carrier_id <> k THEN hours END, 0.9) AS pp,
    count(CASE WHEN carrier_id = k THEN hours END) AS dn, count(CASE WHEN carrier_id <> k THEN hours END) AS dpn FROM s CROSS JOIN c GROUP BY k),
h AS (SELECT *, coalesce(kn >= 30 AND pn >= 30 AND kn >= 0.8e0 * n AND peer - rate >= {gap}e0 - 1e-12, false) AS h1, coalesce(dn >= 30 AND dpn >= 30 AND p >= {times}e0 * pp, false) AS h2 FROM m)
SELECT k AS finding, CASE WHEN h1 AND h2 THEN 'high' ELSE 'medium' END AS severity, CAST(n AS BIGINT) AS affected, round(CASE WHEN h1 THEN rate ELSE p END, 6) AS observed,
    round(CASE WHEN h1 THEN {gap}e0 ELSE {times}e0 * pp END, 6) AS threshold, round(CASE WHEN h1 THEN peer ELSE pp END, 6) AS baseline, round({_ratio("kn", "n")}, 6) AS coverage FROM h WHERE h1 OR h2"""


#: What :data:`.scale_queries.ODD_TEXTS` are in the two normal forms, the Arabic ligature apart.
FOLDED = ("fine", "Straße", "한글", "VIII°C", "", "صلى الله عليه وسلم", "(AB C):", "İ", "11⁄2", "a \x1f b", "", "ét")
LOOKUPS = ("fine", "strasse", "한글", "viii°c", "", "صلى الله عليه وسلم", "(ab c):", "i\u0307", "11⁄2", "a b", "", "ét")
_SPREAD = f"SELECT o_orderkey AS k, o_orderkey % {len(FOLDED)} AS i FROM orders"


def _case(values: tuple[str, ...]) -> str:
    return "CASE i " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def clock_changes() -> str:
    """Stretches that a clock skips (g) or shows twice (t), by the public rules of each zone."""
    changes = [
        (0, "2024-03-31 01:00", "2024-03-31 03:00", "g"), (1, "2024-10-27 01:00", "2024-10-27 03:00", "t"), (2, "2024-04-07 01:30", "2024-04-07 02:00", "t"), (3, "2024-10-06 02:00", "2024-10-06 02:30", "g"),
        (4, "2011-12-30 00:00", "2011-12-31 00:00", "g"), (5, "2015-08-14 23:30", "2015-08-15 00:00", "t"), (6, "2018-05-04 23:30", "2018-05-05 00:00", "g"), (7, "2024-11-03 01:00", "2024-11-03 02:00", "t"),
    ]
    near = ", ".join(f"({i}, '{z}', TIMESTAMP '{t}:00')" for i, (z, t) in enumerate(CLOCKS))
    rows = ", ".join(f"({i}, TIMESTAMP '{a}:00', TIMESTAMP '{b}:00', '{'NONEXISTENT' if kind == 'g' else 'AMBIGUOUS'}_LOCAL_TIME')" for i, a, b, kind in changes)
    return f"""SELECT k, zone, strftime(t, '%Y-%m-%d %H:%M') AS wall, (SELECT max(e) FROM (VALUES {rows}) AS c(j, a, b, e) WHERE j = i AND t >= a AND t < b) AS error
        FROM (SELECT o_orderkey AS k, i, zone, near + (o_orderkey // {len(CLOCKS)} % 60 * 10 - 300) * INTERVAL 1 MINUTE AS t FROM orders JOIN (VALUES {near}) AS n(i, zone, near) ON o_orderkey % {len(CLOCKS)} = i)"""


def plain() -> dict[str, str]:
    """Queries over the driver's own tables."""
    blank = ", ".join(str(i) for i, v in enumerate(FOLDED) if not v)
    issue = "SELECT k AS row_number, '{}' AS field, 'REQUIRED_VALUE_MISSING' AS code, 'ERROR' AS severity FROM ({}) WHERE k % 2 = {} AND i IN ({})"
    price = "[('order_id', 'text', 'mapped'), ('created_at', 'at', 'mapped'), ('promised_delivery_time', NULL, 'optional'), ('actual_delivery_time', NULL, 'optional'), ('ordered_quantity', NULL, 'missing'), ('delivered_quantity', NULL, 'optional'), ('quantity_unit', NULL, 'missing'), ('order_status', NULL, 'optional'), ('raw_order_status', NULL, 'missing'), ('warehouse_id', NULL, 'optional'), ('carrier_id', NULL, 'optional'), ('destination_region', NULL, 'optional'), ('sales_channel', NULL, 'optional')]"
    return {
        "clock_changes": clock_changes(),
        "stored_mappings": """SELECT o_orderstatus AS raw, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'processing' ELSE 'unmapped' END AS code, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'project_user' ELSE 'unmapped' END AS source,
            CASE WHEN o_orderstatus IN ('F', 'O') THEN 1e0 ELSE 0e0 END AS confidence, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus""",
        "folded_texts": f"SELECT k AS row_number, {_case(FOLDED)} AS folded, {_case(LOOKUPS)} AS lookup, i IN ({blank}) AS blank FROM ({_SPREAD})",
        "blank_cells": issue.format("quantity_unit", _SPREAD, 0, blank) + " UNION ALL " + issue.format("order_id", _SPREAD, 1, blank),
        "null_counts": f"""SELECT f[1] AS field, CAST(CASE f[1] WHEN 'order_id' THEN b WHEN 'created_at' THEN 0 ELSE n END AS BIGINT) AS nulls, f[2] AS source, f[3] AS resolution
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE i IN ({blank})) AS b FROM ({_SPREAD})), (SELECT unnest({price}) AS f)""",
    }


def report_markdown() -> str:
    """Each section's lines: the names, the first hundred rows, and the mark where there are more."""
    rates = "('ot_rate', 'if_rate', 'otif_rate')"
    number = lambda c: f"CASE WHEN {c} IS NULL THEN '—' ELSE format('{{:g}}', {c}) END"
    cells = lambda *c: "'| ' || " + " || ' | ' || ".join(c) + " || ' |'"
    parts = {
        "metrics": ("code, value, coverage, warnings", f"SELECT {cells('code', number('value'), number('coverage'), 'warnings')} AS line, row_number() OVER (ORDER BY p) AS k FROM (SELECT *, list_position({list(CODES)}, code) AS p FROM m)"),
        "trend": ("group_key, code, value", f"SELECT {cells('g', 'code', number('value'))} AS line, row_number() OVER (ORDER BY g, code) AS k FROM mw WHERE code IN {rates}"),
        "breakdown": ("group_key, code, value", f"SELECT {cells('g', 'code', number('value'))} AS line, row_number() OVER (ORDER BY g, code) AS k FROM mc WHERE code IN {rates}"),
        "diagnostics": ("place, rule_id, finding, severity, affected", f"SELECT {cells('CAST(place AS VARCHAR)', 'rule_id', 'finding', 'severity', 'CAST(affected AS VARCHAR)')} AS line, place AS k FROM fi"),
    }
    out = []
    for name, (columns, rows) in parts.items():
        out.append(f"SELECT '{name}' AS section, 0 AS place, '| {' | '.join(columns.split(', '))} |' AS line")
        out.append(f"SELECT '{name}', CAST(k AS INTEGER), line FROM ({rows}) WHERE k <= 100")
        out.append(f"SELECT '{name}', 101, 'The first 100 of ' || n || ' rows.' FROM (SELECT count(*) AS n FROM ({rows})) WHERE n > 100")
    return f", {evidence()}, {metrics(ALL, **TOTAL)}, {metrics(f'SELECT order_id, {WEEK} AS g FROM oe', suffix='w')}, {metrics('SELECT order_id, carrier_id AS g FROM oe', suffix='c')}\n" + " UNION ALL ".join(out)


def evidence_list() -> str:
    return f""", {evidence()}, el2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, finding ORDER BY order_id NULLS LAST, observed DESC NULLS LAST, threshold NULLS LAST) AS place FROM ee) WHERE place <= 20),
ms AS (SELECT order_id, event_id AS id, event_time, event_code FROM pw UNION ALL SELECT order_id, tracking_event_id, event_time, event_code FROM pt),
ei AS (SELECT r.rule_id, r.finding, r.place, string_agg(DISTINCT ms.id, ',' ORDER BY ms.id) AS events FROM el2 r JOIN iv ON iv.order_id = r.order_id AND iv.code = r.dimension_value AND r.dimension = 'node' AND abs(iv.hours - r.observed) < 1e-9
    JOIN defs ON defs.code = iv.code JOIN ms ON ms.order_id = r.order_id AND ((ms.event_code = defs.a AND ms.event_time = iv.s) OR (ms.event_code = defs.b AND ms.event_time = iv.e)) GROUP BY 1, 2, 3)
SELECT rule_id, finding, CAST(place AS INTEGER) AS place, order_id, CASE WHEN observed IS NULL THEN finding ELSE finding || ': ' || printf('%.4f', observed) || ' against ' || printf('%.4f', threshold) END AS text, coalesce(events, '') AS events
FROM el2 LEFT JOIN ei USING (rule_id, finding, place)"""


def sql() -> dict[str, str]:
    """Queries over the fixture views, which :data:`HEAD` defines."""
    q = {"breakdown_all": breakdown_all(), "peer_quantiles": peer_quantiles(), "fl_cr_001_lanes": close_lanes()}
    q["streamed_intervals"] = " SELECT order_id, code AS interval_code, sh AS shipment, loc AS location, round(hours, 6) AS hours FROM iv"
    mask = "'***' || right({0}, CASE WHEN length({0}) < 4 THEN 1 ELSE 4 END)"
    q["masked_tree"] = f" SELECT {mask.format('order_id')} AS order_id, {mask.format('order_id')} || ',***c' AS ids, order_id AS note, {mask.format('tracking_event_id')} AS event, event_code, {mask.format('order_id')} AS source, event_code AS code FROM pt"
    number = "CAST(substr(order_id, 5) AS BIGINT)"
    q["browser_order_page"] = f" SELECT order_id, order_status FROM oe ORDER BY {number} DESC LIMIT 50 OFFSET 100"
    q["browser_status_page"] = " SELECT order_id, order_status FROM oe WHERE order_status <> 'delivered' ORDER BY order_status, order_id LIMIT 100"
    q["groups_by_number"] = f", {metrics('SELECT order_id, carrier_id AS g FROM oe')} SELECT g AS group_key, round(v, 6) AS value FROM (SELECT g, CASE WHEN g <> 'CAR-1' THEN value END AS v FROM m WHERE code = 'otif_rate') ORDER BY coalesce(v, -1), g LIMIT 3"
    q |= {"report_markdown": report_markdown(), "evidence_list": evidence_list()}
    return {k: HEAD + v for k, v in q.items()} | plain()
