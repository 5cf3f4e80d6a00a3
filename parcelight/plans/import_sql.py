"""DuckDB SQL for the queries of :mod:`.import_queries`; expected rows of pure header logic are written out."""

from __future__ import annotations

from .oracle import HEAD

K = "o_orderkey"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def _issues(table: str, *rules: tuple[str, str, str, str]) -> str:
    """Issue rows of ``table`` (k) from (condition, field, code, severity)."""
    return " UNION ALL ".join(f"SELECT {big('k')} AS row_number, '{f}' AS field, '{c}' AS code, '{s}' AS severity FROM {table} WHERE {w}" for w, f, c, s in rules)


MAPPED = [
    ("order_id", "order_id", 1.0, "exact"), ("Created At", "created_at", 0.98, "normalized"), ("qty", "ordered_quantity", 0.95, "alias"), ("单位", "quantity_unit", 0.95, "alias"),
    ("订单状态", "raw_order_status", 0.95, "alias"), ("承诺送达时间", "promised_delivery_time", 0.95, "alias"), ("Carrier ID", "carrier_id", 0.98, "normalized"),
]
CHECKED = [("type", t) for t in ("orders", "warehouse_events", "tracking_events")] + [("fault", f) for f in (
    "UNKNOWN_SOURCE:zzz", "UNKNOWN_TARGET:nothing", "IGNORED_AND_MAPPED:qty", "UNRESOLVED:Created At", "UNRESOLVED:单位", "UNRESOLVED:订单状态", "UNRESOLVED:承诺送达时间",
    "UNRESOLVED:Carrier ID", "UNRESOLVED:delivered_quantitty", "DUPLICATE_TARGET:order_id", "MISSING_REQUIRED:created_at", "MISSING_REQUIRED:ordered_quantity",
    "MISSING_REQUIRED:quantity_unit", "MISSING_REQUIRED:raw_order_status")]
BROWSER = [
    ("运单号", "shipment_id", "high", False, "tracking_events"), ("扫描时间", "event_time", "high", False, "tracking_events"), ("物流状态", "raw_status", "high", False, "tracking_events"),
    ("异常", "exception_code", "high", False, "tracking_events"), ("备注", None, "low", True, "tracking_events"),
]
# raw text by its place, with what it becomes
STATUS = [
    ("已签收", "delivered", "builtin_exact", 0.98), ("POD_OK at door", "delivered", "builtin_keyword_raw", 0.96), ("in_transit", "in_transit", "standard_code", 1.0),
    ("ＰＩＣＫＵＰ　ＯＫ", "unmapped", "unmapped", 0.0), ("parcel  Collected", "carrier_picked_up", "builtin_keyword_raw", 0.96), ("nothing known", "unmapped", "unmapped", 0.0),
    ("退件完成", "returned", "builtin_keyword_raw", 0.96), ("到达中转站", "arrived_at_hub", "builtin_keyword_raw", 0.92), ("Custom Scan", "arrived_at_hub", "project_user", 1.0),
    ("returned", "returned", "standard_code", 1.0),
]


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["csv_round_trip"] = f"""SELECT {K} AS id, CASE {K} % 5 WHEN 0 THEN 'say "' || o_orderpriority || '", twice' WHEN 1 THEN '''=' || o_orderpriority WHEN 2 THEN o_orderpriority || chr(10) || ';' || chr(9) || '|'
    WHEN 3 THEN '运单,号' ELSE o_orderpriority END AS cell FROM orders"""
    bad = "CASE WHEN n_nationkey % 4 IN (0, 1) THEN 'COLUMN_COUNT_MISMATCH' END"
    q["csv_blocks"] = """SELECT o_orderkey AS id, CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'b' WHEN k % 5 = 0 THEN 'say "' || p || '", twice'
        WHEN k % 5 = 1 THEN p || chr(10) || ',' || chr(10) || '"' || CAST(k AS VARCHAR) WHEN k % 5 = 2 THEN p || '"' ELSE p END AS cell,
        CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'COLUMN_COUNT_MISMATCH' END AS code, true AS gapless FROM (SELECT o_orderkey, o_orderkey AS k, o_orderpriority AS p FROM orders)"""
    q["csv_ragged"] = f"SELECT {big('n_nationkey + 2')} AS row_number, CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'x' END AS name, {bad} AS code FROM nation WHERE n_nationkey % 4 <> 2"
    q["csv_encodings"] = f"""SELECT {big('n_nationkey')} AS k, CASE n_nationkey % 4 WHEN 2 THEN 'utf-8-sig' WHEN 3 THEN NULL ELSE 'utf-8' END AS encoding, CASE WHEN n_nationkey % 4 = 3 THEN 'gb18030,gbk' ELSE '' END AS choices,
    CASE n_nationkey % 4 WHEN 0 THEN 'gbk' WHEN 1 THEN 'gbk' WHEN 2 THEN 'utf-8' ELSE 'utf-8-sig' END AS alias FROM nation"""
    day = "strftime(DATE '1899-12-30' + CAST(45000 + n_nationkey AS INTEGER), '%Y-%m-%d') || ' 00:00:00'"
    q["xlsx_rows"] = f"SELECT n_name AS name, {day} AS day, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, CAST(NULL AS VARCHAR) AS sum, {big('(SELECT count(*) FROM nation)')} AS formulas FROM nation"
    q["xlsx_sheets"] = "SELECT CAST(n_regionkey AS VARCHAR) AS path, sheet, sheet = 'S' AS visible, 'xlsx' AS kind FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (VALUES ('S'), ('H')) AS v(sheet)"
    q["mapping_suggestions"] = _values(MAPPED, "header, field, confidence, reason").replace("SELECT *", "SELECT header, field, CAST(confidence AS DOUBLE) AS confidence, reason")
    q["mapping_checks"] = _values(CHECKED, "kind, what")
    q["browser_suggestions"] = _values(BROWSER, "header, field, level, ignorable, kind")
    q["sensitive_columns"] = _sensitive()
    q |= _validations()
    q |= _scalars()
    q["streamed_windows"] = f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS event_code, {big('count(*)')} AS n FROM events GROUP BY 1, 2"
    q["streamed_sessions"] = f"""SELECT CAST(user_id AS VARCHAR) AS shipment_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, {big('count(*)')} AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g"""
    facts = {
        "jsonl_round_trip": "SELECT order_id, CAST(promised_delivery_time AS VARCHAR) AS promised_delivery_time, ordered_quantity, carrier_id, CAST(source_index AS BIGINT) AS source_index FROM fx_orders",
        "dataset_ordered": f" SELECT {big('count(*)')} AS n, true AS ordered FROM fx_orders",
        "dataset_store": f""", c AS (SELECT count(*) AS n, count(*) FILTER (WHERE source_index % 3 = 0) AS a, count(*) FILTER (WHERE source_index % 2 = 0) AS b, sum(source_index) FILTER (WHERE source_index % 3 = 0) AS p FROM fx_orders)
    SELECT id AS dataset_id, {big("CASE id WHEN 'a' THEN a ELSE b END")} AS n_rows, created, {big('a')} AS loaded, {big('p')} AS places, {big('n')} AS deleted FROM c, (VALUES ('a', '2024-01-04'), ('b', '2024-01-02')) AS v(id, created)""",
    }
    return {k: HEAD + v for k, v in facts.items()} | q


def _sensitive() -> str:
    hit = {"mobile": "(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])", "id_card": "(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])"}
    parts = ["SELECT '收件人电话' AS column, kind, scope FROM (VALUES ('name'), ('phone')) AS k(kind), (VALUES ('all'), ('preview')) AS s(scope)"]
    for scope, table in (("all", "documents"), ("preview", "(SELECT * FROM documents ORDER BY doc_id LIMIT 100)")):
        parts += [f"SELECT '备注', '{k}', '{scope}' FROM {table} WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for k, p in hit.items()]
    return " UNION ALL ".join(parts)


def _validations() -> dict[str, str]:
    E, W = "ERROR", "WARNING"
    t = f"(SELECT {K} AS k, o_orderdate FROM orders)"
    named = "k % 31 <> 0 AND k % 37 = 0"
    # rows that share a made-up id (k % 37 = 0) differ in some column, unless only one has that id
    ids = f"""SELECT {K} AS k, {K} % 5 AS g, struct_pack(a := CASE WHEN {K} % 17 <> 0 THEN o_orderdate END, b := {K} % 13 = 0, c := CASE WHEN {K} % 19 = 0 THEN 1 WHEN {K} % 29 = 0 OR {K} % 41 = 0 THEN 2 END, d := {K} % 43 = 0,
        e := CASE WHEN {K} % 23 = 0 THEN 2 ELSE {K} % 2 END, f := {K} % 47 = 0) AS body FROM orders WHERE {K} % 31 <> 0 AND {K} % 37 = 0"""
    twins = f"(SELECT k, count(*) OVER w AS n, row_number() OVER (PARTITION BY g ORDER BY k) AS r, (SELECT count(DISTINCT body) FROM ({ids}) y WHERE y.g = x.g) AS d FROM ({ids}) x WINDOW w AS (PARTITION BY g))"
    number = "k % 19 <> 0 AND (k % 29 = 0 OR k % 41 = 0)"
    early = "k % 13 = 0 AND k % 17 <> 0"
    orders = _issues(
        t, ("k % 31 = 0", "order_id", "REQUIRED_VALUE_MISSING", E), ("k % 17 = 0", "created_at", "INVALID_TIME", E), (early, "promised_delivery_time", "TIME_ORDER_CONFLICT", E),
        ("k % 19 = 0", "ordered_quantity", "NEGATIVE_OR_INVALID_QUANTITY", E), (f"{number} AND k % 29 = 0", "ordered_quantity", "AMBIGUOUS_NUMBER_FORMAT", E), (f"{number} AND k % 29 <> 0", "ordered_quantity", "UNPARSEABLE_NUMBER", E),
        ("k % 43 = 0", "quantity_unit", "SCHEMA_VALIDATION_ERROR", E), ("k % 47 = 0", "warehouse_id", "LONG_TEXT_VALUE", E), ("k % 47 = 0", "warehouse_id", "SCHEMA_VALIDATION_ERROR", E), ("k % 23 = 0", "order_status", "UNKNOWN_STATUS", W),
    ) + " UNION ALL " + _issues(twins, ("d > 1", "order_id", "DUPLICATE_KEY_CONFLICT", E), ("d = 1 AND r > 1", "order_id", "EXACT_DUPLICATE_ROW", W))
    bad = f"k % 31 = 0 OR k % 17 = 0 OR ({early}) OR k % 19 = 0 OR {number} OR k % 43 = 0 OR k % 47 = 0 OR k IN (SELECT k FROM {twins} WHERE d > 1 OR r > 1)"
    local = "strftime(CAST(o_orderdate AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')"
    ident = f"CASE WHEN {named} THEN 'D-' || CAST(k % 5 AS VARCHAR) ELSE 'ORD-' || CAST(k AS VARCHAR) END"
    status = "CASE WHEN k % 23 = 0 THEN 'unmapped' WHEN k % 2 = 0 THEN 'delivered' ELSE 'cancelled' END"
    valid = f"SELECT {ident} AS order_id, {local} AS created, 1234.5e0 AS ordered_quantity, {status} AS order_status, 'W1' AS warehouse_id, {big('k')} AS source_index, false AS can_confirm FROM {t} WHERE NOT ({bad})"
    when = f"(SELECT {K} AS k, {K} // 4 AS g, CASE WHEN {K} % 19 <> 0 THEN o_orderdate + (({K} * 7) % 24) * INTERVAL 1 HOUR END AS t FROM orders)"
    late = f"(SELECT k, t, last_value(t IGNORE NULLS) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {when})"
    tracking = _issues(
        f"(SELECT {K} AS k FROM orders)", ("k % 19 = 0", "event_time", "REQUIRED_VALUE_MISSING", E), ("k % 10 IN (3, 5)", "event_code", "UNKNOWN_STATUS", W), ("k % 3 = 0", "exception_code", "GENERIC_OR_UNKNOWN_EXCEPTION", W),
    ) + " UNION ALL " + _issues(late, ("t < p", "event_time", "TIME_ORDER_CONFLICT", W)) + " UNION ALL SELECT NULL, 'tracking_event_id', 'GENERATED_TRACKING_EVENT_ID', 'INFO'"
    rows = ", ".join(f"({i}, '{r}', '{c}', '{s}', {conf}e0)" for i, (r, c, s, conf) in enumerate(STATUS))
    counts = f"SELECT raw, code, source, confidence, {big('count(*)')} AS n FROM orders JOIN (VALUES {rows}) AS v(i, raw, code, source, confidence) ON {K} % 10 = i GROUP BY ALL"
    w = f"(SELECT {K} AS k FROM orders WHERE {K} % 10 IN (2, 3, 4, 5, 6))"
    twin = lambda other: f"k IN (SELECT {K} + {other} FROM orders)"
    # 3 repeats 2 and 5 repeats 4 with another warehouse; amounts differ with k % 7
    body = lambda x: f"(CASE WHEN ({x}) % 7 = 0 THEN 3 WHEN ({x}) % 7 = 1 THEN -3 END, CASE WHEN ({x}) % 7 = 1 THEN 'piece' WHEN ({x}) % 7 = 2 THEN 'box' END)"
    differ = lambda x, y: f"{body(x)} IS DISTINCT FROM {body(y)}"
    warehouse = _issues(
        w, ("k % 7 = 1", "quantity", "NEGATIVE_OR_INVALID_QUANTITY", E), ("k % 7 = 0 OR k % 7 = 2", "quantity", "SCHEMA_VALIDATION_ERROR", E),
        (f"k % 10 = 3 AND {twin(1)} AND {differ('k', 'k - 1')}", "event_id", "DUPLICATE_KEY_CONFLICT", E), (f"k % 10 = 2 AND {twin(-1)} AND {differ('k', 'k + 1')}", "event_id", "DUPLICATE_KEY_CONFLICT", E),
        (f"k % 10 = 3 AND {twin(1)} AND NOT ({differ('k', 'k - 1')})", "event_id", "EXACT_DUPLICATE_ROW", W),
        (f"k % 10 = 5 AND {twin(1)}", "event_id", "DUPLICATE_KEY_CONFLICT", E), (f"k % 10 = 4 AND {twin(-1)}", "event_id", "DUPLICATE_KEY_CONFLICT", E),
    )
    return {"validated_order_rows": orders, "valid_orders": valid, "validated_tracking_rows": tracking, "tracking_statuses": counts, "validated_warehouse_rows": warehouse}


def _scalars() -> dict[str, str]:
    q = {}
    middle = f"CASE {K} % 3 WHEN 0 THEN '(1),' WHEN 1 THEN 'ト1' ELSE 'x  y' END || CAST({K} % 9 AS VARCHAR)"
    canon = f"'S' || CAST({K} AS VARCHAR) || chr(31) || 't' || chr(31) || CAST({K} AS VARCHAR)"
    h = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({canon}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: (xor(x, y) * 16777619) & 4294967295)"
    codes = ["GENERIC_EXCEPTION", None, None, None, "ADDR_BAD", None, None, "GENERIC_EXCEPTION", "WEATHER_DELAY", "OKAY"]
    exception = f"CASE {K} % 10 " + " ".join(f"WHEN {i} THEN {'NULL' if c is None else repr(c)}" for i, c in enumerate(codes)) + " END"
    ident = f"CASE WHEN {K} % 5 <> 0 THEN printf('TRE-GEN-%06d-%08X', {K}, {h}) END"
    q["scalar_texts"] = f"SELECT {K}, 'Ab ' || {middle} AS parsed, 'ab ' || regexp_replace({middle}, '\\s+', ' ', 'g') AS lookup, {ident} AS ident, {exception} AS exception FROM orders"
    # text: value, error, error where a whole number is asked for
    numbers = [(1234.0, None, None), (None, "AMBIGUOUS_NUMBER_FORMAT", "AMBIGUOUS_NUMBER_FORMAT"), (0.5, None, "UNPARSEABLE_INTEGER"), (12.0, None, None), (None, "UNPARSEABLE_NUMBER", "UNPARSEABLE_NUMBER"),
               (None, "UNPARSEABLE_NUMBER", "UNPARSEABLE_NUMBER"), (7.0, None, None), (1000.0, None, None), (3.0, None, None), (-0.5, None, "UNPARSEABLE_INTEGER"), (None, None, None)]
    pick = lambda j: f"CASE {K} % 11 " + " ".join(f"WHEN {i} THEN {'NULL' if r[j] is None else repr(r[j]) + ('e0' if j == 0 else '')}" for i, r in enumerate(numbers)) + " END"
    q["scalar_numbers"] = f"SELECT {K}, {big(f'round_even({K} % 100 + 0.5e0, 0)')} AS rounded, {K} % 4 <= 1 AS near, CAST({pick(0)} AS DOUBLE) AS value, {pick(1)} AS error, {pick(2)} AS whole FROM orders"
    hour, spring = f"({K} // 2 % 6)", f"{K} % 2 = 0"
    error = f"CASE WHEN {spring} AND {hour} = 2 THEN 'NONEXISTENT_LOCAL_TIME' WHEN NOT {spring} AND {hour} = 1 THEN 'AMBIGUOUS_LOCAL_TIME' END"
    wall = f"(CASE WHEN {spring} THEN TIMESTAMP '2024-03-10' ELSE TIMESTAMP '2024-11-03' END + {hour} * INTERVAL 1 HOUR + ({K} % 60) * INTERVAL 1 MINUTE)"
    offset = f"CASE WHEN {spring} THEN CASE WHEN {hour} < 2 THEN 5 ELSE 4 END ELSE CASE WHEN {hour} < 1 THEN 4 ELSE 5 END END"
    zoned = f"CASE {K} % 3 WHEN 0 THEN CASE WHEN {spring} THEN '2024-03-10 10:30' ELSE '2024-11-03 10:30' END WHEN 1 THEN CASE WHEN {spring} THEN '2024-03-10 02:30' ELSE '2024-11-03 02:30' END END"
    q["wall_times"] = f"SELECT {K}, {error} AS error, CASE WHEN ({error}) IS NULL THEN strftime({wall} + ({offset}) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') END AS utc, {zoned} AS zoned FROM orders"
    stem = "CASE n_nationkey % 4 WHEN 0 THEN 'a_b_' || n_name WHEN 1 THEN 'report' WHEN 2 THEN 'x' ELSE substr('r_' || repeat('long', 30), 1, 72) END"
    q["export_names"] = f"SELECT {big('n_nationkey')} AS k, {stem} AS stem, printf('%.1f%%', n_nationkey * 12.5e0) AS ratio, printf('%.2f h', n_nationkey / 4e0) AS hours FROM nation"
    return q
