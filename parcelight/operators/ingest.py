"""Import: field mapping, status normalisation, validation and quality report."""

from __future__ import annotations

import difflib
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import ORDERS, TRACKING_EVENTS, WAREHOUSE_EVENTS
from ..functions import scalars as S
from ..functions.text import lookup_form, unfolded
from ..sources.shared import stored

MAX_CELL = 4096


@dataclass(frozen=True)
class Contract:
    name: str
    schema: T.StructType
    key: str
    required: tuple[str, ...]
    times: tuple[str, ...]
    raw_status: str
    status: str
    aliases: dict[str, tuple[str, ...]]


# Alternative headers of the contract's fields.
CONTRACTS = {
    c.name: c
    for c in (
        Contract("orders", ORDERS, "order_id", ("order_id", "created_at", "ordered_quantity", "quantity_unit", "raw_order_status"), ("created_at", "promised_delivery_time", "actual_delivery_time"), "raw_order_status", "order_status",
                 {"order_id": ("订单号", "订单编号", "order no", "order number"), "created_at": ("下单时间", "创建时间", "order time"), "promised_delivery_time": ("承诺送达时间", "promise time", "eta"), "actual_delivery_time": ("实际送达时间", "签收时间", "delivered at"), "ordered_quantity": ("订购数量", "qty", "quantity"), "delivered_quantity": ("交付数量", "delivered qty"), "quantity_unit": ("单位", "unit"), "raw_order_status": ("订单状态", "status"), "warehouse_id": ("仓库", "warehouse"), "carrier_id": ("承运商", "carrier"), "destination_region": ("目的地", "region"), "sales_channel": ("渠道", "channel")}),
        Contract("warehouse_events", WAREHOUSE_EVENTS, "event_id", ("event_id", "order_id", "event_time", "raw_status", "warehouse_id"), ("event_time",), "raw_status", "event_code", {"event_id": ("事件编号",), "order_id": ("订单号",), "event_time": ("事件时间", "time"), "raw_status": ("状态", "status"), "warehouse_id": ("仓库", "warehouse")}),
        Contract("tracking_events", TRACKING_EVENTS, "tracking_event_id", ("shipment_id", "event_time", "raw_status"), ("event_time",), "raw_status", "event_code", {"shipment_id": ("运单号", "tracking no", "waybill"), "order_id": ("订单号",), "event_time": ("扫描时间", "时间", "time"), "raw_status": ("状态", "物流状态", "status"), "location_code": ("地点", "location"), "carrier_id": ("承运商", "carrier")}),
    )
}


def normalize_name(text: str) -> str:
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).casefold())


def name_variants(text: str) -> tuple[str, ...]:
    plain = unicodedata.normalize("NFKC", text)
    return tuple(dict.fromkeys((normalize_name(plain), normalize_name(re.sub(r"\([^)]*\)", "", plain)))))


def score_column(source: str, contract: Contract, unique: bool = True) -> list[tuple[str, float, str]]:
    """(field, confidence, reason) of every field, best first."""
    out = []
    forms = name_variants(source)
    for f in contract.schema.fieldNames():
        if f == "source_index":
            continue
        target, others = normalize_name(f), {normalize_name(a) for a in contract.aliases.get(f, ())}
        if source == f:
            s, why = 1.0, "exact"
        elif target in forms:
            s, why = 0.98, "normalized"
        elif others & set(forms):
            s, why = 0.95, "alias"
        else:
            s = min(0.94, 0.88 * max(difflib.SequenceMatcher(None, v, t).ratio() for v in forms for t in {target, *others}))
            if f == "tracking_event_id" and not unique:  # an id that repeats; a header that names the field stands
                s = max(0.0, s - 0.25)
            s, why = round(s, 4), "similarity"
        out.append((f, s, why))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def suggest_mapping(headers: list[str], contract: Contract, unique: dict[str, bool] | None = None) -> dict[str, tuple[str, float, str]]:
    """Source to (field, confidence, reason).  A similarity needs a lead over the second; one source per field, the first of equals."""
    best: dict[str, tuple[str, float, str]] = {}
    for h in headers:
        ranked = score_column(h, contract, (unique or {}).get(h, True))
        field, s, why = ranked[0]
        if s >= 0.86 and (why != "similarity" or s - ranked[1][1] >= 0.08):
            best[h] = (field, s, why)
    out: dict[str, tuple[str, float, str]] = {}
    for h, (field, s, why) in sorted(best.items(), key=lambda x: (-x[1][1], headers.index(x[0]))):
        if field not in {f for f, _, _ in out.values()}:
            out[h] = (field, s, why)
    return {h: out[h] for h in headers if h in out}


def detect_types(headers: list[str]) -> list[tuple[str, float]]:
    """Data types by 0.8 * share of required fields found + 0.2 * share of all fields; best first."""
    out = []
    for c in CONTRACTS.values():
        got = {f for f, _, _ in suggest_mapping(headers, c).values()}
        need = {("status" if f in (c.raw_status, c.status) else f) for f in c.required}
        have = {("status" if f in (c.raw_status, c.status) else f) for f in got}
        out.append((c.name, 0.8 * len(need & have) / len(need) + 0.2 * len(got) / (len(c.schema) - 1)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def validate_mapping(mapping: dict[str, str], headers: list[str], contract: Contract, ignored: tuple[str, ...] = ()) -> list[str]:
    errors = [f"UNKNOWN_SOURCE:{h}" for h in [*mapping, *ignored] if h not in headers]
    errors += [f"UNKNOWN_TARGET:{t}" for t in mapping.values() if t not in contract.schema.fieldNames() or t == "source_index"]
    errors += [f"IGNORED_AND_MAPPED:{h}" for h in ignored if h in mapping]
    errors += [f"UNRESOLVED:{h}" for h in headers if h not in mapping and h not in ignored]
    targets = list(mapping.values())
    errors += [f"DUPLICATE_TARGET:{t}" for t in dict.fromkeys(targets) if targets.count(t) > 1]
    have = set(targets) | ({contract.raw_status} if contract.status in targets else set())
    return errors + [f"MISSING_REQUIRED:{f}" for f in contract.required if f not in have]


# Headers that name personal data.
SENSITIVE_HEADERS = {"name": "姓名|收件人|联系人|(recipient|customer|contact)[ _]?name", "phone": "电话|手机|phone|mobile|tel", "address": "地址|address", "id_card": "身份证|证件|id[ _]?card"}
MOBILE = r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"
ID_CARD = r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"


def sensitive_columns(df: DataFrame, order: str | None = None, first: int | None = None) -> dict[str, list[str]]:
    """Columns that look like personal data by header or by their values: all of them, or, as a preview shows, those of the
    ``first`` rows by ``order``."""
    out = {c: [k for k, p in SENSITIVE_HEADERS.items() if re.search(p, unicodedata.normalize("NFKC", c), re.I)] for c in df.columns}
    rows = df if first is None else df.orderBy(order).limit(first)
    hit = lambda c, p: F.max(F.col(f"`{c}`").cast("string").rlike(p))
    kinds = (("mobile", MOBILE), ("id_card", ID_CARD))
    seen = rows.agg(*(hit(c, p).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k, p in kinds)).first()
    for i, c in enumerate(df.columns):
        out[c] += [k for k, _ in kinds if seen[f"{i}_{k}"]]
    return {c: sorted(set(v)) for c, v in out.items() if v}


def column_profile(df: DataFrame) -> DataFrame:
    """Per column the shares, over non-empty values, of dates, numbers, ids and distinct values; one pass over all columns."""
    parts = []
    for c in df.columns:
        v = S.parse_text(F.col(f"`{c}`").cast("string"))
        full = F.when(v != "", v)
        share = lambda p: F.avg(full.rlike(p).cast("double"))  # noqa: E731, B023
        parts.append(F.struct(F.lit(c).alias("column"), F.count(full).alias("n"), share(r"^\d{4}[-/年.]\d{1,2}").alias("date_like"), share(r"^[+-]?\d[\d,]*(\.\d+)?$").alias("numeric"), share(r"^[A-Za-z]*[-_]?\d{3,}$").alias("id_like"), S.ratio(F.count_distinct(full), F.count(full)).alias("unique")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(f"`{s}`").alias(t) for s, t in mapping.items()))


# Status words of each table and the code that they stand for.
SYNONYMS = {
    "orders": {
        "订单已创建": "created",
        "已下单": "created",
        "已确认": "confirmed",
        "已审核": "confirmed",
        "处理中": "processing",
        "履约中": "processing",
        "已发货": "shipped",
        "已完成": "delivered",
        "已签收": "delivered",
        "妥投": "delivered",
        "已取消": "cancelled",
        "交易关闭": "cancelled",
        "已退回": "returned",
        "退货完成": "returned",
    },
    "warehouse_events": {
        "仓库接单": "order_received",
        "订单已下发": "order_received",
        "开始拣货": "picking_started",
        "拣货中": "picking_started",
        "拣货完成": "picking_completed",
        "配货完成": "picking_completed",
        "开始复核": "quality_check_started",
        "复核中": "quality_check_started",
        "复核失败": "quality_check_failed",
        "质检不通过": "quality_check_failed",
        "复核完成": "quality_check_completed",
        "质检通过": "quality_check_completed",
        "开始打包": "packing_started",
        "打包中": "packing_started",
        "打包完成": "packing_completed",
        "待出库": "ready_to_ship",
        "待揽收": "ready_to_ship",
        "已出库": "shipped_from_warehouse",
        "仓内取消": "warehouse_cancelled",
    },
    "tracking_events": {
        "运单已创建": "shipment_created",
        "已揽件": "carrier_picked_up",
        "快件已揽收": "carrier_picked_up",
        "始发地已发出": "origin_departed",
        "运输中": "in_transit",
        "在途": "in_transit",
        "到达分拨中心": "arrived_at_hub",
        "到达中转场": "arrived_at_hub",
        "离开分拨中心": "departed_hub",
        "发往下一站": "departed_hub",
        "到达目的城市": "arrived_at_destination_city",
        "派送中": "out_for_delivery",
        "正在派件": "out_for_delivery",
        "已签收": "delivered",
        "妥投": "delivered",
        "派送失败": "delivery_failed",
        "未妥投": "delivery_failed",
        "运输异常": "exception",
        "物流异常": "exception",
        "退回中": "return_initiated",
        "已退回": "returned",
        "退回完成": "returned",
    },
}
# Keywords of tracking texts, in the order in which the rules are tried, with their confidence.
KEYWORDS = {
    "tracking_events": [
        ("returned", ("return_done", "return_complete", "退回完成", "退件完成", "已退回", "返回仓库完成"), 0.96),
        ("return_initiated", ("return_open", "returning", "return_request", "return_in_flow", "退件处理开始", "退回中", "包裹返回中", "退货申请"), 0.94),
        ("delivered", ("pod_ok", "pod_signed", "customer_accept", "counter_accept", "colleague_pod", "receipt_posted", "locker_deposit",
                       "妥投", "签收", "验收完成", "代收", "智能柜", "delivered"), 0.96),
        ("delivery_failed", ("call_fail", "address_bad", "电话未接", "地址不详", "派送失败", "未妥投"), 0.92),
        ("exception", ("weather_delay", "addr_unclear", "cancelled", "address_hold", "temp_alert", "landslide_hold", "details_pending",
                       "异常", "延迟", "取消", "挂起", "滞留", "山体滑坡"), 0.9),
        ("out_for_delivery", ("out_for_delivery", "local_run_start", "run_assigned", "await_lastmile", "address_run", "重新派送", "派送中",
                              "正在派件", "派送开始", "配送启动", "配送员已接单", "按址派件", "等待末端派车", "delivering"), 0.94),
        ("carrier_picked_up", ("pickup_ok", "pickup done", "pickup_closed", "collect_ok", "door_pickup", "whole_picked", "handover_done", "parcel collected",
                               "shipment picked up", "快件已揽收", "已揽件", "已揽收", "收件完成", "取件完成", "提货完结", "货物已交接"), 0.96),
        ("arrived_at_destination_city", ("delivery_zone", "待派件", "到达派送范围", "destination city", "destination station"), 0.88),
        ("arrived_at_hub", ("hub_arr", "hub_unloaded", "transfer_landed", "province_in", "port_arrive", "dest_warehouse", "arrived @ destination hub",
                            "arrived at hub", "中转扫描", "到达中转", "到达分拨", "到达枢纽", "落地枢纽", "进入目的地仓", "港口作业区"), 0.92),
        ("departed_hub", ("trip_leave", "waypoint_scan", "departed sorting center", "中转车次出发", "经停站扫描", "离开分拨", "发往下一站"), 0.92),
        ("origin_departed", ("outbound", "origin_exit", "origin_gateout", "loading_done", "vehicle_sealed", "sort_finish", "carton_confirm",
                             "已出库", "始发地已发出", "离开发货", "装车完毕", "分拣完结", "装箱确认"), 0.92),
        ("in_transit", ("linehaul in progress", "linehaul", "geo_in_transit", "final_mile_move", "reroute_notice", "route_resume",
                        "运输中", "在途", "转运中", "运输抵达", "改线", "重新启运"), 0.94),
        ("shipment_created", ("pre-advice created", "pack ready", "label_made", "mx_reg", "logistics_order", "fulfill_received", "task_new", "pallet_created",
                              "precheck_pass", "manifest registered", "shipping label", "物流指令", "运单已创建", "运单预审", "货盘建档", "履约指令",
                              "发运任务生成"), 0.9),
    ],
}
# The codes of each table, and the longest text of a field.
CODES = {
    "orders": ("created", "confirmed", "processing", "shipped", "delivered", "cancelled", "returned", "unmapped"),
    "warehouse_events": ("order_received", "picking_started", "picking_completed", "quality_check_started", "quality_check_failed", "quality_check_completed",
                         "packing_started", "packing_completed", "ready_to_ship", "shipped_from_warehouse", "warehouse_cancelled", "unmapped"),
    "tracking_events": ("shipment_created", "carrier_picked_up", "origin_departed", "in_transit", "arrived_at_hub", "departed_hub",
                        "arrived_at_destination_city", "out_for_delivery", "delivered", "delivery_failed", "exception", "return_initiated", "returned", "unmapped"),
}
LONGEST = {"quantity_unit": 32, "sales_channel": 64, "exception_code": 64, "source_system": 64, "raw_order_status": 256, "raw_status": 256}
LONGEST_ID = 128
Keywords = list[tuple[str, tuple[str, ...], float]]


def normalize_status(kind: str, raw: str, project_map: dict[str, str] | None = None, keywords: Keywords | None = None, auxiliary: tuple[str, ...] = (), looks: dict[str, str] | None = None) -> Column:
    """struct(code, source, confidence): the project's own mapping, known synonyms, standard codes, then keywords (the
    table's own, unless given) in the raw status and in auxiliary columns, the first rule that fits; else ``unmapped``.

    Exact tiers are literal maps (a few dozen entries), keywords a chain of conditions, so a row costs no join.  ``looks`` names the
    columns that hold the lookup text of ``raw`` and of auxiliary columns, where these are there already.
    """
    looked = lambda c: F.col(looks[c]) if looks else S.lookup_text(c)
    look = looked(raw)
    found = lambda code, source, conf: F.struct(code.alias("code"), F.lit(source).alias("source"), F.lit(float(conf)).alias("confidence"))
    table = lambda m: F.create_map(*(F.lit(lookup_form(k) if i % 2 == 0 else k) for kv in m.items() for i, k in enumerate(kv)))
    tiers = []
    if project_map:
        own = F.try_element_at(table(project_map), look)
        tiers.append(F.when(own.isNotNull(), found(own, "project_user", 1.0)))
    known = F.try_element_at(table(SYNONYMS[kind]), look)
    tiers.append(F.when(known.isNotNull(), found(known, "builtin_exact", 0.98)))
    tiers.append(F.when(look.isin(*CODES[kind]), found(look, "standard_code", 1.0)))
    for column in (raw, *auxiliary):
        text = looked(column)
        name = "builtin_keyword_raw" if column == raw else f"auxiliary_keyword:{column}"
        for target, words, conf in KEYWORDS.get(kind, []) if keywords is None else keywords:
            hit = None
            for w in words:
                c = F.contains(text, F.lit(lookup_form(w)))
                hit = c if hit is None else hit | c
            if target in CODES[kind] and hit is not None:
                tiers.append(F.when(hit, found(F.lit(target), name, conf)))
    return F.coalesce(*tiers, found(F.lit("unmapped"), "unmapped", 0.0))


@dataclass
class Validation:
    """valid: rows of the contract.  issues: (row_number, field, code, severity); row_number is null where an issue is of the whole
    file.  statuses: what each raw status became.  nulls: (field, nulls) of each field of the contract."""

    valid: DataFrame
    issues: DataFrame
    statuses: DataFrame
    nulls: DataFrame

    def can_confirm(self) -> bool:
        """Whether the import may go on: some row is valid and none has an error."""
        return not self.valid.isEmpty() and self.issues.where("severity = 'ERROR'").isEmpty()

    def report(self) -> DataFrame:
        return self.issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_number").alias("rows"))


ISSUE = "row_number long, field string, code string, severity string"


def _issue(cond: Column, field: str, code: Column | str, severity: str = "ERROR") -> Column:
    found = F.struct(F.lit(field).alias("field"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"))
    return F.when(F.coalesce(cond, F.lit(False)), found)


def _parsed(rows: DataFrame, contract: Contract, mapping: dict[str, str], zone: str, project_map, keywords, auxiliary) -> DataFrame:
    """row_number, the contract's columns, ``st`` (the status) and ``problems`` of each row by itself.

    Text is folded and stripped in one pass of Arrow; times and numbers are parsed once, into columns that checks read.
    """
    names = [f for f in contract.schema.fieldNames() if f != "source_index"]
    raw = contract.raw_status if contract.raw_status in mapping.values() else contract.status
    df = rows.select("row_number", *(F.col(f"`{s}`").cast("string").alias(t) for s, t in mapping.items()), *(F.col(f"`{a}`").cast("string").alias(a) for a in auxiliary if a not in mapping.values()))
    df = df.select("*", *(F.lit(None).cast("string").alias(f) for f in dict.fromkeys((*names, raw)) if f not in df.columns))
    looks = {c: f"look_{i}" for i, c in enumerate((raw, *auxiliary))}
    df = unfolded(df, {f"text_{f}": (f, "text") for f in names} | {look: (c, "lookup") for c, look in looks.items()})
    text = lambda f: F.col(f"text_{f}")
    blank = lambda f: text(f).isNull() | (text(f) == "")
    kinds = {f.name: f.dataType.simpleString() for f in contract.schema.fields}
    numbers = [f for f in names if kinds[f] in ("double", "bigint")]
    status = normalize_status(contract.name, raw, project_map, keywords, auxiliary, looks)
    df = df.select(
        "*", status.alias("st"), *(S.parse_datetime(f"text_{f}", zone, parsed=True).alias(f"time_{f}") for f in contract.times),
        *(S.parse_number(f"text_{f}", kinds[f] == "bigint", parsed=True).alias(f"number_{f}") for f in numbers),
    )
    out: dict[str, Column] = {}
    problems: list[Column] = []
    derived = contract.name == "tracking_events" and contract.key not in mapping.values()
    for f in names:
        problems.append(_issue(F.length(f) > MAX_CELL, f, "LONG_TEXT_VALUE"))
        needed = f in contract.required or f == contract.key and not derived
        if needed and f not in (contract.raw_status, contract.status):
            problems.append(_issue(blank(f), f, "REQUIRED_VALUE_MISSING"))
        if f in contract.times or f in numbers:
            held = F.col(f"time_{f}" if f in contract.times else f"number_{f}")
            problems.append(_issue(held["error"].isNotNull(), f, held["error"]))
            out[f] = held["value"] if f in contract.times else held["value"].cast(kinds[f])
            if f in numbers:
                wrong = held["value"] <= 0 if f == "ordered_quantity" else held["value"] < 0
                problems.append(_issue(wrong, f, "NEGATIVE_OR_INVALID_QUANTITY"))
        elif f == contract.raw_status:
            out[f] = F.col(raw)
        elif f != contract.status:
            out[f] = F.when(text(f) != "", text(f))
            problems.append(_issue(F.length(text(f)) > LONGEST.get(f, LONGEST_ID), f, "SCHEMA_VALIDATION_ERROR"))
    if raw in mapping.values():
        problems += [_issue(blank(raw), contract.raw_status, "REQUIRED_STATUS_MISSING"), _issue(~blank(raw) & (F.col("st.code") == "unmapped"), contract.status, "UNKNOWN_STATUS", "WARNING")]
    if contract.name == "orders":
        problems += [_issue(F.col(f"time_{f}.value") < F.col("time_created_at.value"), f, "TIME_ORDER_CONFLICT") for f in ("promised_delivery_time", "actual_delivery_time")]
    if contract.name == "warehouse_events":
        problems.append(_issue(blank("quantity") != blank("quantity_unit"), "quantity", "SCHEMA_VALIDATION_ERROR"))
    if contract.name == "tracking_events":
        own = [F.coalesce(text(c), F.lit("")) for c in ("shipment_id", "event_time", "raw_status", "order_id", "carrier_id", "sequence_number")]
        if derived:
            out[contract.key] = S.generated_event_id(own, F.col("row_number"), [text(c) for c in ("shipment_id", "event_time", "raw_status")])
        out["exception_code"] = S.exception_code("text_exception_code")
        problems.append(_issue(S.unknown_exception("text_exception_code"), "exception_code", "GENERIC_OR_UNKNOWN_EXCEPTION", "WARNING"))
    absent = F.array_compact(F.array(*(F.when(blank(f), F.lit(f)) for f in names)))
    return df.select("row_number", *(c.alias(f) for f, c in out.items()), "st", absent.alias("absent"), F.array_compact(F.array(*problems)).alias("problems"))


def validate(rows: DataFrame, contract: Contract, mapping: dict[str, str], zone: str = "Asia/Shanghai", project_map: dict[str, str] | None = None, keywords: Keywords | None = None, auxiliary: tuple[str, ...] = ()) -> Validation:
    """``rows``: text columns and row_number.  Rows with an error are left out; warnings stay.

    Identical repeats of a key keep the first; repeats that differ are errors, all of them.  Rows are parsed once and stored; keys
    that repeat are counted first, so only rows of such keys are moved and compared.
    """
    parsed = stored(_parsed(rows, contract, mapping, zone, project_map, keywords, auxiliary), "parsed")
    key, raw = contract.key, contract.raw_status
    values = [c for c in parsed.columns if c not in ("row_number", "st", "absent", "problems")]
    many = stored(parsed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(key), "repeated")
    same = F.struct(*(c for c in values if c != key))  # null-safe, as a hash of the values is not
    w = Window.partitionBy(key)
    again = parsed.join(many, key, "left_semi").withColumns({"lo": F.min(same).over(w), "hi": F.max(same).over(w), "first_row": F.min("row_number").over(w)})
    conflict = F.col("lo") != F.col("hi")
    repeat = ~conflict & (F.col("row_number") > F.col("first_row"))
    more = F.array_compact(F.array(_issue(conflict, key, "DUPLICATE_KEY_CONFLICT"), _issue(repeat, key, "EXACT_DUPLICATE_ROW", "WARNING")))
    again = again.withColumns({"problems": F.concat("problems", more), "repeat": repeat}).select(*parsed.columns, "repeat")
    alone = parsed.join(many, key, "left_anti").select(*parsed.columns, F.lit(False).alias("repeat"))
    checked = alone.unionByName(again)
    issues = checked.select("row_number", F.explode("problems").alias("p")).select("row_number", "p.*")
    if contract.name != "orders":
        by = [c for c in ("order_id", "shipment_id") if c in values]
        # the last time before it of the same process, in the order of the rows
        last = F.last("event_time", True).over(Window.partitionBy(*by).orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1))
        late = parsed.select("row_number", "event_time", last.alias("before")).where("event_time < before")
        issues = issues.unionByName(late.select("row_number", F.lit("event_time").alias("field"), F.lit("TIME_ORDER_CONFLICT").alias("code"), F.lit("WARNING").alias("severity")))
    if contract.name == "tracking_events" and key not in mapping.values():
        issues = issues.unionByName(rows.sparkSession.createDataFrame([(None, key, "GENERATED_TRACKING_EVENT_ID", "INFO")], ISSUE))
    good = checked.where(~F.exists("problems", lambda p: p["severity"] == "ERROR") & ~F.col("repeat"))
    named = {contract.status: F.col("st.code"), "source_index": F.col("row_number")}
    valid = good.select(*(named.get(f, F.col(f) if f in values else F.lit(None)).cast(contract.schema[f].dataType).alias(f) for f in contract.schema.fieldNames()))
    told = checked.where(F.col(raw).isNotNull() & (S.stripped(raw) != ""))
    statuses = told.groupBy(F.col(raw).alias("raw"), "st.code", "st.source", "st.confidence").agg(F.count(F.lit(1)).alias("n"))
    counts = checked.select(F.explode("absent").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("nulls"))
    fields = rows.sparkSession.createDataFrame([(f,) for f in contract.schema.fieldNames() if f != "source_index"], "field string")
    nulls = fields.join(counts, "field", "left").select("field", F.coalesce("nulls", F.lit(0)).alias("nulls"))
    return Validation(valid, issues, statuses, nulls)


def resolutions(contract: Contract, mapping: dict[str, str]) -> list[tuple[str, str | None, str]]:
    """(field, source column, how it is resolved) of each field of the contract: mapped, derived, optional or missing."""
    source = {t: s for s, t in mapping.items()}
    out = []
    for f in contract.schema.fieldNames():
        if f != "source_index":
            derived = f == contract.status and contract.raw_status in source or f == contract.raw_status and contract.status in source or contract.name == "tracking_events" and f == contract.key
            out.append((f, source.get(f), "mapped" if f in source else "derived" if derived else "missing" if f in contract.required else "optional"))
    return out
