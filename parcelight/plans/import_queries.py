"""Registered queries over imports: sources written and read again, mapping, validation row by row, scalars, streaming."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import browser_mapping, ingest, report
from ..sources import csv, store, xlsx
from ..sources.shared import new_path, stored
from ..streaming import tracking
from ..streaming.sink import run_stream
from .queries import registered

Query = Callable[[SparkSession, str], DataFrame]
K = "source_index"

#: Headers of a file, as a user may have named them.
HEADERS = ("order_id", "Created At", "qty", "单位", "订单状态", "承诺送达时间", "Carrier ID", "colour", "delivered_quantitty")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, separators, line breaks and formulas, exported in several files and scanned again."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    odd = F.when(k % 5 == 0, F.concat(F.lit('say "'), p, F.lit('", twice'))).when(k % 5 == 1, F.concat(F.lit("="), p)).when(k % 5 == 2, F.concat(p, F.lit("\n;\t|"))).when(k % 5 == 3, F.lit("运单,号"))
    path = new_path(spark, "csv")
    csv.write(_orders(spark, sf_dir).repartition(3, "o_orderkey").select(k.alias("id"), F.coalesce(odd, p).alias("cell")), path)
    rows, _ = csv.scan(spark, f"{path}/*.txt")
    return rows.select(F.col("id").cast("long").alias("id"), "cell")


def csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several blocks, with line feeds, separators and quotes in cells and rows too short or too long: rows, their
    issues, and whether a file's lines, blank ones counted, run from 2 without a gap."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    key = k.cast("string")
    cell = F.when(k % 5 == 0, F.concat(F.lit('"say ""'), p, F.lit('"", twice"'))).when(k % 5 == 1, F.concat(F.lit('"'), p, F.lit('\n,\n""'), key, F.lit('"'))).when(k % 5 == 2, F.concat(p, F.lit('"')))
    text = F.when(k % 11 == 0, key).when(k % 13 == 0, F.concat(key, F.lit(",b,c"))).when(k % 17 == 0, F.concat(F.lit("\n"), key, F.lit(","), F.coalesce(cell, p))).otherwise(F.concat(key, F.lit(","), F.coalesce(cell, p)))
    path = new_path(spark, "csv")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = _orders(spark, sf_dir).repartitionByRange(3, "o_orderkey").select(text.alias("line"), first.alias("first"))
    rows.select(F.explode(F.when(F.col("first"), F.array(F.lit("id,cell"), F.col("line"))).otherwise(F.array("line")))).write.text(path)
    scan = csv.scan(spark, f"{path}/*.txt", block_bytes=64 * 1024)
    blank = F.when((F.col("id").cast("long") % 17 == 0) & (F.col("id").cast("long") % 11 != 0) & (F.col("id").cast("long") % 13 != 0), 1).otherwise(0)
    whole = scan.located(scan.rows).groupBy("file").agg((F.max("line") == F.count(F.lit(1)) + F.sum(blank) + 1).alias("gapless"))
    return scan.located(scan.rows).join(scan.issues.select("row_number", "code"), "row_number", "left").join(whole, "file").select(F.col("id").cast("long").alias("id"), "cell", "code", "gapless")


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a file whose lines are short, long or blank by key."""
    k = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 4 == 0, k).when(F.col("n_nationkey") % 4 == 1, F.concat(k, F.lit("\tx\ty"))).when(F.col("n_nationkey") % 4 == 2, F.lit("")).otherwise(F.concat(k, F.lit("\tx")))
    path = new_path(spark, "ragged")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), line.alias("line"))
    head = spark.createDataFrame([(-1, "id\tname")], "k long, line string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("k").select("line").write.text(path)
    found, issues = csv.scan(spark, f"{path}/*.txt")
    return found.join(issues, "row_number", "left").select("row_number", "id", "name", "code")


def csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bytes of a file say about its encoding, and the name under which an alias is known."""
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, name in zip(pdf["n_nationkey"], pdf["n_name"], strict=True):
                raw = (name.encode(), ("订单" + name).encode(), b"\xef\xbb\xbf" + name.encode(), ("订单" + name).encode("gb18030"))[k % 4]
                found, choices = csv.detect_encoding(raw)
                out.append((k, found, ",".join(choices), csv.encoding(("cp936", "GB2312", "UTF8", "utf-8-bom")[k % 4])))
            yield pd.DataFrame(out, columns=["k", "encoding", "choices", "alias"])

    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").mapInPandas(judge, "k long, encoding string, choices string, alias string")


def _workbook(names: list[str], keys: list[int]) -> bytes:
    """A small workbook: a text, a day and a padded number per row, and a formula."""
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = "".join(f'<row r="{i}">{text(f"A{i}", n)}<c r="B{i}" s="1"><v>{45000 + k}</v></c><c r="C{i}" s="2"><v>{k}</v></c><c r="D{i}"><f>1+1</f><v>2</v></c></row>' for i, (n, k) in enumerate(zip(names, keys, strict=True), 2))
    head = "".join(text(f"{c}1", t) for c, t in zip("ABCD", ("name", "day", "code", "sum"), strict=True))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="H" sheetId="2" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="00000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData><row r=\"1\">{head}</row>{rows}</sheetData></worksheet>")
    return out.getvalue()


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workbook per region, of its nations."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_nationkey")
        return pd.DataFrame({"path": [str(key[0])], "content": [_workbook(pdf["n_name"].tolist(), pdf["n_nationkey"].tolist())]})

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(*(F.col(c).cast("long").alias(c) for c in ("n_nationkey", "n_regionkey")), "n_name")
    return n.groupBy("n_regionkey").applyInPandas(build, "path string, content binary")


def xlsx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, issues = xlsx.scan_files(_workbooks(spark, sf_dir))
    formulas = issues.agg(F.count(F.lit(1)).alias("formulas"))
    return rows.select("name", "day", "code", "sum").crossJoin(formulas)  # one row


def xlsx_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, n, v, xlsx.source_kind(f"{p}.xlsx", bytes(raw)[:4])) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for n, v in xlsx.sheets(bytes(raw))]
            yield pd.DataFrame(out, columns=["path", "sheet", "visible", "kind"])

    return _workbooks(spark, sf_dir).mapInPandas(names, "path string, sheet string, visible boolean, kind string")


def _contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = registered(spark, sf_dir)[0]
    return o.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ingest.CONTRACTS["orders"].schema.fields))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    store.write_jsonl(_contract_rows(spark, sf_dir), path)
    return store.read_jsonl(spark, path, "orders").select("order_id", "promised_delivery_time", "ordered_quantity", "carrier_id", K)


def dataset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets registered, one replaced, one deleted: the list, and what the first holds."""
    s, rows = store.Store(spark, new_path(spark, "store")), _contract_rows(spark, sf_dir)
    s.register("orders", "a", rows, "2024-01-01 00:00:00")
    s.register("orders", "b", rows.where(F.col(K) % 2 == 0), "2024-01-02 00:00:00")
    s.register("orders", "c", rows, "2024-01-03 00:00:00")
    s.register("orders", "a", rows.where(F.col(K) % 3 == 0), "2024-01-04 00:00:00")
    gone = s.delete("c")["orders"]
    held = s.load("orders", "a").agg(F.count(F.lit(1)).alias("loaded"), F.sum(K).cast("long").alias("places"))
    listed = s.control("orders").select("dataset_id", "n_rows", F.date_format("created_at", "yyyy-MM-dd").alias("created"))
    return listed.limit(2).crossJoin(held).withColumn("deleted", F.lit(gone).cast("long"))  # two rows, one row


def dataset_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders registered in a shuffled state: how many come back, and whether in the order of their places, within and over partitions."""
    s = store.Store(spark, new_path(spark, "ordered"))
    s.register("orders", "a", _contract_rows(spark, sf_dir).repartition(7, F.xxhash64(K)))
    rows = s.load("orders", "a").select(K, F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33))
    step = rows.withColumn("rises", F.coalesce(F.col(K) >= F.lag(K).over(Window.partitionBy("part").orderBy("at")), F.lit(True)))
    parts = step.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("rises").alias("rises"), F.min(K).alias("lo"), F.max(K).alias("hi"))
    # a row for each partition
    after = F.coalesce(F.col("lo") >= F.lag("hi").over(Window.orderBy("part")), F.lit(True))
    return parts.withColumn("after", after).agg(F.sum("n").alias("n"), F.min(F.col("rises") & F.col("after")).alias("ordered"))


def mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    del sf_dir
    found = ingest.suggest_mapping(list(HEADERS), ingest.CONTRACTS["orders"])
    return spark.createDataFrame([(h, f, round(s, 4), why) for h, (f, s, why) in found.items()], "header string, field string, confidence double, reason string")


def mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that the headers suggest, and the faults of a mapping."""
    del sf_dir
    types = [("type", t) for t, _ in ingest.detect_types(list(HEADERS))]
    faults = ingest.validate_mapping({"order_id": "order_id", "qty": "order_id", "zzz": "nothing"}, list(HEADERS), ingest.CONTRACTS["orders"], ("qty", "colour"))
    return spark.createDataFrame(types + [("fault", f) for f in faults], "kind string, what string")


def browser_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers whose values decide: profiles of a tracking file written from orders."""
    rows = _tracking_text(spark, sf_dir).drop("row_number")
    known = browser_mapping.collected(rows)
    found = browser_mapping.suggest(rows.columns, ingest.CONTRACTS["tracking_events"], known)
    types = browser_mapping.detect_type(rows.columns, ingest.CONTRACTS, known)
    ignored = browser_mapping.ignorable(found, {s.source: s.field for s in found if s.applied}, ingest.CONTRACTS["tracking_events"])
    out = [(s.source, s.field, s.level, s.source in ignored, types[0][0]) for s in found]
    return spark.createDataFrame(out, "header string, field string, level string, ignorable boolean, kind string")


def sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("备注"), F.col("source").alias("收件人电话"))
    kinds = [(c, k, scope) for scope, first in (("all", None), ("preview", 100)) for c, ks in ingest.sensitive_columns(docs, "doc_id", first).items() for k in ks]
    return spark.createDataFrame(kinds, "column string, kind string, scope string")


def _orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order text with a fault of every kind, by key."""
    k = F.col("o_orderkey")
    made = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy/M/d H:mm")
    return _orders(spark, sf_dir).select(
        k.cast("long").alias("row_number"), F.when(k % 31 == 0, "").when(k % 37 == 0, F.concat(F.lit("D-"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("ORD-"), k.cast("string"))).alias("订单号"),
        F.when(k % 17 == 0, "2024-02-30 10:00").otherwise(made).alias("下单时间"), F.when(k % 13 == 0, "1990-01-01 00:00").alias("承诺送达时间"),
        F.when(k % 19 == 0, "-1").when(k % 29 == 0, "1,23").when(k % 41 == 0, "true").otherwise("1,234.5").alias("qty"), F.when(k % 43 == 0, F.lit("u" * 33)).otherwise("piece").alias("unit"),
        F.when(k % 23 == 0, "???").when(k % 2 == 0, "已签收").otherwise("交易关闭").alias("订单状态"), F.when(k % 47 == 0, F.lit("x" * 5000)).otherwise("W１").alias("仓库"),
    )


def _tracking_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    hour = lambda h: F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=h), "yyyy-MM-dd HH:mm")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k % len(STATUSES) + 1).cast("int"))
    return _orders(spark, sf_dir).select(
        k.cast("long").alias("row_number"), F.concat(F.lit("SHP-"), (k / 4).cast("long").cast("string")).alias("运单号"), F.when(k % 19 == 0, None).otherwise(hour((k * 7) % 24)).alias("扫描时间"),
        status.alias("物流状态"), F.when(k % 3 == 0, "1").when(k % 5 == 0, "weather delay").when(k % 7 == 0, "none").alias("异常"), F.when(k % 11 == 0, "备").alias("备注"),
    )


#: Raw tracking texts of every tier.
STATUSES = ("已签收", "POD_OK at door", "in_transit", "ＰＩＣＫＵＰ　ＯＫ", "parcel  Collected", "nothing known", "退件完成", "到达中转站", "Custom Scan", "returned")
PROJECT = {"custom scan": "arrived_at_hub"}


def validated_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _orders_text(spark, sf_dir)
    found = ingest.suggest_mapping([c for c in text.columns if c != "row_number"], ingest.CONTRACTS["orders"])
    return ingest.validate(text, ingest.CONTRACTS["orders"], {h: f for h, (f, _, _) in found.items()}).issues.select("row_number", "field", "code", "severity")


def valid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _orders_text(spark, sf_dir)
    found = ingest.suggest_mapping([c for c in text.columns if c != "row_number"], ingest.CONTRACTS["orders"])
    v = ingest.validate(text, ingest.CONTRACTS["orders"], {h: f for h, (f, _, _) in found.items()})
    made = F.date_format("created_at", "yyyy-MM-dd HH:mm")
    return v.valid.select("order_id", made.alias("created"), "ordered_quantity", "order_status", "warehouse_id", K).withColumn("can_confirm", F.lit(v.can_confirm()))


TRACKING_MAP = {"运单号": "shipment_id", "扫描时间": "event_time", "物流状态": "raw_status", "异常": "exception_code"}


def _tracking(spark: SparkSession, sf_dir: str) -> ingest.Validation:
    return ingest.validate(_tracking_text(spark, sf_dir), ingest.CONTRACTS["tracking_events"], TRACKING_MAP, "UTC", PROJECT)


def tracking_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracking(spark, sf_dir).statuses
    return rows.select("raw", "code", "source", F.round("confidence", 2).alias("confidence"), "n")


def warehouse_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse rows whose keys repeat alike or with other values, and amounts without a unit."""
    k = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).select(
        k.cast("long").alias("row_number"), F.concat(F.lit("E-"), F.when(k % 10 == 3, k - 1).when(k % 10 == 5, k - 1).otherwise(k).cast("string")).alias("event_id"),
        F.lit("O").alias("order_id"), F.lit("2024-01-01 10:00").alias("event_time"), F.lit("拣货中").alias("raw_status"), F.when(k % 10 == 5, "W2").otherwise("W1").alias("warehouse_id"),
        F.when(k % 7 == 0, "3").when(k % 7 == 1, "-3").alias("quantity"), F.when(k % 7 == 1, "piece").when(k % 7 == 2, "box").alias("quantity_unit"),
    ).where("o_orderkey % 10 IN (2, 3, 4, 5, 6)")
    mapping = {c: c for c in rows.columns if c != "row_number"}
    return ingest.validate(rows, ingest.CONTRACTS["warehouse_events"], mapping).issues.select("row_number", "field", "code", "severity")


def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding, lookup keys, exception codes and generated ids of text made by key."""
    k = F.col("o_orderkey")
    raw = F.concat(F.lit(" Ａｂ　"), F.when(k % 3 == 0, "（１），").when(k % 3 == 1, "ﾄ①").otherwise("x  y"), (k % 9).cast("string"), F.lit(" "))
    ident = S.generated_event_id([F.concat(F.lit("S"), k.cast("string")), F.lit("t")], k.cast("long"), [F.when(k % 5 != 0, k.cast("string"))])
    code = S.exception_code(F.element_at(F.array(*map(F.lit, EXCEPTIONS)), (k % len(EXCEPTIONS) + 1).cast("int")))
    return _orders(spark, sf_dir).select("o_orderkey", S.parse_text(raw).alias("parsed"), S.lookup_text(raw).alias("lookup"), ident.alias("ident"), code.alias("exception"))


EXCEPTIONS = ("1", "none", "No Exception", "clear_sky", "addr  bad!", "正常", "N", "!!", "weather-delay", "okay")


def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-even rounding, closeness at a boundary, numbers from text, and shown values."""
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*map(F.lit, NUMBERS)), (k % len(NUMBERS) + 1).cast("int"))
    n = S.parse_number(text, integer=False)
    whole = S.parse_number(text, integer=True)["error"]
    near = S.close(F.lit(0.1), F.lit(0.1) + (k % 4) * F.lit(5e-13))
    return _orders(spark, sf_dir).select("o_orderkey", F.bround((k % 100) + F.lit(0.5)).cast("long").alias("rounded"), near.alias("near"), n["value"].alias("value"), n["error"].alias("error"), whole.alias("whole"))


NUMBERS = ("1,234", "12,34", "0.5", "１２", "true", "NaN", " 7 ", "1e3", "+3.", "-.5", "")


def wall_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall times around both changes of the clock, and times at query time, which need an offset."""
    k = F.col("o_orderkey")
    day = F.when(k % 2 == 0, "2024-03-10").otherwise("2024-11-03")
    naive = F.concat(day, F.format_string(" %02d:%02d:00", ((k / 2).cast("int") % 6).cast("int"), (k % 60).cast("int"))).cast("timestamp")
    zoned = S.parse_time(F.concat(day, F.lit("T10:30"), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+08:00").otherwise("")))
    p = S.attach_zone(naive, "America/New_York")
    return _orders(spark, sf_dir).select("o_orderkey", p["error"].alias("error"), F.date_format(p["value"], "yyyy-MM-dd HH:mm").alias("utc"), F.date_format(zoned, "yyyy-MM-dd HH:mm").alias("zoned"))


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems and shown values that reports use, for each nation."""
    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf["k"].tolist()
            stems = [report.export_stem(("a/b:", "con", " .x. ", "r?<>" + "long" * 30)[i % 4] + (n if i % 4 == 0 else "")) for i, n in zip(k, pdf["n"], strict=True)]
            yield pd.DataFrame({"k": k, "stem": stems, "ratio": [report.display(i / 8, "ratio") for i in k], "hours": [report.display(i / 4, "hour") for i in k]})

    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("n"))
    return rows.mapInPandas(name, "k long, stem string, ratio string, hours string")


def _streamed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream of the events folder gives once a last event has moved the watermark past the others, as a stored table."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    ts = F.col("ts").cast("timestamp").alias("event_ts")
    rows = stream.select(ts, F.col("event_type").alias("event_code"), F.col("user_id").cast("string").alias("shipment_id"), F.col("event_id").cast("string").alias("tracking_event_id"))
    last = stored(spark.sql("SELECT TIMESTAMP '2100-01-01' AS event_ts, 'end' AS event_code, 'end' AS shipment_id, 'end' AS tracking_event_id"), "last")
    rows = rows.unionByName(spark.readStream.schema(last.schema).parquet(last.inputFiles()[0].rsplit("/", 1)[0]))
    return run_stream(make(rows)).where("start < '2099-01-01'")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, lambda s: tracking.windowed_counts(tracking.deduplicated(s, "3650 days"), "1 day"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_code", "n")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, lambda s: tracking.sessions(s, "2 days", "3650 days"))
    return rows.select("shipment_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def queries() -> dict[str, Query]:
    return {
        "csv_round_trip": csv_round_trip, "csv_blocks": csv_blocks, "csv_ragged": csv_ragged, "csv_encodings": csv_encodings, "xlsx_rows": xlsx_rows, "xlsx_sheets": xlsx_sheets,
        "jsonl_round_trip": jsonl_round_trip, "dataset_store": dataset_store, "dataset_ordered": dataset_ordered, "mapping_suggestions": mapping_suggestions, "mapping_checks": mapping_checks,
        "browser_suggestions": browser_suggestions, "sensitive_columns": sensitive, "validated_order_rows": validated_order_rows, "valid_orders": valid_orders,
        "validated_tracking_rows": lambda s, d: _tracking(s, d).issues.select("row_number", "field", "code", "severity"),
        "tracking_statuses": tracking_statuses, "validated_warehouse_rows": warehouse_issues, "scalar_texts": scalar_texts, "scalar_numbers": scalar_numbers,
        "wall_times": wall_times, "export_names": export_names, "streamed_windows": streamed_windows, "streamed_sessions": streamed_sessions,
    }
