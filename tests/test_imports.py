"""Scalars, mapping, validation and sources."""

import csv as pycsv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from parcelight.functions import scalars as S
from parcelight.operators import ingest, report
from parcelight.sources import csv, store, xlsx


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_and_text(spark):
    got = one(spark, S.parse_number, "1,234.5", "12,34", "１２", "true", "NaN", "", None, "-3", "1e3")
    assert [(r["value"], r["error"]) for r in got] == [(1234.5, None), (None, "AMBIGUOUS_NUMBER_FORMAT"), (12.0, None), (None, "UNPARSEABLE_NUMBER"), (None, "UNPARSEABLE_NUMBER"), (None, None), (None, None), (-3.0, None), (1000.0, None)]
    assert one(spark, S.escape_cell, "=a", " -1", "ok", None) == ["'=a", "' -1", "ok", None]
    assert one(spark, S.mask_identifier, "ORD-1234", "abc") == ["***1234", "***c"]
    assert one(spark, S.exception_code, "1", "none", "addr bad!", None) == ["GENERIC_EXCEPTION", None, "ADDR_BAD", None]


def test_fnv(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    words = ["", "a", "A中b", "x" * 50]
    assert one(spark, S.fnv1a, *words) == [fnv(w) for w in words]


def test_times(spark):
    text = ["2024-01-02T03:04:05Z", "2024-01-02T03:04+08:00", "2024-01-02 03:04", "2024/1/2 3:04", "1/2/2024 3:04 PM", "2024年1月2日 3:04", "Tue Jan 02 2024 03:04:05 GMT+0800", "2024-02-30 03:04", "", None]
    got = one(spark, lambda c: F.struct(F.date_format(S.parse_datetime(c)["value"], "yyyy-MM-dd HH:mm:ss").alias("t"), S.parse_datetime(c)["error"].alias("e")), *text)
    assert [r["t"] for r in got] == ["2024-01-02 03:04:05", "2024-01-01 19:04:00", "2024-01-01 19:04:00", "2024-01-01 19:04:00", "2024-01-02 07:04:00", "2024-01-01 19:04:00", "2024-01-01 19:04:05", None, None, None]
    assert [r["e"] for r in got][-3:] == ["INVALID_TIME", None, None]
    zone = one(spark, lambda c: S.parse_datetime(c, "America/New_York")["error"], "2024-03-10 02:30", "2024-11-03 01:30", "2024-07-01 12:00")
    assert zone == ["NONEXISTENT_LOCAL_TIME", "AMBIGUOUS_LOCAL_TIME", None]
    assert one(spark, S.parse_time, "2024-01-02T03:04:05") == [None]


def test_mapping():
    c = ingest.CONTRACTS["orders"]
    m = ingest.suggest_mapping(["order_id", "Created At", "qty", "单位", "订单状态", "whatever"], c)
    assert {h: f for h, (f, _, _) in m.items()} == {"order_id": "order_id", "Created At": "created_at", "qty": "ordered_quantity", "单位": "quantity_unit", "订单状态": "raw_order_status"}
    assert ingest.detect_types(["shipment_id", "event_time", "raw_status"])[0][0] == "tracking_events"
    assert ingest.validate_mapping({"a": "order_id", "b": "order_id"}, ["a", "b", "c"], c)[:2] == ["UNRESOLVED:c", "DUPLICATE_TARGET:order_id"]


def test_validation(spark):
    rows = [(2, "S1", "2024-01-02 03:04", "已签收"), (3, "S1", "2024-01-02 02:04", "pod_ok now"), (4, "S2", "", "运输中"), (5, "S3", "2024-01-02 03:04", "zzz"), (6, "S1", "2024-01-02 03:04", "已签收")]
    df = spark.createDataFrame(rows, "row_number long, `运单号` string, `时间` string, `状态` string")
    v = ingest.validate(df, ingest.CONTRACTS["tracking_events"], {"运单号": "shipment_id", "时间": "event_time", "状态": "raw_status"}, keywords=[("delivered", ("pod_ok",), 0.96)])
    good = {r["source_index"]: (r["event_code"], r["tracking_event_id"][:14]) for r in v.valid.collect()}
    assert good == {2: ("delivered", "TRE-GEN-000002"), 3: ("delivered", "TRE-GEN-000003"), 5: ("unmapped", "TRE-GEN-000005"), 6: ("delivered", "TRE-GEN-000006")}
    codes = {(r["row_number"], r["code"]) for r in v.issues.collect()}
    assert {(4, "REQUIRED_VALUE_MISSING"), (5, "UNKNOWN_STATUS"), (3, "TIME_ORDER_CONFLICT"), (None, "GENERATED_TRACKING_EVENT_ID")} <= codes


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id;name\r\n1;"a\nb"\r\n\r\n2\r\n3;c;d\r\n'.encode())
    rows, issues = csv.scan(spark, str(p))
    assert [tuple(r) for r in rows.orderBy("row_number").collect()] == [(2, "1", "a\nb"), (4, "2", ""), (5, "3", "c")]
    assert sorted(r["row_number"] for r in issues.collect()) == [4, 5]
    g = tmp_path / "g.csv"
    g.write_bytes("订单号,状态\n1,已签收\n".encode("gb18030"))
    with pytest.raises(ValueError, match="ENCODING_REQUIRED"):
        csv.scan(spark, str(g))
    assert csv.scan(spark, str(g), "cp936").rows.first()["状态"] == "已签收"
    assert csv.export_bytes(rows.select("id").orderBy("row_number").limit(1)) == "﻿id\r\n1\r\n".encode()


def test_csv_checks_every_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,name\n1,a\n")
    (tmp_path / "2.csv").write_text("name,id\nb,2\n")
    (tmp_path / "3.csv").write_text("other,id\nc,3\n")
    rows, issues = csv.scan(spark, str(tmp_path))
    assert sorted((r["id"], r["name"]) for r in rows.collect()) == [("1", "a"), ("2", "b")]
    assert [(r["row_number"] - 2 * csv.PER_FILE, r["code"], r["file"].rsplit("/", 1)[-1], r["line"]) for r in issues.collect()] == [(1, "HEADER_MISMATCH", "3.csv", 1)]


@pytest.mark.parametrize("block", [60, 300, 100_000])
def test_csv_in_blocks_equals_one_read(spark, tmp_path, block):
    rng = random.Random(block)
    cell = lambda: "".join(rng.choices(['a', 'é', '""', "b;c", "\n", "\r\n", ",", " ", "状", '"'], k=rng.randint(0, 9)))

    def quoted(c):
        c = c.replace('"', '""')
        return f'"{c}"' if any(x in c for x in ',\n\r"') or rng.random() < 0.3 else c

    want = []
    for f in range(3):
        body = ["id,text,more"]
        for i in range(rng.randint(20, 60)):
            # a quote within a bare cell is an ordinary character; some rows are short, long or blank
            body.append(rng.choice([f"{i},{quoted(cell())},{quoted(cell())}", f"{i},{quoted(cell())}", f"{i},in\"side,5\" wide", "", f"{i},a,b,c", f'{i},"x"tail,z', f"{i},a,b\r{i},c,{quoted(cell())}"]))
        text = rng.choice(["\n", "\r\n"]).join(body) + rng.choice(["", "\n"])
        (tmp_path / f"{f}.csv").write_bytes(text.encode())
        for n, row in enumerate(pycsv.reader(io.StringIO(text, newline="")), 1):
            if n > 1 and any(c.strip() for c in row):
                want.append((f, n, *(row + [""] * 3)[:3], len(row) != 3))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = csv.scan(spark, str(tmp_path))
        blocks = got.rows.select("row_number").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wrong = {(r["file"][-5:-4], r["line"]) for r in got.issues.collect()}
    rows = got.located(got.rows).collect()
    assert blocks == len(rows) == len({r["row_number"] for r in rows})
    assert sorted((int(r["file"][-5]), r["line"], r["id"], r["text"], r["more"], (r["file"][-5:-4], r["line"]) in wrong) for r in rows) == sorted(want)


def test_csv_states_of_a_line():
    assert csv.after('a,"b', False, ",") == (True, 0, 0) and csv.after('b",c', True, ",") == (False, 0, 0)
    assert csv.after('a"b,c', False, ",") == (False, 0, 0) and csv.after('"a""b"', False, ",") == (False, 0, 0)
    assert csv.after('x\r"y', False, ",") == (True, 1, 2) and csv.after("x\r", False, ",") == (False, 0, 0) and csv.after('""', True, ",") == (True, 0, 0)


def workbook(sheet, extra=()):
    raw = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="00000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
        for name in extra:
            z.writestr(name, "x")
    return raw.getvalue()


def test_xlsx():
    text = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    raw = workbook(f'<row r="1">{text("A1", "id")}{text("B1", "day")}{text("C1", "n")}</row><row r="2"><c r="A2" s="2"><v>42</v></c><c r="B2" s="1"><v>45293.5</v></c><c r="C2"><f>1+1</f><v>2</v></c></row>')
    headers, rows, issues = xlsx.read(raw)
    assert headers == ["id", "day", "n"] and rows == [(2, ["00042", "2024-01-02 12:00:00", None])] and issues == [(2, "FORMULA_CELL")]
    for bad, why in ((workbook("", ["xl/vbaProject.bin"]), "MACROS"), (workbook("", ["../x"]), "PATH_TRAVERSAL"), (b"hello", "NOT_A_WORKBOOK")):
        with pytest.raises(ValueError, match=why):
            xlsx.check(bad)


def test_xlsx_reads_every_workbook(spark):
    text = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    books = [workbook(f'<row r="1">{text("A1", "id")}{text("B1", "n")}</row><row r="2">{text("A2", f"{i}")}{text("B2", "x")}</row>') for i in range(3)]
    files = [(f"{i}", b) for i, b in enumerate(books)] + [("9", workbook("", ["xl/vbaProject.bin"]))]
    rows, issues = xlsx.scan_files(spark.createDataFrame(files, "path string, content binary"))
    assert sorted(r["id"] for r in rows.collect()) == ["0", "1", "2"] and [r["code"] for r in issues.collect()] == ["MACROS"]
    assert xlsx.source_kind("a.XLSX", b"PK") == "xlsx"
    for name, head, media in (("a.exe", b"", None), ("a.csv", b"PK", None), ("a.csv", b"x", "image/png"), ("a.xlsx", b"hello", None)):
        with pytest.raises(ValueError):
            xlsx.source_kind(name, head, media)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(None,) * 13 + (i,) for i in range(3)], ingest.CONTRACTS["orders"].schema)
    s.register("orders", "a", rows)
    s.register("orders", "b", rows)
    s.register("orders", "a", rows.limit(1))
    assert {r["dataset_id"]: r["n"] for r in s.list("orders").collect()} == {"a": 1, "b": 3}
    s.bind("a", "scenario", spark.range(2))
    s.bind("b", "scenario", spark.range(2))
    assert s.delete("a") == {"orders": 1, "warehouse_events": 0, "tracking_events": 0, "bound": 1}
    assert [r["dataset_id"] for r in s.list("orders").collect()] == ["b"] and s.load("orders", "b").count() == 3


def test_report(spark):
    df = spark.createDataFrame([("a|b", 0.5)], "name string, value double")
    assert "a\\|b" in report.markdown("t", [("s", df)]) and "<td>a|b</td>" in report.html_document("t", [("s", df)])
    assert report.export_stem("con") == "report" and report.export_stem("a/b:c") == "a_b_c"


def test_documents_have_charts_and_mark_what_they_leave_out(spark):
    weeks = [(f"2026-{i // 28 + 1:02d}-{i % 28 + 1:02d}", c, None if i == 7 else i / 60) for i in range(60) for c in ("ot_rate", "if_rate")]
    trend = spark.createDataFrame(weeks, "group_key string, code string, value double").orderBy("group_key", "code")
    groups = spark.createDataFrame([(f"<C{i}>", "otif_rate", i / 20) for i in range(20)], "group_key string, code string, value double").orderBy("value")
    sections = [("trend", trend), ("breakdown", groups), ("empty", groups.limit(0)), ("distribution", spark.createDataFrame([], "bin int, lower double, upper double, n long"))]
    doc = report.html_document("t", sections, most=50)
    assert doc.count("<svg") == 3 and doc.count("<polyline") == 4 and "The first 50 of 120 rows." in doc and "the first 12 of 20" in doc
    assert "&lt;C0&gt;" in doc and "<C0>" not in doc and doc.count("The first") == 1
    text = report.markdown("t", sections, most=50)
    assert text.count("The first 50 of 120 rows.") == 1 and "<svg" not in text
    few = report.tables(sections[:1], most=50, most_charted=60)[0]
    assert (few.total, len(few.rows), few.chart) == (120, 50, "")
