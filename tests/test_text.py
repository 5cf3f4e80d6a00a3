"""Folding of whole columns against Python's own."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from parcelight.functions import scalars as S
from parcelight.functions.text import unfolded
from parcelight.operators import ingest
from parcelight.sources import store


def test_forms_equal_python(spark):
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(1, 0x300), *range(0x1100, 0x1120), *range(0x2000, 0x2190), *range(0x3000, 0x3030), *range(0xF900, 0xF910), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFEF), 0x1D400, 0x1F600)]
    texts = [None, "", "ß", "ﬁ", "\t　", "é"] + ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, T string")
    marks = str.maketrans(S.CJK_MARKS, S.ASCII_MARKS)
    for r in unfolded(df, {"a": ("T", "text"), "b": ("T", "lookup")}).collect():
        t = r["T"]
        assert r["a"] == (None if t is None else unicodedata.normalize("NFKC", t).strip())
        assert r["b"] == (None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).translate(marks)).strip().casefold())
    blank = {r["i"]: r["e"] for r in df.select("i", S.is_empty("T").alias("e")).collect()}
    assert all(e == (texts[i] is None or not texts[i].strip()) for i, e in blank.items())


def test_blank_cells_are_missing_and_ids_fold(spark):
    rows = [(2, "　", "2024-01-02 03:04", "1"), (3, "Ｏ１", "2024-01-02 03:04", "\t"), (4, "O1 ", "2024-01-02 03:04", "1"), (5, "O1", "2024-01-02 03:04", "1"), (6, "O2", "2024-01-02 03:04", "1,23")]
    df = spark.createDataFrame(rows, "row_number long, id string, at string, qty string").withColumns({"unit": F.lit("ﬁ"), "state": F.lit(" 已签收　")})
    mapping = {"id": "order_id", "at": "created_at", "qty": "ordered_quantity", "unit": "quantity_unit", "state": "raw_order_status"}
    v = ingest.validate(df, ingest.CONTRACTS["orders"], mapping)
    got = sorted((r["row_number"], r["field"], r["code"]) for r in v.issues.collect())
    assert got == [
        (2, "order_id", "REQUIRED_VALUE_MISSING"), (3, "order_id", "DUPLICATE_KEY_CONFLICT"), (3, "ordered_quantity", "REQUIRED_VALUE_MISSING"),
        (4, "order_id", "DUPLICATE_KEY_CONFLICT"), (5, "order_id", "DUPLICATE_KEY_CONFLICT"), (6, "ordered_quantity", "AMBIGUOUS_NUMBER_FORMAT"),
    ]
    assert v.valid.isEmpty() and {(r["code"], r["n"]) for r in v.statuses.collect()} == {("delivered", 5)}
    assert {r["field"]: r["nulls"] for r in v.nulls.collect()}["ordered_quantity"] == 1
    assert ("order_status", None, "derived") in ingest.resolutions(ingest.CONTRACTS["orders"], mapping)


def test_stored_status_words(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    assert s.status_mappings("orders") == {}
    s.save_status_mappings("orders", {"done": "delivered", "x": "created"})
    s.save_status_mappings("tracking_events", {"done": "exception"})
    s.save_status_mappings("orders", {"x": "shipped"})
    assert s.status_mappings("orders") == {"done": "delivered", "x": "shipped"} and s.status_mappings("tracking_events") == {"done": "exception"}
    with pytest.raises(ValueError, match="no status"):
        s.save_status_mappings("orders", {"y": "in_transit"})
