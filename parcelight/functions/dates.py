"""Dates of one file: the order of day and month is decided over the whole file, never row by row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import attach_zone, parse_datetime, parse_text

# English month names by number, and the shapes of date text.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_CLOCK = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+\d{1,2}:\d{2}(?::\d{2})?\s*([AaPp][Mm])?)?$"
YEAR_FIRST = r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _CLOCK + "$"
NAMED_MONTH = r"^(?:[A-Za-z]{3}\s+)?(\d{1,2})[-\s]([A-Za-z]{3})[-\s](\d{4})" + _CLOCK + "$"
NUMERIC = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?)?$"
OFFSET = r"(?i)(Z|[+-]\d{2}:?\d{2})(?:\s+\([^)]*\))?$"


@dataclass(frozen=True)
class DateOrder:
    order: str | None
    ambiguous: bool
    dmy: int
    mdy: int
    undecided: int


def date_order_evidence(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Per file (``keys``): values that only DMY explains, only MDY explains (AM and PM as well), either explains; the order, and whether to ask.

    One aggregation over all rows.  Both kinds together, or undecided values alone, are ambiguous and have no order;
    a file without such dates has no order and is not ambiguous.  Day = month and other formats say nothing.
    """
    t = parse_text(df[column])
    a, b = (F.regexp_extract(t, SLASHED, i).try_cast("int") for i in (1, 2))
    seen = t.rlike(SLASHED) & (a != b)
    first, second = (a > 12) & (b <= 12), (b > 12) & (a <= 12)
    meridiem = F.regexp_extract(t, SLASHED, 4) != ""
    kind = F.when(seen & first, "dmy").when(seen & (second | meridiem), "mdy").when(seen, "undecided")
    g = df.groupBy(*(keys or [])).agg(*(F.count_if(F.coalesce(kind == k, F.lit(False))).alias(k) for k in ("dmy", "mdy", "undecided")))
    dmy, mdy = F.col("dmy") > 0, F.col("mdy") > 0
    order = F.when(dmy & ~mdy, "DMY").when(mdy & ~dmy, "MDY")
    return g.withColumn("date_order", order).withColumn("ambiguous", (dmy & mdy) | (~dmy & ~mdy & (F.col("undecided") > 0)))


def infer_date_order(df: DataFrame, column: str) -> DateOrder:
    r = date_order_evidence(df, column).first()
    return DateOrder(r["date_order"], r["ambiguous"], r["dmy"], r["mdy"], r["undecided"])


def with_import_dates(df: DataFrame, column: str, zone: str, order: str | None = None, order_column: str | None = None, out: str = "parsed") -> DataFrame:
    """``df`` and a column ``out``: struct(value timestamp, day date, precision, error) of each text.

    Text with an offset is an instant.  A date without a clock stays a date (``day``, no ``value``).  Day and month are told
    apart by their size, by AM / PM (month first), by a hyphen (day first), else by the file's order (``order``, or a column
    where rows of several files meet); without one the error is DATE_ORDER_REQUIRED.  Blank text has neither value nor
    error; dates that no calendar has are INVALID_DATETIME.  Each step is a column of its own, so that no step is repeated.
    """
    c = lambda n: F.col(f"{out}__{n}")
    add = lambda d, **v: d.withColumns({f"{out}__{n}": e for n, e in v.items()})
    get = lambda n, p, i: F.regexp_extract(c(n), p, i)
    held = F.col(order_column) if order_column else F.lit(order).cast("string")
    t = F.trim(F.regexp_replace(parse_text(df[column]), r"\s+", " "))
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(c("t"), r"^(\d{4})[年/.](\d{1,2})[月/.]", "$1-$2-"), r"^(\d{4}-\d{1,2}-\d{1,2})日", "$1 "), r"\s+", " ")
    rows = add(add(df, t=t), y=F.trim(marks), e=F.trim(F.regexp_replace(F.regexp_replace(c("t"), ",", " "), r"\s+", " ")))
    shape = F.when(c("y").rlike(YEAR_FIRST), "year").when(c("e").rlike(NAMED_MONTH), "name").when(c("t").rlike(NUMERIC), "number").when(c("t").rlike(OFFSET), "offset")
    # groups of one shape: year, month, day, hour, minute, second; or first, second number with their mark and half of the day
    pick = lambda y, n, d: F.when(c("shape") == "year", get("y", YEAR_FIRST, y)).when(c("shape") == "name", get("e", NAMED_MONTH, n)).when(c("shape") == "number", get("t", NUMERIC, d))
    rows = add(add(rows, shape=shape), year=pick(1, 3, 4), a=pick(2, 2, 1), b=pick(3, 1, 3), hour=pick(4, 4, 5), minute=pick(5, 5, 6), second=pick(6, 6, 7), mark=get("t", NUMERIC, 2), half=F.upper(get("t", NUMERIC, 8)))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(c("a"))), F.lit(0)).cast("int")
    rows = add(rows, a=F.when(c("shape") == "name", month).otherwise(c("a").try_cast("int")), b=c("b").try_cast("int"))
    first = F.when(c("a") == c("b"), "DMY").when((c("a") > 12) & (c("b") <= 12), "DMY").when((c("b") > 12) & (c("a") <= 12), "MDY").when(c("half") != "", "MDY").when(c("mark") == "-", "DMY").otherwise(held)
    rows = add(rows, order=F.when(c("shape") == "number", first).otherwise("MDY"))
    hour = F.coalesce(c("hour").try_cast("int"), F.lit(0))
    hour = F.when(c("half") != "", hour % 12 + F.when(c("half") == "PM", 12).otherwise(0)).otherwise(hour)
    number = lambda n: F.coalesce(c(n).try_cast("int"), F.lit(0))
    rows = add(rows, date=F.format_string("%s-%02d-%02d", c("year"), F.when(c("order") == "DMY", c("b")).otherwise(c("a")), F.when(c("order") == "DMY", c("a")).otherwise(c("b"))), clock=F.format_string("T%02d:%02d:%02dZ", hour, number("minute"), number("second")))
    rows = add(rows, day=c("date").try_cast("date"), naive=F.concat(c("date"), c("clock")).try_cast("timestamp"))
    offset = c("shape") == "offset"
    rows = add(rows, local=attach_zone(c("naive"), zone), fixed=parse_datetime(F.when(offset, c("t")), zone))
    dated, blank = c("hour") == "", F.coalesce(c("t"), F.lit("")) == ""
    error = (
        F.when(blank, F.lit(None).cast("string")).when(offset, c("fixed")["error"]).when(c("shape").isNull(), "INVALID_DATETIME").when(c("order").isNull(), "DATE_ORDER_REQUIRED")
        .when(c("day").isNull() | c("naive").isNull(), "INVALID_DATETIME").when(~dated, c("local")["error"])
    )
    rows = add(rows, error=error)
    fine = c("error").isNull() & ~blank
    precision = F.when(offset, F.when(c("t").rlike(r"\d{2}:\d{2}:\d{2}"), "second").otherwise("minute")).when(dated, "date").when(c("second") == "", "minute").otherwise("second")
    value = F.when(fine & offset, c("fixed")["value"]).when(fine & ~dated, c("local")["value"])
    return rows.select(*(F.col(f"`{n}`") for n in df.columns), F.struct(value.alias("value"), F.when(fine & ~offset & dated, c("day")).alias("day"), F.when(fine, precision).alias("precision"), c("error").alias("error")).alias(out))
