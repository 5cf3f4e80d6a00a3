"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import UNKNOWN
from .zones import shifted

# characters of the basic plane that compatibility normalisation (NFKC) folds to one other: full-width and half-width forms,
# circled and raised digits, compatibility ideographs, wide spaces; those that unfold to several are not covered
_FOLDED = [c for c in map(chr, range(0x80, 0xFFFE)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFKC", c) != c and len(unicodedata.normalize("NFKC", c)) == 1]
_WIDE = "".join(_FOLDED)
_NARROW = "".join(unicodedata.normalize("NFKC", c) for c in _FOLDED)
CJK_MARKS, ASCII_MARKS = "，。：；（）【】、", ",.:;()[],"
#: All white space, that of other scripts and the separators of ASCII too.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col(c), F.lit(WHITE))


def parse_text(c: Column | str) -> Column:
    """Folded, then stripped, within the JVM: what unfolds to several characters stays (:func:`.text.unfolded` covers all)."""
    return stripped(F.translate(col(c), _WIDE, _NARROW))


def is_empty(c: Column | str) -> Column:
    """Null or white space alone; a text that begins with a visible character of ASCII is not looked at further."""
    return col(c).isNull() | (~F.ascii(col(c)).between(33, 126) & (stripped(c) == ""))


def dimension(c: Column | str) -> Column:
    """A missing or blank dimension counts as ``unknown``."""
    return F.when(is_empty(c), UNKNOWN).otherwise(stripped(c))


def parse_number(c: Column | str, integer: bool = False, parsed: bool = False) -> Column:
    """struct(value double, error string): commas only as thousands separators; no NaN or infinity.  ``parsed``: the text is
    folded and stripped already."""
    t = col(c) if parsed else parse_text(c)
    plain = F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(t, ",", "")).otherwise(t)
    v = F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    bad = F.when(F.contains(plain, F.lit(",")), "AMBIGUOUS_NUMBER_FORMAT").when(v.isNull() | (F.abs(v) == float("inf")), "UNPARSEABLE_NUMBER")
    if integer:
        bad = bad.when(v != F.floor(v), "UNPARSEABLE_INTEGER")
    error = F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).otherwise(bad)
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def finite(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), col(c))


def ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def parse_time(c: Column | str) -> Column:
    """ISO text with an offset to an instant; text without an offset is null."""
    c = stripped(c)
    seconds = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2")
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), seconds.try_cast("timestamp"))


#: Formats without a zone, in the order in which they are tried.
NAIVE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy.M.d H:mm", "yyyy年M月d日 H:mm",
    "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "d-M-yyyy H:mm", "yyyyMMddHHmmss", "yyyy-MM-dd", "yyyy/M/d", "yyyy年M月d日", "M/d/yyyy",
)


def attach_zone(naive: Column, zone: str) -> Column:
    """struct(value timestamp, error): wall time in a zone; a gap or an overlap of the clock is an error.

    ``naive`` is a timestamp read as if it were UTC.
    """
    value, found = F.to_utc_timestamp(naive, zone), shifted(naive, zone)
    error = F.when(found["gap"], "NONEXISTENT_LOCAL_TIME").when(found["twice"], "AMBIGUOUS_LOCAL_TIME")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def parse_datetime(c: Column | str, zone: str = "Asia/Shanghai", parsed: bool = False) -> Column:
    """struct(value, error) of import text: ISO with offset, ``GMT+hhmm`` text, then the naive formats in ``zone``.  ``parsed``: the
    text is folded and stripped already."""
    t = col(c) if parsed else parse_text(c)
    js = F.regexp_extract(t, r"^\w{3} (\w{3} \d{2} \d{4} \d{2}:\d{2}:\d{2}) GMT([+-]\d{4})", 0)
    js_time = F.when(js != "", F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(t, r"^\w{3} (\w{3} \d{2} \d{4} \d{2}:\d{2}:\d{2})", 1), F.regexp_extract(t, r"GMT([+-]\d{4})", 1)), F.lit("MMM dd yyyy HH:mm:ss Z")))
    fixed = F.coalesce(js_time, parse_time(t))
    naive = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in NAIVE_FORMATS))
    local = attach_zone(naive, zone)
    error = F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).when(fixed.isNull() & naive.isNull(), "INVALID_TIME").when(fixed.isNull(), local["error"])
    return F.struct(F.coalesce(fixed, local["value"]).alias("value"), error.alias("error"))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(3.6e9)


def local_date(ts: Column | str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def week_start(ts: Column | str, zone: str) -> Column:
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(col(ts), zone)))


_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def weekday_label(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, _DAYS)), F.weekday(d))


def six_hour_bucket(ts: Column) -> Column:
    h = (F.floor(F.hour(ts) / 6) * 6).cast("int")
    return F.format_string("%02d:00–%02d:00", h, h + 6)


def lookup_text(c: Column | str) -> Column:
    """Text as a lookup key: full-width and CJK marks to ASCII, white space collapsed, lower case."""
    t = F.translate(parse_text(c), CJK_MARKS, ASCII_MARKS)
    return F.lower(F.trim(F.regexp_replace(t, r"[\s\p{Z}]+", " ")))


def escape_cell(c: Column | str) -> Column:
    """Guard a CSV cell that a spreadsheet would read as a formula (negative numbers as well)."""
    s = col(c).cast("string")
    return F.when(F.ltrim(s).rlike("^[=+@-]"), F.concat(F.lit("'"), s)).otherwise(s)


def mask_identifier(c: Column | str) -> Column:
    s = col(c).cast("string")
    return F.concat(F.lit("***"), F.when(F.length(s) < 4, F.right(s, F.lit(1))).otherwise(F.right(s, F.lit(4))))


def variant_hash(codes: Column) -> Column:
    return F.concat(F.lit("V-"), F.upper(F.substring(F.sha2(F.concat_ws("|", codes), 256), 1, 8)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-8 bytes."""
    data = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(data, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    mixed = F.aggregate(F.sequence(F.lit(1), (F.length(data) / 2).cast("int")), F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.length(data) == 0, F.lit(2166136261).cast("long")).otherwise(mixed)


def generated_event_id(fields: list[Column], row_number: Column, required: list[Column]) -> Column:
    """An id for a tracking row that has none; null if what it needs is missing."""
    h = fnv1a(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in [*fields, row_number])))
    missing = required[0].isNull()
    for r in required:
        missing = missing | is_empty(r)
    return F.when(~missing, F.concat(F.format_string("TRE-GEN-%06d-", row_number), F.lpad(F.hex(h), 8, "0")))


# Texts that say that there is no exception, and the codes that are known.
NO_EXCEPTION = ("", "0", "n", "正常", "无", "-", "常规")
NO_EXCEPTION_PATTERN = r"(?i)^(none|clear|stable|low|zero|normal|ok|no[_\s-]*exception)([_-][a-z0-9]+)*$"
KNOWN_EXCEPTIONS = ("WEATHER_DELAY", "CALL_FAIL", "ADDR_UNCLEAR", "CANCELLED", "RETURNING", "RETURN_DONE")


def exception_code(c: Column | str) -> Column:
    """Texts of no exception to null, ``1`` and texts without a letter or digit to GENERIC_EXCEPTION, others to UPPER_SNAKE."""
    t = parse_text(c)
    snake = F.regexp_replace(F.regexp_replace(F.upper(t), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    none = is_empty(c) | F.lower(t).isin(*NO_EXCEPTION) | t.rlike(NO_EXCEPTION_PATTERN)
    return F.when(none, F.lit(None)).when((t == "1") | (snake == ""), "GENERIC_EXCEPTION").otherwise(snake)


def unknown_exception(c: Column | str) -> Column:
    """Whether a code stands that none of the known ones is."""
    code = exception_code(c)
    return code.isNotNull() & ~code.isin(*KNOWN_EXCEPTIONS)


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
