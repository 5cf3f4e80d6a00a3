"""Clock changes of a zone, as a table that expressions look wall times up in."""

from __future__ import annotations

import datetime as dt
import json
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = 1900, 2100
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
_STEP = 12 * 3600
_TABLE = "array<array<struct<start:bigint,stop:bigint,gap:boolean>>>"


@lru_cache
def transitions(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(second since 1970, offset before, offset after) of each change of the zone's offset in the years covered, in order: the
    time line is walked in half days, and a change within one is found by bisection."""
    z = ZoneInfo(zone)
    offset = lambda s: int((_EPOCH + dt.timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    at = int((dt.datetime(FIRST, 1, 1, tzinfo=dt.UTC) - _EPOCH).total_seconds())
    end = int((dt.datetime(LAST, 1, 1, tzinfo=dt.UTC) - _EPOCH).total_seconds())
    out, before = [], offset(at)
    while at < end:
        after = offset(at + _STEP)
        if after != before:
            lo, hi = at, at + _STEP
            while hi - lo > 1:
                middle = (lo + hi) // 2
                lo, hi = (middle, hi) if offset(middle) == before else (lo, middle)
            out.append((hi, before, after))
        at, before = at + _STEP, after
    return tuple(out)


@lru_cache
def _by_year(zone: str) -> str:
    """For each year from FIRST the stretches of wall time, in microseconds as if UTC, that are skipped (gap) or shown twice."""
    years: list[list[dict]] = [[] for _ in range(FIRST, LAST)]
    for at, before, after in transitions(zone):
        lo, hi = at + min(before, after), at + max(before, after)
        year = lambda s: (_EPOCH + dt.timedelta(seconds=s)).year - FIRST
        for y in range(max(0, year(lo)), min(len(years) - 1, year(hi - 1)) + 1):
            years[y].append({"start": lo * 1_000_000, "stop": hi * 1_000_000, "gap": after > before})
    return json.dumps(years)


def shifted(naive: Column, zone: str) -> Column:
    """struct(gap, twice): whether the clock of ``zone`` skips a wall time, or shows it twice.  ``naive`` is read as if it were UTC.

    The table is a constant; a row reads the few changes of its own year.
    """
    table = F.from_json(F.lit(_by_year(zone)), _TABLE)
    own, us = F.get(table, F.year(naive) - FIRST), F.unix_micros(naive)
    within = lambda gap: F.coalesce(F.exists(own, lambda x: (x["gap"] == gap) & (us >= x["start"]) & (us < x["stop"])), F.lit(False))
    return F.struct(within(F.lit(True)).alias("gap"), within(F.lit(False)).alias("twice"))
