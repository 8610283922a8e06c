"""Time slots: requested ranges, slot grids anchored at the epoch, and the slots an acquisition belongs to. Times are epoch seconds."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, date, datetime
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UNITS = {"D": 86400, "h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1, "W": 7 * 86400}


def seconds_of(frequency: str) -> int:
    """Seconds of a fixed frequency such as 7D, 12h or 2W (a week is 7 days); ValueError for others."""
    found = re.fullmatch(r"(\d*)([A-Za-z]+)", frequency.strip())
    if not found or found[2] not in _UNITS or found[1] == "0":
        raise ValueError(f"not a fixed frequency: {frequency}")
    return int(found[1] or 1) * _UNITS[found[2]]


def _point(text: str, end: bool) -> int:
    text = text.strip()
    if found := re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", text):
        year, month, day = int(found[1]), found[2], found[3]
        if end:
            last_month = int(month or 12)
            last = date(year, last_month, int(day or calendar.monthrange(year, last_month)[1]))
            return int(datetime(last.year, last.month, last.day, tzinfo=UTC).timestamp()) + 86399
        return int(datetime(year, int(month or 1), int(day or 1), tzinfo=UTC).timestamp())
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int((moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp())


def requested(text: str | datetime) -> tuple[int, int]:
    """First and last second of "start/end" or of one date or moment; a partial date covers its day, month or year."""
    if isinstance(text, datetime):
        text = text.isoformat()
    first, slash, last = text.partition("/")
    start, end = _point(first, False), _point(last if slash else first, True)
    if end < start:
        raise ValueError(f"the range ends before it starts: {text}")
    return start, end


def rounded(second: int, step: int) -> int:
    """The nearest multiple of step, the even one of two."""
    return round(Fraction(second, step)) * step


def rounded_column(second: Column, step: int) -> Column:
    return (F.rint(second / F.lit(step)) * F.lit(step)).cast("long")


def slots(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """slot of every step from the rounded start to the rounded end, latest first."""
    first = rounded(start, step)
    last = max(end, first)
    return spark.range(first, last + 1, step).select(F.col("id").alias("slot")).orderBy(F.desc("slot"))


def slot_array(second: Column, step: int) -> Column:
    """Multiples of step within half a step of the moment, both ends included: one, or two on a midpoint."""
    half = step / 2
    return F.transform(F.sequence(F.ceil((second - half) / step), F.floor((second + half) / step)), lambda k: k * step)


def assigned(items: DataFrame, second: str, step: int, slot: str = "slot") -> DataFrame:
    """A row for each slot an item belongs to; an equality key instead of an interval join."""
    return items.withColumn(slot, F.explode(slot_array(F.col(second), step)))


def indexed(times: DataFrame, column: str) -> DataFrame:
    """Distinct times with their index, latest first; a time axis is short."""
    return times.select(column).distinct().withColumn("time_idx", (F.row_number().over(Window.orderBy(F.desc(column))) - 1).cast("int"))


