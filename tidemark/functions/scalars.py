"""Small column expressions: guarded arithmetic, clocks, bins, ladders, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def epoch_to_timestamp(x: Column) -> Column:
    """Epochs above 1e12 are milliseconds, others seconds."""
    return F.when(x > F.lit(10**12), F.timestamp_millis(x.cast("long"))).otherwise(F.timestamp_seconds(x))


def eastern(ts: Column) -> Column:
    """Wall clock of New York for a zoneless UTC timestamp, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(et: Column, start: int = 570, end: int = 960) -> Column:
    """Weekdays from 09:30 to before 16:00 on the wall clock."""
    return minute_of_day(et).between(start, end - 1) & (F.weekday(et) < 5)


def trade_day_17(et: Column) -> Column:
    """The calendar day, or the next one from 17:00 on."""
    return F.to_date(et + F.expr("INTERVAL 7 HOURS"))


def trade_day_utc22(ts: Column) -> Column:
    return F.to_date(ts + F.expr("INTERVAL 2 HOURS"))


def clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", (minutes / 60).cast("int"), (minutes % 60).cast("int"))


def text_boolean(x: Column) -> Column:
    return F.lower(F.trim(x)) == "true"


def dead_band(x: Column, threshold: float = 0.5) -> Column:
    """0 inside the band, else the sign; nulls stay null."""
    return F.when(F.abs(x) < threshold, 0).when(x > 0, 1).when(x.isNotNull(), -1)


def ladder(x: Column, thresholds: list[float], levels: list[float]) -> Column:
    """levels[k] from thresholds[k] on, levels[0] below the first threshold."""
    out = F.lit(float(levels[0]))
    for t, v in zip(thresholds, levels[1:], strict=True):
        out = F.when(x >= t, F.lit(float(v))).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cut(x: Column, edges: list[float], labels: list[str], right: bool = True, include_lowest: bool = False) -> Column:
    """Bins (edges[k], edges[k+1]], the first one with its lower edge if include_lowest; with right=False [edges[k], edges[k+1]).
    Null outside.
    """
    out = F.lit(None).cast("string")
    for k, (a, b, label) in reversed(list(enumerate(zip(edges, edges[1:], labels, strict=False)))):
        above = x >= a if not right or (include_lowest and k == 0) else x > a
        out = F.when(above & (x <= b if right else x < b), label).otherwise(out)
    return out


def normalised(x: Column) -> Column:
    """Text without surrounding space, in upper case."""
    return F.upper(F.trim(x))


def stars(p: Column, levels: tuple[float, ...] = (0.001, 0.01, 0.05)) -> Column:
    out = F.lit("")
    for k, level in enumerate(reversed(levels), 1):
        out = F.when(p < level, "*" * k).otherwise(out)
    return out


def sum_of(*cols: Column) -> Column:
    """Row-wise sum that skips nulls; null only if all are."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*cols).isNotNull(), total)
