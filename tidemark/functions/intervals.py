"""Frequencies and interval arithmetic on timestamps, free of the session time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of the frequency units in seconds.  B (business day) counts as D.
UNIT_SECONDS = {
    "s": 1, "S": 1,
    "min": 60, "T": 60,
    "h": 3600, "H": 3600,
    "D": 86400, "B": 86400,
    "W": 604800,
}


def freq_seconds(freq: str) -> int:
    """Length of a frequency such as '5min', 'h' or '1D'."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
    if not m or m.group(2) not in UNIT_SECONDS:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m.group(1) or 1) * UNIT_SECONDS[m.group(2)]


def freq_us(freq: str) -> int:
    return freq_seconds(freq) * 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; a TIMESTAMP_NTZ column is read in the session time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def _whole(us: Column, freq: str) -> Column:
    size = F.lit(freq_us(freq)).cast("long")
    return F.call_function("div", us - F.pmod(us, size), size)


def grid_number(ts: Column, freq: str) -> Column:
    """Number of the interval (since the epoch) that holds the timestamp."""
    return _whole(micros(ts), freq)


def grid_start(number: Column, freq: str) -> Column:
    return F.timestamp_micros(number * F.lit(freq_us(freq)).cast("long"))


def interval_start(ts: Column, freq: str) -> Column:
    return grid_start(grid_number(ts, freq), freq)


def interval_end(ts: Column, freq: str) -> Column:
    return grid_start(grid_number(ts, freq) + 1, freq)


def close_time(ts: Column, freq: str) -> Column:
    """End of the bar whose timestamp marks its start."""
    return F.timestamp_micros(micros(ts) + F.lit(freq_us(freq)).cast("long"))


def intervals_since(start: Column, now: Column, freq: str) -> Column:
    """Whole intervals between two instants plus the two that are always fetched again."""
    return _whole(micros(now) - micros(start), freq) + 2


def start_for_intervals(now: Column, count: Column | int, freq: str) -> Column:
    """Instant that lies ``count + 1`` intervals before ``now``."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.timestamp_micros(micros(now) - (n + 1).cast("long") * F.lit(freq_us(freq)).cast("long"))


def starts_longer_interval(ts: Column, freq: str, longer: str) -> Column:
    """True when the longer interval begins together with the shorter one."""
    return micros(interval_start(ts, longer)) == micros(interval_start(ts, freq))
