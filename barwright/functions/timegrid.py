"""Integer-second bar arithmetic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LOOKBACK_BARS


def epoch_seconds(wall_clock: Column) -> Column:
    """Floor of the epoch seconds of a zone-less UTC timestamp, whatever the session time zone is."""
    days = F.unix_date(wall_clock.cast("date")).cast("long")
    return days * 86400 + F.hour(wall_clock) * 3600 + F.minute(wall_clock) * 60 + F.second(wall_clock)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def bar_close(seconds: Column, length: Column) -> Column:
    """End of the bar that holds ``seconds``."""
    return (int_div(seconds, length) + 1) * length


class StepTimes(NamedTuple):
    current: int
    previous: int
    oldest: int


def step_times(end: int, minutes: int = 5, hours: int = 0) -> StepTimes:
    """Bar starts a step that ends at ``end`` works on: the bar itself, the one before, the oldest in reach."""
    length = minutes * 60 + hours * 3600
    return StepTimes(end - length, end - 2 * length, end - LOOKBACK_BARS * length)
