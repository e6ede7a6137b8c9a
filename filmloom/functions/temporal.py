"""Scores in [0, 1] of how well an interval answers a question about time, by kind of question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds over which a score decays: from a given time, from the start, beyond a usual length.
NEAR, WHOLE, USUAL = 300.0, 7200.0, 120.0


def at_time(start: Column, end: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    away = F.least(F.abs(start - t), F.abs(end - t))
    return F.when(t.between(start, end), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - away / NEAR))


def first_occurrence(start: Column, description: Column) -> Column:
    late = F.greatest(F.lit(0.2), 1.0 - start / WHOLE)
    return F.when(start < 60, 1.0).when(F.lower(description).contains("first"), 0.9).otherwise(late)


def last_occurrence(start: Column) -> Column:
    return F.least(F.lit(1.0), start / WHOLE + 0.3)


def usual_length(start: Column, end: Column) -> Column:
    """The score where a question names no time."""
    length = end - start
    return F.when((length > 0) & (length <= USUAL), 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (length - USUAL) / USUAL))


def clock(seconds: Column) -> Column:
    """Seconds as H:MM:SS, or M:SS under an hour."""
    h, m, s = (F.floor(x).cast("long") for x in (seconds / 3600, F.pmod(seconds, F.lit(3600.0)) / 60, F.pmod(seconds, F.lit(60.0))))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def timecode(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.ss, without .00; null and negative ones as zero."""
    t = F.greatest(F.lit(0.0), F.coalesce(seconds.cast("double"), F.lit(0.0)))
    h, m = F.floor(t / 3600).cast("long"), F.floor(F.pmod(t, F.lit(3600.0)) / 60).cast("long")
    return F.replace(F.format_string("%02d:%02d:%05.2f", h, m, t - (h * 3600 + m * 60)), F.lit(".00"), F.lit(""))


def seconds_per_shot(runtime_minutes: Column, shots: Column) -> Column:
    """A film's seconds by its shots; 8 where the runtime or the shots are not known."""
    return F.when((runtime_minutes > 0) & (shots > 1), runtime_minutes * 60.0 / shots).otherwise(F.lit(8.0))
