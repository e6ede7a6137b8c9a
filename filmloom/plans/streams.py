"""Registered queries that run as streams over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filmloom.plans.registry import query
from filmloom.streaming import tracker


@query("track_events")
def track_events(spark, d: str) -> DataFrame:
    """Tracks of all events' boxes but those of the last hours, which no later event closes."""
    return tracker.tracked_events(spark, f"{d}/events.parquet")
