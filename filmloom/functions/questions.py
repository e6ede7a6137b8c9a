"""What a question says about time, and how well an interval answers it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filmloom.functions import temporal

#: Kind, pattern and confidence, in the order in which they are tried. Letters' case doesn't count.
EXPRESSIONS = (
    ("at_time", r"at\s+(\d{1,2}:\d{2}(?::\d{2})?)", 1.0),
    ("at_time", r"at\s+(\d+(?:\.\d+)?)\s*(seconds?|minutes?|mins?|secs?|hours?|hrs?)", 0.9),
    ("first_occurrence", r"(?:the\s+)?first\s+(?:time\s+)?(?:we\s+|I\s+)?(?:see|see\s+|see\s+)?([A-Z][a-zA-Z\s]+?)(?:\s+(?:appears?|see|appear|shown))", 0.9),
    ("first_occurrence", r"first\s+([a-z][a-zA-Z]+)", 0.8),
    ("last_occurrence", r"last\s+(?:time\s+)?(?:we\s+|I\s+)?(?:see|see\s+|saw)\s+([A-Z][a-zA-Z]+)", 0.9),
    ("before_event", r"before\s+([A-Z][a-zA-Z]+)\s+(?:happens?|appears?)", 0.85),
    ("after_event", r"after\s+([A-Z][a-zA-Z]+)", 0.85),
    ("any_occurrence", r"when\s+does\s+([A-Z][a-zA-Z]+)\s+(happen|appear|show)", 0.85),
    ("during_event", r"during\s+(?:the\s+)?([A-Z][a-zA-Z]+)", 0.8),
)
#: The score of an event whose time is unknown, of one that the interval may lie in, of a named entity found, of any other.
UNKNOWN, DURING, NAMED, OTHER = 0.6, 0.9, 0.95, 0.5


def clock_seconds(text: Column) -> Column:
    """H:MM:SS or M:SS as seconds; null for other texts."""
    parts = F.split(text, ":")
    n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(parts) == 2, n(1) * 60 + n(2))


def duration_seconds(value: Column, unit: Column) -> Column:
    """A number with its unit as seconds. Only units that begin with min or hr scale it: one in "hours" stays as it is."""
    unit = F.lower(unit)
    return value.try_cast("double") * F.when(unit.startswith("min"), 60.0).when(unit.startswith("hr"), 3600.0).otherwise(1.0)


def expression(question: Column) -> Column:
    """The first of EXPRESSIONS that the question holds: a struct of kind, seconds, entity and confidence; null if there is none.

    seconds is set for at_time, entity for all others.
    """
    out = F.when(F.lit(False), F.lit(None))
    for i, (kind, pattern, sure) in enumerate(EXPRESSIONS):
        pattern = f"(?i){pattern}"
        said = lambda g: F.regexp_extract(question, pattern, g)  # noqa: B023, E731
        at = clock_seconds(said(1)) if i == 0 else duration_seconds(said(1), said(2)) if kind == "at_time" else F.lit(None).cast("double")
        entity = F.lit(None).cast("string") if kind == "at_time" else F.trim(F.regexp_replace(said(1), r"^\s+|\s+$", ""))
        out = out.when(question.rlike(pattern), F.struct(F.lit(kind).alias("kind"), at.alias("seconds"), entity.alias("entity"), F.lit(sure).alias("confidence")))
    return out


def score(expr: Column, start: Column, end: Column, description: Column, names: Column, event_start: Column) -> Column:
    """How well start to end answers a question with this expression, from 0 to 1.

    names: of who is in the interval; event_start: when the expression's event begins, null if unknown. A null start or
    end counts as 0. A question without an expression is scored by the interval's length alone, an empty one with 2.
    """
    start, end = F.coalesce(start, F.lit(0.0)), F.coalesce(end, F.lit(0.0))
    kind, decay = expr["kind"], lambda away: F.greatest(F.lit(0.0), 1.0 - away / temporal.NEAR)
    before = F.when(end <= event_start, 1.0).otherwise(decay(start - event_start))
    after = F.when(start >= event_start, 1.0).otherwise(decay(event_start - start))
    named = F.coalesce(F.exists(names, lambda n: F.contains(F.lower(n), F.lower(expr["entity"]))), F.lit(False))
    out = F.when(expr.isNull(), temporal.usual_length(start, end)).when((kind == "at_time") & expr["seconds"].isNotNull(), temporal.at_time(start, end, expr["seconds"]))
    out = out.when(kind == "first_occurrence", temporal.first_occurrence(start, F.coalesce(description, F.lit("")))).when(kind == "last_occurrence", temporal.last_occurrence(start))
    out = out.when(kind.isin("before_event", "after_event", "during_event") & event_start.isNull(), UNKNOWN)
    out = out.when(kind == "before_event", before).when(kind == "after_event", after).when(kind == "during_event", DURING)
    return out.when((kind == "any_occurrence") & named, NAMED).otherwise(OTHER)


def combined(temporal_score: Column, semantic_score: Column) -> Column:
    return temporal_score * 0.6 + semantic_score * 0.4
