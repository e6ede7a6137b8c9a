"""Columns of chunks: texts to search, layers with their score and review, properties."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Fields that every chunk should have, the fields of each layer and the layers' weights.
CORE_FIELDS = ("chunk_id", "movie_id", "start_seconds", "end_seconds", "description", "dialogue_text", "characters", "cast_in_scene", "narrative_arc", "causal_relations", "script_primary_heading", "screenplay_context_excerpt")
LAYER_FIELDS = {
    "layer_1_temporal": ("movie_id", "chunk_id", "start_seconds", "end_seconds"),
    "layer_2_semantic": ("description", "situation", "vision_setting", "vision_actions"),
    "layer_3_dialogue": ("dialogue_text",),
    "layer_4_character": ("characters", "cast_in_scene"),
    "layer_5_narrative_script": ("narrative_arc", "causal_relations", "script_primary_heading", "screenplay_context_excerpt"),
}
LAYER_WEIGHTS = {"layer_1_temporal": 0.20, "layer_2_semantic": 0.25, "layer_3_dialogue": 0.20, "layer_4_character": 0.20, "layer_5_narrative_script": 0.15}
# Dialogue that says that there is none, and texts that say nothing.
NO_DIALOGUE = ("[PENDING_SRT_ALIGNMENT]", "[NO_DIALOGUE]")
UNSPECIFIED = ("unspecified", "none")


def has_value(df: DataFrame, field: str) -> Column:
    """Whether a row has something in a field: text other than white space, a list or map with entries, any other value that is not null. A column that df lacks has nothing."""
    if field not in df.columns:
        return F.lit(False)
    kind, c = df.schema[field].dataType, F.col(field)
    if isinstance(kind, StringType):
        return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
    return F.coalesce(F.size(c) > 0, F.lit(False)) if isinstance(kind, ArrayType | MapType) else c.isNotNull()


def layered(chunks: DataFrame, layers: Mapping[str, Sequence[str]] = LAYER_FIELDS, weights: Mapping[str, float] = LAYER_WEIGHTS, core: Sequence[str] = CORE_FIELDS) -> DataFrame:
    """chunks with layer_status (each layer's share of its fields), quality_score, missing_layers, missing_fields, review_status and review_priority."""
    share = {name: sum((has_value(chunks, f).cast("int") for f in fields), F.lit(0)) / F.lit(float(len(fields))) for name, fields in layers.items()}
    out = chunks.withColumn("layer_status", F.struct(*[c.alias(n) for n, c in share.items()]))
    of = lambda n: F.col("layer_status")[n]
    missing = F.array_compact(F.array(*[F.when(of(n) < 1.0, n) for n in layers]))
    fields = F.array_compact(F.array(*[F.when(~has_value(chunks, f), f) for f in core]))
    out = out.withColumns({"quality_score": F.round(sum((of(n) * weights[n] for n in layers), F.lit(0.0)), 4), "missing_layers": missing, "missing_fields": fields})
    lacks = lambda n: F.array_contains("missing_layers", n)
    good, first = (F.size("missing_layers") == 0) & (F.col("quality_score") >= 0.90), lacks("layer_1_temporal") | (F.col("quality_score") < 0.60)
    poor = lacks("layer_4_character") | lacks("layer_5_narrative_script")
    status = F.when(good, "approved_auto").when(first, "needs_manual_review").when(poor, "needs_enrichment").otherwise("needs_review")
    return out.withColumn("review_status", status).withColumn("review_priority", F.when(good, "low").when(first | poor, "high").otherwise("medium"))


def evidence_sources(chunks: DataFrame, fields: Sequence[str] = ("timestamp_source", "dialogue_source", "vision_source"), screenplay: str = "screenplay_evidence", always: str = "bootstrap") -> Column:
    """Where a chunk's layers come from, each once, in order of the fields."""
    said = [F.when(has_value(chunks, f), F.trim(F.col(f).cast("string"))) for f in fields if f in chunks.columns]
    return F.array_distinct(F.array_compact(F.array(*said, F.when(has_value(chunks, screenplay), "screenplay"), F.lit(always))))


#: Fields that hold lists of text.
LISTS = ("characters", "cast_in_scene", "script_characters", "vision_objects", "causal_relations")
# Composers. Each takes a function from a field's name to its column; lists are arrays of text, and null fields are empty.
Fields = Callable[[str], Column]


def fields_of(chunks: DataFrame) -> Fields:
    """The columns of chunks as text or lists; what it lacks is empty."""
    kinds: dict[str, DataType] = {f.name: f.dataType for f in chunks.schema}
    empty = F.array().cast("array<string>")

    def get(name: str) -> Column:
        if name not in kinds:
            return empty if name in LISTS else F.lit(None).cast("string")
        if isinstance(kinds[name], ArrayType):
            return F.coalesce(F.col(name).cast("array<string>"), empty)
        return F.col(name).cast("string")

    return get


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def knowledge_text(get: Fields) -> Column:
    """Description, situation, dialogue unless it says that there is none, characters, setting and arc, joined by bars."""
    said = F.coalesce(_filled(get("dialogue_text")), get("dialogue"))
    names = F.when(F.size(get("characters")) > 0, F.array_join(get("characters"), " "))
    return F.concat_ws(" | ", *[_filled(_strip(c)) for c in (get("description"), get("situation"), F.when(~said.isin(*NO_DIALOGUE), said))], _filled(names), *[_filled(_strip(get(f))) for f in ("vision_setting", "narrative_arc")])


def _relations(get: Fields) -> Column:
    """causal_relations as a list of relations' names."""
    r = F.filter(get("causal_relations"), lambda x: x != "")
    return F.when(F.size(get("causal_relations")) > 0, F.concat(F.lit("Relations: "), F.array_join(r, " | ")))


def merge_text(get: Fields) -> Column:
    names = F.when(F.size(get("characters")) > 0, F.concat(F.lit("Characters: "), F.array_join(get("characters"), ", ")))
    return F.concat_ws(" | ", *[_filled(get(f)) for f in ("description", "situation", "dialogue_text")], names, *[_filled(get(f)) for f in ("narrative_arc", "script_heading", "screenplay_context")], _relations(get))


def benchmark_text(get: Fields, use_dialogue: bool = True) -> Column:
    """The first of description, excerpt, context and situation that says something, arc, dialogue, five characters, relations."""
    told = lambda c: F.when((c != "") & ~F.lower(c).isin(*UNSPECIFIED), c)
    first = F.coalesce(*[told(get(f)) for f in ("description", "screenplay_context_excerpt", "screenplay_context", "situation")])
    names = F.when(F.size(get("characters")) > 0, F.concat(F.lit("Characters: "), F.array_join(F.slice(get("characters"), 1, 5), ", ")))
    return F.concat_ws(" | ", first, told(get("narrative_arc")), *([told(get("dialogue_text"))] if use_dialogue else []), names, _relations(get))


def rebuild_text(get: Fields, lists: Sequence[str] = ("characters",)) -> Column:
    flat = lambda f: F.array_join(F.filter(get(f), lambda x: x != ""), " ") if f in lists else get(f)
    order = ("description", "situation", "dialogue_text", "characters", "narrative_arc", "script_heading", "screenplay_context", "vision_setting", "vision_actions")
    return F.concat_ws(" | ", *[_filled(_strip(flat(f))) for f in order])


def _labelled(get: Fields, parts: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws("\n", *[_strip(F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))) for label, c in parts])


def scene_text(get: Fields, most: int = 1200) -> Column:
    """A scene's fields, each on a line after its label, at most `most` characters in all."""
    some = lambda f, n: F.array_join(F.slice(get(f), 1, n), ", ")
    heading, place = get("script_primary_heading"), get("script_location")
    parts = [
        ("Heading", heading), ("Heading exact", heading), ("Location", place), ("Location exact", place), ("Scene label", get("scene_label")), ("Time of day", get("script_time_of_day")), ("Characters", some("characters", 6)), ("Script characters", some("script_characters", 6)),
        ("Vision setting", get("vision_setting")), ("Vision actions", get("vision_actions")), ("Visual focus", get("visual_focus")), ("Visible objects", some("vision_objects", 8)), ("Description", get("description")), ("Screenplay context", get("screenplay_context_excerpt")), ("Dialogue", get("dialogue_text")),
    ]
    return F.substring(_labelled(get, parts), 1, most)


# Properties of graph nodes


def sanitised(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns as properties that a graph can hold: text, numbers, booleans and lists of them as they are, all that is nested as JSON, anything else as text."""

    def plain(kind: DataType) -> bool:
        return kind.typeName() in ("string", "boolean", "byte", "short", "integer", "long", "float", "double")

    def one(c: str) -> Column:
        kind = df.schema[c].dataType
        if plain(kind) or isinstance(kind, ArrayType) and plain(kind.elementType):
            return F.col(c)
        return F.to_json(c) if isinstance(kind, ArrayType | MapType | StructType) else F.col(c).cast("string")

    return df.withColumns({c: one(c) for c in names})


def merged(df: DataFrame, names: Sequence[str], new: str = "new_") -> DataFrame:
    """df with each named column and its `new` one as one: what is there stays, what is empty is filled, and lists get the new entries that they lack."""

    def one(c: str) -> Column:
        old, add = F.col(c), F.col(f"{new}{c}")
        if isinstance(df.schema[c].dataType, ArrayType):
            return F.when(~has_value(df, c), F.coalesce(F.when(F.size(add) > 0, add), old)).when(F.size(add) > 0, F.concat(old, F.filter(F.array_distinct(add), lambda x: ~F.array_contains(old, x)))).otherwise(old)
        empty = (old.isNull() | (old == "")) if isinstance(df.schema[c].dataType, StringType) else old.isNull()
        filled = F.when(add != "", add) if isinstance(df.schema[c].dataType, StringType) else add
        return F.when(empty, F.coalesce(filled, old)).otherwise(old)

    return df.withColumns({c: one(c) for c in names}).drop(*[f"{new}{c}" for c in names])
