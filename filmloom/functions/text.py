"""Text column functions: normalising, tokens, keyword classes, dialogue quality, causal triples, markup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and keyword classes.
STOP_WORDS = ("a", "an", "and", "are", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")
SITUATIONS = (("conflict", ("fight", "argue", "attack")), ("travel", ("drive", "walk", "road")), ("romance", ("kiss", "love")))
#: Patterns of two groups, here without names, and the number of the one that holds the cause.
CAUSAL = (
    (r"(.+?)\s+(?:causes|caused|led to?|results? in?|triggers?|triggered)\s+(.+?)(?:\.|,|$)", 1),
    (r"(?:because of|because|due to|owing to)\s+(.+?),\s+(.+?)(?:\.|,|$)", 1),
    (r"(.+?),?\s+which\s+(?:leads?|led)\s+to\s+(.+?)(?:\.|,|$)", 1),
    (r"(.+?)\s+is\s+(?:the\s+)?(?:direct\s+)?result\s+of\s+(.+?)(?:\.|,|$)", 2),
    (r"(.+?)\s+therefore\s+(.+?)(?:\.|,|$)", 1),
    (r"(.+?),\s+so\s+(.+?)(?:\.|,|$)", 1),
)
#: What any text with a match of one of them holds.
CAUSAL_WORDS = r"(?iU)caused|causes|led t|result|trigger|because|due to|owing to|which|therefore|,\s+so\s"


def normalise(text: Column) -> Column:
    """Lower case, other characters than letters, digits, underscores and white space as spaces, runs of space as one."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def tokens(text: Column, least: int = 2) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(normalise(text), " "), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def situation(text: Column) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("general")
    for label, keys in reversed(SITUATIONS):
        out = F.when(F.regexp_like(low, F.lit("|".join(keys))), label).otherwise(out)
    return out


def dialogue_quality(text: Column) -> Column:
    """0.5 + 0.2 * unique share + 0.2 * letter share + 0.1 for 3 words or more, within 0 and 1."""
    t = F.coalesce(text, F.lit(""))
    ws = F.filter(F.split(normalise(t), " "), lambda w: w != "")
    unique = F.try_divide(F.size(F.array_distinct(ws)).cast("double"), F.size(ws).cast("double"))
    letters = F.try_divide(F.length(F.regexp_replace(t, r"[^\p{L}]", "")).cast("double"), F.length(t).cast("double"))
    score = F.lit(0.5) * (F.size(ws) > 0).cast("double") + 0.2 * F.coalesce(unique, F.lit(0.0)) + 0.2 * F.coalesce(letters, F.lit(0.0)) + F.when(F.size(ws) >= 3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def causal_triples(text: Column) -> Column:
    """Structs (cause, effect) of CAUSAL's matches, in order of pattern and place, each pair once in whatever case.

    Both sides have more than 3 characters. A pattern that opens with any text and fails at one place of a line fails at
    all later ones too: it then takes the rest of the line as a match of nothing, or it would try each place in turn.
    """
    t = F.coalesce(text, F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    found = []
    for pattern, cause in CAUSAL:
        whole = F.lit("(?idU)" + pattern + ("|.+" if pattern.startswith("(.+?)") else ""))
        sides = [F.regexp_extract_all(t, whole, F.lit(g)) for g in (cause, 3 - cause)]
        found.append(F.zip_with(*sides, lambda c, e: F.struct(trimmed(c).alias("cause"), trimmed(e).alias("effect"))))
    long = F.filter(F.concat(*found), lambda p: (F.length(p["cause"]) > 3) & (F.length(p["effect"]) > 3))

    def once(pairs: Column) -> Column:
        # No side holds a line break.
        keys = F.transform(pairs, lambda p: F.lower(F.concat_ws("\n", p["cause"], p["effect"])))
        return _bind(keys, lambda ks: F.filter(pairs, lambda p, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    none = F.array().cast("array<struct<cause:string,effect:string>>")
    return F.when(F.regexp_like(t, F.lit(CAUSAL_WORDS)), _bind(long, once)).otherwise(none)


def without_markup(html: Column) -> Column:
    """Scripts, styles and tags removed, the commonest entity decoded, white space squeezed."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    x = F.replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


# Labels with their words; the first label of which any word is in the text holds, else the one that stands first.
ACTIVITY = {
    "situation": ("activity", (
        ("physical_activity", ("walking", "running", "jogging", "exercising")),
        ("cooking", ("cooking", "baking", "frying", "grilling")),
        ("music_performance", ("playing", "guitar", "piano", "drums", "music")),
        ("conversation", ("talking", "speaking", "conversation")),
        ("dancing", ("dancing", "dance")),
        ("grooming", ("grooming", "shaving", "brushing", "washing")),
        ("repairing", ("assembling", "repairing", "fixing")),
        ("child_play", ("children", "playing", "kids")),
        ("eating", ("eating", "drinking", "having meal")),
        ("pet_activity", ("dog", "cat", "pet", "animal")),
    )),
    "setting": ("indoor", (
        ("indoor_gym", ("gym", "workout", "exercise")),
        ("indoor_kitchen", ("kitchen", "cooking", "baking")),
        ("outdoor", ("outdoor", "park", "street", "garden", "yard")),
        ("outdoor_beach", ("beach", "ocean", "water")),
        ("indoor_bathroom", ("bathroom", "shower", "toilet")),
        ("indoor_bedroom", ("bedroom", "sleeping", "lying")),
        ("outdoor_vehicle", ("car", "driving", "vehicle")),
    )),
    "emotion": ("neutral", (
        ("positive_happy", ("happy", "laughing", "joy", "celebrating")),
        ("negative_sad", ("sad", "crying", "grief")),
        ("negative_angry", ("angry", "fighting", "arguing")),
        ("negative_fearful", ("scary", "fear", "running away")),
        ("positive_romantic", ("romantic", "kissing", "couple")),
        ("positive_funny", ("funny", "comedy", "joking")),
    )),
    "narrative": ("scene", (
        ("introduction", ("intro", "beginning", "starting")),
        ("resolution", ("finish", "end", "completing")),
    )),
    "music": ("", (
        ("epic_orchestral", ("[epic music]",)),
        ("sad_piano", ("[sad music]",)),
        ("suspense_tension", ("[tense music]",)),
        ("romantic_soft", ("[romantic music]",)),
        ("action_drums", ("[action music]",)),
        ("comedic_light", ("[comedic music]",)),
        ("horror_dissonant", ("[horror music]",)),
        ("background_music", ("[music]",)),
    )),
}
# Verbs that are labels of their own.
VERBS = ("walking", "running", "jumping", "dancing", "cooking", "eating", "drinking", "talking", "laughing", "crying", "singing", "playing", "working", "reading", "writing", "driving", "swimming", "fighting", "grooming", "exercising")
# All labels hold of which any word is in the text.
SEVERAL = {
    "actions": ("interacting", tuple((v, (v,)) for v in VERBS)),
    "audio": ("speech", (
        ("background_music", ("[music]", "[song]")),
        ("screaming", ("[scream]", "[shout]")),
        ("explosion", ("[gun]", "[shoot]")),
        ("footsteps", ("[footstep]", "[step]")),
        ("ambient_nature", ("[wind]", "[rain]")),
        ("vehicle_engine", ("[car]", "[engine]")),
        ("applause", ("[applause]",)),
        ("crowd_noise", ("[crowd]",)),
    )),
}
# Marks of noise.
NOISE = ("transciprokey", "advanced effects", "top 10", "subtitle", "credits", "the end")


def _any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def label_of(low: Column, kind: str) -> Column:
    """The label of ACTIVITY's kind for a text in lower case."""
    default, labels = ACTIVITY[kind]
    return F.coalesce(*[F.when(_any(low, words), label) for label, words in labels], F.lit(default))


def labels_of(low: Column, kind: str) -> Column:
    """The labels of SEVERAL's kind for a text in lower case; no audio at all in an empty one."""
    default, labels = SEVERAL[kind]
    found = F.array_compact(F.array(*[F.when(_any(low, words), label) for label, words in labels]))
    out = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(out) if kind == "audio" else out


def dialogue_score(text: Column) -> Column:
    """0.5, up to 0.25 for unique words, up to 0.2 for letters, 0.1 from 12 words, less 0.25 for thanks and 0.2 a mark of noise, within 0 and 1."""

    def score(t: Column) -> Column:
        low = F.lower(t)
        ws = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        unique = F.try_divide(F.size(F.array_distinct(ws)).cast("double"), F.size(ws).cast("double"))
        letters = F.try_divide(F.length(F.regexp_replace(t, r"[^\p{L}]", "")).cast("double"), F.length(t).cast("double"))
        noise = sum((F.contains(low, F.lit(w)).cast("int") for w in NOISE), F.lit(0))
        thanks = F.size(F.regexp_extract_all(low, F.lit("thank you"), F.lit(0))) >= 3
        out = F.lit(0.5) + F.least(F.lit(0.25), 0.35 * unique) + F.least(F.lit(0.2), 0.2 * letters) + F.when(F.size(ws) >= 12, 0.1).otherwise(0.0) - F.when(thanks, 0.25).otherwise(0.0) - 0.2 * noise
        return F.when(F.size(ws) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))

    return _bind(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), score)


# Labels of imported chunks with their words, as in ACTIVITY and SEVERAL.
IMPORTED = {
    "setting": (
        ("beach", ("beach", "ocean", "sea", "shore")),
        ("outdoor_vehicle", ("car", "drive", "road", "street", "highway")),
        ("indoor_home", ("bedroom", "home", "house", "kitchen", "bathroom")),
        ("indoor_office", ("office", "work", "building")),
        ("indoor_restaurant", ("restaurant", "cafe", "bar", "diner")),
        ("outdoor_nature", ("forest", "mountain", "jungle", "desert")),
        ("outdoor_urban", ("city", "urban", "downtown")),
        ("underwater", ("underwater", "seabed", "ocean_floor")),
        ("indoor", ("indoor", "room", "inside")),
    ),
    "actions": (
        ("running", ("running", "run", "sprint")),
        ("walking", ("walking", "walk")),
        ("talking", ("talking", "speaking", "conversing", "chatting")),
        ("driving", ("driving", "drives", "car")),
        ("fighting", ("fighting", "punch", "attack", "kick")),
        ("kissing", ("kissing", "kiss")),
        ("dancing", ("dancing", "dance")),
        ("eating", ("eating", "food", "cooking")),
        ("singing", ("singing", "sing", "music")),
        ("crying", ("crying", "tears", "sad")),
        ("laughing", ("laughing", "laugh", "smile")),
        ("swimming", ("diving", "swimming", "water")),
        ("shooting", ("shooting", "gun", "weapon")),
    ),
}
# Moods with the attributes that show them, in order; None stands for those that the text shows.
MOODS = (
    ("positive_happy", ("happy", "joy", "excited", "cheerful")),
    ("negative_sad", ("sad", "crying", "depressed", "grief")),
    ("negative_angry", ("angry", "rage", "furious", "hostile")),
    ("negative_fearful", ("fear", "scary", "horror", "terror", "afraid")),
    ("positive_romantic", ("romantic", "love", "passionate")),
    ("tense", None),
    ("positive_funny", ("funny", "comedy", "humor", "hilarious")),
)
TENSE = ("tense", "danger", "threat", "suspense")


def imported_setting(low: Column) -> Column:
    """The setting of an imported chunk by its scene label and situation, in lower case; outdoor if none fits."""
    return F.coalesce(*[F.when(_any(low, words), label) for label, words in IMPORTED["setting"]], F.lit("outdoor"))


def imported_actions(low: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(_any(low, words), label) for label, words in IMPORTED["actions"]]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("interacting")))


def imported_emotion(attributes: Column, low: Column) -> Column:
    """The mood that a chunk's attributes show, whole words in any case, or its description in lower case; neutral if none does."""
    own = F.transform(F.coalesce(attributes, F.array().cast("array<string>")), F.lower)
    shows = lambda words: _any(low, TENSE) if words is None else F.arrays_overlap(own, F.array(*[F.lit(w) for w in words]))
    return F.coalesce(*[F.when(shows(words), label) for label, words in MOODS], F.lit("neutral"))
