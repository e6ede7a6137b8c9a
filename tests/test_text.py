"""Text operators against the rules they follow, written out in plain Python."""

from pyspark.sql import functions as F

from filmloom.functions import text as T
from filmloom.plans import queries as _queries  # noqa: F401
from filmloom.plans.registry import QUERIES

TEXTS = [
    "Rain causes floods.",
    "Because of the storm, the game ended. Due to fog, flights stop, so people wait.",
    "He lied, which led to a fight. The fight is the direct result of a lie.\nNo link here\nRain CAUSED Mud, rain caused mud. Rain caused mud",
    "Ice therefore\nslips and falls\nA caused B. It results in\nnothing much, or so it seems\n",
    "The wind triggers\u00a0alarms and they trigger \u00c4rger, owing to rust, which leads to  noise ",
    "nothing of the kind, which is fine",
    "",
    None,
]


# Worked out by hand: what each text states, rule after rule. A side of three characters, like "Mud", states nothing.
STATED = {
    0: [("Rain", "floods")],
    1: [("the storm", "the game ended"), ("Because of the storm, the game ended. Due to fog, flights stop", "people wait")],
    2: [("He lied, which", "a fight"), ("He lied", "a fight"), ("a lie", "He lied, which led to a fight. The fight")],
    3: [],
    4: [("The wind", "alarms and they trigger \u00c4rger"), ("rust", "which leads to  noise"), ("The wind triggers\u00a0alarms and they trigger \u00c4rger, owing to rust", "noise")],
    5: [],
    6: [],
    7: [],
}


def test_causal_statements(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(p) for p in r["t"]] for r in df.select("doc_id", T.causal_triples(F.col("text")).alias("t")).collect()}
    assert got == STATED
    df.where("doc_id = 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["causal_statements"](spark, str(tmp_path)).collect()] == [(0, "Rain", "causes", "floods", "Rain causes floods.", 0.7)]


def test_causal_statements_in_long_lines(spark):
    text = "word " * 40_000 + "which is all"  # quadratic if each place is tried
    assert spark.createDataFrame([(text,)], "text string").select(F.size(T.causal_triples(F.col("text")))).first()[0] == 0


def test_dialogue_scores(spark, tmp_path):
    texts = ["Subtitle credits by us", "thank you Thank you thank you", "one two three", "a b c d e f g h i j k l", " ... ", None]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["quality"] for r in QUERIES["dialogue_scores"](spark, str(tmp_path)).collect()}
    want = [0.35 + 0.2 * 19 / 22, 0.5 + 0.35 / 3 + 0.2 * 24 / 29 - 0.25, 0.75 + 0.2 * 11 / 13, 0.85 + 0.2 * 12 / 23, 0.0, 0.0]
    assert got == {i: round(w, 4) for i, w in enumerate(want)}


def test_keyword_labels(spark, tmp_path):
    texts = ["Kids repairing a car in the park, joking [Music] [STEP]", "A dog on the beach, crying at the end", "[sad music]", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["keyword_labels"](spark, str(tmp_path)).collect()}
    none = ("activity", "indoor", "neutral", "scene", "", ["interacting"], [])
    assert got == {
        0: ("music_performance", "outdoor", "positive_funny", "scene", "background_music", ["interacting"], ["background_music", "footsteps"]),
        1: ("pet_activity", "outdoor_beach", "negative_sad", "resolution", "", ["crying"], ["speech"]),
        2: ("music_performance", "indoor", "negative_sad", "scene", "sad_piano", ["interacting"], ["speech"]),
        3: none,
        4: none,
    }
