"""Chunk columns and excerpts, worked out by hand or by a plain loop."""

import random

from pyspark.sql import functions as F

from filmloom.functions import chunks as C
from filmloom.functions import excerpts as X
from filmloom.functions import text as T
from filmloom.functions.vectors import mean_vector
from filmloom.operators import hits, segments, sequences
from filmloom.sources.subtitles import clean_line, read_subtitles


def test_layers_and_review(spark):
    full = dict(chunk_id="a", movie_id="m", start_seconds=0.0, end_seconds=2.0, description="d", situation="s", vision_setting="v", vision_actions="x", dialogue_text="hi", characters=["A"], cast_in_scene=["B"], narrative_arc="n", causal_relations=["r"], script_primary_heading="h", screenplay_context_excerpt="c")
    rows = [full, full | {"narrative_arc": " "}, full | {"characters": [], "cast_in_scene": None}, full | {"end_seconds": None}, full | {"vision_actions": "", "situation": None}, full | dict(description=None, situation="", vision_setting="", vision_actions=None, dialogue_text="", characters=[])]
    shape = ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in full.items())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], shape)
    got = [(r["quality_score"], r["review_status"], r["review_priority"], r["missing_layers"], r["missing_fields"]) for r in C.layered(df).collect()]
    assert got == [
        (1.0, "approved_auto", "low", [], []),
        (0.9625, "needs_enrichment", "high", ["layer_5_narrative_script"], ["narrative_arc"]),
        (0.8, "needs_enrichment", "high", ["layer_4_character"], ["characters", "cast_in_scene"]),
        (0.95, "needs_manual_review", "high", ["layer_1_temporal"], ["end_seconds"]),
        (0.875, "needs_review", "medium", ["layer_2_semantic"], []),
        (0.45, "needs_manual_review", "high", ["layer_2_semantic", "layer_3_dialogue", "layer_4_character"], ["description", "dialogue_text", "characters"]),
    ]
    said = spark.createDataFrame([("srt", " srt ", None, "x"), ("", None, "vlm", "")], "timestamp_source string, dialogue_source string, vision_source string, screenplay_evidence string")
    assert [r[0] for r in said.select(C.evidence_sources(said)).collect()] == [["srt", "screenplay", "bootstrap"], ["vlm", "bootstrap"]]


def test_composers(spark):
    df = spark.createDataFrame([(" A fight ", "Unspecified", "[NO_DIALOGUE]", ["Al", "Bo"], "", "climax", ["hits", ""]), (None, "none", "Go!", [], "bar", None, None)], "description string, situation string, dialogue_text string, characters array<string>, vision_setting string, narrative_arc string, causal_relations array<string>")
    get = C.fields_of(df)
    got = df.select(C.knowledge_text(get), C.merge_text(get), C.benchmark_text(get), C.benchmark_text(get, False), C.rebuild_text(get), C.scene_text(get, 60)).collect()
    assert list(got[0])[:5] == ["A fight | Unspecified | Al Bo | climax", " A fight  | Unspecified | [NO_DIALOGUE] | Characters: Al, Bo | climax | Relations: hits", " A fight  | climax | [NO_DIALOGUE] | Characters: Al, Bo | Relations: hits", " A fight  | climax | Characters: Al, Bo | Relations: hits", "A fight | Unspecified | [NO_DIALOGUE] | Al Bo | climax"]
    assert list(got[1])[:5] == ["none | Go! | bar", "none | Go!", "Go!", "", "none | Go! | bar"]
    assert got[0][5] == "Heading:\nHeading exact:\nLocation:\nLocation exact:\nScene labe"


def test_properties(spark):
    df = spark.createDataFrame([("a", 1, ["x", "y"], [(1, None)], {"k": 1.5}, None)], "s string, n int, l array<string>, deep array<struct<p:int,q:int>>, m map<string,double>, t timestamp")
    got = C.sanitised(df, *df.columns)
    assert tuple(got.first()) == ("a", 1, ["x", "y"], '[{"p":1}]', '{"k":1.5}', None) and dict(got.dtypes)["t"] == "string"
    shape = "s string, n int, l array<string>, new_s string, new_n int, new_l array<string>"
    rows = [("a", None, ["x", "y"], "b", 2, ["y", "z", "z"]), ("", 1, [], "b", None, ["q", "q"]), (None, 3, None, "", 4, None), ("c", 5, ["k"], None, 6, [])]
    got = C.merged(spark.createDataFrame(rows, shape), ["s", "n", "l"]).collect()
    assert [tuple(r) for r in got] == [("a", 2, ["x", "y", "z"]), ("b", 1, ["q", "q"]), (None, 3, None), ("c", 5, ["k"])]


def test_excerpts(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    lines = F.array(*[F.lit(x) for x in ("one two", "three", "four five six", "x")])
    assert tuple(one(X.greedy_excerpt(lines, 14), X.greedy_excerpt(lines, 13), X.greedy_excerpt(lines, 7), X.greedy_excerpt(F.lit(None).cast("array<string>")))) == ("one two three", "one two", "", "")
    text = F.lit("First one here.  Second!\nThird? Fourth.")
    assert tuple(one(X.sentence_excerpt(text), X.sentence_excerpt(text, 3, 26), X.sentence_excerpt(text, 2, 9), X.sentence_excerpt(F.lit(None).cast("string")))) == ("First one here. Second!", "First one here. Second!", "First...", "")
    said = ["Thank you.", "thank YOU!", "(x) Thank you", "12 34 56", "a", "♪ la", "It is what it is now", "It is what it is now", None, "'s ?!", "Bob's hat (red)"]
    assert one(X.dialogue_lines(F.array(*[F.lit(x).cast("string") for x in said])))[0] == ["Thank you.", "thank YOU!", "♪ la", "It is what it is now", "It is what it is now", "Bob's hat (red)"]
    shape = "sub string, play string, sure double, quality double, script boolean"
    rows = [("a b", "", 0.9, 0.5, True), (None, "p", None, 0.5, False), ("", None, 0.1, 0.0, True), ("a b", "p", 0.46, 0.9, True), ("a b", "p", 0.46, 0.9, False), ("a b", "p", 0.7, 0.9, None), ("a b", "p", 0.1, 0.5, True), ("aaaa", "ppppp", None, 0.9, True), ("aaaa", "pppp", None, 0.9, True)]
    got = spark.createDataFrame(rows, shape).select(X.primary_dialogue(*map(F.col, ("sub", "play", "sure", "quality", "script"))).alias("d")).collect()
    assert [r["d"]["source"] for r in got] == ["subtitle", "screenplay", "none", "screenplay", "subtitle", "screenplay", "screenplay", "screenplay", "subtitle"]


def test_imported_labels(spark):
    rows = [(["Happy"], "a sea shore with people running and tears"), ([], "danger in the room"), (["sadness"], "a plain text"), (None, ""), (["funny", "Rage"], "urban ocean_floor")]
    df = spark.createDataFrame(rows, "a array<string>, low string")
    got = df.select(T.imported_setting(F.col("low")), T.imported_actions(F.col("low")), T.imported_emotion(F.col("a"), F.col("low"))).collect()
    assert [tuple(r) for r in got] == [("beach", ["running", "crying"], "positive_happy"), ("indoor", ["interacting"], "tense"), ("outdoor", ["interacting"], "neutral"), ("outdoor", ["interacting"], "neutral"), ("beach", ["interacting"], "negative_angry")]


def test_pick_per_shot(spark):
    r = random.Random(3)
    frames = [(m, i // 3, r.randrange(5), float(r.randrange(60)), i) for m in ("a", "b") for i in range(40)]
    spans = [("a", 1, 0.0, 20.0), ("a", 2, 15.0, 15.0), ("a", 3, 10.0, 55.0), ("b", 4, 30.0, 31.0), ("c", 5, 0.0, 9.0)]
    got = sequences.pick_per_shot(spark.createDataFrame(frames, "m string, shot int, image int, t double, frame int"), spark.createDataFrame(spans, "m string, span int, s0 double, s1 double"), "m", "span", "shot", "image", "t", 10.0)
    want = {}
    for m, span, s0, s1 in spans:
        for f in frames:
            if f[0] == m and s0 <= f[3] <= s1 and s1 > s0:
                key = ({1: 0, 0: 1, 2: 2}.get(f[2], 99), abs(f[3] - (s0 + s1) / 2), f[3])
                if (span, f[1]) not in want or key < want[span, f[1]]:
                    want[span, f[1]] = key
    at = {i[0]: (i[2] + i[3]) / 2 for i in [(s[1], None, s[2], s[3]) for s in spans]}
    assert {(r["span"], r["shot"]): ({1: 0, 0: 1, 2: 2}.get(r["image"], 99), abs(r["t"] - at[r["span"]]), r["t"]) for r in got.collect()} == want


def test_best_hits_with_payload(spark):
    rows = [("n", 0.5, "graph", 0, "first", []), ("n", 0.9, "text", 1, "best", []), ("n", 0.9, "text", 2, "later", ["Ed"]), ("n", 0.2, "graph", 6, "hybrid", []), ("n", 0.2, "text", 7, "after", ["Al"]), ("m", 0.3, "graph", 3, "only", ["Bo"]), (None, 1.0, "x", 4, "none", ["C"]), ("k", 0.1, "text", 5, "own", None)]
    df = spark.createDataFrame(rows, "node string, score double, source string, place int, text string, names array<string>")
    got = {r["node"]: (r["score"], r["source"], r["text"], r["names"]) for r in hits.best_hits_with(df, "node", "score", "source", "place", "text", names="names").collect()}
    assert got == {"n": (0.9, "hybrid", "best", ["Al"]), "m": (0.3, "graph", "only", ["Bo"]), "k": (0.1, "text", "own", None)}


def test_scenes(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate([0.9, 0.8, 0.2, 0.75, 0.1, None])] + [("j", 0, None)], "k string, place long, sim double")
    got = sorted(tuple(r) for r in segments.scenes_by_similarity(df, "k", "place", "sim").collect())
    assert [(g[0], g[2], g[3], g[4] and round(g[4], 6)) for g in got] == [("j", 0, 1, None), ("k", 0, 3, 0.85), ("k", 3, 5, 0.75), ("k", 5, 6, None)]
    assert sorted(tuple(r) for r in segments.scenes_by_count(df.where("k = 'k'"), "k", "place", 4).collect()) == [("k", 0, 0, 4), ("k", 1, 4, 6)]
    shots = spark.createDataFrame([("k", *p) for p in [(0.0, 4.0), (4.0, 9.0), (9.0, 12.0), (12.0, 30.0), (30.0, 31.0)]], "k string, s double, e double")
    assert [tuple(r)[2:] for r in segments.scenes_by_time(shots, "k", "s", "e", 10.0).orderBy("chunk").collect()] == [(0.0, 12.0, 3), (12.0, 30.0, 1), (30.0, 31.0, 1)]


def test_subtitle_text(spark, tmp_path):
    lines = ["<i>Hi</i>  [NARRATOR:] there", "(Man: yes) (Old Man: no", "(man: stays", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(clean_line(F.col("x"))).collect()] == ["Hi there", "yes) no", "(man: stays", None]
    (tmp_path / "a.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n“Zoë” …\n".encode("cp1252"))
    assert read_subtitles(spark, str(tmp_path)).first()["text"] == "“Zoë” …"


def test_mean_vector_of_length_one(spark):
    df = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [3.0, 8.0]), ("b", [0.0, 2.0])], "k string, v array<double>")
    got = {r["k"]: [round(x, 12) for x in r["v"]] for r in mean_vector(df, "k", "v", normalise=True).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 1.0]}
