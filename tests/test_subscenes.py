"""Sub-scenes, clip matches, windows and grounding against loops."""

import random

from filmloom.operators import grounding, subscenes

R = random.Random(21)


def movie():
    span = lambda most, n: [(x := float(R.randrange(most)), x + R.choice([0.0, 2.0, 8.0, 30.0])) for _ in range(n)]
    return {
        "scenes": [(f"s{i}", *s, f"d{i}") for i, s in enumerate(span(300, 14))],
        "scripts": [(f"u{i}", i, *s, f"h{i}", R.choice(["full", "partial", "linear", "other"]), R.choice([None, 0.2, 0.91234])) for i, s in enumerate(span(260, R.choice([1, 9])))],
        "clips": [(R.choice([f"s{k}" for k in range(10)]), f"c{R.randrange(6)}", i, R.choice([None, f"t{i}"])) for i in range(12)],
        "chunks": [(f"k{i}", i, R.choice(["", *(f"c{k}" for k in range(6))]), R.choice(["", "u0", "u1", "u2"]), *s) for i, s in enumerate(span(300, 40))],
    }


def parts(m):
    clip = {s: (c, t) for s, c, _, t in m["clips"]}
    out = []
    for sid, s0, s1, told in m["scenes"]:
        hit = [x for x in m["scripts"] if x[3] > s0 and x[2] < s1] or [min(m["scripts"], key=lambda x: abs(x[2] - s0))]
        for uid, nth, c0, c1, heading, quality, sure in hit:
            o0, o1 = max(s0, c0), min(s1, c1)
            own = [k for k in m["chunks"] if k[2] == clip.get(sid, ("",))[0]]
            own = [k for k in own if k[3] == uid] or own
            parent = max(own, key=lambda k: (max(0.0, min(k[5], o1) - max(k[4], o0)), -abs(k[4] - o0), -abs(k[5] - o1)), default=("",))
            sec = max(0.0, o1 - o0)
            out.append(dict(scene=sid, uid=uid, parent=parent[0], start=round(o0, 2), sec=round(sec, 2), script=round(sec / max(c1 - c0, 1.0), 3), semantic=round(sec / max(s1 - s0, 1.0), 3), sure=round(sure or 0.0, 3), quality=quality, ok=sec >= 5 or quality in ("full", "partial"), told=clip.get(sid, (0, None))[1] or told))
    for uid in {p["uid"] for p in out}:
        group = [p for p in out if p["uid"] == uid]
        pool = [p for p in group if p["ok"]] or group
        best = max(pool, key=lambda p: (p["sec"], {"full": 2, "partial": 1}.get(p["quality"], 0), p["sure"], p["script"], -p["start"], [-ord(c) for c in p["scene"]]))
        for p in group:
            p["canonical"], p["n"] = p is best, len(group)
    return out


def test_subscenes(spark):
    movies = {f"m{i}": movie() for i in range(4)}
    shapes = {"scenes": "movie_id string, scene_id string, s0 double, s1 double, description string", "scripts": "movie_id string, uid string, nth int, c0 double, c1 double, heading string, anchor_quality string, confidence double", "clips": "movie_id string, scene_id string, clip_id string, nth int, description string", "chunks": "movie_id string, chunk_id string, nth int, clip_id string, uid string, k0 double, k1 double"}
    tables = {t: spark.createDataFrame([(m, *x) for m, v in movies.items() for x in v[t]], s) for t, s in shapes.items()}
    got = {(r["movie_id"], r["scene_id"], r["uid"]): r for r in subscenes.subscenes(**tables).collect()}
    want = {(m, p["scene"], p["uid"]): p for m, v in movies.items() for p in parts(v)}
    assert got.keys() == want.keys()
    for k, p in want.items():
        g = got[k]
        assert (g["start_seconds"], g["overlap_seconds"], g["overlap_ratio_script"], g["overlap_ratio_semantic"], g["confidence_score"]) == (p["start"], p["sec"], p["script"], p["semantic"], p["sure"])
        assert (g["parent_chunk_id"], g["semantic_description"], g["index_eligible"], g["split_count"]) == (p["parent"], p["told"], p["ok"], p["n"])
        assert (g["is_canonical"], g["indexable"]) == (p["canonical"], p["canonical"] and p["ok"])


def test_match_clips_and_windows(spark):
    clips = [(R.choice("ab"), i, x := R.randrange(60), x + R.choice([0, 3, 9])) for i in range(40)]
    scenes = [(m, i, x := R.randrange(50), x + R.choice([1, 5, 12])) for m in "ab" for i in range(8)] + [("a", 55, 900, 901)]
    got = {r["clip"]: r["scene_idx"] for r in subscenes.match_clips(spark.createDataFrame(clips, "m string, clip int, c0 int, c1 int"), spark.createDataFrame(scenes, "m string, scene_idx int, s0 int, s1 int"), "m", "clip", 10.0).collect()}
    for m, c, c0, c1 in clips:
        own = [s for s in scenes if s[0] == m]
        best = max(own, key=lambda s: max(0, min(c1, s[3]) - max(c0, s[2])))
        if max(0, min(c1, best[3]) - max(c0, best[2])) > 0:
            want = best[1]
        else:
            want = next((s[1] for s in own if s[2] <= c0 < s[3]), next((s[1] for s in own if s[1] == c0), None))
        assert got[c] == want
    spans = spark.createDataFrame([(m, i, float(a), float(b)) for m, i, a, b in clips], "m string, clip int, s0 double, s1 double")
    windows = spark.createDataFrame([(m, i, float(a), float(b)) for m, i, a, b in scenes], "m string, nth int, c0 double, c1 double")
    got = {r["clip"]: (r["window_start"], r["window_end"]) for r in subscenes.pick_window(spans, windows, "m", "clip").collect()}
    for m, c, c0, c1 in clips:
        own = [(s[2], s[3]) for s in scenes if s[0] == m]
        over = [w for w in own if w[1] > c0 and w[0] < c1]
        assert got[c] == (max(over, key=lambda w: min(w[1], c1) - max(w[0], c0)) if over else min(own, key=lambda w: abs((w[0] + w[1]) / 2 - (c0 + c1) / 2)))


def test_ground(spark):
    asked = spark.createDataFrame([(1, "what is at 2:00?"), (2, "the first time we see Neo appear"), (3, "who is here"), (4, "during Rain")], "q int, text string")
    rows = [(1, 0, 100.0, 130.0, "x", [], 0.5, None), (1, 1, 400.0, 420.0, "x", [], 1.0, None), (2, 0, 3600.0, 3610.0, "at first", [], 0.4, None), (2, 1, 30.0, 40.0, "", [], 0.1, None), (3, 0, 0.0, 50.0, None, None, None, None)]
    cands = spark.createDataFrame(rows, "q int, nth int, start_s double, end_s double, description string, names array<string>, relevance double, event_start double")
    got = {r["q"]: tuple(r)[1:] for r in grounding.ground(asked, cands, "q").collect()}
    assert got == {1: ("at_time", 100.0, 130.0, 0.5, True, 0), 2: ("first_occurrence", 3600.0, 3610.0, 0.36, True, 0), 3: (None, 0.0, 50.0, 0.5, True, 0), 4: ("during_event", 0.0, 60.0, 0.0, False, None)}


def test_grounding_metrics(spark):
    rows = [(1, 1, 0.0, 10.0, 0.0, 10.0), (1, 2, 0.0, 5.0, 0.0, 10.0), (2, 1, 0.0, 2.0, 0.0, 10.0), (2, 2, 0.0, 6.0, 0.0, 10.0), (2, 3, 0.0, 10.0, 0.0, 10.0), (3, 1, 20.0, 30.0, 0.0, 10.0), (3, 2, 0.0, 1.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "q int, rank int, start_s double, end_s double, true_start double, true_end double")
    r = grounding.grounding_metrics(df, 4, "q", "rank").first()
    assert (round(r["mean_iou"], 6), r["mrr"], r["recall"], r["rank1_share"], r["n_queries"]) == (round((1 + 0.2 + 0.6 + 0 + 0.1) / 5, 6), (1 + 0.5 + 0.5) / 4, 0.5, 0.5, 4)
    assert tuple(grounding.grounding_metrics(df.limit(0), 0, "q", "rank").first()) == (0.0, 0.0, 0.0, 0.0, 0)


def test_no_side_is_broadcast(spark):
    """Both sides of every join grow with the table; what was read many times is a written table, so the plan stays short."""
    span = "movie_id string, {} s0 double, s1 double"
    scenes = spark.createDataFrame([("m", "s0", 0.0, 9.0, "d"), ("m", "s1", 50.0, 60.0, "d")], span.format("scene_id string,") + ", description string")
    scripts = spark.createDataFrame([("m", "u0", 0, 1.0, 8.0, "h", "full", 0.5)], "movie_id string, uid string, nth int, c0 double, c1 double, heading string, anchor_quality string, confidence double")
    clips = spark.createDataFrame([("m", "s0", "c0", 0, "t")], "movie_id string, scene_id string, clip_id string, nth int, description string")
    chunks = spark.createDataFrame([("m", "k0", 0, "c0", "u0", 0.0, 9.0)], "movie_id string, chunk_id string, nth int, clip_id string, uid string, k0 double, k1 double")
    out = subscenes.subscenes(scenes, scripts, clips, chunks, width=5.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Scan ") <= 4
    assert {(r["scene_id"], r["overlap_seconds"], r["is_canonical"]) for r in out.collect()} == {("s0", 7.0, True), ("s1", 0.0, False)}
