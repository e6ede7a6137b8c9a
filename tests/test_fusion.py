"""Fused scenes against a loop over the hits."""

import random

from filmloom.operators import fusion

IDS = ("scene_group_id", "script_scene_uid", "parent_scene_id", "subscene_id", "chunk_id", "clip_id")
TEXT = ("scene_group_type", "movie_id", "heading", "location", "path", "cue")
SHAPE = "q int, source string, rank int, score double, scene_score double, start_s double, end_s double, characters array<string>, script_characters array<string>, " + ", ".join(f"{c} string" for c in IDS + TEXT)


def hits():
    r = random.Random(12)
    some = lambda *x: r.choice([None, "", *x])
    rows = []
    for q in range(12):
        for source in ("visual", "script"):
            for rank in range(r.choice([0, 5, 15])):
                row = {c: some(*(f"{c}{k}" for k in range(2))) if r.random() < 0.6 else None for c in IDS}
                row |= {c: some(f"{c}{r.randrange(3)}") for c in TEXT}
                score = r.choice([None, 0.2, 0.5, 0.5, 0.9])
                start = r.choice([None, float(r.randrange(50))])
                rows.append((q, source, rank, score, r.choice([None, 0.0, 0.6]), start, start and start + 5, r.choice([None, ["b", "a"], ["c", ""]]), r.choice([[], ["x"]]), *row.values()))
    return rows


def fused(rows):
    out: dict = {}
    names = [x.split()[0] for x in SHAPE.split(", ")]
    for row in sorted((dict(zip(names, r)) for r in rows), key=lambda h: (h["source"] != "visual", h["rank"])):
        if row["rank"] >= 12:
            continue
        h, visual = {k: v or None for k, v in row.items() if k != "rank"} | {"rank": row["rank"]}, row["source"] == "visual"
        kinds = {"script_scene_uid": "script_scene", "parent_scene_id": "semantic_scene", "subscene_id": "script_subscene", "chunk_id": "chunk", "clip_id": "clip"}
        if h["scene_group_id"]:
            key, kind = h["scene_group_id"], h["scene_group_type"] or "scene"
        else:
            c = next((c for c in kinds if h[c]), None)
            key, kind = (f"{kinds[c]}::{h[c]}", kinds[c]) if c else (f"{row['source']}::{row['rank']}", "candidate")
        s = out.setdefault(key, dict(kind=kind, v=0.0, s=0.0, scene=0.0, nv=0, ns=0, frame=None, best=-1.0, frames=[], cues=[], chars=set(), clips=set(), subs=[], movie=None, heading=None, start=None))
        score = h["score"] or 0.0
        s["v" if visual else "s"] = max(s["v" if visual else "s"], score)
        s["nv" if visual else "ns"] += 1
        s["movie"], s["heading"] = s["movie"] or h["movie_id"], s["heading"] or h["heading"]
        s["chars"] |= {c for c in h["characters"] or [] if c and visual}
        s["clips"] |= {h["clip_id"]} - {None}
        if row["start_s"] is not None:
            s["start"] = row["start_s"] if s["start"] is None else min(s["start"], row["start_s"])
        if visual and h["cue"] and h["cue"] not in s["cues"]:
            s["cues"].append(h["cue"])
        if visual:
            s["scene"] = max(s["scene"], h["scene_score"] or 0.0)
            if h["path"]:
                s["frames"] += [h["path"]] if h["path"] not in s["frames"] else []
                if score >= s["best"]:
                    s["frame"], s["best"] = h["path"], score
        elif h["heading"] or row["start_s"] is not None:
            s["subs"].append(h["subscene_id"])
    rank = lambda s: (max(0.6 * s["v"] + 0.4 * s["s"], s["scene"]), s["v"], s["s"], s["nv"], s["ns"])
    return sorted(out.items(), key=lambda x: rank(x[1]), reverse=True)[:6], rank


def test_fuse(spark):
    rows = hits()
    got = fusion.fuse(spark.createDataFrame(rows, SHAPE), "q").collect()
    for q in range(12):
        want, rank = fused([r for r in rows if r[0] == q])
        mine = sorted((g for g in got if g["q"] == q), key=lambda g: g["place"])
        assert [(g["id"], g["kind"]) for g in mine] == [(k, s["kind"]) for k, s in want]
        for g, (_, s) in zip(mine, want):
            assert abs(g["score"] - rank(s)[0]) < 1e-12 and g["evidence_count"] == s["nv"] + s["ns"]
            assert (g["frame"], g["frames"], g["cues"], g["movie_id"], g["heading"]) == (s["frame"], s["frames"], s["cues"], s["movie"], s["heading"])
            assert (g["characters"], g["clip_ids"], g["subscenes"], g["start_s"]) == (sorted(s["chars"]), sorted(s["clips"]), s["subs"][:4], s["start"])
    assert fusion.fuse(spark.createDataFrame([], SHAPE), "q").count() == 0
