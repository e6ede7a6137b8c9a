"""Readers of caption data sets, annotations and subtitles on small files."""

import json

from filmloom.sources import captions, subtitles


def put(folder, name, what):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(what if isinstance(what, str) else json.dumps(what))
    return str(folder)


def brief(df):
    return sorted((r["chunk_id"], r["video_id"], r["start_seconds"], r["end_seconds"], r["text"], r["split"]) for r in df.collect())


def test_captions(spark, tmp_path):
    path = put(tmp_path / "list", "all.json", [{"video_id": "v1", "caption": "a man", "split": "test"}, {"caption": "no id"}, {"video_id": "v2", "caption": ""}, {"video_id": "v3"}])
    assert brief(captions.read_caption_list(spark, path, "set", "p")) == [("p_v1_00000", "v1", 0.0, 10.0, "a man", "test"), ("p_video1_00001", "video1", 0.0, 10.0, "no id", "train")]
    path = put(tmp_path / "map", "all.json", {"v1": {"sentences": ["one", "", "three", "four"], "timestamps": [[0, 1.5], [2, 3], [4]]}, "v2": {"sentences": ["x"]}, "v3": {}})
    assert brief(captions.read_caption_map(spark, path, "set", "p")) == [("p_v1_0000", "v1", 0.0, 1.5, "one", None)]
    path = put(tmp_path / "seg", "db.json", {"version": 1, "database": {"v": {"subset": "val", "duration": 9.0, "annotations": [{"segment": [1.239, 4], "label": "run"}, {"segment": [1], "label": "x"}]}, "w": {"annotations": []}}})
    assert brief(captions.read_segments(spark, path, "set", "an")) == [("an_v_00000123", "v", 1.239, 4.0, "run", "val")]
    put(tmp_path / "bad", "all.json", "{ no json")
    assert captions.read_caption_list(spark, f"{tmp_path}/bad", "set", "p").count() == 0


def test_moments_and_their_truth(spark, tmp_path):
    put(tmp_path / "m", "train_data.json", [{"dl_link": "https://x/?id=77&y", "description": "a dog", "times": [[0, 5], [5, 10], [1]]}, {"description": "no link", "times": [[1, 2]]}])
    path = put(tmp_path / "m", "test_data.json", [{"dl_link": "id=77", "description": "again", "times": [[2, 3]]}])
    got = captions.read_moments(spark, path, "set", "d")
    assert brief(got) == [("d_77_0000", "77", 0.0, 5.0, "a dog", "train"), ("d_77_0000", "77", 2.0, 3.0, "again", "test"), ("d_77_0001", "77", 5.0, 10.0, "a dog", "train"), ("d__0000", "", 1.0, 2.0, "no link", "train")]
    (truth,) = captions.ground_truth(got).collect()
    assert (truth["video_id"], truth["n_moments"], [tuple(m) for m in truth["moments"]]) == ("77", 3, [(0.0, 5.0, "a dog"), (2.0, 3.0, "again"), (5.0, 10.0, "a dog")])


def test_annotation_scenes(spark, tmp_path):
    put(tmp_path / "a", "tt1.json", {"fps": 25, "scene": [{"frame": [0, 50], "shot": [0, 2], "place_tag": "bar"}, {"frame": [1], "shot": [2, 3]}, {"frame": [50, 101], "shot": [2, 4], "action_tag": "run"}]})
    path = put(tmp_path / "a", "tt2.json", {"scene": [{"frame": [24, 48], "shot": [0, 1]}]})
    got = sorted((tuple(r) for r in captions.read_annotation_scenes(spark, path).collect()), key=str)
    assert got == [("tt1", 0, 0, 2, 0.0, 2.0, 2.0, "bar", None), ("tt1", 2, 2, 4, 2.0, 4.04, 2.04, None, "run"), ("tt2", 0, 0, 1, 1.0, 2.0, 1.0, None, None)]


def test_subtitle_variants(spark, tmp_path):
    text = "1\n00:00:01,500 --> 00:00:02,000\n<i>Hi</i> [MAN:] there\n\n2\nnote\n00:00:03,000 --> 00:00:04,000\n12\nBye\n\n00:00:05,000 --> 00:00:06,250\nno number\n\n\n4\n00:00:07,000-->00:00:08,000\ntight\n"
    path = put(tmp_path / "s", "a.srt", text.replace("\n", "\r\n"))
    brief = lambda df: [(r["start_s"], r["end_s"], r["text"]) for r in df.orderBy("position").collect()]
    assert brief(subtitles.read_script_subtitles(spark, path)) == [(1.5, 2.0, "Hi there"), (7.0, 8.0, "tight")]
    assert brief(subtitles.read_aligner_subtitles(spark, path)) == [(1.5, 2.0, "Hi [MAN:] there"), (3.0, 4.0, "note Bye"), (5.0, 6.25, "no number")]
    cues = spark.createDataFrame([("m", 3661.0, 3662.5, "later"), ("m", 0.001, 2.0, "first"), ("m", 5.0, 6.0, ""), ("n", 1.0, 2.0, None)], "k string, s double, e double, t string")
    got = {r["k"]: r["srt"] for r in subtitles.subtitle_files(cues, "k", "s", "e", "t").collect()}
    assert got == {"m": "1\n00:00:00,001 --> 00:00:02,000\nfirst\n\n3\n01:01:01,000 --> 01:01:02,500\nlater\n", "n": ""}
