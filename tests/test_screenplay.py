"""Screenplays against a loop over lines, read from files in parts, and with all lines in one key."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filmloom.operators import ranges
from filmloom.sources import screenplay

SAMPLE = """FADE IN:

1   INT. KITCHEN - NIGHT

JOHN stands by the window. It rains.
                    JOHN (O.S.)
          Who is there?
          Nobody.
He turns.
                    MR. X
                    MARY
          (softly)

          Only me.
\x0cEXT. GARDEN. LATER
     int/ext. not a heading?
                    THIS IS A VERY LONG LINE OF CAPITALS THAT IS NO NAME
  12 I/E CAR - DAY
                    ANNA
"""


def parsed(text):
    """(kind, character, text, scene number, scene) of each block, line after line."""
    out, scene, who, speech, buf = [], 0, None, False, []

    def end():
        if buf:
            out.append(("Dialogue" if speech else "Action", who if speech else None, " ".join(buf), None, scene))
            buf.clear()

    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        if re.match(r"^\s*(\d+)?\s*(INT\.?|EXT\.?|INT/EXT\.?|EXT/INT\.?|I/E)\s*[\.\-\s].{2,}", line, re.I):
            end()
            m = re.match(r"^\s*(\d+)?\s*((?:INT|EXT|INT/EXT|EXT/INT|I/E).+)", line, re.I)
            scene, who, speech = scene + 1, None, False
            out.append(("SceneHeading", None, m[2].strip(), int(m[1]) if m[1] else None, scene))
            continue
        lead = len(line) - len(line.lstrip())
        if 10 <= lead <= 45 and s == s.upper() and re.search("[A-Z]", s) and len(s) <= 42 and len(s.split()) <= 5 and ("." not in s[1:] or "(" in s):
            end()
            who, speech = s, True
            continue
        if speech and lead < 8:
            end()
            who, speech = None, False
        buf.append(s)
    end()
    return out


def invented(n):
    r = random.Random(n)
    line = lambda: r.choice(["INT. ROOM - DAY", " 7 EXT. ROAD", "", "  ", "He walks on.", " " * 12 + "JOHN", " " * 20 + "THE OLD MAN", " " * 10 + "Come in, please.", " " * 9 + "now", "CUT TO:", " " * 30 + "A.B.", "ext - x"])
    return "\n".join(line() for _ in range(n))


def found(df):
    return [(r["kind"], r["character"], r["text"], r["scene_num"], r["scene"]) for r in df.orderBy("at").collect()]


@pytest.mark.parametrize("size", [4, 8192])
def test_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(ranges, "SIZE", size)
    texts = {"a": SAMPLE, "b": invented(150), "c": invented(60), "d": "no scene at all", "e": " \n"}
    rows = [(k, i, x) for k, t in texts.items() for i, x in enumerate(t.splitlines())] + [("e", 1, None)]
    got = screenplay.blocks(spark.createDataFrame(rows, "k string, place long, line string"), "k")
    for k, t in texts.items():
        assert found(got.where(F.col("k") == k)) == parsed(t)
    assert ("Dialogue", "MARY", "(softly) Only me.", None, 1) in parsed(SAMPLE)


def test_files_in_parts(spark, tmp_path):
    texts = {f"{i}.txt": t for i, t in enumerate([SAMPLE, invented(3000), invented(1500).replace("\n", "\r\n")])}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = screenplay.read_lines(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
        got = screenplay.blocks(lines, "path").withColumn("name", F.substring_index("path", "/", -1)).persist()
        for name, t in texts.items():
            assert found(got.where(F.col("name") == name)) == parsed(t)
        got.unpersist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scenes_and_their_times(spark):
    rows = [("a", i, x) for i, x in enumerate(SAMPLE.splitlines())]
    got = screenplay.scenes(screenplay.blocks(spark.createDataFrame(rows, "k string, place long, line string"), "k"), "k")
    got = screenplay.linear_times(got, "k", F.lit(600.0)).orderBy("scene").collect()
    want, all_ = parsed(SAMPLE), 0
    size = {s: sum(len(b[2]) for b in want if b[4] == s) for s in {b[4] for b in want} if s}
    total = sum(size.values())
    for r in got:
        assert (r["n_chars"], r["chars_before"]) == (size[r["scene"]], all_)
        assert r["start_s"] == pytest.approx(all_ / total * 600) and r["end_s"] == pytest.approx((all_ + size[r["scene"]]) / total * 600)
        all_ += size[r["scene"]]
    assert [(r["heading"], r["scene_num"]) for r in got] == [(b[2], b[3]) for b in want if b[0] == "SceneHeading"]
