"""Entities resolved by name, worked out by hand."""

from filmloom.operators import entities, grading


def resolved(spark, kind, names):
    df = spark.createDataFrame([("m", n) for n in names] + [(None, "X Y")], "movie string, name string")
    return {r["name"]: (r["canonical"], r["preferred"], r["n_aliases"]) for r in entities.resolve(df, "movie", "name", kind).collect()}


def test_characters(spark):
    got = resolved(spark, "Character", ["JOHN SMITH", "John", "Mr. John Smith", "JOHN SMITH (O.S.)", "MARY", "Mary Jones", "Mary Ann", "The Man", "Dr.", "J. Smith", "A man", "", None, "Narrator's Guy"])
    smith = ("JOHN SMITH", "JOHN SMITH (O.S.)", 5)
    assert got["JOHN SMITH"] == got["Mr. John Smith"] == got["JOHN SMITH (O.S.)"] == got["John"] == got["J. Smith"] == smith
    assert got["MARY"] == ("MARY", "MARY", 1) and got["Mary Ann"] == ("MARY ANN", "Mary Ann", 1)  # two could be meant
    assert got["Dr."] == ("DR", "Dr.", 1)
    assert "The Man" not in got and "A man" not in got and "" not in got and got["Narrator's Guy"][0] == "NARRATOR GUY"


def test_places(spark):
    got = resolved(spark, "Location", ["INT. KITCHEN - DAY", "Kitchen", "Old kitchen of the big house", "GARDEN", "Back garden night", "Hall"])
    assert got["INT. KITCHEN - DAY"][0] == "KITCHEN" and got["Kitchen"][0] == "KITCHEN"  # its only holder has four words more
    assert got["GARDEN"] == got["Back garden night"] == ("BACK GARDEN", "Back garden night", 2)
    assert got["Kitchen"][1] == "INT. KITCHEN - DAY" and "Hall" not in got


def test_names_are_found_once(spark):
    """The steps after the first read a written table, not the names' source again."""
    df = spark.createDataFrame([("g", "Dr Anna Bell"), ("g", "Bell"), ("g", "Tom")], "g string, name string")
    out = entities.resolve(df, "g", "name", "Character")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan
    assert {(r["name"], r["canonical"]) for r in out.collect()} == {("Dr Anna Bell", "ANNA BELL"), ("Bell", "ANNA BELL"), ("Tom", "TOM")}


def test_scenes_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(grading, "PART", 10)
    rows = [(i % 3, "ab"[i % 2], i % 20) for i in range(120)]
    out = grading.groups_of_entity(spark.createDataFrame(rows, "e int, g string, s int"), "e", "g", "s")
    assert "RepartitionByExpression [s" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ", 12" in plan
    assert {(r["e"], r["g"]): r["scene_count"] for r in out.collect()} == {(e, g): len({r[2] for r in rows if r[:2] == (e, g)}) for e, g, _ in rows}
