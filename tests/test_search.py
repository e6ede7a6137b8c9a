"""Search and chunks in pieces whose size does not follow the table's."""

import math
import random

from filmloom.operators import search, timeline


def test_topk_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "ROWS", 20, raising=False)
    vectors = {i: [float(i % 7), float(i % 5)] for i in range(300)}  # many equal scores
    df = spark.createDataFrame([(i, i % 3, v) for i, v in vectors.items()], "vec_id long, label int, embedding array<float>")
    out = search.topk_batch(df, df.where("vec_id % 50 = 0"), 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(vec_id" in plan and ", 15)" in plan  # 300 rows in batches of about 20
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in best]


def test_greedy_chunks_cut_at_gaps(spark):
    df = spark.createDataFrame([("x", 100.0 * i + j, 100.0 * i + j + 1) for i in range(5) for j in range(4)], "m string, s double, e double")
    out = timeline.greedy_chunks(df, ["m"], "s", "e", 3.0)
    assert "_cut" in out._jdf.queryExecution().optimizedPlan().toString()  # groups are cuts of a key, not keys
    got = [tuple(r) for r in out.orderBy("chunk").collect()]
    assert got == [("x", 2 * i + h, 100.0 * i + 3 * h, 100.0 * i + 3 * h + (1 if h else 3), 1 if h else 3) for i in range(5) for h in (0, 1)]


def _vectors(spark, n=260):
    r = random.Random(9)
    rows = [(i * 4 % 1000, i % 3, [r.uniform(-1, 1) for _ in range(6)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), {i: (g, v) for i, g, v in rows}


def test_windows_and_shares_shuffle_no_scores(spark, monkeypatch):
    """Scores of all pairs leave the product's task as results: no exchange by query lies above it."""
    monkeypatch.setattr(search, "ROWS", 20)
    monkeypatch.setattr(search, "BLOCK", 2)
    df, known = _vectors(spark, 240)
    asked = df.where("vec_id % 100 = 0")
    sim = {(q, i): round(sum(a * b for a, b in zip(known[q][1], v)), 4) for q in known if q % 100 == 0 for i, (_, v) in known.items()}
    for out in (search.windowed_scores(df, asked, 3), search.softmax_scores(df, asked, 0.5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Window" not in plan[: plan.index("MapInArrow")]
        rows = out.collect()
        assert len(rows) == len(sim)
        for row in rows:
            q, i = row["query_id"], row["vec_id"]
            own = sorted(k for k, (g, _) in known.items() if g == known[i][0])
            at = own.index(i)
            if "around" in out.columns:
                near = [sim[q, k] for k in own[max(0, at - 3) : at + 4]]
                assert abs(row["sim"] - sim[q, i]) < 1e-9 and abs(row["around"] - sum(near) / len(near)) < 1e-9
            else:
                assert abs(row["p"] - math.exp(sim[q, i] * 2) / (sum(math.exp(sim[q, k] * 2) for k in own) + 1e-8)) < 1e-9


def test_nearest_within_sends_a_pair_of_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 20)
    monkeypatch.setattr(search, "BLOCK", 7)
    df, known = _vectors(spark, 240)
    out = search.nearest_within(df, "label")
    assert "sequence(_side" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) or "sequence(0, _side" in plan
    got = {r["vec_id"]: (r["nearest"], r["score"]) for r in out.collect()}
    for i, (g, v) in known.items():
        best = min((-round(sum(a * b for a, b in zip(v, w)), 4), k) for k, (h, w) in known.items() if h == g and k != i)
        assert got[i] == (best[1], -best[0])
