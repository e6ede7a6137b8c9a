"""Graph operators against breadth-first search in plain Python."""

import random
from collections import defaultdict

from filmloom.operators import graph
from filmloom.plans import queries as _queries  # noqa: F401
from filmloom.plans.registry import QUERIES


def test_paths_over_real_parts_both_ways(spark, tmp_path):
    # Part 1,007 is not part 7, part 2 is not supplier 2, and supplier 9 is met only from the part's side; 12 is 6 hops away.
    lines = [(1, 7), (1, 7), (9, 7), (9, 2), (10, 2), (10, 3), (11, 3), (12, 1007), (11, 1007), (2, 5), (None, 7), (1, None)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 13)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    near = defaultdict(set)
    for s, p in lines:
        if s and p:
            near[f"s:{s}"].add(f"p:{p}")
            near[f"p:{p}"].add(f"s:{s}")
    want, front = {"s:1": 0}, ["s:1"]
    for i in range(1, 5):
        front = {n for f in front for n in near[f]} - set(want)
        want |= dict.fromkeys(front, i)
    got = QUERIES["graph_paths4"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want.items())
    assert want == {"s:1": 0, "p:7": 1, "s:9": 2, "p:2": 3, "s:10": 4}


def similar(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) >= min(2, len(x), len(y))


def chain(target, triples, most=4):
    """The chain as a loop over lists builds it."""
    direct = sorted((t for t in triples if similar(t[1], target)), key=lambda t: -t[2])
    events, n = [target], 0
    for t in direct[:5]:
        events.insert(0, t[0])
        n += 1
    now = [t[0] for t in direct]
    met, depth = set(now), 1
    while depth < most and now:
        new = []
        for c in now:
            for t in [t for t in triples if similar(t[1], c) and t[0] not in met][:2]:
                events.insert(0, t[0])
                n += 1
                new.append(t[0])
                met.add(t[0])
        now, depth = new, depth + 1
    return list(dict.fromkeys(events)), depth, n


def test_causal_chains(spark):
    r = random.Random(5)
    event = lambda: " ".join(r.choice(["Rain", "flood", "dam", "wind", "fire", "road", "the", "old"]) for _ in range(r.choice([1, 2, 3, 3])))
    rows = {k: [(event(), event(), r.choice([0.5, 0.7, 0.9])) for _ in range(n)] for k, n in enumerate([0, 1, 4, 9, 14, 25])}
    rows[9] = [("a b", "c d", 0.7), ("c d", "a b", 0.7), ("x", "X", 0.7)]  # cycles
    triples = spark.createDataFrame([(k, i, *t) for k, ts in rows.items() for i, t in enumerate(ts)], "doc int, nth int, cause string, effect string, confidence double")
    targets = [(k, t[1]) for k, ts in rows.items() for t in ts] + [(4, "nothing like it"), (77, "no triples")]
    got = graph.causal_chains(triples, spark.createDataFrame(targets, "doc int, target string"), "doc").collect()
    want = {(k, t): chain(t, rows[k]) for k, t in targets if rows.get(k)}
    assert {(g["doc"], g["target"]): (g["events"], g["depth"], g["n_triples"]) for g in got} == want and len(got) == len(want)
    assert max(d for _, d, _ in want.values()) == 4 and {round(g["confidence"], 9) for g in got} == {round(min(1.0, n * 0.2 + 0.2), 9) for _, _, n in want.values()}


def test_shortest_paths(spark):
    edges = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("z", "a"), (None, "a")]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",), ("a",), (None,)], "id string"), 3).collect()
    assert sorted((g["id"], g["hops"], "".join(g["path"])) for g in got) == [("a", 0, "a"), ("b", 1, "ab"), ("c", 1, "ac"), ("d", 2, "abd"), ("e", 3, "abde")]
