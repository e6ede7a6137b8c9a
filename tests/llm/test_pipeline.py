"""The stages of the corpus pipeline, each on what the one before kept, against brute force."""

import collections
import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from filmloom.llm import mixing, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage leaves; the first also gets repeated rows, null ids, texts and sources."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.where("doc_id < 30").union(docs.where("doc_id = 3")).union(docs.where("doc_id BETWEEN 40 AND 44").selectExpr("CAST(NULL AS LONG)", "text", "lang", "CAST(NULL AS STRING)", "n_chars")).union(docs.where("doc_id = 5").selectExpr("1000 + doc_id", "CAST(NULL AS STRING)", "lang", "source", "n_chars"))
    docs = docs.union(odd)
    out, rows = [docs.collect()], docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).persist()
        out.append(rows.collect())
    return out


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def test_quality_rules(kept, spark):
    """The SQL of the rules judges the texts, each once; a row stays if its text does."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    good = {r[0] for r in con.sql(f"SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality.OP4_SQL}) WHERE kept)").fetchall()}
    assert sorted(map(str, kept[1])) == sorted(str(r) for r in kept[0] if r["text"] in good) and len(kept[1]) < len(kept[0])


def test_exact_dedup(kept):
    groups = collections.defaultdict(list)
    for r in kept[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    want = [min(g, key=lambda r: (-len(r["text"] or ""), *key(r))) for g in groups.values()]
    assert sorted(map(str, kept[2])) == sorted(map(str, want)) and len(kept[2]) < len(kept[1])


def test_near_dedup(kept):
    rows = kept[2]
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    best: dict = {}
    for i, r in enumerate(rows):
        c = root(i)
        if c not in best or key(r) < key(best[c]):
            best[c] = r
    assert sorted(map(str, kept[3])) == sorted(map(str, best.values())) and len(kept[3]) < len(rows)


def test_mixing(kept, spark):
    taken = {}
    for r in mixing.mix(spark.createDataFrame(kept[3]), carry=["text"]).collect():
        taken[r["doc_id"], r["text"]] = r["copies"]
        assert r["taken"] == r["copies"] * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) <= 2 * r["size"]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept[4]) == {k: n for k, n in taken.items() if n}


def test_packing(kept):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in kept[4]:
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in kept[5]) == want
    places = collections.defaultdict(list)
    for r in kept[5]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n in p) <= 2048


def test_run_gives_the_stages_rows(kept, spark, tmp_path):
    spark.createDataFrame(kept[0]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pick = lambda rows: collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert pick(got) == pick(kept[5])
