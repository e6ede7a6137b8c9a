"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filmloom.llm import exact_dedup, lm_scoring, mixing, ngram_join, packing, pii, quality, suffix_dedup, token_counts, url_filter

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, kept boolean, n long, _id int, key string, size int"


def texts() -> list:
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    base = [" ".join(word() for _ in range(r.choice([3, 20, 90, 150]))) for _ in range(30)]
    near = []
    for t in base[:12]:
        w = t.split()
        for k in (1, 3, 6):
            v = list(w)
            for _ in range(min(k, len(v))):
                v[r.randrange(len(v))] = word()
            near.append(" ".join(v))
    odd = [None, "", "  \n", "A b", "a  B", "a\x1cb", "x" * 30000, base[0] * 3, "<|endoftext|> a <|endoftext|>", "it's  we'll\n\nß", " lead", "trail "]
    return base + base[:6] + near + odd + [None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x, None if i % 7 == 0 else f"s{i % 3}", True, i, 1, "k", 2) for i, x in enumerate(t)] + [(None, "null id here now", "s0", None, None, None, None, None)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def words(t):
    return t.encode().lower().split()


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in plain(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    got = exact_dedup.exact_groups(docs, widths=(2, 8)).collect()
    want = sorted((str(m[3]), str(min(g)[3]), len(g)) for g in groups.values() for m in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.keep_one_of_equal(docs).count() == len(groups) and exact_dedup.keep_one_of_equal(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(BYTE)
    want = sorted((str(i), len(x.encode()), len(t.encode(x, add_special_tokens=False))) for i, x in plain(docs))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, BYTE).collect()) == want
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_packing(docs, empty):
    t, rows = Tokenizer.from_file(WORD), packing.pack(docs, WORD, capacity=64).collect()
    want = []
    for i, x in plain(docs):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    left = []  # first-fit decreasing does no better
    for n in sorted((r["length"] for r in rows), reverse=True):
        at = next((k for k, free in enumerate(left) if free >= n), None)
        if at is None:
            left.append(64 - n)
        else:
            left[at] -= n
    assert len(bins) <= len(left)
    assert packing.pack(empty, WORD).count() == 0


def test_fullest_combination():
    counts = np.zeros(11, np.int64)
    counts[[6, 5, 4]] = [1, 2, 1]
    assert sum(n * k for n, k in packing.fullest(counts, 10)) == 10
    counts[:] = 0
    counts[7] = 3
    assert packing.fullest(counts, 10) == [(7, 1)]


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    for i, t in plain(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {p + k for p, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and r["kept"] == (r["rejected_by"] is None)
    assert quality.judge_quality(empty).count() == 0


@pytest.mark.parametrize("block", [300, lm_scoring.BLOCK_TOKENS])
def test_lm_scoring(docs, empty, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", block)
    c, arcs, n, own = collections.Counter(), collections.Counter(), 0, plain(docs)
    for i, t in own:
        if not lm_scoring.held_out(i):
            w = [0, *words(t), None]
            c.update(w[1:])
            for k in (2, 3):
                arcs.update(tuple(w[x : x + k]) for x in range(len(w) - k + 1))
            arcs[(0,)] += 1
            n += len(w) - 1
    c_of = lambda g: c[g[0]] if len(g) == 1 and g != (0,) else arcs[g]
    size = len([k for k in c if c[k]])

    def p(h, x):
        if not h:
            return (c[x] + 1) / (n + size + 1)
        return (arcs[(*h, x)] + lm_scoring.MU * p(h[1:], x)) / (c_of(h) + lm_scoring.MU)

    want = {}
    for i, t in own:
        w = [0, *words(t), None]
        steps = [(tuple(w[max(0, x - 2) : x]), w[x]) for x in range(1, len(w))]
        want[i] = len(steps), sum(c[x] > 0 for _, x in steps), sum(math.log10(p((), x)) for _, x in steps), sum(math.log10(p(h, x)) for h, x in steps)
    rows = lm_scoring.score_texts(docs).collect()
    assert len(rows) == len(own)
    for r in rows:
        k, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (k, known, n, lm_scoring.held_out(r["doc_id"]))
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and abs(r["score"] - score) < 1e-6 * max(1, -score)
    assert lm_scoring.score_texts(empty).count() == 0


def test_automaton_sums_to_one_and_follows_failure_arcs():
    words_ = np.array([lm_scoring.END, 5, 6, 7], np.uint64)
    seq, lengths = np.array([1, 2, 1, 2, 3, 0, 2, 0]), np.array([6, 2])
    row = {"ids": [i for i in range(20) if not lm_scoring.held_out(i)][:2], "lengths": lengths.astype("<i8").tobytes(), "vocab": words_.tobytes(), "seq": lm_scoring.planes(seq)}
    grams = lm_scoring.Grams(row)
    count = {k: grams.sent(k, np.zeros(9, bool))[3] for k in (1, 2, 3)}
    model = lm_scoring.Automaton(grams, count, 2.0, int(count[1].sum()), int((count[1] > 0).sum()))
    unseen = 1 / (count[1].sum() + (count[1] > 0).sum() + 1)
    for s in range(len(model.fail)):
        if s == model.one[0]:  # nothing follows an end
            continue
        _, weight = model.step(np.full(4, s), np.arange(4))
        way, at = 0.0, s
        while at:
            way, at = way + model.fail_weight[at], model.fail[at]
        assert abs((10**weight).sum() + 10**way * unseen - 1) < 1e-9
    assert model.fail[model.step(np.array([model.start]), np.array([1]))[0]] > 0  # after two words: fails to one


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(rows) == key(again) and len(rows) == docs.count()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        b = by[round(r["target"], 6), r["source_size"]]
        b[0] += r["size"]
        b[1] += r["taken"]
        b[2] = max(b[2], r["size"])
    for (target, size), (own, taken, most) in by.items():
        assert own == size and abs(taken - target) <= most
    assert mixing.take_mix(docs).count() == sum(r["copies"] for r in rows) and mixing.take_mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0
    assert mixing.targets([10, 1000], [3, 1]) == [20, 1495.0]


def test_suffix_array():
    r = random.Random(3)
    for _ in range(80):
        s = "".join(r.choice("ab" if r.random() < 0.5 else "abcdef") for _ in range(r.randrange(1, 90))).encode() * r.choice([1, 1, 3])
        assert suffix_dedup.suffix_array(np.frombuffer(s, np.uint8), 1 << 30).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(docs, empty):
    n, own = 40, plain(docs)
    c = collections.Counter(t.encode()[i : i + n] for _, t in own for i in range(len(t.encode()) - n + 1))
    want = []
    for i, t in own:
        b, cover = t.encode(), np.zeros(len(t.encode()) + 1, bool)
        for k in range(len(b) - n + 1):
            if c[b[k : k + n]] > 1:
                cover[k : k + n] = True
        kept = bytes(x for x, y in zip(b, cover) if not y)
        want.append((str(i), len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), kept))
    got = suffix_dedup.remove_repeats(docs, length=n, k=12).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_ngram_join(docs, empty):
    own, sets = plain(docs), []
    for _, t in own:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 70 * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    low = {}
    for x, (i, _) in enumerate(own):
        low[find(x)] = min([v for v in (low.get(find(x)), i) if v is not None], default=None)
    want = sorted((str(i), len(sets[x]), str(low[find(x)] if sets[x] else i)) for x, (i, _) in enumerate(own))
    got = ngram_join.link_documents(docs, width=3, percent=70).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert ngram_join.link_documents(empty).count() == 0


def test_count_r_tree_loses_nothing():
    r = np.random.default_rng(1)
    p = r.poisson(2, (300, ngram_join.GROUPS)).astype(np.int64)
    p[100:200] = np.maximum(0, p[:100] + r.integers(-1, 2, (100, ngram_join.GROUPS)) * (r.random((100, ngram_join.GROUPS)) < 0.1))
    n = p.sum(1)
    i, j = ngram_join.CountRTree(p, n, 80).join()
    got = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    assert got == {(x, y) for x in range(300) for y in range(x + 1, 300) if 180 * np.minimum(p[x], p[y]).sum() >= 80 * (n[x] + n[y])}


def test_count_vectors_bound_the_overlap():
    r, sets = np.random.default_rng(2), [np.array([5 << 7], np.uint64)]
    for n in (3, 60, 64, 300, 700, 9000):
        own = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        sets += [own, own[: n * 9 // 10], np.unique(np.concatenate([own[n // 10 :], r.integers(0, 1 << 62, 1 + n // 20).astype(np.uint64)]))]
    sets.append(np.arange(300, dtype=np.uint64) << np.uint64(22))  # all in one group of the fine ones
    vectors, n = [ngram_join.count_vector(s) for s in sets], np.array([len(s) for s in sets])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    fine = ngram_join.CountVectors([v[1] for v in vectors], n).bounds(i, j)
    coarse = np.stack([np.frombuffer(v[0], "<u4") for v in vectors]).astype(int)
    for x, y, f in zip(i, j, fine, strict=True):
        assert len(np.intersect1d(sets[x], sets[y])) <= f <= min(n[x], n[y])
        assert len(np.intersect1d(sets[x], sets[y])) <= np.minimum(coarse[x], coarse[y]).sum()
        assert x != y or f == n[x]


def test_rarest_boxes_keep_one_in_common():
    r = np.random.default_rng(3)
    for percent in (70, 80, 85):
        sets = []
        for n in (2, 5, 8, 11, 40, 200, 900) * 3:
            own = r.integers(0, 1 << 62, n).astype(np.uint64)
            for gone in (0, 0.05, 0.1, 0.2):
                part = own[int(n * gone) :]
                sets += [np.unique(part), np.unique(np.concatenate([part, r.integers(0, 1 << 62, int(n * gone) // 2).astype(np.uint64)]))]
        held = [ngram_join.boxes(s, percent) for s in sets]
        df = collections.Counter(k for keys, _, _ in held for k in keys.tolist())
        few = []
        for keys, spare, first in held:
            own = set()
            for c, n in enumerate(spare):
                ks = [k for k in keys.tolist() if k % 64 == first + c]
                own |= set(sorted(ks, key=lambda k: (df[k], k))[: len(ks) - n])
            few.append(own)
        for x, y in ((x, y) for x in range(len(sets)) for y in range(x)):
            same = len(np.intersect1d(sets[x], sets[y]))
            if 100 * same >= percent * (len(sets[x]) + len(sets[y]) - same) and same < max(len(sets[x]), len(sets[y])):
                assert few[x] & few[y]


def test_ngram_join_in_blocks(spark, monkeypatch):
    # A large group of near copies, most of whose pairs are close to the threshold, over blocks smaller than a box, and a very long text.
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 10)
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            w[r.randrange(60)] = f"x{r.randrange(100)}"
        rows.append((i, " ".join(w)))
    long = [f"y{r.randrange(10**6)}" for _ in range(20_000)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:-900])), (102, " ".join(long[:9_000]))]
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    low = {c: min(rows[x][0] for x in range(len(rows)) if root[x] == c) for c in set(root)}
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), width=4, percent=85).collect()
    assert sorted((g["doc_id"], g["component_id"]) for g in got) == sorted((rows[x][0], low[root[x]]) for x in range(len(rows)))
    assert 3 < len(low) < 60


def test_one_of_each_linked_group_stays(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (5, t + " end"), (None, t), (None, t), (5, t), (7, "a"), (7, "b"), (None, ""), (None, ""), (8, None), (9, t + " end more"), (6, "c d e f g h"), (6, "c d e f g h")]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "`a.doc` int, `text.x` string, _row int")
    got = sorted(map(str, (tuple(r)[:2] for r in ngram_join.keep_one_of_linked(docs, "a.doc", "text.x").collect())))
    assert len([g for g in got if "w0" in g]) == 1
    assert [g for g in got if "w0" not in g] == sorted(map(str, [(7, "a"), (7, "b"), (None, ""), (None, ""), (8, None), (6, "c d e f g h")]))


def test_pii(spark, empty):
    t = "a 4111-1111-1111-1111 b 2024-02-29 c 31/12/1999 d 2024-02-30 999.1.1.1 4111111111111112 123-45-6789 x.y@z.com 10.20.30.40 +1 (264) 555-5961"
    docs = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "4111-1111-1111-1111 10.20.30.40"), (5, "no values 12 here")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, key="k").collect()}
    assert (got[2]["text"], got[3]["text"], got[5]["text"]) == (None, "", "no values 12 here")
    assert got[1]["found"] == ["card", "date", "date", "ssn", "email", "ip", "phone"]
    new = got[1]["text"]
    assert "2024-02-30 999.1.1.1 4111111111111112" in new and new != t
    card = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", new)[0]
    digits = [int(c) for c in card if c != "-"][::-1]
    assert sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10
    assert got[4]["text"].startswith(card) and got[4]["text"].split()[1] in new
    assert pii.pseudonymise(empty).count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, F.lit("0")).alias("d"))
    out = df.select(pii.permute_digits(F.lit("k"), F.col("d"), "x").alias("p"))
    assert out.distinct().count() == 1000 and out.where("length(p) <> 3").count() == 0


def test_url_filter(spark):
    urls = ["http://Spam-Farm.example.org/en/1", "https://a.b.example.com/en/x?q#f", "http://www.example.com/en/", "http://x.net/fr/1", "http://x.net/de/1", "no scheme", None, "http://com", "ftp://q.org?x=/y", "http://q.org/a://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert [got[i]["verdict"] for i in range(10)] == ["block", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert [got[i]["rule"] for i in (1, 2, 3, 4)] == ["example.com/en/", "www.example.com/en/", "net/fr/", None]
    assert (got[9]["host"], got[9]["path"], got[8]["path"], got[6]["host"]) == ("q.org", "/a://b", "", "")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_bloom_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    levels = url_filter.cascade(universe, listed)
    hit = universe.where(url_filter.cascade_has(F.col("key"), levels))
    assert hit.exceptAll(listed).count() == 0 and hit.count() == listed.count()


def test_a_table_of_pieces_that_was_emptied_knows_all_texts(monkeypatch):
    from filmloom.llm import _pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [["alpha", "beta", "gamma", "delta"], ["omega", "alpha"], ["beta", "omega", "gamma"]]
    want = list(_pieces.PieceTable(path, "", counts=False).of(texts))
    monkeypatch.setattr(_pieces, "MOST_PIECES", 3)
    small = _pieces.PieceTable(path, "", counts=False)
    assert [*small.of(texts[:1]), *small.of(texts[1:])] == want and len(small.known) == 4


@pytest.mark.parametrize("most", [8, 400_000])
def test_words_are_encoded_as_the_library_does(monkeypatch, most):
    from filmloom.llm import _pieces

    monkeypatch.setattr(_pieces, "MOST_PIECES", most)
    r, t = random.Random(8), Tokenizer.from_file(WORD)
    signs = [*map(chr, range(0x20, 0x7F)), *"\t\n\r", *map(chr, range(0xC0, 0x180)), "'s", "'LL", " the "]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(90))) for _ in range(400)] + ["-" * 100, "é" * 100 + "0×_÷", "<|endoftext|>", "\u4e2d a\x1cb", ""]
    words, pieces = _pieces.WordTable(t), _pieces.PieceTable(WORD, "", counts=False)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(texts, words, pieces)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert max(len(words), len(words.older)) <= most // 2 and "-" * 100 not in words


def test_frequent_words_stay_known_while_rare_ones_fill_the_table(monkeypatch):
    from filmloom.llm import _pieces

    texts = [f"the of and {a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    monkeypatch.setattr(_pieces, "MOST_PIECES", 16)
    library, asked = Tokenizer.from_file(WORD), collections.Counter()

    class Model:
        def tokenize(self, word):
            asked[word] += 1
            return library.model.tokenize(word)

    class Counting:
        model = Model()

    words, pieces = _pieces.WordTable(Counting()), _pieces.PieceTable(WORD, "", counts=False)
    list(packing.encoded(texts, words, pieces))
    assert set(asked.values()) == {1} and len(asked) == len({w for x in texts for w in x.split()})
