"""Long runs of numbers and domains of many labels: the patterns need no stack for them and find what plain ones find."""

import random
import re

import pytest

from filmloom.llm import pii

# The same languages with groups that Java repeats by recursion.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"(?<![\w])(?:\d(?: ?\d){12,}(?![\w]|[./-]\d)|\d(?:-?\d){12,}(?![\w/]|\.\d)|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w]))"
LABELS = "a@" + "b." * 20_000 + "com"
RUNS = {"spaces": "1 " * 10_000, "hyphens": "1-" * 10_000 + "1", "cards": "4111 1111 1111 1111 " * 1_000, "domain": LABELS, "no domain": LABELS[:-2]}


@pytest.mark.parametrize("name", RUNS)
def test_patterns_need_no_stack(spark, name):
    found = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pii.ANY).matcher(RUNS[name])
    assert found.find() == (name != "no domain")  # a StackOverflowError here would end an executor
    if name != "no domain":
        assert found.group() == RUNS[name].rstrip()


@pytest.mark.parametrize(("new", "plain", "pieces"), [(pii.CARD, CARD, ["1", "12", "1234", "1234567890123", " ", "-", " 1", "-12", " 1234", "-1", "a", "_", "/", ".", "  "]), (pii.EMAIL, EMAIL, ["a", "b1", "@", "a@", "-", ".", "..", ".ab", ".a", ".1", ".ab1", ".abc", " "])])
def test_same_matches_as_plain_patterns(new, plain, pieces):
    rnd, n = random.Random(9), 0
    for _ in range(20_000):
        s = "".join(rnd.choices(pieces, k=rnd.randint(2, 24)))
        spans = [m.span() for m in re.finditer(plain, s, re.ASCII)]
        assert (s, [m.span() for m in re.finditer(new, s, re.ASCII)]) == (s, spans)
        assert all(re.fullmatch(new, s[a:b], re.ASCII) for a, b in spans)
        n += len(spans)
    assert n > 1_000


def test_texts_with_long_runs(spark):
    texts = [f"{RUNS[k]} c@d.com" for k in RUNS]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), key="k").collect()}
    email = out[0]["text"].split()[-1]
    want = [["email"], ["email"], ["card"] * 1_000 + ["email"], ["email"] * 2, ["email"]]
    for i, (name, text) in enumerate(RUNS.items()):
        assert (name, out[i]["found"], out[i]["n_found"]) == (name, want[i], len(want[i]))
        assert out[i]["text"].endswith(f" {email}")
        if name in ("spaces", "hyphens", "no domain"):
            assert out[i]["text"] == f"{text} {email}"
    card = out[2]["text"][:19]
    assert card != "4111 1111 1111 1111" and re.fullmatch(r"(\d{4} ){3}\d{4}", card)
    assert out[2]["text"] == f"{card} " * 1_000 + f" {email}"
