"""Forms of personal values that differ from those in the test tables."""

import re

import pytest

from filmloom.llm import pii

ONE = {
    "card": ["3782 822463 10005", "378282246310005", "6304 0000 0000 0000 000", "4111 1111-1111 1111", "41 11 11 11 11 11 11 11", "4222222222222", "4111-1111-1111-1111"],
    "phone": ["(663) 555-6869", "663-555-6869", "663.555.6869", "1-663-555-6869", "+44 20 7946 0958", "+33 1 23 45 67 89", "+1 (264) 555-5961", "+49 (30) 901820"],
    "date": ["2024-5-1", "1/2/2024", "05/13/2024", "5/13/2024", "31/12/1999", "2024-02-29"],
    "secret": ["0123456789ABCDEF" * 2, "0123456789abcdef" * 2],
}
TEXTS = {
    "at 2024-05-01T10:00:00Z": ["date"],
    "05 4111 1111 1111 1111 and": ["card"],
    "4111 1111 1111 1111 5500 0000 0000 0004": ["card", "card"],
    "4111 1111 1111 1111 05": ["card"],
    "4111111111111111 123-45-6789 4111 1111 1111 1111 10.20.30.40": ["card", "ssn", "card", "ip"],
    "12 2024-05-01 2024-05-02 call +44 20 7946 0958 4111 1111 1111 1111": ["date", "date", "phone", "card"],
    "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20": [],
    "4111111111111112 3782 822463 10006 13/13/2024 2024-02-30 555-6869 v1.2.3": [],
}


@pytest.fixture(scope="module")
def found(spark):
    texts = [v for vs in ONE.values() for v in vs] + list(TEXTS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {texts[r["doc_id"]]: r for r in pii.pseudonymise(docs, key="k").collect()}


@pytest.mark.parametrize("kind", ONE)
def test_one_value(found, kind):
    for v in ONE[kind]:
        r = found[v]
        assert (v, r["found"], r["n_found"]) == (v, [kind], 1) and r["text"] != v
        if kind != "secret" and not re.search(r"\b\d\b", v):
            assert re.sub(r"\d", "0", r["text"]) == re.sub(r"\d", "0", v)
    if kind == "phone":
        assert found["+44 20 7946 0958"]["text"][:4] == "+44 " and found["+33 1 23 45 67 89"]["text"][:4] == "+33 "
    if kind == "date":
        assert all(int(found[v]["text"].split("/")[1]) > 12 for v in ("05/13/2024", "5/13/2024"))
    if kind == "secret":
        assert re.fullmatch("[0-9A-F]{32}", found["0123456789ABCDEF" * 2]["text"])


@pytest.mark.parametrize("text", TEXTS)
def test_in_text(found, text):
    assert found[text]["found"] == TEXTS[text]
    assert (found[text]["text"] == text) == (not TEXTS[text])
