"""Personal data: base kinds against the plain patterns, added kinds by example, odd tables."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesig.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in twice) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


@settings(deadline=None, max_examples=600)
@given(st.one_of(st.text(alphabet="aZ.@-_+%é ", max_size=40), st.text(alphabet="0123459. -+()x漢", max_size=60),
                 st.text(alphabet="1a@.+- 7", max_size=60)))
def test_base_kinds_match_the_patterns(text):
    assert base(text) == plain(text)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "a.b@c.de", "@x.y", "1.2.3.4",
                                 "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (663) 555-6869", "+12", "+4930123456", " ", "-", ".", "é", "0",
                                 "x@y@z.w", "  ", "12345678901234567890"]), max_size=12))
def test_joined_pieces_match_the_patterns(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


def test_every_document_matches_the_patterns(spark, docs):
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    total = 0
    for r in rows:
        want = plain(r["text"])
        mine = got[r["doc_id"]]
        assert [mine[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        joined = ",".join(":".join(map(str, s)) for s in want)
        assert mine["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert mine["spans"].startswith(joined)
        total += len(want)
    assert total


@pytest.mark.parametrize("text,kind,value", [
    ("see https://ann:pw@example.org:8080/x", "address", "https://ann:pw@example.org:8080"),
    ("SSH://root@localhost now", "address", "SSH://root@localhost"),
    ("write mailto:root@localhost.", "address", "mailto:root@localhost"),
    ("call tel:555-0123-456.", "address", "tel:555-0123-456"),
    ("ann.b [at] example [dot] org!", "address", "ann.b [at] example [dot] org"),
    ("é ann(AT)example.org", "address", "ann(AT)example.org"),
    ("IBAN: DE89 3704 0044 0532 0130 00.", "account", "DE89 3704 0044 0532 0130 00"),
    ("iban gb29NWBK60161331926819", "account", "gb29NWBK60161331926819"),
    ("Account no. 1234-567890", "account", "1234-567890"),
    ("SSN 123-45-6789,", "account", "123-45-6789")])
def test_added_kinds(text, kind, value):
    assert [text[a:b] for k, a, b in pii.spans(text) if k == kind] == [value]


@pytest.mark.parametrize("text", ["https://example.org/a@b", "see http://example.org", "accounting 1234567", "iban DE00 3704 0044 0532 0130 00",
                                  "SSN 000-45-6789", "SSN 123-45-67890", "an account of 1920", "look at home.example", "account 12345",
                                  "hotel:1234567", "meet me (at) noon", "ssn", "iban", "mailto:", "@", "+", ""])
def test_clean_texts(text):
    assert pii.spans(text) == []


LONG_TEXTS = [lambda n: "1" * n, lambda n: "1." * n, lambda n: "a" * n + "@", lambda n: "a@" * n, lambda n: "+1" + "(" * n,
              lambda n: "+1 " * n, lambda n: "1 " * n, lambda n: "account " * n, lambda n: "a@b." * n, lambda n: "a.b@c.d 1.2.3.4 " * n]


@pytest.mark.parametrize("make", LONG_TEXTS)
def test_long_texts_take_linear_time(make):
    assert base(make(500)) == plain(make(500))
    begin = time.process_time()
    pii.spans(make(200_000))
    assert time.process_time() - begin < 20  # a square would take hours


def test_redaction():
    text = "é mail a.b@c.de, ip 1.2.3.4; mailto:a@b.c"
    assert pii.masked(text, pii.spans(text)) == "é mail [email], ip [ip]; [address]"


def test_odd_rows(spark, odd, empty):
    rows = pii.report(odd).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 2 and all(r["spans"] == "" for r in rows)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.report(empty).collect() == [] and pii.redact(empty).collect() == []
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    df = spark.createDataFrame([(1, "x@y.z", "a"), (1, "x@y.z", "b"), (2, None, "c")], "doc_id long, text string, spans string")
    assert sorted((r["doc_id"], r["n_email"], r["spans"]) for r in pii.report(df).collect()) == [
        (1, 1, "email:0:5"), (1, 1, "email:0:5"), (2, 0, "")]
    assert sorted(map(str, pii.redact(df).select("text").collect())) == ["Row(text='[email]')", "Row(text='[email]')", "Row(text=None)"]
