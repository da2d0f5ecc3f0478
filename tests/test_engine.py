"""Detection, surrogates, span algebra: literal cases and properties."""

import re

import pytest
from pyspark.sql import functions as F

from inkveil.functions import keyed
from inkveil.operators import engine, spans
from inkveil.operators.patterns import luhn, only_digits, verhoeff
from inkveil.operators.surrogates import Surrogates
from inkveil.settings import TYPES, Settings

CASES = [
    ("write to jane.roe@example.org now", "EMAIL", "jane.roe@example.org"),
    ("call +91 22 4505 4321 today", "PHONE", "+91 22 4505 4321"),
    ("SSN: 123-45-6789", "SSN", "123-45-6789"),
    ("card 4111 1111 1111 1111", "CREDIT_CARD", "4111 1111 1111 1111"),
    ("server 10.1.2.3.", "IP_ADDRESS", "10.1.2.3"),
    ("Date of birth: 14/05/1982", "DATE_OF_BIRTH", "14/05/1982"),
    ("PAN ABCPD1234E", "PAN", "ABCPD1234E"),
    ("Aadhaar 2345 6789 0124", "AADHAAR", "2345 6789 0124"),
    ("DIN: 01234567", "DIN", "01234567"),
    ("Passport No: M1234567", "PASSPORT", "M1234567"),
    ("see www.acme-foods.com/x", "URL", "www.acme-foods.com/x"),
    ("Mr. Rohan Mehta came", "PERSON", "Rohan Mehta"),
    ("by Acme Foods Private Limited", "ORGANIZATION", "Acme Foods Private Limited"),
]
ABSENT = [("card 4111 1111 1111 1112", "CREDIT_CARD"), ("order 123-45-6789", "SSN"), ("version 1.2.3.4", "IP_ADDRESS"), ("invoice dated 14/05/1982", "DATE_OF_BIRTH"), ("total 12345", "PHONE")]


@pytest.mark.parametrize("text,kind,value", CASES)
def test_found(text, kind, value):
    assert (kind, value) in {(s[0], " ".join(text[s[1] : s[2]].split())) for s in engine.analyze(text, Settings())}


@pytest.mark.parametrize("text,kind", ABSENT)
def test_absent(text, kind):
    assert kind not in {s[0] for s in engine.analyze(text, Settings())}


def test_disjoint_and_types():
    text = " ".join(c[0] for c in CASES)
    found = engine.analyze(text, Settings())
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))
    assert {s[0] for s in engine.analyze(text, Settings(types=("EMAIL",)))} == {"EMAIL"}
    with pytest.raises(ValueError):
        Settings(types=("NOPE",))


@pytest.mark.parametrize("kind,value", [(k, v) for _, k, v in CASES] + [("ADDRESS", "742 Evergreen Terrace, Springfield, IL 62704")])
def test_surrogate(kind, value):
    a, b = Surrogates("one").of(kind, value), Surrogates("two").of(kind, value)
    assert a == Surrogates("one").of(kind, value) and a != value and a != b
    if kind == "CREDIT_CARD":
        assert luhn(only_digits(a)) and a[0] == value[0]
    if kind == "AADHAAR":
        assert verhoeff(only_digits(a))
    if kind == "SSN":
        assert re.fullmatch(r"9\d\d-\d\d-\d{4}", a)


def test_all_types_covered():
    assert {k for _, k, _ in CASES} | {"ADDRESS"} == set(TYPES)


def test_redact_frame(spark):
    df = spark.createDataFrame([(1, "mail jane.roe@example.org"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in engine.detect(df).collect()}
    assert "jane.roe" not in rows[1].redacted and rows[2].redacted is None and rows[3].entities == []


def test_failing_detector_is_left_out(spark):
    def bad(text):
        raise RuntimeError

    assert engine.analyze("mail jane.roe@example.org", Settings(), [bad])


def test_keyed_and_spans(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(keyed.hmac_hex("k" * 70, F.lit("m")).alias("h"), keyed.verhoeff_ok(F.lit("234567890124")).alias("v")).first()
    assert row.h == hmac.new(b"k" * 70, b"m", hashlib.sha256).hexdigest() and row.v
    d = spark.createDataFrame([("\U0001f600 12 ab 345",)], "t string").select(spans.matches("t", "[0-9]+").alias("m")).first()
    assert [(m.start, m.end, m.text) for m in d.m] == [(2, 4, "12"), (8, 11, "345")]
