"""Literal cases of detection: found, absent, and kept apart; by both engines."""

import time

import pytest
from pyspark.sql import functions as F

from inkveil.operators import engine, names, patterns
from inkveil.operators.surrogates import Surrogates
from inkveil.settings import TYPES, Settings

FOUND = [
    ("write to john.doe@example.co.in please", "EMAIL", "john.doe@example.co.in"),
    ("Telephone: + 91 20 45053237", "PHONE", "+ 91 20 45053237"),
    ("call +1 415-555-0182 now", "PHONE", "+1 415-555-0182"),
    ("+91 22\n40094400\n12 Pune", "PHONE", "+91 22 40094400"),
    ("(415) 555-0182 at noon", "PHONE", "(415) 555-0182"),
    ("SSN 214-77-3910 on file", "SSN", "214-77-3910"),
    ("Social Security Number: 214773910", "SSN", "214773910"),
    ("card 4111 1111 1111 1111 charged", "CREDIT_CARD", "4111 1111 1111 1111"),
    ("card 4111\n1111 1111 1111 charged", "CREDIT_CARD", "4111 1111 1111 1111"),
    ("amex 3782 822463 10005 charged", "CREDIT_CARD", "3782 822463 10005"),
    ("connected from 203.0.113.47 today", "IP_ADDRESS", "203.0.113.47"),
    ("connected via 198.51.100.9.", "IP_ADDRESS", "198.51.100.9"),
    ("listens on 127.0.0.1 only", "IP_ADDRESS", "127.0.0.1"),
    ("at 2001:4860:4860:0:0:0:0:8888", "IP_ADDRESS", "2001:4860:4860:0:0:0:0:8888"),
    ("date of birth 12/04/1958.", "DATE_OF_BIRTH", "12/04/1958"),
    ("born on 3rd March 1971", "DATE_OF_BIRTH", "3rd March 1971"),
    ("PAN: ABCPK7890L", "PAN", "ABCPK7890L"),
    ("Aadhaar 2345 6789 0124", "AADHAAR", "2345 6789 0124"),
    ("DIN: 00135070", "DIN", "00135070"),
    ("din 00135070", "DIN", "00135070"),
    ("Chairman 00135070", "DIN", "00135070"),
    ("Rohan Dey \nManaging Director \n0011419\n3 \n12 Elm Road", "DIN", "0011419 3"),
    ("Passport No: M1234567", "PASSPORT", "M1234567"),
    ("passport M 1234567", "PASSPORT", "M 1234567"),
    ("see www.acme-wire.com for details", "URL", "www.acme-wire.com"),
    ("see www.acme-wire. com for details", "URL", "www.acme-wire. com"),
    ("Mr. Rashi Prakash Patil signed", "PERSON", "Rashi Prakash Patil"),
    ("Contact Person Lokesh Shah/ Soumavo Sarkar", "PERSON", "Lokesh Shah"),
    ("Contact Person: Lokesh Shah/ Soumavo Sarkar", "PERSON", "Soumavo Sarkar"),
    ("Rashi Patil is our Managing Director", "PERSON", "Rashi Patil"),
    ("Rashi Patil\nChief Financial Officer", "PERSON", "Rashi Patil"),
    ("Whole-time Director\nRashi Patil", "PERSON", "Rashi Patil"),
    ("OUR PROMOTERS: RASHI PRAKASH PATIL AND OTHERS", "PERSON", "RASHI PRAKASH PATIL"),
    ("OUR PROMOTER: RASHI PATIL, DHAULAGIRI FAMILY TRUST AND OTHERS", "PERSON", "RASHI PATIL"),
    ("OUR PROMOTERS: RASHI PATIL, DHAULAGIRI FAMILY TRUST AND OTHERS", "ORGANIZATION", "DHAULAGIRI FAMILY TRUST"),
    ("Acme Wire Industries Limited filed", "ORGANIZATION", "Acme Wire Industries Limited"),
    ("by Acme Limited Liability Partnership", "ORGANIZATION", "Acme Limited Liability Partnership"),
    ("HDFC Bank Limited and ICICI Bank Limited", "ORGANIZATION", "ICICI Bank Limited"),
    ("Nuvama Nuvama Wealth Limited", "ORGANIZATION", "Nuvama Wealth Limited"),
    ("our Registered Office is at 12, Tower 2, Baner, Pune 411 045 Maharashtra, India", "ADDRESS", "12, Tower 2, Baner, Pune 411 045 Maharashtra, India"),
    ("lives at 742 Evergreen Terrace, Springfield, IL 62704", "ADDRESS", "742 Evergreen Terrace, Springfield, IL 62704"),
    ("Gat No. 11/3, 11/4, Village Birdewadi", "ADDRESS", "Gat No. 11/3, 11/4, Village Birdewadi"),
    ("Email: cs@acme.co.in Telephone: + 91 20 45053237\n12, Tower 2, Baner, Pune 411 045 Maharashtra, India", "PHONE", "+ 91 20 45053237"),
    ("Email: cs@acme.co.in Telephone: + 91 20 45053237\n12, Tower 2, Baner, Pune 411 045 Maharashtra, India", "ADDRESS", "12, Tower 2, Baner, Pune 411 045 Maharashtra, India"),
]
ABSENT = [
    ("Order 1234 5678 9012 3456 was cancelled", "CREDIT_CARD"),
    ("invoice reference 400-25-1000 attached", "SSN"),
    ("ticket 555-12-3456789 closed", "SSN"),
    ("SSN: 000123456", "SSN"),
    ("schema version 3.47.2.1 deployed", "IP_ADDRESS"),
    ("build 6.011.111.111 shipped", "IP_ADDRESS"),
    ("v1.2.3.4 of the server", "IP_ADDRESS"),
    ("the agreement dated December 10, 2025", "DATE_OF_BIRTH"),
    ("Bid/Offer opens on Tuesday, December 16, 2025", "DATE_OF_BIRTH"),
    ("born later; the invoice dated 14/05/1982", "DATE_OF_BIRTH"),
    ("total payable 5,55,555.00 this quarter", "CREDIT_CARD"),
    ("quote your PAN and Aadhaar when contacting us", "PAN"),
    ("9876543210 equity shares were allotted", "PHONE"),
    ("approved by BSE Limited and the Securities and Exchange Board of India", "ORGANIZATION"),
    ("see www.sebi.gov.in for the circular", "URL"),
    ("The Anchor Investor Application Form, the Basis of Allotment and the Bidder's DP ID must be provided. Non-GAAP Measures are defined below.", "PERSON"),
    ("a total of 100 000 shares", "ADDRESS"),
]


def values(text, settings=Settings()):
    return {(s[0], " ".join(text[s[1] : s[2]].split())) for s in engine.analyze(text, settings)}


@pytest.mark.parametrize("text,kind,value", FOUND)
def test_found(text, kind, value):
    assert (kind, value) in values(text)


@pytest.mark.parametrize("text,kind", ABSENT)
def test_absent(text, kind):
    assert kind not in {k for k, _ in values(text)}


def test_policy():
    assert ("ORGANIZATION", "BSE Limited") in values("approved by BSE Limited", Settings(redact_public=True))
    assert "URL" in {k for k, _ in values("see www.sebi.gov.in for it", Settings(redact_public=True))}
    assert values("a@b.com and +91 20 45053237", Settings(types=("EMAIL",))) == {("EMAIL", "a@b.com")}
    assert not values("write a@b.com", Settings(allow={"EMAIL": ("A@b.com",)}))
    assert values("the X-7 project", Settings(deny={"ORGANIZATION": ("X-7",)})) == {("ORGANIZATION", "X-7")}
    assert not values("at 10:11:12", Settings(strict_ipv6=True))


def test_no_overlap():
    text = "Contact Person: Rashi Patil\nAcme Wire Industries Limited, 12, Tower 2, Baner, Pune – 411 045 Maharashtra, India\nEmail rashi.patil@acme.co.in Telephone: + 91 20 45053237"
    found = engine.analyze(text, Settings())
    assert len(found) >= 4 and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


TEXTS = [t for t, *_ in FOUND + ABSENT] + ["\n\n".join(t for t, *_ in FOUND), "", None, "\U0001f600 éa@b.com a@b.com. ünser.4111111111111111", "x" * 3000]


def test_both_engines_find_the_same(spark):
    settings = Settings(allow={"EMAIL": ("cs@acme.co.in",)})
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("doc_id", "text", patterns.candidates(F.col("text"), settings).alias("c")).collect()
    for r in rows:
        first = {}
        for e in r.c:
            assert e.text == r.text[e.start : e.end]
            first.setdefault((e.type, e.start, e.end), (e.type, e.start, e.end, e.recognizer, e.score, e.notes))
        assert list(first.values()) == list(patterns.find(r.text or "", settings)), r.text


def test_cue_holds_wherever_structure_is_found(spark):
    import re

    for t in TEXTS:
        spans = [*names.people(t or ""), *names.organizations(t or "", lambda k, v: False), *names.addresses(t or "")]
        assert not spans or re.search(names.CUE, t), t
    got = spark.createDataFrame([(t,) for t in TEXTS if t], "t string").select("t", F.col("t").rlike(names.CUE).alias("c")).collect()
    assert all(r.c == bool(re.search(names.CUE, r.t)) for r in got)


def test_frame_equals_single_texts(spark):
    found = engine.detect(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for r in found:
        spans = engine.analyze(r.text, Settings()) if r.text else []
        assert [(e.type, e.start, e.end, e.recognizer) for e in r.entities] == [s[:4] for s in spans]
        assert r.redacted == (engine.rewrite(r.text, spans, Settings().seed)[0] if spans else r.text)


@pytest.mark.parametrize("piece", ["a.", "x", "1 ", "www.", "+1 ", "Mr A", "1-", "A ", "Director ", "1a, "])
def test_long_odd_texts_end_soon(piece):
    began = time.time()
    engine.analyze("@ born ip " + piece * (40_000 // len(piece)), Settings(propagate=False))
    assert time.time() - began < 20


def _redacted(text, seed="s"):
    return engine.rewrite(text, engine.analyze(text, Settings(seed=seed)), seed)[0]


def test_one_person_in_all_forms():
    out = _redacted("Mr. Rashi Prakash Patil is our Chairman. Rashi Prakash Patil signed. Write to rashi.patil@acme.co.in, said Rashi Patil.")
    person = out.split("Mr. ")[1].split(" is our")[0]
    first, _, last = person.split()
    assert "Rashi" not in out and out.count(person) == 2 and f"{first} {last}." in out and f"{first}.{last}@".lower() in out
    assert _redacted("OUR PROMOTERS: RASHI PRAKASH PATIL AND OTHERS").split(": ")[1].split(" AND")[0].isupper()
    assert _redacted("Mr. Rashi Patil signed", "a") != _redacted("Mr. Rashi Patil signed", "b")


def test_formats_stay():
    import re

    s = Surrogates("s")
    assert re.fullmatch(r"\+ 91 \d\d \d{4} \d{4}", s.of("PHONE", "+ 91 20 4505 3237"))
    assert re.fullmatch(r"9\d\d-\d\d-\d{4}", s.of("SSN", "214-77-3910")) and re.fullmatch(r"9\d{8}", s.of("SSN", "214773910"))
    card = s.of("CREDIT_CARD", "4111 1111 1111 1111")
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card) and patterns.luhn(patterns.only_digits(card))
    assert patterns.verhoeff(patterns.only_digits(s.of("AADHAAR", "2345 6789 0124")))
    assert s.of("IP_ADDRESS", "8.8.8.8").rsplit(".", 1)[0] in {"192.0.2", "198.51.100", "203.0.113"} and s.of("IP_ADDRESS", "2001:4860:4860::8888").startswith("2001:0db8:")
    assert s.of("EMAIL", "a.b@acme.co.in").endswith(".example.com") and _redacted("Email: cs.connect@kshinternational.com").startswith("Email: cs.connect@")
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", s.of("DATE_OF_BIRTH", "12/04/1958")) and re.fullmatch(r"[A-Z][a-z]+ \d{1,2}, \d{4}", s.of("DATE_OF_BIRTH", "May 4, 1958"))
    assert re.fullmatch(r"\d{1,2}(st|nd|rd|th) [A-Z][a-z]+ 19\d\d", s.of("DATE_OF_BIRTH", "3rd March 1971")) and re.fullmatch(r"\d{4}-\d\d-\d\d", s.of("DATE_OF_BIRTH", "1958-04-12"))
    assert s.of("ORGANIZATION", "Acme Wire Industries Limited").endswith(" Limited")
    for kind in TYPES:
        assert s.of(kind, "Sample Value 1234")
    assert s.made["SSN", "214-77-3910"] == s.of("SSN", "214-77-3910")


def test_model_detector():
    model = lambda t: [(i, i + 11, "PERSON") for i in [t.find("Rashi Patil")] if i >= 0] + [(0, 8, "PERSON"), (0, 8, "ORG")]
    d = names.model_detector(model, lambda k, v: False, companies=True, most=40)
    text = "Acme Org said\n" + "x" * 30 + "\nthat Rashi Patil came"
    assert [(s[0], text[s[1] : s[2]]) for s in d(text)][-1] == ("PERSON", "Rashi Patil") and ("ORGANIZATION", "Acme Org") in [(s[0], text[s[1] : s[2]]) for s in d(text)]
    assert ("PERSON", "Rashi Patil") in {(s[0], text[s[1] : s[2]]) for s in engine.analyze(text, Settings(), [d])}
