"""Detectors that go by pattern, checksum and context.

Each is said once, as a Rule, in terms that two engines share: candidates() makes a Catalyst expression of the rules for a text column,
find() evaluates them in plain Python for single texts (services, SQL functions). Patterns are written in what Java and Python read
alike: \\s and \\d are ASCII, (?i:...) folds ASCII only, and {w} stands for a letter, digit or underscore of any script.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.arrays import let, matches
from inkveil.operators import policy
from inkveil.settings import Settings

Span = tuple[str, int, int, str, float, str]
ENTITY = "struct<type:string,start:int,end:int,text:string,recognizer:string,score:double,notes:string>"
TAIL = " \t\r\n.,;:)"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return bool(digits) and total % 10 == 0


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetries of a pentagon, numbered 0-4 turns and 5-9 flips."""
    flip_a, flip_b = a > 4, b > 4
    turn = (a % 5 + (-1) ** flip_a * (b % 5)) % 5
    return turn + 5 * (flip_a != flip_b)


_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # fixed value: the base permutation


def _moved(d: int, times: int) -> int:
    for _ in range(times):
        d = _STEP[d]
    return d


def verhoeff(digits: str) -> bool:
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = _dihedral(c, _moved(int(d), i % 8))
    return bool(digits) and c == 0


def verhoeff_digit(body: str) -> str:
    return next(str(d) for d in range(10) if verhoeff(body + str(d)))


def verhoeff_ok(digits: Column) -> Column:
    table = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # noqa: E731  folded to a literal
    moved = table(_moved(d, i) for i in range(8) for d in range(10))
    product = table(_dihedral(a, b) for a in range(10) for b in range(10))
    steps = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.get(moved, (i % 8) * 10 + c.cast("int")))
    return F.aggregate(steps, F.lit(0), lambda c, d: F.get(product, c * 10 + d)) == 0


def only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


class Test(NamedTuple):
    """A predicate over a value, the place where its match starts, and the text, for either engine."""

    column: Callable[[Column, Column, Column], Column]
    python: Callable[[str, int, str], bool]

    def __and__(self, other: Test) -> Test:
        return Test(lambda *x: self.column(*x) & other.column(*x), lambda *x: self.python(*x) and other.python(*x))

    def __or__(self, other: Test) -> Test:
        return Test(lambda *x: self.column(*x) | other.column(*x), lambda *x: self.python(*x) or other.python(*x))

    def __invert__(self) -> Test:
        return Test(lambda *x: ~self.column(*x), lambda *x: not self.python(*x))


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def digits(least: int, most: int) -> Test:
    return Test(lambda v, at, t: F.length(_bare(v)).between(least, most), lambda v, at, t: least <= len(only_digits(v)) <= most)


def near(before: int, after: int, *cues: str) -> Test:
    """One of the cues stands in the `before` characters ahead of the match or the `after` from its start."""

    def column(v: Column, at: Column, t: Column) -> Column:
        start = F.greatest(at - before, F.lit(0))
        window = F.lower(F.substring(t, start + 1, at + after - start))
        return let(window, lambda w: F.exists(F.split(F.lit("|".join(cues)), "[|]"), lambda c: w.contains(c)))

    def python(v: str, at: int, t: str) -> bool:
        window = t[max(0, at - before) : at + after].lower()
        return any(c in window for c in cues)

    return Test(column, python)


def holds(pattern: str) -> Test:
    return Test(lambda v, at, t: v.rlike(pattern), lambda v, at, t: re.search(pattern, v) is not None)


LUHN = Test(lambda v, at, t: F.call_function("luhn_check", _bare(v)), lambda v, at, t: luhn(only_digits(v)))
VERHOEFF = Test(lambda v, at, t: verhoeff_ok(_bare(v)), lambda v, at, t: verhoeff(only_digits(v)))
#: Two octets over 31, which versions rarely have.
WIDE = Test(lambda v, at, t: F.size(F.filter(F.split(v, r"\."), lambda o: o.cast("int") > 31)) >= 2, lambda v, at, t: sum(int(o) > 31 for o in v.split(".")) >= 2)
ANY = Test(lambda v, at, t: F.lit(True), lambda v, at, t: True)
LOCAL = holds(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
COLON = holds(":")
BUSINESS = ("account", "batch", "case", "claim", "invoice", "item", "licence", "license", "lot ", "order", "part no", "po ", "policy", "purchase", "receipt", "ref", "serial", "sku", "ticket", "tracking")
VERSION = ("article", "build", "chapter", "clause", "firmware", "paragraph", "regulation", "release", "revision", "schema", "section", "version")
NETWORK = ("client", "connected", "gateway", "host", "ip address", "ip ", "ip:", "login", "logged in", "network", "server", "session", "subnet")
BIRTH = ("birth", "born", "d.o.b", "dob")
OTHER_DATE = ("agreement", "as of", "dated", "due", "effective", "expir", "filed", "invoice", "issued", "meeting", "order", "period", "signed")
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
AREA = r"(?!000|666|9\d\d)\d{3}"


class Rule(NamedTuple):
    type: str
    name: str
    score: float
    pattern: str
    guard: str  # a text in which this is not found has no match
    group: int = 0  # the value: the whole match, or its last part
    test: Test = ANY
    exempt: bool = True  # does policy count?
    notes: str = ""
    wrapped: bool = False  # a short last group on a line of its own is not of the value


RULES = (
    Rule("EMAIL", "email", 0.99, r"(?<![{w}%+-])(?<![{w}%+-]\.)[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}(?![{w}])", "@"),
    Rule("URL", "url", 0.90, r"(?<![@{w}])(?i:https?://|www\.)[A-Za-z0-9.-]{1,253}?\. ?(?i:co\.in|com|net|org|in|io|gov|edu|biz|info)(?![{w}])(?:/[^\s\"'<>]*)?", "(?i:http|www)"),
    Rule("IP_ADDRESS", "ip_address", 0.95, r"(?<![:{w}])(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}(?![:{w}])", ":[A-Fa-f0-9]{1,4}:"),
    Rule("PHONE", "phone", 0.95, r"(?<![{w}+])\+\s?\d{1,3}(?:[\s.-]{0,2}\(?\d{2,10}\)?){1,5}(?!\d)", r"\+", test=digits(8, 15), exempt=False, wrapped=True),
    Rule(
        "PHONE",
        "phone",
        0.90,
        r"(?<![{w}])(?i:tel(?:ephone)?|phone|mob(?:ile)?|fax|contact\s+(?:no|number)|helpline|landline)\.?\s*(?i:no\.?|number)?\s*[:–-]?\s*(\+?\d[\d\s().-]{7,20}\d)",
        r"\d[\d\s().-]{7,20}\d",
        1,
        digits(8, 15),
        False,
        wrapped=True,
    ),
    Rule("PHONE", "phone", 0.75, r"(?<![\d{w}-])(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}(?![\d{w}-])", r"\d{3}[-.\s]\d{4}", test=digits(8, 15), exempt=False),
    Rule(
        "CREDIT_CARD",
        "credit_card",
        0.95,
        r"(?<![\d.,])(?:3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}|(?:4\d{3}|5[1-5]\d{2}|2(?:2(?:2[1-9]|[3-9]\d)|[3-6]\d{2}|7(?:[01]\d|20))|6(?:011|4[4-9]\d|5\d{2})|3(?:0[0-5]|[68]\d)\d|35\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7})(?!\d)(?![.,]\d)",
        r"\d{4}[\s-]?\d{4}|\d{6}",
        test=digits(13, 19) & LUHN,
    ),
    Rule("SSN", "ssn", 0.95, rf"(?<![\d-]){AREA}[\s-](?!00)\d{{2}}[\s-](?!0000)\d{{4}}(?![\d-])", r"\d{3}[\s-]\d{2}[\s-]\d{4}", test=near(60, 0, "ssn", "social security") | ~near(60, 0, *BUSINESS)),
    Rule("SSN", "ssn_labelled", 0.90, rf"(?<![{{w}}])(?i:ssn|social\s+security(?:\s+(?:number|no\.?))?)\s*(?i:is)?\s*[:#-]?\s*({AREA}[\s-]?(?!00)\d{{2}}[\s-]?(?!0000)\d{{4}})(?![{{w}}])", r"(?i:ssn|social\s+security)", 1),
    Rule("AADHAAR", "aadhaar", 0.93, r"(?<![\d.,-])[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}(?![\d-])(?![.,]\d)", r"\d{4}[\s-]?\d{4}[\s-]?\d{4}", test=VERHOEFF | near(60, 20, "aadhaar", "aadhar", "uid")),
    Rule("PAN", "pan", 0.92, r"(?<![{w}])[A-Z]{3}[ABCFGHLJPTK][A-Z]\d{4}[A-Z](?![{w}])", r"[A-Z]{5}\d{4}"),
    Rule("DIN", "din", 0.90, r"(?<![{w}])(?i:din|director\s+identification\s+number)\s*(?i:no\.?)?\s*[:#–-]?\s*(\d{6,8})(?![{w}])", r"\d{6}", 1),
    Rule("DIN", "din_designation", 0.75, r"(?<![{w}])(?i:chairman|chairperson|director)\s*(\d{6,8}(?:[ \t]*\n(?!\s*\n)[ \t]*\d{1,2})?)(?!\d)", r"\d{6}", 1),
    Rule("PASSPORT", "passport", 0.88, r"(?<![{w}])(?i:passport)\s*(?i:no\.?|number)?\s*[:#–-]?\s*([A-PR-WYa-pr-wy]\s?\d{7})(?![{w}])", "(?i:passport)", 1),
    Rule("IP_ADDRESS", "ip_address", 0.95, rf"(?<![{{w}}.])(?:{OCTET}\.){{3}}{OCTET}(?!\d)(?!\.\d)", r"\d\.\d", test=~near(24, 0, *VERSION) & (near(60, 25, *NETWORK) | LOCAL | WIDE)),
    Rule(
        "DATE_OF_BIRTH",
        "date_of_birth",
        0.90,
        rf"(?<!\d)(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})|\d{{4}}[/.-]\d{{1,2}}[/.-]\d{{1,2}}|(?i:{MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?i:st|nd|rd|th)?\s+(?i:{MONTHS})\.?,?\s+\d{{4}})(?!\d)",
        r"(?i:birth|born|d\.o\.b|dob)",
        test=near(90, 0, *BIRTH) & ~near(30, 0, *OTHER_DATE),
        exempt=False,
        notes="dob-context",
    ),
)
_PLAIN_TAIL = re.compile(r"\n[ \t]*[0-9]{1,3}\Z")


def java(pattern: str) -> str:
    return pattern.replace("{w}", r"\p{L}\p{N}_")


@cache
def python(pattern: str) -> re.Pattern:
    """\\s and \\d of ASCII, whether in brackets or not; (?i: folds ASCII only."""
    out, inside = [], False
    for token in re.findall(r"\\.|[\[\]]|\(\?i:|\{w\}|.", pattern, re.S):
        if token in "[]" and len(token) == 1:
            inside = token == "["
        token = {"(?i:": "(?ai:", "{w}": r"\w", r"\s": "\\t-\\r " if inside else "[\\t-\\r ]", r"\d": "0-9" if inside else "[0-9]"}.get(token, token)
        out.append(token)
    return re.compile("".join(out))


def _enabled(settings: Settings) -> list[Rule]:
    rules = [r for r in RULES if r.type in settings.types]
    strict = holds(r"[A-Fa-f]|(?:[^:]*:){7}")
    return [r._replace(test=strict) if settings.strict_ipv6 and r.pattern.startswith("(?<![:") else r for r in rules]


def find(text: str, settings: Settings) -> Iterator[Span]:
    """All candidates of the enabled types in a text, each span of a type once."""
    exempt, seen = policy.exempter(settings), set()
    for r in _enabled(settings):
        if not python(r.guard).search(text):
            continue
        for m in python(r.pattern).finditer(text):
            s, value = m.start(r.group), m.group(r.group).rstrip(TAIL)
            if r.wrapped:
                value = _PLAIN_TAIL.sub("", value).rstrip(TAIL)
            key = r.type, s, s + len(value)
            if value and key not in seen and r.test.python(value, m.start(), text) and not (r.exempt and exempt(r.type, value)):
                seen.add(key)
                yield *key, r.name, r.score, r.notes


def _of_rule(r: Rule, text: Column, settings: Settings) -> Column:
    rx, fields = java(r.pattern), ("type", "start", "end", "text", "recognizer", "score", "notes")
    cut = lambda v: F.regexp_replace(v, r"[ \t\r\n.,;:)]+\z", "")
    whole = lambda v: cut(F.regexp_replace(cut(v), r"\n[ \t]*[0-9]{1,3}\z", "")) if r.wrapped else cut(v)

    def entity(m: Column, value: Column) -> Column:
        """A value is the last part of its match; `at` is where the match starts."""
        start = m["end"] - F.length(value)
        kept = lambda v: F.struct(F.lit(r.type).alias("type"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("text"), F.lit(r.name).alias("recognizer"), F.lit(r.score).alias("score"), F.lit(r.notes).alias("notes"), m["start"].alias("at"))
        return let(whole(value), kept)

    def ok(e: Column) -> Column:
        out = (e["text"] != "") & r.test.column(e["text"], e["at"], text)
        return out & ~policy.exempt_column(settings, r.type, e["text"]) if r.exempt else out

    def rows(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(rx), F.lit(r.group)) if r.group else F.transform(found, lambda m: m["text"])
        good = F.filter(F.zip_with(found, values, entity), ok)
        return F.transform(good, lambda e: F.struct(*(e[c].alias(c) for c in fields)))

    return F.when(text.rlike(java(r.guard)), let(matches(text, rx), rows)).otherwise(F.array().cast(f"array<{ENTITY}>"))


def candidates(text: Column, settings: Settings) -> Column:
    """array<ENTITY>: the same for a text column; empty for null. A span of a type may be there more than once."""
    none, enabled = F.array().cast(f"array<{ENTITY}>"), _enabled(settings)
    some, other = ([_of_rule(r, text, settings) for r in enabled if (r.type in ("EMAIL", "URL") or r.guard.startswith(":")) is free] for free in (True, False))
    return F.concat(none, *some, F.when(text.rlike("[0-9]"), F.concat(none, *other)).otherwise(none))  # all others need a digit
