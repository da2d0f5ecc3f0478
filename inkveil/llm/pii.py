"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

Numbers and dates are validated and then permuted within their own format by a keyed Feistel network, so equal values have
equal pseudonyms in all documents, unlike values have unlike ones, and whoever has the key can go back:

* card: 13 to 19 digits that pass the Luhn test, of a longer candidate the longest such prefix of whole groups; the first digit stays, the check digit fits the new number.
* ssn: ddd-dd-dddd of assignable parts, to others of them.
* ip: dotted quads of octets.
* phone: + country code and 6 to 14 more digits, in groups of any size, up to where another candidate starts; the country code (by the
  table of codes, however the number is grouped), a trunk "(0)" and punctuation stay, so a number is the same one in all its spellings.
* date: y-m-d, d/m/y or d.m.y, or m/d/y where d/m/y is no day, of a real day from 0001-01-01 to 9999-12-31, to another within about
  a century (36525 days); the order and punctuation stay.
* email: has no numbering, so its local part becomes a keyed digest; the domain stays.

The network works on a pair (A, B) of an a * b domain: even rounds add a keyed digest of B to A modulo a, odd rounds one of A
to B modulo b; that is a bijection for any a and b. Where the image would be read as something else (a card that becomes longer with the
number behind it, a phone that looks like an ssn, a day that is not written so), it is permuted again until it would not, which
is a bijection too; 24 times at most, beyond which the value stays (that has never been seen).

Every pattern is read in time linear in the text: repeats inside it are possessive or bounded, and an e-mail is only looked for where
a run of its characters begins.

Cases: null text stays null, with no findings; values that fail validation stay; a null doc_id stays null; equal rows have
equal results; a long text is read whole; of overlapping candidates the leftmost, then the first named kind counts; an empty
table gives an empty result; pseudonymize() keeps all other columns, of any names, but for one named found, which gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.arrays import let
from inkveil.llm.common import corpus, doc_id, hide, show

ROUNDS = 8
WALK = 24
CENTURY = (75, 487)  # multiplied: 36525 days
#: Country codes (ITU E.164): of one and two digits; all others have three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Of the registered query alone. Whoever knows the key can go back, so a real run passes its own.
DEMO_KEY = "for tests only"
_IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
#: A card as it is mostly written, in fours or at a stretch.
_CARD = r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
#: A further digit of a phone or a card, after a blank, point or dash, unless another candidate starts there.
_PHONE_DIGIT = rf"(?:[ .-]?(?!{_IP}|{_SSN}|{_DATE}|{_CARD})[0-9])"
_CARD_DIGIT = rf"(?:[ -]?(?!{_IP}|{_SSN}|{_DATE})[0-9])"
#: kind: pattern of candidates, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9_%+-])(?<![A-Za-z0-9_%+-]\.)[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}",
    "ip": _IP,
    "ssn": _SSN,
    "date": _DATE,
    # of known length (+1), at a stretch, with the first group in parentheses, or in groups
    "phone": r"(?<![0-9+])\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{8,17}"
    rf"|[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,2}}\){_PHONE_DIGIT}{{6,12}}|\([0-9]{{3,4}}\){_PHONE_DIGIT}{{4,10}})|[0-9]{{1,3}}(?![0-9]){_PHONE_DIGIT}{{7,14}})(?![0-9])",
    "card": rf"(?<![0-9.])[0-9]{_CARD_DIGIT}{{12}}(?:(?![ -]{_CARD}){_CARD_DIGIT}){{0,6}}(?![0-9])",
}
RX = "|".join(PATTERNS.values())


def _digest(key: str, kind: Column | str, i: int, x: Column) -> Column:
    """60 keyed bits of the round number and one half."""
    inner = F.sha2(F.concat(F.lit(f"{key}|{kind}|{i}|"), x.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|"), inner).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def permute(pair: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """The image of struct(a, b) of halves in the a * b domain; back: its preimage."""
    sign = F.lit(-1 if back else 1)

    def turn(i: int):
        def left(p: Column) -> Column:
            return F.struct(F.pmod(p["a"] + sign * F.pmod(_digest(key, kind, i, p["b"]), a), a).alias("a"), p["b"].alias("b"))

        def right(p: Column) -> Column:
            return F.struct(p["a"].alias("a"), F.pmod(p["b"] + sign * F.pmod(_digest(key, kind, i, p["a"]), b), b).alias("b"))

        return right if i % 2 else left

    out = pair
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        out = let(out, turn(i))
    return out


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def permute_digits(d: Column, key: str, kind: str, back: bool = False) -> Column:
    """A digit string (of 2 to 36) to another of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    pair = _pair(F.substring(d, F.lit(1), u), F.substring(d, u + 1, n - u))
    return let(permute(pair, _pow10(u), _pow10(n - u), key, kind, back), lambda p: F.concat(_padded(p["a"], u), _padded(p["b"], n - u)))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order."""
    return F.array_join(
        F.aggregate(
            F.split(shape, ""),
            F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.array(F.substring(digits, s["at"], F.lit(1)))).alias("out"))).otherwise(
                F.struct(s["at"].alias("at"), F.concat(s["out"], F.array(c)).alias("out"))
            ),
            lambda s: s["out"],
        ),
        "",
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card_in(m: Column) -> Column:
    """The longest prefix of whole groups that passes the Luhn test: a following short number may stand in the candidate. Null if none does."""
    prefixes = (F.regexp_extract(m, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1))
    return F.get(F.filter(F.array(*prefixes), lambda x: (x != "") & F.call_function("luhn_check", _digits(x))), F.lit(0))


def _walk(m: Column, step, reads_back) -> Column:
    """step(m), and steps on while the image would not be read back as it is; null if it never would."""
    out = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), step(m), lambda s, _: F.when(reads_back(s), s).otherwise(step(s)))
    return let(out, lambda s: F.when(reads_back(s), s))


def _card(m: Column, key: str, back: bool) -> Column:
    """The new card alone, without what follows it in m, which is also not to be taken for its end."""

    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), n - 2), key, "card", back))
        return let(body, lambda b: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(b, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), F.lit(0)))

    step = lambda c: let(_digits(c), lambda d: _refill(c, new(d)))

    def of_card(c: Column) -> Column:
        rest = F.substring(m, F.length(c) + 1, F.length(m))
        return F.when(c == m, step(c)).when(c.isNotNull(), _walk(c, step, lambda s: _card_in(F.concat(s, rest)) == s))

    return let(_card_in(m), of_card)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, *p).cast("int") for p in ((1, 3), (5, 2), (8, 4)))
    a = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    out = permute(_pair(a, serial - 1), F.lit(898 * 99), F.lit(9999), key, "ssn", back)
    return let(out, lambda p: let(F.floor(p["a"] / 99), lambda r: F.concat_ws("-", _padded(r + F.when(r >= 665, 2).otherwise(1), F.lit(3)), _padded(p["a"] % 99 + 1, F.lit(2)), _padded(p["b"] + 1, F.lit(4)))))


def _ip(m: Column, key: str, back: bool) -> Column:
    o = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("int")
    out = permute(_pair(o(0) * 256 + o(1), o(2) * 256 + o(3)), F.lit(65536), F.lit(65536), key, "ip", back)
    return let(out, lambda p: F.concat_ws(".", *(x.cast("int").cast("string") for x in (F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256))))


def _phone(m: Column, key: str, back: bool) -> Column:
    code = F.regexp_extract(_digits(m), f"^(?:{COUNTRY})", 0)

    def step(x: Column) -> Column:
        """Digits behind the code, but for a trunk 0 in parentheses, permuted as one number."""
        shape = F.replace(x, F.lit("(0)"), F.lit("(\x01)"))
        return let(code, lambda c: let(F.substring(_digits(shape), F.length(c) + 1, F.length(m)), lambda d: F.replace(_refill(shape, F.concat(c, permute_digits(d, key, "phone", back))), F.lit("\x01"), F.lit("0"))))

    n = F.length(_digits(F.replace(m, F.lit("(0)"), F.lit("")))) - F.length(code)
    return F.when(n.between(6, 14), _walk(m, step, lambda s: (F.regexp_extract(s, PATTERNS["phone"], 0) == s) & (s.contains("(0)") == m.contains("(0)"))))


def _date(m: Column, key: str, back: bool) -> Column:
    day_of = lambda iso: F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit("0001-01-01").cast("date"))
    part = lambda at, n: F.substring(m, at, n)
    sep = part(3, 1)
    first = F.when(m.rlike("^[0-9]{4}-"), day_of(m)).otherwise(day_of(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))))
    american = F.when(~m.rlike("^[0-9]{4}-") & (sep == "/"), day_of(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))))
    size = CENTURY[0] * CENTURY[1]

    def step(n: Column) -> Column:
        out = permute(_pair(F.floor(n % size / CENTURY[1]), n % size % CENTURY[1]), F.lit(CENTURY[0]), F.lit(CENTURY[1]), key, "date", back)
        return let(out, lambda p: (F.floor(n / size) * size + p["a"] * CENTURY[1] + p["b"]).cast("int"))

    iso = lambda n: F.date_format(F.date_add(F.lit("0001-01-01").cast("date"), n), "yyyy-MM-dd")
    last = 3652058  # 9999-12-31
    as_day = lambda n: let(iso(n), lambda t: F.when(m.rlike("^[0-9]{4}-"), t).otherwise(F.concat(F.substring(t, 9, 2), sep, F.substring(t, 6, 2), sep, F.substring(t, 1, 4))))
    as_american = lambda n: let(iso(n), lambda t: F.concat(F.substring(t, 6, 2), sep, F.substring(t, 9, 2), sep, F.substring(t, 1, 4)))
    plain = let(first, lambda n: F.when(n.isNotNull(), as_day(_walk(n, step, lambda x: x <= last))))
    late = lambda x: F.when(x > last, False).otherwise(F.dayofmonth(F.date_add(F.lit("0001-01-01").cast("date"), F.least(x, F.lit(last)))) > 12)
    return F.coalesce(plain, let(american, lambda n: F.when(n.isNotNull(), as_american(_walk(n, step, late)))))


def _email(m: Column, key: str, back: bool) -> Column:

    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|"), F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)).cast("binary"), 256)).cast("binary"), 256), 1, 16), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """struct(kind, to): what a candidate is and becomes; to is null if it fails validation. back undoes all but emails."""
    kind = F.when(m.contains("@"), "email").when(m.startswith("+"), "phone")
    kind = kind.when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    kind = kind.when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\2[0-9]{4})$"), "date").otherwise("card")
    makers = {"email": _email, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card}

    def made(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, f in makers.items():
            if not (back and name == "email"):
                out = F.when(k == name, f(m, key, back)).otherwise(out)
        of = F.when(k == "card", F.coalesce(_card_in(m), m)).otherwise(m)
        return F.struct(k.alias("kind"), of.alias("of"), out.alias("to"))

    return let(kind, made)


def pseudonymize(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """docs with text rewritten, and found: array<struct<kind, of, to>> of what was replaced, in order. back undoes all but e-mails."""
    hidden, names, text = hide(docs)
    has = F.col(text).rlike("@[A-Za-z0-9]|[0-9]")
    d = hidden.withColumn("m", F.when(has, F.regexp_extract_all(text, F.lit(RX), F.lit(0))))
    d = d.withColumn("f", F.transform("m", lambda m: pseudonym(m, key, back)))

    def piece(p: Column, i: Column) -> Column:
        tail = lambda f, m: F.concat(p, F.coalesce(f["to"], f["of"]), F.substring(m, F.length(f["of"]) + 1, F.length(m)))
        return F.when(i < F.size("m"), let(F.struct(F.get("f", i).alias("f"), F.get("m", i).alias("m")), lambda x: tail(x["f"], x["m"]))).otherwise(p)

    spliced = F.array_join(F.transform(F.split(F.col(text).cast("string"), RX, -1), piece), "")
    found = F.coalesce(F.filter("f", lambda x: x["to"].isNotNull()), F.array().cast("array<struct<kind:string,of:string,to:string>>"))
    d = d.withColumn("found", found).withColumn("new", F.when(F.size("m") > 0, spliced).otherwise(F.col(text)))
    return show(d, names, "found", **{text: "new"})


def pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, a count of each kind, and the rewritten text."""
    d = pseudonymize(docs.select(doc_id().alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *(n(k) for k in PATTERNS), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(corpus(spark, sf_dir), spark.conf.get("spark.inkveil.key", DEMO_KEY))
