"""Licence scans by a positional rare-token index, in DataFrame and SQL functions only.

Licence templates (full texts of short licences, notices of long ones) are cut into sentences and words. The document frequency of
every template word is counted over the whole corpus, and each sentence is indexed by its words of highest IDF: a posting says at
which place of which sentence a word stands. Words that more than a twentieth of all files (and ten) have are not rare. Where a sentence
has the template's key phrase, half of its indexed words come from that, rare or not. A file's rare licence words are looked up with their places; a lookup votes for (sentence, place in the file less place in
the sentence), so words that stand apart as in the sentence vote alike. A sentence with enough votes for one place makes its template a
candidate, and that counts if its mandatory key phrase stands in the file too.

Base labels come from four phrases by themselves; the method's labels are added to them. The score is the largest share of a sentence's
postings that agree on a place, of templates that count, and 1 where a base phrase stands.

Cases: null and empty text has no words, no labels and score 0; a null doc_id stays null; rows that repeat a doc_id stay rows;
long files are read whole, in time linear in their words (votes: n log n); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.arrays import let
from inkveil.llm.common import corpus, doc_id
from inkveil.llm.license_texts import TEMPLATES

#: Word characters: digits, letters of ASCII, everything beyond ASCII. Patterns say (?i), which folds ASCII only.
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
GAP = rf"[^{WORD}]+"
#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
RARE = 4  # indexed words of a sentence
AGREE = 0.5  # share of its postings that must agree on a place
COMMON = 20  # words of more than a COMMON-th of all files, and ten, are not rare
SHIFT = 1 << 40


def phrase(words: str) -> str:
    return GAP.join(words.split())


def _alone(body: str) -> str:
    return rf"(?i)(?<![{WORD}])(?:{body})(?![{WORD}])"


BASE_RX = _alone("|".join(map(phrase, BASE)))
Templates = dict[str, tuple[str, str]]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def sentences(templates: Templates = TEMPLATES) -> list[tuple[str, list[str], list[str]]]:
    """(label, words, words of the key phrase if it stands in the sentence)."""
    out = []
    for label, (key, text) in templates.items():
        seen = set()
        for part in re.split(r"(?<=[.;:])\s+(?=[A-Z])", text.strip()):
            words = words_of(part)
            if words and tuple(words) not in seen:
                seen.add(tuple(words))
                out.append((label, words, key.split() if f" {key} " in f" {' '.join(words)} " else []))
    return out


def words_column(text: Column) -> Column:
    """The words, with an empty one in front if the text begins with none, and at the end likewise."""
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), GAP)


def document_frequency(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """(word, n): documents that have the template word; as many rows as there are template words at most."""
    known = sorted({w for _, s, _ in sentences(templates) for w in s})
    own = F.array_distinct(F.filter(words_column(F.col("text").cast("string")), lambda w: w.isin(known)))
    return docs.where(F.col("text").isNotNull()).select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def index(frequency: dict[str, int], n_docs: int, templates: Templates = TEMPLATES) -> tuple[list[tuple[str, int, int]], dict[str, list[tuple[int, int]]]]:
    """The sentences' labels, numbers of postings and of votes needed, and the postings word -> (sentence, place).

    The least frequent words have the highest IDF; words that no file has come last, and ties go by the word. A sentence that has its key
    phrase needs no more votes than that alone gives."""
    rarity = lambda w: (not frequency.get(w), frequency.get(w, 0), w)
    known, postings = [], {}
    for t, (label, words, key) in enumerate(sentences(templates)):
        own = sorted(set(key), key=rarity)[: math.ceil(RARE * AGREE)]
        other = [w for w in set(words) - set(own) if COMMON * (frequency.get(w, 0) - 10) <= n_docs]
        rare = own + sorted(other, key=rarity)[: RARE - len(own)]
        places = [(w, at) for at, w in enumerate(words) if w in rare]
        known.append((label, len(places), min(len(own) or RARE, max(1, math.ceil(len(places) * AGREE)))))
        for w, at in places:
            postings.setdefault(w, []).append((t, at))
    return known, postings


def licenses(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known, postings = index({r.word: r.n for r in document_frequency(docs, templates).collect()}, docs.count(), templates)
    d = docs.select(doc_id().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    # One pass over the words leaves the rare ones, and the first words of base phrases, with their places.
    starts = sorted({p.split()[0] for p in BASE})
    wanted = sorted({*postings, *starts})

    def of_words(words: Column) -> Column:
        skip = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)
        end = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
        hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(wanted), F.struct(w.alias("w"), (i - skip).alias("at")))))
        return F.struct((F.size(words) - skip - end).cast("long").alias("n"), hits.alias("hits"))

    d = d.withColumn("seen", let(words_column(text), of_words)).select("doc_id", "text", F.col("seen.n").alias("n_words"), F.col("seen.hits").alias("hits"))

    # Base phrases: a start, and the words behind it.
    count = lambda c: F.regexp_count(c, F.lit(rf"[{WORD}]+")).cast("long")
    maybe = F.exists("hits", lambda h: h["w"].isin(starts))
    d = d.withColumn("base", F.when(maybe, F.regexp_extract_all("text", F.lit(BASE_RX), F.lit(0))).otherwise(F.array().cast("array<string>")))
    has = F.size("base") > 0
    pieces = F.split("text", BASE_RX, -1)
    first = F.when(has, count(F.get(pieces, F.lit(0))))
    last = F.when(has, F.col("n_words") - count(F.element_at(pieces, -1)) - count(F.element_at("base", -1)))

    def named(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, v in BASE.items():
            out = F.when(m.rlike(rf"(?i)^{p.split()[0]}[^{WORD}]"), F.lit(v)).otherwise(out)
        return out

    base_labels = F.array_sort(F.array_distinct(F.transform("base", named)))
    d = d.select("doc_id", "text", "n_words", "hits", F.size("base").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), base_labels.alias("own"))

    # Votes of rare words.
    table_ = F.create_map(*(x for w, own in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.lit(t * SHIFT - at + SHIFT // 2) for t, at in own)))))
    rare = F.filter("hits", lambda h: h["w"].isin(sorted(postings)))
    d = d.withColumn("votes", F.sort_array(F.flatten(F.transform(rare, lambda h: F.transform(F.element_at(table_, h["w"]), lambda p: p + h["at"])))))
    most = max(n for _, n, _ in known)
    need, total = F.array(*(F.lit(n) for *_, n in known)), F.array(*(F.lit(n) for _, n, _ in known))
    label = F.array(*(F.lit(name) for name, *_ in known))
    # Sorted votes: those that agree follow each other, and no place gets more than a sentence has postings.
    runs = F.transform(
        "votes",
        lambda v, i: F.struct(F.floor(v / SHIFT).cast("int").alias("t"), F.size(F.filter(F.slice("votes", i + 1, F.lit(most)), lambda x: x == v)).alias("n")),
    )
    d = d.select("*", F.filter(runs, lambda r: r["n"] >= F.get(need, r["t"])).alias("good"))

    # Key phrases of the candidates.
    def there(name: Column) -> Column:
        out = F.lit(False)
        for key, v in ((key, v) for v, (key, _) in templates.items()):
            out = F.when(name == v, text.rlike(_alone(phrase(key)))).otherwise(out)
        return out

    d = d.select("*", F.filter(F.array_distinct(F.transform("good", lambda r: F.get(label, r["t"]))), there).alias("found"))
    shares = F.transform(F.filter("good", lambda r: F.array_contains("found", F.get(label, r["t"]))), lambda r: r["n"] / F.get(total, r["t"]))
    return d.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", "found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).cast("double").alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(corpus(spark, sf_dir))


def _sql() -> str:
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    known = sentences()
    words = [(t, at, w) for t, (_, s, _) in enumerate(known) for at, w in enumerate(s)]
    keys = sorted({(t, w) for t, (_, _, key) in enumerate(known) for w in key})
    half = math.ceil(RARE * AGREE)
    longest = max(len(p.split()) for p in BASE)
    ahead = ", ".join(f"lead(w, {k}) OVER (PARTITION BY d ORDER BY i) AS w{k}" for k in range(1, longest))
    base = " OR ".join("(" + " AND ".join(f"w{k or ''} = '{w}'" for k, w in enumerate(p.split())) + ")" for p in BASE)
    label = " ".join(f"WHEN w = '{p.split()[0]}' THEN '{v}'" for p, v in BASE.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS a FROM documents),
words AS (SELECT d, unnest(range(len(a))) AS i, unnest(a) AS w FROM docs),
template(t, pos, w) AS (VALUES {quoted(words)}),
sentence(t, label) AS (VALUES {quoted((t, label) for t, (label, *_) in enumerate(known))}),
phrase(label, key) AS (VALUES {quoted((v, key) for v, (key, _) in TEMPLATES.items())}),
keyword(t, w) AS (VALUES {quoted(keys)}),
frequency AS (SELECT w, count(DISTINCT d) AS n FROM words WHERE w IN (SELECT w FROM template) GROUP BY w),
ranked AS (SELECT DISTINCT t, template.w, coalesce(n, 0) AS n FROM template LEFT JOIN frequency USING (w)),
own AS (SELECT t, w FROM ranked JOIN keyword USING (t, w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n = 0, n, w) <= {half}),
owned AS (SELECT t, count(*) AS k FROM own GROUP BY t),
others AS (SELECT t, w FROM ranked LEFT JOIN owned USING (t) ANTI JOIN own USING (t, w) WHERE {COMMON} * (n - 10) <= (SELECT count(*) FROM docs)
           QUALIFY row_number() OVER (PARTITION BY t ORDER BY n = 0, n, w) <= {RARE} - coalesce(k, 0)),
posting AS (SELECT t, w, pos FROM template JOIN (SELECT t, w FROM own UNION ALL SELECT t, w FROM others) USING (t, w)),
needed AS (SELECT t, total, least(coalesce(k, {RARE}), greatest(1, ceil(total * {AGREE}))) AS need FROM (SELECT t, count(*) AS total FROM posting GROUP BY t) LEFT JOIN owned USING (t)),
vote AS (SELECT d, t, i - pos AS place, count(*) AS n FROM words JOIN posting USING (w) GROUP BY ALL),
found AS (
  SELECT d, label, max(n / total) AS share
  FROM vote JOIN needed USING (t) JOIN sentence USING (t) JOIN phrase USING (label) JOIN docs USING (d)
  WHERE n >= need AND contains(' ' || array_to_string(a, ' ') || ' ', ' ' || key || ' ')
  GROUP BY d, label),
base AS (SELECT d, i, CASE {label} END AS label FROM (SELECT d, i, w, {ahead} FROM words) WHERE {base}),
bases AS (SELECT d, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY d),
every AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT d, label FROM found UNION SELECT d, label FROM base) GROUP BY d),
best AS (SELECT d, max(share) AS share FROM found GROUP BY d)
SELECT doc_id, len(a)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM docs LEFT JOIN bases USING (d) LEFT JOIN every USING (d) LEFT JOIN best USING (d)
"""


SQL = _sql()
