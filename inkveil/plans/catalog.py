"""Queries of the engine's own operators over the tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import keyed
from inkveil.operators import engine, patterns, policy, scoring, spans
from inkveil.operators import surrogates as fakes
from inkveil.operators.spread import mentions
from inkveil.settings import PRIORITY, Settings
from inkveil.sources import blocks

EMAIL = next(r for r in patterns.RULES if r.type == "EMAIL")
TICKET = Settings(seed="catalog")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, factor: int = 4) -> DataFrame:
    """df, or its rows dealt out anew if one split has more than twice a core's even share, as a file of one row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_split = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    largest, total = by_split.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(factor * cores) if largest and largest * cores > 2 * total and total > factor * cores else df


def _documents(spark, sf_dir):
    return _dealt(_t(spark, sf_dir, "documents").select("doc_id", "text"))


def redact_documents(spark, sf_dir):
    found = engine.detect(_documents(spark, sf_dir), TICKET)
    return found.select("doc_id", F.size("entities").alias("n_entities"), "redacted").where("n_entities > 0")


def detect_entities(spark, sf_dir):
    return engine.entities(engine.detect(_documents(spark, sf_dir), TICKET, redact=False))


def counts_by_type(spark, sf_dir):
    return engine.counts(engine.detect(_documents(spark, sf_dir), TICKET, redact=False))


def surrogate_mapping(spark, sf_dir):
    return engine.mapping(engine.detect(_documents(spark, sf_dir), TICKET))


def surrogate_numbers(spark, sf_dir):
    """The mapping's cards and addresses of machines."""
    some = TICKET.but(types=("CREDIT_CARD", "IP_ADDRESS"))
    return engine.mapping(engine.detect(_documents(spark, sf_dir), some))


def entities_by_recognizer(spark, sf_dir):
    return engine.by_recognizer(engine.detect(_documents(spark, sf_dir), TICKET, redact=False)).drop("share")


def kept_domains(spark, sf_dir):
    """E-mail addresses that policy leaves: an allowlist as an anti-join and in the settings give the same."""
    known = Settings(seed="catalog", types=("EMAIL",), allow={"EMAIL": tuple(r.value for r in _all_emails(spark, sf_dir).where("value < 'm'").orderBy("value").limit(5).collect())})
    return engine.entities(engine.detect(_documents(spark, sf_dir), known, redact=False)).groupBy("text").agg(F.count("*").alias("n"))


def _all_emails(spark, sf_dir):
    return engine.entities(engine.detect(_documents(spark, sf_dir), TICKET.but(types=("EMAIL",)), redact=False)).select(F.lower("text").alias("value")).distinct()


def redact_conversations(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))
    found = engine.detect(turns, TICKET)
    return found.select("conv_id", F.size("entities").alias("n_entities"), "redacted")


def _spans_of(spark, sf_dir, pattern, guard=None):
    key, d = "doc_id", _documents(spark, sf_dir).withColumnRenamed("text", "t")
    if guard:
        d = d.where(F.col("t").rlike(guard))
    return d.select(key, F.explode(spans.matches("t", pattern)).alias("m")).select(key, "m.start", "m.end", F.col("m.text").alias("value"))


def email_spans(spark, sf_dir):
    return _spans_of(spark, sf_dir, patterns.java(EMAIL.pattern), guard=EMAIL.guard).select("doc_id", "value", F.count("*").over(Window.partitionBy("doc_id", "value")).alias("times")).distinct()


def luhn_numbers(spark, sf_dir):
    runs = _spans_of(spark, sf_dir, r"[0-9]+").where(F.length("value") == 16)
    return runs.groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).withColumn("valid", F.call_function("luhn_check", F.col("value")))


def verhoeff_numbers(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select((F.lit(200000000000) + F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("string").alias("number"))
    return d.groupBy("number").agg(F.count("*").alias("n")).withColumn("valid", keyed.verhoeff_ok(F.col("number")))


def hmac_draws(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("SSN|"), F.col("c_custkey").cast("string")).alias("k"))
    return d.select("c_custkey", *(keyed.draw("catalog", F.col("k"), i).alias(f"draw{i}") for i in (0, 7, 8)))


def segment_starts(spark, sf_dir):
    return spans.segment_starts(_t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start")


def bucketed_spans(spark, sf_dir):
    """Marks every 500 characters of a conversation, as spans of 3 characters of the turn that they begin in."""
    starts = spans.segment_starts(_t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "text", "start")
    size = starts.groupBy("conv_id").agg(F.max(F.col("start") + F.length("text")).alias("size"))
    marks = size.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size"), F.lit(500).cast("long"))).alias("start")).withColumn("end", F.col("start") + 3)
    return spans.bucket(marks, starts, "conv_id").select("conv_id", "turn", "start", "end")


def dictionary_mentions(spark, sf_dir):
    """Where documents have the first two, and the first four, words of benchmark items, as a dictionary join."""
    first = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    forms = _t(spark, sf_dir, "benchmark").select(F.explode(F.array(F.slice(first, 1, 2), F.slice(first, 1, 4))).alias("w")).select(F.array_join("w", " ").alias("form"), F.concat(F.lit("words"), F.size("w").cast("string")).alias("type")).distinct()
    return mentions(_documents(spark, sf_dir), forms)


def _event_spans(spark, sf_dir, *more):
    e = _t(spark, sf_dir, "events")
    return e.select("user_id", *more, (F.col("event_id") * 7919 % 5000).alias("start"), (F.col("event_id") * 7919 % 5000 + 1 + F.col("event_id") * 31 % 40).alias("end"))


def merged_islands(spark, sf_dir):
    return spans.islands(_event_spans(spark, sf_dir), "user_id")


def deduped_spans(spark, sf_dir):
    """The best event of each (user, start, end): of the highest rank, then the first."""
    e = _event_spans(spark, sf_dir, F.col("event_id"), (F.col("event_id") * 17 % 7).alias("rank"))
    best = F.max_by(F.struct("event_id", "rank"), F.struct("rank", -F.col("event_id")))
    return e.groupBy("user_id", "start", "end").agg(best.alias("b")).select("user_id", "start", "end", "b.event_id", "b.rank")


def resolved_spans(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", F.struct((F.col("event_id") * 31 % 40 * 1000000 + F.col("event_id") % 1000000).alias("rank"), (F.col("event_id") * 7919 % 5000).alias("start"), (F.col("event_id") * 7919 % 5000 + 1 + F.col("event_id") * 31 % 40).alias("end")).alias("s"))
    g = rows.groupBy("user_id").agg(spans.greedy(F.collect_list("s")).alias("kept"))
    return g.select("user_id", F.explode("kept").alias("s")).select("user_id", "s.start", "s.end")


def url_hosts(spark, sf_dir):
    host = F.regexp_replace(policy.host_of(F.col("url")), r"^www\.", "")
    return _t(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages")).withColumn("public", policy.is_public_domain(F.col("host")))


def context_tokens(spark, sf_dir):
    """Hexadecimal runs with the word token in the 20 characters before them."""
    d = _documents(spark, sf_dir).where(F.col("text").rlike("(?i:token)"))
    close = patterns.near(20, 0, "token")
    s = d.select("doc_id", F.explode(F.filter(spans.matches("text", r"[0-9a-f]{40}"), lambda m: close.column(m["text"], m["start"], F.col("text")))).alias("m"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("m.text").alias("least"))


def clean_blocks(spark, sf_dir):
    """Turns of conversations with their blanks mended."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", blocks.clean(F.concat(F.col("text"), F.lit("\u200b \u00a0 x . com"))).alias("text"))


def _gold(spark, sf_dir):
    """Every fifth event is a label, and predictions are events moved by up to two places."""
    e = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("type"), (F.col("event_id") * 100).cast("int").alias("start"))
    side = lambda d, shift: d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("type", (F.col("start") + shift).alias("start"), (F.col("start") + shift + 5).alias("end")))).alias("entities"))
    return side(e.where("event_id % 5 < 3"), F.lit(0)), side(e.where("event_id % 5 > 0"), (F.col("event_id") % 3 * 3).cast("int"))


def strict_scores(spark, sf_dir):
    return scoring.scores(*_gold(spark, sf_dir), partial=False)


def partial_scores(spark, sf_dir):
    return scoring.scores(*_gold(spark, sf_dir))


def identifiers_by_quality(spark, sf_dir):
    """Documents with a mailbox, by label."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").contains("@").cast("int").alias("has"))
    return d.join(_t(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum("has").alias("with_at"))


def at_signs_rollup(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("lang", "source", (F.length("text") - F.length(F.replace("text", F.lit("@"), F.lit("")))).alias("n"))
    return d.rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("at_signs"))


def top_documents(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"))
    return d.orderBy(F.desc("numbers"), "doc_id").limit(20)


def anti_joined_benchmark(spark, sf_dir):
    """Benchmark items in which the engine finds nothing."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", "text")
    found = engine.entities(engine.detect(items, TICKET, redact=False), "item_id")
    return items.join(found, "item_id", "left_anti").select("item_id", F.length("text").alias("size"))


QUERIES = {f.__name__: f for f in (redact_documents, detect_entities, counts_by_type, surrogate_mapping, surrogate_numbers, entities_by_recognizer, kept_domains, redact_conversations, dictionary_mentions, email_spans, luhn_numbers, verhoeff_numbers, hmac_draws, segment_starts, bucketed_spans, merged_islands, deduped_spans, resolved_spans, url_hosts, context_tokens, clean_blocks, strict_scores, partial_scores, identifiers_by_quality, at_signs_rollup, top_documents, anti_joined_benchmark)}

_INNER, _OUTER = keyed.pads("catalog")
_EVENTS = "SELECT user_id, event_id * 7919 % 5000 AS s, event_id * 7919 % 5000 + 1 + event_id * 31 % 40 AS e FROM events"
_DRAW = lambda i: f"('0x' || substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode('SSN|' || c_custkey || '|{i // 8}')))), {1 + 8 * (i % 8)}, 8))::BIGINT AS draw{i}"


def _found(rx: str, group: int = 0) -> str:
    """d, text, and 0-based s and v of a pattern's matches (or of the group that ends them)."""
    return f"""SELECT d, text, (e - length(v))::BIGINT AS s, v FROM (
      SELECT d, text, list_sum(list_transform(g[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x))) AS e, c[i] AS v
      FROM (SELECT d, text, m, c, g, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT d, text, regexp_extract_all(text, '{rx}') AS m, regexp_extract_all(text, '{rx}', {group}) AS c, regexp_split_to_array(text, '{rx}') AS g FROM docs)))"""


_MAIL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
_CALL = r"(?:^|[^A-Za-z0-9_+])(\+\s?[0-9]{1,3}(?:[\s.-]{0,2}\(?[0-9]{2,10}\)?){1,5})"
_CARD = r"(?:^|[^0-9.,])((?:3[47][0-9]{2}[\s-]?[0-9]{6}[\s-]?[0-9]{5}|(?:4[0-9]{3}|5[1-5][0-9]{2}|2(?:2(?:2[1-9]|[3-9][0-9])|[3-6][0-9]{2}|7(?:[01][0-9]|20))|6(?:011|4[4-9][0-9]|5[0-9]{2})|3(?:0[0-5]|[68][0-9])[0-9]|35[0-9]{2})[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,7}))"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_bare = lambda v: f"regexp_replace({v}, '[^0-9]', '', 'g')"
_LUHN = lambda d: f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN substr({d}, i, 1)::INT ELSE (2 * substr({d}, i, 1)::INT) // 10 + (2 * substr({d}, i, 1)::INT) % 10 END)) % 10"
_cue = lambda before, after, cues: "(" + " OR ".join(f"contains(lower(substr(text, greatest(s - {before}, 0) + 1, s + {after} - greatest(s - {before}, 0))), '{c}')" for c in cues) + ")"
_MOVED = [patterns._moved(d, i) for i in range(8) for d in range(10)]
_PRODUCT = [patterns._dihedral(a, b) for a in range(10) for b in range(10)]
_VERHOEFF = lambda d: f"list_reduce([0] || list_transform(range(0, length({d})::BIGINT), lambda i: ({_MOVED})[(i % 8) * 10 + substr({d}, length({d}) - i, 1)::INT + 1]), lambda c, d: ({_PRODUCT})[c * 10 + d + 1]) = 0"
_AMERICAN = r"(?:^|[^A-Za-z0-9_-])((?:\([0-9]{3}\)\s?|[0-9]{3}[-.\s])[0-9]{3}[-.\s][0-9]{4})"
_TWELVE = r"(?:^|[^0-9.,-])([2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4})"
#: Entities of five kinds, found by other means than the engine's: runs are cut out and then tested, and the best of overlapping ones stay.
_ENTITIES = f"""
docs AS (SELECT doc_id AS d, text FROM documents WHERE text IS NOT NULL),
mails AS (SELECT d, s, v, 'EMAIL' AS type, 'email' AS recognizer, 0.99 AS score FROM ({_found(_MAIL)})),
calls AS (SELECT d, s, v, 'PHONE' AS type, 'phone' AS recognizer, 0.95 AS score
  FROM (SELECT d, text, s, regexp_replace(regexp_replace(rtrim(v, ' .)'), '\n[ \t]*[0-9]{{1,3}}$', ''), '[ .)\n\t]+$', '') AS v FROM ({_found(_CALL, 1)}) WHERE NOT regexp_matches(substr(text, (s + length(v) + 1)::BIGINT, 1), '[0-9]'))
  WHERE length({_bare("v")}) BETWEEN 8 AND 15),
cards AS (SELECT d, s, v, 'CREDIT_CARD' AS type, 'credit_card' AS recognizer, 0.95 AS score FROM ({_found(_CARD, 1)})
  WHERE NOT regexp_matches(substr(text, (s + length(v) + 1)::BIGINT, 2), '^([0-9]|[.,][0-9])') AND length({_bare("v")}) BETWEEN 13 AND 19 AND {_LUHN(_bare("v"))} = 0),
american AS (SELECT d, s, v, 'PHONE' AS type, 'phone' AS recognizer, 0.75 AS score FROM ({_found(_AMERICAN, 1)}) WHERE NOT regexp_matches(substr(text, (s + length(v) + 1)::BIGINT, 1), '[A-Za-z0-9_-]')),
twelve AS (SELECT d, s, v, 'AADHAAR' AS type, 'aadhaar' AS recognizer, 0.93 AS score FROM ({_found(_TWELVE, 1)})
  WHERE NOT regexp_matches(substr(text, (s + length(v) + 1)::BIGINT, 2), '^([0-9-]|[.,][0-9])') AND ({_VERHOEFF(_bare("v"))} OR {_cue(60, 20, ("aadhaar", "aadhar", "uid"))})),
quads AS (SELECT d, text, s, rtrim(v, '.') AS v FROM ({_found("[0-9.]+")})
  WHERE regexp_full_match(rtrim(v, '.'), '({_OCTET}[.]){{3}}{_OCTET}') AND NOT regexp_matches(substr(text, s::BIGINT, 1), '[A-Za-z0-9_]') OR s = 0),
hosts AS (SELECT d, s, v, 'IP_ADDRESS' AS type, 'ip_address' AS recognizer, 0.95 AS score FROM quads
  WHERE regexp_full_match(v, '({_OCTET}[.]){{3}}{_OCTET}') AND NOT {_cue(24, 0, patterns.VERSION)}
    AND ({_cue(60, 25, patterns.NETWORK)} OR regexp_matches(v, '^(10|127|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]') OR len(list_filter(string_split(v, '.'), lambda o: o::INT > 31)) >= 2)),
bag AS (SELECT *, s + length(v) AS e, CASE type {" ".join(f"WHEN '{k}' THEN {n}" for k, n in PRIORITY.items())} END AS p FROM (FROM mails UNION ALL FROM calls UNION ALL FROM cards UNION ALL FROM american UNION ALL FROM twelve UNION ALL FROM hosts)),
entities AS (SELECT d, s, e, v, type, recognizer, score FROM bag a WHERE NOT EXISTS (
  SELECT 1 FROM bag b WHERE a.d = b.d AND a.s < b.e AND b.s < a.e AND (b.p, b.e - b.s, b.score, -b.s) > (a.p, a.e - a.s, a.score, -a.s)))"""
_flat = "regexp_replace(trim(v), '\\s+', ' ', 'g')"


def _word(key: str, k: int) -> str:
    """The k-th draw of a key, by HMAC in SQL."""
    return f"('0x' || substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode({key} || '|{k // 8}')))), {1 + 8 * (k % 8)}, 8))::BIGINT"


_COUNTRY = fakes.COUNTRY.pattern
_laid = lambda new: f"list_aggregate(list_transform(range(1, length(o) + 1), lambda i: CASE WHEN regexp_matches(substr(o, i, 1), '[0-9]') THEN substr({new}, length(regexp_replace(substr(o, 1, i), '[^0-9]', '', 'g')), 1) ELSE substr(o, i, 1) END), 'string_agg', '')"
_pick = lambda pool, key, k: f"({list(pool)})[({_word(key, k)} % {len(pool)} + 1)::INT]"
_SLUG = lambda v: f"lower({_pick(fakes.HEADS, f"'ORGANIZATION|' || {v}", 0)} || {_pick(fakes.TAILS, f"'ORGANIZATION|' || {v}", 1)})"
_digit = lambda key, k: f"({_word(key, k)} % 10)::VARCHAR"
_BODY = "substr(n, 1, 1) || " + " || ".join(f"CASE WHEN length(n) > {k + 1} THEN {_digit("'CREDIT_CARD|' || o", k)} ELSE '' END" for k in range(1, 18))
_CALLED = " || ".join(f"CASE WHEN {k} >= length(n) THEN '' WHEN {k} < length(c) THEN substr(n, {k + 1}, 1) WHEN {k} = length(c) THEN ({_word("'PHONE|' || lower(o)", k)} % 9 + 1)::VARCHAR ELSE {_digit("'PHONE|' || lower(o)", k)} END" for k in range(15))
_AADHAAR = f"({_word("'AADHAAR|' || o", 0)} % 8 + 2)::VARCHAR || " + " || ".join(_digit("'AADHAAR|' || o", k) for k in range(1, 11))
#: Surrogates of values (type, o): the formats filled in SQL.
_NEW = f"""
o AS (SELECT DISTINCT type, {_flat} AS o FROM entities),
card AS (SELECT o, b || ((10 - {_LUHN("(b || '0')")}) % 10)::BIGINT AS w FROM (SELECT o, {_BODY} AS b FROM (SELECT o, {_bare("o")} AS n FROM o WHERE type = 'CREDIT_CARD'))),
twelve_new AS (SELECT o, b || list_filter(range(0, 10), lambda k: {_VERHOEFF("(b || k)")})[1] AS w FROM (SELECT o, {_AADHAAR} AS b FROM o WHERE type = 'AADHAAR')),
call AS (SELECT o, {_CALLED} AS w FROM (SELECT o, {_bare("o")} AS n, CASE WHEN regexp_matches(o, '^[( ]*\\+') THEN regexp_extract({_bare("o")}, '^({_COUNTRY})', 1) ELSE '' END AS c FROM o WHERE type = 'PHONE')),
part AS (SELECT o, i, f, regexp_replace(lower(f), '[0-9]+$', '') AS w FROM (SELECT o, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS f FROM (SELECT o, string_split(split_part(o, '@', 1), '.') AS p FROM o WHERE type = 'EMAIL'))),
local AS (SELECT o, string_agg(CASE WHEN length(w) >= 3 AND regexp_full_match(w, '[a-z]+') AND len(list_filter({sorted(fakes.ROLES)}, lambda r: w = r OR length(r) >= 4 AND contains(w, r))) = 0
  THEN {_SLUG("w")} ELSE lower(f) END, '.' ORDER BY i) AS l FROM part GROUP BY o),
mail AS (SELECT o, l || '@' || {_SLUG("lower(split_part(o, '@', 2))")} || '.example.com' AS w FROM local),
new AS (
  SELECT 'CREDIT_CARD' AS type, o, {_laid("w")} AS w FROM card UNION ALL SELECT 'PHONE', o, {_laid("w")} FROM call UNION ALL SELECT 'AADHAAR', o, {_laid("w")} FROM twelve_new UNION ALL SELECT 'EMAIL', o, w FROM mail UNION ALL
  SELECT 'IP_ADDRESS', o, {_pick(fakes.DOC_NETS, "'IP_ADDRESS|' || o", 0)} || ({_word("'IP_ADDRESS|' || o", 1)} % 254 + 1) FROM o WHERE type = 'IP_ADDRESS'),
piece AS (SELECT d, s, e, substr(text, (coalesce(lag(e) OVER (PARTITION BY d ORDER BY s), 0) + 1)::BIGINT, (s - coalesce(lag(e) OVER (PARTITION BY d ORDER BY s), 0))::BIGINT) || w AS x
  FROM (SELECT entities.*, {_flat} AS o FROM entities) JOIN new USING (type, o) JOIN docs USING (d)),
done AS (SELECT d, count(*) AS n, string_agg(x, '' ORDER BY s) || substr(any_value(text), (max(e) + 1)::BIGINT) AS redacted FROM piece JOIN docs USING (d) GROUP BY d)"""
_TURNS = "docs AS (SELECT conv_id AS d, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
_SIDES = """
g AS (SELECT user_id AS id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS type, event_id * 100 AS s FROM events WHERE event_id % 5 < 3),
p AS (SELECT user_id AS id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS type, event_id * 100 + event_id % 3 * 3 AS s FROM events WHERE event_id % 5 > 0)"""
_SCORES = lambda on: f"""
WITH {_SIDES},
c AS (SELECT type, count(*) AS g, 0 AS p, 0 AS b FROM g GROUP BY 1 UNION ALL SELECT type, 0, count(*), 0 FROM p GROUP BY 1
      UNION ALL SELECT g.type, 0, 0, count(*) FROM g JOIN p ON g.id = p.id AND g.type = p.type AND {on} GROUP BY 1),
t AS (SELECT type, sum(b)::BIGINT AS tp, (sum(p) - sum(b))::BIGINT AS fp, (sum(g) - sum(b))::BIGINT AS fn FROM c GROUP BY ROLLUP (type))
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM t"""  # noqa: E731
SQL = {
    "detect_entities": f"""WITH {_ENTITIES} SELECT d AS doc_id, type, s::INT AS start, e::INT AS "end", v AS text, recognizer, score::DOUBLE AS score, '' AS notes FROM entities""",
    "counts_by_type": f"WITH {_ENTITIES} SELECT type, count(*) AS n FROM entities GROUP BY type",
    "entities_by_recognizer": f"WITH {_ENTITIES} SELECT type, recognizer, count(*) AS n, count(DISTINCT v) AS distinct_values FROM entities GROUP BY ALL",
    "kept_domains": f"""WITH {_ENTITIES}, known AS (SELECT DISTINCT lower(v) AS v FROM mails WHERE lower(v) < 'm' ORDER BY 1 LIMIT 5)
      SELECT mails.v AS text, count(*) AS n FROM mails LEFT JOIN known ON lower(mails.v) = known.v WHERE known.v IS NULL GROUP BY 1""",
    "surrogate_numbers": f"WITH {_ENTITIES}, {_NEW.replace('FROM entities),', "FROM bag WHERE type IN ('CREDIT_CARD', 'IP_ADDRESS')),", 1)} SELECT type, o AS original, w AS surrogate FROM new",
    "surrogate_mapping": f"WITH {_ENTITIES}, {_NEW} SELECT type, o AS original, w AS surrogate FROM new",
    "redact_documents": f"WITH {_ENTITIES}, {_NEW} SELECT d AS doc_id, n::INT AS n_entities, redacted FROM done",
    "redact_conversations": f"""WITH {_ENTITIES.replace("docs AS (SELECT doc_id AS d, text FROM documents WHERE text IS NOT NULL)", _TURNS)}, {_NEW}
      SELECT d AS conv_id, coalesce(n, 0)::INT AS n_entities, coalesce(redacted, text) AS redacted FROM docs LEFT JOIN done USING (d)""",
    "dictionary_mentions": """
      WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS a FROM documents),
      b AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS a FROM benchmark),
      f AS (SELECT DISTINCT array_to_string(a[:n], ' ') AS form, n FROM b, (VALUES (2), (4)) AS k(n)),
      g AS (SELECT doc_id, n, array_to_string(a[i : i + n - 1], ' ') AS form FROM (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM w, (VALUES (2), (4)) AS k(n)))
      SELECT doc_id, form, 'words' || n AS type, count(*) AS n FROM g JOIN f USING (form, n) GROUP BY ALL""",
    "verhoeff_numbers": f"""
      WITH x AS (SELECT (200000000000 + l_orderkey * 1000 + l_linenumber)::VARCHAR AS number, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT number, n, {_VERHOEFF("number")} AS valid FROM x""",
    "resolved_spans": """
      WITH RECURSIVE x AS (SELECT user_id, event_id * 7919 % 5000 AS s, event_id * 7919 % 5000 + 1 + event_id * 31 % 40 AS e,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id * 31 % 40 * 1000000 + event_id % 1000000 DESC, event_id * 7919 % 5000) AS r FROM events),
      k AS (SELECT user_id, 0::BIGINT AS r, []::STRUCT(s BIGINT, e BIGINT)[] AS kept FROM (SELECT DISTINCT user_id FROM x)
        UNION ALL SELECT user_id, x.r, CASE WHEN len(list_filter(kept, lambda z: z.s < x.e AND x.s < z.e)) > 0 THEN kept ELSE list_append(kept, {'s': x.s, 'e': x.e}) END FROM k JOIN x USING (user_id) WHERE x.r = k.r + 1)
      SELECT user_id, z.s AS start, z.e AS "end" FROM (SELECT user_id, unnest(kept) AS z FROM (SELECT user_id, kept FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1))""",
    "context_tokens": f"""WITH docs AS (SELECT doc_id AS d, text FROM documents), h AS ({_found("[0-9a-f]{40}")})
      SELECT d AS doc_id, count(*) AS n, min(v) AS least FROM h WHERE {_cue(20, 0, ("token",))} GROUP BY d""",
    "clean_blocks": """SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(translate(text || chr(8203) || ' ' || chr(160) || ' x . com', chr(160), ' '), chr(8203), '', 'g'), '[ \\t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '([A-Za-z0-9_-])[.]\\s+(com|in|net|org|io|gov|edu|biz|info)\\b', '\\1.\\2', 'g') AS text FROM conversations""",
    "strict_scores": _SCORES("g.s = p.s"),
    "partial_scores": _SCORES("g.s < p.s + 5 AND p.s < g.s + 5"),
    "email_spans": f"WITH {_ENTITIES} SELECT d AS doc_id, v AS value, count(*) AS times FROM mails GROUP BY ALL",
    "luhn_numbers": """
      WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM documents),
      kinds AS (SELECT value, count(*) AS n, min(doc_id) AS first_doc FROM runs WHERE length(value) = 16 GROUP BY value)
      SELECT value, n, first_doc, list_sum([CASE WHEN i % 2 = 0 THEN substr(value, i, 1)::INT ELSE (2 * substr(value, i, 1)::INT) // 10 + (2 * substr(value, i, 1)::INT) % 10 END FOR i IN range(1, 17)]) % 10 = 0 AS valid
      FROM kinds""",
    "hmac_draws": "SELECT c_custkey, " + ", ".join(map(_DRAW, (0, 7, 8))) + " FROM customer",
    "segment_starts": "SELECT conv_id, turn, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations",
    "bucketed_spans": """
      WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, length(text) AS n FROM conversations),
      m AS (SELECT conv_id, unnest(range(0, max(a + n) + 1, 500)) AS p FROM s GROUP BY conv_id)
      SELECT conv_id, turn, p - a AS start, p - a + 3 AS "end" FROM m JOIN s USING (conv_id) WHERE p >= a AND p < a + n AND p + 3 <= a + n""",
    "merged_islands": f"""
      WITH x AS ({_EVENTS}), y AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x),
      z AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y)
      SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM z GROUP BY user_id, k""",
    "deduped_spans": """SELECT user_id, event_id * 7919 % 5000 AS start, event_id * 7919 % 5000 + 1 + event_id * 31 % 40 AS "end", event_id, event_id * 17 % 7 AS rank FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, start, "end" ORDER BY rank DESC, event_id) = 1""",
    "url_hosts": f"SELECT *, host IN ({', '.join(repr(x) for x in policy.PUBLIC_DOMAINS)}) OR {' OR '.join(f'suffix(host, {x!r})' for x in policy.PUBLIC_ENDINGS)} AS public FROM (SELECT regexp_replace(regexp_extract(lower(url), '^(?:https?://)?([^/]*)', 1), '^www[.]', '') AS host, count(*) AS pages FROM pages GROUP BY 1)",
    "identifiers_by_quality": "SELECT quality, toxic, count(*) AS docs, sum(contains(text, '@')::INT)::BIGINT AS with_at FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "at_signs_rollup": "SELECT lang, source, count(*) AS docs, sum(length(text) - length(replace(text, '@', '')))::BIGINT AS at_signs FROM documents GROUP BY ROLLUP (lang, source)",
    "top_documents": "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents ORDER BY numbers DESC, doc_id LIMIT 20",
    "anti_joined_benchmark": f"""WITH {_ENTITIES.replace("doc_id AS d, text FROM documents", "item_id AS d, text FROM benchmark")} SELECT item_id, length(text) AS size FROM benchmark ANTI JOIN entities ON item_id = d""",
}
