"""Queries over the validators, candidate collection and evidence building."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import text, validators
from corrobora.operators import evidence as ops
from corrobora.plans.base import table
from corrobora.plans.registry import query

_BASE = "https://example.org"
_NAV = "[" + ", ".join("'" + w + "'" for w in validators.NAV_WORDS) + "]"


def _nav(x):
    return f"len(list_filter({_NAV}, lambda w: contains(lower({x}), w))) > 0"


def _clean(x):
    for a, b in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '\\[(?:\\d{{1,3}}|[a-z])\\]', '', 'g')"
    x = f"regexp_replace(translate({x}, '\u00a0', ' '), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _paragraphs(x):
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda p: {_clean('p')}), lambda p: p <> ''), chr(10) || chr(10))"


_SYNOPSIS = rf"""(SELECT doc_id, v, CASE WHEN coalesce(trim(v), '') = '' THEN 'empty' WHEN length(v) < 15 THEN 'too short' WHEN length(v) > 4000 THEN 'too long'
WHEN regexp_matches(v, '(?i)members?\s+must\s+compete\s+in\s+a\s+series') THEN 'generic' WHEN {_nav('v')} THEN 'navigation' WHEN regexp_matches(v, '(?i)^\s*(?:watch|stream|download)\b.{{0,40}}(?:online|free|hd)\b') THEN 'tagline'
WHEN len(w) >= 25 AND len(list_distinct(w))::DOUBLE / len(w) < 0.35 THEN 'repetitive' WHEN len(regexp_extract_all(v, '\|')) > 6 OR len(regexp_extract_all(v, '•')) > 8 THEN 'menu' END AS reason
FROM (SELECT doc_id, v, regexp_split_to_array(lower(v), '\s+') AS w FROM (SELECT doc_id, {_paragraphs("regexp_replace(text, '<[^<>]*>', '', 'g')")} AS v FROM documents)))"""


@query("validate_synopsis", f"SELECT doc_id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN md5(v) END AS h FROM {_SYNOPSIS}")
def validate_synopsis(spark, d):
    v = table(spark, d, "documents").select("doc_id", F.inline(F.array(validators.synopsis(F.col("text")))))  # once for all three
    return v.select("doc_id", "valid", "reason", F.md5(F.col("value").cast("binary")).alias("h"))


@query("validate_titles", rf"""SELECT p_partkey, CASE WHEN length(v) < 4 THEN 'too short' WHEN length(v) > 300 THEN 'too long' WHEN {_nav('v')} THEN 'navigation' WHEN regexp_matches(v, '(?i)Episodes?\s*[-–]\s*Page\s*\d+') THEN 'paged index'
WHEN regexp_matches(v, '(?i)^\s*(?:home|episodes?|search|login|404|error)\s*$') THEN 'navigation label' WHEN regexp_matches(raw, '(?i)<[a-z][^>]*>') THEN 'raw HTML' END AS reason, v AS cleaned
FROM (SELECT p_partkey, raw, {_clean('raw')} AS v FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '<b>' || p_name WHEN 1 THEN left(p_name, 3) WHEN 2 THEN repeat(p_name || ' ', 40) WHEN 3 THEN 'Episodes - Page ' || p_size WHEN 4 THEN 'Home' ELSE p_name END AS raw FROM part))""")
def validate_titles(spark, d):
    k, name = F.col("p_size") % 6, F.col("p_name")
    raw = (F.when(k == 0, F.concat(F.lit("<b>"), name)).when(k == 1, F.substring(name, 1, 3)).when(k == 2, F.repeat(F.concat(name, F.lit(" ")), F.lit(40)))
           .when(k == 3, F.concat(F.lit("Episodes - Page "), F.col("p_size").cast("string"))).when(k == 4, "Home").otherwise(name))
    rows = table(spark, d, "part").withColumn("raw", raw)
    return rows.select("p_partkey", validators.title(F.col("raw"))["reason"].alias("reason"), text.clean(F.col("raw")).alias("cleaned"))


@query("validate_dates", """SELECT o_orderkey, CASE WHEN bad THEN 'no date' WHEN o_orderdate < DATE '1995-01-01' THEN 'before the first' WHEN o_orderdate > DATE '1998-01-01' + 60 THEN 'far in the future' WHEN abs(year(o_orderdate) - (1993 + o_orderkey % 6)) > 1 THEN 'another year' END AS reason
FROM (SELECT *, o_orderkey % 9 = 0 AS bad FROM orders)""")
def validate_dates(spark, d):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    v = validators.air_date(raw, F.lit("1998-01-01").cast("date"), (1993 + F.col("o_orderkey") % 6).cast("int"), "1995-01-01")
    return table(spark, d, "orders").select("o_orderkey", v["reason"].alias("reason"))


@query("validate_lists", r"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN '1999 Special' WHEN 1 THEN 'Ann ' || chr((65 + l_partkey % 5)::INT) ELSE 'ANN-' || chr((65 + l_suppkey % 5)::INT) END AS raw FROM lineitem),
g AS (SELECT k, arg_max(raw, (n, raw)) AS name, min((n, raw)) AS first FROM l WHERE NOT regexp_matches(raw, '\d{4}') GROUP BY k, lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g'))), r AS (SELECT k, string_agg(name, ', ' ORDER BY first) AS guests FROM g GROUP BY k)
SELECT DISTINCT l.k, guests, CASE WHEN guests IS NULL THEN 'no usable names' END AS reason FROM l LEFT JOIN r ON r.k = l.k""")
def validate_lists(spark, d):
    n = F.col("l_linenumber") % 3
    letter = lambda c: F.char((65 + F.col(c) % 5).cast("int"))
    raw = F.when(n == 0, "1999 Special").when(n == 1, F.concat(F.lit("Ann "), letter("l_partkey"))).otherwise(F.concat(F.lit("ANN-"), letter("l_suppkey")))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("n"), raw.alias("raw")).alias("x"))
    lists = lines.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["raw"]).alias("raw"))
    v = lists.select("k", validators.guests(F.col("raw")).alias("v"))
    return v.select("k", F.col("v.value").alias("guests"), "v.reason")


@query("validate_tags", r"""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'home' WHEN event_id % 2 = 0 THEN '#' || event_type ELSE upper(event_type) || ' ·' END AS raw FROM events),
c AS (SELECT user_id, event_id, regexp_replace(raw, '^[#·\s-]+|[·\s-]+$', '', 'g') AS name FROM s), u AS (SELECT user_id, lower(name) AS k, arg_max(name, event_id) AS name, min(event_id) AS first FROM c WHERE lower(name) <> 'home' GROUP BY 1, 2),
j AS (SELECT user_id, string_agg(name, ', ' ORDER BY first) AS tags FROM u GROUP BY 1) SELECT user_id, tags, tags IS NOT NULL AS valid FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN j USING (user_id)""")
def validate_tags(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "view", "home").when(F.col("event_id") % 2 == 0, F.concat(F.lit("#"), kind)).otherwise(F.concat(F.upper(kind), F.lit(" ·")))
    # The last spelling of each tag and its first place, before anything is collected: a user has few tags, but many events.
    named = table(spark, d, "events").select("user_id", "event_id", raw.alias("raw"))
    few = named.groupBy("user_id", F.lower(text.tag(F.col("raw"))).alias("k")).agg(F.max_by("raw", "event_id").alias("raw"), F.min("event_id").alias("first"))
    lists = few.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "raw"))), lambda x: x["raw"]).alias("raw"))
    v = lists.select("user_id", validators.tags(F.col("raw")).alias("v"))
    return v.select("user_id", F.col("v.value").alias("tags"), "v.valid")


@query("validate_urls", r"""SELECT page_id, CASE WHEN u IS NULL THEN 'malformed' WHEN regexp_matches(u, '(?i)/(?:logo|placeholder|default|no[-_]?image|blank|spacer|avatar)[-_.]') THEN 'placeholder' END AS reason, u FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://example.org/img/logo_' || page_id || '.png' ELSE url END AS u FROM pages)""")
def validate_urls(spark, d):
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("javascript:"), F.col("url"))).when(k == 1, F.concat(F.lit("/img/logo_"), F.col("page_id").cast("string"), F.lit(".png"))).otherwise(F.col("url"))
    v = table(spark, d, "pages").select("page_id", validators.image_url(raw, _BASE).alias("v"), text.absolute_url(raw, _BASE).alias("u"))
    return v.select("page_id", "v.reason", "u")


@query("validate_places", f"""SELECT c_custkey, reason, CASE WHEN reason IS NULL THEN n END AS name FROM (SELECT c_custkey, n, CASE WHEN coalesce(trim(n), '') = '' THEN 'unusable' WHEN {_nav('n')} THEN 'navigation' WHEN length(n) > 120 THEN 'too long' END AS reason
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Skip to content ' || c_name WHEN 2 THEN repeat(c_name, 20) ELSE c_name END AS n FROM customer))""")
def validate_places(spark, d):
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    raw = F.when(k == 0, "  , Seoul").when(k == 1, F.concat(F.lit("Skip to content "), name)).when(k == 2, F.repeat(name, F.lit(20))).otherwise(F.concat(name, F.lit("  , Busan, South Korea")))
    v = table(spark, d, "customer").select("c_custkey", validators.location(raw).alias("v"))
    return v.select("c_custkey", "v.reason", F.col("v.value").alias("name"))


_OFFERS = """o AS (SELECT event_id % 211 AS entity, 's' || user_id % 7 AS source, f AS field, CASE f WHEN 'episode_number' THEN CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE (event_id % 2600)::VARCHAR END WHEN 'mission' THEN CASE WHEN event_id % 5 = 0 THEN 'Please log in' ELSE event_type END ELSE '' END AS raw
FROM events, (VALUES ('episode_number'), ('mission'), ('_url'), ('empty')) t(f)), k AS (SELECT * FROM o WHERE field[1] <> '_' AND raw <> ''),
v AS (SELECT *, CASE WHEN field = 'episode_number' AND raw = 'n/a' THEN 'not numeric' WHEN field = 'episode_number' AND raw::INT NOT BETWEEN 1 AND 2000 THEN 'out of range' WHEN raw = 'Please log in' THEN 'navigation' END AS reason FROM k)"""


def _offers(spark, d):
    i = F.col("event_id")
    payload = F.create_map(
        F.lit("episode_number"), F.when(i % 4 == 0, "n/a").otherwise((i % 2600).cast("string")), F.lit("mission"), F.when(i % 5 == 0, "Please log in").otherwise(F.col("event_type")),
        F.lit("_url"), F.lit("x"), F.lit("empty"), F.lit(""))
    rows = table(spark, d, "events").select((i % 211).alias("entity"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("source"), payload.alias("payload"))
    return ops.flattened(rows, "payload")


@query("flatten_payloads", f"WITH {_OFFERS} SELECT field, source, count(*) AS n, count(DISTINCT raw) AS forms FROM k GROUP BY 1, 2")
def flatten_payloads(spark, d):
    return _offers(spark, d).groupBy("field", "source").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("forms"))


@query("collect_candidates", f"""WITH {_OFFERS} SELECT entity, field, arg_min(raw, (source, raw)) FILTER (reason IS NULL) AS value, count(*) FILTER (reason IS NULL) AS offers, coalesce(string_agg(DISTINCT source || ': ' || reason, '; ' ORDER BY source || ': ' || reason), '') AS rejected FROM v GROUP BY 1, 2""")
def collect_candidates(spark, d):
    found = ops.collected(_offers(spark, d), validators.check(F.col("field"), F.col("raw"), F.lit("2024-01-31").cast("date"), _BASE), F.col("source"))
    return found.select("entity", "field", F.col("first.value").alias("value"), "offers", F.array_join("rejected", "; ").alias("rejected"))


@query("source_outcomes", """SELECT user_id, event_id, CASE event_id % 8 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'NO_DATA' WHEN 2 THEN 'PARSER_ERROR' WHEN 3 THEN 'JAVASCRIPT_REQUIRED' WHEN 4 THEN 'RATE_LIMITED' WHEN 5 THEN 'NOT_APPLICABLE' WHEN 6 THEN 'TEMPORARY_ERROR' ELSE 'UNAVAILABLE' END AS status FROM events""")
def source_outcomes(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("ok", "missing_episode", "adapter_error", "needs_javascript", "suppressed", "disabled", "fetch_failed", "other")]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("user_id", "event_id", ops.outcome_word(said).alias("status"))


@query("normal_values", r"""SELECT doc_id, md5(trim(lower(regexp_replace(text, '[^\p{L}\p{N}\s]+', ' ', 'g')))) AS as_title, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS as_text FROM documents""")
def normal_values(spark, d):
    h = lambda c: F.md5(c.cast("binary"))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", h(ops.normal_value(F.lit("title"), F.col("text"))).alias("as_title"), h(ops.comparable(F.col("text"))).alias("as_text"))
