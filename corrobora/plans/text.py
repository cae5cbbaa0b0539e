"""Queries over the text, date and score expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import scores, text
from corrobora.plans.base import table
from corrobora.plans.registry import query


@query("text_clean", r"""SELECT doc_id, length(c) AS n, md5(c) AS h FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
'\[(?:\d{1,3}|[a-z])\]', '', 'g'), '[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS c FROM documents)""")
def text_clean(spark, d):
    c = table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("h"))


@query("paragraph_clean", r"""SELECT doc_id, length(c) AS n, md5(c) AS h FROM (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(regexp_replace(regexp_replace(regexp_replace(
replace(replace(replace(replace(replace(replace(replace(p, '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
'\[(?:\d{1,3}|[a-z])\]', '', 'g'), '[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS c FROM documents)""")
def paragraph_clean(spark, d):
    c = text.clean_paragraphs(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("h"))


# Raw texts are written the same way for both engines; the SQL then applies the rule to them, with another engine's patterns.
_TITLES = """CASE p_size % 8 WHEN 0 THEN 'Show Ep. ' || p_partkey || ': ' || p_name WHEN 1 THEN 'Show Ep. ' || (p_partkey + 1) || ': ' || p_name WHEN 2 THEN 'Episode #' || p_partkey || ' - ' || p_name || '  &amp; more'
WHEN 3 THEN p_name || ' alone' WHEN 4 THEN '#' || p_partkey WHEN 5 THEN 'E' || p_partkey || '|' || p_name WHEN 6 THEN 'Special one #' || p_partkey || ' ' || p_name ELSE '' END"""
_SAID = r"""coalesce(nullif(regexp_extract(t, '(?i)(?:\b(?:episode|ep\.?|e)\s*#?\s*|#\s*)0*(\d{1,4})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(t, '^\s*0*(\d{1,4})\s*$', 1), ''))::INT"""


@query("title_canonical", rf"""WITH r AS (SELECT p_partkey AS n, {_TITLES} AS t FROM part),
c AS (SELECT n, {_SAID} AS said, trim(regexp_replace(regexp_replace(replace(t, '&amp;', '&'), '\s+', ' ', 'g'), '(?i)^.*?(?:\b(?:episode|ep\.?|e)\s*#?\s*|#\s*)\d{{1,4}}\s*[-:|]*\s*', '')) AS rest FROM r)
SELECT n AS p_partkey, 'Episode #' || CASE WHEN n < 1000 THEN printf('%03d', n) ELSE n::VARCHAR END || CASE WHEN rest <> '' AND coalesce(said BETWEEN 1 AND 2000, false) = false OR rest <> '' AND said = n THEN ' - ' || rest ELSE '' END AS title FROM c""")
def title_canonical(spark, d):
    return table(spark, d, "part").select("p_partkey", text.canonical_title(F.expr(_TITLES), F.col("p_partkey")).alias("title"))


_NUMBERED = """CASE p_size % 8 WHEN 0 THEN '  E0' || p_size * 50 || ' ' WHEN 1 THEN 'Ep. 20' || p_partkey || ' and #7' WHEN 2 THEN ' 00' || p_size || ' ' WHEN 3 THEN 'The 12 races' WHEN 4 THEN 'time #' || p_partkey
WHEN 5 THEN 'one 5 Episode ' || p_size || 'b' WHEN 6 THEN 'episode # ' || p_partkey || p_partkey ELSE p_partkey || '' END"""


@query("number_from_text", rf"""SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 2000 THEN n END AS number FROM (SELECT p_partkey, {_SAID} AS n FROM (SELECT p_partkey, {_NUMBERED} AS t FROM part))""")
def number_from_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.entity_number(F.expr(_NUMBERED)).alias("number"))


_PEOPLE = """CASE c_custkey % 9 WHEN 0 THEN '• <b>' || c_mktsegment || '</b> Lee (guest)' WHEN 1 THEN '3. Ann-' || c_mktsegment WHEN 2 THEN 'Ünal ' || c_mktsegment || ' [2]' WHEN 3 THEN c_mktsegment || ' Kim - host of all' WHEN 4 THEN 'TBA'
WHEN 5 THEN '<i></i>' WHEN 6 THEN 'a = b; ' || c_mktsegment WHEN 7 THEN ' ' || c_name || ' ' ELSE 'X' END"""
_NAME_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '^[\s*·•-]+|^\s*\d+[.)]\s*', '', 'g'), '\s*[(\[][^)\]]*[)\]]\s*$|\s+[-–]\s+.*$', '', 'g'), '\s+', ' ', 'g'))"""


@query("person_names", rf"""SELECT c_custkey, name, nullif(lower(regexp_replace(replace(replace(name, 'Ü', 'u'), 'ü', 'u'), '[^\pL\pN]+', '', 'g')), '') AS key FROM (
SELECT c_custkey, CASE WHEN length(n) BETWEEN 2 AND 60 AND NOT regexp_matches(n, '[{{}}<>;=]|^\W+$') AND lower(n) NOT IN ('guest', 'guests', 'tba', 'none', 'n/a') THEN n END AS name FROM (SELECT c_custkey, {_NAME_SQL} AS n FROM (SELECT c_custkey, {_PEOPLE} AS t FROM customer)))""")
def person_names(spark, d):
    name = text.person_name(F.expr(_PEOPLE))
    return table(spark, d, "customer").select("c_custkey", name.alias("name"), text.identity_key(name).alias("key"))


_SPELT = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN upper(left(p_name, 1)) || substr(p_name, 2) WHEN 3 THEN replace(p_name, ' ', '-') ELSE upper(left(p_name, 1)) || replace(substr(p_name, 2), ' ', '-') END"


@query("best_spelling", rf"""SELECT k, arg_max(s, (score, -p_partkey)) AS best, max(score)::INT AS score FROM (SELECT p_partkey, replace(lower(s), '-', ' ') AS k, s, CASE WHEN regexp_matches(s, '^\p{{Lu}}') THEN 2 ELSE 0 END + CASE WHEN contains(s, '-') THEN 3 ELSE 0 END
+ CASE WHEN regexp_matches(s, '^(?:\p{{Lu}}\p{{Ll}}+[ -]?)+$') THEN 3 ELSE 0 END - CASE WHEN s = upper(s) AND s <> lower(s) THEN 3 ELSE 0 END - CASE WHEN s = lower(s) AND s <> upper(s) THEN 2 ELSE 0 END AS score FROM (SELECT p_partkey, {_SPELT} AS s FROM part)) GROUP BY 1""")
def best_spelling(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.expr(_SPELT).alias("s")).withColumn("score", text.spelling_score(F.col("s")))
    return named.groupBy(F.replace(F.lower("s"), F.lit("-"), F.lit(" ")).alias("k")).agg(F.max_by("s", F.struct("score", -F.col("p_partkey"))).alias("best"), F.max("score").alias("score"))


_PLACES = """CASE s_suppkey % 6 WHEN 0 THEN s_name || ' , ' || n_name || '-si,Korea' WHEN 1 THEN s_name || ', ' || n_name || ' city,  ' || r_name WHEN 2 THEN n_name WHEN 3 THEN n_name || '-gu, Republic of Korea' WHEN 4 THEN 'Hall A, ' || s_name || ', ' || n_name || ', ' || r_name ELSE s_name || ',' || r_name END"""


@query("location_parse", rf"""WITH p AS (SELECT s_suppkey, list_transform(regexp_split_to_array({_PLACES}, '\s*,\s*'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT *, lower(a[-1]) IN ('korea', 'south korea', 'republic of korea') OR len(a) = 1 AS home FROM p)
SELECT s_suppkey, a[1] AS name, regexp_replace(CASE WHEN len(a) > 2 THEN a[-2] WHEN len(a) = 2 THEN a[1] END, '(?i)[- ](?:si|city|gun|gu)$', '') AS city, CASE WHEN home THEN 'South Korea' ELSE a[-1] END AS country, NOT home AS is_overseas FROM h""")
def location_parse(spark, d):
    supplier, nation, region = (table(spark, d, n) for n in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("s_suppkey", text.place(F.expr(_PLACES)).alias("p")).select("s_suppkey", "p.*")


_LINKS = """CASE page_id % 8 WHEN 0 THEN '//x.org/a?b=1&amp;c=2' WHEN 1 THEN '/a/' || page_id WHEN 2 THEN url WHEN 3 THEN 'javascript:x' WHEN 4 THEN ' ' || url || ' ' WHEN 5 THEN 'http://a b' WHEN 6 THEN 'ftp://x.org' ELSE replace(url, 'e', '"') END"""


@query("url_normalise", rf"""SELECT page_id, CASE WHEN regexp_matches(k, '^https?://[^\s"''<>]+$') THEN k END AS link FROM (SELECT page_id, CASE WHEN starts_with(l, '//') THEN 'https:' || l WHEN starts_with(l, '/') THEN 'https://b.org' || l ELSE l END AS k FROM (SELECT page_id, trim(replace({_LINKS}, '&amp;', '&')) AS l FROM pages))""")
def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", text.absolute_url(F.expr(_LINKS), "https://b.org/").alias("link"))


@query("stable_hashes", """SELECT l_orderkey, sha1(string_agg(m, '|' ORDER BY m)) AS h FROM (SELECT DISTINCT l_orderkey, lower(l_returnflag || l_linestatus) AS m FROM lineitem) GROUP BY 1""")
def stable_hashes(spark, d):
    marks = F.collect_set(F.concat("l_returnflag", "l_linestatus"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(text.stable_list_hash(marks).alias("h"))


@query("comparison_keys", "SELECT k, count(*) AS n FROM (SELECT left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 120) AS k FROM documents) GROUP BY 1 HAVING n > 1")
def comparison_keys(spark, d):
    k = text.comparison_key(F.col("text")).alias("k")
    return table(spark, d, "documents").groupBy(k).agg(F.count("*").alias("n")).where("n > 1")


@query("summary_sentence", """SELECT c_custkey, CASE n WHEN 1 THEN a[1] ELSE array_to_string(a[:n - 1], ', ') || ' and ' || a[n] END AS said FROM (
SELECT o_custkey AS c_custkey, list(k ORDER BY k) AS a, len(list(k)) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority AS k FROM orders) GROUP BY 1)""")
def summary_sentence(spark, d):
    items = F.array_sort(F.collect_set("o_orderpriority"))
    said = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(items.alias("a"))
    return said.select("c_custkey", text.spoken_list(F.col("a")).alias("said"))


@query("redact", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(token|secret|password|api_?key)(\s*[=:]\s*)"?[^\s"&]+"?', '\1\2***', 'g'),
'(?i)([?&](?:key|token|sig)=)[^&\s]+', '\1***', 'g'), '\b[0-9a-f]{32,}\b', '***', 'g')) AS h FROM documents""")
def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.redacted(F.col("text")).cast("binary")).alias("h"))


@query("lexical_variety", r"""SELECT doc_id, round(len(list_distinct(w)) / len(w), 4) AS variety, len(w) >= 25 AND len(list_distinct(w)) / len(w) < 0.35 AS dull
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def lexical_variety(spark, d):
    words = F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    v = table(spark, d, "documents").select("doc_id", text.lexical_variety(F.col("text")).alias("variety"), words.alias("n"))
    return v.select("doc_id", "variety", ((F.col("n") >= 25) & (F.col("variety") < 0.35)).alias("dull"))


@query("shorten", "SELECT doc_id, CASE WHEN length(text) <= 70 THEN text ELSE rtrim(left(text, 69)) || '…' END AS snippet FROM documents")
def shorten(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text"), 70).alias("snippet"))


_MONTH = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left({}, 3)))"
_DATES = r"""WITH t AS (SELECT k, regexp_replace(raw, '\s*\([^)]*\)', '', 'g') AS t FROM ({raw})),
p AS (SELECT k, t, regexp_extract(t, '(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}})', ['y', 'm', 'd']) AS i, regexp_extract(t, '(\d{{4}})년\s*(\d{{1,2}})월\s*(\d{{1,2}})일', ['y', 'm', 'd']) AS o,
regexp_extract(t, '(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})', ['d', 'm', 'y']) AS a, regexp_extract(t, '([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})', ['m', 'd', 'y']) AS b FROM t),
f AS (SELECT k, coalesce(try_cast(i.y || '-' || lpad(i.m, 2, '0') || '-' || lpad(i.d, 2, '0') AS DATE), try_cast(o.y || '-' || lpad(o.m, 2, '0') || '-' || lpad(o.d, 2, '0') AS DATE),
try_cast(a.y || '-' || lpad({am}::VARCHAR, 2, '0') || '-' || lpad(a.d, 2, '0') AS DATE), try_cast(b.y || '-' || lpad({bm}::VARCHAR, 2, '0') || '-' || lpad(b.d, 2, '0') AS DATE)) AS day FROM p)
SELECT k AS o_orderkey, CASE WHEN year(day) BETWEEN 1995 AND 1998 THEN day::VARCHAR END AS day FROM f"""
_RAW_DATES = """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y') || ' (filmed 2 May 2001)'
WHEN 3 THEN strftime(o_orderdate, '%Y년 %-m월 %-d일') WHEN 4 THEN '1996-02-30' WHEN 5 THEN 'aired ' || strftime(o_orderdate, '%d.%m.%Y') ELSE 'on ' || strftime(o_orderdate, '%Y.%m.%d') || ' at noon' END AS raw FROM orders"""


@query("date_parse", _DATES.format(raw=_RAW_DATES, am=_MONTH.format("a.m"), bm=_MONTH.format("b.m")))
def date_parse(spark, d):
    when, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    written = lambda form: F.date_format(when, form)
    raw = (
        F.when(k == 0, written("yyyy-M-d")).when(k == 1, written("d MMMM yyyy")).when(k == 2, F.concat(written("MMM d, yyyy"), F.lit(" (filmed 2 May 2001)")))
        .when(k == 3, written("yyyy'년' M'월' d'일'")).when(k == 4, "1996-02-30").when(k == 5, F.concat(F.lit("aired "), written("dd.MM.yyyy")))
        .otherwise(F.concat(F.lit("on "), written("yyyy.MM.dd"), F.lit(" at noon")))
    )
    return table(spark, d, "orders").select("o_orderkey", text.parsed_date(raw, 1995, 1998).cast("string").alias("day"))


@query("duration_text", """SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN ms // 1000 || ' s' ELSE ms // 60000 || ' min ' || (ms // 1000) % 60 || ' s' END AS said
FROM (SELECT event_id, (round(value) * round(value) * 40)::BIGINT AS ms FROM events)""")
def duration_text(spark, d):
    ms = (F.round("value") * F.round("value") * 40).cast("long")
    return table(spark, d, "events").select("event_id", text.spoken_duration(ms).alias("said"))


@query("backoff", "SELECT user_id, n AS attempts, least(86400, (900 * least(16, pow(2, greatest(n - 1, 0))))::INT)::INT AS seconds FROM (SELECT user_id, count(*) FILTER (event_type = 'error') % 8 AS n FROM events GROUP BY 1)")
def backoff(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") % 8).alias("attempts"))
    return n.select("user_id", "attempts", scores.backoff(F.col("attempts"), 900, 86400).alias("seconds"))


@query("reliability_shrink", """WITH o AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS samples, count(*) FILTER (event_type <> 'error' AND value >= 50) AS agree, count(*) FILTER (event_type = 'error') AS fails FROM events GROUP BY 1)
SELECT user_id, samples, round(CASE WHEN samples < 3 THEN 68 ELSE 68 * (1 - least(0.65::DOUBLE, samples / 60)) + 100.0::DOUBLE * agree / samples * (1 - least(0.5::DOUBLE, fails / (samples + fails))) * least(0.65::DOUBLE, samples / 60) END)::INT AS reliability FROM o""")
def reliability_shrink(spark, d):
    ok = F.col("event_type") != "error"
    o = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(ok).alias("samples"), F.count_if(ok & (F.col("value") >= 50)).alias("agree"), F.count_if(~ok).alias("fails"))
    return o.select("user_id", "samples", scores.shrunk(F.lit(68), F.col("agree"), F.col("samples"), F.col("fails")).alias("reliability"))


@query("prior_bands", """SELECT s_suppkey, p AS prior, CASE WHEN p >= 85 THEN 'excellent' WHEN p >= 70 THEN 'good' WHEN p >= 50 THEN 'fair' ELSE 'poor' END AS band FROM (
SELECT s_suppkey, greatest(0, least(99, [80, 68, 55][1 + s_suppkey % 3] + [6, 2, 0, -6][1 + s_nationkey % 4] - CASE WHEN s_suppkey % 7 = 0 THEN 25 ELSE least(18, 4 * (s_suppkey % 7)) END)) AS p FROM supplier)""")
def prior_bands(spark, d):
    tier, kind = F.col("s_suppkey") % 3 + 1, F.element_at(F.array(*map(F.lit, ("official", "database", "wiki", "blog"))), F.col("s_nationkey") % 4 + 1)
    rank = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 7)
    p = table(spark, d, "supplier").select("s_suppkey", scores.prior(tier, kind, rank).alias("prior"))
    return p.withColumn("band", scores.band(F.col("prior")))


@query("image_scores", """SELECT p_partkey, round(greatest(0, least(1, (0.35 * (p_size / 50) + 0.30 * least(1.0::DOUBLE, (p_size * 40) * (p_size * 20 + 100) / 921600.0) + 0.15 * greatest(0.0::DOUBLE, 1 - abs((p_size * 40) / (p_size * 20 + 100) - 16.0::DOUBLE / 9) / 2)
+ 0.20 * (p_partkey % 2)) * CASE WHEN p_partkey % 5 = 0 THEN 0.85 ELSE 1 END)), 2) AS score FROM part""")
def image_scores(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", scores.image_score(s / 50, s * 40, s * 20 + 100, k % 2, k % 5 == 0).alias("score"))
