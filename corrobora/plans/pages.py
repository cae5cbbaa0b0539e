"""Queries over raw pages and conversations: links, titles, profiles, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import grounding as ground
from corrobora.plans.base import table
from corrobora.plans.registry import query
from corrobora.sources import html


@query("html_links", """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1))) AS link FROM pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


@query("html_title")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("html_profile", r"""SELECT page_id, length(html) AS n_chars, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<p>')) AS paragraphs,
length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS visible,
contains(html, '<table') AS has_table FROM pages""")
def html_profile(spark, d):
    h = F.col("html")
    n = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return table(spark, d, "pages").select(
        "page_id", F.length(h).cast("long").alias("n_chars"), n("<script").alias("scripts"), n("<p>").alias("paragraphs"),
        F.length(html.visible_text(h)).cast("long").alias("visible"), F.contains(h, F.lit("<table")).alias("has_table"))


@query("page_hosts", r"""SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS pages, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS addresses FROM pages GROUP BY 1""")
def page_hosts(spark, d):
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)).alias("host")
    return table(spark, d, "pages").groupBy(host).agg(F.count("*").alias("pages"), F.countDistinct(F.regexp_replace(url, r"[?#].*$", "")).alias("addresses"))


@query("page_diagnosis")
def page_diagnosis(spark, d):
    number = F.col("page_id") % 100
    return table(spark, d, "pages").groupBy(html.diagnosis(F.col("html"), number).alias("why")).agg(F.count("*").alias("n"))


@query("list_items", r"""SELECT page_id, pos, item FROM (SELECT page_id, unnest(a) AS item, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS a FROM pages))""")
def list_items(spark, d):
    items = F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(items).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


@query("list_cells")
def list_cells(spark, d):
    """The navigation lists, laid out as tables and scanned by the table parser."""
    as_table = F.replace(F.replace(F.replace(F.replace("html", F.lit("<ul>"), F.lit("<table>")), F.lit("</ul>"), F.lit("</table>")), F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("</td></tr>"))
    return html.table_cells(table(spark, d, "pages").select("page_id", as_table.alias("html")), "page_id", "html")


_GROUNDING = r"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g') AS s, lower(coalesce(text, '')) AS low,
list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN''-]+')) AS vocab, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words FROM conversations),
c AS (SELECT a.conv_id, a.turn, a.words, b.vocab, a.low, regexp_extract_all(a.s, '(?:^|[.!?]\s+)([A-Z][a-zA-Z''-]*)\b', 1) AS opening,
list_distinct(regexp_extract_all(a.s, '\b[A-Z][a-zA-Z''-]*(?:\s+(?:[A-Z][a-zA-Z''-]*|of|the|and))*\b')) AS phrases
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
u AS (SELECT *, len(list_filter(phrases, lambda p: regexp_matches(p, '\s') OR NOT list_contains(opening, p))) AS n_claims,
list_sort(list_filter(phrases, lambda p: (regexp_matches(p, '\s') OR NOT list_contains(opening, p))
AND len(list_filter(regexp_split_to_array(lower(p), '\s+'), lambda w: NOT list_contains(string_split('SAFE', ' '), w) AND NOT list_contains(vocab, w))) > 0)) AS bad,
regexp_matches(low, '^[ "“\n\t]*(OPENERS)') AS generic FROM c)
SELECT conv_id, turn, words, n_claims, array_to_string(bad, '|') AS unsupported,
greatest(0, 96 - CASE WHEN words < 30 THEN 40 WHEN words < 50 OR words > 140 THEN 15 ELSE 0 END - CASE WHEN generic THEN 25 ELSE 0 END - 18 * len(bad)) AS confidence,
words >= 30 AND NOT generic AND len(bad) = 0 AS valid FROM u""".replace("SAFE", " ".join(ground.SAFE_WORDS)).replace("OPENERS", "|".join(ground.OPENERS).replace("'", "''"))


@query("grounding", _GROUNDING)
def grounding(spark, d):
    """Answers against the turn before them as evidence."""
    t, text = table(spark, d, "conversations"), F.col("text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), ground.vocabulary(text).alias("known"))
    said = t.where("role = 'assistant'").select(
        "conv_id", "turn", ground.word_count(text).alias("words"), ground.claims(text).alias("claims"), ground.generic_opening(text).alias("generic"))
    bad = said.join(before, ["conv_id", "turn"]).withColumn("bad", ground.unsupported(F.col("claims"), F.col("known")))
    n = F.size("bad")
    return bad.select(
        "conv_id", "turn", "words", F.size("claims").alias("n_claims"), F.array_join("bad", "|").alias("unsupported"),
        ground.confidence(F.col("words"), F.col("generic"), n).alias("confidence"),
        (~ground.too_short(F.col("words")) & ~F.col("generic") & (n == 0)).alias("valid"))


@query("turn_order_gaps", "SELECT conv_id, count(*) AS turns, max(turn) + 1 - count(DISTINCT turn) AS missing, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1")
def turn_order_gaps(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), (F.max("turn") + 1 - F.countDistinct("turn")).alias("missing"), F.count_if(F.col("role") == "user").alias("asked"))
