"""Searches of documents whose shape is not known: JSON payloads, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.plans.base import table
from corrobora.plans.registry import query
from corrobora.sources import documents, markup

# A payload for each event: its own properties (JSON text) at several depths and in several orders of keys.
_PAYLOAD = """CASE event_id % 5
WHEN 0 THEN '{"meta": ' || props || ', "data": {"zeta": [{"name": "' || event_type || ' ' || user_id || '", "p": ' || props || '}], "alpha": {"title": "No. 0' || user_id || '"}}}'
WHEN 1 THEN '[' || props || ', [[{"subject": "' || event_id || '", "list": [{"name": "x' || user_id || 'y"}]}]], {"title": "late ' || user_id || '"}]'
WHEN 2 THEN '{"title": ' || user_id || ', "text": "{\\"title\\": \\"' || user_id || '\\"}", "a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"vod_title": "deep ' || user_id || '", "i": {"title": "' || user_id || '"}}}}}}}}}}'
WHEN 3 THEN '{"name": "' || user_id || '1", "items": [{"title": "none"}, {"title": "1' || user_id || '", "name": "' || user_id || '회"}, {"title": "' || user_id || '"}]}'
ELSE '{"broken": [' || props || ', {"title": "' || user_id || '"}' END"""
_SEARCH = r"""WITH p AS (SELECT event_id, user_id, {payload} AS j FROM events),
t AS (SELECT event_id, user_id, x.id, x.parent, x.key, x.type AS kind, x.atom ->> '$' AS atom, x.fullkey AS path
  FROM p, LATERAL (SELECT * FROM json_tree(CASE WHEN json_valid(j) THEN j ELSE '{{}}' END)) x),
h AS (SELECT t.event_id, n.id, n.path, t.key AS name, t.atom AS value,
  list_position(['title', 'program_title', 'vod_title', 'subject', 'name'], t.key) AS place
  FROM t JOIN t n ON n.event_id = t.event_id AND n.id = t.parent
  WHERE t.kind = 'VARCHAR' AND n.kind = 'OBJECT' AND place IS NOT NULL AND len(regexp_extract_all(n.path, '[.\[]')) <= 8
  AND regexp_matches(t.atom, '(^|[^0-9])0*' || t.user_id || '([^0-9]|$)'))
SELECT event_id, path, name, value FROM h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id, place) = 1"""


@query("json_search", _SEARCH.format(payload=_PAYLOAD))
def json_search(spark, d):
    # Searching costs far more than reading: a small file of few row groups is dealt to all cores.
    dealt = table(spark, d, "events").select("event_id", "user_id", "event_type", "props").repartition(4 * spark.sparkContext.defaultParallelism)
    events = dealt.select("event_id", "user_id", F.expr(_PAYLOAD.replace("\\", "\\\\")).alias("payload"))
    found = documents.first_node(events, "payload", lambda text: documents.mentions(text, F.col("user_id")), with_node=False)
    return found.where("found IS NOT NULL").select("event_id", "found.path", "found.name", "found.value")


_ENTITIES = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"
_PLAIN = "trim(regexp_replace({}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


# A heading may be cut within an entity; in a text HTML reads these five without their semicolon too.
_TEXT_ENTITIES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&nbsp;?', '\u00a0', 'g'), '&amp;?', '&', 'g')"


@query("page_heading", f"""SELECT page_id, nullif({_PLAIN.format(_TEXT_ENTITIES.format("regexp_replace(coalesce(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '<[^>]*>', '', 'g')"))}, '') AS heading FROM pages""")
def page_heading(spark, d):
    """The first heading that a page has, by paths over its markup."""
    pages = table(spark, d, "pages").select("page_id", "html")
    paths = ["//article/h1[contains(@class,'title')]", "//h1", "//head/title", "//body//text()"]
    return markup.first_text(pages, "html", paths, "heading").select("page_id", "heading")


@query("nav_links", f"""SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, {_ENTITIES.format("unnest(a)")} AS text FROM (
SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)"', 1) AS a FROM pages)""")
def nav_links(spark, d):
    return markup.found_texts(table(spark, d, "pages"), "page_id", "html", "//nav/ul/li/a/@href")
