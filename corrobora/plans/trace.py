"""Traces and reports over order lines: suppliers as sources that offer flag, status and cut of a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.operators import trace as ops
from corrobora.operators.layout import dealt
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query

_OFFERS = """o AS (SELECT l_partkey AS entity, 's' || l_suppkey % 5 AS source, (l_suppkey % 5)::INT AS rank, l_shipdate AS t, status, f.field, f.value,
lower(f.value) AS key, f.field IS NOT NULL AND NOT f.bad AS valid, CASE WHEN f.bad THEN f.field || ' out of range, token=abc' || f.value END AS reason
FROM (SELECT *, CASE l_linenumber WHEN 7 THEN 'fetch_failed' WHEN 6 THEN 'missing_episode' WHEN 5 THEN 'parser_warning' ELSE 'ok' END AS status FROM lineitem),
LATERAL (SELECT unnest(CASE WHEN l_linenumber >= 6 THEN [{'field': NULL, 'value': NULL, 'bad': NULL}] ELSE [{'field': 'flag', 'value': l_returnflag, 'bad': false},
{'field': 'status', 'value': l_linestatus, 'bad': false}, {'field': 'cut', 'value': round(l_discount * 100)::INT::VARCHAR, 'bad': round(l_discount * 100) NOT BETWEEN 1 AND 9}] END) AS f)),
g AS (SELECT entity, field, source, status, key, valid, reason, count(*) AS n, min(rank) AS rank, min(value) AS value, min(t) AS first_seen, max(t) AS last_seen FROM o GROUP BY ALL),
w AS (SELECT *, first_value(CASE WHEN valid THEN key END) OVER b AS top, first_value(CASE WHEN valid THEN value END) OVER b AS won, row_number() OVER b AS turn
FROM g WINDOW b AS (PARTITION BY entity, field ORDER BY valid DESC, rank, source, value, key, status)),
j AS (SELECT *, CASE WHEN field IS NULL THEN NULL WHEN NOT valid THEN 'rejected' WHEN key = top THEN 'agreed' ELSE 'conflicting' END AS verdict, field IS NOT NULL AND valid AND turn = 1 AS first FROM w)"""


def _judged(spark, d):
    """Offers of the lines, which are dealt by entity before they are taken apart."""
    lines = dealt(table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity"), "l_linenumber", (F.col("l_suppkey") % 5).cast("int").alias("k"), "l_shipdate", "l_returnflag", "l_linestatus",
        F.round(F.col("l_discount") * 100).cast("int").alias("cut")), "entity")
    n, k, cut = F.col("l_linenumber"), F.col("k"), F.col("cut")
    status = F.when(n == 7, "fetch_failed").when(n == 6, "missing_episode").when(n == 5, "parser_warning").otherwise("ok")
    of = lambda field, value, bad: F.struct(F.lit(field).alias("field"), value.alias("value"), bad.alias("bad"))
    fields = F.array(of("flag", F.col("l_returnflag"), F.lit(False)), of("status", F.col("l_linestatus"), F.lit(False)), of("cut", cut.cast("string"), ~cut.between(1, 9)))
    asked = lines.select(
        "entity", F.concat(F.lit("s"), k.cast("string")).alias("source"), k.alias("rank"), F.col("l_shipdate").alias("at"),
        status.alias("status"), F.explode_outer(F.when(n < 6, fields)).alias("f"))
    reason = F.when(F.col("f.bad"), F.concat(F.col("f.field"), F.lit(" out of range, token=abc"), F.col("f.value")))
    offers = asked.select(
        "entity", "f.field", "source", "status", "f.value", F.lower("f.value").alias("key"), "rank", F.coalesce(~F.col("f.bad"), F.lit(False)).alias("valid"), reason.alias("reason"), "at")
    return ops.judged(offers)


_COUNTS = """sum(n) FILTER (verdict IS NOT NULL) AS offered, sum(n) FILTER (verdict = 'agreed') AS agreed, sum(n) FILTER (verdict = 'rejected') AS rejected,
sum(n) FILTER (verdict = 'conflicting') AS conflicting, sum(n) FILTER (status <> 'fetch_failed') AS reached, sum(n) FILTER (status = 'fetch_failed') AS unreached,
sum(n) FILTER (status = 'ok') AS parsed, sum(n) FILTER (status = 'parser_warning') AS warned, sum(n) FILTER (status = 'missing_episode') AS unlisted"""
_EACH = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in "offered agreed rejected conflicting reached unreached parsed warned unlisted".split())


@query("source_trace", f"""WITH {_OFFERS} SELECT part, source, field, {_EACH} FROM (
SELECT 'source' AS part, source, NULL AS field, {_COUNTS} FROM j GROUP BY source UNION ALL SELECT 'field', NULL, field, {_COUNTS} FROM j WHERE field IS NOT NULL GROUP BY field
UNION ALL SELECT 'cell', source, field, {_COUNTS} FROM j WHERE field IS NOT NULL GROUP BY source, field UNION ALL SELECT 'all', NULL, NULL, {_COUNTS} FROM j)""")
def source_trace(spark, d):
    return ops.trace(_judged(spark, d))


@query("source_fields", f"""WITH {_OFFERS} SELECT source, {', '.join(f"coalesce(sum(n) FILTER (field = '{f}'), 0)::BIGINT AS {f}" for f in ('flag', 'status', 'cut'))} FROM j WHERE valid GROUP BY source""")
def source_fields(spark, d):
    return ops.field_matrix(_judged(spark, d), ["flag", "status", "cut"])


_TIME = "strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen"
_SPAN = "min(first_seen) AS first_seen, max(last_seen) AS last_seen"


@query("run_report", f"""WITH {_OFFERS}, c AS (SELECT *, CASE WHEN old IS NULL THEN 'added' WHEN old = won THEN 'unchanged' ELSE 'changed' END AS change FROM j
LEFT JOIN (SELECT p_partkey AS entity, f AS field, CASE WHEN p_size % 4 <> 0 THEN CASE f WHEN 'flag' THEN 'N' WHEN 'status' THEN 'O' ELSE '5' END END AS old FROM part, (VALUES ('flag'), ('status'), ('cut')) t(f)) USING (entity, field))
SELECT section, name, item, n::BIGINT AS n, {_TIME} FROM (SELECT 'operation' AS section, 'run' AS name, 'offers' AS item, sum(n) AS n, {_SPAN} FROM c
UNION ALL SELECT 'source_results', source, status, sum(n), {_SPAN} FROM c GROUP BY source, status
UNION ALL SELECT 'field_analysis', field, verdict, sum(n), {_SPAN} FROM c WHERE field IS NOT NULL GROUP BY field, verdict
UNION ALL SELECT 'database_state', field, change, count(*), {_SPAN} FROM c WHERE first GROUP BY field, change
UNION ALL SELECT 'errors', source, field || ' out of range, token=***', sum(n), {_SPAN} FROM c WHERE reason IS NOT NULL GROUP BY source, field)""")
def run_report(spark, d):
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("v")) for f, v in (("flag", "N"), ("status", "O"), ("cut", "5"))])
    existing = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), "p_size", F.explode(fields).alias("f")).select(
        "entity", "f.field", F.when(F.col("p_size") % 4 != 0, F.col("f.v")).alias("old"))
    report = ops.run_report(_judged(spark, d), existing)
    return report.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")})


_BUNDLE = """WITH s AS (SELECT o_custkey AS e, string_agg(x, ';' ORDER BY x) AS sources FROM (SELECT o_custkey, o_orderstatus || ' ' || count(*) AS x FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY 1),
f AS (SELECT o_custkey AS e, string_agg(x, ';' ORDER BY x) AS fields FROM (SELECT o_custkey, o_orderpriority || ' ' || min(o_orderstatus) AS x FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY 1),
c AS (SELECT o_custkey AS e, string_agg(o_orderkey, ';' ORDER BY o_orderkey DESC) AS changes FROM (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 10) GROUP BY 1)
SELECT c_custkey AS entity, coalesce(sources, '') AS sources, coalesce(fields, '') AS fields, coalesce(changes, '') AS changes, c_name || ';' || c_mktsegment AS titles
FROM customer LEFT JOIN s ON s.e = c_custkey LEFT JOIN f ON f.e = c_custkey LEFT JOIN c ON c.e = c_custkey"""


@query("provenance_bundle", _BUNDLE)
def provenance_bundle(spark, d):
    orders, customer = tables(spark, d, "orders customer")
    o = orders.withColumnRenamed("o_custkey", "entity")
    sources = o.groupBy("entity", F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("n"))
    fields = o.groupBy("entity", F.col("o_orderpriority").alias("field")).agg(F.min("o_orderstatus").alias("source"))
    titles = customer.select(F.col("c_custkey").alias("entity"), F.explode(F.array(
        F.struct(F.lit(1).alias("lang"), F.col("c_name").alias("title")), F.struct(F.lit(2).alias("lang"), F.col("c_mktsegment").alias("title")))).alias("t")).select("entity", "t.*")
    found = ops.provenance(sources, fields, o.select("entity", "o_orderkey"), titles, "entity", last=10)
    pair = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x[a], x[b].cast("string"))), ";").alias(c)
    return found.select(
        "entity", pair("sources", "source", "n"), pair("fields", "field", "source"),
        F.array_join(F.transform("changes", lambda x: x["o_orderkey"].cast("string")), ";").alias("changes"), F.array_join(F.transform("titles", lambda x: x["title"]), ";").alias("titles"))


@query("field_sources", """SELECT entity, string_agg(field || '=' || source, ';' ORDER BY field) AS by_field FROM (SELECT l_partkey AS entity, l_returnflag || l_linestatus AS field, min('s' || l_suppkey % 7) AS source FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def field_sources(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("field"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("source"))
    said = F.transform(F.map_entries("by_field"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ops.field_sources(rows).select("entity", F.array_join(said, ";").alias("by_field"))


@query("stored_evidence", """SELECT l_partkey AS entity, l_returnflag AS field, l_orderkey, l_linenumber, l_suppkey, (85 - 6 * (l_suppkey % 5))::INT AS reliability,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, 85 - 6 * (l_suppkey % 5) DESC, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity) AS place FROM lineitem""")
def stored_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("field"), "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity",
        (85 - 6 * (F.col("l_suppkey") % 5)).cast("int").alias("reliability"))
    return ops.stored_evidence(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity"]).drop("l_shipdate", "l_quantity")


_PROVENANCE = """WITH w AS (SELECT p_partkey AS entity, CASE WHEN p_size % 9 = 0 THEN 'rejected' ELSE 'passed' END AS grounding, CASE WHEN p_size % 7 = 0 THEN 'KEEP' ELSE 'GENERATE' END AS decision, p_partkey % 3 = 0 AS applied, p_size FROM part),
d AS (SELECT o_orderkey AS entity, CASE o_orderstatus WHEN 'F' THEN 'FILL' WHEN 'O' THEN 'UPDATE' ELSE 'REVIEW' END AS decision FROM orders WHERE o_orderkey % 50 < 2)
SELECT * FROM (
SELECT 'applied_despite_grounding' AS issue, 'CRITICAL' AS severity, count(*) AS n, min(entity) AS first FROM w WHERE applied AND grounding = 'rejected'
UNION ALL SELECT 'applied_without_generate', 'CRITICAL', count(*), min(entity) FROM w WHERE applied AND decision <> 'GENERATE' UNION ALL SELECT 'decision_applied_unsafe', 'CRITICAL', count(*), min(entity) FROM d WHERE decision = 'REVIEW'
UNION ALL SELECT 'applied_but_empty', 'ERROR', count(*), min(entity) FROM w WHERE applied AND p_size % 5 = 0
UNION ALL SELECT 'no_field_provenance', 'INFO', count(*), min(p_partkey) FROM part WHERE p_size <> 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)) WHERE n > 0"""


@query("provenance_issues", _PROVENANCE)
def provenance_issues(spark, d):
    part, orders, lineitem = tables(spark, d, "part orders lineitem")
    entity, size, synopsis = F.col("p_partkey").alias("entity"), F.col("p_size"), F.lit("synopsis").alias("field")
    drafts = part.select(entity, synopsis, F.when(size % 7 == 0, "KEEP").otherwise("GENERATE").alias("decision"), F.when(size % 9 == 0, "rejected").otherwise("passed").alias("grounding"), (F.col("p_partkey") % 3 == 0).alias("applied"))
    verdict = F.when(F.col("o_orderstatus") == "F", "FILL").when(F.col("o_orderstatus") == "O", "UPDATE").otherwise("REVIEW")
    decisions = orders.select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("field"), verdict.alias("decision"), (F.col("o_orderkey") % 50 < 2).alias("applied"))
    items = part.select(entity, synopsis, F.when(size % 5 == 0, " ").otherwise(F.col("p_name")).alias("value"))
    states = part.select(entity, F.when(size == 1, "never_researched").otherwise("done").alias("status"))
    sources = lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("field"))
    found = ops.provenance_issues(drafts, decisions, items, states, sources)
    return found.groupBy("issue", "severity").agg(F.count("*").alias("n"), F.min("entity").alias("first"))
