"""Evidence-resolution queries; evidence comes from order lines, with suppliers as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import text
from corrobora.operators import evidence as ops
from corrobora.operators import identity
from corrobora.operators.layout import dealt
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query

_EVIDENCE = """ev AS (SELECT l_partkey AS entity, f AS field, CASE f WHEN 'flag' THEN l_returnflag WHEN 'status' THEN l_linestatus ELSE (l_discount * 100)::INT::VARCHAR END AS value,
's' || l_suppkey % 5 AS source, (1 + l_suppkey % 5 % 3)::INT AS tier, (l_suppkey % 5)::INT AS rank, CASE WHEN l_suppkey % 5 IN (1, 2) THEN 'f' END AS family, l_suppkey % 5 = 4 AS verify_only,
(85 - 6 * (l_suppkey % 5))::INT AS reliability FROM lineitem, (VALUES ('flag'), ('status'), ('cut')) t(f)),
cand AS (SELECT entity, field, value, count(*)::INT AS independent, max(r) AS reliability, list_sort(list_distinct(flatten(list(s)))) AS sources, bool_and(v) AS verify_only,
least(99, round(list_reduce(list_prepend({'s': list_reverse_sort(list(r))[1]::DOUBLE, 'w': 0.35::DOUBLE, 'r': 0::INT}, list_transform(list_reverse_sort(list(r))[2:], lambda x: {'s': 0::DOUBLE, 'w': 0::DOUBLE, 'r': x})),
lambda a, x: {'s': a.s + (100.0::DOUBLE - a.s) * a.w * x.r / 100.0::DOUBLE, 'w': a.w / 2, 'r': 0::INT}).s)::INT) AS confidence
FROM (SELECT entity, field, value, coalesce(family, source) AS witness, max(reliability) AS r, list(DISTINCT source) AS s, bool_and(verify_only) AS v FROM ev GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


def _evidence(spark, d):
    """Three claims a line; the lines are dealt by entity, so all that is gathered of a field is in its task."""
    lines = dealt(table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity"), (F.col("l_suppkey") % 5).cast("int").alias("k"), "l_returnflag", "l_linestatus",
        F.round(F.col("l_discount") * 100).cast("int").alias("cut")), "entity")
    k = F.col("k")
    fields = F.array(
        F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit("status").alias("field"), F.col("l_linestatus").alias("value")),
        F.struct(F.lit("cut").alias("field"), F.col("cut").cast("string").alias("value")),
    )
    return lines.select(
        "entity", F.concat(F.lit("s"), k.cast("string")).alias("source"), (k % 3 + 1).alias("tier"),
        k.alias("rank"), F.when(k.isin(1, 2), "f").alias("family"), (k == 4).alias("verify_only"),
        (85 - 6 * k).alias("reliability"), F.explode(fields).alias("f"),
    ).select("entity", "f.field", "f.value", "source", "tier", "rank", "family", "verify_only", "reliability")


def _candidates(spark, d):
    ev = ops.independence(_evidence(spark, d), F.lit(False), F.length("value"), F.sha1(F.col("value").cast("binary")))
    return ops.candidates(ev)


@query("evidence_candidates", f"WITH {_EVIDENCE} SELECT entity, field, value, independent, reliability, confidence, array_to_string(sources, ',') AS sources, verify_only FROM cand")
def evidence_candidates(spark, d):
    return _candidates(spark, d).withColumn("sources", F.array_join("sources", ","))


@query("copied_witnesses", """WITH e AS (SELECT doc_id % 97 AS entity, CASE WHEN length(text) >= 40 THEN 'copy:' || left(sha1(text), 10) ELSE source END AS witness FROM documents)
SELECT entity, count(*) AS reports, count(DISTINCT witness) AS witnesses FROM e GROUP BY 1""")
def copied_witnesses(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 97).alias("entity"), "source", "text", F.lit(None).cast("string").alias("family"))
    seen = ops.independence(docs, F.lit(True), F.length("text"), F.sha1(F.col("text").cast("binary")))
    return seen.groupBy("entity").agg(F.count("*").alias("reports"), F.countDistinct("witness").alias("witnesses"))


#: Fixed value: how much a wrong field harms.
_LEVELS = {"flag": "critical", "status": "important"}
_OLD_SQL = """old AS (SELECT p_partkey AS entity, f AS field, CASE WHEN p_size % 4 = 0 THEN NULL WHEN f = 'flag' THEN 'N' WHEN f = 'status' THEN ' o' ELSE '5' END AS old, (p_size % 60)::INT AS oc
FROM part, (VALUES ('flag'), ('status'), ('cut')) t(f))"""
_DECIDE = f"""{_EVIDENCE}, {_OLD_SQL},
bars AS (SELECT * FROM (VALUES ('flag', 'critical', 90, 85, 70), ('status', 'important', 82, 75, 60), ('cut', 'secondary', 75, 65, 50)) t(field, level, up, fill, rev)),
pl AS (SELECT *, row_number() OVER w AS place, first(independent) OVER w AS lead FROM cand WINDOW w AS (PARTITION BY entity, field ORDER BY verify_only, independent DESC, confidence DESC, value)),
loss AS (SELECT entity, field, sum(round(confidence * least(1.0::DOUBLE, independent::DOUBLE / greatest(lead, 1)) * 0.35::DOUBLE)) AS loss, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS dissenting FROM pl WHERE place > 1 GROUP BY 1, 2),
j AS (SELECT coalesce(o.entity, a.entity) AS entity, coalesce(o.field, a.field) AS field, old, coalesce(oc, 0) AS held, a.value AS top, a.verify_only AS vo, a.independent AS ind, a.sources AS src, coalesce(dissenting, '') AS dissenting,
greatest(0, least(99, a.confidence - CASE WHEN a.independent <= 1 THEN 6 ELSE 0 END - coalesce(loss, 0)))::INT AS conf, coalesce(old, '') = '' AS empty, coalesce(lower(trim(old)) = lower(trim(a.value)), false) AS same,
coalesce(b.independent >= 2 AND a.independent <= b.independent + 1 AND abs(a.confidence - b.confidence) <= 12, false) AS contested
FROM old o FULL JOIN (SELECT * FROM pl WHERE place = 1) a ON a.entity = o.entity AND a.field = o.field LEFT JOIN (SELECT * FROM pl WHERE place = 2) b ON b.entity = a.entity AND b.field = a.field
LEFT JOIN loss l ON l.entity = a.entity AND l.field = a.field),
dec AS (SELECT j.*, level, up, CASE WHEN top IS NULL THEN 'UNKNOWN' WHEN empty AND vo THEN 'REVIEW' WHEN empty AND conf >= fill THEN 'FILL' WHEN empty AND conf >= rev THEN 'REVIEW' WHEN empty THEN 'REJECT' WHEN same THEN 'KEEP'
WHEN contested OR vo THEN 'REVIEW' WHEN conf >= up AND conf >= held + 8 THEN 'UPDATE' WHEN conf >= rev THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM j JOIN bars USING (field)),
out AS (SELECT *, CASE WHEN decision = 'KEEP' THEN old ELSE top END AS value, CASE WHEN decision = 'KEEP' AND same THEN greatest(conf, held) WHEN decision = 'KEEP' THEN held ELSE conf END AS confidence FROM dec)"""


def _existing(spark, d):
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("v")) for f, v in (("flag", "N"), ("status", " o"), ("cut", "5"))])
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity"), "p_size", F.explode(fields).alias("f")).select(
        "entity", "f.field", F.when(F.col("p_size") % 4 != 0, F.col("f.v")).alias("old"), (F.col("p_size") % 60).cast("int").alias("old_confidence"))


def _decided(spark, d):
    level = F.coalesce(*[F.when(F.col("field") == f, x) for f, x in _LEVELS.items()], F.lit("secondary"))
    return ops.decide(_candidates(spark, d), _existing(spark, d), level)


@query("decide", f"WITH {_DECIDE} SELECT entity, field, decision, value, confidence FROM out")
def decide(spark, d):
    return _decided(spark, d).select("entity", "field", "decision", "value", "confidence")


@query("decision_counts", f"WITH {_DECIDE} SELECT field, decision, count(*) AS n FROM out GROUP BY 1, 2")
def decision_counts(spark, d):
    return _decided(spark, d).groupBy("field", "decision").agg(F.count("*").alias("n"))


@query("decision_explain", f"""WITH {_DECIDE} SELECT entity, field, coalesce(array_to_string(list_transform(src, lambda x: x || ' supports this value'), ';') || ';', '')
|| CASE WHEN dissenting = '' THEN '' ELSE replace(dissenting, ',', ' says otherwise;') || ' says otherwise;' END || CASE WHEN ind <= 1 THEN 'one independent source;' WHEN ind > 1 THEN ind || ' independent sources;' ELSE '' END
|| CASE WHEN empty THEN '' WHEN held > 0 THEN 'stored at ' || held || ';' ELSE 'stored without confidence;' END || level || ' field, needs ' || up AS why FROM out""")
def decision_explain(spark, d):
    return ops.explained(_decided(spark, d)).select("entity", "field", F.array_join("why", ";").alias("why"))


@query("review_queue", f"""WITH {_DECIDE} SELECT entity, field, value, old, confidence, CASE level WHEN 'critical' THEN 1 WHEN 'important' THEN 2 ELSE 3 END AS urgency FROM out WHERE decision = 'REVIEW'
AND NOT EXISTS (SELECT 1 FROM partsupp_answers r WHERE r.entity = out.entity AND r.field = out.field)""".replace("partsupp_answers", "(SELECT l_partkey AS entity, 'flag' AS field FROM lineitem WHERE l_quantity > 45)"))
def review_queue(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entity"), F.lit("flag").alias("field"))
    return ops.review_queue(_decided(spark, d), done)


@query("review_resolved", f"""WITH {_DECIDE}, ans AS (SELECT p_partkey AS entity, 'status' AS field, CASE WHEN p_size % 3 = 0 THEN 'changed since' WHEN p_size % 4 <> 0 THEN ' o' END AS seen FROM part WHERE p_size % 5 <> 0)
SELECT o.entity, o.field, CASE WHEN t THEN r.value ELSE o.old END AS old, CASE WHEN t THEN r.confidence ELSE o.oc END AS old_confidence FROM (SELECT o.*, coalesce(a.entity IS NOT NULL AND q.entity IS NOT NULL AND o.old IS NOT DISTINCT FROM a.seen AND q.value IS NOT NULL, false) AS t
FROM old o LEFT JOIN ans a USING (entity, field) LEFT JOIN (SELECT * FROM out WHERE decision = 'REVIEW') q USING (entity, field)) o LEFT JOIN out r USING (entity, field)""")
def review_resolved(spark, d):
    seen = F.when(F.col("p_size") % 3 == 0, "changed since").when(F.col("p_size") % 4 != 0, " o")
    answers = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.lit("status").alias("field"), (F.col("p_size") % 5 != 0).alias("accepted"), seen.alias("seen"))
    return ops.resolve_reviews(_existing(spark, d), _decided(spark, d).where("decision = 'REVIEW'"), answers)


@query("apply_decisions", f"""WITH {_DECIDE}, veto AS (SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_quantity >= 50)
SELECT entity, field, CASE WHEN ok THEN value ELSE x.old END AS old, CASE WHEN ok THEN confidence ELSE oc END AS old_confidence FROM (SELECT out.*, old.entity AS known, oc, decision IN ('UPDATE', 'FILL') AND NOT (field = 'cut' AND entity IN (SELECT entity FROM veto)) AS ok
FROM out LEFT JOIN old USING (entity, field)) x WHERE known IS NOT NULL OR ok""")
def apply_decisions(spark, d):
    veto = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("entity"), F.lit("cut").alias("field"))
    return ops.apply_decisions(_existing(spark, d), _decided(spark, d), veto)


@query("resolve_scalar", f"""WITH {_EVIDENCE}, k AS (SELECT *, CASE WHEN field = 'cut' THEN (value::INT // 4)::VARCHAR ELSE lower(value) END AS k FROM ev), top AS (SELECT entity, field, k AS wk, value AS won, source AS src FROM k QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY rank, source, value) = 1),
s AS (SELECT entity, field, won AS value, src AS source, count(*) FILTER (k = wk) AS agree, count(DISTINCT k) - 1 AS conflicts, coalesce(sum(tier) FILTER (k = wk), 0) AS weight, max(tier) FILTER (k = wk) AS best, coalesce(max(tier) FILTER (k <> wk), 0) AS other FROM k JOIN top USING (entity, field) GROUP BY entity, field, won, src)
SELECT entity, field, value, source, agree, conflicts, CASE WHEN other >= 2 AND best >= 2 THEN 'CONFLICT' WHEN agree >= 2 AND weight >= 4 THEN 'HIGH' WHEN agree >= 2 OR best >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""")
def resolve_scalar(spark, d):
    return ops.resolve_scalar(_evidence(spark, d), F.when(F.col("field") == "cut", F.floor(F.try_divide(F.col("value").try_cast("int"), F.lit(4))).cast("string")).otherwise(F.lower("value")))


@query("resolve_union", """WITH i AS (SELECT o_custkey AS entity, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) AS k, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS item, o_orderstatus AS source FROM orders),
g AS (SELECT entity, k, arg_max(item, (CASE WHEN item = lower(item) THEN 0 ELSE 1 END, item)) AS item, count(DISTINCT source) AS sources FROM i GROUP BY 1, 2)
SELECT entity, string_agg(item || ':' || sources, ';' ORDER BY item) AS items FROM g GROUP BY 1""")
def resolve_union(spark, d):
    item = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), item.alias("item"), F.col("o_orderstatus").alias("source"))
    score = F.when(F.col("item") == F.lower("item"), 0).otherwise(1)
    union = ops.resolve_union(rows, text.identity_key(F.col("item")), score)
    said = F.transform("items", lambda x: F.concat(x["item"], F.lit(":"), x["sources"].cast("string")))
    return union.select("entity", F.array_join(said, ";").alias("items"))


_DIFF_SQL = """(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS o, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN text WHEN 2 THEN left(text, (length(text) // 3)::INT) WHEN 3 THEN upper(text) WHEN 4 THEN 'x' ELSE text || ' And more.' END AS n FROM documents)"""
_DIFF_RULE = """CASE WHEN coalesce(n, '') = '' AND coalesce(o, '') = '' THEN 'UNCHANGED' WHEN coalesce(n, '') = '' THEN 'REJECTED' WHEN coalesce(o, '') = '' THEN 'ADDED' WHEN o = n THEN 'UNCHANGED'
WHEN (length(n) * 2 < length(o) AND length(o) > 40) OR (starts_with(o, n) AND length(n) < length(o)) THEN 'REJECTED' ELSE 'CHANGED' END"""


def _diff(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 6
    third = F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    new = F.when(k == 0, F.lit(None)).when(k == 1, F.col("text")).when(k == 2, third).when(k == 3, F.upper("text")).when(k == 4, "x").otherwise(F.concat("text", F.lit(" And more.")))
    old = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return ops.diff(docs.select("doc_id", old.alias("value")), docs.select("doc_id", new.alias("value")), ["doc_id"])


@query("diff_changes", f"SELECT doc_id, {_DIFF_RULE} AS change FROM {_DIFF_SQL}")
def diff_changes(spark, d):
    return _diff(spark, d).select("doc_id", "change")


@query("change_summary", f"SELECT {_DIFF_RULE} AS change, count(*) AS n FROM {_DIFF_SQL} GROUP BY 1")
def change_summary(spark, d):
    return _diff(spark, d).groupBy("change").agg(F.count("*").alias("n"))


# Stored and new values of six fields of a part, from its columns; new ones in other formats, shortened, or gone.
_FIELDS = """f AS (SELECT p_partkey AS entity, t.f AS field, 's' || p_partkey % 4 AS old_source, 's' || (p_partkey // 4) % 4 AS source,
CASE p_size % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'CONFLICT' END AS confidence,
CASE f WHEN 'title' THEN 'Episode #' || p_size || ' - ' || p_name WHEN 'synopsis' THEN p_name || ', ' || p_brand || ' of the ' || p_type || ' kind' WHEN 'air_date' THEN '2024-03-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0')
WHEN 'location' THEN p_brand || ', ' || p_type WHEN 'image_url' THEN 'https://a.example/' || p_name || '.jpg?v=1' ELSE p_name || ' - ' || p_type || ' - ' || p_brand || ' - ' || p_partkey || ' notes' END AS v
FROM part, (VALUES ('title'), ('synopsis'), ('air_date'), ('location'), ('image_url'), ('notes')) t(f)),
p AS (SELECT *, CASE WHEN entity % 11 = 0 THEN NULL ELSE v END AS old, CASE entity % 7 WHEN 0 THEN upper(v) WHEN 1 THEN replace(v, ' ', '  ') WHEN 2 THEN CASE field WHEN 'air_date' THEN replace(v, '-', '.') ELSE left(v, 12) END
WHEN 3 THEN ' ' WHEN 4 THEN CASE field WHEN 'air_date' THEN '9 May 2023' ELSE v || ' and others' END WHEN 5 THEN replace(v, '?v=1', '?v=2') ELSE left(v, (length(v) * 3 // 4)::INT) END AS new FROM f),
d AS (SELECT *, trim(regexp_extract(trim(old), '^Episode\\s*#\\d+\\s*-\\s*(.+)$', 1)) AS od, trim(regexp_extract(trim(new), '^Episode\\s*#\\d+\\s*-\\s*(.+)$', 1)) AS nd,
CASE old_source WHEN 's0' THEN 3 WHEN 's1' THEN 2 ELSE 1 END AS orank, CASE source WHEN 's0' THEN 3 WHEN 's1' THEN 2 ELSE 1 END AS nrank FROM p),
k AS (SELECT *, lower(regexp_replace(CASE WHEN od <> '' THEN od ELSE old END, '[^A-Za-z0-9]', '', 'g')) AS okey, lower(regexp_replace(CASE WHEN nd <> '' THEN nd ELSE new END, '[^A-Za-z0-9]', '', 'g')) AS nkey,
coalesce(trim(old), '') <> '' AS ho, coalesce(trim(new), '') <> '' AS hn FROM d),
s AS (SELECT *, CASE field WHEN 'air_date' THEN old = replace(CASE WHEN new LIKE '%May%' THEN '2023-05-09' ELSE new END, '.', '-') WHEN 'title' THEN okey = nkey
WHEN 'location' THEN lower(regexp_replace(old, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(new, '[^A-Za-z0-9]', '', 'g')) WHEN 'image_url' THEN lower(regexp_replace(old, '\\?.*$', '')) = lower(regexp_replace(new, '\\?.*$', ''))
ELSE trim(regexp_replace(old, '\\s+', ' ', 'g')) = trim(regexp_replace(new, '\\s+', ' ', 'g')) END AS same FROM k),
r AS (SELECT *, CASE WHEN NOT (ho AND hn) OR same THEN NULL WHEN nrank < orank AND source <> old_source THEN 'weaker source' WHEN field = 'title' AND od <> '' AND nd = '' THEN 'descriptor lost'
WHEN field = 'title' AND od <> '' AND length(nd) < length(od) * 0.5 THEN 'descriptor shrunk' WHEN field = 'synopsis' AND length(new) < length(old) * 0.5 THEN 'shrunk'
WHEN field = 'synopsis' AND starts_with(lower(regexp_replace(old, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(new, '[^A-Za-z0-9]', '', 'g'))) THEN 'cut short'
WHEN field IN ('air_date', 'location') AND confidence = 'LOW' THEN 'one low-trust source' WHEN field = 'air_date' AND confidence = 'CONFLICT' THEN 'sources disagree'
WHEN field = 'notes' AND length(old) > 40 AND length(new) < length(old) * 0.4 THEN 'shrunk' END AS reason FROM s)
SELECT entity, field, CASE WHEN NOT hn THEN 'KEPT' WHEN NOT ho THEN 'ADDED' WHEN same THEN 'UNCHANGED' WHEN reason IS NOT NULL THEN 'REJECTED' WHEN confidence = 'CONFLICT' THEN 'CONFLICT' ELSE 'CHANGED' END AS change, reason FROM r WHERE ho OR hn"""


@query("field_changes", "WITH " + _FIELDS)
def field_changes(spark, d):
    part = table(spark, d, "part")
    c, key = F.concat, F.col("p_partkey")
    lit = F.lit
    values = {
        "title": c(lit("Episode #"), F.col("p_size").cast("string"), lit(" - "), "p_name"),
        "synopsis": c("p_name", lit(", "), "p_brand", lit(" of the "), "p_type", lit(" kind")),
        "air_date": c(lit("2024-03-"), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0")),
        "location": c("p_brand", lit(", "), "p_type"),
        "image_url": c(lit("https://a.example/"), "p_name", lit(".jpg?v=1")),
        "notes": c("p_name", lit(" - "), "p_type", lit(" - "), "p_brand", lit(" - "), key.cast("string"), lit(" notes")),
    }
    rows = part.select(key.alias("entity"), "p_size", F.explode(F.array(*[F.struct(lit(f).alias("field"), v.alias("v")) for f, v in values.items()])).alias("f"))
    rows = rows.select("entity", "p_size", "f.*")
    source = lambda n: c(lit("s"), (n % 4).cast("string"))
    existing = rows.where("entity % 11 <> 0").select("entity", "field", F.col("v").alias("old"), source(F.col("entity")).alias("old_source"))
    k, v, dated = F.col("entity") % 7, F.col("v"), F.col("field") == "air_date"
    new = (
        F.when(k == 0, F.upper(v)).when(k == 1, F.replace(v, lit(" "), lit("  ")))
        .when(k == 2, F.when(dated, F.replace(v, lit("-"), lit("."))).otherwise(F.left(v, lit(12))))
        .when(k == 3, " ").when(k == 4, F.when(dated, "9 May 2023").otherwise(c(v, lit(" and others"))))
        .when(k == 5, F.replace(v, lit("?v=1"), lit("?v=2"))).otherwise(F.left(v, F.floor(F.length(v) * 3 / 4).cast("int")))
    )
    size = F.col("p_size") % 3
    confidence = F.when(size == 0, "LOW").when(size == 1, "HIGH").otherwise("CONFLICT")
    resolved = rows.select("entity", "field", new.alias("new"), source(F.floor(F.col("entity") / 4)).alias("source"), confidence.alias("confidence"))
    authority = F.when(F.col("source") == "s0", 3).when(F.col("source") == "s1", 2).otherwise(1)
    return ops.diff_fields(existing, resolved, authority).select("entity", "field", "change", "reason")


@query("upsert", """SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(a, c_acctbal) AS c_acctbal, c_mktsegment FROM customer FULL JOIN (
SELECT CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS k, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max(o_totalprice) END AS a FROM orders GROUP BY o_custkey) ON k = c_custkey""")
def upsert(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    key = F.when(F.col("o_custkey") % 10 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    new = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).select(key.alias("c_custkey"), F.when(F.col("o_custkey") % 3 != 0, F.col("m")).alias("c_acctbal"))
    return ops.upsert(customer.select("c_custkey", "c_acctbal", "c_mktsegment"), new, ["c_custkey"])


@query("insert_new", "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey * 2 FROM orders")
def insert_new(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    return ops.insert_new(customer.select(F.col("c_custkey").alias("k")), orders.select((F.col("o_custkey") * 2).alias("k")), ["k"])


@query("replace_set", """SELECT l_orderkey AS k, l_partkey AS item FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'P'""")
def replace_set(spark, d):
    lineitem, orders = tables(spark, d, "lineitem orders")
    old = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("item"))
    new = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast("long").alias("item"))
    return ops.replace_set(old, new, ["k"])


@query("anomalies", """SELECT l_orderkey, l_linenumber, l_partkey, kind FROM (SELECT *, unnest(list_filter([CASE WHEN l_shipdate < o_orderdate THEN 'order' END, CASE WHEN l_shipdate > o_orderdate + INTERVAL 400 DAY THEN 'drift' END,
CASE WHEN l_quantity NOT BETWEEN 2 AND 49 THEN 'range' END], lambda x: x IS NOT NULL)) AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def anomalies(spark, d):
    lineitem, orders = tables(spark, d, "lineitem orders")
    found = F.array_compact(F.array(
        F.when(F.col("l_shipdate") < F.col("o_orderdate"), "order"),
        F.when(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS"), "drift"),
        F.when(~F.col("l_quantity").between(2, 49), "range")))
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(found).alias("kind"))


@query("field_locks", "SELECT user_id, event_type, count(*) AS n FROM events WHERE NOT (user_id % 9 = 0 OR (user_id % 4 = 1 AND event_type = 'view')) GROUP BY 1, 2")
def field_locks(spark, d):
    events = table(spark, d, "events")
    users = events.select("user_id").distinct()
    locks = users.where("user_id % 9 = 0").withColumn("f", F.lit("*")).unionByName(users.where("user_id % 4 = 1").withColumn("f", F.lit("view")))
    locks = locks.withColumnRenamed("user_id", "u")
    locked = (events["user_id"] == locks["u"]) & ((locks["f"] == "*") | (locks["f"] == events["event_type"]))
    return events.join(locks, locked, "left_anti").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("near_names", """WITH n AS (SELECT DISTINCT p_name AS s FROM part WHERE length(p_name) >= 6)
SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s)::INT AS distance FROM n a JOIN n b ON a.s < b.s AND abs(length(a.s) - length(b.s)) <= 2
AND levenshtein(a.s, b.s) <= CASE WHEN least(length(a.s), length(b.s)) >= 8 THEN 2 ELSE 1 END""")
def near_names(spark, d):
    return identity.near_names(table(spark, d, "part"), "p_partkey", "p_name", 2, shortest=6, lenient=8)


_HASH_SQL = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1 ELSE 0 END)), lambda h, x: h * 2 + x)"


@query("near_embeddings", f"""WITH e AS (SELECT embedding FROM embeddings UNION ALL SELECT list_transform(embedding, lambda x, i: CASE WHEN i % 16 = vec_id % 16 THEN -x ELSE x END) FROM embeddings),
h AS (SELECT DISTINCT {_HASH_SQL} AS h FROM e) SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 8""")
def near_embeddings(spark, d):
    """The vectors, and each once more with every sixteenth component turned round."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda x, i: F.when((i + 1) % 16 == F.col("vec_id") % 16, -x).otherwise(x))
    every = rows.select("embedding").unionByName(rows.select(turned.alias("embedding")))
    return identity.near_hashes(every.select(identity.gradient_hash(F.col("embedding")).alias("h")), "h")


@query("hash_distances", f"""WITH h AS (SELECT vec_id, lpad(hex({_HASH_SQL}), 16, '0') AS x FROM embeddings) SELECT a.vec_id, bit_count(xor(('0x' || a.x)::BIGINT, ('0x' || b.x)::BIGINT))::INT AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def hash_distances(spark, d):
    h = table(spark, d, "embeddings").select("vec_id", F.lpad(F.hex(identity.gradient_hash(F.col("embedding"))), 16, "0").alias("x"))
    following = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return h.join(following, "vec_id").select("vec_id", identity.hex_hamming(F.col("x"), F.col("y")).alias("distance"))


@query("dup_suspects", """WITH r AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, 'date' AS why FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey
UNION SELECT a.o_orderkey, b.o_orderkey, 'price' FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND floor(a.o_totalprice / 2000) = floor(b.o_totalprice / 2000) AND a.o_orderkey < b.o_orderkey
UNION SELECT a.o_orderkey, b.o_orderkey, 'kind' FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey < b.o_orderkey)
SELECT a, b, string_agg(why, ',' ORDER BY why) AS reasons FROM r GROUP BY 1, 2 HAVING count(*) >= 2 OR bool_or(why = 'date')""")
def dup_suspects(spark, d):
    orders = table(spark, d, "orders").withColumn("step", F.floor(F.col("o_totalprice") / 2000))

    def pairs(*on):
        other = orders.select(F.col("o_orderkey").alias("b"), *on)
        return orders.select(F.col("o_orderkey").alias("a"), *on).join(other, list(on)).where("a < b")

    found = identity.suspected_duplicates(
        {"date": pairs("o_custkey", "o_orderdate"), "price": pairs("o_custkey", "step"), "kind": pairs("o_custkey", "o_orderpriority", "o_orderstatus")}, "date")
    return found.withColumn("reasons", F.array_join("reasons", ","))
