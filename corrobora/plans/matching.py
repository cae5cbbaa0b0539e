"""Names across scripts, repaired texts, prefixes, greedy groups and the newest number by consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import scripts, text
from corrobora.operators import identity, quality
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query

_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_SYLLABLE = f"({_LIST(scripts.INITIALS)}[s // 588 + 1] || {_LIST(scripts.VOWELS)}[s % 588 // 28 + 1] || {_LIST(scripts.FINALS)}[s % 28 + 1])"


@query("romanised_keys", f"""WITH s AS (SELECT c_custkey, c_custkey * 7919 % 11172 AS s, c_mktsegment AS m, c_custkey % 3 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN lower(replace(m, ' ', '')) || {_SYLLABLE} || {_SYLLABLE.replace('s //', '(s + 611) % 11172 //').replace('s %', '(s + 611) % 11172 %')}
WHEN 1 THEN 'zukova' || c_custkey ELSE 'thanos' || c_custkey || 'psyche' END AS key FROM s""")
def romanised_keys(spark, d):
    """Names of Hangul syllables, Cyrillic and Greek letters, put together from a customer's columns."""
    code = F.col("c_custkey") * 7919 % 11172
    letter = lambda c: F.decode(F.unhex(F.hex(c % 11172 + 0xAC00)), "UTF-16BE")
    k = F.col("c_custkey") % 3
    number = F.col("c_custkey").cast("string")
    name = (
        F.when(k == 0, F.concat(F.col("c_mktsegment"), F.lit("-"), letter(code), F.lit(" "), letter(code + 611)))
        .when(k == 1, F.concat(F.lit("Жукова "), number))
        .otherwise(F.concat(F.lit("Θάνος "), number, F.lit(" Ψυχή")))
    )
    return table(spark, d, "customer").select("c_custkey", text.identity_key(name).alias("key"))


@query("charset_repaired", "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def charset_repaired(spark, d):
    """A third of the texts are read as single bytes once too often, a sixth twice; all must come back as they were, the others stay."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 6
    seen = F.when(k.isin(0, 1), wrong(F.col("text"))).when(k == 2, wrong(wrong(F.col("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(scripts.charset_repaired(seen).cast("binary")).alias("md5"))


@query("prefix_matches", """WITH p AS (SELECT DISTINCT rtrim(trim(left(text, 8 + (doc_id % 90)::INT)), '.') AS start FROM documents WHERE text IS NOT NULL)
SELECT start, count(*) AS n, min(doc_id) AS first_doc FROM p JOIN documents ON starts_with(text, start) WHERE start <> '' GROUP BY start""")
def prefix_matches(spark, d):
    """How many texts begin with the beginnings of all texts."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    start = F.rtrim(F.trim(F.left("text", 8 + (F.col("doc_id") % 90).cast("int"))), F.lit("."))
    starts = docs.select(start.alias("start")).distinct()
    return identity.prefix_pairs(docs, starts, "text", "start").groupBy("start").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_RESTATED = """CASE p_size % 4 WHEN 0 THEN p_name || '..' WHEN 1 THEN 'The mission: find ' || p_name || ' at once' WHEN 2 THEN 'The task: ' || p_name ELSE p_name || ' and more' END"""


@query("restated", f"""SELECT p_partkey, rtrim(trim(s), '.') = rtrim(trim(p_name || '.'), '.') OR s LIKE 'The mission: %' || rtrim(trim(p_name), '.') || '%' AS restated FROM (SELECT p_partkey, p_name, {_RESTATED} AS s FROM part)""")
def restated(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", text.restates(F.expr(_RESTATED), F.concat("p_name", F.lit("."))).alias("restated"))


_BITS = "(SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 20), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1 ELSE 0 END)), lambda h, x: h * 2 + x) AS h FROM embeddings)"


@query("near_groups", f"""WITH RECURSIVE h AS (SELECT DISTINCT h FROM {_BITS}), n AS (SELECT h, row_number() OVER (ORDER BY h) AS i FROM h),
near AS (SELECT a.i AS a, list(b.i) AS bs FROM n a JOIN n b ON a.i < b.i AND bit_count(xor(a.h, b.h)) <= 2 GROUP BY a.i),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS seen, []::BIGINT[] AS took
UNION ALL SELECT w.i + 1, CASE WHEN list_contains(seen, w.i + 1) THEN seen ELSE list_concat(seen, list_filter(coalesce(bs, []), lambda b: NOT list_contains(seen, b))) END,
CASE WHEN list_contains(seen, w.i + 1) THEN [] ELSE list_filter(coalesce(bs, []), lambda b: NOT list_contains(seen, b)) END
FROM walk w LEFT JOIN near ON near.a = w.i + 1 WHERE w.i < (SELECT count(*) FROM n))
SELECT m.h AS node, s.h AS seed FROM (SELECT i AS seed, unnest(list_prepend(i, took)) AS node FROM walk WHERE len(took) > 0) g JOIN n m ON m.i = g.node JOIN n s ON s.i = g.seed""")
def near_groups(spark, d):
    """Groups of near hashes (first 20 components) as a walk in order of the hashes makes them."""
    hashed = table(spark, d, "embeddings").select(identity.gradient_hash(F.slice("embedding", 1, 20)).alias("h"))
    return identity.greedy_groups(identity.near_hashes(hashed, "h", bits=19, most=2))


@query("detected_latest", """WITH s AS (SELECT o_custkey AS entity, o_orderpriority AS source, 500 + o_custkey % 50 + max(o_orderkey) % 4 + CASE WHEN max(o_orderkey) % 23 = 0 THEN 200 WHEN max(o_orderkey) % 19 = 0 THEN -90 WHEN max(o_orderkey) % 7 = 0 THEN 9 ELSE 0 END AS n FROM orders GROUP BY 1, 2),
a AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 13 = 0 THEN 0 WHEN c_custkey % 7 = 0 THEN 440 + c_custkey % 50 ELSE 499 + c_custkey % 50 END AS known FROM customer),
m AS (SELECT entity, quantile_disc(n, 0.5) AS middle, count(*) AS size FROM s GROUP BY 1),
k AS (SELECT entity, max(n) AS top, max(n) - min(n) AS spread, any_value(size) - count(*) AS cut FROM s JOIN m USING (entity) WHERE size < 3 OR abs(n - middle) <= 30 GROUP BY entity)
SELECT entity, CASE WHEN top IS NULL OR (known > 0 AND top > known + 30) THEN nullif(known, 0) ELSE top END AS latest, coalesce(spread, 0) AS spread,
CASE WHEN top IS NULL THEN 'low' WHEN known > 0 AND top > known + 30 THEN 'conflict' WHEN spread > 3 THEN 'conflict' WHEN spread = 0 THEN 'high' ELSE 'medium' END AS confidence, coalesce(cut, 0) AS cut FROM a LEFT JOIN k USING (entity)""")
def detected_latest(spark, d):
    orders, customer = tables(spark, d, "orders customer")
    m, k = F.max("o_orderkey"), F.col("o_custkey") % 50
    off = F.when(m % 23 == 0, 200).when(m % 19 == 0, -90).when(m % 7 == 0, 9).otherwise(0)
    signals = orders.groupBy(F.col("o_custkey"), F.col("o_orderpriority").alias("source")).agg((500 + F.first(k) + m % 4 + off).alias("n")).withColumnRenamed("o_custkey", "entity")
    c = F.col("c_custkey")
    known = F.when(c % 13 == 0, F.lit(0).cast("long")).when(c % 7 == 0, 440 + c % 50).otherwise(499 + c % 50)
    return quality.detected_latest(signals, customer.select(c.alias("entity"), known.alias("known")))
