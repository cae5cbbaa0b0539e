"""Queries over the writes and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import text
from corrobora.operators import evidence
from corrobora.operators import writes as ops
from corrobora.plans.base import table, tables
from corrobora.plans.evidence import _DIFF_RULE, _DIFF_SQL, _diff
from corrobora.plans.registry import query

_ID = "('0x' || left(md5({}), 15))::BIGINT"


@query("find_or_create", f"""SELECT coalesce(id, {_ID.format('n')}) AS id, n AS name, id IS NULL AS created FROM (SELECT DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN 'Clerk ' || o_orderkey % 100 ELSE o_orderpriority END AS n FROM orders) w
LEFT JOIN (SELECT o_orderpriority AS k, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' GROUP BY 1) ON k = n""")
def find_or_create(spark, d):
    orders = table(spark, d, "orders")
    known = orders.where("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    clerk = F.concat(F.lit("Clerk "), (F.col("o_orderkey") % 100).cast("string"))
    return ops.find_or_create(known, orders.select(F.when(F.col("o_orderkey") % 7 == 0, clerk).otherwise(F.col("o_orderpriority")).alias("name")), "name", "id")


@query("delete_garbage", "SELECT c_custkey, c_name FROM customer WHERE NOT (regexp_matches(c_name, '[05]$') OR length(c_name) > 40)")
def delete_garbage(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return ops.delete_matching(rows, F.col("c_name").rlike("[05]$") | (F.length("c_name") > 40))


@query("delete_joined", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_quantity < 30 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")
def delete_joined(spark, d):
    lineitem, orders = tables(spark, d, "lineitem orders")
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ops.delete_matching(rows, F.col("l_quantity") < 30, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))).drop("l_quantity")


@query("update_scalar", "SELECT c_custkey, c_nationkey, CASE WHEN m IS NULL THEN c_acctbal ELSE m END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey")
def update_scalar(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    best = orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return ops.update_from(customer.select("c_custkey", "c_nationkey", "c_acctbal"), best, ["c_custkey"], ["c_acctbal"])


@query("fill_blanks", """SELECT c_custkey, CASE WHEN blank AND m IS NOT NULL THEN m ELSE o END AS segment FROM (SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS blank, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END AS o FROM customer)
LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def fill_blanks(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    old = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment"))
    new = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"))
    return ops.fill_blanks(customer.select("c_custkey", old.alias("segment")), new, ["c_custkey"], ["segment"])


@query("change_log", f"SELECT doc_id, change FROM (SELECT doc_id, {_DIFF_RULE} AS change FROM {_DIFF_SQL}) WHERE change <> 'UNCHANGED'")
def change_log(spark, d):
    return ops.change_rows(_diff(spark, d)).select("doc_id", "change")


@query("log_append", r"""SELECT event_id, CASE WHEN event_type IN ('error') THEN 'error' ELSE 'info' END AS level, regexp_replace('run ' || user_id || ' token=' || md5(event_type), '(?i)\b(token|secret|password|api_?key)(\s*[=:]\s*)"?[^\s"&]+"?', '\1\2***', 'g') AS message FROM events""")
def log_append(spark, d):
    events = table(spark, d, "events")
    said = F.concat(F.lit("run "), F.col("user_id").cast("string"), F.lit(" token="), F.md5(F.col("event_type").cast("binary")))
    return ops.log_rows(events.select("event_id", "user_id", "event_type"), F.upper("event_type"), text.redacted(said)).select("event_id", "level", "message")


@query("candidate_list", """WITH c AS (SELECT l_orderkey AS k, 'u' || l_partkey % 40 AS url, l_returnflag = 'R' AS winner, l_linenumber AS rank, l_quantity BETWEEN 10 AND 40 AS ok FROM lineitem),
o AS (SELECT k, url, min((NOT winner, rank)) AS ord, bool_or(ok) AS ok FROM c GROUP BY 1, 2), f AS (SELECT k, min((ord, url)) AS f, min(ord) AS ford FROM o WHERE ok GROUP BY 1)
SELECT o.k, arg_min(url, (ord, url)) FILTER (ok) AS url, count(*) AS tried FROM o JOIN f USING (k) WHERE ord <= ford GROUP BY 1""")
def candidate_list(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.concat(F.lit("u"), (F.col("l_partkey") % 40).cast("string")).alias("url"), (F.col("l_returnflag") == "R").alias("winner"), F.col("l_linenumber").alias("rank"), "l_quantity")
    return ops.first_acceptable(c, "k", "url", F.col("l_quantity").between(10, 40))


@query("alias_lookup", "SELECT DISTINCT p_name AS raw, p_partkey % 150 AS ident FROM part WHERE p_size > 25 AND p_partkey % 150 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def alias_lookup(spark, d):
    part, supplier = tables(spark, d, "part supplier")
    aliases = part.where("p_size > 25").select(F.col("p_name").alias("raw"), (F.col("p_partkey") % 150).alias("ident")).distinct()
    return ops.aliased(part.select(F.col("p_name").alias("raw")), aliases, supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("ident")))


@query("identity_lookup", """WITH k AS (SELECT c_custkey AS ident, c_name AS name, nullif(regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g'), '') AS key FROM customer WHERE c_custkey % 4 > 0),
w AS (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(replace(c_name, '#', ' - ')) ELSE '???' END AS raw FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT raw, coalesce(same, lik) AS ident, CASE WHEN same IS NOT NULL THEN 'exact' WHEN lik IS NOT NULL THEN 'key' ELSE 'none' END AS matched FROM w LEFT JOIN (SELECT name, min(ident) AS same FROM k GROUP BY 1) ON name = raw
LEFT JOIN (SELECT key, min(ident) AS lik FROM k WHERE key IS NOT NULL GROUP BY 1) b ON b.key = nullif(regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g'), '')""")
def identity_lookup(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    known = customer.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("ident"), F.col("c_name").alias("name"), text.identity_key(F.col("c_name")).alias("key"))
    k = F.col("o_custkey") % 3
    raw = F.when(k == 0, F.col("c_name")).when(k == 1, F.upper(F.replace("c_name", F.lit("#"), F.lit(" - ")))).otherwise("???")
    wanted = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(raw.alias("raw"))
    return ops.exact_or_key(wanted.withColumn("key", text.identity_key(F.col("raw"))), known)


@query("location_lookup", """WITH v AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey), k AS (SELECT n_nationkey AS ident, n_name AS name, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '', 'g')) AS key FROM v WHERE n_nationkey <> 3),
w AS (SELECT DISTINCT CASE c_custkey % 2 WHEN 0 THEN n_name ELSE lower(n_name) || ', ' || r_name END AS said FROM customer JOIN v ON n_nationkey = c_nationkey), p AS (SELECT DISTINCT split_part(said, ', ', 1) AS raw FROM w)
SELECT raw, coalesce(a.ident, b.ident) AS ident, CASE WHEN a.ident IS NOT NULL THEN 'exact' WHEN b.ident IS NOT NULL THEN 'key' ELSE 'none' END AS matched FROM p LEFT JOIN k a ON a.name = raw LEFT JOIN k b ON b.key = lower(regexp_replace(raw, '[^A-Za-z0-9]+', '', 'g'))""")
def location_lookup(spark, d):
    nation, region, customer = tables(spark, d, "nation region customer")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    known = places.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("ident"), F.col("n_name").alias("name"), text.identity_key(F.col("n_name")).alias("key"))
    said = F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit(", "), F.col("r_name")))
    raw = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(text.place(said)["name"].alias("raw"))
    return ops.exact_or_key(raw.withColumn("key", text.identity_key(F.col("raw"))), known)


@query("verified_missing", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_shipdate IS NOT NULL)")
def verified_missing(spark, d):
    orders, lineitem = tables(spark, d, "orders lineitem")
    good = lineitem.where("l_returnflag = 'R' AND l_shipdate IS NOT NULL").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.select("o_orderkey").join(good, "o_orderkey", "left_anti")


@query("flags_reconciled", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AS verified, (p_size > 25) <> (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)) AS changed FROM part")
def flags_reconciled(spark, d):
    part, lineitem = tables(spark, d, "part lineitem")
    there = lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("there")).distinct()
    now = F.coalesce("there", F.lit(False))
    return part.join(there, "p_partkey", "left").select("p_partkey", now.alias("verified"), ((F.col("p_size") > 25) != now).alias("changed"))


@query("stored_duplicates", "SELECT doc_id, min_id AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS min_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> min_id")
def stored_duplicates(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("duplicate_of"))
    return docs.join(first, "hash").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


@query("discoveries", """WITH s AS (SELECT user_id, 'p' || event_id % 6 AS url, count(*) AS seen, bool_or(event_type = 'purchase') AS confirmed FROM events GROUP BY 1, 2)
SELECT user_id, url, seen, confirmed, row_number() OVER (PARTITION BY user_id ORDER BY confirmed DESC, seen DESC, url) AS place FROM s""")
def discoveries(spark, d):
    from pyspark.sql import Window

    seen = table(spark, d, "events").groupBy("user_id", F.concat(F.lit("p"), (F.col("event_id") % 6).cast("string")).alias("url")).agg(
        F.count("*").alias("seen"), F.bool_or(F.col("event_type") == "purchase").alias("confirmed"))
    order = Window.partitionBy("user_id").orderBy(F.desc("confirmed"), F.desc("seen"), "url")
    return seen.withColumn("place", F.row_number().over(order).cast("long"))


@query("item_diff", """WITH o AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem WHERE l_linenumber % 3 > 0), n AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem WHERE l_linenumber % 2 > 0), has AS (SELECT DISTINCT k FROM n)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.i, n.i) AS item, CASE WHEN o.i IS NULL THEN 'ITEM_ADDED' WHEN n.i IS NULL THEN 'ITEM_REMOVED' ELSE 'UNCHANGED' END AS change FROM o FULL JOIN n ON o.k = n.k AND o.i = n.i WHERE coalesce(o.k, n.k) IN (SELECT k FROM has)""")
def item_diff(spark, d):
    lineitem = table(spark, d, "lineitem")
    rows = lambda cond: lineitem.where(cond).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("item"))
    return evidence.diff_items(rows("l_linenumber % 3 > 0"), rows("l_linenumber % 2 > 0"), "k", "item")
