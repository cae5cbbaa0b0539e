"""Catalogue queries over the order tables: lists, details, neighbours, related items, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.operators import catalog as ops
from corrobora.operators import quality
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query


def _orders(spark, d):
    orders, customer, nation = tables(spark, d, "orders customer nation")
    return ops.with_dimensions(orders, [(customer, "o_custkey", "c_custkey"), (nation, "c_nationkey", "n_nationkey")])




def _filtered(spark, d):
    base = _orders(spark, d).withColumn("o_year", F.year("o_orderdate"))
    return ops.optional_filters(base, search="1", search_in=("c_name", "n_name"), equal={"o_orderstatus": "O", "o_year": None}, at_least={"o_totalprice": 1000.0})


_FROM = """FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE (contains(lower(c_name), '1') OR contains(lower(n_name), '1')) AND o_orderstatus = 'O' AND o_totalprice >= 1000"""


@query("catalog_page", f"SELECT o_orderkey, c_name, n_name, o_totalprice {_FROM} ORDER BY o_orderkey DESC LIMIT 24 OFFSET 24")
def catalog_page(spark, d):
    rows = _filtered(spark, d).select("o_orderkey", "c_name", "n_name", "o_totalprice")
    return ops.page(rows, [F.desc("o_orderkey")], 2, 24)


@query("catalog_count", f"SELECT count(*) AS n, ceil(count(*) / 24.0)::BIGINT AS pages {_FROM}")
def catalog_count(spark, d):
    return _filtered(spark, d).agg(F.count("*").alias("n"), F.ceil(F.count("*") / 24).alias("pages"))


@query("substring_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%econ%'")
def substring_search(spark, d):
    return table(spark, d, "part").where(F.ilike("p_name", F.lit("%re%")) | F.ilike("p_type", F.lit("%econ%"))).select("p_partkey", "p_name")


@query("on_this_day", """SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders
WHERE month(o_orderdate) = 6 AND day(o_orderdate) = 15 AND o_orderdate < TIMESTAMP '1998-06-15' ORDER BY o_orderkey DESC LIMIT 10""")
def on_this_day(spark, d):
    when = F.col("o_orderdate")
    same = (F.month(when) == 6) & (F.dayofmonth(when) == 15) & (when < F.lit("1998-06-15").cast("timestamp_ntz"))
    return table(spark, d, "orders").where(same).orderBy(F.desc("o_orderkey")).limit(10).select("o_orderkey", F.year(when).alias("y"))


@query("regex_filter", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)(small|promo)$') AND p_type || ' - ' || p_name NOT LIKE '% - blue%'")
def regex_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_type").rlike("(?i)(small|promo)$") & ~F.concat("p_type", F.lit(" - "), "p_name").like("% - blue%")).select("p_partkey", "p_type")


@query("aired_guard", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '1996-06-30'")
def aired_guard(spark, d):
    when = F.col("o_orderdate")
    past = when.isNotNull() & (when <= F.lit("1996-06-30").cast("timestamp_ntz"))
    return table(spark, d, "orders").where(past).select("o_orderkey", when.cast("date").cast("string").alias("day"))


@query("in_list_ordered", """SELECT o_orderkey, (list_position([7, 3, 99, 1, 1000, 32], o_orderkey) - 1)::INT AS pos, o_totalprice
FROM orders WHERE o_orderkey IN (7, 3, 99, 1, 1000, 32)""")
def in_list_ordered(spark, d):
    found = ops.in_request_order(table(spark, d, "orders"), "o_orderkey", [7, 3, 99, 7, 1, 1000, 32, 3])
    return found.select("o_orderkey", "pos", "o_totalprice")


@query("latest_items", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderkey <> 5 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def latest_items(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey <> 5").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.limit(12).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("detail_nested", """SELECT o_orderkey, count(l_orderkey) AS n_items,
coalesce(string_agg(printf('%03d', l_linenumber) || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS items
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def detail_nested(spark, d):
    orders, lineitem = tables(spark, d, "orders lineitem")
    items = lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    child = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    nested = ops.nested_children(orders.select("o_orderkey"), items, "o_orderkey", child, "parts")
    text = F.transform("parts", lambda x: F.concat(F.format_string("%03d", x["l_linenumber"]), F.lit(":"), x["l_partkey"].cast("string")))
    return nested.select("o_orderkey", F.size("parts").cast("long").alias("n_items"), F.array_join(text, ",").alias("items"))


@query("dimension_counts", """SELECT n_name, count(c_custkey) AS customers, min(c_custkey) AS first_key, max(c_custkey) AS last_key
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_name""")
def dimension_counts(spark, d):
    nation, customer = tables(spark, d, "nation customer")
    rich = customer.where("c_acctbal > 9000")
    joined = nation.join(rich, nation["n_nationkey"] == rich["c_nationkey"], "left")
    return joined.groupBy("n_name").agg(
        F.count("c_custkey").alias("customers"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key")
    )


@query("facet_having", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING n > 10 ORDER BY n DESC, 1 LIMIT 4")
def facet_having(spark, d):
    counts = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counts.where("n > 10").orderBy(F.desc("n"), "c_mktsegment").limit(4)


@query("orphans", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, d):
    orders, lineitem = tables(spark, d, "orders lineitem")
    return orders.join(lineitem, orders["o_orderkey"] == lineitem["l_orderkey"], "left_anti").select("o_orderkey")


@query("broken_refs", """SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL
AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1""")
def broken_refs(spark, d):
    lineitem, part = tables(spark, d, "lineitem part")
    known = part.where("p_size <= 25")
    lost = lineitem.where("l_partkey IS NOT NULL").join(known, lineitem["l_partkey"] == known["p_partkey"], "left_anti")
    return lost.groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("semi_join", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def semi_join(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    done, dear = orders.where("o_orderstatus = 'F'"), orders.where("o_totalprice > 400000")
    own = customer["c_custkey"] == F.col("o_custkey")
    return customer.join(done, own, "left_semi").join(dear, own, "left_anti").select("c_custkey")


@query("existence_flags", """SELECT p_partkey, (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) AS sold_in_bulk,
(p_size > 40 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1)) AS flagged FROM part""")
def existence_flags(spark, d):
    part, lineitem = tables(spark, d, "part lineitem")
    has = lineitem.where("l_quantity = 50 OR l_discount = 0.1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.bool_or(F.col("l_quantity") == 50).alias("bulk"), F.bool_or(F.col("l_discount") == 0.1).alias("cheap")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    return part.join(has, "p_partkey", "left").select(
        "p_partkey", yes("bulk").alias("sold_in_bulk"), ((F.col("p_size") > 40) | yes("cheap")).alias("flagged")
    )


@query("null_safe_eq", """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT count(*) AS n FROM a WHERE s IS NOT DISTINCT FROM CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'O' END""")
def null_safe_eq(spark, d):
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    other = F.when(F.col("o_orderkey") % 2 != 0, F.lit("O"))
    return table(spark, d, "orders").where(status.eqNullSafe(other)).agg(F.count("*").alias("n"))


@query("shared_items", """WITH mine AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = 1)
SELECT l_orderkey, count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_orderkey <> 1 AND l_partkey IN (FROM mine) GROUP BY 1""")
def shared_items(spark, d):
    return ops.sharing_items(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 1)


@query("bridge_load", """SELECT c_custkey, n_nationkey FROM (VALUES ('Customer#000000001','A'), ('Customer#000000007','A'), ('nobody','B')) v(who, tag)
JOIN customer ON c_name = who JOIN nation ON n_nationkey % 5 = CASE tag WHEN 'A' THEN 1 ELSE 2 END""")
def bridge_load(spark, d):
    customer, nation = tables(spark, d, "customer nation")
    tag = F.when(F.col("c_name").isin("Customer#000000001", "Customer#000000007"), 1).when(F.col("c_name") == "nobody", 2)
    named = customer.withColumn("slot", tag).where("slot IS NOT NULL")
    return named.join(nation, named["slot"] == nation["n_nationkey"] % 5).select("c_custkey", "n_nationkey")


@query("range_bucket", """SELECT CASE WHEN p_size <= 10 THEN 2010 WHEN p_size <= 20 THEN 2011 WHEN p_size <= 35 THEN 2012 ELSE 2013 END AS bucket, count(*) AS n
FROM part GROUP BY 1""")
def range_bucket(spark, d):
    part = table(spark, d, "part")
    ranges = spark.createDataFrame([(0, 10, 2010), (11, 20, 2011), (21, 35, 2012), (36, None, 2013)], "lo int, hi int, bucket int")
    inside = (part["p_size"] >= ranges["lo"]) & (ranges["hi"].isNull() | (part["p_size"] <= ranges["hi"]))
    return part.join(F.broadcast(ranges), inside).groupBy("bucket").agg(F.count("*").alias("n"))  # four literal rows


@query("prev_next", """SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (ORDER BY o_orderkey)""")
def prev_next(spark, d):
    return quality.neighbours(table(spark, d, "orders"), "o_orderkey")


@query("exact_neighbours", """SELECT a.o_orderkey, b.o_orderdate::DATE::VARCHAR AS before, c.o_orderdate::DATE::VARCHAR AS after FROM orders a
LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 LEFT JOIN orders c ON c.o_orderkey = a.o_orderkey + 1""")
def exact_neighbours(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    below = orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("day").alias("before"))
    above = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("day").alias("after"))
    return orders.join(below, "o_orderkey", "left").join(above, "o_orderkey", "left").select("o_orderkey", "before", "after")


@query("representative_row", """SELECT p_brand, p_partkey FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_retailprice DESC, p_partkey) = 1""")
def representative_row(spark, d):
    rank = [F.desc(F.col("p_size") > 25), F.desc("p_retailprice"), F.col("p_partkey")]
    return ops.first_per_group(table(spark, d, "part"), ["p_brand"], rank).select("p_brand", "p_partkey")


@query("featured_topk", """WITH li AS (SELECT l_orderkey, count(DISTINCT l_suppkey) >= 3 AS many, bool_or(l_discount > 0.05) AS cut FROM lineitem GROUP BY 1)
SELECT o_orderkey, (o_totalprice > 200000)::INT + 2 * (o_orderpriority = '1-URGENT')::INT + many::INT + cut::INT AS score
FROM orders LEFT JOIN li ON l_orderkey = o_orderkey ORDER BY score DESC NULLS LAST, o_orderkey DESC LIMIT 10""")
def featured_topk(spark, d):
    orders, lineitem = tables(spark, d, "orders lineitem")
    li = lineitem.groupBy("l_orderkey").agg(
        (F.countDistinct("l_suppkey") >= 3).alias("many"), F.bool_or(F.col("l_discount") > 0.05).alias("cut")
    )
    flag = lambda c: c.cast("int")
    score = flag(F.col("o_totalprice") > 200000) + 2 * flag(F.col("o_orderpriority") == "1-URGENT") + flag(F.col("many")) + flag(F.col("cut"))
    joined = orders.join(li, orders["o_orderkey"] == li["l_orderkey"], "left").select("o_orderkey", score.alias("score"))
    return joined.orderBy(F.desc_nulls_last("score"), F.desc("o_orderkey")).limit(10)


@query("nearest_k", "SELECT p_partkey, abs(p_partkey - 100) AS distance FROM part WHERE p_partkey <> 100 ORDER BY distance, p_partkey LIMIT 9")
def nearest_k(spark, d):
    return ops.nearest(table(spark, d, "part"), "p_partkey", 100, 9).select("p_partkey", F.abs(F.col("p_partkey") - 100).alias("distance"))


@query("related_items", """WITH f AS (SELECT * FROM part WHERE p_partkey = 10),
s AS (SELECT p_partkey, 0 AS stage, abs(p_partkey - 10) AS far FROM part WHERE p_partkey <> 10 AND p_brand = (SELECT p_brand FROM f) AND p_size = (SELECT p_size FROM f)
UNION ALL SELECT p_partkey, 1, abs(p_partkey - 10) FROM part WHERE p_partkey <> 10 AND p_type = (SELECT p_type FROM f)
UNION ALL SELECT p_partkey, 2, abs(p_partkey - 10) FROM part WHERE p_partkey <> 10)
SELECT p_partkey, min(stage) AS stage FROM s GROUP BY p_partkey, far ORDER BY min(stage), far, p_partkey LIMIT 8""")
def related_items(spark, d):
    part = table(spark, d, "part").withColumn("far", F.abs(F.col("p_partkey") - 10))
    focus = part.where("p_partkey = 10").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"), F.col("p_type").alias("t"))
    others = part.where("p_partkey <> 10")
    stages = [
        others.join(focus, (others["p_brand"] == focus["b"]) & (others["p_size"] == focus["s"]), "left_semi"),
        others.join(focus, others["p_type"] == focus["t"], "left_semi"),
        ops.nearest(part, "p_partkey", 10, 8),
    ]
    return ops.staged_top_up(stages, "p_partkey", 8, ["far"]).select("p_partkey", "stage")


@query("surprise_pick", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY md5(o_orderkey::VARCHAR || ':7'), o_orderkey LIMIT 1")
def surprise_pick(spark, d):
    draw = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":7")).cast("binary"))
    return table(spark, d, "orders").where("o_totalprice > 100000").orderBy(draw, "o_orderkey").limit(1).select("o_orderkey")


@query("spread_sample", """WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem), r AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS rank, count(*) OVER () AS n FROM k)
SELECT l_orderkey, rank FROM r WHERE rank IN (SELECT i * (n - 1) // 11 FROM range(12) t(i))""")
def spread_sample(spark, d):
    return ops.spread_sample(table(spark, d, "lineitem"), "l_orderkey", 12)


@query("capped_scan", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 49 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 51)
SELECT *, (SELECT count(*) FROM r) > 50 AS truncated FROM r ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 50""")
def capped_scan(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = table(spark, d, "lineitem").where("l_quantity >= 49").select(*order, "l_quantity").orderBy(*order).limit(51)
    more = rows.agg((F.count("*") > 50).alias("truncated"))
    return rows.orderBy(*order).limit(50).join(F.broadcast(more))  # one row


@query("text_mentions", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9])0*4([^0-9]|$)')")
def text_mentions(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike("(?<![0-9])0*4(?![0-9])")).select("doc_id")


@query("json_export", """SELECT l_returnflag || '/' || l_linestatus AS grp, count(*) AS n FROM lineitem GROUP BY 1""")
def json_export(spark, d):
    groups = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    packed = groups.select(F.to_json(F.struct(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("grp"), "n")).alias("j"))
    return packed.select(F.from_json("j", "grp string, n long").alias("r")).select("r.*")
