"""Contracts, access, evidence and comparisons over events, parts and orders; titles, names, addresses and dates as imports bring them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import scores, text
from corrobora.operators import access as ops
from corrobora.operators import commits
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query

_CONTRACT = """WITH r AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'fetch_failed' ELSE 'ok' END AS status,
CASE event_id % 4 WHEN 0 THEN 'Item ' || user_id WHEN 1 THEN 'Item 1' || user_id WHEN 2 THEN '' END AS title, CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' END AS kind FROM events),
k AS (SELECT *, (coalesce(title, '') <> '' AND regexp_matches(title, '(^|[^0-9])0*' || user_id || '([^0-9]|$)'))::INT + (trim(kind) <> '')::INT AS given FROM r)
SELECT event_id, CASE WHEN status = 'ok' AND given = 0 THEN 'parser_warning' ELSE status END AS status, given FROM k"""


@query("adapter_contract", _CONTRACT)
def adapter_contract(spark, d):
    k = F.col("event_id") % 4
    name = lambda mark: F.concat(F.lit(mark), F.col("user_id").cast("string"))
    title = F.when(k == 0, name("Item ")).when(k == 1, name("Item 1")).when(k == 2, "")
    kind = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ")
    results = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("number"), F.when(F.col("event_type") == "error", "fetch_failed").otherwise("ok").alias("status"),
        F.create_map(F.lit("title"), title, F.lit("kind"), kind).alias("fields"))
    return ops.contracted(results).select("event_id", "status", "given")


@query("latest_evidence", """WITH p AS (SELECT o_custkey AS entity, o_orderpriority AS source, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2),
r AS (SELECT entity, source, 'number' AS field, (k % 3)::VARCHAR AS value FROM p UNION ALL SELECT entity, source, 'status', s FROM p),
o AS (SELECT *, count(*) OVER (PARTITION BY entity, field, value) - 1 AS others FROM r), a AS (SELECT *, max(others) OVER (PARTITION BY entity, source) > 0 AS agrees FROM o)
SELECT entity, source, field, value, others, CASE WHEN source LIKE '1%' AND others > 0 THEN 95 WHEN source LIKE '1%' THEN 80 WHEN others > 0 THEN 70 WHEN source LIKE '2%' THEN 55 ELSE 40 END AS confidence,
CASE WHEN others > 0 THEN 'usable' WHEN agrees THEN 'corroborating' ELSE 'weak' END AS status FROM a""")
def latest_evidence(spark, d):
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("source")).agg(
        F.max("o_orderkey").alias("k"), F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    said = F.array(F.struct(F.lit("number").alias("field"), (F.col("k") % 3).cast("string").alias("value")), F.struct(F.lit("status").alias("field"), F.col("s").alias("value")))
    reports = by.select("entity", "source", F.explode(said).alias("f")).select("entity", "source", "f.*")
    found = ops.corroborated_evidence(reports, F.col("source").startswith("1"), F.col("source").startswith("2"), scores.confidence_ladder)
    return found.withColumn("confidence", F.round(F.col("confidence") * 100).cast("int"))


@query("source_access", """WITH e AS (SELECT user_id, CASE WHEN value < 4 THEN 'ROBOTS_DISALLOWED' WHEN value < 20 THEN 'ROBOTS_FETCH_FAILED' ELSE 'ROBOTS_OK' END AS robots, event_type AS t, event_id % 5 AS k FROM events),
c AS (SELECT robots, CASE WHEN robots = 'ROBOTS_DISALLOWED' THEN robots WHEN t = 'signup' THEN 'NOT_ATTEMPTED' WHEN t <> 'error' AND k = 0 THEN 'SOURCE_EMPTY' WHEN t <> 'error' AND k = 1 THEN 'PARSER_FAILURE'
WHEN t <> 'error' THEN 'SUCCESSFUL_ACCESS' WHEN k = 2 THEN 'TARGET_TIMEOUT' WHEN k = 3 THEN 'TARGET_HTTP_FAILURE' ELSE 'TARGET_NETWORK_FAILURE' END AS found FROM e)
SELECT found, count(*) AS n, count(*) FILTER (robots = 'ROBOTS_FETCH_FAILED' AND found = 'SUCCESSFUL_ACCESS') AS noted FROM c GROUP BY 1""")
def source_access(spark, d):
    t, k = F.col("event_type"), F.col("event_id") % 5
    robots = F.when(F.col("value") < 4, "ROBOTS_DISALLOWED").when(F.col("value") < 20, "ROBOTS_FETCH_FAILED").otherwise("ROBOTS_OK")
    request = F.when(t == "signup", "not_attempted").when(t == "error", "failed").otherwise("ok")
    failure = F.when((t != "error") & (k == 0), "SOURCE_EMPTY").when((t != "error") & (k == 1), "PARSER_FAILURE")
    error = F.when((t == "error") & (k == 2), "Read timed out")
    seen = table(spark, d, "events").select(robots.alias("robots"), request.alias("request"), failure.alias("failure"), F.when(k == 3, 503).alias("http"), error.alias("error"))
    found = seen.withColumn("found", ops.access_class(F.col("robots"), F.col("request"), F.col("failure"), F.col("http"), F.col("error")))
    return found.groupBy("found").agg(F.count("*").alias("n"), F.count_if(ops.stale_note(F.col("robots"), F.col("found"))).alias("noted"))


@query("implementations", """SELECT year(l_shipdate)::VARCHAR AS implementation, count(DISTINCT l_suppkey) AS attempted, count(DISTINCT l_suppkey) FILTER (l_quantity > 3) AS usable,
string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields, count(DISTINCT l_suppkey || ': ' || l_linestatus) FILTER (l_quantity <= 3) AS blocking FROM lineitem GROUP BY 1""")
def implementations(spark, d):
    results = table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("implementation"), F.col("l_suppkey").cast("string").alias("source"), (F.col("l_quantity") > 3).alias("usable"),
        F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("failure"))
    found = ops.compared(results)
    return found.select("implementation", "attempted", "usable", F.array_join("fields", ",").alias("fields"), F.size("blocking").cast("long").alias("blocking"))


@query("bumped_counters", """SELECT c_custkey, 100 + coalesce(sum(floor(o_totalprice)::BIGINT) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS o, coalesce(sum(floor(o_totalprice)::BIGINT) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS f
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def bumped_counters(spark, d):
    customer, orders = tables(spark, d, "customer orders")
    rows = customer.select("c_custkey", F.lit(100).cast("long").alias("o"), F.lit(0).cast("long").alias("f"))
    bumps = orders.select(F.col("o_custkey").alias("c_custkey"), F.lower("o_orderstatus").alias("counter"), F.floor("o_totalprice").alias("n"))
    return ops.bumped(rows, bumps, "c_custkey", ("o", "f"))


_EPISODES = """'{"id": 1, "_embedded": {"episodes": [{"name": "Episode ' || (o_orderkey % 50) || '", "airdate": "2024-01-01"}, {"name": "No number", "airdate": "2024-01-02"}, {"name": "Ep. 0' || (o_custkey % 50) || ' again", "airdate": "2024-01-03"}, {"name": null}]}}'"""


@query("endpoint_index", """SELECT o_orderkey, n AS number, arg_max(name, pos) AS name, arg_max(airdate, pos) AS airdate FROM (SELECT o_orderkey, 0 AS pos, (o_orderkey % 50)::INT AS n, 'Episode ' || o_orderkey % 50 AS name, '2024-01-01' AS airdate FROM orders
UNION ALL SELECT o_orderkey, 2, (o_custkey % 50)::INT, 'Ep. 0' || o_custkey % 50 || ' again', '2024-01-03' FROM orders) WHERE n > 0 GROUP BY 1, 2""")
def endpoint_index(spark, d):
    payloads = table(spark, d, "orders").select("o_orderkey", F.expr(_EPISODES).alias("body"))
    return ops.endpoint_index(payloads, "o_orderkey", "body", text.entity_number(F.col("name")))


@query("fixup_checks", """SELECT 'all' AS part, count(*) AS n, max(o_orderkey) AS latest, min(o_orderkey) AS first, count(*) FILTER (o_orderstatus <> '' AND o_orderstatus IS NOT NULL) AS filled, count(*) FILTER (o_orderpriority LIKE '_-%') AS titled FROM orders
UNION ALL SELECT year(o_orderdate)::VARCHAR, count(*), max(o_orderkey), min(o_orderkey), 0, 0 FROM orders GROUP BY 1 UNION ALL SELECT 'links', count(DISTINCT l_orderkey), count(*), (SELECT count(*) FROM supplier), 0, 0 FROM lineitem""")
def fixup_checks(spark, d):
    orders, lineitem, supplier = tables(spark, d, "orders lineitem supplier")
    key, none = F.col("o_orderkey"), F.lit(0).cast("long")
    sums = [F.count("*").alias("n"), F.max(key).alias("latest"), F.min(key).alias("first")]
    filled = F.count_if(F.coalesce("o_orderstatus", F.lit("")) != "").alias("filled")
    every = orders.agg(F.lit("all").alias("part"), *sums, filled, F.count_if(F.col("o_orderpriority").like("_-%")).alias("titled"))
    years = orders.groupBy(F.date_format("o_orderdate", "yyyy").alias("part")).agg(*sums).withColumns({"filled": none, "titled": none})
    links = lineitem.agg(F.lit("links").alias("part"), F.countDistinct("l_orderkey").alias("n"), F.count("*").alias("latest")).join(F.broadcast(supplier.agg(F.count("*").alias("first"))))  # one row
    return every.unionByName(years).unionByName(links.withColumns({"filled": none, "titled": none}))


@query("dry_run", """WITH new AS (SELECT DISTINCT o_custkey % 40 AS y FROM orders WHERE o_orderkey % 2 = 1), c AS (SELECT o_orderkey % 40 AS y, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT 'items' AS part, count(*) AS added, 0 AS removed FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'images', count(*), 0 FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'guests', count(DISTINCT o_orderpriority) - 1, 0 FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT 'links', count(*), 0 FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'years', (SELECT count(*) FROM new), (SELECT count(*) FROM c WHERE y IN (SELECT y FROM new))""")
def dry_run(spark, d):
    """What the creation of half of the orders would change in five tables; nothing is written."""
    orders = table(spark, d, "orders")
    items = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("number"), F.lit("t").alias("title"), (F.col("o_orderkey") % 40).alias("year"))
    before = {
        "items": items, "images": items.select("number", F.lit(True).alias("placeholder")).limit(0), "guests": spark.createDataFrame([(1, "1-URGENT")], "ident long, name string"),
        "links": spark.createDataFrame([], "number long, ident long"), "years": items.groupBy("year").agg(F.count("*").alias("total"))}
    wanted = orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("number"), F.lit("t").alias("title"), (F.col("o_custkey") % 40).alias("year"), F.array("o_orderpriority").alias("guests"))
    return ops.dry_run(before, commits.created(before, wanted))


_TITLES = "CASE p_size % 5 WHEN 0 THEN 'Episode #' || p_partkey || ' - ' || p_name WHEN 1 THEN 'episode #' || p_partkey WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'Show: ' || p_name || ' | Site ' || p_brand END"


@query("display_titles", f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 4 THEN 'Show: ' || p_name || ' | Site ' || p_brand ELSE 'untitled' END AS shown,
CASE p_size % 5 WHEN 4 THEN p_name WHEN 2 THEN NULL ELSE {_TITLES} END AS plain FROM part""")
def display_titles(spark, d):
    title = F.expr(_TITLES)
    return table(spark, d, "part").select("p_partkey", text.display_title(title, "untitled").alias("shown"), text.source_title(title, ("Site.*", "Wiki"), "Show").alias("plain"))


_NAMES = "CASE p_size % 6 WHEN 0 THEN '• ' || p_name || ' (actor)' WHEN 1 THEN '3. <b>' || p_name || '</b>' WHEN 2 THEN p_name || ' [2] ' WHEN 3 THEN p_name || '  –  host' WHEN 4 THEN 'TBD' ELSE '-' END"


@query("plain_names", "SELECT p_partkey, CASE WHEN p_size % 6 < 4 THEN p_name END AS name, CASE WHEN p_size % 6 < 4 THEN lower(replace(p_name, ' ', '')) ELSE '' END AS key FROM part")
def plain_names(spark, d):
    raw = F.expr(_NAMES)
    return table(spark, d, "part").select("p_partkey", text.plain_person(raw, ("tbd",)).alias("name"), text.plain_key(raw, ("tbd",)).alias("key"))


@query("relevant_urls", r"""WITH p AS (SELECT page_id, (100 + page_id % 900)::INT AS number, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
n AS (SELECT page_id, number, list_filter(list_transform(regexp_split_to_array(path, '[^0-9]+'), lambda x: CASE WHEN length(x) BETWEEN 2 AND 4 THEN x::INT END), lambda x: x IS NOT NULL AND
(x = number OR NOT (x BETWEEN 1900 AND 2100 OR x IN (150, 300, 360, 480, 600, 640, 720, 1080, 1280, 1920) OR abs(x - number) <= 2))) AS tell FROM p)
SELECT page_id, coalesce(tell[1] = number, true) AS relevant FROM n""")
def relevant_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.relevant_url(F.col("url"), (100 + F.col("page_id") % 900).cast("int")).alias("relevant"))


@query("import_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 AND o_orderdate + INTERVAL 13 YEAR > '2009-01-01' THEN strftime(o_orderdate + INTERVAL 13 YEAR, '%Y-%m-%d') END AS day FROM orders""")
def import_dates(spark, d):
    day, k = F.add_months(F.col("o_orderdate").cast("date"), 156), F.col("o_orderkey") % 5
    written = lambda form: F.date_format(day, form)
    raw = F.when(k == 0, written("yyyy-MM-dd HH:mm:ss")).when(k == 1, written("d MMMM yyyy")).when(k == 2, written("MMM d, yyyy")).when(k == 3, written("yyyy.M.d")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", text.import_date(raw).cast("string").alias("day"))
