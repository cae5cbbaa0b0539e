"""Data-quality queries: completeness, gaps, duplicates, anomalies, histories, health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corrobora.operators import quality as ops
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query


def _yes(c):
    return F.count_if(c)


@query("stats_bundle", """SELECT count(*) AS total, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderkey) - min(o_orderkey) + 1 AS expected,
max(o_orderkey) - min(o_orderkey) + 1 - count(*) AS missing, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1)::DOUBLE AS pct FROM orders""")
def stats_bundle(spark, d):
    a = table(spark, d, "orders").agg(
        F.count("*").alias("total"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"),
        _yes(F.col("o_orderstatus") == "F").alias("done"),
    )
    expected = F.col("last_key") - F.col("first_key") + 1
    return a.select("*", expected.alias("expected"), (expected - F.col("total")).alias("missing"), ops.percent(F.col("done"), F.col("total")).alias("pct"))


@query("archive_stats", """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers,
(SELECT count(*) FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)) AS served,
(SELECT count(DISTINCT p_brand) FROM part) AS brands, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS in_debt""")
def archive_stats(spark, d):
    orders, customer, nation, part, supplier = tables(spark, d, "orders customer nation part supplier")
    one = lambda df, c, n: df.agg(c.alias(n))
    served = nation.join(customer, nation["n_nationkey"] == customer["c_nationkey"], "left_semi")
    out = one(orders, F.count("*"), "orders")
    for other in (one(customer, F.count("*"), "customers"), one(served, F.count("*"), "served"),
                  one(part, F.countDistinct("p_brand"), "brands"), one(supplier.where("s_acctbal < 0"), F.count("*"), "in_debt")):
        out = out.join(F.broadcast(other))  # one row each
    return out


_GAPS = {
    "no_text": lambda: ops.blank("text"),
    "short": lambda: F.length("text") < 200,
    "no_lines": lambda: ~F.contains("text", F.lit("\n")),
    "foreign": lambda: ~F.col("lang").isin("en"),
}


@query("field_gap_counts", """SELECT count(*) AS total, count(*) FILTER (trim(coalesce(text, '')) = '') AS no_text, count(*) FILTER (length(text) < 200) AS short,
count(*) FILTER (NOT contains(text, chr(10))) AS no_lines, count(*) FILTER (lang NOT IN ('en')) AS foreign_,
count(*) FILTER (NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)) AS unlabelled FROM documents""")
def field_gap_counts(spark, d):
    documents, labels = tables(spark, d, "documents labels")
    known = labels.select("doc_id", F.lit(True).alias("known")).distinct()
    gaps = {n: c() for n, c in _GAPS.items()} | {"unlabelled": F.col("known").isNull()}
    return ops.gap_counts(documents.join(known, "doc_id", "left"), gaps).withColumnRenamed("foreign", "foreign_")


@query("computed_flags", """SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'no_text' END, CASE WHEN length(text) < 200 THEN 'short' END,
CASE WHEN NOT contains(text, chr(10)) THEN 'no_lines' END) AS missing FROM documents
WHERE trim(coalesce(text, '')) = '' OR length(text) < 200 OR NOT contains(text, chr(10))""")
def computed_flags(spark, d):
    found = ops.missing_fields(table(spark, d, "documents"), {n: _GAPS[n]() for n in ("no_text", "short", "no_lines")})
    return found.select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("core_completeness", """SELECT lang, count(*) AS total, count(*) FILTER (length(text) >= 200 AND contains(text, chr(10))) AS complete,
coalesce(round(100.0 * count(*) FILTER (length(text) >= 200 AND contains(text, chr(10))) / nullif(count(*), 0), 1), 0)::DOUBLE AS pct FROM documents GROUP BY lang""")
def core_completeness(spark, d):
    whole = (F.length("text") >= 200) & F.contains("text", F.lit("\n"))
    a = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("total"), _yes(whole).alias("complete"))
    return a.withColumn("pct", ops.percent(F.col("complete"), F.col("total")))


@query("numbering_gaps", """SELECT k AS l_orderkey FROM (SELECT unnest(range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) + 1 FROM lineitem))) AS k)
WHERE k NOT IN (SELECT l_orderkey FROM lineitem)""")
def numbering_gaps(spark, d):
    return ops.numbering_gaps(table(spark, d, "lineitem"), "l_orderkey")


@query("dup_groups", "SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1, 2 HAVING n > 1")
def dup_groups(spark, d):
    day = F.col("o_orderdate").cast("date").cast("string").alias("day")
    return ops.duplicate_groups(table(spark, d, "orders"), [F.col("o_custkey"), day], "o_orderkey")


@query("dup_documents", """SELECT sha1(lower(trim(text))) AS h, count(*) OVER (PARTITION BY sha1(lower(trim(text)))) AS n, doc_id FROM documents QUALIFY n > 1""")
def dup_documents(spark, d):
    return ops.duplicate_rows(table(spark, d, "documents"), F.sha1(F.lower(F.trim(F.col("text"))).cast("binary")), "doc_id")


@query("hash_group_classify", """SELECT sha1(text) AS h, count(*) AS n, max(n_chars) AS longest,
CASE WHEN max(n_chars) < 500 THEN 'placeholder' WHEN count(*) = max(doc_id) - min(doc_id) + 1 AND count(*) <= 2 THEN 'legitimate' ELSE 'likely_wrong' END AS class
FROM documents GROUP BY 1 HAVING n > 1""")
def hash_group_classify(spark, d):
    a = table(spark, d, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(
        F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    close = (F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("n") <= 2)
    kind = F.when(F.col("longest") < 500, "placeholder").when(close, "legitimate").otherwise("likely_wrong")
    return a.where("n > 1").select("h", "n", "longest", kind.alias("class"))


@query("contiguity", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) = max(l_partkey) - min(l_partkey) + 1 AS contiguous, min(l_partkey) || '-' || max(l_partkey) AS label FROM lineitem GROUP BY 1")
def contiguity(spark, d):
    lo, hi = F.min("l_partkey"), F.max("l_partkey")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("n"), (F.countDistinct("l_partkey") == hi - lo + 1).alias("contiguous"),
        F.concat_ws("-", lo.cast("string"), hi.cast("string")).alias("label"))


@query("distinct_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.col("ts").cast("date")).alias("days"))


@query("status_histogram", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p,
round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*))::BIGINT AS pct FROM orders GROUP BY 1""")
def status_histogram(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    n = lambda c: F.coalesce(c, F.lit(0))
    all_ = n("F") + n("O") + n("P")
    return wide.select("o_orderpriority", n("F").alias("f"), n("O").alias("o"), n("P").alias("p"),
                       F.round(F.try_divide(100.0 * n("F"), all_)).cast("long").alias("pct"))


@query("activity_window", """SELECT event_type, user_id % 5 AS slot, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2""")
def activity_window(spark, d):
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS"))  # one row
    return recent.groupBy("event_type", (F.col("user_id") % 5).alias("slot")).agg(F.count("*").alias("n"))


@query("run_stats", """SELECT ts::DATE::VARCHAR AS day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 2) AS total, round(avg(value), 3) AS mean FROM events GROUP BY 1""")
def run_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count("*").alias("runs"), _yes(F.col("event_type") == "error").alias("failed"),
        F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 3).alias("mean"))


@query("outcome_reasons", """SELECT event_type, user_id % 7 AS source, (props->>'k')::INT % 4 AS reason, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, 1, 2, 3 LIMIT 25""")
def outcome_reasons(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    a = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("source"), k.alias("reason")).agg(F.count("*").alias("n"))
    return a.orderBy(F.desc("n"), "event_type", "source", "reason").limit(25)


@query("evidence_span", "SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_shipdate)::DATE::VARCHAR AS first_seen, max(l_shipdate)::DATE::VARCHAR AS last_seen FROM lineitem GROUP BY 1, 2")
def evidence_span(spark, d):
    day = lambda c: c.cast("date").cast("string")
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("n"), day(F.min("l_shipdate")).alias("first_seen"), day(F.max("l_shipdate")).alias("last_seen"))


@query("unstable_entities", """WITH u AS (SELECT user_id, 'error' AS why FROM events WHERE event_type = 'error' AND value > 50 UNION
SELECT user_id, 'purchase' FROM events WHERE event_type = 'purchase' AND value < 5)
SELECT user_id, string_agg(why, ',' ORDER BY why) AS reasons, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events e WHERE e.user_id = u.user_id) AS last_seen FROM u GROUP BY user_id""")
def unstable_entities(spark, d):
    events = table(spark, d, "events")
    bad = events.where("event_type = 'error' AND value > 50").select("user_id", F.lit("error").alias("why"))
    odd = events.where("event_type = 'purchase' AND value < 5").select("user_id", F.lit("purchase").alias("why"))
    reasons = bad.union(odd).distinct().groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))
    last = events.groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return reasons.join(last, "user_id")


@query("tagged_union", "SELECT 'part' AS kind, p_partkey AS k FROM part WHERE p_size = 1 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal < 0 ORDER BY kind, k LIMIT 40")
def tagged_union(spark, d):
    part, supplier = tables(spark, d, "part supplier")
    a = part.where("p_size = 1").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("k"))
    b = supplier.where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"))
    return a.unionByName(b).orderBy("kind", "k").limit(40)


@query("set_differences", """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.s, b.s) AS l_suppkey, count(*) FILTER (b.p IS NULL) AS removed, count(*) FILTER (a.p IS NULL) AS added, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) AS kept
FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p GROUP BY 1""")
def set_differences(spark, d):
    line = table(spark, d, "lineitem")
    side = lambda f, n: line.where(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey").distinct().withColumn(n, F.lit(True))
    both = side("A", "old").join(side("R", "new"), ["l_suppkey", "l_partkey"], "full")
    return both.groupBy("l_suppkey").agg(_yes(F.col("new").isNull()).alias("removed"), _yes(F.col("old").isNull()).alias("added"),
                                         _yes(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("kept"))


@query("latest_signal", """WITH s AS (SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'F') AS f, max(o_orderkey) FILTER (o_orderstatus = 'O') AS o, max(o_orderkey) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_custkey, greatest(f, o, p) AS latest, coalesce(greatest(f, o, p) - least(f, o, p), 0) AS spread,
CASE WHEN (f IS NOT NULL)::INT + (o IS NOT NULL)::INT + (p IS NOT NULL)::INT < 2 THEN 'single' WHEN greatest(f, o, p) - least(f, o, p) > 1000 THEN 'conflict' ELSE 'agreed' END AS state FROM s""")
def latest_signal(spark, d):
    by = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("m"))
    a = by.groupBy("o_custkey").agg(F.max("m").alias("latest"), (F.max("m") - F.min("m")).alias("spread"), F.count("*").alias("n"))
    state = F.when(F.col("n") < 2, "single").when(F.col("spread") > 1000, "conflict").otherwise("agreed")
    return a.select("o_custkey", "latest", "spread", state.alias("state"))


@query("mode_vote", "SELECT l_partkey, arg_max(l_suppkey, (n, -l_suppkey)) AS winner, max(n) AS votes, max(n) - min(n) AS spread FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def mode_vote(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("winner"),
                                      F.max("n").alias("votes"), (F.max("n") - F.min("n")).alias("spread"))


@query("ewma_latency", """SELECT user_id, count(*) AS n, list_reduce(list_prepend(0::BIGINT, list(round(value)::BIGINT ORDER BY ts, event_id)),
lambda a, x: CASE WHEN a = 0 THEN x ELSE round((a * 3 + x) / 4.0)::BIGINT END) AS smoothed FROM events GROUP BY 1""")
def ewma_latency(spark, d):
    return ops.smoothed(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.round("value").cast("long"))


@query("streaks", """WITH m AS (SELECT user_id, event_type = 'error' AS f, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, island, count(*) FILTER (f) AS run FROM m GROUP BY 1, 2)
SELECT user_id, arg_max(run, island) AS current_streak, max(run) AS longest_streak FROM r GROUP BY 1""")
def streaks(spark, d):
    return ops.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("outcome_counters", """WITH e AS (SELECT user_id, unnest([event_type, '*']) AS field, value FROM events)
SELECT user_id, field, count(*) AS samples, count(*) FILTER (value >= 50) AS agreements, count(*) FILTER (value < 50) AS disagreements FROM e GROUP BY 1, 2""")
def outcome_counters(spark, d):
    e = table(spark, d, "events").select("user_id", F.explode(F.array("event_type", F.lit("*"))).alias("field"), "value")
    return e.groupBy("user_id", "field").agg(F.count("*").alias("samples"), _yes(F.col("value") >= 50).alias("agreements"), _yes(F.col("value") < 50).alias("disagreements"))


@query("severity_ladder", """SELECT strftime(l_shipdate, '%Y-%m') AS domain, count(*) AS issues, ['info', 'notice', 'warning', 'critical'][max(CASE WHEN l_discount >= 0.1 AND l_quantity > 49 THEN 4 WHEN l_discount >= 0.09 THEN 3 WHEN l_tax = 0 THEN 2 ELSE 1 END)] AS worst FROM lineitem GROUP BY 1""")
def severity_ladder(spark, d):
    severity = (F.when((F.col("l_discount") >= 0.1) & (F.col("l_quantity") > 49), "critical").when(F.col("l_discount") >= 0.09, "warning")
                .when(F.col("l_tax") == 0, "notice").otherwise("info"))
    issues = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("domain"), severity.alias("severity"))
    return ops.worst_severity(issues, "domain", "severity", ["info", "notice", "warning", "critical"])


@query("ranked_issues", """SELECT CASE WHEN l_discount >= 0.1 THEN 3 ELSE 1 END AS severity, l_returnflag AS domain, l_orderkey, l_linenumber, l_partkey FROM lineitem
ORDER BY severity DESC, domain, l_orderkey, l_linenumber, l_partkey LIMIT 100""")
def ranked_issues(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    s = F.when(F.col("l_discount") >= 0.1, 3).otherwise(1).alias("severity")
    return table(spark, d, "lineitem").select(s, F.col("l_returnflag").alias("domain"), *order).orderBy(F.desc("severity"), "domain", *order).limit(100)


@query("record_confidence", "SELECT l_orderkey, round(0.4 * min(100 - l_quantity) + 0.6 * avg(100 - l_quantity))::INT AS confidence FROM lineitem GROUP BY 1")
def record_confidence(spark, d):
    c = 100 - F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(0.4 * F.min(c) + 0.6 * F.avg(c)).cast("int").alias("confidence"))


@query("latest_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark, d):
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return table(spark, d, "events").groupBy("user_id").agg(newest).select("user_id", "e.*")


@query("daily_reference", "SELECT event_id, 'RUN-' || ts::DATE::VARCHAR || '-' || CASE WHEN n < 1000 THEN printf('%03d', n) ELSE n::VARCHAR END AS ref FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS n FROM events)")
def daily_reference(spark, d):
    day = F.col("ts").cast("date")
    placed = ops.numbered(table(spark, d, "events").select("event_id", day.alias("day")), "event_id", "n", F.col("day"))
    return placed.select("event_id", F.concat(F.lit("RUN-"), F.col("day").cast("string"), F.lit("-"), F.format_string("%03d", "n")).alias("ref"))


@query("order_anomaly", """SELECT o_orderkey, (b.d IS NOT NULL AND b.d > a.d) AS after_next, (c.d IS NOT NULL AND c.d < a.d) AS before_previous FROM (SELECT o_orderkey, o_orderdate AS d FROM orders) a
LEFT JOIN (SELECT o_orderkey + 1 AS k, o_orderdate AS d FROM orders) b ON b.k = a.o_orderkey LEFT JOIN (SELECT o_orderkey - 1 AS k, o_orderdate AS d FROM orders) c ON c.k = a.o_orderkey
WHERE (b.d IS NOT NULL AND b.d > a.d) OR (c.d IS NOT NULL AND c.d < a.d)""")
def order_anomaly(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("day"))
    shifted = lambda by, n: orders.select((F.col("o_orderkey") + by).alias("o_orderkey"), F.col("day").alias(n))
    joined = orders.join(shifted(1, "before"), "o_orderkey", "left").join(shifted(-1, "after"), "o_orderkey", "left")
    late = F.coalesce(F.col("before") > F.col("day"), F.lit(False))
    early = F.coalesce(F.col("after") < F.col("day"), F.lit(False))
    return joined.select("o_orderkey", late.alias("after_next"), early.alias("before_previous")).where("after_next OR before_previous")


@query("audit_join", """SELECT o_orderkey, o_totalprice FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND n < 2""")
def audit_join(spark, d):
    orders, lineitem = tables(spark, d, "orders lineitem")
    n = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).where("n < 2")
    return orders.where("o_orderstatus = 'F'").join(n, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("date_corroboration", """SELECT l_orderkey, l_linenumber, l_partkey, min(o.o_orderkey) AS witness FROM lineitem JOIN orders o ON o.o_orderdate::DATE = l_shipdate::DATE AND o.o_totalprice > 450000 GROUP BY 1, 2, 3""")
def date_corroboration(spark, d):
    lineitem, orders = tables(spark, d, "lineitem orders")
    seen = orders.where("o_totalprice > 450000").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.min("o_orderkey").alias("witness"))
    keyed = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("day")).distinct()
    return keyed.join(seen, "day").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("witness").alias("witness"))


@query("health_scan", """SELECT 'missing_items' AS issue, 'high' AS severity, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'duplicate_lines', 'medium', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'short_text', 'low', count(*) FROM documents WHERE length(text) < 200
UNION ALL SELECT 'unlabelled', 'low', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'idle_suppliers', 'medium', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
UNION ALL SELECT 'error_burst', 'high', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 20)""")
def health_scan(spark, d):
    orders, lineitem, documents, labels, supplier, events = tables(spark, d, "orders lineitem documents labels supplier events")
    checks = [
        ("missing_items", "high", orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")),
        ("duplicate_lines", "medium", lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
        ("short_text", "low", documents.where(F.length("text") < 200)),
        ("unlabelled", "low", documents.join(labels, "doc_id", "left_anti")),
        ("idle_suppliers", "medium", supplier.join(lineitem, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti")),
        ("error_burst", "high", events.where("event_type = 'error'").groupBy("user_id").count().where("count > 20")),
    ]
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("issue"), F.lit(s).alias("severity"), "n") for i, s, df in checks]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out
