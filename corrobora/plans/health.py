"""Queries over targets, issues, health domains, state views, error classes and small scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import text
from corrobora.operators import health as ops
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query

_STATE = """st AS (SELECT p_partkey AS number, list_filter([CASE WHEN p_size % 5 = 0 THEN 'title' END, CASE WHEN p_size % 7 = 0 THEN 'date' END, CASE WHEN p_retailprice < 1000 THEN 'price' END], lambda x: x IS NOT NULL) AS missing,
coalesce(f, false) AS failed, coalesce(u, false) AS unstable, p_size > 45 AS unverified, coalesce(lines, 0) AS lines FROM part LEFT JOIN (SELECT l_partkey, bool_or(l_returnflag = 'R' AND l_quantity > 48) AS f, count(DISTINCT l_returnflag) > 2 AS u, count(*) AS lines FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def _state(spark, d):
    part, lineitem = tables(spark, d, "part lineitem")
    seen = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)).alias("failed"), (F.countDistinct("l_returnflag") > 2).alias("unstable"), F.count("*").alias("lines"))
    missing = F.array_compact(F.array(F.when(F.col("p_size") % 5 == 0, "title"), F.when(F.col("p_size") % 7 == 0, "date"), F.when(F.col("p_retailprice") < 1000, "price")))
    return part.join(seen, "p_partkey", "left").select(
        F.col("p_partkey").alias("number"), missing.alias("missing"), F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("unstable", F.lit(False)).alias("unstable"),
        (F.col("p_size") > 45).alias("unverified"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("targets", f"""WITH {_STATE}, t AS (SELECT number, 'single' AS mode FROM st WHERE number = 17 UNION ALL SELECT number, 'range' FROM st WHERE number BETWEEN 100 AND 180 UNION ALL SELECT number, 'missing' FROM st WHERE len(missing) > 0 UNION ALL SELECT number, 'failed' FROM st WHERE failed
UNION ALL SELECT number, 'unstable' FROM st WHERE unstable UNION ALL SELECT number, 'thumbnails' FROM st WHERE unverified UNION ALL SELECT number, 'full' FROM st WHERE number >= 1)
SELECT number, mode FROM t QUALIFY row_number() OVER (PARTITION BY mode ORDER BY number) <= 200
UNION ALL SELECT n, 'latest' FROM (SELECT m + i AS n FROM (SELECT max(number) AS m FROM st), range(1, 6) r(i) UNION SELECT number FROM (SELECT number FROM st WHERE len(missing) > 0 ORDER BY number DESC LIMIT 3))""")
def targets(spark, d):
    state = _state(spark, d)
    modes = [ops.targets(m, state, single=17, low=100 if m == "range" else 1, high=180) for m in ("single", "range", "missing", "failed", "unstable", "thumbnails", "full")]
    return ops.union_all([*modes, ops.latest_targets(state, 10_000_000, 5, 3)])


@query("sources_for_mode", "SELECT s_suppkey, mode FROM supplier, (VALUES ('quick', 3), ('normal', 2), ('deep', 1)) m(mode, least) WHERE s_suppkey % 3 + 1 >= least")
def sources_for_mode(spark, d):
    # The three modes are fixed.
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("least")) for m, n in (("quick", 3), ("normal", 2), ("deep", 1))]))
    return table(spark, d, "supplier").select("s_suppkey", modes.alias("m")).where(F.col("s_suppkey") % 3 + 1 >= F.col("m.least")).select("s_suppkey", "m.mode")


_ISSUES = f"""{_STATE}, iss AS (SELECT 'provenance' AS domain, * FROM (SELECT unnest([{{'issue': 'applied_rejected', 'severity': 'CRITICAL', 'n': count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.08)}}, {{'issue': 'applied_unsafe', 'severity': 'CRITICAL', 'n': count(*) FILTER (l_quantity >= 50)}},
{{'issue': 'applied_empty', 'severity': 'ERROR', 'n': count(*) FILTER (l_tax = 0 AND l_discount = 0)}}, {{'issue': 'unsourced', 'severity': 'WARNING', 'n': count(*) FILTER (l_suppkey % 50 = 0)}}, {{'issue': 'source_missing', 'severity': 'INFO', 'n': count(*) FILTER (l_tax = 0)}}], recursive := true) FROM lineitem)
UNION ALL SELECT 'research', * FROM (SELECT unnest([{{'issue': 'conflict', 'severity': 'WARNING', 'n': count(*) FILTER (unstable)}}, {{'issue': 'failed', 'severity': 'WARNING', 'n': count(*) FILTER (failed)}}, {{'issue': 'never_researched', 'severity': 'INFO', 'n': count(*) FILTER (lines = 0)}}], recursive := true) FROM st)
UNION ALL SELECT 'quiet', * FROM (SELECT unnest([{{'issue': 'negative', 'severity': 'ERROR', 'n': count(*) FILTER (number < 0)}}], recursive := true) FROM st))"""


def _issues(spark, d):
    state, line = _state(spark, d), table(spark, d, "lineitem")
    return ops.union_all([
        ops.counted_rules(line, "provenance", {
            "applied_rejected": ("CRITICAL", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)), "applied_unsafe": ("CRITICAL", F.col("l_quantity") >= 50),
            "applied_empty": ("ERROR", (F.col("l_tax") == 0) & (F.col("l_discount") == 0)), "unsourced": ("WARNING", F.col("l_suppkey") % 50 == 0), "source_missing": ("INFO", F.col("l_tax") == 0)}),
        ops.counted_rules(state, "research", {"conflict": ("WARNING", F.col("unstable")), "failed": ("WARNING", F.col("failed")), "never_researched": ("INFO", F.col("lines") == 0)}),
        ops.counted_rules(state, "quiet", {"negative": ("ERROR", F.col("number") < 0)})])


@query("domain_issues", f"WITH {_ISSUES} SELECT domain, issue, severity, n FROM iss")
def domain_issues(spark, d):
    return _issues(spark, d)


@query("domain_status", f"""WITH {_ISSUES} SELECT domain, CASE max(CASE WHEN n = 0 THEN 0 WHEN severity = 'CRITICAL' THEN 4 WHEN severity = 'ERROR' THEN 3 WHEN severity = 'WARNING' THEN 2 ELSE 1 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'INFO' ELSE 'GOOD' END AS status,
count(*) FILTER (n > 0) AS issues, sum(n)::BIGINT AS rows FROM iss GROUP BY 1""")
def domain_status(spark, d):
    return ops.domain_status(_issues(spark, d))


@query("filtered_issues", f"WITH {_ISSUES} SELECT domain, issue, severity, n FROM iss WHERE severity IN ('CRITICAL', 'WARNING') AND domain = 'provenance'")
def filtered_issues(spark, d):
    return ops.filter_issues(_issues(spark, d), severity=["CRITICAL", "WARNING"], domain="provenance", issue=None)


_IMAGES = """im AS (SELECT doc_id, doc_id % 10 <> 0 AS recorded, doc_id % 11 <> 0 AS stored, length(text) >= 200 AS ok, min(doc_id) OVER (PARTITION BY md5(text)) AS first, source = 'src1' AS shared, count(*) OVER (PARTITION BY md5(regexp_replace(lower(text), '[^\\pL\\pN]+', '', 'g'))) > 1 AS near FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN NOT recorded THEN 'MISSING' WHEN NOT stored THEN 'BROKEN' WHEN NOT ok THEN 'INVALID' WHEN first <> doc_id AND NOT shared THEN 'DUPLICATE' WHEN near THEN 'SUSPECT_DUPLICATE' ELSE 'VALID' END AS state FROM im)"""


def _images(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("hash"), F.md5(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "").cast("binary")).alias("like"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first"))
    like = docs.groupBy("like").agg((F.count("*") > 1).alias("near"))
    i = F.col("doc_id")
    state = ops.image_state(i % 10 != 0, i % 11 != 0, F.col("n") >= 200, F.when(F.col("first") != i, F.col("first")), F.col("source") == "src1", F.col("near"))
    return docs.join(first, "hash").join(like, "like").select("doc_id", state.alias("state"))


@query("image_states", f"WITH {_IMAGES} SELECT doc_id, state FROM s".replace("source = 'src1'", "coalesce(source, '') = 'src1'"))
def image_states(spark, d):
    return _images(spark, d)


@query("image_integrity", f"WITH {_IMAGES} SELECT state, count(*) AS n, CASE WHEN state IN ('BROKEN', 'INVALID') THEN 'ERROR' WHEN state IN ('MISSING', 'DUPLICATE') THEN 'WARNING' WHEN state = 'SUSPECT_DUPLICATE' THEN 'INFO' ELSE 'GOOD' END AS severity FROM s GROUP BY 1".replace("source = 'src1'", "coalesce(source, '') = 'src1'"))
def image_integrity(spark, d):
    state = F.col("state")
    severity = F.when(state.isin("BROKEN", "INVALID"), "ERROR").when(state.isin("MISSING", "DUPLICATE"), "WARNING").when(state == "SUSPECT_DUPLICATE", "INFO").otherwise("GOOD")
    return _images(spark, d).groupBy("state").agg(F.count("*").alias("n")).withColumn("severity", severity)


@query("state_view", f"WITH {_STATE} SELECT number, round(100.0 * (3 - len(missing)) / 3)::BIGINT AS completeness, array_to_string(missing, ',') AS gaps, CASE WHEN failed THEN 'failed' WHEN unstable THEN 'conflict' WHEN lines = 0 THEN 'never' WHEN len(missing) = 0 THEN 'complete' ELSE 'incomplete' END AS status, len(missing) > 0 AND NOT unstable AS eligible, lines < 20 AS stale FROM st")
def state_view(spark, d):
    status = F.when(F.col("failed"), "failed").when(F.col("unstable"), "conflict").when(F.col("lines") == 0, "never").when(F.size("missing") == 0, "complete").otherwise("incomplete")
    return _state(spark, d).select(
        "number", F.round(100.0 * (3 - F.size("missing")) / 3).cast("long").alias("completeness"), F.array_join("missing", ",").alias("gaps"), status.alias("status"),
        ((F.size("missing") > 0) & ~F.col("unstable")).alias("eligible"), (F.col("lines") < 20).alias("stale"))


@query("gap_fields", f"""WITH {_STATE}, m AS (SELECT * FROM (VALUES ('title', 'title'), ('title', 'title_ko'), ('date', 'air_date'), ('price', 'location'), ('price', 'tags')) t(gap, field)), g AS (SELECT number, unnest(missing) AS gap FROM st) SELECT number, field FROM g JOIN m USING (gap)""")
def gap_fields(spark, d):
    # The fields that fill a gap.
    fields = F.create_map(F.lit("title"), F.array(F.lit("title"), F.lit("title_ko")), F.lit("date"), F.array(F.lit("air_date")), F.lit("price"), F.array(F.lit("location"), F.lit("tags")))
    gaps = _state(spark, d).select("number", F.explode("missing").alias("gap"))
    return gaps.select("number", F.explode(F.element_at(fields, F.col("gap"))).alias("field"))


@query("source_status", """SELECT s_suppkey, CASE WHEN n IS NULL THEN 'not checked' WHEN rate >= 60 THEN 'reliable' WHEN rate >= 45 THEN 'mixed' ELSE 'failing' END AS label, rate, s_suppkey % 4 = 0 AND coalesce(rate, 0) < 55 AS cooling FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS n, round(100.0 * count(*) FILTER (l_returnflag = 'N') / count(*))::BIGINT AS rate FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def source_status(spark, d):
    supplier, lineitem = tables(spark, d, "supplier lineitem")
    seen = lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(100.0 * F.count_if(F.col("l_returnflag") == "N") / F.count("*")).cast("long").alias("rate"))
    label = F.when(F.col("rate").isNull(), "not checked").when(F.col("rate") >= 60, "reliable").when(F.col("rate") >= 45, "mixed").otherwise("failing")
    return supplier.join(seen, "s_suppkey", "left").select("s_suppkey", label.alias("label"), "rate", ((F.col("s_suppkey") % 4 == 0) & (F.coalesce("rate", F.lit(0)) < 55)).alias("cooling"))


@query("dashboard", f"""WITH {_ISSUES} SELECT (SELECT count(*) FROM st) AS items, (SELECT count(*) FROM st WHERE len(missing) = 0) AS complete, (SELECT max(number) FROM st) AS latest, (SELECT count(*) FROM supplier) AS sources, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS healthy,
(SELECT count(*) FROM iss WHERE n > 0) AS issues, (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders) AS last_run""")
def dashboard(spark, d):
    items = _state(spark, d).agg(F.count("*").alias("items"), F.count_if(F.size("missing") == 0).alias("complete"), F.max("number").alias("latest"))
    sources = table(spark, d, "supplier").agg(F.count("*").alias("sources"), F.count_if(F.col("s_acctbal") > 0).alias("healthy"))
    issues = _issues(spark, d).agg(F.count_if(F.col("n") > 0).alias("issues"))
    runs = table(spark, d, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_run"))
    return items.crossJoin(sources).crossJoin(issues).crossJoin(runs)  # one row each


@query("error_classes", """SELECT event_id, CASE WHEN s IN (404, 410) THEN 'not_found' WHEN s IN (401, 403) THEN 'blocked' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'http_5xx' WHEN s >= 400 THEN 'http_4xx' ELSE 'other' END AS http,
CASE WHEN user_id % 13 = 0 OR c IN (5, 97) THEN 'proxy' WHEN c = 6 THEN 'dns' WHEN c IN (7, 56) THEN 'connect' WHEN c = 28 THEN 'timeout' WHEN c IN (35, 58, 59, 83, 51, 60) THEN 'tls' WHEN c = 47 THEN 'redirect' ELSE 'other' END AS transport FROM (SELECT event_id, user_id, 395 + event_id % 120 AS s, event_id % 100 AS c FROM events)""")
def error_classes(spark, d):
    message = F.when(F.col("user_id") % 13 == 0, "CONNECT tunnel failed, response 403").otherwise("failed")
    return table(spark, d, "events").select(
        "event_id", ops.error_class(395 + F.col("event_id") % 120).alias("http"), ops.transport_class(F.col("event_id") % 100, message).alias("transport"))


@query("failure_tally", "SELECT user_id, count(*) AS tried, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT event_type) AS kinds, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 1) AS coverage FROM events GROUP BY 1")
def failure_tally(spark, d):
    failed = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("tried"), failed.alias("failed"), F.countDistinct("event_type").alias("kinds"), F.round(100.0 * (F.count("*") - failed) / F.count("*"), 1).alias("coverage"))


@query("source_agreement", """WITH a AS (SELECT l_orderkey AS k, max(l_partkey % 3) FILTER (l_linenumber % 2 = 0) AS x, max(l_partkey % 3) FILTER (l_linenumber % 2 = 1) AS y FROM lineitem GROUP BY 1) SELECT k % 10 AS sample, count(*) AS n, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both_present, count(*) FILTER (x = y) AS agree FROM a GROUP BY 1""")
def source_agreement(spark, d):
    value = F.col("l_partkey") % 3
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.max(F.when(F.col("l_linenumber") % 2 == 0, value)).alias("x"), F.max(F.when(F.col("l_linenumber") % 2 == 1, value)).alias("y"))
    return a.groupBy((F.col("k") % 10).alias("sample")).agg(
        F.count("*").alias("n"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both_present"), F.count_if(F.col("x") == F.col("y")).alias("agree"))


@query("year_summary", "SELECT year(o_orderdate) AS y, count(*) AS n, max(o_orderkey) AS top, arg_max(o_orderkey, o_orderkey, 2)[2] AS second FROM orders GROUP BY 1")
def year_summary(spark, d):
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey")
    n = orders.groupBy("y").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))
    below = orders.join(n, "y").where("o_orderkey < top").groupBy("y").agg(F.max("o_orderkey").alias("second"))
    return n.join(below, "y", "left")


@query("confidence_numbers", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 88 WHEN '2' THEN 72 WHEN '3' THEN 55 WHEN '4' THEN 40 ELSE 50 END AS confidence FROM orders")
def confidence_numbers(spark, d):
    words = F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "CONFLICT", "?")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    # What a confidence word counts.
    number = F.create_map(*[F.lit(x) for pair in {"HIGH": 88, "MEDIUM": 72, "LOW": 55, "CONFLICT": 40}.items() for x in pair])
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.element_at(number, words), F.lit(50)).alias("confidence"))


@query("field_vocabulary", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS title, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS location FROM customer")
def field_vocabulary(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return rows.select("c_custkey", *[text.truthy(F.col(c)).alias(field) for c, field in (("c_name", "title"), ("c_nationkey", "location"))])


@query("weak_casts", r"SELECT p_partkey, coalesce(try_cast(regexp_extract(s, '^\s*([+-]?\d+)', 1) AS INT), 0) AS n FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_partkey || 'abc' WHEN 2 THEN ' -' || p_size || '.9' ELSE '' END AS s FROM part)")
def weak_casts(spark, d):
    k = F.col("p_size") % 4
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.col("p_partkey").cast("string"), F.lit("abc"))).when(k == 2, F.concat(F.lit(" -"), F.col("p_size").cast("string"), F.lit(".9"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", text.weak_int(raw).alias("n"))


_HEADS = """CASE p_size % 5 WHEN 0 THEN 'Episode #' || p_partkey || ' - ' || p_name WHEN 1 THEN 'Episode #' || p_partkey WHEN 2 THEN ' Episode #' || p_partkey || '  -  ' || upper(p_name) || '! ' WHEN 3 THEN 'Part ' || p_name || ' - ' || p_brand ELSE '' END"""


@query("title_keys", rf"""SELECT p_partkey, regexp_replace(lower(CASE WHEN d <> '' THEN d ELSE t END), '[^\pL\pN]+', '', 'g') AS key FROM (SELECT p_partkey, t, trim(regexp_extract(trim(t), '^Episode\s*#\d+\s*-\s*(.+)$', 1)) AS d FROM (SELECT p_partkey, {_HEADS} AS t FROM part))""")
def title_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_key(F.expr(_HEADS)).alias("key"))


@query("name_splits", r"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(p_name, ' ', CASE p_size % 4 WHEN 0 THEN ', ' WHEN 1 THEN ' & ' WHEN 2 THEN ' and ' ELSE ' · ' END), '-', ' '), '\s*(?:[,&·\n]|\band\b)\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM part""")
def name_splits(spark, d):
    k = F.col("p_size") % 4
    by = F.when(k == 0, ", ").when(k == 1, " & ").when(k == 2, " and ").otherwise(" · ")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.listed(F.replace(F.replace("p_name", F.lit(" "), by), F.lit("-"), F.lit(" "))), "|").alias("names"))


@query("unglued", r"""SELECT p_partkey, CASE WHEN length(g) > 22 AND len(regexp_extract_all(g, '[a-z][A-Z]')) >= 2 THEN regexp_replace(regexp_replace(g, '([a-z])([A-Z])', '\1|\2', 'g'), '([a-z])([A-Z])', '\1|\2', 'g') ELSE g END AS names
FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS g FROM part)""")
def unglued(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.unglued(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))), "|").alias("names"))


@query("json_lists", """SELECT o_orderkey AS k, max(l_partkey) FILTER (l_linenumber = 2) AS second, max(l_linenumber) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def json_lists(spark, d):
    """Order lines as a JSON list per order, read back: the entry with a given number, and the last."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part")))).alias("body"))
    read = lines.select(F.col("l_orderkey").alias("k"), F.from_json("body", "array<struct<number: int, part: long>>").alias("list"))
    of = lambda n: F.array_max(F.transform(F.filter("list", lambda x: x["number"] == n), lambda x: x["part"]))
    return read.select("k", of(2).alias("second"), F.array_max(F.transform("list", lambda x: x["number"])).alias("last"))


@query("merged_maps", "SELECT c_custkey, 'b:' || c_nationkey || ',c:3,a:1' AS settings FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'a:1,b:2,c:3' FROM customer WHERE c_custkey % 2 = 1".replace("'b:' || c_nationkey || ',c:3,a:1'", "'a:1,b:' || c_nationkey || ',c:3'"))
def merged_maps(spark, d):
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    own = F.create_map(F.lit("c"), F.lit("3"), F.lit("b"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")))
    merged = text.merged(base, own)
    said = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return table(spark, d, "customer").select("c_custkey", F.array_join(said, ",").alias("settings"))
