"""Queues, cool-downs, health and routing over the event log (users as sources, errors as failures)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corrobora.functions import scores
from corrobora.operators import quality
from corrobora.operators import state as ops
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query

_NOW = "2024-01-31 00:00:00"
_QUEUE = "q AS (SELECT event_id AS item, user_id AS run, (event_id % 17)::INT AS position, CASE event_type WHEN 'view' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'done' END AS state, (event_id % 3)::INT AS attempts FROM events)"


def _queue(spark, d):
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "error", "failed").otherwise("done")
    return table(spark, d, "events").select(
        F.col("event_id").alias("item"), F.col("user_id").alias("run"), (F.col("event_id") % 17).cast("int").alias("position"),
        state.alias("state"), (F.col("event_id") % 3).cast("int").alias("attempts"))


@query("queue_claim", f"WITH {_QUEUE} SELECT run, item, position, 'researching' AS state, attempts + 1 AS attempts FROM q WHERE state = 'queued' QUALIFY row_number() OVER (PARTITION BY run ORDER BY position, item) = 1")
def queue_claim(spark, d):
    return ops.claim_next(_queue(spark, d), "run")


@query("queue_positions", f"WITH {_QUEUE} SELECT item, row_number() OVER (PARTITION BY run ORDER BY attempts, item) - 1 AS place FROM q WHERE state = 'queued'")
def queue_positions(spark, d):
    place = F.row_number().over(Window.partitionBy("run").orderBy("attempts", "item")) - 1
    return _queue(spark, d).where("state = 'queued'").select("item", place.alias("place"))


@query("run_states", f"""WITH {_QUEUE} SELECT run, CASE WHEN count(*) FILTER (state = 'queued') > 20 THEN 'running' WHEN count(*) FILTER (state = 'done') = 0 AND count(*) FILTER (state = 'failed') > 0 THEN 'failed'
WHEN count(*) FILTER (state = 'failed') > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, round(100.0 * count(*) FILTER (state <> 'queued') / count(*))::BIGINT AS pct FROM q GROUP BY 1""")
def run_states(spark, d):
    n = _queue(spark, d).groupBy("run").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "done", "failed")], F.count("*").alias("n"))
    status = ops.run_status(F.col("done"), F.col("failed"), F.greatest(F.col("queued") - 20, F.lit(0)))
    return n.select("run", status.alias("status"), F.round(100.0 * (F.col("n") - F.col("queued")) / F.col("n")).cast("long").alias("pct"))


@query("cooldown_eligible", f"""WITH s AS (SELECT user_id, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1)
SELECT user_id, attempts, CASE WHEN status = 'purchase' THEN false WHEN user_id % 10 = 0 THEN true ELSE last + to_seconds(least(864000, (3600 * least(16, pow(2, greatest(attempts - 1, 0))))::INT)) <= TIMESTAMP '{_NOW}' END AS eligible FROM s""")
def cooldown_eligible(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(
        F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    rest = scores.backoff(F.col("attempts"), 3600, 864000)
    next_at = F.col("last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rest)
    status = F.when(F.col("status") == "purchase", "review").otherwise("done")
    return s.select("user_id", "attempts", ops.eligible(F.col("last"), status, F.col("user_id") % 10 == 0, next_at, F.lit(_NOW).cast("timestamp_ntz")).alias("eligible"))


@query("health_ladder", """WITH m AS (SELECT user_id, event_type = 'error' AS f, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, island, count(*) FILTER (f) AS run FROM m GROUP BY 1, 2), k AS (SELECT user_id, arg_max(run, island) AS streak FROM r GROUP BY 1),
e AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'signup') AS warned, CASE user_id % 11 WHEN 0 THEN 'offline' WHEN 1 THEN 'robots' WHEN 2 THEN 'blocked' WHEN 3 THEN 'rate_limited' ELSE 'fine' END AS o FROM events GROUP BY 1),
h AS (SELECT user_id, CASE WHEN o = 'offline' THEN 'unknown' WHEN o = 'robots' THEN 'robots_denied' WHEN o = 'blocked' THEN 'blocked' WHEN o = 'rate_limited' THEN 'rate_limited' WHEN streak >= 3 THEN 'down' WHEN warned >= 3 AND ok > 0 AND streak = 0 THEN 'parser_warning'
WHEN streak > 0 THEN 'degraded' WHEN ok > 0 THEN 'ok' ELSE 'unknown' END AS status FROM e JOIN k USING (user_id))
SELECT user_id, status, CASE WHEN status IN ('blocked', 'robots_denied') THEN 3600 WHEN status = 'rate_limited' THEN 900 WHEN status = 'down' THEN 600 ELSE 0 END AS rest FROM h""")
def health_ladder(spark, d):
    events = table(spark, d, "events")
    streak = quality.streaks(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    names = ("offline", "robots", "blocked", "rate_limited")
    k = (F.col("user_id") % 11).cast("int")
    outcome = F.when(k < 4, F.try_element_at(F.array(*map(F.lit, names)), k + 1)).otherwise("fine")
    n = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") == "signup").alias("warned"))
    h = n.join(streak, "user_id").select("user_id", ops.health(outcome, F.col("current_streak"), F.col("warned"), F.col("ok")).alias("status"))
    return h.withColumn("rest", ops.rest_seconds(F.col("status")))


@query("attention_buckets", """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, max(ts) AS last, sum(value) AS v FROM events GROUP BY 1)
SELECT CASE WHEN e > 15 THEN 'failing' WHEN v < 2500 THEN 'thin' WHEN last < TIMESTAMP '2024-01-30' THEN 'stale' ELSE 'fine' END AS bucket, count(*) AS n, min(user_id) AS example FROM u GROUP BY 1""")
def attention_buckets(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.max("ts").alias("last"), F.sum("value").alias("v"))
    bucket = F.when(F.col("e") > 15, "failing").when(F.col("v") < 2500, "thin").when(F.col("last") < F.lit("2024-01-30").cast("timestamp_ntz"), "stale").otherwise("fine")
    return u.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("user_id").alias("example"))


@query("priority_queue", """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT user_id, CASE WHEN p = 0 THEN 1 WHEN e > 20 THEN 2 WHEN e > 10 THEN 4 ELSE 8 END AS priority, concat_ws(',', CASE WHEN p = 0 THEN 'empty' END, CASE WHEN e > 10 THEN 'errors' END, CASE WHEN user_id % 2 = 0 THEN 'even' END) AS reasons
FROM u ORDER BY priority, user_id DESC LIMIT 50""")
def priority_queue(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    band = F.when(F.col("p") == 0, 1).when(F.col("e") > 20, 2).when(F.col("e") > 10, 4).otherwise(8)
    why = F.array_compact(F.array(F.when(F.col("p") == 0, "empty"), F.when(F.col("e") > 10, "errors"), F.when(F.col("user_id") % 2 == 0, "even")))
    return u.select("user_id", band.alias("priority"), F.array_join(why, ",").alias("reasons")).orderBy("priority", F.desc("user_id")).limit(50)


@query("coverage_label", """WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM k)
SELECT min(k) AS first_key, max(k) AS last_key, count(*) AS n FROM g GROUP BY island""")
def coverage_label(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    starts = keys.join(keys.select((F.col("k") + 1).alias("k")), "k", "left_anti").select(F.col("k").alias("s"))
    ends = keys.join(keys.select((F.col("k") - 1).alias("k")), "k", "left_anti").select(F.col("k").alias("e"))
    # The n-th start belongs to the n-th end.
    paired = quality.numbered(starts, "s", "i").join(quality.numbered(ends, "e", "i"), "i")
    return paired.select(F.col("s").alias("first_key"), F.col("e").alias("last_key"), (F.col("e") - F.col("s") + 1).alias("n"))


@query("recency_list", "WITH v AS (SELECT user_id, event_type, max(ts) AS t, max(event_id) AS i FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_type) AS place FROM v QUALIFY place <= 3")
def recency_list(spark, d):
    return ops.recency_list(table(spark, d, "events"), "user_id", "event_type", ["ts"], 3)


@query("stalled_runs", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, date_sub('second', last, (SELECT max(last) FROM l)) AS silent FROM l WHERE last + INTERVAL 6 HOUR < (SELECT max(last) FROM l)")
def stalled_runs(spark, d):
    return ops.stalled(table(spark, d, "events"), "user_id", "ts", 6 * 3600).select("user_id", "silent")


@query("heartbeat_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 4 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS beats FROM s GROUP BY user_id, n""")
def heartbeat_sessions(spark, d):
    found = ops.sessions(table(spark, d, "events"), "user_id", "ts", "4 hours")
    return found.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("cache_ttl", "SELECT CASE WHEN o_orderkey > 14990 THEN 3600 WHEN o_orderkey < 700 THEN 2592000 ELSE 86400 END AS ttl, count(*) AS n FROM orders GROUP BY 1")
def cache_ttl(spark, d):
    k = F.col("o_orderkey")
    ttl = F.when(k > 14990, 3600).when(k < 700, 2592000).otherwise(86400)
    return table(spark, d, "orders").groupBy(ttl.alias("ttl")).agg(F.count("*").alias("n"))


@query("classify_outcome", """WITH r AS (SELECT user_id, ts::DATE::VARCHAR AS day, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN e = n THEN 'all_failed' WHEN p = 0 AND e > 0 THEN 'partial' WHEN p = 0 THEN 'no_data' ELSE 'ok' END AS outcome FROM r""")
def classify_outcome(spark, d):
    r = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p"), F.count("*").alias("n"))
    kind = F.when(F.col("e") == F.col("n"), "all_failed").when((F.col("p") == 0) & (F.col("e") > 0), "partial").when(F.col("p") == 0, "no_data").otherwise("ok")
    return r.select("user_id", "day", kind.alias("outcome"))


@query("latest_state", """WITH s AS (SELECT c_nationkey, max(o_orderkey) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') AS aired, max(o_orderkey) AS any_, count(DISTINCT o_orderstatus) AS sources FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_nationkey, aired, CASE WHEN any_ > aired THEN any_ END AS upcoming, CASE WHEN sources < 2 THEN 'insufficient' WHEN any_ - aired > 3 THEN 'conflict' ELSE 'confirmed' END AS state FROM s""")
def latest_state(spark, d):
    orders, customer = tables(spark, d, "orders customer")
    past = F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz")
    s = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.max(F.when(past, F.col("o_orderkey"))).alias("aired"), F.max("o_orderkey").alias("latest"), F.countDistinct("o_orderstatus").alias("sources"))
    state = F.when(F.col("sources") < 2, "insufficient").when(F.col("latest") - F.col("aired") > 3, "conflict").otherwise("confirmed")
    return s.select("c_nationkey", "aired", F.when(F.col("latest") > F.col("aired"), F.col("latest")).alias("upcoming"), state.alias("state"))


@query("route_sources", "SELECT l_suppkey, min(l_linenumber) AS best_rank, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def route_sources(spark, d):
    wanted = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return wanted.groupBy("l_suppkey").agg(F.min("l_linenumber").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("fields"))


@query("recheck_targets", "SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_partkey = p_partkey WHERE last IS NULL OR last < TIMESTAMP '2001-01-01' OR p_size = 1")
def recheck_targets(spark, d):
    part, lineitem = tables(spark, d, "part lineitem")
    last = lineitem.where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("last"))
    stale = F.col("last").isNull() | (F.col("last") < F.lit("2001-01-01").cast("timestamp_ntz")) | (F.col("p_size") == 1)
    return part.join(last, "p_partkey", "left").where(stale).select("p_partkey")


@query("signature", "SELECT sha1(string_agg(x, '|' ORDER BY x)) AS signature FROM (SELECT s_name || ':' || s_nationkey AS x FROM supplier WHERE s_acctbal > 0)")
def signature(spark, d):
    x = F.concat_ws(":", "s_name", F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").where("s_acctbal > 0").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(x)), "|").cast("binary")).alias("signature"))


@query("reputation_profile", """WITH o AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value >= 50) AS a FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(100.0::DOUBLE * a / n)::INT AS reliability, row_number() OVER (PARTITION BY event_type ORDER BY 100.0::DOUBLE * a / n DESC, user_id) AS place, count(*) OVER (PARTITION BY event_type) AS of FROM o""")
def reputation_profile(spark, d):
    o = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("a"))
    rate = 100.0 * F.col("a") / F.col("n")
    # Rates are ranked within whole percents; what stands before comes from counts.
    o = o.withColumn("percent", F.floor(rate))
    counts = o.groupBy("event_type", "percent").agg(F.count("*").alias("c"))
    field = Window.partitionBy("event_type")
    above = field.orderBy(F.desc("percent")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("event_type", "percent", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("skip"), F.sum("c").over(field).alias("of"))
    inner = F.row_number().over(Window.partitionBy("event_type", "percent").orderBy(F.desc(rate), "user_id"))
    placed = o.withColumn("inner", inner).join(F.broadcast(offsets), ["event_type", "percent"])  # 101 rows for an event type
    return placed.select("user_id", "event_type", F.round(rate).cast("int").alias("reliability"), (F.col("inner") + F.col("skip")).alias("place"), "of")
