"""Runs that stream, resume and commit: the event log as the stream, orders as what is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.operators import commits
from corrobora.plans.base import table, tables
from corrobora.plans.registry import query
from corrobora.sources.shared import shared_folder, written
from corrobora.streaming import health, resume, runs


@query("resumed_run", """SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'done' END AS outcome FROM events""")
def resumed_run(spark, d):
    """Every event once, though the run stops after a batch is written and before that is known."""
    root = shared_folder(spark, "resumed")
    stream = health.read_events(spark, f"{d}/events.parque[t]")  # a pattern, as the table may be one file

    def work(batch):
        return batch.select("event_id", "user_id", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("outcome"))

    resume.resumable(stream, work, f"{root}/out", f"{root}/checkpoint")
    resume.resumable(stream, work, f"{root}/out", f"{root}/checkpoint")  # finds nothing left
    return resume.done(spark, f"{root}/out", "event_id long, user_id long, outcome string").drop("batch")


@query("remaining_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def remaining_work(spark, d):
    orders, lineitem = tables(spark, d, "orders lineitem")
    finished = lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume.remaining(orders.select("o_orderkey"), finished, "o_orderkey")


_RUNS = """WITH r AS (SELECT o_custkey, min(o_orderdate) AS started, count(*) FILTER (o_orderstatus = 'O') AS todo, count(*) FILTER (o_orderstatus = 'P') AS paused FROM orders GROUP BY 1)
SELECT o_custkey, todo FROM r WHERE paused < 3 AND todo > 0 AND started < TIMESTAMP '1995-06-01 00:00:00' - INTERVAL 30 MINUTE"""


@query("interrupted_runs", _RUNS)
def interrupted_runs(spark, d):
    runs = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("started_at"), F.count_if(F.col("o_orderstatus") == "O").alias("left"),
        F.when(F.count_if(F.col("o_orderstatus") == "P") < 3, "running").otherwise("paused").alias("status"))
    found = resume.interrupted(runs, F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"))
    return found.select("o_custkey", F.col("left").alias("todo"))


_CREATED = """WITH w AS (SELECT l_orderkey AS number, max(l_linenumber) AS year, list_distinct(list('Clerk ' || l_suppkey % 40)) AS guests FROM lineitem GROUP BY 1),
old AS (SELECT o_orderkey AS number, (o_orderkey % 7)::INT AS year FROM orders WHERE o_orderkey % 3 = 0),
i AS (SELECT number, year FROM old UNION ALL SELECT number, year FROM w WHERE number NOT IN (SELECT number FROM old)),
f AS (SELECT * FROM w WHERE number NOT IN (SELECT number FROM old)),
l AS (SELECT number, unnest(guests) AS name FROM f)
SELECT 'items' AS part, count(*) AS n, sum(year)::BIGINT AS total FROM i UNION ALL SELECT 'images', count(*), sum(number)::BIGINT FROM f UNION ALL SELECT 'guests', count(*), 20 FROM
(SELECT 'Clerk ' || x FROM range(0, 20) t(x) UNION SELECT name FROM l) UNION ALL SELECT 'links', count(*), sum(number)::BIGINT FROM l
UNION ALL SELECT 'years', count(*), sum(c)::BIGINT FROM (SELECT year, CASE WHEN year IN (SELECT year FROM f) THEN count(*) ELSE -1 END AS c FROM i GROUP BY year)"""


@query("manual_create", _CREATED)
def manual_create(spark, d):
    """Five tables in one commit, made twice with the same input: the second finds all there."""
    root = shared_folder(spark, "created")
    orders, lineitem = tables(spark, d, "orders lineitem")
    items = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("number"), F.lit("old").alias("title"), (F.col("o_orderkey") % 7).cast("int").alias("year"))
    clerks = spark.range(20).select((F.col("id") + 1).alias("ident"), F.concat(F.lit("Clerk "), F.col("id").cast("string")).alias("name"))
    start = {
        "items": items,
        "images": spark.createDataFrame([], "number long, placeholder boolean"),
        "guests": clerks,
        "links": spark.createDataFrame([], "number long, ident long"),
        "years": items.select("year", F.lit(-1).cast("long").alias("total")).distinct(),
    }
    wanted = lineitem.groupBy(F.col("l_orderkey").alias("number")).agg(
        F.lit("new").alias("title"), F.max("l_linenumber").alias("year"), F.collect_set(F.concat(F.lit("Clerk "), (F.col("l_suppkey") % 40).cast("string"))).alias("guests"))
    wanted = written(wanted)  # each transaction reads it more than once
    commits.commit(spark, root, start, -1)
    for _ in range(2):
        commits.transact(spark, root, lambda now: commits.created(now, wanted))
    _, now = commits.snapshot(spark, root)
    told = lambda name, total: now[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), total.cast("long").alias("total"))
    parts = [told("items", F.sum("year")), told("images", F.sum("number")), told("guests", F.count_if(F.col("ident") <= 20)), told("links", F.sum("number")), told("years", F.sum("total"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_KINDS = "CASE WHEN event_type IN ('view', 'click') THEN 'beat' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'fail' END"
_MACHINE = f"""WITH e AS (SELECT user_id AS run, ts, event_id, {_KINDS} AS kind, (SELECT max(ts) FROM events WHERE event_type <> 'signup') - INTERVAL 10 MINUTE AS horizon FROM events WHERE event_type <> 'signup'),
s AS (SELECT *, CASE kind WHEN 'beat' THEN 'running' WHEN 'done' THEN 'completed' ELSE 'failed' END AS status, ts + INTERVAL 6 HOUR AS quiet, lead(ts) OVER w AS nxt, count(*) FILTER (kind = 'done') OVER w AS finished
FROM e WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
q AS (SELECT *, status = 'running' AND coalesce(nxt, horizon) >= quiet AS silent, (count(*) FILTER (kind = 'fail') OVER (PARTITION BY run, finished ORDER BY ts, event_id))::INT AS attempts FROM s),
b AS (SELECT *, coalesce(lag(CASE WHEN silent THEN 'paused' ELSE status END) OVER (PARTITION BY run ORDER BY ts, event_id), 'created') AS before FROM q)
SELECT run, strftime(t, '%Y-%m-%d %H:%M:%S') AS told_at, before, after, attempts, strftime(next_at, '%Y-%m-%d %H:%M:%S') AS next_at FROM (
SELECT run, ts AS t, before, status AS after, attempts, CASE WHEN kind = 'fail' THEN ts + to_seconds(least(864000, (3600 * least(16, pow(2, greatest(attempts - 1, 0))))::INT)) END AS next_at FROM b WHERE kind = 'fail' OR status <> before
UNION ALL SELECT run, quiet, 'running', 'paused', attempts, NULL FROM b WHERE silent)"""


def _run_events(events):
    kind = F.when(F.col("event_type").isin("view", "click"), "beat").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail")
    return events.select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"))


def _told(found):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("run", text("at").alias("told_at"), "before", "after", "attempts", text("next_at").alias("next_at"))


@query("run_transitions", _MACHINE)
def run_transitions(spark, d):
    events = _run_events(table(spark, d, "events")).where("kind IS NOT NULL")
    newest = events.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("horizon"))
    return _told(runs.transitions(events.join(F.broadcast(newest)), F.col("horizon"), silence=6 * 3600))  # one row


@query("live_runs", _MACHINE)
def live_runs(spark, d):
    """``run_transitions`` by a stream with state and timers."""
    root = shared_folder(spark, "runs")
    with runs.state_store(spark):
        stream = runs.live_transitions(_run_events(health.read_events(spark, f"{d}/events.parque[t]")), silence=6 * 3600)
        health.run_once(stream, f"{root}/out", f"{root}/checkpoint")
    return _told(spark.read.schema(runs.SCHEMA).parquet(f"{root}/out"))
