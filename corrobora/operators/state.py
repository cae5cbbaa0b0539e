"""Operational state: queues, cool-downs, health ladders, priorities, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim_next(queue: DataFrame, run: str) -> DataFrame:
    """Per run the queued row of the lowest position, marked as being worked on, its attempts raised by one."""
    queued = queue.where("state = 'queued'")
    first = queued.groupBy(run).agg(F.min_by(F.struct(*[c for c in queue.columns if c != run]), F.struct("position", "item")).alias("q"))
    return first.select(run, "q.*").withColumn("state", F.lit("researching")).withColumn("attempts", F.col("attempts") + 1)


def run_status(done: Column, failed: Column, open_: Column) -> Column:
    return (
        F.when(open_ > 0, "running")
        .when((done == 0) & (failed > 0), "failed")
        .when(failed > 0, "completed_with_warnings")
        .otherwise("completed")
    )


def eligible(last: Column, status: Column, changed: Column, next_at: Column, now: Column) -> Column:
    """Never seen: yes; under review: no; sources changed: yes; else once its rest is over."""
    return (
        F.when(last.isNull(), True).when(status == "review", False).when(changed, True)
        .otherwise(next_at.isNull() | (next_at <= now))
    )


def health(outcome: Column, streak: Column, warnings: Column, successes: Column) -> Column:
    """A source's status: the first rule that holds."""
    return (
        F.when(outcome == "offline", "unknown")
        .when(outcome == "robots", "robots_denied")
        .when(outcome.isin("blocked", "proxy"), "blocked")
        .when(outcome == "rate_limited", "rate_limited")
        .when(streak >= 3, "down")
        .when((warnings >= 3) & (successes > 0) & (streak == 0), "parser_warning")
        .when(streak > 0, "degraded")
        .when(successes > 0, "ok")
        .otherwise("unknown")
    )


def rest_seconds(status: Column) -> Column:
    return F.when(status.isin("blocked", "robots_denied"), 3600).when(status == "rate_limited", 900).when(status == "down", 600).otherwise(0)


def recency_list(visits: DataFrame, user: str, item: str, at: list[str], cap: int = 12) -> DataFrame:
    """(user, item, place): each user's latest distinct items, newest first, up to ``cap``."""
    latest = visits.groupBy(user, item).agg(F.max(F.struct(*at)).alias("__at"))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("__at"), item))
    return latest.withColumn("place", place).where(F.col("place") <= cap).select(user, item, "place")


def stalled(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, last, silent): keys whose last beat is over ``seconds`` before the newest beat of all."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    newest = last.agg(F.max("last").alias("now"))
    gap = F.expr("timestampdiff(SECOND, last, now)")
    # Compared as moments: silent is cut to whole seconds.
    over = F.expr(f"timestampadd(SECOND, {seconds}, last) < now")
    return last.join(F.broadcast(newest)).withColumn("silent", gap).where(over).drop("now")  # one row


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, started, beats): bursts of beats no more than ``gap`` apart."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("beats")).select(key, F.col("w.start").alias("started"), "beats")
