"""Targets, issues, health domains and state views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from worst to least, and what a domain of that worst severity is called.
SEVERITIES = {"CRITICAL": 4, "ERROR": 3, "WARNING": 2, "INFO": 1}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), severity), F.lit(0))


def domain_status(issues: DataFrame) -> DataFrame:
    """(domain, status, issues, rows) per domain of issues (domain, severity, n): the worst severity found, GOOD if none."""
    found = F.when(F.col("n") > 0, severity_rank(F.col("severity"))).otherwise(0)
    worst = F.max(found)
    status = F.when(worst == 4, "CRITICAL").when(worst == 3, "ERROR").when(worst == 2, "WARNING").when(worst == 1, "INFO").otherwise("GOOD")
    return issues.groupBy("domain").agg(status.alias("status"), F.count_if(F.col("n") > 0).alias("issues"), F.sum("n").alias("rows"))


def filter_issues(issues: DataFrame, **wanted: str | list[str] | None) -> DataFrame:
    """The issues whose columns have the wanted values; a filter that is None or empty does not count."""
    for column, values in wanted.items():
        values = [values] if isinstance(values, str) else values
        if values:
            issues = issues.where(F.col(column).isin(*values))
    return issues


def counted_rules(rows: DataFrame, domain: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Issues (domain, issue, severity, n): how many rows break each rule, in one pass. rules: issue -> (severity, condition)."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, (_, c) in rules.items()])
    listed = F.array(*[F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"), F.col(k).alias("n")) for k, (s, _) in rules.items()])
    return counts.select(F.explode(listed).alias("x")).select(F.lit(domain).alias("domain"), "x.*")


def image_state(recorded: Column, stored: Column, valid: Column, copy_of: Column, shared: Column, near: Column) -> Column:
    """MISSING, BROKEN, INVALID, DUPLICATE, SUSPECT_DUPLICATE or VALID; an image that is legitimately shared is no duplicate."""
    return (
        F.when(~recorded, "MISSING")
        .when(~stored, "BROKEN")
        .when(~valid, "INVALID")
        .when(copy_of.isNotNull() & ~shared, "DUPLICATE")
        .when(F.coalesce(near, F.lit(False)), "SUSPECT_DUPLICATE")
        .otherwise("VALID")
    )


def targets(mode: str, state: DataFrame, *, single: int = 0, low: int = 1, high: int | None = None, limit: int = 200) -> DataFrame:
    """(number, mode) of the rows of ``state`` that a mode selects, the smallest ``limit``.

    ``state``: number, missing (fields), failed, unstable, unverified. Modes: single, range,
    missing, failed, unstable, thumbnails, full.
    """
    n = F.col("number")
    rule = {
        "single": n == single,
        "range": n.between(low, high if high is not None else low),
        "missing": F.size("missing") > 0,
        "failed": F.col("failed"),
        "unstable": F.col("unstable"),
        "thumbnails": F.col("unverified"),
    }.get(mode, n >= low)
    return state.where(rule).select("number", F.lit(mode).alias("mode")).orderBy("number").limit(limit)


def latest_targets(state: DataFrame, latest: int, most_new: int, tail: int) -> DataFrame:
    """(number, mode): numbers after the largest stored up to ``latest``, at most ``most_new``, and the last ``tail`` incomplete ones."""
    top = state.agg(F.max("number").alias("top"))
    new = top.where(F.col("top") < latest).select(F.explode(F.sequence(F.col("top") + 1, F.least(F.lit(latest), F.col("top") + most_new))).alias("number"))
    old = state.where(F.size("missing") > 0).select("number").orderBy(F.desc("number")).limit(tail)
    return new.unionByName(old).distinct().select("number", F.lit("latest").alias("mode"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def error_class(status: Column) -> Column:
    """The class of an HTTP status."""
    return (
        F.when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403), "blocked")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "http_5xx")
        .when(status >= 400, "http_4xx")
        .otherwise("other")
    )


def transport_class(code: Column, message: Column) -> Column:
    """The class of a transfer error by its code; a proxy's refusal is told by the message."""
    proxy = F.lower(message).rlike("connect tunnel failed|proxy connect|received http code 403 from proxy")
    return (
        F.when(proxy | code.isin(5, 97), "proxy")
        .when(code == 6, "dns")
        .when(code.isin(7, 56), "connect")
        .when(code == 28, "timeout")
        .when(code.isin(35, 58, 59, 83, 51, 60), "tls")
        .when(code == 47, "redirect")
        .otherwise("other")
    )
