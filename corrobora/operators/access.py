"""What sources gave and how they were reached: contracts, evidence, access, comparisons, counters, dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.sources.documents import mentions


def contracted(results: DataFrame, title: str = "title") -> DataFrame:
    """``results`` (number, status, fields: map) as an adapter must hand them on.

    Fields without a value are dropped, the title also where it does not name the number; a
    result that is ok and has no field left is a parser warning. ``given`` counts the fields.
    """
    filled = F.map_filter("fields", lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    named = F.map_filter(filled, lambda k, v: (k != title) | mentions(v, F.col("number")))
    kept = results.withColumn("fields", F.coalesce(named, F.create_map().cast("map<string,string>")))
    status = F.when((F.col("status") == "ok") & (F.size("fields") == 0), "parser_warning").otherwise(F.col("status"))
    return kept.withColumns({"status": status, "given": F.size("fields")})


def corroborated_evidence(reports: DataFrame, authority: Column, witness: Column, ladder) -> DataFrame:
    """(entity, source, field, value, others, confidence, status) for what ``reports`` (entity, source, field, value) say.

    ``authority`` and ``witness`` are conditions on source and field: whether the source leads
    for the field, and whether it is known for it at all. ``ladder`` turns (authority, witness,
    others) into a confidence. A value that others give is usable; one that stands alone is
    corroborating where the source agrees with others on another field of the entity, else weak.
    """
    once = reports.select("entity", "source", "field", "value").distinct()
    others = F.count("*").over(Window.partitionBy("entity", "field", "value")) - 1
    seen = once.withColumn("others", others)
    agrees = F.max("others").over(Window.partitionBy("entity", "source")) > 0
    status = F.when(F.col("others") > 0, "usable").when(F.col("agrees"), "corroborating").otherwise("weak")
    told = seen.withColumn("agrees", agrees).withColumns({"status": status, "confidence": ladder(authority, witness, F.col("others"))})
    return told.select("entity", "source", "field", "value", "others", "confidence", "status")


def access_class(robots: Column, request: Column, failure: Column, http: Column, error: Column) -> Column:
    """What happened to a source's request: robots' rules, not tried, reached (usable, empty, unparsed) or how it failed."""
    timed_out = F.lower(F.coalesce(error, F.lit(""))).rlike("timeout|timed out")
    return (
        F.when(robots == "ROBOTS_DISALLOWED", "ROBOTS_DISALLOWED")
        .when(request == "not_attempted", "NOT_ATTEMPTED")
        .when((request == "ok") & (failure == "SOURCE_EMPTY"), "SOURCE_EMPTY")
        .when((request == "ok") & (failure == "PARSER_FAILURE"), "PARSER_FAILURE")
        .when(request == "ok", "SUCCESSFUL_ACCESS")
        .when(timed_out, "TARGET_TIMEOUT")
        .when(http.isNotNull(), "TARGET_HTTP_FAILURE")
        .otherwise("TARGET_NETWORK_FAILURE")
    )


def stale_note(robots: Column, found: Column) -> Column:
    """Whether a success must be told with the note that robots' rules could not be read."""
    return F.coalesce((robots == "ROBOTS_FETCH_FAILED") & (found == "SUCCESSFUL_ACCESS"), F.lit(False))


def compared(results: DataFrame) -> DataFrame:
    """(implementation, attempted, usable, fields, blocking): reports of several implementations side by side.

    ``results``: implementation, source, usable, field, failure. Fields and failures are names
    from fixed vocabularies, so their sets are small.
    """
    return results.groupBy("implementation").agg(
        F.countDistinct("source").alias("attempted"),
        F.countDistinct(F.when(F.col("usable"), F.col("source"))).alias("usable"),
        F.array_sort(F.collect_set("field")).alias("fields"),
        F.array_sort(F.collect_set(F.when(~F.col("usable"), F.concat_ws(": ", "source", "failure")))).alias("blocking"),
    )


def bumped(rows: DataFrame, bumps: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """``rows`` with counters raised by ``bumps`` (key, counter, n); counters that are not ``allowed`` stay out."""
    sums = bumps.where(F.col("counter").isin(*allowed)).groupBy(key).pivot("counter", list(allowed)).agg(F.sum("n"))
    added = sums.select(key, *[F.col(c).alias(f"__{c}") for c in allowed])
    raised = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in allowed}
    return rows.join(added, key, "left").withColumns(raised).select(*rows.columns)


def endpoint_index(payloads: DataFrame, key: str, json: str, number: Column) -> DataFrame:
    """(key, number, name, airdate): the numbers that an endpoint's episodes name, the last of each winning.

    ``number`` reads it from a column ``name``. Episodes without a number are left out.
    """
    shape = "struct<_embedded: struct<episodes: array<struct<name: string, airdate: string>>>>"
    rows = payloads.select(key, F.posexplode(F.from_json(json, shape)["_embedded"]["episodes"]).alias("pos", "e")).select(key, "pos", "e.*")
    numbered = rows.withColumn("number", number).where("number IS NOT NULL")
    last = numbered.groupBy(key, "number").agg(F.max_by(F.struct("name", "airdate"), "pos").alias("e"))
    return last.select(key, "number", F.col("e.name").alias("name"), F.col("e.airdate").alias("airdate"))


def dry_run(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(part, added, removed): what writing ``after`` would change in each table, without writing: the same plans, no sink.

    Rows count as often as they stand. Columns are those of the table as it is.
    """
    out = None
    for name, new in after.items():
        old = before[name]
        side = lambda df, n: df.select(*old.columns, F.lit(n).alias("__n"))  # noqa: B023, E731
        net = side(new, 1).unionByName(side(old, -1)).groupBy(*old.columns).agg(F.sum("__n").alias("n"))
        told = net.agg(
            F.lit(name).alias("part"),
            F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("added"),
            F.coalesce(-F.sum(F.when(F.col("n") < 0, F.col("n"))), F.lit(0)).alias("removed"),
        )
        out = told if out is None else out.unionByName(told)
    return out
