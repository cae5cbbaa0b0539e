"""Evidence resolution: candidates, independence, scores, decisions, diffs.

Evidence is long: (entity, field, source, value, tier, rank, family, verify_only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions import scores, text


def independence(df: DataFrame, copyable: Column, length: Column, value_hash: Column) -> DataFrame:
    """``df`` with ``witness``: equal long copyable texts are one witness, else a source's family, else the source."""
    copied = F.concat(F.lit("copy:"), F.substring(value_hash, 1, 10))
    return df.withColumn("witness", F.when(copyable & (length >= 40), copied).otherwise(F.coalesce("family", "source")))


def candidates(df: DataFrame) -> DataFrame:
    """One row per (entity, field, value): sources, witnesses, their corroborated confidence, best reliability."""
    by_source = df.groupBy("entity", "field", "value", "witness", "source").agg(F.max("reliability").alias("r"), F.bool_and("verify_only").alias("v"))
    # A field has few sources: the register's. Windows sort the claims once; an aggregate that collects would sort them on both of its sides.
    of = Window.partitionBy("entity", "field", "value")
    claims = by_source.withColumn("turn", F.row_number().over(of.orderBy("witness", "source"))).select(
        "entity", "field", "value", "turn", F.collect_list(F.struct("witness", "source", "r")).over(of).alias("claims"),
        F.max("r").over(of).alias("reliability"), F.bool_and("v").over(of).alias("verify_only"),
    ).where("turn = 1")
    strongest = lambda w: F.array_max(F.transform(F.filter("claims", lambda c: c["witness"] == w), lambda c: c["r"]))
    witnesses = claims.withColumn("heard", F.transform(F.array_distinct(F.transform("claims", lambda c: c["witness"])), strongest))
    return witnesses.select(
        "entity", "field", "value",
        F.size("heard").alias("independent"),
        "reliability",
        scores.corroborated(F.col("heard")).alias("confidence"),
        F.array_sort(F.array_distinct(F.transform("claims", lambda c: c["source"]))).alias("sources"),
        "verify_only",
    )


def ranked(found: DataFrame) -> DataFrame:
    """Candidates with ``place`` 1 for the best of each (entity, field) and that one's witnesses as ``lead``.

    Usable candidates come before verification-only ones, then by witnesses and corroborated confidence.
    """
    order = [F.col("verify_only"), F.desc("independent"), F.desc("confidence"), F.col("value")]
    best = Window.partitionBy("entity", "field").orderBy(*order)
    return found.withColumn("place", F.row_number().over(best)).withColumn("lead", F.first("independent").over(best))


def contested(top: Column, second: Column) -> Column:
    """Whether a second candidate (structs with independent, confidence) comes close to the first."""
    close = (second["independent"] >= 2) & (top["independent"] <= second["independent"] + 1)
    return F.coalesce(close & (F.abs(top["confidence"] - second["confidence"]) <= 12), F.lit(False))


# How sure a decision must be, by how much a wrong field harms.
THRESHOLDS = {"critical": (90, 85, 70), "important": (82, 75, 60), "secondary": (75, 65, 50)}
OVERWRITE_MARGIN = 8


def threshold(criticality: Column, which: int) -> Column:
    """The bar to update (0), fill (1) or review (2) a field of that criticality."""
    bars = F.when(criticality == "critical", THRESHOLDS["critical"][which])
    bars = bars.when(criticality == "important", THRESHOLDS["important"][which])
    return bars.otherwise(THRESHOLDS["secondary"][which])


def comparable(value: Column) -> Column:
    """A value without case and spacing, so that formatting is not taken for disagreement."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def decide(found: DataFrame, existing: DataFrame, criticality: Column) -> DataFrame:
    """(entity, field, decision, value, confidence, old, old_confidence, independent, sources, dissenting).

    ``found``: candidates. ``existing``: entity, field, old, old_confidence. ``criticality`` is
    a condition on field. The score starts at the best candidate's corroborated confidence,
    less 6 for a lone witness and a share of each rival's. What is kept has the stored value.
    """
    rival = F.when(
        F.col("place") > 1,
        F.round(F.col("confidence") * F.least(F.lit(1.0), F.col("independent") / F.greatest("lead", F.lit(1))) * 0.35),
    )
    # All of a field's candidates lie side by side after ranking: the best one's row takes what the others say.
    of = Window.partitionBy("entity", "field")
    both = ranked(found).select(
        "entity", "field", "place",
        F.struct("value", "independent", "confidence", "verify_only", "sources").alias("top"),
        F.lead(F.struct("independent", "confidence")).over(of.orderBy("place")).alias("second"),
        F.coalesce(F.sum(rival).over(of), F.lit(0.0)).cast("int").alias("loss"),
        # A field has few sources: the register's.
        F.collect_list(F.when(F.col("place") > 1, F.col("sources"))).over(of).alias("others"),
    ).where("place = 1").withColumn("dissenting", F.array_sort(F.array_distinct(F.flatten("others")))).drop("place", "others")
    alone = F.when(F.col("top.independent") <= 1, 6).otherwise(0)
    conf = F.greatest(F.lit(0), F.least(F.lit(99), F.col("top.confidence") - alone - F.col("loss")))
    both = both.withColumn("top_form", normal_value(F.col("field"), F.col("top.value")))
    existing = existing.withColumn("old_form", normal_value(F.col("field"), F.col("old")))
    joined = existing.join(both, ["entity", "field"], "full").withColumn("conf", conf).withColumn("level", criticality)
    joined = joined.withColumn("held", F.coalesce("old_confidence", F.lit(0)))
    empty, bar = F.coalesce(F.col("old"), F.lit("")) == "", lambda which: threshold(F.col("level"), which)
    same = F.col("old_form") == F.col("top_form")
    enough = lambda which: F.col("conf") >= bar(which)
    rule = (
        F.when(F.col("top").isNull(), "UNKNOWN")
        .when(empty & F.col("top.verify_only"), "REVIEW")
        .when(empty & enough(1), "FILL")
        .when(empty & enough(2), "REVIEW")
        .when(empty, "REJECT")
        .when(same, "KEEP")
        .when(contested(F.col("top"), F.col("second")), "REVIEW")
        .when(F.col("top.verify_only"), "REVIEW")
        .when(enough(0) & (F.col("conf") >= F.col("held") + OVERWRITE_MARGIN), "UPDATE")
        .when(enough(2), "REVIEW")
        .otherwise("KEEP")
    )
    out = joined.withColumn("decision", rule).withColumn("same", ~empty & same)
    kept = F.col("decision") == "KEEP"
    return out.select(
        "entity",
        "field",
        "decision",
        F.when(kept, F.col("old")).otherwise(F.col("top.value")).alias("value"),
        F.when(kept & F.col("same"), F.greatest("conf", "held")).when(kept, F.col("held")).otherwise(F.col("conf")).alias("confidence"),
        "old",
        "held",
        F.col("top.independent").alias("independent"),
        F.col("top.sources").alias("sources"),
        "dissenting",
        "level",
    )


def explained(decided: DataFrame) -> DataFrame:
    """``decided`` with ``why``: who supports the value, who does not, the witnesses, what is stored and the bar."""
    n = F.col("independent")
    lines = F.concat(
        F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.concat(s, F.lit(" supports this value"))),
        F.transform(F.coalesce("dissenting", F.array().cast("array<string>")), lambda s: F.concat(s, F.lit(" says otherwise"))),
        F.array_compact(
            F.array(
                F.when(n <= 1, "one independent source").when(n > 1, F.concat(n.cast("string"), F.lit(" independent sources"))),
                F.when(
                    F.coalesce("old", F.lit("")) != "",
                    F.when(F.col("held") > 0, F.concat(F.lit("stored at "), F.col("held").cast("string"))).otherwise("stored without confidence"),
                ),
                F.concat(F.col("level"), F.lit(" field, needs "), threshold(F.col("level"), 0).cast("string")),
            )
        ),
    )
    return decided.withColumn("why", lines)


def apply_decisions(existing: DataFrame, decided: DataFrame, vetoed: DataFrame | None = None) -> DataFrame:
    """(entity, field, old, old_confidence) after the decisions that are safe to write: UPDATE and FILL.

    Fields in ``vetoed`` (entity, field), those that an anomaly touches, stay as they are.
    """
    safe = decided.where(F.col("decision").isin("UPDATE", "FILL")).select("entity", "field", F.col("value").alias("__v"), F.col("confidence").alias("__c"))
    if vetoed is not None:
        safe = safe.join(vetoed.select("entity", "field").distinct(), ["entity", "field"], "left_anti")
    joined = existing.select("entity", "field", "old", "old_confidence").join(safe, ["entity", "field"], "full")
    return joined.select("entity", "field", F.coalesce("__v", "old").alias("old"), F.coalesce("__c", "old_confidence").alias("old_confidence"))


def review_queue(decided: DataFrame, resolved: DataFrame) -> DataFrame:
    """Open reviews (entity, field, value, old, confidence, urgency): those without an answer in ``resolved``."""
    urgency = F.when(F.col("level") == "critical", 1).when(F.col("level") == "important", 2).otherwise(3)
    open_ = decided.where("decision = 'REVIEW'").join(resolved.select("entity", "field").distinct(), ["entity", "field"], "left_anti")
    return open_.select("entity", "field", "value", "old", "confidence", urgency.alias("urgency"))


def resolve_reviews(existing: DataFrame, reviews: DataFrame, answers: DataFrame) -> DataFrame:
    """``existing`` after reviews that ``answers`` (entity, field, accepted, seen) accepts, if the stored value is still what was seen."""
    said = answers.where("accepted").select("entity", "field", F.col("seen").alias("__seen"))
    won = reviews.join(said, ["entity", "field"]).select("entity", "field", "__seen", F.col("value").alias("__v"), F.col("confidence").alias("__c"))
    joined = existing.join(won, ["entity", "field"], "left")
    take = F.col("__v").isNotNull() & F.col("old").eqNullSafe(F.col("__seen"))
    return joined.select(
        "entity", "field", F.when(take, F.col("__v")).otherwise(F.col("old")).alias("old"), F.when(take, F.col("__c")).otherwise(F.col("old_confidence")).alias("old_confidence")
    )


# What an engine's status says about a source.
OUTCOMES = {
    "ok": "FOUND", "empty": "NO_DATA", "missing_episode": "NO_DATA", "not_applicable": "NOT_APPLICABLE", "parser_warning": "PARSER_ERROR",
    "structure_changed": "STRUCTURE_CHANGED", "needs_javascript": "JAVASCRIPT_REQUIRED", "blocked": "ACCESS_RESTRICTED", "rate_limited": "RATE_LIMITED",
    "suppressed": "RATE_LIMITED", "disabled": "NOT_APPLICABLE", "skipped": "NOT_APPLICABLE", "fetch_failed": "TEMPORARY_ERROR", "adapter_error": "PARSER_ERROR",
}


def outcome_word(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair]), status), F.lit("UNAVAILABLE"))


def normal_value(field: Column, value: Column) -> Column:
    """The form in which values of a field are compared: dates as dates, titles without marks, others without case and spacing."""
    titles = F.trim(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}\s]+", " ")))
    dates = F.coalesce(text.parsed_date(value, 1900, 2100).cast("string"), value)
    return F.when(field == "air_date", dates).when(F.startswith(field, F.lit("title")), titles).otherwise(comparable(value))


def flattened(rows: DataFrame, payload: str) -> DataFrame:
    """(..., field, raw) for each value of a payload map that is not empty; fields that begin with '_' are about the payload."""
    keep = F.map_filter(payload, lambda k, v: ~F.startswith(k, F.lit("_")) & (k != "") & (F.coalesce(v, F.lit("")) != ""))
    others = [c for c in rows.columns if c != payload]
    return rows.select(*others, F.explode(keep).alias("field", "raw"))


def collected(offers: DataFrame, verdict: Column, priority: Column) -> DataFrame:
    """(entity, field, first, offers, rejected): the first valid offer by priority, how many there are, and why sources were rejected.

    ``verdict`` is the validator's for field and raw. A source's reasons are few, so they are collected.
    """
    seen = offers.withColumn("v", verdict).withColumn("rank", priority)
    ok = F.col("v.valid")
    return seen.groupBy("entity", "field").agg(
        F.min(F.when(ok, F.struct("rank", F.col("v.value").alias("value"), "source"))).alias("first"),
        F.count_if(ok).alias("offers"),
        F.array_sort(F.collect_set(F.when(~ok, F.concat("source", F.lit(": "), "v.reason")))).alias("rejected"),
    )


def resolve_scalar(df: DataFrame, key: Column) -> DataFrame:
    """(entity, field, value, source, agree, conflicts, confidence): the value of the best-ranked source, its smallest if it gave several.

    Sources agree by equal ``key``, the field's comparison form. Tiers from 2 up are trusted;
    confidence is CONFLICT, HIGH, MEDIUM or LOW by the best and the summed tiers of those
    that agree and of those that do not. Claims are summed once by key, before any is picked.
    """
    by_key = df.withColumn("k", key).groupBy("entity", "field", "k").agg(
        F.min(F.struct("rank", "source", "value")).alias("first"),
        F.count("*").alias("n"),
        F.sum("tier").alias("weight"),
        F.max("tier").alias("best"),
    )
    part = F.struct("first", "n", "weight", "best")
    sums = by_key.groupBy("entity", "field").agg(
        F.min(part).alias("w"), F.count("*").alias("keys"),
        F.count_if(F.col("best") >= 2).alias("trusted"),
    )
    strong = F.col("w.best") >= 2
    others = F.col("trusted") - strong.cast("int") > 0
    confidence = (
        F.when(others & strong, "CONFLICT")
        .when((F.col("w.n") >= 2) & (F.col("w.weight") >= 4), "HIGH")
        .when((F.col("w.n") >= 2) | strong, "MEDIUM")
        .otherwise("LOW")
    )
    return sums.select(
        "entity", "field", F.col("w.first.value").alias("value"), F.col("w.first.source").alias("source"), F.col("w.n").alias("agree"),
        (F.col("keys") - 1).alias("conflicts"), confidence.alias("confidence"),
    )


def resolve_union(df: DataFrame, key: Column, score: Column) -> DataFrame:
    """(entity, items): the union of list items by identity key, each in its best spelling, with its number of sources."""
    keyed = df.withColumn("k", key).where("k IS NOT NULL").withColumn("score", score)
    items = keyed.groupBy("entity", "k").agg(
        F.max_by("item", F.struct("score", "item")).alias("item"), F.countDistinct("source").alias("sources")
    )
    return items.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("item", "sources"))).alias("items"))


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change, old_value, new_value): ADDED, CHANGED, UNCHANGED or REJECTED; an empty value never replaces one.

    Guards: text that shrinks below half, or to a prefix of what it was, is rejected.
    """
    joined = old.withColumnRenamed("value", "old_value").join(new.withColumnRenamed("value", "new_value"), key, "full")
    has_old, has_new = F.coalesce("old_value", F.lit("")) != "", F.coalesce("new_value", F.lit("")) != ""
    shrunk = (F.length("new_value") * 2 < F.length("old_value")) & (F.length("old_value") > 40)
    prefix = F.startswith("old_value", "new_value") & (F.length("new_value") < F.length("old_value"))
    change = (
        F.when(~has_new & ~has_old, "UNCHANGED")
        .when(~has_new, "REJECTED")
        .when(~has_old, "ADDED")
        .when(F.col("old_value") == F.col("new_value"), "UNCHANGED")
        .when(shrunk | prefix, "REJECTED")
        .otherwise("CHANGED")
    )
    return joined.select(*key, change.alias("change"), "old_value", "new_value")


def diff_items(old: DataFrame, new: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, item, change): ITEM_ADDED, ITEM_REMOVED or UNCHANGED; an owner for which nothing new came loses nothing."""
    a = old.select(owner, item).distinct().withColumn("__old", F.lit(True))
    b = new.select(owner, item).distinct().withColumn("__new", F.lit(True))
    joined = a.join(b, [owner, item], "full").join(b.select(owner).distinct(), owner, "left_semi")
    change = F.when(F.col("__old").isNull(), "ITEM_ADDED").when(F.col("__new").isNull(), "ITEM_REMOVED").otherwise("UNCHANGED")
    return joined.select(owner, item, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``: columns of ``new`` win where they are not null; other rows stay."""
    renamed = new.select(*key, *[F.col(c).alias(f"__{c}") for c in new.columns if c not in key])
    joined = old.join(renamed, key, "full")
    pick = lambda c: F.coalesce(f"__{c}", c) if c in new.columns else F.col(c)
    return joined.select(*[F.col(c) if c in key else pick(c).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks (the first by value if a key repeats)."""
    fresh = new.join(old, key, "left_anti").dropDuplicates(key)
    return old.unionByName(fresh.select(*old.columns))


def replace_set(old: DataFrame, new: DataFrame, owner: list[str]) -> DataFrame:
    """``old`` without the rows of the owners that ``new`` has, and all rows of ``new``."""
    return old.join(new.select(*owner).distinct(), owner, "left_anti").unionByName(new.select(*old.columns))


def field_form(field: Column, value: Column) -> Column:
    """What two values of a field must share to say the same: dates as dates, titles and places by key, addresses without their query, else without spacing."""
    date = F.coalesce(text.parsed_date(value, 1900, 2100).cast("string"), F.trim(value))
    place, address = F.coalesce(text.identity_key(value), F.lit("")), F.lower(F.regexp_replace(value, r"\?.*$", ""))
    return (
        F.when(field == "air_date", date).when(field == "title", text.title_key(value)).when(field == "location", place)
        .when(field == "image_url", address).otherwise(F.trim(F.regexp_replace(value, r"\s+", " ")))
    )


def refusal(field: Column, old: Column, new: Column, confidence: Column, weaker: Column) -> Column:
    """Why a differing value must not replace a stored one, or null: a weaker source, lost or shrunken text, thin backing.

    Reasons are tried in this order. A title must keep its descriptor and half its length; a
    synopsis must keep half its length and not be the old one cut short; dates and places need
    more than one low-trust source, dates also sources that agree; other texts over 40
    characters must keep two fifths.
    """
    was, now = text.title_descriptor(old), text.title_descriptor(new)
    letters = lambda v: F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}]+", "")
    shorter = lambda a, b, share: F.length(b) < F.length(a) * share
    return (
        F.when(weaker, "weaker source")
        .when((field == "title") & was.isNotNull() & now.isNull(), "descriptor lost")
        .when((field == "title") & shorter(was, now, 0.5), "descriptor shrunk")
        .when((field == "synopsis") & shorter(old, new, 0.5), "shrunk")
        .when((field == "synopsis") & (letters(old) != "") & F.startswith(letters(old), letters(new)), "cut short")
        .when(field.isin("air_date", "location") & (confidence == "LOW"), "one low-trust source")
        .when((field == "air_date") & (confidence == "CONFLICT"), "sources disagree")
        .when(~field.isin("title", "synopsis", "air_date", "location", "image_url") & (F.length(old) > 40) & shorter(old, new, 0.4), "shrunk")
    )


def diff_fields(existing: DataFrame, resolved: DataFrame, authority: Column) -> DataFrame:
    """(entity, field, change, reason, old, new, applied): what a resolved value does to a stored one.

    ``existing``: entity, field, old, old_source. ``resolved``: entity, field, new, source,
    confidence. ``authority`` ranks the sources by name, as an expression over a column
    ``source``. change is ADDED, UNCHANGED, REJECTED, CONFLICT (allowed, but sources disagree),
    CHANGED, or KEPT where nothing new came for a stored value. An empty value never replaces one.
    """
    known = existing.withColumnRenamed("old_source", "source").withColumns({"old_rank": authority, "old_form": field_form(F.col("field"), F.col("old"))})
    fresh = resolved.withColumns({"new_rank": authority, "new_form": field_form(F.col("field"), F.col("new"))})
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    joined = known.withColumnRenamed("source", "old_source").join(fresh, ["entity", "field"], "full").where(has("old") | has("new"))
    same = has("old") & has("new") & (F.col("old_form") == F.col("new_form"))
    weaker = F.coalesce((F.col("new_rank") < F.col("old_rank")) & (F.col("source") != F.col("old_source")), F.lit(False))
    why = refusal(F.col("field"), F.col("old"), F.col("new"), F.coalesce("confidence", F.lit("")), weaker)
    change = (
        F.when(~has("new"), "KEPT")
        .when(~has("old"), "ADDED")
        .when(F.col("same"), "UNCHANGED")
        .when(F.col("reason").isNotNull(), "REJECTED")
        .when(F.col("confidence") == "CONFLICT", "CONFLICT")
        .otherwise("CHANGED")
    )
    told = joined.withColumn("same", F.coalesce(same, F.lit(False)))
    told = told.withColumn("reason", F.when(has("old") & has("new") & ~F.col("same"), why)).withColumn("change", change)
    return told.select("entity", "field", "change", "reason", "old", "new", F.col("change").isin("ADDED", "CHANGED", "CONFLICT").alias("applied"))
