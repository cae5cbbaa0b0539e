"""Writes as frames: what a table holds after a find-or-create, delete, update, append or staged publication.

Tables are immutable frames; each function gives the rows after the write. ``publish`` makes
several of them visible together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The levels a log row may have; others become the first.
LEVELS = ("info", "warning", "error", "success")


def hash_id(name: Column) -> Column:
    """A 60-bit identifier made from a name, so that reruns and parallel writers agree."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def find_or_create(dimension: DataFrame, wanted: DataFrame, name: str, ident: str) -> DataFrame:
    """(ident, name, created) for each name of ``wanted``: its row of ``dimension``, or a new one named by hash.

    The smallest identifier stands for a name that several rows have.
    """
    known = dimension.groupBy(name).agg(F.min(ident).alias(ident))
    names = wanted.select(name).where(F.col(name).isNotNull() & (F.trim(name) != "")).distinct()
    found = names.join(known, name, "left")
    return found.select(F.coalesce(ident, hash_id(F.col(name))).alias(ident), name, F.col(ident).isNull().alias("created"))


def delete_matching(rows: DataFrame, condition: Column, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` without those that meet ``condition`` (null counts as no) and, with ``keys``, whose key is among them."""
    gone = F.coalesce(condition, F.lit(False))
    if keys is None:
        return rows.where(~gone)
    on = keys.columns
    marked = keys.distinct().withColumn("__hit", F.lit(True))
    return rows.join(marked, on, "left").where(~(gone & F.coalesce("__hit", F.lit(False)))).select(*rows.columns)


def update_from(rows: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``other`` where its key matches (one row per key there); others keep theirs."""
    new = other.select(*key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = rows.join(new, key, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def fill_blanks(rows: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Like ``update_from``, but only columns that are null or empty are written, and never with an empty value."""
    new = other.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, key, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    fill = lambda c: F.when(blank(c) & ~blank(f"__{c}"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[fill(c) if c in columns else F.col(c) for c in rows.columns])


def change_rows(diffed: DataFrame) -> DataFrame:
    """The rows of a diff that a change log keeps: all but unchanged ones."""
    return diffed.where("change <> 'UNCHANGED'")


def log_rows(rows: DataFrame, level: Column, message: Column) -> DataFrame:
    """``rows`` with a whitelisted ``level`` and a ``message``."""
    low = F.lower(level)
    return rows.withColumn("level", F.when(low.isin(*LEVELS), low).otherwise(LEVELS[0])).withColumn("message", message)


def first_acceptable(candidates: DataFrame, owner: str, url: str, ok: Column) -> DataFrame:
    """(owner, url, tried): the first acceptable of an owner's candidates (winner, rank), each address tried once.

    The winner's candidate comes first, then the others by rank; tried counts addresses up to it.
    """
    order = F.struct((~F.col("winner")).alias("late"), "rank")
    once = candidates.withColumn("ok", ok).groupBy(owner, url).agg(F.min(order).alias("order"), F.bool_or("ok").alias("ok"))
    first = once.where("ok").groupBy(owner).agg(F.min(F.struct("order", F.col(url).alias("url"))).alias("f"))
    before = once.join(first, owner).where(F.col("order") <= F.col("f.order"))
    return before.groupBy(owner).agg(F.first("f.url").alias(url), F.count("*").alias("tried"))


def aliased(names: DataFrame, aliases: DataFrame, live: DataFrame) -> DataFrame:
    """(raw, ident): what an alias points at, if that still exists. aliases: raw, ident; live: ident."""
    return names.select("raw").distinct().join(aliases.join(live.select("ident").distinct(), "ident", "left_semi"), "raw").select("raw", "ident")


def exact_or_key(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, ident, matched) for names (raw, key): a row of ``known`` (name, key, ident) of the same spelling, else of the same key.

    The smallest identifier wins; an empty key matches nothing.
    """
    exact = known.groupBy(F.col("name").alias("raw")).agg(F.min("ident").alias("same"))
    keyed = known.where("key IS NOT NULL").groupBy("key").agg(F.min("ident").alias("like"))
    found = wanted.select("raw", "key").distinct().join(exact, "raw", "left").join(keyed, "key", "left")
    how = F.when(F.col("same").isNotNull(), "exact").when(F.col("like").isNotNull(), "key").otherwise("none")
    return found.select("raw", F.coalesce("same", "like").alias("ident"), how.alias("matched"))


def publish(spark: SparkSession, frames: dict[str, DataFrame], root: str) -> str:
    """Write ``frames`` to new folders under ``root``, then name them in one manifest row; the version.

    Readers follow the latest manifest, so they see all of the frames or, if a write fails
    before it, none of them.
    """
    version = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.write.parquet(f"{root}/{name}/{version}")
    row = [(version, name) for name in sorted(frames)]
    manifest = spark.createDataFrame(row, "version string, name string").withColumn("at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The frame that the latest manifest of ``root`` names."""
    last = spark.read.parquet(f"{root}/_manifest").where(F.col("name") == name).orderBy(F.desc("at"), "version").first()
    return spark.read.parquet(f"{root}/{name}/{last['version']}")
