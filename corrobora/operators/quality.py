"""Data-quality operators: gaps, completeness, duplicates, streaks, ladders of severity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(column: str) -> Column:
    """Null, empty, or spaces only."""
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def gap_counts(df: DataFrame, gaps: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, and for each named condition how many rows meet it, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in gaps.items()])


def missing_fields(df: DataFrame, gaps: dict[str, Column], name: str = "missing") -> DataFrame:
    """Rows that meet any condition, with the array of the names they meet."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in gaps.items()]))
    return df.withColumn(name, named).where(F.size(name) > 0)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, 0 if there is nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def blocks(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the number of the block of its integer key: about as many blocks as keys in one.

    Both then grow with the root of the range of keys, so that neither the work within a block
    nor that over all blocks is large.
    """
    ends = df.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    width = F.ceil(F.sqrt(F.col("__hi").cast("double") - F.col("__lo") + 1))
    block = F.floor((F.col(key) - F.col("__lo")) / F.greatest(width, F.lit(1000)))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, block).drop("__lo", "__hi")  # one row


def numbered(df: DataFrame, key: str, name: str, within: Column | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order of its integer key, per ``within`` if given.

    Places are counted within blocks of keys, and what stands before a block comes from counts.
    """
    df = blocks(df, key, "__b").withColumn("__g", F.lit(0) if within is None else within)
    sizes = df.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    skip = sizes.select(F.col("__g").alias("__g2"), F.col("__b").alias("__b2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    place = F.row_number().over(Window.partitionBy("__g", "__b").orderBy(key))
    same = F.col("__g").eqNullSafe(F.col("__g2")) & F.col("__b").eqNullSafe(F.col("__b2"))
    ranked = df.withColumn("__r", place).join(skip, same)
    return ranked.withColumn(name, F.col("__r") + F.col("__skip")).drop("__g", "__b", "__g2", "__b2", "__r", "__skip")


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """Distinct integer keys with the nearest smaller one (``prev``) and the nearest larger one (``next``)."""
    keys = blocks(df.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct(), "k", "b")
    over = Window.orderBy("b")
    ends = keys.groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    ends = ends.select("b", F.lag("hi").over(over).alias("before"), F.lead("lo").over(over).alias("after"))
    w = Window.partitionBy("b").orderBy("k")
    near = keys.withColumn("p", F.lag("k").over(w)).withColumn("n", F.lead("k").over(w)).join(ends, "b")
    return near.select(F.col("k").alias(key), F.coalesce("p", "before").alias("prev"), F.coalesce("n", "after").alias("next"))


def numbering_gaps(df: DataFrame, key: str, step: int = 1 << 20) -> DataFrame:
    """The integers between the smallest and the largest key that no row has.

    Each key looks at its successor; a missing stretch is made where it is, in runs of ``step``
    numbers that are dealt out before they are counted through. Successors beyond a block of
    keys come from block minima.
    """
    keys = df.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    blocked = blocks(keys, "k", "b")
    minima = blocked.groupBy("b").agg(F.min("k").alias("m"))
    following = minima.select("b", F.lead("m").over(Window.orderBy("b")).alias("m"))
    after = F.lead("k").over(Window.partitionBy("b").orderBy("k"))
    seen = blocked.withColumn("n", after).join(following, "b").withColumn("n", F.coalesce("n", "m"))
    runs = seen.where("n > k + 1").select("n", F.explode(F.sequence(F.col("k") + 1, F.col("n") - 1, F.lit(step))).alias("s"))
    return runs.select(F.explode(F.sequence(F.col("s"), F.least(F.col("s") + (step - 1), F.col("n") - 1))).alias(key))


def duplicate_groups(df: DataFrame, by: list[Column], key: str, most: int | None = None) -> DataFrame:
    """Groups of more than one row (at most ``most``), with their ordered keys as text."""
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(key)).alias("keys"))
    kept = groups.where(F.col("n") > 1) if most is None else groups.where((F.col("n") > 1) & (F.col("n") <= most))
    return kept.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


def duplicate_rows(df: DataFrame, by: Column, key: str) -> DataFrame:
    """(h, n, key) for each row whose ``by`` others share: no group is gathered anywhere."""
    hashed = df.select(by.alias("h"), key)
    groups = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(groups, "h").select("h", "n", key)


def streaks(df: DataFrame, entity: str, order: list[str], failed: Column) -> DataFrame:
    """Per entity: failures since its last success, and its longest run of failures."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("__f", failed).withColumn("__island", F.count_if(~F.col("__f")).over(w))
    runs = marked.groupBy(entity, "__island").agg(F.count_if("__f").alias("__run"))
    return runs.groupBy(entity).agg(
        F.max_by("__run", "__island").alias("current_streak"), F.max("__run").alias("longest_streak")
    )


def smoothed(df: DataFrame, entity: str, order: list[str], value: Column) -> DataFrame:
    """Per entity the running mean that gives the newest value a quarter, rounded at each step; 0 starts anew.

    The fold depends on the order: rows are dealt by entity, sorted where they lie (spilling if
    need be) and read in batches, with one number held at a time. Null values count as 0.
    """
    rows = df.select(entity, *order, F.coalesce(value.cast("long"), F.lit(0)).alias("__v"))
    dealt = rows.repartition(F.col(entity)).sortWithinPartitions(entity, *order).select(entity, "__v")
    kind = df.schema[entity].dataType.simpleString()

    def table_of(done, arrow):
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (arrow, pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[entity, "n", "smoothed"])

    def fold(batches):
        who, mean, n, arrow = None, 0, 0, None
        for batch in batches:
            arrow = batch.schema.field(0).type
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = []
            for i, v in zip(ids, values, strict=True):
                if n and i != who:
                    done.append((who, n, mean))
                    mean, n = 0, 0
                who, n = i, n + 1
                total = 3 * mean + v
                # quarters round half away from zero
                mean = v if mean == 0 else (total + 2) // 4 if total >= 0 else -((2 - total) // 4)
            if done:
                yield table_of(done, arrow)
        if n:
            yield table_of([(who, n, mean)], arrow)

    return dealt.mapInArrow(fold, f"`{entity}` {kind}, n long, smoothed long")


def worst_severity(df: DataFrame, group: str, severity: str, ladder: list[str]) -> DataFrame:
    """Per group: issues and the worst severity by the ladder, mildest first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ladder]), F.col(severity))
    found = df.groupBy(group).agg(F.count("*").alias("issues"), F.max(rank).alias("__r"))
    name = F.element_at(F.array(*[F.lit(s) for s in ladder]), F.col("__r").cast("int"))
    return found.select(group, "issues", name.alias("worst"))


def detected_latest(signals: DataFrame, archive: DataFrame, high: int = 2000, apart: int = 3, jump: int = 30) -> DataFrame:
    """(entity, latest, spread, confidence, cut): the newest number by what sources report, with disagreement told.

    ``signals``: entity, source, n. ``archive``: entity, known, the largest number that is
    stored, which is the floor and never a witness. Numbers outside 1 to ``high`` - 1 are no
    signals. Of three or more signals, those over ``jump`` away from the middle one are cut
    first. The latest is the largest that is left; signals more than ``apart`` from each other
    are a conflict, equal ones give high confidence, others medium. A latest over ``jump`` past
    the archive is taken for an error: the archive's stays. An entity has few sources.
    """
    usable = signals.where((F.col("n") > 0) & (F.col("n") < high)).groupBy("entity").agg(F.array_sort(F.collect_list("n")).alias("all"))
    middle = F.element_at("all", F.floor((F.size("all") + 1) / 2).cast("int"))
    kept = F.when(F.size("all") >= 3, F.filter("all", lambda n: F.abs(n - F.col("middle")) <= jump)).otherwise(F.col("all"))
    judged = archive.join(usable.withColumn("middle", middle).withColumn("kept", kept), "entity", "left")
    latest, spread = F.array_max("kept"), F.array_max("kept") - F.array_min("kept")
    far = (F.col("known") > 0) & (latest > F.col("known") + jump)
    confidence = F.when(latest.isNull(), "low").when(far, "conflict").when(spread > apart, "conflict").when(spread == 0, "high").otherwise("medium")
    return judged.select(
        "entity",
        F.when(latest.isNull() | far, F.nullif("known", F.lit(0))).otherwise(latest).alias("latest"),
        F.coalesce(spread, F.lit(0)).alias("spread"),
        confidence.alias("confidence"),
        F.coalesce(F.size("all") - F.size("kept"), F.lit(0)).alias("cut"),
    )
