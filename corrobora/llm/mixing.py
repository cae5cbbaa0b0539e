"""Mixing sources to target weights with hash-threshold histograms.

Each row has a 60-bit hash of its identifier and text. Words are summed by source and the
top bits of the hash; a running sum over these buckets finds the one in which a source's
budget runs out, and only that boundary bucket is split by the next bits, level by level.
The thresholds are nested and rows are kept by comparing their hash with one number, so no
rows are sorted. Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import BROADCAST_ROWS, durable, small_side

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CAP = 2.0


def _hash(id_col: str, text_col: str) -> Column:
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    both = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return F.conv(F.substring(both, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, cap=CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources take the weights in turn, by code point with null last. A target is the smaller
    of ``cap`` times the source's size and ``level`` times its weight, where the level makes
    the targets sum to the total: the limit that resharing the excess by weight reaches. The
    level follows from running sums over sources ordered by the level at which each is full.
    The windows run over one row per distinct source, the list a mix is configured by.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")
    )
    named = per.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    full = named.select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")
    )
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    # If the sources before this one are full and the rest are not, this is the level.
    level = (
        F.sum("source_size").over(everything) * F.lit(float(total_share))
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = full.withColumn("try", level).withColumn("open", F.col("try") * F.col("weight") <= F.col("most"))
    # The first source that stays open sets the level; those after it try less.
    level_found = F.max(F.when(F.col("open"), F.col("try"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(level_found * F.col("weight"), F.col("most")))
    return tried.select("source", "source_size", target.alias("target"))


def _boundaries(rows: DataFrame, budgets: DataFrame, level_bits: int) -> DataFrame:
    """(source, threshold): rows of a source with a hash below its threshold fit its budget.

    ``rows``: source, hash, size. ``budgets``: source, budget. A source all of whose rows fit
    gets the largest threshold.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    few = budgets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # one row of each state per source
    shift = HASH_BITS
    while shift > 0:
        above, shift = shift, max(0, shift - level_bits)
        inside = rows.alias("r").join(
            F.broadcast(state).alias("s") if few else state.alias("s"),
            F.col("r.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright(F.col("r.hash"), above) == F.col("s.prefix")),
        )
        sums = inside.groupBy(F.col("r.source").alias("source"), F.shiftright("r.hash", shift).alias("bucket")).agg(
            F.sum("r.size").alias("words"), F.first("s.left").alias("left")
        )
        run = F.sum("words").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        over = sums.withColumn("run", run).where(F.col("run") > F.col("left"))
        first = over.groupBy("source").agg(
            F.min_by(F.struct("bucket", "words", "run", "left"), "bucket").alias("b")
        )
        state = first.select(
            "source",
            F.col("b.bucket").alias("prefix"),
            (F.col("b.left") - F.col("b.run") + F.col("b.words")).alias("left"),
            F.col("b.words").alias("words"),
        )
    # The last bucket is one hash: its rows are taken if that comes nearer to the budget.
    last = F.col("prefix") + F.when(F.col("words") - F.col("left") < F.col("left"), 1).otherwise(0)
    return budgets.select("source").alias("b").join(
        state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")), "left"
    ).select(F.col("b.source").alias("source"), F.coalesce(last, F.lit(1 << HASH_BITS)).alias("threshold"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hash(id_col, text_col).alias("hash"),
    )


def mix_plan(rows: DataFrame, weights, total_share: float, cap: float, level_bits: int) -> DataFrame:
    """(source, source_size, target, base, threshold) from durable rows (source, size, hash).

    A row is taken ``base`` times, and once more if its hash lies below the threshold.
    """
    targets = durable(source_targets(rows.select("source", "size"), weights, total_share, cap))
    base = F.floor(F.least(F.lit(cap), F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    budgets = durable(
        targets.withColumn("base", base.cast("int")).withColumn(
            "budget", F.col("target") - F.col("base") * F.col("source_size")
        )
    )
    thresholds = _boundaries(rows.select("source", "hash", "size"), budgets.select("source", "budget"), level_bits)
    return small_side(
        durable(
            budgets.alias("b")
            .join(thresholds.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
            .select("b.*", "t.threshold")
        )
    )


def _copies(hash_: Column, cap: float) -> Column:
    return F.least(F.col("p.base") + F.when(hash_ < F.col("p.threshold"), 1).otherwise(0), F.lit(int(cap)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    total_share: float = TOTAL_SHARE,
    cap: float = CAP,
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``.

    A row is taken whole or not at all, ``copies`` times (0, 1 or 2): all rows once if the
    target reaches the source's size, and on top of that those whose hash lies below the
    threshold of what is left. A source's taken words differ from its target by at most half
    of the words that share one hash, usually one row. Null texts have size 0, null sources
    form a source, rows that repeat identifier and text share a hash and stand or fall
    together, and an empty table gives an empty result. Columns other than the three named
    are ignored, whatever their names.
    """
    rows = durable(_sized(docs, id_col, text_col, source_col))
    plan = mix_plan(rows, weights, total_share, cap, level_bits)
    copies = _copies(F.col("r.hash"), cap)
    return (
        rows.alias("r")
        .join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .select(
            "r.doc_id",
            "r.source",
            "r.size",
            "p.source_size",
            "p.target",
            copies.alias("copies"),
            (copies * F.col("r.size")).cast("long").alias("taken"),
        )
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    total_share: float = TOTAL_SHARE,
    cap: float = CAP,
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix of ``mix_sources`` takes them, with all their columns.

    Rows are compared with their source's threshold where they lie; no text is shuffled.
    """
    rows = durable(_sized(docs, id_col, text_col, source_col))
    plan = mix_plan(rows, weights, total_share, cap, level_bits)
    hashed = docs.withColumn("__hash", _hash(id_col, text_col))
    taken = hashed.alias("r").join(plan.alias("p"), F.col(f"r.{source_col}").eqNullSafe(F.col("p.source")))
    times = F.array_repeat(F.lit(1), _copies(F.col("r.__hash"), cap))
    return taken.select(*[F.col(f"r.{c}") for c in docs.columns], F.explode(times).alias("__time")).drop("__time")
