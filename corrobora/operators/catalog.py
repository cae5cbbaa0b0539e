"""Catalogue operators: filtered pages, nested details, neighbours, related items, facets."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.operators.quality import numbered


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of ``conditions``; true if there are none."""
    return functools.reduce(operator.and_, conditions, F.lit(True))


def optional_filters(df: DataFrame, search=None, search_in=(), equal=None, at_least=None) -> DataFrame:
    """``df`` with the conjuncts whose argument was given; None drops one, 0 and False do not.

    ``search`` is a case-insensitive substring of any of the columns ``search_in``.
    """
    conditions = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    conditions += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    if search:
        hits = [F.contains(F.lower(c), F.lit(search.lower())) for c in search_in]
        conditions.append(functools.reduce(operator.or_, hits))
    return df.where(all_of(conditions))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page; the number is clamped to the pages there are, which takes one count."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def with_dimensions(facts: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of ``facts`` to dimensions (frame, fact key, dimension key); Spark picks the strategy by size."""
    for dim, fact_key, dim_key in dimensions:
        facts = facts.join(dim, facts[fact_key] == dim[dim_key], "left")
    return facts


def nested_children(parents: DataFrame, children: DataFrame, key: str, child: Column, name: str) -> DataFrame:
    """``parents`` with an ordered array ``name`` of their children's structs (empty if none)."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(child)).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))


def in_request_order(df: DataFrame, key: str, wanted: list, cap: int = 12) -> DataFrame:
    """Rows whose key was asked for, with ``pos`` of its first mention; repeats and those past ``cap`` are dropped."""
    distinct = list(dict.fromkeys(wanted))[:cap]
    positions = F.create_map(*[F.lit(x) for i, k in enumerate(distinct) for x in (k, i)])
    return df.where(F.col(key).isin(distinct)).withColumn("pos", positions[F.col(key)])


def sharing_items(bridge: DataFrame, entity: str, item: str, focus) -> DataFrame:
    """Entities that share items with ``focus``, with the number shared: a semi join on the focus's items."""
    mine = bridge.where(F.col(entity) == focus).select(item).distinct()
    others = bridge.where(F.col(entity) != focus).select(entity, item).distinct()
    return others.join(mine, item, "left_semi").groupBy(entity).agg(F.count("*").alias("shared"))


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def nearest(df: DataFrame, key: str, to: int, k: int) -> DataFrame:
    """The k rows nearest to a number, ties to the smaller key."""
    return df.where(F.col(key) != to).orderBy(F.abs(F.col(key) - to), key).limit(k)


def staged_top_up(stages: list[DataFrame], key: str, k: int, order: list[str]) -> DataFrame:
    """Up to ``k`` keys from ranked stages: earlier stages first, a key in its first stage only.

    Each stage has ``key`` and the columns ``order`` that rank it within its stage.
    """
    tagged = [s.select(key, *order, F.lit(i).alias("stage")) for i, s in enumerate(stages)]
    every = functools.reduce(DataFrame.unionByName, tagged)
    first = first_per_group(every, [key], [F.col("stage"), *[F.col(c) for c in order]])
    return first.orderBy("stage", *order, key).limit(k)


def spread_sample(df: DataFrame, key: str, k: int) -> DataFrame:
    """``k`` keys spread evenly over the sorted distinct ones, first and last included.

    Ranks come from per-block counts and ranks within a block, so no task sorts all keys.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    spark = df.sparkSession
    n = keys.count()
    wanted = sorted({i * (n - 1) // max(k - 1, 1) for i in range(k) if n})
    ranked = numbered(keys, key, "__place").withColumn("rank", F.col("__place") - 1)
    picks = spark.createDataFrame([(i,) for i in wanted], "rank long")
    return ranked.join(F.broadcast(picks), "rank", "left_semi").select(key, F.col("rank").cast("long"))
