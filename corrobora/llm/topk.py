"""Exact top-k inner products with multi-resolution segment statistics.

Vectors become integers, floor(1024 x). At each resolution a vector is cut into equal
segments, kept by their means and deviations. These bound the distance of two vectors from
below, |u - v|^2 >= sum n ((mean_u - mean_v)^2 + (dev_u - dev_v)^2), and as
2 u.v = |u|^2 + |v|^2 - |u - v|^2, their inner product from above. A task goes from coarse to
fine: pairs whose bound stays below the query's k-th best score so far are dropped, and
what survives is computed in integers. Shards of candidates meet blocks of queries, each
pair in one task of bounded size, which passes on k rows for a query at most. A few shards
go first; the k-th best score that a query finds there is its floor in all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import durable

SCALE = 1024
#: Candidates and queries that one task holds at most, about.
SHARD_ROWS = 32_768
BLOCK_QUERIES = 4096
SHARDS_AT_LEAST = 64
#: One shard in so many goes first, to find the floors.
FIRST_OF = 16
RESOLUTIONS = (4, 16)
#: Candidates tried at a time, between updates of the k-th best scores.
STEP = 512
#: Components multiplied at a time.
PRODUCTS = 1 << 22
#: Where one pair in so many is left by the bounds, a step is multiplied whole.
DENSE = 16
#: Scores beyond 64 bits are given as the nearest of these.
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1
_NONE = -(1 << 63)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, times the root of their length (vectors are padded with zeros)."""
    wide = np.pad(x, ((0, 0), (0, -x.shape[1] % segments)))
    parts = wide.reshape(len(x), segments, wide.shape[1] // segments)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(parts.shape[2])


def inner_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers held as doubles, the nearest 64-bit number if beyond."""
    out = np.empty(len(q), np.int64)
    q_length, r_length = np.hypot.reduce(q, axis=1, initial=0), np.hypot.reduce(r, axis=1, initial=0)
    # No partial sum exceeds the product of the lengths.
    fits = (q_length < 2.0**62) & (r_length < 2.0**62) & (q_length * np.minimum(r_length, 2.0**62) < 2.0**62)
    out[fits] = np.einsum("ij,ij->i", q[fits].astype(np.int64), r[fits].astype(np.int64))
    for i in np.flatnonzero(~fits).tolist():
        exact = sum(int(x) * int(y) for x, y in zip(q[i], r[i], strict=True))
        out[i] = max(LOWEST, min(HIGHEST, exact))
    return out


def best_of_cell(
    queries: np.ndarray,
    query_ids: np.ndarray,
    rows: np.ndarray,
    row_ids: np.ndarray,
    k: int,
    floors: np.ndarray | None = None,
    resolutions=RESOLUTIONS,
) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows for each query but its own, ties to the smaller id; score _NONE marks an empty place.

    Vectors are integers held as doubles. Rows below a query's floor may be left out.
    """
    n = len(queries)
    score, ident = np.full((n, k), _NONE), np.full((n, k), -1, np.int64)
    floors = np.full(n, _NONE) if floors is None else floors
    top = max(1.0, np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    q_small, r_small = queries / top, rows / top  # so that no square overflows
    q_norm, r_norm = (q_small**2).sum(axis=1), (r_small**2).sum(axis=1)
    levels = [(q, (q**2).sum(axis=1)[:, None], statistics(r_small, s)) for s in resolutions for q in [statistics(q_small, s)]]
    # Doubles hold every partial sum of such products exactly.
    doubles = np.sqrt(q_norm.max(initial=0) * r_norm.max(initial=0)) * top * top < 2.0**52
    slack = 1e-9 * (q_norm.max(initial=0) + r_norm.max(initial=0)) + 1e-6 / top / top  # far above the rounding errors
    order = np.argsort(-r_norm, kind="stable")  # long vectors raise the k-th best scores early
    pairs = max(1, PRODUCTS // max(1, queries.shape[1]))
    for at in range(0, len(order), STEP):
        batch = order[at : at + STEP]
        alive = np.ones((n, len(batch)), bool)
        # A pair can reach the floor only if its distance is at most this.
        floor = np.maximum(score[:, -1], floors)
        open_ = (floor <= LOWEST)[:, None]
        most = q_norm[:, None] + r_norm[batch] - 2.0 * (floor[:, None].astype(np.float64) / top / top)
        for q_stat, q_part, r_stat in levels:
            r_part = r_stat[batch]
            least = q_part + (r_part**2).sum(axis=1) - 2.0 * (q_stat @ r_part.T)
            alive &= (least <= most + slack) | open_
            if not alive.any():
                break
        alive &= row_ids[batch] != query_ids[:, None]
        at_q, at_r = np.nonzero(alive)
        if not len(at_q):
            continue
        if doubles and len(at_q) * DENSE >= alive.size:
            value = (queries @ rows[batch].T)[at_q, at_r].astype(np.int64)
        else:
            value = np.concatenate(
                [
                    inner_products(queries[at_q[i : i + pairs]], rows[batch[at_r[i : i + pairs]]])
                    for i in range(0, len(at_q), pairs)
                ]
            )
        reach = value >= floor[at_q]
        at_q, at_r, value = at_q[reach], at_r[reach], value[reach]
        if not len(at_q):
            continue
        starts = np.flatnonzero(np.r_[True, at_q[1:] != at_q[:-1]])
        for i, j in zip(starts.tolist(), np.r_[starts[1:], len(at_q)].tolist(), strict=True):
            q = at_q[i]
            s = np.concatenate([score[q], value[i:j]])
            ids = np.concatenate([ident[q], row_ids[batch[at_r[i:j]]]])
            best = np.lexsort((ids, ~s))[:k]  # ~s falls as s rises, for every 64-bit number
            score[q], ident[q] = s[best], ids[best]
    return score, ident


def scaled(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(SCALE x) as doubles, which hold such integers exactly, shorter vectors padded with zeros."""
    sizes = vectors.map(len).to_numpy(np.int64)
    out = np.zeros((len(sizes), width))
    if len(sizes):
        with np.errstate(over="ignore"):
            flat = np.nan_to_num(np.floor(np.concatenate(vectors.to_list()).astype(np.float64) * SCALE))
        out[np.arange(width) < sizes[:, None]] = flat
    return out


def _cell(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        width = max([1, *rows["v"].map(len), *queries["v"].map(len)])
        score, ident = best_of_cell(
            scaled(queries["v"], width),
            queries["vec_id"].to_numpy(np.int64),
            scaled(rows["v"], width),
            rows["vec_id"].to_numpy(np.int64),
            k,
            queries["floor"].to_numpy(np.int64),
        )
        at, place = np.nonzero(score > _NONE)
        return pd.DataFrame(
            {
                "query_id": queries["vec_id"].to_numpy(np.int64)[at],
                "query": queries["query"].to_numpy(np.int64)[at],
                "vec_id": ident[at, place],
                "score": score[at, place],
            }
        )

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors``.

    Exact, ties to the smaller id, fewer than k rows if there are fewer. A query is not
    compared with rows of its own id. Rows without an id or vector, or with a null, NaN or
    infinite component, take no part on either side; shorter vectors count as followed by
    zeros; query rows that repeat id and vector count once; other columns are ignored. Empty
    tables give an empty result. Scores are exact up to 64 bits; one beyond is given, and
    ranked, as the nearest 64-bit number. Components past the largest double count as that.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
            F.col("vec_id").isNotNull()
            & F.col("v").isNotNull()
            & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        )

    asked = durable(usable(queries).distinct().withColumn("query", F.xxhash64("vec_id", "v")))
    rows = usable(vectors)
    shards = max(SHARDS_AT_LEAST, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def best(part: DataFrame, asked: DataFrame, low: int, high: int) -> DataFrame:
        right = asked.withColumn("block", F.pmod(F.xxhash64("query", F.lit("block")), F.lit(blocks)).cast("int")).withColumn(
            "shard", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")))
        )
        cells = part.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
        return cells.applyInPandas(_cell(k), "query_id long, query long, vec_id long, score long")

    first = max(1, shards // FIRST_OF)
    found = durable(best(left.where(F.col("shard") < first), asked.withColumn("floor", F.lit(_NONE)), 0, first))
    # k rows at most for each query and first shard.
    kth = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    floors = found.withColumn("place", F.row_number().over(kth)).where(F.col("place") == k)
    floors = floors.select(F.col("query_id").alias("vec_id"), "query", F.col("score").alias("floor"))
    raised = asked.join(floors, ["vec_id", "query"], "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
    found = found.unionByName(best(left.where(F.col("shard") >= first), durable(raised), first, shards))
    place = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
