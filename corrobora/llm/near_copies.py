"""Near copies by exact Jaccard similarity of word shingles: SimHash classes first, then MinHash bands.

A text is the set of its five-word shingles. Texts whose SimHash fingerprints are linked by
multi-index hashing meet the leader of their class and are verified. Distances of 64 bits
have no bound that follows from a similarity of 0.8, so bands of minimal hashes find the rest.
Texts that agree in a band meet under one key; a pair of Jaccard similarity 0.8 shares none of the 40 bands of 5 with a chance
of 1.3e-7 (1e-9 at 0.85), and every pair that meets is verified on the complete sets. Groups of
copies are not compared all with all: in the first rounds every text meets one leader of its
keys, and links found join components. Only keys
that still hold several components are then compared across components, inside their task: by
sketches, and what may be similar by complete sets unless it is joined by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import durable
from corrobora.llm.components import connected_components
from corrobora.llm.simhash import majority, near_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
BANDS = 40
BAND_ROWS = 5
#: Rounds in which a text meets one leader only.
LEADER_ROUNDS = 2
#: Minimal hashes in a sketch; the first BANDS * BAND_ROWS make the bands.
SKETCH_HASHES = 512
#: Pairs whose sketches agree by this much less than the similarity (5 deviations: a chance of 3e-7) are not compared in full.
SLACK = 0.09
#: Texts of a key that are compared at a time with as many others.
COMPARED = 192

_PRIME = np.uint64(0x9E3779B185EBCA87)


def text_hash(text: Column) -> Column:
    """Names a text; null and empty texts are equal."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 of a text's ``width``-word shingles, ascending; see ``shingle_hashes``."""
    return np.unique(shingle_hashes(text, width))


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The XXH64 of a text's ``width``-word shingles, with repeats; words as in ``simhash.fingerprint``.

    Fewer words than ``width`` form one shingle, no words an empty one.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    join, digest, n = b" ".join, xxhash.xxh64_intdigest, max(len(words) - width + 1, 1)
    return np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minimal_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the upper 32 bits of each of SKETCH_HASHES keyed hashes."""
    draw = np.random.default_rng(SEED)
    by, mask = draw.integers(0, 1 << 63, (2, SKETCH_HASHES, 1), np.uint64)
    by = by * np.uint64(2) + np.uint64(1)
    least = np.full(SKETCH_HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (((hashes[None, at : at + 256] ^ mask) * by) >> np.uint64(32)).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * _PRIME
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sketches, fps = [], [], [], []
        for text in batch.column(1):
            every = shingle_hashes(text.as_py())
            hashes = np.unique(every)
            fps.append(majority(every))
            least = minimal_hashes(hashes)
            sizes.append(len(hashes))
            keys.append(band_keys(least))
            sketches.append(least.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))],
            names=["node", "size", "keys", "sketch", "fp"],
        )


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3)
            )
            keep = pa.array((x == y).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _exact(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c) for c in (0, 2, 3)), strict=True):
                if at != a.as_py():
                    at, mine = a.as_py(), shingles(x.as_py())
                keep.append(similarity(mine, shingles(y.as_py())) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, named: DataFrame, value: str) -> DataFrame:
    """(a, b, x, y): pairs with the ``value`` that ``named`` (node, value) has for either end."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mine = durable(named.join(ends, "node", "left_semi").select("node", value).dropDuplicates(["node"]))
    first = pairs.join(mine.select(F.col("node").alias("b"), F.col(value).alias("y")), "b")
    return first.join(mine.select(F.col("node").alias("a"), F.col(value).alias("x")), "a").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts have a similarity of ``least`` or more; durable."""
    alike = _with_both(durable(pairs), sketches, "sketch").mapInArrow(_alike(least - SLACK), "a long, b long")
    return durable(_with_both(durable(alike), texts, "text").mapInArrow(_exact(least), "a long, b long"))


def alike_pairs(key: int, size, keys, sketch, least: float, roots) -> Iterator[np.ndarray]:
    """(n, 2) places of pairs under a key that may be ``least`` similar, if the key is the first they share; a chunk at a time.

    ``roots`` has the roots of a slice of places as they are then; pairs of equal roots are left out.
    """
    agree = int(np.ceil((least - SLACK) * sketch.shape[1]))
    for i in range(0, len(size), COMPARED):
        for j in range(i, len(size), COMPARED):
            x, y = slice(i, i + COMPARED), slice(j, j + COMPARED)
            open_ = roots(x)[:, None] != roots(y)[None]
            open_ &= np.minimum(size[x, None], size[None, y]) >= least * np.maximum(size[x, None], size[None, y]) - 1e-6
            if i == j:
                open_ = np.triu(open_, 1)
            p, q = np.nonzero(open_)
            for at in range(0, len(p), 8192):
                a, b = p[at : at + 8192] + i, q[at : at + 8192] + j
                near = (sketch[a] == sketch[b]).sum(axis=1) >= agree
                a, b = a[near], b[near]
                same = keys[a] == keys[b]
                first = keys[a, same.argmax(axis=1)] == key
                yield np.stack([a[first], b[first]], axis=1)


def meeting(key: int, node, root, size, keys, sketch, least: float) -> np.ndarray:
    """The (distinct) nodes that stand in one of the ``alike_pairs``."""
    met = np.zeros(len(node), bool)
    for pairs in alike_pairs(key, size, keys, sketch, least, lambda at: root[at]):
        met[pairs.ravel()] = True
    return node[met]


def forest(key: int, node, root, size, keys, sketch, hashes, least: float) -> np.ndarray:
    """(n, 2) nodes: links that join the same components as all ``least`` similar ``alike_pairs``, each of them compared exactly.

    ``hashes`` are the shingles of the places. A pair whose ends are joined by then adds
    nothing and is not compared, so there are fewer links than nodes.
    """
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    found, named = [], root.tolist()
    for pairs in alike_pairs(key, size, keys, sketch, least, lambda at: np.array([top(r) for r in named[at]], np.int64)):
        for a, b in pairs.tolist():
            x, y = top(named[a]), top(named[b])
            if x != y and similarity(hashes[a], hashes[b]) >= least:
                up[max(x, y)] = min(x, y)
                found.append((node[a], node[b]))
    return np.array(found, np.int64).reshape(-1, 2)


def _by_key(run, names: list[str]):
    """mapInArrow: rows (key, ...) sorted by key; what ``run`` makes of the rows of each as columns ``names``."""

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = rows["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                columns = run(int(key[i]), rows.slice(i, j - i))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut or held and held[-1].column(0)[-1].as_py() != key[0]:
                if cut:
                    held.append(batch.slice(0, cut))
                yield from found(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from found(pa.Table.from_batches(held))

    return all_rows


def _arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """node, root, size, keys and sketch of the rows of a key."""
    keys = np.array(rows["keys"].to_pylist(), np.int64).reshape(len(rows), -1)
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(len(rows), -1)
    return *(rows[c].to_numpy() for c in ("node", "root", "size")), keys, sketch


def _across(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) across the roots of each key of ``rows`` (key, node, root, size, keys, sketch), as in ``forest``; durable.

    Shingles are read only for the texts that sketches leave in some pair.
    """

    def met(key: int, rows: pa.Table):
        nodes = meeting(key, *_arrays(rows), least)
        return np.full(len(nodes), key), nodes

    def linked(key: int, rows: pa.Table):
        hashes = [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
        links = forest(key, *_arrays(rows), hashes, least)
        return links.min(axis=1), links.max(axis=1)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    dealt = lambda df: df.repartition("key").sortWithinPartitions("key", "node")
    open_ = durable(dealt(rows).mapInArrow(_by_key(met, ["key", "node"]), "key long, node long"))
    needed = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text").dropDuplicates(["node"])
    hashes = durable(needed.mapInArrow(shingled, "node long, hashes binary"))
    left = rows.join(open_, ["key", "node"], "left_semi").join(hashes, "node")
    left = dealt(left.select("key", "node", "root", "size", "keys", "sketch", "hashes"))
    return durable(left.mapInArrow(_by_key(linked, ["a", "b"]), "a long, b long"))


def _class_pairs(sketches: DataFrame) -> DataFrame:
    """(a, b): each text of a SimHash class of several, after the smallest of them."""
    fps = durable(sketches.select("fp").distinct())
    roots = connected_components(near_links(fps))
    named = sketches.select("node", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("node", F.coalesce("root", "fp").alias("class"))
    leaders = named.groupBy("class").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a < high")
    return named.join(leaders, "class").where("node <> a").select("a", F.col("node").alias("b"))


def near_copies(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, root) for the texts (node, text) linked to another: equal roots where a chain of pairs is ``least`` similar.

    Nodes are hashes of texts and may repeat. ``least`` is the similarity the bands are made
    for, 0.8, or more.
    """
    if least < SIMILARITY:
        raise ValueError("the bands find similarities of 0.8 and more")
    sketches = durable(texts.select("node", "text").mapInArrow(_sketch, "node long, size long, keys array<long>, sketch binary, fp long"))
    sketches = durable(sketches.dropDuplicates(["node"]))
    entries = sketches.select("node", "size", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # A text's weight: how many texts it meets. That of the others' original is large, so it leads first.
    entries = entries.join(met, "key")
    weights = entries.groupBy("node").agg(F.sum("n").alias("weight"))
    entries = durable(entries.drop("n").join(weights, "node"))
    links = [_verified(_class_pairs(sketches), sketches, texts, least)]
    roots = connected_components(links[0])
    for number in range(LEADER_ROUNDS + 1):
        named = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        shuffled = F.xxhash64("node", F.lit(number))
        order = F.struct((-F.col("weight") if number == 0 else shuffled).alias("order"), "node", "size", "root")
        open_keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(order).alias("l"))
        open_keys = durable(open_keys.where("low < high").select("key", "l.order", "l.node", "l.size", "l.root"))
        if open_keys.isEmpty():
            break
        if number == LEADER_ROUNDS:
            rest = named.join(open_keys.select("key"), "key", "left_semi").select("key", "node", "root", "size")
            rest = rest.join(sketches.select("node", "keys", "sketch"), "node").select("key", "node", "root", "size", "keys", "sketch")
            links.append(_across(rest, texts, least))
        else:
            x, y = named.alias("x"), open_keys.alias("y")
            enough = F.least("x.size", "y.size") >= F.lit(least) * F.greatest("x.size", "y.size") - F.lit(1e-6)
            met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & enough)
            shared = met.groupBy(F.col("x.node").alias("b"), F.col("y.node").alias("a")).agg(
                F.count("*").alias("n"), F.min("y.order").alias("order")
            )
            # The first in order leads at first, then the one that shares most keys.
            best = F.struct("order", "a") if number == 0 else F.struct((-F.col("n")).alias("n"), "order", "a")
            pairs = shared.groupBy("b").agg(F.min(best).alias("best")).select("best.a", "b")
            links.append(_verified(pairs, sketches, texts, least))
        roots = connected_components(reduce(DataFrame.unionByName, links))
    return roots


def near_copy_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY
) -> DataFrame:
    """(doc_id, node, kept) per distinct identifier and text of ``docs``; node is ``text_hash``.

    Of the rows whose texts are linked, the one with the smallest identifier is kept (null
    last; ties: the smallest hash); equal texts are linked like others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("node"))
    rows = durable(rows.distinct())
    roots = near_copies(docs.select(text_hash(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text")), least)
    named = durable(
        rows.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = named.groupBy("root").agg(F.min(order).alias("best"))
    return named.join(best, "root").select("doc_id", "node", (order == F.col("best")).alias("kept"))
