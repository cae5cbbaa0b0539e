"""SimHash near-duplicate classes by multi-index hashing.

Fingerprints are computed once per row; everything after works on distinct fingerprints, so
groups of copies count as one. A 64-bit fingerprint is cut into two 32-bit segments. If two
fingerprints differ in at most 3 bits, some segment differs in at most 1, so a segment's
Hamming ball of radius 1 is enumerated: the segment itself is filed in the table, and of the
one-bit neighbours those that turn a 0 into a 1 are looked up, which meets each pair from one
side. Entries are dealt by (segment, value); within a value the complete distances are
verified, and a spanning forest of the links is passed on in place of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import durable
from corrobora.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SEGMENT_BITS = 32
#: Entries of the segment tables that one task holds.
ENTRIES_A_TASK = 1_000_000

#: Fingerprints of a bucket beyond which it is split before all are compared.
SPLIT_BUCKET = 256

_EACH_BYTE = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of the ``width``-word shingles of a text; 0 without words.

    A-Z are lower-cased, words are runs of anything but space and tab to carriage return;
    repeats of a shingle count; fewer words than ``width`` form one shingle. A bit is 1 if it
    is set in over half of the shingles' XXH64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the 64-bit ``hashes``."""
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    counts = np.empty((8, 8), np.int64)  # [bit of a byte, byte]
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _EACH_BYTE).reshape(-1, 255).sum(axis=1)  # 8 counters, none over 255
        counts[bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (counts.T.ravel() * 2 > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed 64-bit number."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _entries(distinct: DataFrame) -> DataFrame:
    """Table rows (filed) and look-ups of both segments: (key, fp, filed); key holds the segment's number."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    parts = []
    for number, value in ((0, low), (1, high)):
        flips = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
            lambda bit: F.col("value").bitwiseAND(bit) == 0,
        )
        own = distinct.select("fp", value.alias("value"))
        ball = own.select(
            "fp",
            F.explode(
                F.concat(
                    F.array(F.struct(F.col("value").alias("value"), F.lit(True).alias("filed"))),
                    F.transform(
                        flips, lambda bit: F.struct(F.col("value").bitwiseXOR(bit).alias("value"), F.lit(False).alias("filed"))
                    ),
                )
            ).alias("e"),
        )
        parts.append(
            ball.select((F.col("e.value") * 2 + number).alias("key"), "fp", F.col("e.filed").alias("filed"))
        )
    return parts[0].unionByName(parts[1])


def forest(filed: np.ndarray, looked_up: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints filed under one value and those looked up there.

    Look-ups are linked to filed ones only. Breadth first: each fingerprint reached takes all
    unreached ones within ``max_bits`` out of the list, so a dense group is passed a few times.
    """
    at, is_filed = np.concatenate([filed, looked_up]), np.arange(len(filed) + len(looked_up)) < len(filed)
    links: list[tuple[int, int]] = []
    while is_filed.any():
        first = int(np.argmax(is_filed))
        queue = [(at[first], True)]
        at, is_filed = np.delete(at, first), np.delete(is_filed, first)
        while queue and len(at):
            fp, from_filed = queue.pop()
            near = np.bitwise_count(at ^ fp) <= max_bits
            if not from_filed:
                near &= is_filed
            if near.any():
                queue += list(zip(at[near], is_filed[near].tolist(), strict=True))
                links += [(int(fp), int(x)) for x in at[near]]
                at, is_filed = at[~near], is_filed[~near]
    return links


def bucket_links(filed: np.ndarray, looked_up: np.ndarray, max_bits: int, shift: int) -> list[tuple[int, int]]:
    """Links as of ``forest``; a large bucket is split first.

    All fingerprints of a bucket nearly agree in one half, so those within 3 bits of each
    other have a byte of the other half (that at ``shift``) in common: four forests over the
    groups of equal bytes join what one over all would.
    """
    if max_bits > 3 or len(filed) + len(looked_up) <= SPLIT_BUCKET:
        return forest(filed, looked_up, max_bits)
    at, links = np.concatenate([filed, looked_up]), []
    is_filed = np.arange(len(at)) < len(filed)
    for byte in range(4):
        value = (at >> np.uint64(shift + 8 * byte)) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(part) > 1 and is_filed[part].any():
                links += forest(at[part[is_filed[part]]], at[part[~is_filed[part]]], max_bits)
    return links


def _linker(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        links: list[tuple[int, int]] = []
        if table is not None and table.num_rows:
            key = table["key"].to_numpy()
            order = np.argsort(key, kind="stable")
            key, fp = key[order], table["fp"].to_numpy().view(np.uint64)[order]
            filed = table["filed"].to_numpy(zero_copy_only=False)[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            worth = (ends - starts > 1) & (np.add.reduceat(filed.astype(np.int64), starts) > 0)
            for i, j in zip(starts[worth].tolist(), ends[worth].tolist(), strict=True):
                mine = filed[i:j]
                # Keys of the low half (even ones) leave the high half to split by.
                links += bucket_links(fp[i:j][mine], fp[i:j][~mine], max_bits, 0 if key[i] & 1 else 32)
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``max_bits`` (at most 3) of each other; durable."""
    if max_bits > 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    spark = distinct.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(wide, -(-distinct.count() * 2 * (1 + SEGMENT_BITS // 2) // ENTRIES_A_TASK))
    dealt = _entries(distinct).repartition(tasks, "key")
    return durable(dealt.mapInArrow(_linker(max_bits), "a long, b long"))


def simhash_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Fingerprints that differ in at most ``max_bits`` bits are linked; a component's id is its
    smallest identifier. Null and empty texts have fingerprint zero, which is linked like any
    other. Equal fingerprints are one class whatever their number. A null identifier keeps its
    row and never names a component unless all its members lack one (then null). An empty table
    gives an empty result; other columns are ignored.
    """
    rows = durable(fingerprints(docs, id_col, text_col))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct.select("fp"), max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = durable(named.join(names, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
