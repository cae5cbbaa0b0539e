"""Removal of long repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

A 400-byte window is named by the smallest hash of the 32-byte grams in it. Equal windows
have equal names wherever they stand, so all occurrences of a window meet under its name.
Neighbouring windows of one name form a run (about 190 windows); its segment is the bytes
they span. Only names that occur twice can hold repeats: they are found by counting 8-byte
names, and equal segments of a name are counted before any bytes are shuffled, so a group of
copies is one segment with a weight; a segment that is alone under its name needs no bytes.

Tasks build the transform of the segments of complete names, a chunk at a time, and derive
their common prefixes breadth first: the intervals of one-byte strings are extended to the
left, each step finds the boundaries of the next value, and it stops at the minimum length.
Boundaries not found by then separate suffixes that agree in at least that many bytes.

A name with more different segments than a task should hold (edits in thousands of near
copies, a passage in thousands of contexts) is dealt anew: its windows are put in narrow
ranges by their distance from the gram that names them, and a range takes the bytes that all
its windows share as its name. Only ranges whose shared bytes occur twice go on; they meet
in the same expansion, or in ranges still narrower. A range of one window is its own name,
so this ends after a few rounds, each with a few rows for a segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import durable

MIN_BYTES = 400
GRAM = 32
#: Windows hashed at a time; a longer text is cut into overlapping blocks.
BLOCK = 1 << 20
#: Different segments of a name that one task expands; the windows of a name with more are dealt anew.
MANY_SEGMENTS = 512
#: Windows in a range, round by round.
RANGES = (64, 8, 1)
#: Bytes of the segments whose transform is built together (more if one name has more).
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xBF58476D1CE4E5B9)


class GramHasher:
    """Hashes of all grams of a byte string, by position-free polynomials modulo 2**64."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            for name, x in (("up", self.base), ("down", self.inverse)):
                powers = np.full(2 * n, np.uint64(x))
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, body: np.ndarray, gram: int) -> np.ndarray:
        n = len(body)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= _ODD
        return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima that run within blocks from either end."""
    m = len(x)
    blocks = np.full(-(-m // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:m] = x
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: m - width + 1], forward[width - 1 : m])


RUNS_DDL = "uid binary, lead long, start int, nwin int, anchors int, key long, seg long"


def _runs(min_bytes: int, gram: int):
    width = min_bytes - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = GramHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for uid, lead, body in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    for off in range(0, len(body) - min_bytes + 1, BLOCK):
                        piece = body[off : off + BLOCK + min_bytes - 1]
                        h = hasher(np.frombuffer(piece, np.uint8), gram)
                        low = sliding_min(h, width)
                        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                        ends = np.r_[starts[1:], len(low)].tolist()
                        names, signed = low[starts], low[starts].view(np.int64).tolist()
                        for i, j, name, key in zip(starts.tolist(), ends, names, signed, strict=True):
                            seen = int(np.count_nonzero(h[i : j - 1 + width] == name))
                            seg = xxhash.xxh3_64_intdigest(piece[i : j - 1 + min_bytes])
                            out.append((uid, lead, off + i, j - i, min(seen, 2), key, seg - (1 << 63)))
                columns = list(zip(*out, strict=True)) if out else [()] * 7
                types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["uid", "lead", "start", "nwin", "anchors", "key", "seg"],
                )

    return run


SEGMENTS_DDL = "key long, seg long, nwin int, weight long, many boolean, body binary"
_SEGMENTS = pa.schema(
    [
        ("key", pa.int64()),
        ("seg", pa.int64()),
        ("nwin", pa.int32()),
        ("weight", pa.int64()),
        ("many", pa.bool_()),
        ("body", pa.binary()),
    ]
)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _extract(min_bytes: int):
    """Rows (body, parts) to the segments that the parts name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for body, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for p in wanted:
                        piece = body[p["start"] : p["start"] + p["nwin"] + min_bytes - 1]
                        out.append((p["key"], p["seg"], p["nwin"], p["weight"], p["many"], piece))
                        held += len(piece)
                    if held > 8 << 20:
                        yield _table(_SEGMENTS, out)
                        out, held = [], 0
        yield _table(_SEGMENTS, out)

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` ordered by at least the first ``depth`` bytes that follow, by doubling."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(first)
    first = first[order]
    fresh = np.r_[True, first[1:] != first[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    have = 8
    while True:
        starts = np.flatnonzero(fresh)
        rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
        if have >= depth or len(starts) == n:
            return order
        alone = fresh & np.r_[fresh[1:], True]
        open_ = np.flatnonzero(~alone)
        at = order[open_]
        both = rank[at] * (n + 1) + rank[np.minimum(at + have, n)] + 1
        by = np.argsort(both)
        order[open_] = at[by]
        both = both[by]
        fresh[open_] = np.r_[True, both[1:] != both[:-1]]
        have *= 2


def common_prefix_classes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Class numbers along ``order``: neighbours share one if they agree in ``depth`` bytes.

    ``text`` holds bytes plus one, and zeros that end strings and match nothing. Breadth-first
    backward extension: level by level, the intervals whose right boundary was new are
    extended by all bytes that precede their suffixes.
    """
    n = len(text)
    before = text[order - 1]  # the transform; text ends with a zero, which precedes its start
    step = np.empty(n, np.int32)  # where the suffix one byte longer stands
    step[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    lead = np.zeros(n + 1, np.uint8)
    lead[:n] = text[order]
    owner = np.full(n + 2, -1, np.int32)  # at place + 1: the interval whose extension holds it
    found = np.zeros(n + 1, bool)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    found[0] = found[n] = True
    found[ends] = True
    used = np.flatnonzero(counts[1:]) + 1
    low, high = (ends[used] - counts[used]).astype(np.int32), (ends[used] - 1).astype(np.int32)
    names = 0
    for _ in range(1, depth):
        sizes = high - low + 1
        which = np.repeat(np.arange(names, names + len(low), dtype=np.int32), sizes)
        before_it = np.cumsum(sizes, dtype=np.int32) - sizes
        place = np.arange(sizes.sum(), dtype=np.int32) + np.repeat(low - before_it, sizes)
        keep = before[place] != 0
        to, which = step[place[keep]], which[keep]
        names += len(low)
        owner[to + 1] = which
        own = lead[to]
        is_high = (owner[to + 2] != which) | (lead[to + 1] != own)
        is_low = (owner[to] != which) | (lead[to - 1] != own)
        high, low = np.sort(to[is_high]), np.sort(to[is_low])
        new = ~found[high + 1]
        low, high = low[new], high[new]
        if not len(low):
            break
        found[high + 1] = True
    return np.cumsum(found[:n])


def repeated_windows(bodies: list[bytes], weights: list[int], min_bytes: int) -> list[list[tuple[int, int]]]:
    """For each string, the runs [from, to) of windows that occur at least twice among all, by weight."""
    parts, at = [], 0
    starts = []
    for b in bodies:
        parts += [np.frombuffer(b, np.uint8) + np.uint8(1), np.zeros(1, np.uint8)]
        starts.append(at)
        at += len(b) + 1
    text = np.concatenate(parts)
    weight = np.zeros(len(text), np.float64)
    for s, b, w in zip(starts, bodies, weights, strict=True):
        weight[s : s + len(b) - min_bytes + 1] = w
    order = suffix_order(text, min_bytes)
    classes = common_prefix_classes(text, order, min_bytes)
    total = np.bincount(classes, weights=weight[order])
    repeated = np.zeros(len(text) + 1, bool)
    repeated[order] = total[classes] >= 2
    repeated[:-1] &= weight > 0
    edges = np.flatnonzero(np.diff(np.r_[False, repeated]))
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    owner = np.searchsorted(starts, edges[::2], side="right") - 1
    for k, i, j in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[k].append((i - starts[k], j - starts[k]))
    return out


_SPAN = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
_FOUND = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("nwin", pa.int32()), ("runs", _SPAN)])
FOUND_DDL = "key long, seg long, nwin int, runs array<struct<i: int, j: int>>"


def _expand(min_bytes: int, chunk: int):
    """Segments sorted by key to their repeated windows; a chunk ends where a key does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def done() -> pa.RecordBatch:
            found = repeated_windows([r[4] for r in rows], [r[3] for r in rows], min_bytes)
            out = [
                (*r[:3], [{"i": i, "j": j} for i, j in runs]) for r, runs in zip(rows, found, strict=True) if runs
            ]
            return _table(_FOUND, out)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = [part.column(c).to_pylist() for c in ("key", "seg", "nwin", "weight", "body")]
                for row in zip(*columns, strict=True):
                    if held >= chunk and row[0] != last:
                        yield done()
                        rows, held = [], 0
                    rows.append(row)
                    held += len(row[4])
                    last = row[0]
        if rows:
            yield done()

    return run


RANGES_DDL = "key long, seg long, nwin int, weight long, name long, form long, n int, offs array<int>"
_RANGES = pa.schema(
    [
        ("key", pa.int64()),
        ("seg", pa.int64()),
        ("nwin", pa.int32()),
        ("weight", pa.int64()),
        ("name", pa.int64()),
        ("form", pa.int64()),
        ("n", pa.int32()),
        ("offs", pa.list_(pa.int32())),
    ]
)


def window_ranges(body: bytes, key: int, parts: list[tuple[int, int]], width: int, min_bytes: int, anchors: np.ndarray):
    """{(name, form, n): offsets}: the windows of a segment in ranges of ``width`` distances.

    A window's distance is that to the first of ``anchors``, the places of the naming gram, in
    it. ``parts`` are (offset, windows) to look at. The name is a hash of the bytes that all
    windows of such a range share, the form one of the bytes that those present span.
    """
    found: dict[tuple[int, int, int], list[int]] = {}
    digest, sign = xxhash.xxh3_64_intdigest, 1 << 63
    for off, n in parts:
        starts = np.arange(off, off + n)
        anchor = anchors[np.searchsorted(anchors, starts)]
        block = (anchor - starts) // width
        edges = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
        for i, j in zip(edges.tolist(), np.r_[edges[1:], n].tolist(), strict=True):
            last = int(anchor[i]) - int(block[i]) * width  # where the range's last window would start
            core = body[last : last - width + 1 + min_bytes]
            name = digest(core, (key + int(block[i]) * 2 * width) % (2 * sign)) - sign
            span = body[off + i : off + j - 1 + min_bytes]
            form = digest(span, int(anchor[i]) - off - i) - sign
            found.setdefault((name, form, j - i), []).append(off + i)
    return found


def _ranges(width: int, min_bytes: int, gram: int):
    """Segments (key, seg, nwin, weight, body, parts) to their ranges; equal ones of a segment are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = GramHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    h = hasher(np.frombuffer(r["body"], np.uint8), gram)
                    anchors = np.flatnonzero(h.view(np.int64) == r["key"])
                    parts = [(p["off"], p["n"]) for p in r["parts"]]
                    ranges = window_ranges(r["body"], r["key"], parts, width, min_bytes, anchors)
                    out += [(r["key"], r["seg"], r["nwin"], r["weight"], *k, offs) for k, offs in ranges.items()]
                yield _table(_RANGES, out)

    return run


def _expanded(cut: DataFrame, min_bytes: int, chunk: int) -> DataFrame:
    """The repeated windows (key, seg, nwin, runs) of segments, each name in one task."""
    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(_expand(min_bytes, chunk), FOUND_DDL)


def _whole(groups: DataFrame) -> DataFrame:
    """As ``_expanded``, for segments that are alone under their names and occur twice: every window is repeated."""
    run = F.struct(F.lit(0).alias("i"), F.col("nwin").alias("j"))
    return groups.select("key", "seg", "nwin", F.array(run).alias("runs"))


def _dealt_anew(segments: DataFrame, min_bytes: int, gram: int, most: int, chunk: int) -> list[DataFrame]:
    """Frames as of ``_expanded`` for the segments (key, seg, nwin, weight, body) of names with more than ``most``."""
    place = ["key", "seg", "nwin"]
    every = F.array(F.struct(F.lit(0).alias("off"), F.col("nwin").alias("n")))
    pending, found = segments.withColumn("parts", every), []
    for width in RANGES:
        ranges = durable(
            pending.select(*place, "weight", "body", "parts").mapInArrow(_ranges(width, min_bytes, gram), RANGES_DDL)
        )
        groups = ranges.groupBy("name", "form", "n").agg(
            F.sum(F.col("weight") * F.size("offs")).alias("weight"),
            F.min(F.struct(*place, F.col("offs")[0].alias("start"))).alias("rep"),
        )
        names = groups.groupBy("name").agg(F.sum("weight").alias("total"), F.count("*").alias("forms"))
        groups = groups.join(names.where("total > 1"), "name").select(
            F.col("name").alias("key"), F.col("form").alias("seg"), F.col("n").alias("nwin"), "weight", "rep", "forms"
        )
        groups = durable(groups)
        few = groups.where(F.col("forms").between(2, most))
        parts = few.groupBy(*[F.col(f"rep.{c}").alias(c) for c in place]).agg(
            F.collect_list(F.struct(F.col("rep.start").alias("start"), *place, "weight", F.lit(False).alias("many"))).alias("parts")
        )
        cut = segments.select(*place, "body").join(parts, place).select("body", "parts")
        done = durable(
            _whole(groups.where("forms = 1")).unionByName(
                _expanded(cut.mapInArrow(_extract(min_bytes), SEGMENTS_DDL), min_bytes, chunk)
            )
        )
        done = done.select(F.col("key").alias("name"), F.col("seg").alias("form"), F.col("nwin").alias("n"), "runs")
        moved = F.transform(
            "offs", lambda o: F.transform("runs", lambda r: F.struct((r["i"] + o).alias("i"), (r["j"] + o).alias("j")))
        )
        found.append(ranges.join(done, ["name", "form", "n"]).select(*place, F.flatten(moved).alias("runs")))
        still = durable(groups.where(F.col("forms") > most).select(F.col("key").alias("name")).distinct())
        if still.isEmpty():
            break
        parts = (
            ranges.join(still, "name", "left_semi")
            .select(*place, "n", F.explode("offs").alias("off"))
            .groupBy(*place)
            .agg(F.collect_list(F.struct("off", "n")).alias("parts"))
        )
        pending = segments.join(parts, place)
    return found


def _cut(min_bytes: int):
    """Rows (uid, body, parts) to merged spans and the bytes outside them."""
    schema = pa.schema(
        [
            ("uid", pa.binary()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("kept", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = []
                for row in batch.slice(at, 128).to_pylist():
                    cover = sorted(
                        (p["start"] + r["i"], p["start"] + r["j"] - 1 + min_bytes) for p in row["parts"] for r in p["runs"]
                    )
                    spans: list[list[int]] = []
                    for i, j in cover:
                        if spans and i <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], j)
                        else:
                            spans.append([i, j])
                    kept, last = [], 0
                    for i, j in spans:
                        kept.append(row["body"][last:i])
                        last = j
                    kept.append(row["body"][last:])
                    out.append((row["uid"], [{"start": i, "end": j} for i, j in spans], b"".join(kept)))
                yield _table(schema, out)

    return run


CUT_DDL = "uid binary, spans array<struct<start: long, end: long>>, kept binary"


def text_uid(text_col: str = "text"):
    """The 16 bytes that stand for a text in this operator's joins: the MD5 of its UTF-8."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    gram: int = GRAM,
    many_segments: int = MANY_SEGMENTS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(uid, spans, kept) for each distinct text of ``docs`` with a repeated string.

    Spans are the maximal runs [start, end) of bytes covered by a string of ``min_bytes``
    bytes that also starts anywhere else, in the same row or another (rows with equal texts
    included); kept is the other bytes, concatenated. ``text_uid`` of a row's text finds its
    result; texts without one have no repeats. Null texts are empty; rows may lack or share
    identifiers, which only serve to fetch one bearer of a text; other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    bodies = docs.select(
        text_uid(text_col).alias("uid"), F.col(id_col).cast("long").alias("lead"), body.alias("body")
    ).where(F.length("body") >= min_bytes)
    runs = durable(bodies.mapInArrow(_runs(min_bytes, gram), RUNS_DDL))
    names = durable(
        runs.groupBy("key").agg(F.sum("anchors").alias("anchors")).where("anchors > 1").select("key")
    )
    place = ["key", "seg", "nwin"]
    groups = durable(
        runs.join(names, "key", "left_semi")
        .groupBy(*place)
        .agg(F.count("*").alias("weight"), F.min(F.struct("uid", "start", "lead")).alias("rep"))
    )
    sizes = groups.groupBy("key").agg(F.count("*").alias("segs"))
    groups = durable(groups.join(sizes, "key"))
    alone = (F.col("segs") == 1) & (F.col("weight") > 1)
    parts = groups.where(~alone).groupBy(F.col("rep.uid").alias("uid"), F.col("rep.lead").alias("lead")).agg(
        F.collect_list(F.struct(F.col("rep.start").alias("start"), *place, "weight", (F.col("segs") > many_segments).alias("many"))).alias("parts")
    )
    b, p = bodies.alias("b"), parts.alias("p")
    own = (F.col("b.uid") == F.col("p.uid")) & F.col("b.lead").eqNullSafe(F.col("p.lead"))
    segments = durable(
        b.join(p, own).select("b.body", "p.parts").mapInArrow(_extract(min_bytes), SEGMENTS_DDL)
    )
    found = [_whole(groups.where(alone)), _expanded(segments.where("not many"), min_bytes, chunk)]
    found += _dealt_anew(segments.where("many"), min_bytes, gram, many_segments, chunk)
    found = durable(reduce(DataFrame.unionByName, found))
    covered = durable(
        runs.join(found, place)
        .groupBy("uid")
        .agg(F.collect_set(F.struct("start", "runs")).alias("parts"), F.min("lead").alias("lead"))
    )
    c = covered.alias("c")
    own = (F.col("b.uid") == F.col("c.uid")) & F.col("b.lead").eqNullSafe(F.col("c.lead"))
    # Rows that share identifier and text come out once for each; their results are equal.
    return b.join(c, own).select("b.uid", "b.body", "c.parts").mapInArrow(_cut(min_bytes), CUT_DDL)


def removal_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cut = repeated_spans(docs, id_col, text_col, min_bytes).select(
        "uid",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("sha"),
    )
    cut = durable(cut.dropDuplicates(["uid"]))
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text_uid(text_col).alias("uid"),
        F.length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("whole"),
    )
    return rows.join(cut, "uid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )
