"""Exact deduplication with Patricia-trie owners.

Every text is cast to its bytes and dealt by (length, content hash). A partition inserts
the full byte strings into a compressed radix trie whose terminal nodes keep the owner of
the string (smallest or largest identifier) and its number of copies, so two texts are
equal only if all their bytes are. Map tasks run the same trie first, so that a group of
copies that holds a third of all rows reaches its partition as one row per map task. A trie
that outgrows its budget hands its largest subtrees on as rows for another round (the spill
by subtree): these go through Spark's shuffle, so an executor can be lost at any time. The
subtrees are those under the first fork, so a prefix that all texts share does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import Collector, durable

#: Memory of a node besides its label, and with the mark of a string, about.
NODE_BYTES = 450
TRIE_BYTES = 256 << 20

OWNERS_DDL = "length long, hash long, sha binary, body binary, owner long, tie long, copies long, rest {rest}, spilled boolean"
_INPUT = ("length", "hash", "sha", "body", "owner", "tie", "copies", "rest")


@dataclass(slots=True)
class Mark:
    """What a terminal node keeps: a tag, the owner (its tie-break and other columns) and the number of copies."""

    tag: object
    owner: int | None
    copies: int = 1
    tie: int = 0
    rest: object = None


class PatriciaTrie:
    """A compressed radix trie over byte strings; a terminal node keeps a ``Mark``.

    A node is [label, children by first byte, mark]; where a subtree has been handed on, its
    place among the children is held by ``None``. ``size`` counts labels and nodes.
    """

    def __init__(self, largest: bool):
        self.largest = largest
        self.root = [b"", {}, None]
        self.size = 0

    def add(self, key: bytes, mark: Mark) -> bool:
        """Insert ``key``; False if its subtree has been handed on."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at], self)
            if child is None:
                return False
            if child is self:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.size += end - at + NODE_BYTES
            elif not key.startswith(child[0], at):
                child = self._split(node, child, key, at)
                self.size += NODE_BYTES
            node, at = child, at + len(child[0])
        if node[2] is None:
            node[2] = mark
        else:
            node[2] = self._joined(node[2], mark)
        return True

    def _joined(self, a: Mark, b: Mark) -> Mark:
        """The mark of the better owner: one with an identifier, the largest (smallest), then the smallest tie."""
        sign = -1 if self.largest else 1
        order = lambda m: (m.owner is None, sign * (m.owner or 0), m.tie)
        copies = a.copies + b.copies
        best = b if order(b) < order(a) else a
        best.copies = copies
        return best

    @staticmethod
    def _split(node, child, key: bytes, at: int):
        """Put a new node where ``child``'s label stops agreeing with ``key``."""
        label, low = child[0], 1
        high = min(len(label), len(key) - at)
        while low < high:  # the longest agreeing prefix, by halving
            mid = (low + high + 1) // 2
            low, high = (mid, high) if key.startswith(label[:mid], at) else (low, mid - 1)
        fork = node[1][key[at]] = [label[:low], {label[low]: child}, None]
        child[0] = label[low:]
        return fork

    def terminals(self, top=None, prefix: bytes = b"") -> Iterator[tuple[bytes, Mark]]:
        stack = [(top or self.root, prefix)]
        while stack:
            node, path = stack.pop()
            path += node[0]
            if node[2] is not None:
                yield path, node[2]
            stack += [(child, path) for child in node[1].values() if child is not None]

    @staticmethod
    def _size(top) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node[0]) + NODE_BYTES
            stack += [child for child in node[1].values() if child is not None]
        return total

    def hand_on(self, most: int) -> Iterator[tuple[bytes, Mark]]:
        """Cut subtrees off, the largest first, until ``size`` is at most ``most``; yield their strings.

        They hang on the first node that ends a string or forks, whatever prefix all strings
        share; when only one string is left, it stays.
        """
        while self.size > most:
            node, path = self.root, b""
            while True:
                live = [byte for byte, child in node[1].items() if child is not None]
                if len(live) != 1 or node[2] is not None:
                    break
                node = node[1][live[0]]
                path += node[0]
            sizes = {byte: self._size(node[1][byte]) for byte in live}
            for byte in sorted(sizes, key=lambda x: (-sizes[x], -x)):  # the one that may stay comes last, also among equals
                if self.size <= most or (node[2] is None and byte == min(sizes, key=lambda x: (sizes[x], x)) and len(sizes) > 1):
                    break
                yield from self.terminals(node[1][byte], path)
                node[1][byte] = None
                self.size -= sizes[byte]
            else:
                if not sizes or node[2] is not None:
                    return  # one string is left


def _owners(largest: bool, budget: int, final: bool, bodies: bool):
    """mapInArrow function: rows (length, hash, sha, body, owner, tie, copies, rest) to one per string.

    ``final``: spill by subtree, and drop the bodies unless ``bodies``. Otherwise a full trie is
    emptied and begun anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = None, PatriciaTrie(largest)

        def put(body: bytes, m: Mark, whole: bool, spilled: bool) -> None:
            row = (*m.tag, body if whole else None, m.owner, m.tie, m.copies, m.rest, spilled)
            out.add(row, len(body) if whole else 64)

        for batch in batches:
            out = out or Collector(batch.schema.append(pa.field("spilled", pa.bool_())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(c).to_pylist() for c in _INPUT]
                for length, hashed, sha, body, owner, tie, copies, rest in zip(*columns, strict=True):
                    mark = Mark((length, hashed, sha), owner, copies, tie, rest)
                    if not trie.add(body, mark):
                        put(body, mark, True, True)
                if trie.size > budget:
                    # Half goes, so that the next spill is not at hand.
                    gone = trie.hand_on(budget // 2) if final else trie.terminals()
                    for body, mark in gone:
                        put(body, mark, True, final)
                        if out.full:
                            yield out.take()
                    if not final:
                        trie = PatriciaTrie(largest)
                if out.full:
                    yield out.take()
        if out is None:
            return
        for body, mark in trie.terminals():
            put(body, mark, bodies or not final, False)
            if out.full:
                yield out.take()
        yield out.take()

    return run


def _settled(docs: DataFrame, text_col: str, owner, tie, rest, keep: str, trie_bytes: int, bodies: bool) -> DataFrame:
    """Rows (length, hash, sha, body, owner, tie, copies, rest), one for each distinct text. A durable frame."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.length(body).cast("long").alias("length"),
        F.xxhash64(body).alias("hash"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
        body.alias("body"),
        owner.cast("long").alias("owner"),
        tie.cast("long").alias("tie"),
        F.lit(1).cast("long").alias("copies"),
        rest.alias("rest"),
    )
    ddl = OWNERS_DDL.format(rest=rows.schema["rest"].dataType.simpleString())
    pending = rows.mapInArrow(_owners(keep == "max", trie_bytes, False, True), ddl)
    done, wide = None, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        pending = pending.drop("spilled")
        dealt = pending.repartition("length", "hash") if done is None else pending.repartition(wide, "length", "hash")
        found = durable(dealt.mapInArrow(_owners(keep == "max", trie_bytes, True, bodies), ddl))
        wide *= 2  # what was spilled is dealt to more tasks; each keeps one string at least, so the rounds end
        settled = found.where("not spilled").drop("spilled")
        done = settled if done is None else done.unionByName(settled)
        pending = found.where("spilled")
        if pending.isEmpty():
            return done


def text_owners(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per distinct text: sha (SHA-256 of its UTF-8), owner, copies. A durable frame.

    A null text is the empty text; an owner is null only if all copies lack an identifier.
    """
    nothing = F.lit(None).cast("int")
    found = _settled(docs, text_col, F.col(id_col), F.lit(0), nothing, keep, trie_bytes, False)
    return found.select("sha", "owner", "copies")


def distinct_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """Whole rows of ``docs``, one for each distinct text. A durable frame.

    The row with the largest identifier stays (``keep='min'``: the smallest), one without an
    identifier only if all copies lack one; rows that tie there are told apart by a hash of
    all columns. Null and empty texts are equal, and the row that stays keeps its own. The
    rows travel with their texts, so that texts are shuffled once and nothing is joined.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Numbered, as names may hold any character.
    rest = F.struct(
        F.col(text_col).isNull().alias("none"),
        *[c.alias(f"c{i}") for i, (c, name) in enumerate(zip(columns, docs.columns, strict=True)) if name != text_col],
    )
    found = _settled(docs, text_col, F.col(id_col), F.xxhash64(*columns), rest, keep, trie_bytes, True)
    text = F.when(~F.col("rest.none"), F.col("body").cast("string"))
    return found.select(
        *[(text if name == text_col else F.col(f"rest.c{i}")).alias(name) for i, name in enumerate(docs.columns)]
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when all their bytes are (null counts as empty). Of equal texts the row
    with the largest identifier stays (``keep='min'``: the smallest). Rows that repeat both
    identifier and text are the same document and share its fate; in a group where no row has
    an identifier, keep_id is null and all rows stay. Input columns of the four output names
    are replaced. An empty table gives an empty result.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    groups = text_owners(docs, id_col, text_col, keep, trie_bytes).where("copies > 1")
    groups = groups.select(F.col("sha").alias("__sha"), F.col("owner").alias("__owner"), F.col("copies").alias("__copies"))
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    own = F.col(id_col).cast("long")
    return (
        docs.withColumn("__sha", sha)
        .join(groups, "__sha", "left")
        .select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.when(F.col("__copies").isNull(), own).otherwise(F.col("__owner")).alias("keep_id"),
            F.coalesce("__copies", F.lit(1)).cast("long").alias("group_size"),
            (F.col("__copies").isNull() | own.eqNullSafe(F.col("__owner"))).alias("kept"),
            F.lower(F.hex(F.col("__sha"))).alias("text_sha256"),
        )
    )
