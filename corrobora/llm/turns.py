"""Repair of conversations: faults found, cheapest edits chosen, rows written out in order.

A repaired conversation is empty or an optional system row followed by user and assistant in
turn. Edits, cheapest first in sum and, of equal sums, the ASCII-least string of initials:
Keep 0, Rerole 1, Delete 2 (blank and duplicate rows must go), Insert 5; a truncated row that
stays adds 5.

The costs to go from each of four states (nothing yet, after system, after user, after
assistant) make a vector that a row carries one step back. Rows are ordered by range, so a
conversation of any length spreads over tasks; there it is cut into blocks that grow by a
constant, so that n rows make about sqrt(n) blocks of at most about sqrt(n) rows. Each block's
table of costs between states goes, without texts, to the conversation's task, which runs
backward over the blocks and keeps the vector at each block's end: the checkpoints. A second
run streams the rows forward, recomputes the vectors of one block from its checkpoint, walks
it, and hashes or hands on the repaired rows. It holds one block's kinds (a byte a row) and no
texts. A conversation's rows pass through one task there, as a hash over all of them must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import Collector, durable, rows_of

#: Blocks of a conversation have this many rows more, one after the other.
GROWTH = 16
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Kinds: role (0 other, 1 system, 2 user, 3 assistant) and one fault.
BLANK, DUPLICATE, CUT = 4, 8, 16
_FAULTS = BLANK | DUPLICATE
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; what a rerole or an insert leads to.
_NEXT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_FAR = 1 << 60
_END = (0, 2 * INSERT, INSERT, 0)


def _kept(state: int, role: int) -> int:
    """The state after keeping a row, or -1 where its role cannot stand."""
    if role == 1:
        return 1 if state == 0 else -1
    return role if role and _NEXT[state] == role else -1


def _edits(state: int, kind: int) -> list[tuple[str, int, int]]:
    """Edits of a row (initial, cost, next state), in ASCII order."""
    edits = [("D", DELETE, state)]
    if not kind & _FAULTS:
        stays = TRUNCATED if kind & CUT else 0
        kept = _kept(state, kind & 3)
        if kept >= 0:
            edits.append(("K", stays, kept))
        edits.append(("R", stays + REROLE, _NEXT[state]))
    return edits


_TABLE = {kind: tuple(tuple(_edits(s, kind)) for s in range(4)) for kind in (r | f for r in range(4) for f in (0, BLANK, DUPLICATE, CUT))}


def back(after: tuple, kind: int) -> tuple:
    """The costs to go before a row of this kind, given those after it; inserts may come first."""
    base = [min(cost + after[to] for _, cost, to in edits) for edits in _TABLE[kind]]
    return tuple(min(base[s], INSERT + base[_NEXT[s]], 2 * INSERT + base[_NEXT[_NEXT[s]]]) for s in range(4))


def between(kinds: bytes) -> list[int]:
    """The costs from each state before a block to each state after it, row by row of 4 x 4."""
    ends = []
    for t in range(4):
        v = tuple(0 if s == t else _FAR for s in range(4))
        for kind in reversed(kinds):
            v = back(v, kind)
        ends.append(v)
    return [min(ends[t][s], _FAR) for s in range(4) for t in range(4)]


def over(table: list[int], after: tuple) -> tuple:
    """The costs to go before a block, given those after it."""
    return tuple(min(table[4 * s + t] + after[t] for t in range(4)) for s in range(4))


class _Walk:
    """Goes forward over one conversation, block by block."""

    def __init__(self):
        self.state, self.costs, self.at, self.cost = 0, [_END], 0, 0
        self.kinds = b""

    def block(self, after: Iterable[int], kinds: bytes) -> None:
        costs = [tuple(after)]
        for kind in reversed(kinds):
            costs.append(back(costs[-1], kind))
        self.costs, self.kinds, self.at = costs[::-1], kinds, 0

    def _inserts(self) -> Iterator[tuple[str, str | None]]:
        here = self.costs[self.at]
        while self.at == len(self.kinds) or not self._deletes():
            to = _NEXT[self.state]
            if here[self.state] != INSERT + here[to]:
                return
            self.state = to
            self.cost += INSERT
            yield "I", _NAMES[to]

    def _deletes(self) -> bool:
        return self.costs[self.at][self.state] == DELETE + self.costs[self.at + 1][self.state]

    def row(self) -> Iterator[tuple[str, str | None]]:
        """Edits up to and with the next row: (initial, role it gets or None for its own)."""
        yield from self._inserts()
        here, after = self.costs[self.at], self.costs[self.at + 1]
        for edit, cost, to in _TABLE[self.kinds[self.at]][self.state]:
            if here[self.state] == cost + after[to]:
                break
        self.state = to
        self.cost += cost
        self.at += 1
        yield edit, _NAMES[to] if edit == "R" else None

    def end(self) -> Iterator[tuple[str, str | None]]:
        self.costs, self.kinds, self.at = [_END], b"", 0
        yield from self._inserts()


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20: (conv_id, turn, role, text, gone).

    0 drops a row (it stays as a mark with gone true), 1 empties its text, 2 removes . ! ?
    from it, 3 repeats it, 4 sets its role to user. Nulls count as one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault, text, role = F.crc32(name) % 20, F.coalesce("text", space), F.coalesce("role", space)
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    changed = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their kind, in order over all partitions; conversations without rows have one of kind -1."""
    lived = rows.where(~F.col("gone")).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    bare = F.expr(r"rtrim(' \t\n\u000B\u000C\r', text)")
    role = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    fault = F.when(bare == "", BLANK).when(F.col("times") > 1, DUPLICATE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT)
    marked = lived.withColumn("times", F.row_number().over(same)).withColumn("kind", role + fault)
    lost = rows.where("gone").select("conv_id").distinct()
    none = {c: F.lit(None).cast(marked.schema[c].dataType) for c in ("turn", "role", "text")}
    both = marked.unionByName(lost.withColumns(none | {"kind": F.lit(-1), "times": F.lit(0)}))
    # Texts that open alike within a turn and role stay together, so that the range needs no whole texts.
    start = F.substring("text", 1, 64)
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role")]
    return both.repartitionByRange(*keys, start.asc_nulls_first()).sortWithinPartitions(*keys, F.asc_nulls_first("text"), "times")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their block (part, block, at); each block has a row of its own before them, with its kinds and table."""
    plain = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role", "text"))
    schema = f"{plain}, part int, block long, at long, kind int, kinds binary, costs array<long>"
    names = ["conv_id", "turn", "role", "text", "part", "block", "at", "kind", "kinds", "costs"]
    fixed = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        out: Collector | None = None
        conv, kinds, most = None, bytearray(), GROWTH

        def close() -> None:
            nonlocal block
            if kinds:
                out.add((conv, None, None, None, part, block, -1, None, bytes(kinds), between(bytes(kinds))))
                kinds.clear()
                block += 1

        for batch in batches:
            if out is None:
                types = [batch.schema.field(c).type for c in names[:4]] + fixed
                out = Collector(pa.schema(list(zip(names, types, strict=True))))
            for c, turn, role, text, kind in rows_of([batch], [*names[:4], "kind"]):
                if c != conv or len(kinds) >= most:
                    close()
                    conv, most = c, GROWTH if c != conv else most + GROWTH
                if kind < 0:
                    out.add((c, None, None, None, part, block, -3, kind, None, None))
                else:
                    out.add((c, turn, role, text, part, block, len(kinds), kind, None, None), len(text))
                    kinds.append(kind)
                if out.full:
                    yield out.take()
        if out is not None:
            close()
            yield out.take()

    return rows.select("conv_id", "turn", "role", "text", "kind").mapInArrow(run, schema)


def _checkpoints(placed: DataFrame) -> DataFrame:
    """(conv_id, part, block, costs): the costs to go after each block, found backward."""
    blocks = placed.where("at = -1").select("conv_id", "part", "block", "costs")
    order = ["conv_id", F.desc("part"), F.desc("block")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after, begun = None, _END, False
        for batch in batches:
            found = []
            for c, table in rows_of([batch], ["conv_id", "costs"]):
                if not begun or c != conv:
                    conv, after, begun = c, _END, True
                found.append(list(after))
                after = over(table, after)
            yield batch.set_column(3, "costs", pa.array(found, pa.list_(pa.int64())))

    return blocks.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, blocks.schema)


def _forward(rows: DataFrame) -> DataFrame:
    """Each conversation's checkpoints, blocks and rows in order, in one partition."""
    placed = durable(_placed(_ordered(rows)))
    marks = _checkpoints(placed)
    rest = {c: F.lit(None).cast(placed.schema[c].dataType) for c in ("turn", "role", "text", "kind", "kinds")}
    marks = marks.withColumns(rest | {"at": F.lit(-2).cast("long")}).select(placed.columns)
    both = placed.withColumn("costs", F.when(F.col("at") == -2, F.col("costs"))).unionByName(marks)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "at")


_READ = ["conv_id", "turn", "role", "text", "at", "kind", "kinds", "costs"]


class _Report:
    """What is told of one conversation, gathered as its rows pass."""

    def __init__(self):
        self.walk, self.hash, self.lines, self.audit = _Walk(), hashlib.sha256(), 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def _edits(self, edits: Iterator[tuple[str, str | None]], role: str, text: str) -> None:
        for edit, new in edits:
            self.audit.append(edit)
            if edit != "D":
                line = f"{new}:" if edit == "I" else f"{new or role}:{text}"
                self.hash.update((("\n" if self.lines else "") + line).encode())
                self.lines += 1

    def row(self, turn, role: str, text: str, kind: int) -> None:
        self.blank += bool(kind & BLANK)
        self.duplicate += bool(kind & DUPLICATE)
        self.truncated += bool(kind & CUT)
        role_kind = kind & 3
        self.illegal += self.before is not None and (self.before, role_kind) not in ((1, 2), (2, 3), (3, 2))
        self.before = role_kind
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self._edits(self.walk.row(), role, text)

    def end(self) -> tuple:
        self._edits(self.walk.end(), "", "")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        told = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.walk.cost)
        return (*told, "".join(self.audit), self.hash.hexdigest())


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text and gone (see ``damage``); other columns are ignored.
    Rows go by turn, nulls first, then role and text. A null role or text is one space; rows
    without conv_id are one conversation. A row's first fault counts: blank, duplicate (role
    and text seen earlier), truncated (it does not end with . ! ?). Of repeated rows all but
    the first are duplicates. A conversation whose rows are all gone has zeros, an empty audit
    and the hash of nothing; an empty table gives no rows. The audit has a character a row, so
    a conversation is bound by the size of one value.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *numbers, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Collector | None = None
        conv, told = None, None
        for batch in batches:
            if out is None:
                types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                out = Collector(pa.schema(list(zip(names, types, strict=True))))
            for c, turn, role, text, at, k, kinds, costs in rows_of([batch], _READ):
                if told is None or c != conv:
                    if told is not None:
                        out.add((conv, *told.end()))
                    conv, told = c, _Report()
                if at == -2:
                    after = costs
                elif at == -1:
                    told.walk.block(after, kinds)
                elif at >= 0:
                    told.row(turn, role, text, k)
                if out.full:
                    yield out.take()
        if told is not None:
            out.add((conv, *told.end()))
            yield out.take()

    schema = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in numbers) + ", audit string, repaired_sha256 string"
    return _forward(rows).select(_READ).mapInArrow(run, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the repaired rows in order, with the edit that made each.

    Takes what ``repair_report`` takes, with the same rules. Inserted rows have no turn and an
    empty text; deleted rows do not come.
    """
    typed = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["conv_id", "position", "edit", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Collector | None = None
        conv, walk, position = None, None, 0

        def put(edits: Iterator[tuple[str, str | None]], turn, role: str, text: str) -> None:
            nonlocal position
            for edit, new in edits:
                if edit != "D":
                    position += 1
                    made = (None, new, "") if edit == "I" else (turn, new or role, text)
                    out.add((conv, position, edit, *made), len(text))

        for batch in batches:
            if out is None:
                of = {c: batch.schema.field(c).type for c in ("conv_id", "turn")}
                out = Collector(pa.schema([(n, of.get(n, pa.int64() if n == "position" else pa.string())) for n in names]))
            for c, turn, role, text, at, _, kinds, costs in rows_of([batch], _READ):
                if walk is None or c != conv:
                    if walk is not None:
                        put(walk.end(), None, "", "")
                    conv, walk, position = c, _Walk(), 0
                if at == -2:
                    after = costs
                elif at == -1:
                    walk.block(after, kinds)
                elif at >= 0:
                    put(walk.row(), turn, role, text)
                if out.full:
                    yield out.take()
        if walk is not None:
            put(walk.end(), None, "", "")
            yield out.take()

    schema = f"conv_id {typed['conv_id']}, position long, edit string, turn {typed['turn']}, role string, text string"
    return _forward(rows).select(_READ).mapInArrow(run, schema)
