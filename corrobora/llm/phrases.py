"""Collocations of two to ``size`` words from a weighted de Bruijn graph of phrases.

Edges are the longest phrases, of ``size`` words; each leads from the node of its first
words to the node of its last ones. One shuffle sums them, dealt by the node they leave and
sorted; pieces that end before ``size`` words add shorter rows, the corrections. The flow out
of a node and its corrections give the node's own count, and so on for each shorter prefix,
all in one pass over the sorted rows that holds one row at a time. Only what is frequent goes
on. Nodes through which a single phrase passes whole are unary: edges that meet there have the
node's count and are linked, and pointer doubling joins them into paths. Inside a path every
count is the path's own, so only its two ends are looked up.

Rows are counted in tasks before they are shuffled, so a phrase that is in every text arrives
as one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import durable, rows_of

#: A task counts so many words, or different words, before it hands their phrases on.
POSITIONS, WORDS = 2_000_000, 1_000_000
#: Parts of a language that are ranked alone before its best phrases are.
SALTS = 64
_END = b"."
#: Between a node's words and its language; line ends part pieces, so no word holds one.
_LANG = "\n"
#: A-Z to lower case; marks and line ends that part pieces to one of them.
_TABLE = bytes(
    _END[0] if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def _grams(words: np.ndarray, size: int, known: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct runs of up to ``size`` words from each place (0 ends a piece and fills), and how often each comes."""
    at = np.flatnonzero(words)
    padded = np.concatenate([words, np.zeros(size, words.dtype)])
    columns = [words[at]]
    for k in range(1, size):
        columns.append(np.where(columns[-1] > 0, padded[at + k], 0))
    code, span = columns[0].astype(np.int64), known
    for c in columns[1:]:
        if span * known >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code, span = code * known + c, span * known
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return [c[first] for c in columns], counts


class _Counter:
    """Phrases of one task, by language, until they are handed on."""

    def __init__(self, size: int):
        self.size = size
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {_END: 0}
        self.seen: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        words = text.encode().translate(_TABLE).replace(_END, b" . ").split()
        numbers = self.numbers
        found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
        self.seen.setdefault(lang, []).append(np.append(found, np.int32(0)))
        self.held += len(words)

    @property
    def full(self) -> bool:
        return self.held >= POSITIONS or len(self.numbers) >= WORDS

    def take(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        for lang, runs in self.seen.items():
            columns, counts = _grams(np.concatenate(runs), self.size, len(self.numbers))
            for i in range(0, len(counts), 1 << 16):
                part = [c[i : i + (1 << 16)] for c in columns]
                n = len(part[0])
                *first, last = [words.take(pa.array(c, mask=c == 0)) for c in part]
                node = pc.binary_join_element_wise(*first, " ", null_handling="skip")
                node = pc.binary_join_element_wise(node, pa.scalar(lang), _LANG)
                yield pa.RecordBatch.from_arrays([node, last, pa.array(counts[i : i + n], pa.int64())], names=["node", "last", "n"])
        self._clear()


def _summed(keys: pa.Array, sums: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    coded = keys.dictionary_encode()
    out = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(out, coded.indices.to_numpy(), sums)
    return coded.dictionary, out


class _Flow:
    """Sums of edges and nodes over sorted rows; what a batch leaves open goes on in the next."""

    def __init__(self, size: int, least: int):
        self.size, self.least = size, least
        self.key: tuple | None = None
        self.edge = self.node = 0

    @staticmethod
    def _rows(size: int, lang: pa.Array, phrase: pa.Array, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(sums):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), size, np.int32)), lang, phrase, pa.array(sums, pa.int64())], names=["size", "lang", "phrase", "n"]
            )

    @staticmethod
    def _parted(keys: pa.Array) -> tuple[pa.Array, pa.Array]:
        parts = pc.split_pattern(keys, _LANG, max_splits=1)
        return pc.list_element(parts, 0), pc.list_element(parts, 1)

    def _edges(self, nodes: pa.Array, last: pa.Array, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = pa.array((sums >= self.least) & ~np.asarray(pc.is_null(last)))
        words, lang = self._parted(nodes.filter(keep))
        yield from self._rows(self.size, lang, pc.binary_join_element_wise(words, last.filter(keep), " "), sums[np.asarray(keep)])

    def _nodes(self, nodes: pa.Array, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole nodes, which no other partition adds to, if frequent; parts of the counts of all shorter prefixes."""
        words, lang = self._parted(nodes)
        held = pc.add(pc.count_substring(words, " "), 1).to_numpy()
        keep = (held == self.size - 1) & (sums >= self.least)
        yield from self._rows(self.size - 1, lang.filter(pa.array(keep)), words.filter(pa.array(keep)), sums[keep])
        langs, total = _summed(lang, sums)
        yield from self._rows(0, langs, pa.array([""] * len(total)), total)
        for m in range(1, self.size - 1):
            mine = held >= m
            first = pc.binary_join(pc.list_slice(pc.split_pattern(words.filter(pa.array(mine)), " "), 0, m), " ")
            keys, part = _summed(pc.binary_join_element_wise(first, lang.filter(pa.array(mine)), _LANG), sums[mine])
            phrase, of = self._parted(keys)
            yield from self._rows(m, of, phrase, part)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, last, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        moved, changed = np.zeros(len(n), bool), np.zeros(len(n), bool)
        for mask, column in ((moved, nodes), (changed, last)):
            code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            mask[1:] = code[1:] != code[:-1]
        if self.key is not None:
            moved[0] = nodes[0].as_py() != self.key[0]
            changed[0] = last[0].as_py() != self.key[1]
        for what, mask in (("edge", moved | changed), ("node", moved)):
            if mask[0]:
                yield from self._close(what)
            at = np.flatnonzero(mask)
            at = at if mask[0] else np.r_[0, at]
            sums = np.add.reduceat(n, at)
            sums[0] += getattr(self, what)
            setattr(self, what, int(sums[-1]))
            if len(at) > 1:
                done = pa.array(at[:-1])
                of = nodes.take(done)
                yield from self._edges(of, last.take(done), sums[:-1]) if what == "edge" else self._nodes(of, sums[:-1])
        self.key = nodes[-1].as_py(), last[-1].as_py()

    def _close(self, what: str) -> Iterator[pa.RecordBatch]:
        """Hand on the edge or node that is open."""
        if self.key is not None:
            node, last = (pa.array([k], pa.string()) for k in self.key)
            sums = np.array([getattr(self, what)])
            yield from self._edges(node, last, sums) if what == "edge" else self._nodes(node, sums)
        setattr(self, what, 0)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._close("edge")
        yield from self._close("node")


def phrase_counts(docs: DataFrame, size: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(size, lang, phrase, n): how often each phrase of up to ``size`` words comes, if ``least`` times; size 0 counts all words.

    Letters A-Z are lowered, texts part into pieces at marks and line ends, pieces into words
    at spaces and tabs. Phrases do not cross pieces; overlapping ones all count. A null text is
    empty, a null language ``und``; repeated rows count each time.
    """
    if size < 2 or least < 1:
        raise ValueError("phrases have two words at least and come once at least")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(size)
        for lang, text in rows_of(batches, ["lang", "text"]):
            counter.add(lang, text)
            if counter.full:
                yield from counter.take()
        yield from counter.take()

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Flow(size, least)
        for batch in batches:
            if batch.num_rows:
                yield from sums.add(batch)
        yield from sums.close()

    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = texts.mapInArrow(count, "node string, last string, n long")
    dealt = rows.repartition("node").sortWithinPartitions("node", "last")
    parts = dealt.mapInArrow(flow, "size int, lang string, phrase string, n long")
    return parts.groupBy("size", "lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= least))


def _words(column: str) -> Column:
    return F.split(column, " ")


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def compact_paths(counts: DataFrame, size: int = 3) -> DataFrame:
    """(lang, words, n): maximal runs of edges between unary nodes, each phrase of ``size`` words in one of them.

    ``counts`` is as ``phrase_counts`` returns it, written out. An edge follows another where
    both have the count of the node between them: then every text that has the one has the
    other after it. Each round doubles the steps that are known, so a run of n edges takes
    log2(n) rounds. No run is a circle, as pieces begin and end.
    """
    words = _words("phrase")
    edges = counts.where(F.col("size") == size).select(
        "lang", "phrase", "n", _part(words, 1, size - 1).alias("head"), _part(words, 2, size - 1).alias("tail")
    )
    nodes = counts.where(F.col("size") == size - 1).select("lang", F.col("phrase").alias("head"), "n")
    after = edges.select("lang", "phrase", "head", "n").join(nodes, ["lang", "head", "n"])
    before = edges.select("lang", F.col("tail").alias("head"), "n", F.col("phrase").alias("up"))
    links = after.join(before, ["lang", "head", "n"]).select("lang", "phrase", "up", F.lit(1).cast("long").alias("hops"))
    steps = edges.select("lang", "phrase", "n").join(links, ["lang", "phrase"], "left")
    steps = durable(steps.select("lang", "phrase", "n", F.coalesce("up", "phrase").alias("up"), F.coalesce("hops", F.lit(0).cast("long")).alias("hops")))
    linked = steps.where("hops > 0")
    while not linked.isEmpty():
        far = linked.select("lang", F.col("phrase").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"))
        moved = steps.join(far, ["lang", "up"], "left").select(
            "lang", "phrase", "n", F.coalesce("next", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")
        )
        moved = durable(moved)
        steps, linked = moved.drop("moved"), moved.where("hops > 0") if not moved.where("moved").isEmpty() else moved.limit(0)
    last = F.struct("hops", F.element_at(_words("phrase"), -1).alias("word"))
    runs = steps.groupBy("lang", "up").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("hops") > 0, last))).alias("more"))
    return runs.select("lang", F.concat(_words("up"), F.transform("more", lambda x: x["word"])).alias("words"), "n")


def collocations(
    docs: DataFrame,
    size: int = 3,
    least: int = 10,
    best: int = 2000,
    swallow: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``size`` words.

    a is the phrase's count, l and r are those of the parts at the cut with the lowest score,
    1000000 a a / (l r) rounded down, ties to the earliest cut; n counts the language's words.
    A phrase goes if a longer one that contains it has ``swallow`` percent of its count or
    more; as counts fall with length, one word more is enough to look at. Ranks go by score,
    count and phrase (bytes). Numbers are exact up to counts of 10^15, beyond them it is an
    error. An empty table gives no rows; see ``phrase_counts`` for nulls and repeated rows.
    """
    if not 0 < swallow <= 100:
        raise ValueError("swallow is a share in percent")
    counts = durable(phrase_counts(docs, size, least, text_col, lang_col))
    of = lambda m, name: counts.where(F.col("size") == m).select("lang", F.col("phrase").alias(name), F.col("n").alias(f"{name}_n"))
    paths = durable(compact_paths(counts, size))
    every = F.col("words")
    ends = paths.withColumns({"first": _part(every, 1, size - 1), "last": _part(every, 1 - size, size - 1)})
    ends = ends.join(of(size - 1, "first"), ["lang", "first"]).join(of(size - 1, "last"), ["lang", "last"])
    places = ends.select("lang", "words", "n", "first_n", "last_n", F.explode(F.sequence(F.lit(0), F.size(every) - size)).alias("at"))
    longest = places.select(
        "lang",
        F.slice(every, F.col("at") + 1, size).alias("words"),
        F.col("n").alias("a"),
        F.when(F.col("at") == 0, F.col("first_n")).otherwise(F.col("n")).alias("left"),
        F.when(F.col("at") == F.size(every) - size, F.col("last_n")).otherwise(F.col("n")).alias("right"),
    )
    # Shorter phrases: nodes on a path against the path's count, still shorter ones against one word more.
    nodes_on = F.explode(F.transform(F.sequence(F.lit(1), F.size(every) - size + 2), lambda i: _part(every, i, size - 1)))
    shorter = []
    for m in range(2, size):
        if m == size - 1:
            over = paths.select("lang", nodes_on.alias("phrase"), "n")
        else:
            w = _words("phrase")
            over = counts.where(F.col("size") == m + 1).select("lang", F.explode(F.array(_part(w, 1, m), _part(w, 2, m))).alias("phrase"), "n")
        over = over.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        left = counts.where(F.col("size") == m).join(over, ["lang", "phrase"], "left")
        left = left.where(F.col("longer").isNull() | (100 * F.col("longer") < swallow * F.col("n")))
        none = F.lit(None).cast("long")
        shorter.append(left.select("lang", _words("phrase").alias("words"), F.col("n").alias("a"), none.alias("left"), none.alias("right")))
    found = reduce(DataFrame.unionByName, shorter, longest)
    for m in range(1, size - 1):
        found = found.withColumns({f"p{m}": _part(every, 1, m), f"s{m}": _part(every, -F.least(F.lit(m), F.size(every)), m)})
        found = found.join(of(m, f"p{m}"), ["lang", f"p{m}"], "left").join(of(m, f"s{m}"), ["lang", f"s{m}"], "left")

    def part(side: str, m: int) -> Column:
        return F.col("left" if side == "p" else "right") if m == size - 1 else F.col(f"{side}{m}_n")

    def cut(k: int, m: int) -> Column:
        a, l, r = (c.cast("decimal(19,0)") for c in (F.col("a"), part("p", k), part("s", m - k)))
        found = F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * a * a, l * r)
        return F.struct(found.alias("score"), F.lit(k).alias("k"), part("p", k).alias("l"), part("s", m - k).alias("r"))

    worst = F.lit(None)
    for m in range(2, size + 1):
        worst = F.when(F.size(every) == m, F.array_min(F.array(*(cut(k, m) for k in range(1, m))))).otherwise(worst)
    scored = found.select("lang", F.array_join("words", " ").alias("phrase"), "a", worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    total = counts.where("size = 0").select("lang", "n")
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
