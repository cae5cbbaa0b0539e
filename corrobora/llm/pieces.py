"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is escaped (a marker stands for each space, one is put in front), cut where a marker
follows another character, as no piece reaches over such a place, and every distinct stretch
is segmented once per task: the path of pieces with the largest sum of log scores, ties to
the longer last piece. Stretches of similar length run through the trie side by side. A
character without a piece becomes its UTF-8 bytes (or the unknown piece, if the vocabulary
has no byte pieces). Decoding joins pieces and bytes and turns markers into spaces.

The vocabulary is a file that the session's driver reads; tasks get it as a broadcast of
fixed size. It is not trained here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches of up to these many bytes are segmented together; longer ones one by one.
WIDTHS = (8, 16, 32, 64)
_KEPT = 600_000


class DoubleArray:
    """A trie in two arrays: the child of s by byte c is t = base[s] + c if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][c]
            values[at] = value
        used = bytearray(4 * len(children) + 1024)
        used[0] = 1
        place, base, check = {0: 0}, {}, {}
        stack = [0]
        while stack:
            node = stack.pop()
            kids = children[node]
            if not kids:
                continue
            codes = sorted(kids)
            free = used.index(0, codes[0] + 1)
            while any(used[free - codes[0] + c] for c in codes):
                free = used.index(0, free + 1)
            start = free - codes[0]
            base[place[node]] = start
            if start + 512 > len(used):
                used.extend(bytes(len(used)))
            for c in codes:
                used[start + c] = 1
                check[start + c] = place[node]
                place[kids[c]] = start + c
                stack.append(kids[c])
        size = max(place.values()) + 257
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[list(base)] = list(base.values())
        self.check[list(check)] = list(check.values())
        for node, at in place.items():
            self.value[at] = values[node]


@dataclass
class Vocabulary:
    """Pieces with their scores; ``bytes_at`` has the ids of the 256 byte pieces, if there are."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    unknown: int
    bytes_at: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        return cls(
            [model.id_to_piece(i) for i in ids],
            [model.get_score(i) for i in ids],
            [not s for s in special],
            model.unk_id(),
            [i for i in ids if model.is_byte(i)],
        )


class _Numbers(dict):
    """Numbers stretches as they come; ``fresh`` lists those without a segmentation yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, stretch: str) -> int:
        number = self[stretch] = len(self)
        self.fresh.append(stretch)
        return number


class Codec:
    """Encodes and decodes with a vocabulary; remembers the stretches it has segmented, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.trie = DoubleArray({p.encode(): i for i, (p, ok) in enumerate(zip(v.pieces, v.plain, strict=True)) if ok and p})
        plain = [s for s, ok in zip(v.scores, v.plain, strict=True) if ok]
        self.scores = np.array(v.scores, np.float64)
        self.unknown_score = min(plain, default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.array(v.bytes_at if len(v.bytes_at) == 256 else [v.unknown] * 256, np.int32)
        self.by_bytes = len(v.bytes_at) == 256
        crossing = re.compile(f"[^{MARK}]{MARK}")
        cut = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        whole = any(ok and crossing.search(p) for p, ok in zip(v.pieces, v.plain, strict=True))
        self.stretch = re.compile("(?s).+" if whole else cut)
        # For decoding: the bytes of each piece, one after the other.
        raw = [p.encode() if ok else b"" for p, ok in zip(v.pieces, v.plain, strict=True)]
        for value, i in enumerate(v.bytes_at):
            raw[i] = bytes([value])
        raw[v.unknown] = " ⁇ ".encode()
        self.piece_size = np.array([len(b) for b in raw], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def _segment_long(self, s: bytes) -> list[int]:
        """Viterbi of one stretch, by walking the trie from each character."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(s)
        best, back = [float("-inf")] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            width = 1 if s[i] < 0x80 else 2 if s[i] < 0xE0 else 3 if s[i] < 0xF0 else 4
            state, single = 0, False
            for j in range(i, n):
                to = int(base[state]) + s[j]
                if to >= len(check) or check[to] != state:
                    break
                state = to
                piece = int(value[state])
                if piece >= 0:
                    single |= j + 1 == i + width
                    if best[i] + self.scores[piece] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + self.scores[piece], (i, piece)
            if not single and best[i] + self.unknown_score > best[i + width]:
                best[i + width], back[i + width] = best[i] + self.unknown_score, (i, -1)
            i += width
        out: list[int] = []
        while n:
            i, piece = back[n]
            if piece < 0:
                out += self.byte_ids[list(s[i:n])][::-1].tolist() if self.by_bytes else [int(self.byte_ids[0])]
            else:
                out.append(piece)
            n = i
        return out[::-1]

    def _segment_short(self, stretches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi of many stretches of at most ``width`` bytes: ids, right-aligned, and their numbers."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(stretches)
        text = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in stretches), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, stretches), np.int64, n)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        step = np.zeros((n, width + 1), np.int64)
        ident = np.zeros((n, width + 1), np.int32)
        char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        for i in range(width):
            rows = np.flatnonzero((i < size) & (text[:, i] & 0xC0 != 0x80))
            if not len(rows):
                continue
            lone = np.zeros(n, bool)
            lone[rows] = True
            every, state = rows, np.zeros(len(rows), np.int32)
            for j in range(i, width):
                to = base[state] + text[rows, j]
                ok = (check[to] == state) & (j < size[rows])
                rows, state = rows[ok], to[ok]
                if not len(rows):
                    break
                piece = value[state]
                hit = piece >= 0
                r, p = rows[hit], piece[hit]
                lone[r[char[r, i] == j + 1 - i]] = False
                s = best[r, i] + self.scores[p]
                better = s > best[r, j + 1]
                r = r[better]
                best[r, j + 1], step[r, j + 1], ident[r, j + 1] = s[better], j + 1 - i, p[better]
            rows = every[lone[every]]
            end = i + char[rows, i]
            worth = best[rows, i] + self.unknown_score > best[rows, end]
            rows, end = rows[worth], end[worth]
            best[rows, end] = best[rows, i] + self.unknown_score
            if self.by_bytes:
                for d in range(1, min(4, width - i) + 1):  # places within a character are reached from here only
                    r = rows[end - i >= d]
                    step[r, i + d], ident[r, i + d] = 1, self.byte_ids[text[r, i + d - 1]]
            else:
                step[rows, end], ident[rows, end] = end - i, self.byte_ids[0]
        out, count, at = np.zeros((n, width), np.int32), np.zeros(n, np.int64), size.copy()
        rows = np.flatnonzero(at)
        while len(rows):
            count[rows] += 1
            out[rows, width - count[rows]] = ident[rows, at[rows]]
            at[rows] -= step[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return out, count

    def _store(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Segment the stretches that have not been met before."""
        while len(self.known) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        fresh, self.known.fresh = self.known.fresh, []
        first = len(self.known) - len(fresh)
        raw = [s.encode("utf-8", "surrogatepass") for s in fresh]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        group = np.searchsorted(WIDTHS, size)
        for g, width in enumerate(WIDTHS):
            mine = np.flatnonzero(group == g)
            for at in range(0, len(mine), 1 << 15):
                part = mine[at : at + (1 << 15)]
                out, count = self._segment_short([raw[i] for i in part.tolist()], width)
                self._store(first + part, out[np.arange(width) >= width - count[:, None]], count)
        for i in np.flatnonzero(group == len(WIDTHS)).tolist():
            ids = self._segment_long(raw[i])
            self._store([first + i], np.array(ids, np.int32), np.array([len(ids)]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each; empty and null texts have none."""
        if len(self.known) > _KEPT:
            self._forget()
        cut = [self.stretch.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        per = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(per.sum()))
        if self.known.fresh:
            self._learn()
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.at[which] - (ends - sizes), sizes)]
        marks = np.r_[0, ends][np.r_[0, np.cumsum(per)]]
        return ids, np.diff(marks)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become replacement characters."""
        sizes = self.piece_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.arange(total) + np.repeat(self.piece_at[ids] - (ends - sizes), sizes)].tobytes()
        marks = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
        out = []
        for i, j in zip(marks, marks[1:], strict=False):
            text = raw[i:j].decode("utf-8", "replace").replace(MARK, " ")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) per row of ``docs``.

    round_trip tells whether decoding the ids gives the text again (a marker character in the
    text comes back as a space, so such texts don't). Null and empty texts have no ids and
    round_trip true. Rows are independent; repeats of a row repeat its result; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids, counts = codec.encode(texts)
                back = codec.decode(ids, counts)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                        pa.array(counts, pa.int64()),
                        pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)]),
                    ],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean"
    )


def decode_ids(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of ``rows``: the text that its ids stand for; null ids are no ids."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [x or [] for x in part.column(1).to_pylist()]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                ids = np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(codec.decode(ids, counts))], names=["doc_id", "text"]
                )

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )


def default_vocabulary() -> Vocabulary:
    """The public 32k vocabulary with byte fallback that this environment offers."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
