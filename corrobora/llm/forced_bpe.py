"""Byte-pair encoding and decoding, with words cut where no token can reach across.

A vocabulary file of the tokenizers library (byte-level BPE with word ends) is read on the
driver and broadcast. Which pairs of neighbouring bytes occur inside any token is a table of
256 x 512 bits (the second byte may be the last of its word). A pair that occurs in none is a
certain cut: no merge can span it, and merges on either side don't depend on each other, so
the fragments between cuts are encoded alone and their ids concatenated. Words and fragments
repeat, so each is encoded once per worker; a fragment of any length takes n log n steps.

Texts are normalised (NFC, lower case by character) and split into words as the file says.
Special tokens are found in the raw text first. Files with other normalizers, splits or
decoders are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and fragments remembered by a worker before it starts anew.
_KEPT = 600_000
#: Texts handled together are at most so many, or hold about so many characters.
_TEXTS, _CHARACTERS = 256, 4_000_000
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LIMITS = (0x250, 0x10000, sys.maxunicode + 1)
# The settings of the files that this module can follow.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@dataclass
class Merges:
    """A vocabulary: its tokens by id, merges by rank, and special tokens with their ids."""

    tokens: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str
    name: str

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, "rb") as file:
            raw = file.read()
        spec = json.loads(raw)
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != _NORMALIZERS or split.get("pattern") != {"Regex": _SPLIT} or spec["decoder"] or model["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE with these words and normalizers is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must stand for their plain text")
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(model["vocab"], pairs, special, model["end_of_word_suffix"] or "", hashlib.sha256(raw).hexdigest())


@cache
def _words(limit: int) -> re.Pattern[str]:
    """The words of texts whose characters are below ``limit``: short classes match faster.

    Letters and numbers are those of this Python's Unicode tables; code points that a later
    Unicode assigned count as neither.
    """

    def members(kind: str) -> str:
        codes = [c for c in range(limit) if unicodedata.category(chr(c))[0] == kind]
        starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
        ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c + 1 != after]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))

    letters, numbers = members("L"), members("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")


def _runs(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[at : at + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at - (ends - sizes), sizes)]


class _Store(dict):
    """Numbers keys as they come; holds a run of ids for each number."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number

    def take_fresh(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh

    def put(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Runs of the keys that came last."""
        first = len(self) - len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first : len(self)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : len(self)] = sizes
        self.used += len(ids)

    def runs(self, numbers: np.ndarray) -> np.ndarray:
        return _runs(self.ids, self.at[numbers], self.size[numbers])


class Codec:
    """Encodes and decodes; remembers words and fragments, up to a bound."""

    def __init__(self, merges: Merges):
        letters = byte_letters()
        code = {c: b for b, c in enumerate(letters)}
        # Symbols: a byte, or 256 more for the last byte of a word.
        self.base = np.array(
            [merges.tokens.get(c, -1) for c in letters] + [merges.tokens.get(c + merges.suffix, -1) for c in letters], np.int32
        )
        if (self.base < 0).any():
            raise ValueError("the vocabulary must have a token for each byte, within and at the end of a word")
        self.joined = np.zeros((256, 512), bool)
        for token in merges.tokens:
            last = bool(merges.suffix) and token.endswith(merges.suffix)
            symbols = [code[c] for c in (token[: -len(merges.suffix)] if last else token)]
            if last and symbols:
                symbols[-1] += 256
            for pair in zip(symbols, symbols[1:], strict=False):
                self.joined[pair] = True
        ids = merges.tokens
        self.rank = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges.merges)}
        self.special = merges.special
        by_length = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(by_length)})") if by_length else None
        # For decoding: each token's characters and a space.
        shown = {i: t for t, i in (ids | self.special).items()}
        raw = [(shown.get(i, "") + " ").encode() if i in shown else b"" for i in range(max(shown) + 1)]
        self.token_size = np.array([len(t) for t in raw], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.words, self.fragments = _Store(), _Store()
        for token, number in self.special.items():  # a word of one id; no word of a text is a tuple
            self.words[(token,)]
            self.words.put(np.array([number], np.int32), np.array([1]))
        self.words.take_fresh()

    def merge(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges: the pair of lowest rank first, the leftmost of equals."""
        rank = self.rank
        if len(ids) < 24:
            ids = list(ids)
            known = [rank.get(p) for p in zip(ids, ids[1:], strict=False)]
            while True:
                best, at = None, -1
                for i, r in enumerate(known):
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    return ids
                ids[at : at + 2] = [best[1]]
                del known[at]
                if at:
                    known[at - 1] = rank.get((ids[at - 1], ids[at]))
                if at < len(known):
                    known[at] = rank.get((ids[at], ids[at + 1]))
        ids = list(ids)
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = [(*r, i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank.get(p))]
        queue = [(r, i, made) for r, made, i in queue]
        heapq.heapify(queue)
        while queue:
            r, i, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank.get((ids[i], ids[j])) != (r, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := rank.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := rank.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, found[1]))
        return [x for x in ids if x >= 0]

    def cuts(self, symbols: np.ndarray) -> np.ndarray:
        """Where in a run of symbols a fragment ends: after a word's last byte, and between bytes that no token joins."""
        ends = symbols >= 256
        ends[:-1] |= ~self.joined[symbols[:-1] & 255, symbols[1:]]
        return ends

    def _learn_words(self) -> None:
        fresh = [w.encode() for w in self.words.take_fresh()]
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        symbols = np.frombuffer(b"".join(fresh), np.uint8).astype(np.uint16)
        symbols[np.cumsum(sizes) - 1] += 256
        ends = np.flatnonzero(self.cuts(symbols)) + 1
        raw, marks = symbols.tobytes(), [0, *(2 * ends).tolist()]
        which = np.fromiter((self.fragments[raw[a:b]] for a, b in zip(marks, marks[1:], strict=False)), np.int64, len(ends))
        if self.fragments.fresh:
            self._learn_fragments()
        # A word's ids are those of its fragments.
        per = np.searchsorted(ends, np.cumsum(sizes), side="right")
        counts = np.r_[0, np.cumsum(self.fragments.size[which])][np.r_[0, per]]
        self.words.put(self.fragments.runs(which), np.diff(counts))

    def _learn_fragments(self) -> None:
        found = []
        for raw in self.fragments.take_fresh():
            found.append(self.merge(self.base[np.frombuffer(raw, np.uint16)].tolist()))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.fragments.put(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)

    def _cut(self, text: str) -> list:
        """The words of a text; special tokens are 1-tuples."""
        if self.marks is not None and self.marks.search(text):
            parts = self.marks.split(text)
            return [w for i, p in enumerate(parts) for w in ([(p,)] if i % 2 else self._cut(p))]
        text = unicodedata.normalize("NFC", text)
        # A final sigma has no form of its own here, unlike in str.lower.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        top = ord(max(text, default="a"))
        return _words(next(x for x in _LIMITS if top < x)).findall(text)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each; empty and null texts have none."""
        if len(self.words) + len(self.fragments) > _KEPT:
            self._forget()
        cut = [self._cut(t) if t else [] for t in texts]
        per = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, int(per.sum()))
        if self.words.fresh:
            self._learn_words()
        counts = np.r_[0, np.cumsum(self.words.size[which])][np.r_[0, np.cumsum(per)]]
        return self.words.runs(which), np.diff(counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The tokens of runs of ids, joined by spaces, as the library does without a decoder. Unknown ids give nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.token_size)), ids, -1)
        sizes = np.where(ids >= 0, self.token_size[ids], 0)
        raw = _runs(self.token_bytes, self.token_at[ids], sizes).tobytes()
        marks = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[i : max(i, j - 1)].decode() for i, j in zip(marks, marks[1:], strict=False)]


_CODECS: dict[str, Codec] = {}


def _codec(merges: Merges) -> Codec:
    """The worker's codec of a vocabulary; workers outlive tasks, and so does what it remembers."""
    if merges.name not in _CODECS:
        _CODECS.clear()
        _CODECS[merges.name] = Codec(merges)
    return _CODECS[merges.name]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of few texts or characters, with the texts of column 1."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, _TEXTS)
        texts = part.column(1).to_pylist()
        total = np.cumsum([len(t or "") for t in texts])
        n = max(1, int(np.searchsorted(total, _CHARACTERS)))
        yield part.slice(0, n), texts[:n]
        at += n if n < len(texts) else len(texts)


def encode_texts(
    docs: DataFrame, merges: Merges, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids) per row of ``docs``, and with ``decoded`` also the text that the ids stand for.

    ids is binary, 4 bytes a token, little-endian unsigned, as training files hold them;
    ``unpacked`` makes an array of it. Null and empty texts have no ids. Rows are independent:
    repeated rows repeat their result, rows without an identifier keep none, other columns are
    ignored, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(merges)
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part, texts in _parts(batch):
                ids, counts = codec.encode(texts)
                raw, marks = ids.astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(counts)]).tolist()
                packed = [raw[a:b] for a, b in zip(marks, marks[1:], strict=False)]
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array(codec.decode(ids, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, merges: Merges, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of ``rows``, whose ids are packed as by ``encode_texts``; null ids are no ids."""
    shared = rows.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                packed = [bytes(x or b"") for x in part.column(1).to_pylist()]
                counts = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
                ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.decode(ids, counts), pa.string())], names=["doc_id", "text"])

    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, text string")


def unpacked(ids: str = "ids") -> Column:
    """The packed ids of a column as an array of numbers."""
    digits = " || ".join(f"hex(substring({ids}, 4 * x + {i}, 1))" for i in (4, 3, 2, 1))
    places = f"filter(sequence(0, cast(length({ids}) / 4 AS int)), x -> 4 * x < length({ids}))"
    return F.expr(f"transform({places}, x -> cast(conv({digits}, 16, 10) AS bigint))")


def default_merges(path: str | None = None) -> Merges:
    """The vocabulary at ``path``, or the public one of 49k tokens that this environment offers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Merges.load(path)
