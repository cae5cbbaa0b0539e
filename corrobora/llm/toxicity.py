"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word stems, bigrams and one-word skip-grams, hashed into
2**20 coordinates. The learner keeps a rate per coordinate and an L1 threshold, so most
weights stay exactly zero and the rest fit in a small broadcast. Coordinates are made where
the texts lie; the learner sees those of a bounded, hash-chosen sample of the labelled rows,
in one task. Scoring runs over whole texts where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import durable

COORDINATES = 1 << 20
#: Labelled rows that the model is fitted on at most; those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Rows that share an identifier and a label of which the sample takes no more.
SAMPLE_COPIES = 4
#: Passes over the sample: as many as make this many updates, within these bounds.
UPDATES, EPOCHS = 30_000, (3, 10)
#: By cross-validation within training rows.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 20.0, 0.1
STEM_LETTERS = 4
THRESHOLD = 0.3

_TOKEN = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 400_000


class _Words(dict):
    """Numbers words as they come; ``hashes`` has those of a word and of its stem."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((2, 1024), np.uint64)

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        self.hashes[:, number] = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(word[:STEM_LETTERS], 1)
        self[word] = number
        return number


class Featurizer:
    """Hashed features of a text; word hashes are remembered up to a bound."""

    def __init__(self, coordinates: int = COORDINATES):
        self.mask = np.uint64(coordinates - 1)
        self.words = _Words()

    def all(self, text: str | None) -> np.ndarray:
        """Coordinates of all features that occur, with repeats."""
        if len(self.words) > _WORDS_KEPT:
            self.words = _Words()
        tokens = _TOKEN.findall((text or "").lower())
        at = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        w, stem = self.words.hashes[:, at]
        parts = [w, stem]
        for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):  # bigrams, skip-grams
            parts.append((w[:-gap] * _MIX + w[gap:] + np.uint64(salt)) * _MIX)
        every = np.concatenate(parts)
        return ((every ^ (every >> np.uint64(31))) & self.mask).view(np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct coordinates of the features that occur, ascending."""
        return np.unique(self.all(text))


class FtrlProximal:
    """FTRL-proximal logistic regression on binary features, with a bias that is not shrunk."""

    def __init__(self, coordinates: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(coordinates), np.zeros(coordinates)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = _sigmoid(self.bias + w.sum()) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * self.bias
        self.bias_n += g * g


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _trainer(coordinates: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "tie", "label"])
        inputs = [np.frombuffer(x, np.int32) for x in rows["at"]]
        labels = rows["label"].to_numpy(np.float64)
        model = FtrlProximal(coordinates)
        for _ in range(min(EPOCHS[1], max(EPOCHS[0], UPDATES // max(len(labels), 1)))):
            for at, label in zip(inputs, labels, strict=True):
                model.learn(at, label)
        w = model.weights()
        used = np.flatnonzero(w)
        return pd.DataFrame({"at": np.r_[used, -1], "weight": np.r_[w[used], model.bias]})

    return run


def _coordinates(coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(coordinates)
        for b in batches:
            at = [features(t.as_py()).astype(np.int32).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(at, pa.binary())], names=["order", "tie", "label", "at"]
            )

    return run


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, id_col: str, text_col: str, rows: int
) -> DataFrame:
    """(order, text, label): rows of ``rows`` labelled ids that ``train`` admits, those of the smallest hashes.

    Ids labelled more than once take their largest label; null ids and labels are left out. Of
    rows that share an id, SAMPLE_COPIES are taken, those of the smallest text hashes, so the
    sample has at most ``rows`` x SAMPLE_COPIES rows however often an id comes.
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label"))
        .where(F.col("__id").isNotNull() & F.col("label").isNotNull() & train)
        .groupBy("__id")
        .agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("__id"))
    )
    chosen = durable(known.orderBy("order", "__id").limit(rows))
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "__id"  # bounded by ``rows``
    )
    turn = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("text")))
    return found.withColumn("turn", turn).where(F.col("turn") <= SAMPLE_COPIES).select("order", "text", "label")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    coordinates: int = COORDINATES,
) -> list[tuple[int, float]]:
    """The non-zero weights [(coordinate, weight)], the bias at coordinate -1.

    ``train`` is a condition on ``__id``. The list is bounded by ``coordinates``. The fit holds
    four bytes for each different feature of a sampled text. Labels of an id apply to every
    row that bears it; the sample takes a few of the rows that share one.
    """
    sample = labelled_sample(docs, labels, label, train, id_col, text_col, sample_rows)
    text = F.col("text").cast("string")
    measured = sample.select("order", F.xxhash64(text).alias("tie"), "label", text.alias("text")).mapInArrow(
        _coordinates(coordinates), "order long, tie long, label int, at binary"
    )
    fitted = measured.groupBy(F.lit(0).alias("all")).applyInPandas(_trainer(coordinates), "at long, weight double")
    return [(r["at"], r["weight"]) for r in fitted.collect()]


def score_toxicity(
    docs: DataFrame,
    model: list[tuple[int, float]],
    id_col: str = "doc_id",
    text_col: str = "text",
    coordinates: int = COORDINATES,
) -> DataFrame:
    """(doc_id, score) per row; null and empty texts score by the bias alone, an unfitted model by 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Featurizer(coordinates), np.zeros(coordinates)
        bias = -40.0 if not shared.value else 0.0
        for at, w in shared.value:
            if at < 0:
                bias = w
            else:
                weights[at] = w
        def score(text: str | None) -> float:
            at = features.all(text)
            return float(_sigmoid(bias + weights[np.unique(at[weights[at] != 0])].sum()))

        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, score double"
    )


def in_fold(id_column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))
