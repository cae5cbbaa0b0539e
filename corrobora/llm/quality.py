"""Quality scores: Bradley-Terry pairwise ranking on features of whole texts.

A document's score is linear in its features; the chance that a good document beats a bad
one is the logistic function of the difference of their scores. Every labelled row stands in
preference pairs (good, bad) with some rows of the other kind, and the weights minimise the
logistic loss on feature differences. Scores are then cut at the quantile of all labelled
rows' scores that their share of bad documents names, and mapped so that this cut is 0.3.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import durable

PAIRS = 100_000
#: Different rows that are paired within one task at a time, about; of either kind this many at least, where there are so many.
BLOCK_ROWS, BLOCK_LEAST = 4096, 64
#: Rows of the other kind that a row is paired with.
RIVALS = 16
#: Steps of a feature's histogram to one.
GRID = 4096
STEPS = 40
BINS = 4
THRESHOLD = 0.3

_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = (
    "upper_letters",
    "letters",
    "digits",
    "spaces",
    "symbols",
    "bare_words",
    "marked_words",
    "same_as_before",
    "distinct_words",
    "commonest_word",
    "distinct_lines",
    "word_length",
    "word_spread",
    "log_words",
)
_MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def features(text: str | None) -> list[float]:
    """FEATURES of a text, each bounded; an empty text has zeros throughout."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    runs = _LETTERS.findall(text)
    letters = sum(map(len, runs))
    codes, lower = _codes(text), _codes(text.lower())
    same_size = len(codes) == len(lower)  # a few letters become two in lower case
    upper = int(np.count_nonzero(codes != lower)) if same_size else sum(map(str.isupper, text))
    marks = len(_MARKS.findall(text))
    n, size = len(words), len(text)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    marked = sum(1 for w in words if not w[-1].isalnum())
    bare = sum(1 for w in words if not (w[0].isalnum() or w[-1].isalnum()))
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    return [
        upper / max(letters, 1),
        letters / size,
        int(np.count_nonzero((codes >= 48) & (codes <= 57))) / size,
        (size - sizes.sum()) / size,
        min(marks / n, 2.0),
        bare / n,
        marked / n,
        repeats / n,
        len(counts) / n,
        max(counts.values()) / n,
        len(set(lines)) / max(len(lines), 1),
        min(sizes.mean(), 30.0) / 10,
        min(sizes.std(), 30.0) / 10,
        np.log1p(n) / 10,
    ]


def expand(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Features with a hinge at each of their cuts, so that scores can bend."""
    hinges = np.maximum(x[:, :, None] - cuts[None], 0).reshape(len(x), cuts.size)
    return np.concatenate([x, hinges], axis=1)


def slope_and_bend(d: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What good-minus-bad differences of these weights add to the slope and the curvature of the loss at ``w``."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # the chance that the bad one wins
    return d.T @ (weight * p), (d * (weight * p * (1 - p))[:, None]).T @ d


def newton(width: int, sums, steps: int) -> np.ndarray:
    """Weights that minimise a logistic loss plus a small ridge (damped Newton steps); ``sums`` gives slope and bend at weights."""
    w, ridge = np.zeros(width), 1e-4 * np.eye(width)
    for _ in range(steps):
        slope, bend = sums(w)
        move = np.linalg.solve(bend + ridge, slope - ridge @ w)
        w += move / max(1.0, np.abs(move).max() / 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int, steps: int) -> np.ndarray:
    """Weights that minimise the mean logistic loss of ``pairs`` good-minus-bad differences plus a small ridge."""
    best, worst = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(best) or not len(worst):
        return np.zeros(x.shape[1])
    draw = np.random.default_rng(0)
    d = x[draw.choice(best, pairs)] - x[draw.choice(worst, pairs)]
    return newton(x.shape[1], lambda w: slope_and_bend(d, np.full(pairs, 1 / pairs), w), steps)


def fit_model(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS) -> dict[str, list[float]]:
    """The model as plain lists: cuts, mean, scale, weights, cut and spread of the scores."""
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T if len(x) else np.zeros((len(FEATURES), BINS))
    wide = expand(x, cuts)
    mean, scale = (wide.mean(axis=0), wide.std(axis=0) + 1e-3) if len(x) else (np.zeros(wide.shape[1]), np.ones(wide.shape[1]))
    w = fit_pairs((wide - mean) / scale, good, pairs, steps)
    raw = (wide - mean) / scale @ w
    share = float((good == 0).mean()) if len(good) else 0.0
    # Between the worst of the better scores and the best of the worse ones.
    cut = float(np.quantile(raw, share, method="midpoint")) if 0 < share < 1 else -1.0
    return {"cuts": cuts.ravel().tolist(), "mean": mean.tolist(), "scale": scale.tolist(), "w": w.tolist(), "cut": [cut]}


def apply_model(x: np.ndarray, model: dict[str, list[float]]) -> np.ndarray:
    """Scores in 0 to 1; a raw score at the model's cut gives the threshold."""
    cuts = np.array(model["cuts"]).reshape(len(FEATURES), -1)
    raw = (expand(x, cuts) - np.array(model["mean"])) / np.array(model["scale"]) @ np.array(model["w"])
    z = raw - model["cut"][0] + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(FEATURES))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column, label: str, id_col: str, text_col: str) -> DataFrame:
    """(label, x, n): the different features of labelled rows and how many rows have them; durable.

    Ids labelled more than once take their largest label; null ids and labels, and labels other than 0 and 1, are left out.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
        .where(F.col("__id").isNotNull() & F.col("label").isin(0, 1) & train)
        .groupBy("__id")
        .agg(F.max("label").alias("label"))
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["__id", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    measured = texts.where(F.col("__id").isNotNull() & train).mapInArrow(measure, "__id long, x array<double>")
    return durable(measured.join(known, "__id").groupBy("label", "x").agg(F.count("*").alias("n")))


def _cuts(rows: DataFrame, total: int) -> np.ndarray:
    """(features, BINS): quantiles of each feature over all rows, to the smallest value of a step of its histogram."""
    each = rows.select("n", F.posexplode("x").alias("at", "v"))
    steps = each.groupBy("at", F.floor(F.col("v") * GRID).alias("step")).agg(F.sum("n").alias("n"), F.min("v").alias("v"))
    found = steps.toPandas().sort_values(["at", "step"])  # features are bounded: 12,300 steps each at most
    ranks = np.linspace(0, 1, BINS + 2)[1:-1] * (total - 1)
    out = []
    for _, f in found.groupby("at"):
        places = np.searchsorted(f["n"].cumsum().to_numpy(), np.floor(ranks), side="right")
        out.append(f["v"].to_numpy()[places])
    return np.array(out)


def _summed(rows: DataFrame, add) -> list[np.ndarray]:
    """The sum over ``rows`` of the arrays that ``add`` makes of a batch; a task sends its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                new = [np.ravel(a) for a in add(b)]
                total = new if total is None else [x + y for x, y in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.tolist() for a in total]])], names=["sums"])

    parts = [[np.array(a) for a in r["sums"]] for r in rows.mapInArrow(run, "sums array<array<double>>").collect()]
    return [np.sum(a, axis=0) for a in zip(*parts, strict=True)]


def _blocks(rows: DataFrame, kinds: dict[int, int], distinct: dict[int, int]) -> DataFrame:
    """(part, good, bad, good_n, bad_n): rows dealt by hash to blocks, as bytes of doubles; durable.

    A kind of which a block would have fewer than BLOCK_LEAST is dealt several times, its
    shares split. Shares of each kind add up to a half.
    """
    parts = -(-sum(distinct.values()) // BLOCK_ROWS)
    copies = {k: min(parts, -(-BLOCK_LEAST * parts // n)) for k, n in distinct.items()}
    of = lambda values: F.when(F.col("label") == 1, F.lit(values[1])).otherwise(F.lit(values[0]))
    turn = F.explode(F.sequence(F.lit(0), of(copies) - 1))
    dealt = rows.select("label", "x", (F.col("n") / of({k: 2.0 * n * copies[k] for k, n in kinds.items()})).alias("n"), F.xxhash64("label", "x").alias("h"), turn.alias("turn"))
    dealt = dealt.withColumn("part", F.pmod(F.col("h") + F.col("turn"), F.lit(parts)).cast("int"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["label", "h"])
        kind = {k: block[block["label"] == k] for k in (1, 0)}
        x = {k: np.array(b["x"].tolist(), np.float64).tobytes() for k, b in kind.items()}
        n = {k: b["n"].to_numpy(np.float64).tobytes() for k, b in kind.items()}
        return pd.DataFrame([(block["part"].iloc[0], x[1], x[0], n[1], n[0])], columns=["part", "good", "bad", "good_n", "bad_n"])

    return durable(dealt.groupBy("part").applyInPandas(pack, "part int, good binary, bad binary, good_n binary, bad_n binary"))


def _differences(block: dict, cuts: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Good-minus-bad differences of a block and their weights: each row with RIVALS of the other kind, drawn by their shares."""
    draw = np.random.default_rng(block["part"])
    x = {k: (expand(np.frombuffer(block[k]).reshape(-1, len(FEATURES)), cuts) - mean) / scale for k in ("good", "bad")}
    n = {k: np.frombuffer(block[f"{k}_n"]) for k in ("good", "bad")}
    if not len(n["good"]) or not len(n["bad"]):
        return np.zeros((0, len(mean))), np.zeros(0)
    size = {k: len(v) * RIVALS for k, v in n.items()}
    rivals = {k: draw.choice(len(n[o]), size[k], p=n[o] / n[o].sum()) for k, o in (("good", "bad"), ("bad", "good"))}
    every = {k: np.repeat(np.arange(len(v)), RIVALS) for k, v in n.items()}
    d = np.concatenate([x["good"][every["good"]] - x["bad"][rivals["good"]], x["good"][rivals["bad"]] - x["bad"][every["bad"]]])
    return d, np.concatenate([n[k][every[k]] for k in ("good", "bad")]) / RIVALS


def nth_value(rows: DataFrame, value: str, count: str, rank: int) -> tuple[float, int]:
    """The value of ``rank`` (from 0) in order, each as often as ``count`` says, and how many are no larger: by ever finer histograms."""
    below, (low, high) = 0, rows.agg(F.min(value), F.max(value)).first()
    while True:
        cell = F.floor((F.col(value) - low) / (high - low) * 1023) if high > low else F.lit(0)
        cells = rows.where(F.col(value).between(low, high)).groupBy(cell.alias("cell"))
        for c in sorted(cells.agg(F.sum(count).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()):
            if below + c["n"] > rank:
                break
            below += c["n"]
        if c["low"] == c["high"]:
            return c["low"], below + c["n"]
        low, high = c["low"], c["high"]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    steps: int = STEPS,
) -> dict[str, list[float]]:
    """A model of a few hundred numbers, from all labelled rows; ``train`` is a condition on ``__id``.

    Features are computed where the texts lie. Cuts, means and the final cut are taken over all
    rows; the loss is summed over blocks of rows, in tasks, for each step. Weights are rounded,
    so that the order of sums does not show.
    """
    rows = _labelled(docs, labels, train, label, id_col, text_col)
    seen = {r["label"]: r for r in rows.groupBy("label").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct")).collect()}
    kinds, distinct = ({k: r[c] for k, r in seen.items()} for c in ("rows", "distinct"))
    total = sum(kinds.values())
    if not total:
        return fit_model(np.zeros((0, len(FEATURES))), np.zeros(0))
    cuts = _cuts(rows, total)

    def moments(b: pa.RecordBatch):
        wide, n = expand(_matrix(b.column(b.schema.get_field_index("x"))), cuts), b.column(b.schema.get_field_index("n")).to_numpy()
        return n @ wide, n @ wide**2

    first, second = _summed(rows, moments)
    mean = np.round(first / total, 9)
    scale = np.round(np.sqrt(np.maximum(second / total - (first / total) ** 2, 0)), 9) + 1e-3
    w, cut = np.zeros(len(mean)), -1.0
    if len(kinds) == 2:
        blocks = _blocks(rows, kinds, distinct)

        def sums(w: np.ndarray):
            def add(b: pa.RecordBatch):
                slope, bend = 0, 0
                for block in b.to_pylist():
                    s, h = slope_and_bend(*_differences(block, cuts, mean, scale), w)
                    slope, bend = slope + s, bend + h
                return slope, bend

            slope, bend = _summed(blocks, add)
            return slope, bend.reshape(len(w), -1)

        w = np.round(newton(len(mean), sums, steps), 6)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = (expand(_matrix(b.column(0)), cuts) - mean) / scale @ w
                yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(1)], names=["raw", "n"])

        raw = durable(rows.select("x", "n").mapInArrow(scored, "raw double, n long"))
        # Between the worst of the better scores and the best of the worse ones.
        worse, upto = nth_value(raw, "raw", "n", kinds[0] - 1)
        better = worse if upto > kinds[0] else raw.where(F.col("raw") > worse).agg(F.min("raw")).first()[0]
        cut = (worse + better) / 2
    return {"cuts": cuts.ravel().tolist(), "mean": mean.tolist(), "scale": scale.tolist(), "w": w.tolist(), "cut": [cut]}


def score_quality(
    docs: DataFrame, model: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, score) per row; a null or empty text scores as zero features do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(apply_model(x, model))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, score double"
    )


def rows_of_quality(
    docs: DataFrame, model: dict[str, list[float]], least: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, with all their columns; each is judged by its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(text_col)], np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(apply_model(x, model) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
