"""Collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import phrases
from corrobora.llm.common import durable
from corrobora.llm.phrases import collocations, compact_paths, phrase_counts

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows, size):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(size, len(words) - i) + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    return counts, total


def plain(rows, size, least, best, swallow):
    counts, total = plain_counts(rows, size)
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        m = len(p)
        if any(
            lang == other and len(q) > m and 100 * b >= swallow * a and any(q[i : i + m] == p for i in range(len(q) - m + 1))
            for (other, q), b in found.items()
        ):
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, m)]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranked = []
    for lang in {o[0] for o in out}:
        for rank, (_, s, a, p, l, r) in enumerate(sorted(o for o in out if o[0] == lang)[:best], 1):
            ranked.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(ranked)


def made_up(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "Of", "red", "Äpfel", "z\x01", "mill", " ", "river", "日本", "x"]
    phrase = ["one two three four five six seven", "the the the the", "red mill river"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrase) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 25))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n"]) for p in parts)
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "..,;\n"), ("fr", "word")] + [("en", "Deep deep sea.")] * 12


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], "lang string, text string, phrase string, n string").repartition(5)


@pytest.mark.parametrize("size, least, best, swallow", [(3, 5, 2000, 50), (2, 3, 7, 50), (4, 4, 30, 80), (5, 6, 2000, 100)])
def test_against_plain_counts(spark, size, least, best, swallow):
    rows = made_up(size)
    got = sorted(tuple(r) for r in collocations(frame(spark, rows), size, least, best, swallow).collect())
    assert got == plain(rows, size, least, best, swallow)


def test_small_batches_and_spans(spark, monkeypatch):
    """Rows of one node over many batches, tasks that hand on early, codes that would pass 64 bits."""
    rows = made_up(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(phrases, "POSITIONS", 50)
        got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in phrase_counts(frame(spark, rows), 3, 1).where("size > 0").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(plain_counts(rows, 3)[0])
    words = np.array([5, 6, 7, 8, 0, 5, 6, 7, 8, 5, 0], np.int32)
    for known in (9, 1 << 31):
        columns, counts = phrases._grams(words, 3, known)
        assert sorted(zip(*(c.tolist() for c in columns), counts.tolist(), strict=True)) == [
            (5, 0, 0, 1), (5, 6, 7, 2), (6, 7, 8, 2), (7, 8, 0, 1), (7, 8, 5, 1), (8, 0, 0, 1), (8, 5, 0, 1),
        ]


def test_paths(spark):
    """Paths hold each frequent phrase once, with the same count all along, and cannot be longer."""
    rows = [("en", "a b c d e f g")] * 5 + [("en", "x c d e f")] * 3 + [("en", " ".join(f"w{i}" for i in range(70)))] * 2
    counts = durable(phrase_counts(frame(spark, rows), 3, 2))
    paths = {" ".join(r.words): r.n for r in compact_paths(counts, 3).collect()}
    assert paths == {"a b c d": 5, "x c d": 3, "c d e f": 8, "e f g": 5, " ".join(f"w{i}" for i in range(70)): 2}


def test_messy_and_empty(spark, messy, empty):
    assert collocations(empty).count() == 0
    rows = [(r.lang, r.text) for r in messy.collect()]
    got = sorted(tuple(r) for r in collocations(messy).collect())
    assert got == plain(rows, 3, 10, 2000, 50)
    assert collocations(messy.withColumn("words", F.lit("c")), least=3).count() > 0


def test_arguments(empty):
    with pytest.raises(ValueError, match="two words"):
        phrase_counts(empty, 1)
    with pytest.raises(ValueError, match="percent"):
        collocations(empty, swallow=0)
