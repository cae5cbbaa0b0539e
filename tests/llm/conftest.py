from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, `size` string, copies string, label string"


def messy_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "\n".join(f"Line {i} of a rather long text about rivers and mills number {i * i}." for i in range(6000))
    texts = [
        (1, "A plain sentence about the harbour and its old lighthouse keeper."),
        (2, "A plain sentence about the harbour and its old lighthouse keeper."),
        (2, "A plain sentence about the harbour and its old lighthouse keeper."),
        (3, None),
        (4, ""),
        (5, ""),
        (None, "No identifier here at all."),
        (None, "No identifier here at all."),
        (None, None),
        (6, long),
        (7, long + " And an end."),
        (8, "   \t\n "),
        (9, "Ünïcode ▁ marks, 日本語, \U0001f642 and é."),
        (10, "x" * 3000),
        (11, "ab" * 700),
        (12, "one"),
        (13, "One"),
        (-5, "negative identifier text that stands alone"),
    ]
    return [(i, t, None if i == 3 else "en", f"s{i % 3}" if i else None, None, "c", "c", "c", "c", None) for i, t in texts]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(1, 14)] + [(None, 1, 1), (2, None, None), (3, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
