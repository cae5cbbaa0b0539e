from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from corrobora.functions import scores, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-3-9", datetime.date(2024, 3, 9)),
        ("2024.03.09", datetime.date(2024, 3, 9)),
        ("9 March 2024", datetime.date(2024, 3, 9)),
        ("Mar. 9, 2024 (filmed 1 March)", datetime.date(2024, 3, 9)),
        ("2024년 3월 9일", datetime.date(2024, 3, 9)),
        ("2024-02-30", None),
        ("1999-01-01", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parsed_date(spark, raw, want):
    assert value(spark, text.parsed_date(F.lit(raw).cast("string"), 2009, 2026)) == want


def test_clean(spark):
    assert value(spark, text.clean(F.lit("  A&amp;B[12]   x​[a] "))) == "A&B x"
    assert value(spark, text.clean(F.lit(None).cast("string"))) is None
    assert value(spark, text.clean_paragraphs(F.lit("a \n b\n\n\n\n c"))) == "a b\n\nc"


def test_six_spellings_one_key(spark):
    names = ["Yoo Jae-suk", "yoo jae suk", "YOO JAE SUK", "Yoo Jaesuk", " Yoo  Jae-Suk", "Yoó Jae-suk"]
    assert {value(spark, text.identity_key(F.lit(n))) for n in names} == {"yoojaesuk"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("• <b>Ann Lee</b> (guest)", "Ann Lee"), ("3. Bob – host", "Bob"), ("TBA", None), ("{x}", None), ("a", None), (None, None)],
)
def test_person_name(spark, raw, want):
    assert value(spark, text.person_name(F.lit(raw).cast("string"))) == want


def test_title(spark):
    say = lambda raw, n: value(spark, text.canonical_title(F.lit(raw), F.lit(n)))
    assert say("Show Ep. 8: The Race", 8) == "Episode #008 - The Race"
    assert say("Show Ep. 9: The Race", 8) == "Episode #008"
    assert say("The Race", 1234) == "Episode #1234 - The Race"


def test_lists_and_snippets(spark):
    say = lambda *x: value(spark, text.spoken_list(F.array(*map(F.lit, x))))
    assert [say("a"), say("a", "b"), say("a", "b", "c")] == ["a", "a and b", "a, b and c"]
    assert value(spark, text.shortened(F.lit("abc def"), 5)) == "abc…"


def test_redaction(spark):
    raw = 'token = "abcdef" see /x?key=1&b=2 ' + "f" * 40
    assert value(spark, text.redacted(F.lit(raw))) == "token = *** see /x?key=***&b=2 ***"


def test_corroboration(spark):
    of = lambda *x: value(spark, scores.corroborated(F.array(*map(F.lit, x))))
    assert of(80) == 80
    assert of(60, 80) == of(80, 60) == round(80 + 20 * 0.35 * 0.6)
    assert of(99, 99, 99, 99) == 99


def test_backoff(spark):
    of = lambda n: value(spark, scores.backoff(F.lit(n), 60, 500))
    assert [of(n) for n in (0, 1, 2, 3, 9)] == [60, 60, 120, 240, 500]


def test_shrinkage_needs_samples(spark):
    of = lambda a, n, f: value(spark, scores.shrunk(F.lit(70), F.lit(a), F.lit(n), F.lit(f)))
    assert of(2, 2, 0) == 70
    assert of(60, 60, 0) == round(70 * 0.35 + 100 * 0.65)
    assert of(0, 0, 0) == 70


def test_grounding_of_names(spark):
    from corrobora.functions import grounding as g

    text = "Anna met Bo in Jeju Island on Monday. Then Bo saw Lake Como. Yes, Études and the Tower of London; Zed."
    row = spark.createDataFrame([(text, "anna's bo jeju island lake"), (None, None), ("In today's episode Anna won.", "")], "t string, e string")
    got = row.select(g.claims(F.col("t")).alias("c"), g.unsupported(g.claims(F.col("t")), g.vocabulary(F.col("e"))).alias("u"),
                     g.word_count(F.col("t")).alias("n"), g.generic_opening(F.col("t")).alias("o")).collect()
    assert got[0].c == ["Bo", "Jeju Island", "Monday", "Then Bo", "Lake Como", "Tower of London", "Zed"]
    assert got[0].u == ["Lake Como", "Then Bo", "Tower of London", "Zed"] and got[0].n == 21 and not got[0].o
    assert got[1].c == [] and got[1].u == [] and got[1].n == 0 and not got[1].o
    assert got[2].o and got[2].u == ["Anna"]
    score = spark.range(1).select(g.confidence(F.lit(20), F.lit(False), F.lit(3)).alias("a"), g.confidence(F.lit(60), F.lit(True), F.lit(0)).alias("b"),
                                  g.confidence(F.lit(40), F.lit(False), F.lit(1)).alias("c")).first()
    assert tuple(score) == (2, 71, 63)
