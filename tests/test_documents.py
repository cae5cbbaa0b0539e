"""Searches of JSON and markup, scripts and encodings."""

from __future__ import annotations

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corrobora import plans
from corrobora.functions import scripts, text
from corrobora.sources import documents, markup


def walk(node, number, names, depth=0, path="$"):
    """The same search by recursion over the parsed document."""
    if depth > documents.MAX_DEPTH or not isinstance(node, dict | list):
        return None
    if isinstance(node, dict):
        for name in names:
            value = node.get(name)
            if isinstance(value, str) and number in [int(x) for x in "".join(c if c in "0123456789" else " " for c in value).split()]:
                return path, name, value
    for step, child in (node.items() if isinstance(node, dict) else enumerate(node)):
        found = walk(child, number, names, depth + 1, path + (f".{step}" if isinstance(node, dict) else f"[{step}]"))
        if found:
            return found
    return None


def made_up(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice([rng.randint(0, 9), f"no {rng.randint(0, 9)}", f"0{rng.randint(0, 9)}", None, True, '{"title": "5"}', "", "5x5"])
    if rng.random() < 0.5:
        return [made_up(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    keys = ["title", "name", "subject", "zz", "aa", "data", "mm"]
    rng.shuffle(keys)
    return {k: made_up(rng, depth - 1) for k in keys[: rng.randint(0, 4)]}


def test_first_node_as_by_recursion(spark):
    rng = random.Random(4)
    rows = [(i, 5, json.dumps(made_up(rng, rng.choice([2, 4, 7, 11])))) for i in range(120)]
    rows += [(200, 5, None), (201, 5, ""), (202, 5, "{"), (203, 5, '{"title": "5", "title": "6"}'), (204, 5, '"title 5"'), (205, 5, "[" * 8 + '{"title": "5"}' + "]" * 8), (206, 5, "[" * 9 + '{"title": "5"}' + "]" * 9)]
    frame = spark.createDataFrame(rows, "id int, number int, payload string")
    found = documents.first_node(frame, "payload", lambda t: documents.mentions(t, F.col("number")))
    got = {r.id: (r.found.path, r.found.name, r.found.value) if r.found else None for r in found.collect()}
    for i, number, payload in rows:
        if i == 203:
            assert got[i] is None  # a repeated key counts as no JSON
            continue
        try:
            want = walk(json.loads(payload or "null"), number, documents.TITLE_NAMES)
        except ValueError:
            want = None
        assert got[i] == want, payload
    assert sum(v is not None for v in got.values()) > 15
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_first_node_of_odd_texts(spark):
    rows = [
        (0, ' {"a": [{"z": 1.50, "title": "x5", "b": {"y": [2, 1e3]}}]} '), (1, '{"title": "5", "n": ' + "9" * 5000 + "}"), (2, '{"title": "5", "n": NaN}'), (3, "[" * 1200 + "]" * 1200),
        (4, '{"title": "5 \\ud800", "k.[0]": 1}'), (5, '[{"a": {"title": "5"}, "a": 1}]'), (6, '{"b": 1, "a": {"x\'\\"y": {"name": "5"}}}'), (7, '{"title": "5\t"}'), (8, '{"ti\\u0074le": "\\u0035"}')]
    frame = spark.createDataFrame(rows, "id int, payload string")
    found = documents.first_node(frame, "payload", lambda t: documents.mentions(t, F.lit(5)))
    got = {r.id: tuple(r.found) if r.found else None for r in found.collect()}
    assert got[0] == ([0, 0], "$.a[0]", "title", "x5", '{"b":{"y":[2,1000.0]},"title":"x5","z":1.5}')
    assert got[4] == ([], "$", "title", "5 ?", '{"k.[0]":1,"title":"5 ?"}')
    assert got[6] == ([1, 0], "$.a.x'\"y", "name", "5", '{"name":"5"}')
    assert got[8] == ([], "$", "title", "5", '{"title":"5"}')
    assert [got[i] for i in (2, 3, 5, 7)] == [None] * 4
    # One parse a text, not one a level: strings are listed once, whatever the depth.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 4


def test_first_of(spark):
    frame = spark.createDataFrame([('{"desc": " ", "summary": "s", "thumb": 3}',), ("no json",)], "node string")
    got = documents.first_of(frame, "node", {"text": ("desc", "summary"), "image": ("thumb", "poster")}).collect()
    assert [tuple(r)[1:] for r in got] == [("s", "3"), (None, None)]


SOUP = """<html><head><title>T &amp; t</title></head><body class="a b"><div id=x class="pi item">
<p>one<p>two <b>bold<i>both</b> rest</i><ul><li>1<li>2<ul><li>2a</ul><li>3</ul>
<table><tr><td>a<td>b<tr><td>c<table><tr><td>inner</table><td>d</table></div><br><img src="i.png"></p></bogus>
<div class="item">last <!-- no --> &nbsp; word<script>var a = "<li>x</li>";</script>"""


@pytest.mark.parametrize(
    "path, want",
    [
        ("//title", ["T & t"]),
        ("//p", ["one", "two boldboth rest"]),
        ("//ul/li/text()", ["1", "2", "2a", "3"]),
        ("//li[2]", ["22a"]),
        ("//div/ul/li", ["1", "22a", "3"]),
        ("//table/tr/td", ["a", "b", "cinner", "inner", "d"]),
        ("//div[@id='x']/@class", ["pi item"]),
        ("//*[contains(@class,'item')]/@id", ["x"]),
        ("//div[contains(concat(' ', normalize-space(@class), ' '), ' item ')][starts-with(@class,'pi')]/@id", ["x"]),
        ("//img/@src", ["i.png"]),
        (".//body/div[2]/text()", ["last", "word"]),
        ("//nothing", []),
    ],
)
def test_paths(path, want):
    assert [s for n in markup.follow(markup.tree(SOUP), path) if (s := markup._said(n))] == want


def test_paths_that_are_not_supported():
    for path in ("", "//a[position() < 3]", "//a/@href/b", "//a | //b"):
        with pytest.raises(ValueError, match="supported"):
            markup.follow(markup.tree("<a>"), path)


def test_first_text(spark):
    rows = [(1, SOUP, "c"), (2, None, None), (3, "", ""), (4, "<h1> </h1><h2>second", None), (5, "<div>" * 3000 + "deep", None)]
    frame = spark.createDataFrame(rows, "id int, html string, text string").withColumnRenamed("text", "odd name")
    got = {r.id: r.told for r in markup.first_text(frame, "html", ["//h1", "//h2", "//title", "//text()"], "told").collect()}
    assert got == {1: "T & t", 2: None, 3: None, 4: "second", 5: "deep"}
    found = markup.found_texts(frame, "id", "html", "//h2").collect()
    assert [tuple(r) for r in found] == [(4, 0, "second")]


def test_heading_cut_within_an_entity(spark, tmp_path):
    pages = ["<h1>a &lt;b&gt; &quot;c&quot; d&amp</h1>", "<head><title>x&nbsp;y&am</title></head>", "<head><title>a&quot</title></head><h1></h1>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.heading for r in plans.plans()["page_heading"](spark, str(tmp_path)).collect()}
    assert got == {0: 'a <b> "c" d&', 1: "x y&am", 2: 'a"'}
    said = duckdb.connect()
    said.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(said.sql(plans.oracles()["page_heading"]).fetchall()) == got


def test_names_across_scripts(spark):
    six = ["Lee Kwang-soo", "Lee Kwang Soo", "Lee Kwangsoo", "lee kwang-soo", "LEE KWANG SOO", "  Lee  Kwang-Soo  "]
    same = [("유재석", "Yu Jae-seok"), ("김종국", "Gim Jong-guk"), ("Иван Петров", "Ivan Petrov"), ("Νίκος Παππάς", "Nikos Pappas"), ("Жукова", "Zukova"), ("Ψυχή", "psyche")]
    apart = [("Kim Jong-kook", "Kim Jong-min"), ("유재석", "유재식"), ("Lee Kwang-soo", "Lee Kwang-hee")]
    names = six + [n for pair in same + apart for n in pair] + ["王", "", None]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    key = {r.n: r.k for r in frame.select("n", text.identity_key(F.col("n")).alias("k")).collect()}
    assert len({key[n] for n in six}) == 1 and key["王"] == "王" and key[""] is None and key[None] is None
    assert all(key[a] == key[b] for a, b in same) and all(key[a] != key[b] for a, b in apart)


def test_charset_repair(spark):
    whole = ["Café à Zürich – “quoted” €5", "런닝맨", "Привет", "naïve", "plain", "", "Ã", "Â£", "é", "日本 café"]
    wrong = lambda s, code: s.encode().decode(code)
    rows = [(s, s) for s in whole[:7] + whole[8:]]
    rows += [(wrong(s, "latin-1"), s) for s in whole[:4]] + [(wrong(wrong(s, "latin-1"), "latin-1"), s) for s in whole[:4]]
    rows += [("CafÃ© â€“ â€œquotedâ€\x9d â‚¬5", "Café – “quoted” €5"), (wrong("naïve", "cp1252"), "naïve"), (None, None)]
    rows += [("Â£", "£")]  # valid UTF-8 once read back
    got = spark.createDataFrame(rows, "seen string, want string").select("seen", "want", scripts.charset_repaired(F.col("seen")).alias("got")).collect()
    assert [(r.seen, r.got) for r in got if r.got != r.want] == []


def test_restates(spark):
    rows = [("Find it.", "Find it", True), ("The mission: go and find it. Now", "find it.", True), ("The mission: rest", "find it", False), ("find it all", "find it", False)]
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", text.restates(F.col("a"), F.col("b")).alias("got")).collect())
