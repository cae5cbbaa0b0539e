"""Contracts, evidence, access, counters and dry runs; titles, names, addresses and dates of imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import scores, text
from corrobora.operators import access, commits


def test_contract(spark):
    rows = [(1, 7, "ok", {"title": "Item 7", "date": ""}), (2, 7, "ok", {"title": "Item 77"}), (3, 7, "ok", None), (4, 7, "fetch_failed", {}), (5, 7, "ok", {"title": "Item 8", "date": "x"})]
    got = access.contracted(spark.createDataFrame(rows, "id int, number int, status string, fields map<string,string>")).collect()
    assert {r.id: (r.status, sorted(r.fields)) for r in got} == {
        1: ("ok", ["title"]), 2: ("parser_warning", []), 3: ("parser_warning", []), 4: ("fetch_failed", []), 5: ("ok", ["date"])}


def test_evidence_ladder(spark):
    rows = [(1, s, "number", v) for s, v in (("lead", "9"), ("known", "9"), ("odd", "8"))] + [(1, "known", "date", "d"), (2, "lead", "number", "1"), (2, "lead", "number", "1")]
    found = access.corroborated_evidence(
        spark.createDataFrame(rows, "entity int, source string, field string, value string"), F.col("source") == "lead", F.col("source") == "known", scores.confidence_ladder)
    got = {(r.entity, r.source, r.field): (r.others, r.confidence, r.status) for r in found.collect()}
    assert got == {
        (1, "lead", "number"): (1, 0.95, "usable"), (1, "known", "number"): (1, 0.7, "usable"), (1, "odd", "number"): (0, 0.4, "weak"),
        (1, "known", "date"): (0, 0.55, "corroborating"), (2, "lead", "number"): (0, 0.8, "weak")}


def test_access_classes(spark):
    rows = [("ROBOTS_DISALLOWED", "ok", None, 200, None), ("", "not_attempted", None, None, None), ("ROBOTS_FETCH_FAILED", "ok", None, 200, None), ("", "ok", "SOURCE_EMPTY", 200, None),
            ("", "failed", None, None, "Read timed out"), ("", "failed", None, 503, "no"), ("", "failed", None, None, None)]
    frame = spark.createDataFrame(rows, "robots string, request string, failure string, http int, error string")
    found = access.access_class(*(F.col(c) for c in ("robots", "request", "failure", "http", "error")))
    got = [tuple(r) for r in frame.select(found.alias("f")).select("f").collect()]
    assert [g[0] for g in got] == ["ROBOTS_DISALLOWED", "NOT_ATTEMPTED", "SUCCESSFUL_ACCESS", "SOURCE_EMPTY", "TARGET_TIMEOUT", "TARGET_HTTP_FAILURE", "TARGET_NETWORK_FAILURE"]
    assert [r.n for r in frame.select(access.stale_note(F.col("robots"), found).alias("n")).collect()] == [False, False, True, False, False, False, False]


def test_only_allowed_counters_rise(spark):
    rows = spark.createDataFrame([(1, 5, 0), (2, 0, 0)], "k int, added int, failed int")
    bumps = spark.createDataFrame([(1, "added", 2), (1, "added", 1), (1, "status", 9), (3, "added", 1)], "k int, counter string, n int")
    assert sorted(tuple(r) for r in access.bumped(rows, bumps, "k", ("added", "failed")).collect()) == [(1, 8, 0), (2, 0, 0)]


def test_last_episode_of_a_number_wins(spark):
    body = '{"_embedded": {"episodes": [{"name": "Episode 3", "airdate": "a"}, {"name": "x"}, {"name": "Ep. 03 b", "airdate": "b"}, {"name": "E2"}]}}'
    found = access.endpoint_index(spark.createDataFrame([(1, body), (2, "no"), (3, None)], "id int, body string"), "id", "body", text.entity_number(F.col("name")))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "E2", None), (1, 3, "Ep. 03 b", "b")]


def test_dry_run_tells_what_would_change(spark):
    items = spark.createDataFrame([(1, "t", 2020), (2, "t", 2021)], "number int, title string, year int")
    before = {"items": items, "images": spark.createDataFrame([], "number int, placeholder boolean"), "guests": spark.createDataFrame([(1, "Ann")], "ident long, name string"),
              "links": spark.createDataFrame([], "number int, ident long"), "years": spark.createDataFrame([(2020, 1)], "year int, total long")}
    wanted = spark.createDataFrame([(2, "other", 2021, ["Bob"]), (3, "n", 2020, ["Ann", "Bob", "Bob"])], "number int, title string, year int, guests array<string>")
    got = {r.part: (r.added, r.removed) for r in access.dry_run(before, commits.created(before, wanted)).collect()}
    assert got == {"items": (1, 0), "images": (1, 0), "guests": (1, 0), "links": (2, 0), "years": (1, 1)}


def test_created_reads_what_is_wanted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    empty = lambda ddl: spark.createDataFrame([], ddl)
    before = {"items": empty("number int, title string, year int"), "images": empty("number int, placeholder boolean"), "guests": empty("ident long, name string"),
              "links": empty("number int, ident long"), "years": empty("year int, total long")}
    wanted = spark.createDataFrame([(i, "t", 2020 + i % 2, ["Ann", "Bob", "Ann"]) for i in range(10)], "number int, title string, year int, guests array<string>")
    after = commits.created(before, wanted.mapInArrow(counted, wanted.schema))
    assert {name: rows.count() for name, rows in after.items()} == {"items": 10, "images": 10, "guests": 2, "links": 20, "years": 2}
    assert seen.value == 10


def test_import_texts(spark):
    titles = [("Episode #12 - The Race", "The Race"), ("episode #12", "none"), ("", "none"), (None, "none"), ("Plain", "Plain")]
    frame = spark.createDataFrame(titles, "t string, want string")
    assert all(r.got == r.want for r in frame.select("want", text.display_title(F.col("t"), "none").alias("got")).collect())
    urls = [("https://x.org/img/810.jpg", 810, True), ("https://x.org/2024/img-1280x720/811.jpg", 810, True), ("https://x.org/ep795.jpg?ep=810", 810, False), ("https://x.org/a.jpg", 810, True),
            ("https://x.org/700/810", 810, False), ("https://x.org/12345/1.jpg", 810, True), ("", 810, True), (None, 810, True)]
    frame = spark.createDataFrame(urls, "u string, n int, want boolean")
    assert [r.u for r in frame.select("u", "want", text.relevant_url(F.col("u"), F.col("n")).alias("got")).collect() if r.got != r.want] == []
    days = [("2024-05-06 10:00:00", "2024-05-06"), ("6 May 2024", "2024-05-06"), ("2008-12-31", None), ("2030-01-01", None), ("soon", None), (None, None)]
    frame = spark.createDataFrame(days, "d string, want string")
    assert [r.d for r in frame.select("d", "want", text.import_date(F.col("d")).cast("string").alias("got")).collect() if r.got != r.want] == []
    names = [("1. <b>Ann  Lee</b> (actor)", "Ann Lee", "annlee"), ("• 유재석 – host", "유재석", "유재석"), ("TBD", None, ""), ("x", None, ""), ("Ann [2]", "Ann", "ann"), (None, None, "")]
    frame = spark.createDataFrame(names, "n string, want string, key string")
    got = frame.select("n", "want", "key", text.plain_person(F.col("n"), ("tbd",)).alias("a"), text.plain_key(F.col("n"), ("tbd",)).alias("b")).collect()
    assert [r.n for r in got if (r.a, r.b) != (r.want, r.key)] == []
