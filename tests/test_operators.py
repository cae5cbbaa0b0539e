from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import catalog, evidence, identity, quality, state
from corrobora.sources import files, html
from corrobora.streaming import health


def test_optional_filters_keep_false(spark):
    df = spark.createDataFrame([(1, False, "Ab"), (2, True, "b"), (3, None, None)], "k int, special boolean, name string")
    keys = lambda **a: [r.k for r in catalog.optional_filters(df, search_in=("name",), **a).orderBy("k").collect()]
    assert keys() == [1, 2, 3]
    assert keys(equal={"special": False}) == [1]
    assert keys(equal={"special": None}, search="B") == [1, 2]


def test_page_is_clamped(spark):
    df = spark.range(10)
    got = lambda n: [r.id for r in catalog.page(df, [F.col("id")], n, 4).collect()]
    assert got(0) == [0, 1, 2, 3]
    assert got(99) == [8, 9]
    assert catalog.page(df.limit(0), [F.col("id")], 1, 4).collect() == []


def test_staged_top_up(spark):
    s = lambda *x: spark.createDataFrame([(k, f) for k, f in x], "k int, far int")
    got = catalog.staged_top_up([s((1, 5)), s((1, 0), (2, 1)), s((3, 0), (4, 0))], "k", 3, ["far"]).collect()
    assert [(r.k, r.stage) for r in got] == [(1, 0), (2, 1), (3, 2)]


def test_spread_sample(spark):
    assert sorted(r.id for r in catalog.spread_sample(spark.range(101), "id", 5).collect()) == [0, 25, 50, 75, 100]
    assert catalog.spread_sample(spark.range(2), "id", 5).count() == 2
    assert catalog.spread_sample(spark.range(0), "id", 5).count() == 0


def test_numbering_gaps_across_blocks(spark):
    df = spark.createDataFrame([(1,), (3,), (3,), (None,), (20_001,), (20_003,)], "k long")
    got = [r.k for r in quality.numbering_gaps(df, "k").collect()]
    assert len(got) == 1 + (20_001 - 4) + 1
    assert {2, 4, 20_000, 20_002} <= set(got)


def test_percent_of_nothing(spark):
    assert spark.range(1).select(quality.percent(F.lit(0), F.lit(0)).alias("x")).first().x == 0.0


def test_streaks(spark):
    rows = [("a", i, f) for i, f in enumerate([1, 1, 0, 1])] + [("b", 0, 0)]
    got = quality.streaks(spark.createDataFrame(rows, "s string, i int, f int"), "s", ["i"], F.col("f") == 1)
    assert {r.s: (r.current_streak, r.longest_streak) for r in got.collect()} == {"a": (1, 2), "b": (0, 0)}


def _evidence(spark, rows):
    names = "entity int, field string, source string, value string, tier int, rank int, family string, verify_only boolean, reliability int"
    return spark.createDataFrame(rows, names)


def _decided(spark, rows, old=None):
    ev = _evidence(spark, rows)
    found = evidence.candidates(evidence.independence(ev, F.lit(True), F.length("value"), F.sha1(F.col("value").cast("binary"))))
    existing = spark.createDataFrame([(1, "f", old, 50)], "entity int, field string, old string, old_confidence int")
    return found.collect(), evidence.decide(found, existing, F.lit("secondary")).first().decision


def test_copied_texts_are_one_witness(spark):
    long = "x" * 60
    found, _ = _decided(spark, [(1, "f", s, long, 1, 0, None, False, 70) for s in "abc"])
    assert found[0].independent == 1
    found, _ = _decided(spark, [(1, "f", s, "short", 1, 0, None, False, 70) for s in "abc"])
    assert found[0].independent == 3


def test_verification_only_never_fills(spark):
    rows = [(1, "f", "a", "v", 1, 0, None, True, 95)]
    assert _decided(spark, rows)[1] == "REVIEW"
    assert _decided(spark, rows, "old")[1] == "REVIEW"
    assert _decided(spark, [(1, "f", "a", "v", 1, 0, None, False, 95)])[1] == "FILL"
    assert _decided(spark, [(1, "f", "a", "V ", 1, 0, None, False, 95)], "v")[1] == "KEEP"
    assert _decided(spark, [(2, "f", "a", "v", 1, 0, None, False, 95)], "old")[1] in ("UNKNOWN", "FILL")


def test_decision_scores(spark):
    """A lone witness costs 6, a rival its share; what is kept is the stored value; the bar goes by criticality."""
    rows = [(1, "f", "a", "v", 1, 0, None, False, 90), (1, "f", "b", "v", 1, 0, None, False, 80), (1, "f", "c", "w", 1, 0, None, False, 40)]
    found = evidence.candidates(evidence.independence(_evidence(spark, rows), F.lit(False), F.length("value"), F.col("value")))
    existing = spark.createDataFrame([(1, "f", "old", 50)], "entity int, field string, old string, old_confidence int")
    # 90 + 10 * 0.35 * 0.80 = 93; less round(40 * 1/2 * 0.35) = 7
    for level, want in (("secondary", "UPDATE"), ("important", "UPDATE"), ("critical", "REVIEW")):
        got = evidence.decide(found, existing, F.lit(level)).first()
        assert (got.decision, got.confidence, got.value) == (want, 86, "v")
    kept = evidence.decide(found.where("value = 'w'"), existing, F.lit("critical")).first()
    assert (kept.decision, kept.value, kept.confidence) == ("KEEP", "old", 50)


def test_agreement_and_conflict(spark):
    """Tiers from 2 up are trusted; what counts is the best tier among those that agree."""
    one = lambda *rows: evidence.resolve_scalar(_evidence(spark, list(rows)), F.lower("value")).first()
    high = one((1, "f", "a", "v", 2, 0, None, False, 0), (1, "f", "b", "V", 3, 1, None, False, 0))
    assert (high.value, high.source, high.agree, high.confidence) == ("v", "a", 2, "HIGH")
    torn = one((1, "f", "a", "v", 1, 0, None, False, 0), (1, "f", "c", "v", 2, 2, None, False, 0), (1, "f", "b", "w", 2, 1, None, False, 0))
    assert (torn.confidence, torn.conflicts) == ("CONFLICT", 1)
    assert one((1, "f", "a", "v", 1, 0, None, False, 0), (1, "f", "b", "w", 2, 1, None, False, 0)).confidence == "LOW"


def test_published_together(spark, tmp_path):
    from corrobora.operators import writes

    root = str(tmp_path / "store")
    writes.publish(spark, {"a": spark.range(2), "b": spark.range(3)}, root)
    writes.publish(spark, {"a": spark.range(5)}, root)
    spark.range(9).write.parquet(f"{root}/a/unfinished")  # no manifest names it
    assert writes.published(spark, root, "a").count() == 5 and writes.published(spark, root, "b").count() == 3


def test_diff_guards(spark):
    old = spark.createDataFrame([(1, "x" * 50), (2, "abc"), (3, None), (4, "abc"), (5, "q")], "k int, value string")
    new = spark.createDataFrame([(1, "short"), (2, "ab"), (3, "n"), (4, ""), (6, "z")], "k int, value string")
    got = {r.k: r.change for r in evidence.diff(old, new, ["k"]).collect()}
    assert got == {1: "REJECTED", 2: "REJECTED", 3: "ADDED", 4: "REJECTED", 5: "REJECTED", 6: "ADDED"}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, s string, n int")
    assert sorted(map(tuple, evidence.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert sorted(r.k for r in evidence.insert_new(old, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted(map(tuple, evidence.replace_set(old, new, ["k"]).collect())) == [(1, "a", 1), (2, None, 5), (3, "c", 6)]


def test_numbering_gaps_of_many_numbers(spark):
    df = spark.createDataFrame([(0,), (3_000_000,), (3_000_001,), (None,)], "k long")
    found = quality.numbering_gaps(df, "k", step=1000).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    assert tuple(found) == (2_999_999, 1, 2_999_999)
    assert quality.numbering_gaps(df.limit(0), "k").count() == 0


def test_numbered_places(spark):
    rng = random.Random(3)
    rows = [(k, k % 3 or None) for k in rng.sample(range(-50_000, 10**7), 4000)]
    df = spark.createDataFrame(rows, "k long, g long")
    want, seen = {}, {}
    for k, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    assert {r.k: r.place for r in quality.numbered(df, "k", "place", F.col("g")).collect()} == want
    every = {r.k: r.place for r in quality.numbered(df, "k", "place").collect()}
    assert every == {k: i for i, k in enumerate(sorted(k for k, _ in rows), 1)}


def test_smoothed_is_the_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), t, rng.randint(-40, 90)) for t in range(3000)] + [("c", 1, None), ("d", 1, -7)]
    got = quality.smoothed(spark.createDataFrame(rows, "u string, t long, v long").repartition(5), "u", ["t"], F.col("v"))
    want = {}
    for u, _, v in sorted(rows, key=lambda r: r[1]):
        a, v = want.get(u, 0), v or 0
        x = (3 * a + v) / 4
        want[u] = v if a == 0 else int(math.copysign(math.floor(abs(x) + 0.5), x))
    assert {r.u: r.smoothed for r in got.collect()} == want


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (2, "x")], "k long, t string")
    got = sorted((r.h or "", r.n, r.k) for r in quality.duplicate_rows(df, F.coalesce("t", F.lit("")), "k").collect())
    assert got == [("", 2, 4), ("", 2, 5), ("x", 3, 1), ("x", 3, 2), ("x", 3, 2)]


def test_near_names(spark):
    names = ["jonathan", "jonathon", "jnathan", "xonathan", "maria", "marai", "", None, "a", "b", "jonathan"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, n string")
    got = {(r.a, r.b): r.distance for r in identity.near_names(df, "k", "n", 2).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    known = sorted({n for n in names if n})
    want = {(a, b): edits(a, b) for a in known for b in known if a < b and edits(a, b) <= 2}
    assert got == want


def test_hamming(spark):
    of = lambda a, b: spark.range(1).select(identity.hex_hamming(F.lit(a), F.lit(b)).alias("x")).first().x
    assert of("00ff", "0f0f") == 8
    assert of("00", "000") is None
    assert of("", "") is None
    df = spark.createDataFrame([(0,), (255,), (7,), (1 << 62,)], "h long")
    assert {(r.a, r.b) for r in identity.near_hashes(df, "h", most=5).collect()} == {(0, 7), (7, 255), (0, 1 << 62), (7, 1 << 62)}


def test_near_hashes_by_brute_force(spark):
    rng = random.Random(8)
    for bits, most in ((63, 8), (19, 2), (30, 3), (12, 1), (10, 0)):
        base = [rng.getrandbits(bits) for _ in range(60)]
        near = [h ^ sum(1 << i for i in rng.sample(range(bits), rng.randint(0, most + 1))) for h in base for _ in range(3)]
        all_ = sorted({*base, *near})
        want = sorted((a, b, (a ^ b).bit_count()) for i, a in enumerate(all_) for b in all_[i + 1 :] if (a ^ b).bit_count() <= most)
        df = spark.createDataFrame([(h,) for h in [*base, *near, None]], "h long")
        assert sorted(map(tuple, identity.near_hashes(df, "h", bits, most).collect())) == want
    with pytest.raises(ValueError, match="too few"):
        identity.near_hashes(df, "h", 63, 8, bands=2)


def test_claim_and_recency(spark):
    q = spark.createDataFrame([(1, 10, 1, "queued", 0), (1, 11, 0, "done", 0), (1, 12, 0, "queued", 2)], "run int, item int, position int, state string, attempts int")
    assert tuple(state.claim_next(q, "run").select("item", "state", "attempts").first()) == (12, "researching", 3)
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], "u int, i string, t int")
    assert [(r.i, r.place) for r in state.recency_list(v, "u", "i", ["t"]).orderBy("place").collect()] == [("a", 1), ("b", 2)]


def test_stalled_by_part_of_a_second(spark):
    beats = spark.sql("SELECT * FROM VALUES ('now', TIMESTAMP_NTZ'2024-01-02 06:00:00.5'), ('just', TIMESTAMP_NTZ'2024-01-02 00:00:00.5'), ('over', TIMESTAMP_NTZ'2024-01-02 00:00:00.2') t(k, ts)")
    assert [tuple(r) for r in state.stalled(beats, "k", "ts", 6 * 3600).select("k", "silent").collect()] == [("over", 21600)]


def test_tables_with_spans(spark):
    page = "<table><tr><th>No</th><th>Title</th></tr><tr><td rowspan=2>1</td><td>A &amp; B</td></tr><tr><td>C</td></tr><tr><td colspan='2'>end</td></tr></table>"
    cells = html.table_cells(spark.createDataFrame([(1, page), (2, None), (3, "no table")], "id int, html string"), "id", "html")
    got = {(r.row, r.column): r.text for r in cells.collect()}
    assert got == {(0, 0): "No", (0, 1): "Title", (1, 0): "1", (1, 1): "A & B", (2, 0): "1", (2, 1): "C", (3, 0): "end", (3, 1): "end"}
    records = html.rows_by_header(cells, "id", {"number": "(?i)^no", "title": "(?i)^title"}).orderBy("row").collect()
    assert [(r.number, r.title) for r in records] == [("1", "A & B"), ("1", "C"), ("end", "end")]


def test_boxes_and_patterns(spark):
    page = "<h3 class='pi-data-label'>Air date</h3><div class='pi-data-value'>1 May</div>"
    got = html.box_pairs(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").first()
    assert tuple(got) == (1, "Air date", "1 May")
    of = lambda c: spark.range(1).select(c.alias("x")).first().x
    rules = "User-agent: a\nDisallow: /\nUser-agent: *\nDisallow: /x\nAllow: /x/ok\n"
    assert [of(html.robots_allows(F.lit(rules), F.lit(p))) for p in ("/", "/x/1", "/x/ok/2")] == [True, False, True]
    assert of(html.meta(F.lit('<meta property="og:image" content="u">'), "og:image")) == "u"
    assert of(html.embedded_json(F.lit('<script type="application/ld+json">{"a":1}</script>'))) == ['{"a":1}']
    sitemap = "<loc>http://h/ep-007</loc><loc>http://h/ep-70</loc>"
    assert of(html.sitemap_links(F.lit(sitemap), F.lit(7))) == ["http://h/ep-007"]
    assert of(html.block_around(F.lit("abc 12 def"), F.lit(12), 2, 5)).startswith("c 12")


def test_files(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([("a, b", 'say "x"\nline'), ("c", "")], "k string, v string")
    files.write_csv(df.coalesce(1), str(tmp_path / "out.csv"))
    back = files.read_any(spark, str(tmp_path / "out.csv"))
    assert sorted((r.k, r.v or "") for r in back.collect()) == sorted((r.k, r.v) for r in df.collect())
    files.write_json_lines(df, str(tmp_path / "out.json"))
    assert files.read_any(spark, str(tmp_path / "out.json")).count() == 2
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    assert files.read_any(spark, str(tmp_path / "s.xlsx")).first().cells == ["name", "5"]
    cache = spark.createDataFrame([("p", "a", 10), ("p", "b", 30)], "kind string, key string, expires int")
    assert tuple(files.cache_stats(cache, 20).first()) == ("p", 2, 1)


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    source = str(tmp_path / "in")
    edges = [None, "2024-01-10", "2024-01-20", None]
    for low, high in zip(edges, edges[1:], strict=False):  # files in order of time
        part = events.where(f"ts >= '{low}'" if low else "true").where(f"ts < '{high}'" if high else "true")
        part.coalesce(1).write.mode("append").parquet(source)
    health.run_once(health.failure_rates(health.read_events(spark, source), "1 day", "60 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.schema("started timestamp, user_id long, events long, failures long").parquet(str(tmp_path / "out")).count() == 0
    # Files come in order of time, so no event is late and each window that the last event closes is right.
    health.run_once(health.failure_rates(health.read_events(spark, source, 1), "1 hour", "0 seconds"), str(tmp_path / "out2"), str(tmp_path / "check2"))
    told = lambda df: sorted((str(r.started), r.user_id, r.events, r.failures) for r in df.collect())
    newest = events.agg(F.max("ts")).first()[0]
    hours = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("started"), "user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"))
    closed = hours.where(F.col("started") + F.expr("INTERVAL 1 HOUR") <= F.lit(newest).cast("timestamp"))
    assert told(spark.read.parquet(str(tmp_path / "out2"))) == told(closed) and closed.count() > 0
