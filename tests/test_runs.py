"""Traces, commits, resumed and live runs, greedy groups, prefixes, field-aware changes."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corrobora import plans
from corrobora.operators import commits, evidence, identity, quality, trace
from corrobora.streaming import health, resume, runs

OFFERS = "entity long, field string, source string, status string, value string, key string, rank int, valid boolean, reason string, at timestamp"


def offer(entity, field, source, value, rank, valid=True, status="ok", reason=None, at=datetime(2024, 1, 1)):
    return (entity, field, source, status, value, value and value.lower(), rank, valid, reason, at)


ROWS = [
    offer(1, "title", "a", "X", 1), offer(1, "title", "b", "x", 2), offer(1, "title", "c", "Y", 3), offer(1, "title", "d", "", 0, False, reason="empty, token=abcdef"),
    offer(1, None, "e", None, 4, False, "fetch_failed"), offer(2, "title", "c", "Z", 3, status="parser_warning"), offer(2, None, "a", None, 1, False, "missing_episode"),
    offer(2, "place", "c", "Q", 3), offer(2, "place", "c", "Q", 3, at=datetime(2024, 2, 1)),
]


def test_trace_and_report(spark):
    judged = trace.judged(spark.createDataFrame(ROWS, OFFERS))
    cell = {(r.source, r.field): (r.offered, r.agreed, r.rejected, r.conflicting) for r in trace.trace(judged).where("part = 'cell'").collect()}
    assert cell == {("a", "title"): (1, 1, 0, 0), ("b", "title"): (1, 1, 0, 0), ("c", "title"): (2, 1, 0, 1), ("d", "title"): (1, 0, 1, 0), ("c", "place"): (2, 2, 0, 0)}
    by_source = {r.source: (r.reached, r.unreached, r.parsed, r.warned, r.unlisted) for r in trace.trace(judged).where("part = 'source'").collect()}
    assert by_source["e"] == (0, 1, 0, 0, 0) and by_source["a"] == (1 + 1, 0, 1, 0, 1) and by_source["c"] == (4, 0, 3, 1, 0)
    assert {r.source: (r.title, r.place) for r in trace.field_matrix(judged, ["title", "place"]).collect()} == {"a": (1, 0), "b": (1, 0), "c": (2, 2)}
    old = spark.createDataFrame([(1, "title", "X"), (2, "place", "R"), (3, "title", "T")], "entity long, field string, old string")
    report = {(r.section, r.name, r["item"]): r.n for r in trace.run_report(judged, old).collect()}
    assert report["operation", "run", "offers"] == len(ROWS) and report["source_results", "e", "fetch_failed"] == 1
    assert report["database_state", "title", "unchanged"] == 1 and report["database_state", "title", "added"] == 1 and report["database_state", "place", "changed"] == 1
    assert report["field_analysis", "title", "conflicting"] == 1 and report["errors", "d", "empty, token=***"] == 1
    plan = trace.run_report(judged, old)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1


def test_filed_hashes_are_dealt_by_number(spark):
    hashes = spark.range(2000).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 19) - 1))).alias("h"))
    found = identity.near_hashes(hashes, "h", bits=19, most=2)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\((band#\d+), (value#\d+L?), (\d+)\), REPARTITION_BY_NUM", plan))
    assert len(dealt) == 2 and {int(n) for *_, n in dealt} == {parts}
    h = sorted({r.h for r in hashes.collect()})
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for i, a in enumerate(h) for b in h[i + 1:] if (a ^ b).bit_count() <= 2]


def test_lines_are_dealt_once(spark, sf_dir):
    """What is gathered of order lines by entity takes one shuffle of the lines, before they are taken apart; stored values and answers bring theirs."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, most in (("resolve_scalar", 1), ("evidence_candidates", 1), ("run_report", 3), ("decision_explain", 3)):
            plan = plans.plans()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            above, below = plan.split("REPARTITION_BY_NUM")
            assert plan.count("Exchange ") <= most and "Generate" not in below.split("FileScan")[0], name
            assert "ObjectHashAggregate(keys=[entity" not in above or name == "run_report", name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_provenance_cuts_changes(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = trace.provenance(one([(1, "s", 2)], "e long, source string, n int"), one([(1, "f", "s")], "e long, field string, source string"),
                           one([(1, i) for i in range(100)] + [(2, 5)], "e long, change int"), one([(3, "ko", "t")], "e long, lang string, title string"), "e", last=60).collect()
    by = {r.e: r for r in got}
    assert [c.change for c in by[1].changes] == list(range(99, 39, -1)) and by[2].sources == [] and by[3].titles[0].title == "t"


def test_one_of_two_writers_fails_whole(spark, tmp_path):
    root = str(tmp_path / "log")
    row = lambda x: spark.createDataFrame([(x,)], "x int")
    assert commits.latest(spark, root) == -1
    assert commits.commit(spark, root, {"a": row(1), "b": row(1)}, -1) == 0
    assert commits.commit(spark, root, {"a": row(2)}, 0) == 1
    before = sorted(p.name for p in (tmp_path / "log" / "data").iterdir())
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, {"a": row(3), "b": row(3)}, 0)
    broken = row(4).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        commits.commit(spark, root, {"b": row(4), "a": broken}, 1)
    assert sorted(p.name for p in (tmp_path / "log" / "data").iterdir()) == before  # nothing of the failed ones is left
    at, now = commits.snapshot(spark, root)
    assert (at, now["a"].first().x, now["b"].first().x) == (1, 2, 1)
    assert commits.snapshot(spark, root, 0)[1]["a"].first().x == 1
    (tmp_path / "log" / "_log" / f"{2:020d}.json").write_text('{"a": ')  # a writer that has not finished
    assert commits.latest(spark, root) == 1
    with pytest.raises(ValueError, match="no version"):
        commits.snapshot(spark, root, 7)


def test_transact_tries_again(spark, tmp_path):
    root, tries = str(tmp_path / "log"), []
    frame = lambda x: {"a": spark.createDataFrame([(x,)], "x int")}
    commits.commit(spark, root, frame(1), -1)

    def change(tables):
        if not tries:
            commits.commit(spark, root, frame(10), 0)  # another writer comes first
        tries.append(tables["a"].first().x)
        return frame(tries[-1] + 1)

    assert commits.transact(spark, root, change) == 2 and tries == [1, 10]
    assert commits.snapshot(spark, root)[1]["a"].first().x == 11


def split_events(spark, path, rows, files):
    """Rows of (event_id, ts, user_id, event_type) in files by time."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for i in range(files):
        part = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
        frame = spark.createDataFrame([(*r, 0.0, "") for r in part], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


def test_each_row_once_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "events")
    split_events(spark, path, [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 3, "view") for i in range(90)], 9)
    sink, checkpoint, killed = str(tmp_path / "out"), str(tmp_path / "checkpoint"), []

    def once(batch):
        if batch == 1 and not killed:
            killed.append(batch)
            raise RuntimeError("killed between write and commit")

    work = lambda batch: batch.select("event_id")
    with pytest.raises(Exception, match="killed"):
        resume.resumable(health.read_events(spark, path, 2), work, sink, checkpoint, once)
    assert resume.done(spark, sink, "event_id long").count() == 40  # the second batch is written, not committed
    resume.resumable(health.read_events(spark, path, 2), work, sink, checkpoint, once)
    got = sorted(r.event_id for r in resume.done(spark, sink, "event_id long").collect())
    assert got == list(range(90)) and killed == [1]
    left = resume.remaining(spark.range(100).withColumnRenamed("id", "event_id"), resume.done(spark, sink, "event_id long"), "event_id")
    assert [r.event_id for r in left.collect()] == list(range(90, 100))


def test_live_runs_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    at, rows = datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(seconds=rng.choice([1, 30, 200, 900, 2000]))
        rows.append((i, at, rng.randrange(5), rng.choice(["beat", "beat", "beat", "done", "fail", "fail"])))
    path = str(tmp_path / "events")
    split_events(spark, path, rows, 7)
    pick = lambda df: df.select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"))
    with runs.state_store(spark):
        health.run_once(runs.live_transitions(pick(health.read_events(spark, path, 1))), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    live = spark.read.schema(runs.SCHEMA).parquet(str(tmp_path / "out"))
    batch = runs.transitions(pick(spark.read.parquet(path)), F.lit(at - timedelta(minutes=10)))
    told = lambda df: sorted(tuple(map(str, r)) for r in df.select("run", "at", "before", "after", "attempts", "next_at").collect())
    assert told(live) == told(batch) and len(told(live)) > 200
    paused = live.where("after = 'paused'").count()
    rests = {(r.next_at - r.at).total_seconds() for r in live.where("after = 'failed'").collect()}
    assert paused > 10 and {3600, 7200} <= rests and max(rests) <= 16 * 3600


@pytest.mark.parametrize("seed", range(4))
def test_greedy_groups_as_the_walk(spark, seed):
    rng = random.Random(seed)
    n = 60
    near = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)} | ({(i, i + 1) for i in range(n - 1)} if seed == 3 else set())
    seen, want = set(), []
    for a in range(n):
        if a not in seen:
            group = [b for b in range(n) if b not in seen and b != a and ((a, b) in near or (b, a) in near)]
            if group:
                seen |= {a, *group}
                want += [(a, a)] + [(b, a) for b in group]
    got = identity.greedy_groups(spark.createDataFrame([*near, *list(near)[:5]], "a int, b int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_groups_without_pairs(spark):
    assert identity.greedy_groups(spark.createDataFrame([], "a int, b int")).count() == 0


def test_prefix_pairs_shuffle_beginnings_only(spark, capsys):
    """Whole texts stay where they lie if only the prefixes that they begin with are asked for."""
    texts = spark.createDataFrame([(i, "abc" * i) for i in range(40)], "i long, t string")
    joined = identity.prefix_pairs(texts, spark.createDataFrame([("abca",), ("abcabcab",), ("b",)], "p string"), "t", "p").select("i", "p")
    assert sorted(map(tuple, joined.collect())) == sorted((i, p) for i in range(40) for p in ("abca", "abcabcab", "b") if ("abc" * i).startswith(p))
    joined.explain("formatted")
    dealt = [x for x in capsys.readouterr().out.split("\n\n") if re.match(r"\(\d+\) (Exchange|BroadcastExchange)", x)]
    assert dealt and not any(re.search(r"\bt#", x) for x in dealt)


def test_prefix_pairs(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 70))) for _ in range(150)]
    prefixes = sorted({t[: rng.randint(0, 40)] for t in texts[:60]} | {"a", "ü", "b" * 64})
    joined = identity.prefix_pairs(spark.createDataFrame([(t,) for t in [*texts, "über", None]], "t string"), spark.createDataFrame([(p,) for p in prefixes], "p string"), "t", "p", longest=32)
    got = sorted((r.t, r.p) for r in joined.collect())
    assert got == sorted((t, p) for t in [*texts, "über"] for p in prefixes if p and t.startswith(p))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_field_changes(spark):
    old = spark.createDataFrame([
        (1, "air_date", "2024-03-09", "web"), (2, "title", "Episode #001 - A long descriptor", "web"), (3, "synopsis", "Some long text that says it all, and more.", "web"),
        (4, "title", "Episode #004 - Name", "tv"), (5, "location", "Seoul, Korea", "web"), (6, "notes", "kept", "web"), (8, "notes", "n", "web")], "entity int, field string, old string, old_source string")
    new = spark.createDataFrame([
        (1, "air_date", "9 March 2024", "tv", "HIGH"), (2, "title", "Episode #001", "tv", "HIGH"), (3, "synopsis", "Some long text that says it all", "tv", "HIGH"),
        (4, "title", "Episode #004 - Another", "web", "HIGH"), (5, "location", "Busan", "tv", "CONFLICT"), (6, "notes", " ", "tv", "LOW"), (7, "notes", "new", "web", "LOW"), (8, "notes", "m", "tv", "HIGH")],
        "entity int, field string, new string, source string, confidence string")
    got = {r.entity: (r.change, r.reason, r.applied) for r in evidence.diff_fields(old, new, F.when(F.col("source") == "tv", 2).otherwise(1)).collect()}
    assert got == {
        1: ("UNCHANGED", None, False), 2: ("REJECTED", "descriptor lost", False), 3: ("REJECTED", "cut short", False), 4: ("REJECTED", "weaker source", False),
        5: ("CONFLICT", None, True), 6: ("KEPT", None, False), 7: ("ADDED", None, True), 8: ("CHANGED", None, True),
    }


def test_newest_number(spark):
    said = [(1, "a", 800), (1, "b", 801), (1, "c", 950), (2, "a", 900), (3, "a", 700), (3, "b", 710), (4, "a", 5000), (5, "a", 801), (5, "b", 801)]
    archive = [(1, 799), (2, 800), (3, 705), (4, 0), (5, 0)]
    found = quality.detected_latest(spark.createDataFrame(said, "entity int, source string, n int"), spark.createDataFrame(archive, "entity int, known int"))
    got = {r.entity: (r.latest, r.confidence, r.cut) for r in found.collect()}
    assert got == {1: (801, "medium", 1), 2: (800, "conflict", 0), 3: (710, "conflict", 0), 4: (None, "low", 0), 5: (801, "high", 0)}
