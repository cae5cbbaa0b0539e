"""Exact, SimHash and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corrobora.llm import simhash, suffix_dedup
from corrobora.llm.components import connected_components
from corrobora.llm.exact_dedup import NODE_BYTES, Mark, PatriciaTrie, distinct_rows, exact_dedup
from corrobora.llm.simhash import fingerprint, forest, near_links, simhash_classes
from corrobora.llm.suffix_dedup import removal_report, repeated_windows


@given(st.lists(st.tuples(st.text("ab", max_size=6), st.integers(0, 50)), max_size=60))
@settings(max_examples=80, deadline=None)
def test_trie_against_a_dict(pairs):
    trie, want = PatriciaTrie(True), {}
    for s, i in pairs:
        assert trie.add(s.encode(), Mark(s, i))
        owner, n = want.get(s.encode(), (i, 0))
        want[s.encode()] = (max(owner, i), n + 1)
    assert {k: (m.owner, m.copies) for k, m in trie.terminals()} == want


@given(st.lists(st.text("ab", max_size=7), min_size=1, max_size=40), st.sampled_from([b"", b"same start "]))
@settings(max_examples=80, deadline=None)
def test_trie_hands_on_subtrees(texts, start):
    """Whatever is asked for, strings leave or stay whole, and one stays."""
    keys = {start + t.encode() for t in texts}
    trie = PatriciaTrie(False)
    for k in keys:
        trie.add(k, Mark(k, 1))
    gone = {k for k, _ in trie.hand_on(0)}
    left = {k for k, _ in trie.terminals()}
    assert gone | left == keys and not gone & left and len(left) == 1
    assert not any(trie.add(k, Mark(k, 1)) for k in gone) and all(trie.add(k, Mark(k, 1)) for k in left)


def test_trie_hands_on_equal_subtrees():
    """Subtrees of one size, the smallest byte first: all but one go, and it ends."""
    trie = PatriciaTrie(False)
    for k in (b"a", b"b", b"c"):
        trie.add(k, Mark(k, 1))
    assert len(list(trie.hand_on(0))) == 2 and len(list(trie.terminals())) == 1


def test_trie_keeps_to_its_budget():
    trie = PatriciaTrie(False)
    for i in range(4000):
        trie.add(b"<html><body>%d</body>" % (i * 7919), Mark(i, i))
    assert trie.size > 4000 * NODE_BYTES
    gone = list(trie.hand_on(300_000))
    assert 100_000 < trie.size <= 300_000 and len(gone) + len(list(trie.terminals())) == 4000


def _exact(rows, keep=max):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = [i for i in groups[r.text or ""] if i is not None]
        owner = keep(ids) if ids else None
        sha = hashlib.sha256((r.text or "").encode()).hexdigest()
        out.append((r.doc_id, owner, len(groups[r.text or ""]), r.doc_id == owner, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [1 << 20, 2000])
def test_exact_dedup(messy, budget):
    """The small budget makes tries spill by subtree over several rounds."""
    got = exact_dedup(messy, trie_bytes=budget)
    assert got.columns[:5] == messy.columns[:5]
    rows = got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == _exact(messy.collect())


def test_exact_dedup_spills_behind_a_common_start(spark):
    """Many small texts that all begin alike: tries spill over several rounds and lose nothing."""
    rows = [(i, "<!doctype html> " + str(i % 3000)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in exact_dedup(docs, trie_bytes=100_000).collect()}
    assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (i % 3000 + 3000, 2, i >= 3000) for i in range(6000))


@pytest.mark.parametrize("budget", [1 << 20, 2000])
def test_distinct_rows(messy, budget):
    rows, got = messy.collect(), distinct_rows(messy, trie_bytes=budget)
    assert got.columns == messy.columns and got.dtypes == messy.dtypes
    kept = [tuple(r) for r in got.collect()]
    assert {r[1] or "" for r in kept} == {r.text or "" for r in rows} and len(kept) == len({r.text or "" for r in rows})
    assert all(tuple(k) in {tuple(r) for r in rows} for k in kept)
    for k in kept:
        ids = [r.doc_id for r in rows if (r.text or "") == (k[1] or "") and r.doc_id is not None]
        assert k[0] == (max(ids) if ids else None)


def test_exact_dedup_smallest(small):
    got = exact_dedup(small, keep="min").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == _exact(small.collect(), min)


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == 0
    assert distinct_rows(empty).columns == empty.columns and distinct_rows(empty).count() == 0
    assert simhash_classes(empty).count() == 0
    assert removal_report(empty).count() == 0


def test_fingerprint_by_definition():
    for text in ("a b c d e f g a b c", "One", "two words", "ABC abc\tABC\x0babc", "", None, "é É x y z", "\x1f q  r"):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert fingerprint(text) == want


def _components(fps, ids, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[find(i)] = min(best.get(find(i), x), x)
    return [best.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("name", ["messy", "small"])
def test_simhash(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, _components(fps, [r.doc_id for r in rows], 3), strict=True)), key=str)
    assert sorted(map(tuple, simhash_classes(docs).collect()), key=str) == want


def test_dense_near_links(spark):
    """A chain and a ball of fingerprints: every link between different ones must be joined."""
    draw = random.Random(3)
    fps = {0}
    at = draw.getrandbits(64)
    for _ in range(150):
        at ^= 1 << draw.randrange(64)
        fps |= {at, at ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))}
    fps |= {draw.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    for r in links.collect():
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3
    root = {r.node: r.root for r in connected_components(links).collect()}
    got = defaultdict(set)
    for s in signed:
        got[root.get(s, s)].add(s)
    want = defaultdict(set)
    for s, c in zip(signed, _components(fps, signed, 3), strict=True):
        want[c].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_large_buckets_are_split(monkeypatch):
    """Fingerprints that share a half: splitting by bytes of the other half joins the same components."""
    draw = random.Random(5)
    centres = [draw.getrandbits(32) for _ in range(25)]
    low = {c ^ sum(1 << b for b in draw.sample(range(32), draw.randrange(4))) for c in centres for _ in range(20)}
    fps = [(77 << 32) | x for x in sorted(low)]
    filed, looked = fps[::2], [f ^ (1 << 40) for f in fps[1::2]]

    def joined(links):
        parent = {f: f for f in filed + looked}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        groups = defaultdict(set)
        for f in parent:
            groups[find(f)].add(f)
        return sorted(map(sorted, groups.values()))

    whole = forest(np.array(filed, np.uint64), np.array(looked, np.uint64), 3)
    monkeypatch.setattr(simhash, "SPLIT_BUCKET", 10)
    split = simhash.bucket_links(np.array(filed, np.uint64), np.array(looked, np.uint64), 3, 0)
    assert joined(split) == joined(whole)


def test_forest_spans():
    filed = np.array([0, 1, 3, 7, 1 << 40], np.uint64)
    links = forest(filed, np.array([15], np.uint64), 1)
    assert sorted(links) == [(0, 1), (0, 1 << 40), (1, 3), (3, 7), (7, 15)]


@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(8, 12))
@settings(max_examples=60, deadline=None)
def test_repeated_windows(texts, size):
    bodies = [t.encode() for t in texts if len(t) >= size]
    if not bodies:
        return
    counts = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    want = [{i for i in range(len(b) - size + 1) if counts[b[i : i + size]] > 1} for b in bodies]
    got = [{x for i, j in runs for x in range(i, j)} for runs in repeated_windows(bodies, [1] * len(bodies), size)]
    assert got == want


def _removed(rows, size=400):
    counts = Counter()
    for r in rows:
        b = (r.text or "").encode()
        counts.update(hash(b[i : i + size]) for i in range(len(b) - size + 1))
    out = []
    for r in rows:
        b, spans = (r.text or "").encode(), []
        for i in range(len(b) - size + 1):
            if counts[hash(b[i : i + size])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        kept, at = b"", 0
        for i, j in spans:
            kept, at = kept + b[at:i], j
        kept += b[at:]
        out.append((r.doc_id, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [512, 1])
@pytest.mark.parametrize("name", ["messy", "small"])
def test_removal(name, many, request, monkeypatch):
    """With ``many`` 1, names with two different segments are dealt anew down to single windows."""
    docs = request.getfixturevalue(name)
    defaults = suffix_dedup.repeated_spans.__defaults__
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", tuple(many if d == 512 else d for d in defaults))
    assert sorted(map(tuple, removal_report(docs).collect()), key=str) == _removed(docs.collect())


@pytest.mark.parametrize("kind", ["passage", "edits", "periods"])
def test_names_with_many_segments(spark, kind, monkeypatch):
    """A passage in many contexts, many edited copies, or texts with a period: few rows for a segment, right results."""
    draw = random.Random(7)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    base, rows = words(130), []
    for i in range(400):
        if kind == "passage":
            text = words(draw.randrange(40)) + base[100:820] + words(draw.randrange(40))
        elif kind == "edits":
            at = draw.randrange(len(base))
            text = base[:at] + words(1) + base[at:]
        else:
            text = words(draw.randrange(20)) + words(2) * 60 if i % 9 else "-" * draw.randrange(300, 900)
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []

    def counted(df):
        out = durable(df)
        if "form" in out.columns:
            made.append(out.count())
        return out

    durable = suffix_dedup.durable
    monkeypatch.setattr(suffix_dedup, "durable", counted)
    defaults = suffix_dedup.repeated_spans.__defaults__
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", tuple(16 if d == 512 else d for d in defaults))
    assert sorted(map(tuple, removal_report(docs).collect()), key=str) == _removed(docs.collect())
    windows = sum(max(len(t) - 399, 0) for _, t in rows)
    assert kind == "periods" or made and sum(made) < windows / 6


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    draw = random.Random(1)
    part = "".join(draw.choice("abcdefgh ") for _ in range(900))
    rest = ["".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (700, 1500, 3)]
    docs = spark.createDataFrame([(1, rest[0] + part + rest[1]), (2, rest[2] + part), (3, rest[1][:399])], "doc_id long, text string")
    assert sorted(map(tuple, removal_report(docs).collect()), key=str) == _removed(docs.collect())
