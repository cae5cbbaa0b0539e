"""Byte-pair encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corrobora.llm import queries
from corrobora.llm.forced_bpe import Codec, Merges, decode_ids, default_merges, encode_texts, unpacked

ODD = [
    "Hello  World's x<|endoftext|>y 123 ΑΣ İé é \x1c a\x1cb",
    "<|startoftext|><|endoftext|>",
    "A<|ENDOFTEXT|> e<|endoftext|>́ <|endof",
    "日本語 \U0001f642!!! a\u0000b \u0085 　",
    "x" * 5000,
    "ab" * 7000,
    "=-" * 3000 + "!" * 1001,
    "I'LL we've don't 'S ''s '",
    "",
    None,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def codec():
    return Codec(default_merges())


def same(codec, library, texts):
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, a, b, w, back in zip(texts, ends - counts, ends, want, codec.decode(ids, counts), strict=True):
        assert ids[a:b].tolist() == w.ids, t
        assert back == library.decode(w.ids, skip_special_tokens=False), t


def test_texts_as_the_library(codec, library):
    rng = random.Random(5)
    letters = "abcdefgh 'stre" + "éüß日́<|>.!1٣Σ"
    same(codec, library, ODD)
    same(codec, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(1500)])
    same(codec, library, ["".join(rng.choice("abcdetrsn") for _ in range(rng.randint(20, 900))) for _ in range(300)])
    same(codec, library, [f"x{chr(c)}1x{chr(c)}" for c in range(0x20, 0x1C80)])


def test_cuts_are_forced(codec):
    """No token spans a cut, and whole words merge to what their fragments merge to."""
    rng = random.Random(6)
    for _ in range(2000):
        word = "".join(rng.choice("abxzqé日'-") for _ in range(rng.randint(1, 30))).encode()
        symbols = np.frombuffer(word, np.uint8).astype(np.uint16)
        symbols[-1] += 256
        ends = [0, *(np.flatnonzero(codec.cuts(symbols)) + 1).tolist()]
        assert ends[-1] == len(symbols)
        parts = [x for a, b in zip(ends, ends[1:], strict=False) for x in codec.merge(codec.base[symbols[a:b]].tolist())]
        assert parts == codec.merge(codec.base[symbols].tolist())


def test_forgetting(codec, library, monkeypatch):
    monkeypatch.setattr("corrobora.llm.forced_bpe._KEPT", 3)
    for text in ODD:
        same(codec, library, [text, "again and again"])


def test_frames(spark, messy, empty, library):
    merges = default_merges()
    coded = encode_texts(messy, merges, decoded=True)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = coded.select("*", unpacked().alias("list")).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in messy.collect())
    assert all(len(r.ids) == 4 * r.n_tokens == 4 * len(r.list) for r in rows)
    back = {(r.doc_id, r.text) for r in decode_ids(coded, merges).collect()}
    assert back == {(r.doc_id, r.decoded) for r in rows}
    assert encode_texts(empty, merges).count() == 0 == decode_ids(encode_texts(empty, merges), merges).count()
    for r in messy.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert any(x.doc_id == r.doc_id and x.list == ids for x in rows)


def test_query(spark, sf_dir, small, library):
    got = {r.doc_id: r for r in queries.plans()["op11_forced_bpe"](spark, sf_dir).collect()}
    for r in small.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="only byte-level BPE"):
        Merges.load(public_tokenizers.path("byte_bpe_50k.json"))
