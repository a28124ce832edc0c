"""Encoding and decoding against the public library."""

import hashlib
import os
import random
import sys

import pytest

from seston.llm import bpe
from seston.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.MODEL), reason="no vocabulary files")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    with open(bpe.MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(data):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode())


def texts():
    rng = random.Random(3)
    words = ["the", "attion", "It's", "we'LL", "ÉÈaux", "Straße", "ΣΟΦΌΣ", "niño", "ñ", "x1234", "$$$", "aaaaaaaaaaaa", "日本語", "🙂", "\n", "  ",
             "\t", " ", "\u0085", "İ", "<|endoftext|>", "<|startoftext|>x", "<|endoftext", "\0", "²½", "_"]
    out = [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    out += ["".join(chr(rng.choice([rng.randint(1, 126), rng.randint(160, 600)])) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    out += ["".join(rng.choice("abcdeinorst ") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    return out + ["", " ", "a", "lower" * 900, "ab" * 500, "q" * 3001, "zq" * 70_000]


def test_as_the_library(data, library):
    encoder = bpe.Encoder(data)
    given = texts()
    for text, ids in zip(given, encoder.encode(given), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:100])
        assert encoder.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_character(data, library):
    """Classes, lower case and composition of all characters, in groups."""
    encoder = bpe.Encoder(data)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    given = [" a".join(chars[i : i + 64]) for i in range(0, len(chars), 64)]
    theirs = library.encode_batch(given, add_special_tokens=False)
    for text, ids, their in zip(given, encoder.encode(given), theirs, strict=True):
        assert ids.tolist() == their.ids, hex(ord(text[0]))


def test_both_ways_of_merging(data):
    encoder = bpe.Encoder(data)
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(9, 16))) for _ in range(300)]
    inner, last = encoder.model.inner, encoder.model.last
    for word, ids in zip(words, encoder.merge_in_step([w.encode() for w in words], 16), strict=True):
        raw = word.encode()
        assert ids == encoder.merge_one([*inner[list(raw[:-1])].tolist(), int(last[raw[-1]])])


def test_table(spark, library):
    rows = [(i, t, "k") for i, t in enumerate(texts()[::9])] + [(900, None, "k"), (900, None, "k"), (None, "same", "k"), (None, "same", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    tokens = bpe.encode(docs)
    assert tokens.columns == ["doc_id", "size", "ids", "n_tokens", "decoded"]
    again = {(r.doc_id, r.decoded) for r in bpe.decode(tokens.drop("decoded")).collect()}
    got = tokens.collect()
    assert len(got) == len(rows) and {(r.doc_id, r.decoded) for r in got} == again
    for r in got:
        text = None if r.doc_id == 900 else "same" if r.doc_id is None else rows[r.doc_id][1]
        if text is None:
            assert r.ids is None and r.n_tokens is None and r.decoded is None
        else:
            assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert bpe.encode(docs.limit(0)).collect() == []
    clash = bpe.encode(docs.withColumnRenamed("size", "IDS")).where("doc_id = 0").first()
    assert clash.asDict() == {k: v for k, v in next(r for r in got if r.doc_id == 0).asDict().items() if k != "size"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_bpe"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
