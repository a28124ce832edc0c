"""Encoding against the public library, and exact round trips."""

import os
import random

import pytest

from seston.llm.pieces import MODEL, Encoder, decode, encode

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary files")


def texts():
    rng = random.Random(1)
    words = ["the", "attion", "ofthing", "éèaux", "Straße", "niño", "x", "1234", "$$$", "aaaaaa", "日本語", "🙂", "\n", "  ", "   ", "\t", "á"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 600)])) for _ in range(rng.randint(1, 50))) for _ in range(150)]
    letters = "abcdeinorst "
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    return out + ["", " ", "    ", "a", "\n\n", "lower " * 400, "ab" * 500]


def test_as_the_library():
    import sentencepiece

    model = open(MODEL, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = Encoder(model)
    given = texts()
    for text, ids in zip(given, encoder.encode(given), strict=True):
        assert ids.tolist() == library.encode(text), repr(text)
        assert encoder.decode(ids.tolist()) == text


def test_round_trip(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts()[::9])] + [(900, None, 1), (900, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").drop("ids")
    tokens = encode(docs)
    assert {(r.doc_id, r.text) for r in decode(tokens).collect()} == {(i, t) for i, t, _ in rows}
    checked = tokens.where("doc_id < 900").collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in checked)
    assert encode(docs.limit(0)).collect() == []


def test_usual_parts_go_together(monkeypatch):
    """Only parts with a character without a piece, and the last few, are taken one by one."""
    import sentencepiece

    from seston.llm.pieces import TOGETHER

    data = open(MODEL, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    alone = []
    relax = Encoder.relax
    monkeypatch.setattr(Encoder, "relax", lambda self, part, *a: alone.append(part) or relax(self, part, *a))
    rng = random.Random(3)
    sounds = ["th", "tion", "e", "zung", "keit", "é", "ción", "qu", "ing", "st", "ö", "a"]
    words = sorted({"".join(rng.choice(sounds) for _ in range(rng.randint(1, 12))) for _ in range(4000)})
    given = [" ".join(words[i::40]) for i in range(40)] + ["日本 🙂🙂", "▁a  b▁", "x" * 900]
    for text, ids in zip(given, Encoder(data).encode(given), strict=True):
        assert ids.tolist() == library.encode(text), repr(text)
    assert len(words) > 3000 and len(alone) <= TOGETHER + 10
