"""Alignment against the libraries and a plain comparison of byte ranges."""

import hashlib
import os
import random
from collections import Counter

import pytest

from seston.llm import align
from seston.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(align.MODEL_A), reason="no vocabulary files")
FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    """(id, begin, end) of the tokens of both sides, or none."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a, tokens.b = Tokenizer.from_file(align.MODEL_A), SentencePieceProcessor(model_file=align.MODEL_B)
        tokens.a.encode_special_tokens = True
    if not text:
        return [], []
    whole = (" " + text).encode()
    signs = [chr(b) for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    byte_of = {s: ord(s) for s in signs}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in signs)})
    sides = []
    ids = tokens.a.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(byte_of[c] for c in tokens.a.id_to_token(i))) for i in ids])
    side = []
    for i in tokens.b.encode(text):
        p = tokens.b.id_to_piece(i)
        side.append((i, bytes([int(p[3:5], 16)]) if tokens.b.is_byte(i) else p.replace("▁", " ").encode()))
    sides.append(side)
    if any(b"".join(b for _, b in s) != whole for s in sides):
        return [], []
    out = []
    for s in sides:
        at, found = 0, []
        for i, b in s:
            found.append((i, at, at + len(b)))
            at += len(b)
        out.append(found)
    return tuple(out)


def expected(texts):
    links, rows = [], []
    for text in texts:
        a, b = tokens(text)
        begin = {x[1]: k for k, x in enumerate(b)}
        found, k = [], 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                found.append((i, b[j][0]))
                j += 1
        assert not a or begin
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, s = [], 0
        for e in ends:
            part = [",".join(str(i) for i, x, y in side if s <= x and y <= e) for side in (a, b)]
            groups.append("|".join(part))
            s = e
        links.append(found)
        rows.append([len(a), len(b), len(groups), len(found), ";".join(groups)])
    count = Counter(p for found in links for p in set(found))
    most = {}
    for (a, _), c in count.items():
        most[a] = max(c, most.get(a, 0))
    for row, found in zip(rows, links, strict=True):
        row += [sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found)]
    return [tuple(r) for r in rows]


def texts():
    rng = random.Random(6)
    words = ["the", "attion", "ofthing", "éèaux", "Straße", "x1234", "$$$", "aaaaaa", "日本語", "🙂", "\n", "  ", "\t", "<s>", "<|endoftext|>", "<0x41>", "it's"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    out += ["".join(chr(rng.choice([rng.randint(0, 126), rng.randint(160, 600)])) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return [*out, None, "", " ", "a", "a", "with ▁ inside", "▁", "lower " * 3000, "ab" * 2000, out[0], out[0]]


@pytest.mark.parametrize("slice_bytes", [4_000_000, 600])
def test_against_ranges(spark, monkeypatch, slice_bytes):
    from seston.durable import Staged

    given = texts()
    a, b = align.Side(align.ByteBpe(open(align.MODEL_A, "rb").read())), align.Side(align.Pieces(open(align.MODEL_B, "rb").read()))
    want = expected(given)
    got = align.aligned(given, a, b)
    assert list(zip(*[got[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "n_links", "groups")], strict=True)) == [w[:5] for w in want]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(given)], "doc_id long, text string, row string").repartition(
        1 if slice_bytes > 600 else 40, "doc_id"
    )
    found = Staged(align.align(docs)).df
    rows = {r.doc_id: r for r in align.counted(found, b.size).collect()}
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for _, r in sorted(rows.items())] == want
    assert rows[0].row == "k"


def test_names_and_empty_table(spark):
    from seston.durable import Staged

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.counted(Staged(align.align(docs)).df, 32_000).collect() == []
    row = align.align(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Groups int")).first()
    assert row.groups and "Groups" not in row.asDict()
    assert align.aligned([], *[align.Side(m) for m in (align.ByteBpe(open(align.MODEL_A, "rb").read()), align.Pieces(open(align.MODEL_B, "rb").read()))])["n_a"].to_pylist() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    want = expected([t for _, t in docs])
    got = sorted(QUERIES["op13_alignment"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    for r, (na, nb, groups, links, text, best, total) in zip(got, want, strict=True):
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (na, nb, groups, links, best, total, sha)
