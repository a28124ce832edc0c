"""Variant groups against all pairs of words."""

import random
import re
import zlib

import pytest

from seston.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(rows):
    n = {}
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] = n.get(word, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def fixture(seed, docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("etaoinsé×") for _ in range(rng.randint(7, 9))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "abababab", "babababa", "Ünterschied", "strasse"]
    words = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("etaz") + w[i:], w[:i] + rng.choice("etaz") + w[i + 1 :]]))
    weights = [rng.choice([1, 3, 12, 150, 2000]) for _ in words]
    rows = []
    for i in range(docs):
        text = "".join(w.upper() + rng.choice([" ", ", ", "1", "\n"]) if rng.random() < 0.1 else w + " " for w in rng.choices(words, weights, k=400))
        rows.append((i, text))
    return [*rows, (900, None), (901, ""), (902, "Straße 123 -- ÷"), (None, rows[0][1]), rows[1], rows[1], (903, "abcdefgh" * 4000)]


@pytest.mark.parametrize(("seed", "most"), [(1, spelling.MOST), (2, 40), (3, 2)])
def test_variants(spark, seed, most):
    """With small nodes the trie is walked by Spark, with tiny ones to its end and in blocks."""
    rows = fixture(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    got = sorted((tuple(r) for r in spelling.variants(docs, most=most).collect()), key=str)
    assert got == expected(rows)
    assert any(r[1] and r[2] != r[1] for r in got) or seed > 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).collect() == []


def test_groups_cover_all_letters():
    assert sorted("".join(spelling.GROUPS)) == sorted([*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))])
