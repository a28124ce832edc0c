"""The join against all pairs of a small fixture."""

import random
import re

import pytest

from seston.llm import common, jaccard
from seston.llm.jaccard import band_of, band_start, jaccard_components, keys, most_apart, one_per_component, shingle_set


def expected(rows, words, percent):
    sets = {}
    for i, (doc, text) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    to = list(range(len(rows)))

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                to[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted((d is not None, d or 0, len(sets[i]), least.get(root(i), -1)) for i, (d, _) in enumerate(rows))


def fixture(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    rows, bases = [], []
    for i in range(docs):
        if bases and rng.random() < 0.6:
            words = list(rng.choice(bases[-12:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 12, 30, 60, 90, 150, 400]))]
            if rng.random() < 0.4:
                words = passage + words
        bases.append(words)
        rows.append((i * 7 % 1000, rng.choice([" ", "\t", "\n "]).join(words)))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "A b"), (9005, "a B"), (rows[0][0], rows[0][1]), (None, rows[3][1]), (None, "alone here")]


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components(spark, words, percent, seed):
    rows = fixture(seed)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n long, key string")
    got = jaccard_components(docs, words=words, percent=percent).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], -1 if r[2] is None else r[2])
    assert sorted(map(key, got)) == expected(rows, words, percent)


def test_rest_of_a_place_is_compared(spark):
    """Members that are far from the first one, but near each other."""
    base = [f"x{i}" for i in range(60)]
    a = " ".join(base)
    b = " ".join(base[:40] + [f"y{i}" for i in range(20)])
    c = " ".join(base[:40] + [f"y{i}" for i in range(19)] + ["z"])
    rows = [(1, a), (2, b), (3, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, words=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_linked_sets_meet():
    rng = random.Random(5)
    for percent in (80, 90):
        for n in (1, 5, 9, 10, 26, 75, 300):
            for _ in range(20):
                a = [f"{rng.random()}" for _ in range(n)]
                apart = most_apart(n, percent)
                drop = rng.randint(0, apart)
                b = a[: n - drop] + [f"{rng.random()}" for _ in range(apart - drop)]
                x, y = shingle_set(" ".join(a), 1), shingle_set(" ".join(b), 1)
                i = len(set(x.tolist()) & set(y.tolist()))
                if i and 100 * i >= percent * (len(x) + len(y) - i):
                    assert set(keys(x, percent).tolist()) & set(keys(y, percent).tolist())


def test_bands_cover_all_sizes():
    for n in range(1, 500):
        assert band_start(band_of(n, 90), 90) <= n < band_start(band_of(n, 90) + 1, 90)


def test_one_row_of_each_component(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, None), (None, "a b c d"), (None, "p q r")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    got = sorted((r.doc_id or -1, r.text or "") for r in one_per_component(docs).collect())
    assert got == [(-1, "p q r"), (3, "a b c d"), (7, "")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).collect() == []


def test_workers_let_go_of_what_stages_before_kept(spark, monkeypatch):
    makers = []

    def seen(df, text, make, added, keep_text=False):
        makers.append(make)
        return common.over_texts(df, text, make, added, keep_text)

    monkeypatch.setattr(jaccard, "over_texts", seen)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e")], "doc_id long, text string")
    jaccard_components(docs).collect()
    assert len(makers) > 1
    for make in [*makers, lambda: list(jaccard.linked_members(3, 90)(iter([])))]:
        common.kept_for(("a model",), lambda: "of another stage")
        make()
        assert not common._KEPT


def test_parts_of_keys_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "KEYS_A_TASK", 100)
    asked, deal = [], jaccard.dealt_by_key
    monkeypatch.setattr(jaccard, "dealt_by_key", lambda places, total: asked.append((places, total)) or deal(places, total))
    rows = fixture(3, docs=40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id is not None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(docs).collect()]
    assert sorted(got) == expected(rows, 3, 90)
    (places, total), = asked
    assert total == sum(len(keys(shingle_set(t, 3), 90)) for _, t in rows) > 400
    assert deal(spark.range(5).withColumnRenamed("id", "key"), total).rdd.getNumPartitions() == -(-total // 100)


def test_long_signatures_bound_the_difference(spark):
    rng = random.Random(7)
    rows = []
    for n, m in ((800, 900), (1500, 1560), (1500, 1500), (3000, 3100), (3000, 9000), (700, 800), (760, 770)):
        for shared in (0, n // 2, n - 20):
            a = [str(rng.random()) for _ in range(n)]
            b = a[:shared] + [str(rng.random()) for _ in range(m - shared)]
            x, y = shingle_set(" ".join(a), 1), shingle_set(" ".join(b), 1)
            longs = [None if s is None else s.tolist() for s in map(jaccard.long_signature, (x, y))]
            rows.append((*longs, len(set(x.tolist()) ^ set(y.tolist())), n, m))
    docs = spark.createDataFrame(rows, "x array<long>, y array<long>, apart long, n long, m long")
    got = docs.select("apart", "n", "m", jaccard.apart_at_least(docs.x, docs.y).alias("bits")).collect()
    assert [r.bits is None for r in got] == [(r.n, r.m) in ((3000, 9000), (700, 800), (760, 770)) for r in got]
    assert all(r.bits <= r.apart for r in got if r.bits is not None)
    # 512 bits never differ in as many as linked sets of 3,000 and 3,100 elements may
    assert [r.bits > 20 * 6100 // 180 for r in got if r.n == 3000 and r.m == 3100] == [True, True, False]


def test_a_text_travels_once_to_a_cell(spark, monkeypatch):
    """Texts of one group, near each other but not linked: each partner took a
    text of its own, which grows with the square of the group."""
    rng = random.Random(11)
    base = [f"x{i}" for i in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        for at in range(rng.randrange(12), 150, 12):
            words[at] = f"{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"alone{i}_{k}" for k in range(100))) for i in range(60)]
    packed, over = [], jaccard.over_texts

    def counted(df, text, make, added, keep_text=False):
        if added.startswith("packed"):
            packed.append(df.count())
        return over(df, text, make, added, keep_text)

    monkeypatch.setattr(jaccard, "over_texts", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard.Join(docs, "doc_id", "text", 1, 90)
    ids = {r.doc_id: r.row for r in join.rows.df.collect()}
    small = join.rows.df.withColumnRenamed("row", "id")
    pairs = spark.createDataFrame([(ids[a], ids[b]) for a in range(40) for b in range(a)], "a long, b long")
    got = {frozenset(r) for r in join.verified(pairs, small).collect()}
    sets = [set(t.split()) for _, t in rows]
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    assert got == {frozenset((ids[a], ids[b])) for a in range(40) for b in range(a) if alike(a, b)}
    assert packed == [40]


def test_sieve_never_misses(spark):
    hashes = spark.range(0, 60_000, 3).selectExpr("xxhash64(id) as h")
    sieve = common.Sieve(hashes)
    maybe, none = sieve.parted(spark.range(60_000).selectExpr("id", "'t' as _sieve", "id as row"), jaccard.F.xxhash64("id"))
    found = {r.id for r in maybe.collect()}
    assert maybe.columns == ["id", "_sieve", "row"] and {i for i in range(0, 60_000, 3)} <= found
    assert found.isdisjoint(r.id for r in none.collect()) and len(found) + none.count() == 60_000
    assert len(found) < 24_000  # one in sixteen of the others
    maybe, none = common.Sieve(hashes.limit(0)).parted(spark.range(5), jaccard.F.xxhash64("id"))
    assert (maybe.count(), none.count()) == (0, 5)
    maybe, none = sieve.parted(spark.range(5), jaccard.F.lit(None).cast("bigint"))
    assert (maybe.count(), none.count()) == (0, 5)


def test_repeated_rows_and_texts_of_one_id(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d e f", "z"), (2, "a b c d", "x"), (3, "", "x"), (3, "", "x"), (None, "q r s", "x"), (None, "q r s", "x"), (4, "t u v", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_sieve` string")
    got = one_per_component(docs)
    assert got.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert found == [(0, "q r s"), (1, "a b c d"), (1, "a b c d e f"), (3, ""), (3, ""), (4, "t u v")]
