"""Columns that clash with results or working columns, very long texts, empty
tables, and results recomputed where they were wrong for unusual input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seston.llm import fingerprint, jaccard, language, licenses, links, near_vectors, pieces, quality, toxicity

LONG = "plain words of a long text, said again and again; " * 40_000
ROWS = [(1, "some words here", "kept"), (2, "some words here", "kept"), (3, None, "kept"), (4, "", "kept"), (5, LONG, "kept")]


def scorers():
    other = ["the calm river runs past the quiet town", "a garden of green trees"] * 8
    toxic = ["vile insult vile insult you fool", "hateful insult fool vile"] * 8
    model = language.train({"en": other, "xx": toxic})
    harm = toxicity.train([(t + f" n{i}", 0) for i, t in enumerate(other)] + [(t + f" n{i}", 1) for i, t in enumerate(toxic)])
    good = quality.train([(t, 1) for t in other] + [(t, 0) for t in toxic])
    return {
        "language": (lambda d: language.identify(d, model), ["lang_pred", "score"]),
        "toxicity": (lambda d: toxicity.score(d, harm), ["score", "predicted", "passages"]),
        "quality": (lambda d: quality.score(d, good), ["score", "predicted"]),
        "licenses": (licenses.scan, ["matches"]),
        "pieces": (pieces.encode, ["ids", "n_tokens", "round_trip"]),
    }


@pytest.mark.parametrize("name", ["language", "toxicity", "quality", "licenses", "pieces"])
def test_results_replace_columns_of_their_name(spark, name):
    run, added = scorers()[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, note string")
    plain = run(docs)
    clash = run(docs.select("*", *[F.lit("x").alias(c.title()) for c in added]))
    assert clash.columns == plain.columns == ["doc_id", "note", *added]
    got = sorted(plain.collect(), key=lambda r: r.doc_id)
    assert sorted(clash.collect(), key=lambda r: r.doc_id) == got
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5] and {r.note for r in got} == {"kept"}
    assert got[0][2:] == got[1][2:]
    assert run(docs.limit(0)).collect() == []


def test_text_kept_beside_a_clash(spark):
    run = quality.train([])
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, score int")
    out = quality.score(docs, run, keep_text=True)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.first().score == 0.5


def test_tokens_decode_beside_a_column_named_text(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    ids = pieces.encode(docs).withColumn("text", F.lit("old"))
    assert sorted((r.doc_id, r.text) for r in pieces.decode(ids).collect()) == [(1, "some words"), (2, None)]


def test_one_row_of_each_component_by_row(spark):
    """Repeated and NULL ids: every component keeps one row, whole."""
    rows = [
        (1, "a b c d", 1.0, "p"), (1, "a b c d", 2.0, "q"), (1, "other words entirely here", 3.0, "r"),
        (2, "a b c d", 4.0, "s"), (2, "lone text of two", 5.0, "t"), (None, "no id at all", 6.0, "u"),
        (None, "no id at all", 7.0, "v"), (None, "a b c d", 8.0, "w"), (9, None, 9.0, "x"), (9, " \t", 9.5, "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _of double, _keep string")
    out = jaccard.one_per_component(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.doc_id or -1, (r.text or "").strip()) for r in got) == sorted(
        [(1, "a b c d"), (1, "other words entirely here"), (2, "lone text of two"), (-1, "no id at all"), (9, ""), (9, "")]
    )
    assert all(tuple(r) in rows for r in got)
    again = jaccard.one_per_component(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert jaccard.one_per_component(docs.limit(0)).collect() == []


def test_a_long_text_in_the_join(spark):
    rows = [(1, LONG), (2, LONG.upper()), (3, "short text of words")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_vectors_of_extreme_doubles(spark):
    rows = [(1, [1e200, 1e200]), (2, [3e-200, 3e-200]), (3, [2.0, 2.0]), (4, [1e308, 0.0]), (5, [5e-324, 0.0]), (6, [0.0, 0.0])]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6),
    }


def test_usual_vectors_are_scaled_exactly():
    v = np.random.default_rng(3).normal(size=(200, 64))
    assert (near_vectors.unit_rows(v) == v / np.sqrt((v * v).sum(1))[:, None]).all()


def test_short_texts_inside_long_ones(spark):
    """Whatever the sketch of a short text: containment is 1 or unknown, never 0."""
    rows = []
    for i in range(200):
        words = [f"w{i}x{k}" for k in range(60)]
        rows.append((" ".join(words[20 : 20 + 5 + i % 8]), " ".join(words), f"alien{i} " * (5 + i % 8)))
    df = spark.createDataFrame(rows, "short string, whole string, other string")
    for name in ("short", "whole", "other"):
        df = fingerprint.with_sketch(df, name, f"s_{name}")
    s = {n: F.col(f"s_{n}") for n in ("short", "whole", "other")}
    out = df.select(
        fingerprint.containment(s["short"], s["whole"]).alias("inside"),
        (fingerprint.merged(s["short"], s["whole"]) == s["whole"]).alias("same"),
        F.exists(s["short"], lambda h: h < fingerprint.limit(fingerprint.FRACTION)).alias("told"),
    ).collect()
    assert all(r.inside == 1.0 if r.told else r.inside in (None, 1.0) for r in out)
    assert all(r.same for r in out) and sum(r.told for r in out) > 20


def test_propagation_until_the_threshold_is_safe(spark):
    """A chain of hosts longer than most and a cycle, by plain iteration."""
    names = [f"h{i}" for i in range(24)]
    edges = [("k", a, b, 1) for a, b in zip(names, names[1:])] + [("k", "c1", "c2", 1), ("k", "c2", "c1", 1), ("k", "h3", "c1", 1)]
    seed = {x: 1.0 if x == "h0" else 0.0 for x in [*names, "c1", "c2"]}
    nodes = spark.createDataFrame([("k", x, s) for x, s in seed.items()], "kind string, host string, seed double")
    table = spark.createDataFrame(edges, "kind string, a string, b string, n long")
    enough = links.SAFE * links.THRESHOLD / 10
    got = {r.host: r["rank"] for r in links.propagate(nodes, table, enough=enough).df.collect()}
    out = {a: sum(e[3] for e in edges if e[1] == a) for a in seed}
    rank = dict(seed)
    for _ in range(400):
        lost = sum(r for x, r in rank.items() if not out[x])
        new = {x: (0.15 + 0.85 * lost) * s for x, s in seed.items()}
        for _, a, b, n in edges:
            new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    assert sum(abs(got[x] - rank[x]) for x in rank) <= enough
    with pytest.raises(RuntimeError):
        links.propagate(nodes, table, rounds=3)
