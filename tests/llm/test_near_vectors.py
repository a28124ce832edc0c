"""The range join against all pairs."""

import numpy as np

from seston.llm.near_vectors import near_duplicates


def test_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 12))
    for i in range(100, 220):
        x[i] = x[i % 37] + rng.normal(size=12) * rng.choice([0.02, 0.2, 0.35])
    x[220:230] = x[5]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0, None] * 6), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n int")
    got = sorted(map(tuple, near_duplicates(docs, cell=40).collect()))
    usable = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in usable}
    near = {k: [m for m in usable if m != k and len(unit[m]) == len(unit[k]) and unit[k] @ unit[m] >= 0.95 - 1e-12] for k in usable}
    expected = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min(rows[m][0] for m in seen)
        expected.append((i, len(near.get(k, [])), c, i == c))
    assert got == sorted(expected)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
