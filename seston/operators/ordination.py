"""Non-metric multidimensional scaling on a table of distances.

Each iteration fits the exact monotone curve through all pairs (``monotone``) and
moves the samples towards the fitted distances; several random starts advance
together. The search goes on until the best solution has been found twice: two
starts agree if one can be turned, mirrored, moved and scaled onto the other.

The pairs are written once, in chunks, and read by tasks in every iteration. The
driver holds the configurations, ``n x k`` numbers a start.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.operators.columns import separate
from seston.operators.monotone import SENT_BYTES, Ranked

#: two solutions agree if no more apart than this, of a spread of 1 in all
SAME_RMSE, SAME_LARGEST = 0.005, 0.01
#: iterations over which the stress must fall by ``tolerance``
SPAN = 5


@dataclass
class Ordination:
    """``scores``: sample and axis1..k of the best start; ``stress``: start,
    stress, iterations and whether the start ended by itself; ``history``:
    (iteration, start, stress); ``converged``: whether another start came to
    the same solution as the best one; ``agreed``: the starts that did."""

    scores: DataFrame
    stress: DataFrame
    history: list[tuple[int, int, float]]
    converged: bool
    agreed: list[int] = field(default_factory=list)


def _axes(k: int) -> list[str]:
    return [f"axis{i}" for i in range(1, k + 1)]


def _standard(x: np.ndarray) -> np.ndarray:
    """Centred, with a spread of 1 in all."""
    x = x - x.mean(-2, keepdims=True)
    return x / np.sqrt(np.maximum((x * x).sum((-2, -1), keepdims=True), 1e-300))


def _turn(cross: np.ndarray) -> tuple[np.ndarray, float]:
    """Rotation (or reflection) and scale that bring one configuration onto
    another, from their cross-products (spreads of 1)."""
    u, size, v = np.linalg.svd(cross)
    return u @ v, float(size.sum())


def apart(one: np.ndarray, two: np.ndarray) -> tuple[float, float]:
    """Root mean square and largest distance of the samples of two
    configurations after the second is fitted onto the first."""
    one, two = _standard(one), _standard(two)
    turn, scale = _turn(two.T @ one)
    rest = np.sqrt(((one - scale * two @ turn) ** 2).sum(1))
    return float(np.sqrt((rest * rest).mean())), float(rest.max())


def procrustes(one: DataFrame, two: DataFrame, axes: Sequence[str], sample: str = "sample") -> DataFrame:
    """rmse and largest residual of two tables of scores, after the second is
    turned, mirrored, moved and scaled onto the first, both with a spread of 1.

    The cross-products come from one aggregation, the residuals from a second;
    samples that only one table has are left out.
    """
    k = len(axes)
    both = one.select(sample, *[F.col(a).alias(f"a{i}") for i, a in enumerate(axes)]).join(
        two.select(sample, *[F.col(a).alias(f"b{i}") for i, a in enumerate(axes)]), sample
    )
    sides = [f"{s}{i}" for s in "ab" for i in range(k)]
    found = both.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in sides],
        *[F.var_pop(c).alias(f"v_{c}") for c in sides],
        *[F.covar_pop(f"b{i}", f"a{j}").alias(f"c_{i}_{j}") for i in range(k) for j in range(k)],
    ).first()
    n = found["n"]
    size = {s: np.sqrt(max(n * sum(found[f"v_{s}{i}"] or 0.0 for i in range(k)), 1e-300)) for s in "ab"}
    cross = np.array([[n * (found[f"c_{i}_{j}"] or 0.0) for j in range(k)] for i in range(k)]) / (size["a"] * size["b"])
    turn, scale = _turn(cross)
    unit = lambda c: (F.col(c) - F.lit(found[f"m_{c}"])) / F.lit(float(size[c[0]]))
    square = F.lit(0.0)
    for j in range(k):
        moved = sum((unit(f"b{i}") * F.lit(float(scale * turn[i, j])) for i in range(k)), F.lit(0.0))
        square = square + F.pow(unit(f"a{j}") - moved, 2)
    return both.select(square.alias("q")).agg(F.sqrt(F.avg("q")).alias("rmse"), F.sqrt(F.max("q")).alias("largest"))


def _random(n: int, k: int, start: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, start]).uniform(-0.5, 0.5, (n, k))


def _transformed(links: Ranked, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Guttman transform of each configuration, and its stress before it."""
    n, k = at.shape[1:]

    def pull(chunk, pairs, gap, apart, order, fit, start, stress) -> dict:
        i, j = pairs[0][order], pairs[1][order]
        force = np.divide(fit, apart, out=np.zeros_like(fit), where=apart > 0)
        out = {"start": np.full(n + 1, start, np.int32), "at": np.arange(-1, n, dtype=np.int32)}
        for a in range(k):
            by = force * gap[:, a]
            out[f"x{a}"] = np.r_[0.0, np.bincount(i, by, n) - np.bincount(j, by, n)]
        # the stress is told once, by the first chunk, in row -1
        out["stress"] = np.full(n + 1, stress)
        return out

    axes = [f"x{a}" for a in range(k)]
    schema = "start int, at int, " + ", ".join(f"{a} double" for a in axes) + ", stress double"
    summed = links.with_values(at, pull, schema).groupBy("start", "at").agg(
        *[F.sum(a).alias(a) for a in axes], F.max("stress").alias("stress")
    )
    table = summed.toArrow()
    start, place = table["start"].to_numpy(), table["at"].to_numpy()
    stress = np.zeros(len(at))
    stress[start] = table["stress"].to_numpy()
    moved = np.zeros_like(at)
    inside = place >= 0
    for a in range(k):
        moved[start[inside], place[inside], a] = table[f"x{a}"].to_numpy()[inside]
    return moved / n, stress


class _Start:
    """One start on its way: the step is along the Guttman transform, longer
    while successive directions agree and the stress falls slowly."""

    LONGEST = 8.0

    def __init__(self, x: np.ndarray):
        self.x, self.best, self.seen = x, x, []
        self._step, self._last = 2.0, None

    def move(self, transform: np.ndarray, stress: float) -> None:
        seen, x = self.seen, self.x
        if not seen or stress <= min(seen):
            self.best = x
        seen.append(stress)
        # the part along the configuration itself only changes its scale
        way = transform - x * ((transform * x).sum() / (x * x).sum())
        if self._last is not None and stress > 0:
            size = np.sqrt((way * way).sum() * (self._last * self._last).sum())
            agree = (way * self._last).sum() / max(size, 1e-300)
            slow = 1.3 / (1 + min(1.0, stress / seen[max(0, len(seen) - 1 - SPAN)]) ** 5)
            worse = min(1.0, stress / seen[-2]) if seen[-2] > 0 else 1.0
            self._step = float(np.clip(self._step * 4 ** (agree**3) * slow * worse, 0.5, self.LONGEST))
        self._last = way
        self.x = _standard(x + self._step * way) * np.sqrt(len(x))

    def falls(self, tolerance: float) -> bool:
        seen = self.seen
        return len(seen) <= SPAN or min(seen[:-SPAN]) - min(seen) > tolerance * min(seen)


def _principal(x: np.ndarray) -> np.ndarray:
    """Centre, turn to the principal axes, scale to unit mean square and point
    each axis to its longer tail, so that equal solutions look equal."""
    n, k = x.shape
    x = _standard(x) * np.sqrt(n * k)
    size, turn = np.linalg.eigh(x.T @ x)
    x = x @ turn[:, np.argsort(size)[::-1]]
    return x * np.where((x**3).sum(0) >= 0, 1.0, -1.0)


def _table(spark: SparkSession, names: list, x: np.ndarray, axes: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"sample": pa.array(names), **{a: x[:, i] for i, a in enumerate(axes)}}))


def nmds(
    pairs: DataFrame,
    k: int = 3,
    starts: int = 100,
    max_iter: int = 200,
    tolerance: float = 1e-4,
    at_once: int = 8,
    least_starts: int = 2,
    enough: float = 1e-4,
    seed: int = 1,
) -> Ordination:
    """Place samples in ``k`` dimensions so that distances there follow the
    order of the dissimilarities.

    ``pairs`` lists every pair (sample_1, sample_2, distance) once; missing
    pairs or distances raise ``ValueError``. Random starts are tried
    ``at_once`` at a time, until at least ``least_starts`` are done and the best
    solution has been found twice, or ``starts`` are done. A start ends when its
    stress is below ``enough`` or has not fallen by more than ``tolerance`` of its
    value over the last ``SPAN`` iterations. If no two best starts agree, ``converged`` is false and
    the scores are the best found. The work is done when this is called.
    """
    axes = _axes(k)
    spark = pairs.sparkSession
    links = Ranked(pairs)
    fits = max(1, SENT_BYTES // max(1, links.n * k * 8))
    done: dict[int, tuple[float, np.ndarray, int, bool]] = {}
    history: list[tuple[int, int, float]] = []
    agreed: list[int] = []
    best = 1
    while len(done) < starts and not (agreed and len(done) >= least_starts):
        first, last = len(done) + 1, min(len(done) + min(at_once, fits), starts)
        running = {s: _Start(_standard(_random(links.n, k, s, seed)) * np.sqrt(links.n)) for s in range(first, last + 1)}
        for step in range(max_iter + 1):
            which = list(running)
            moved, stress = _transformed(links, np.stack([running[s].x for s in which]))
            for s, x, v in zip(which, moved, stress.tolist(), strict=True):
                one = running[s]
                one.move(x, v)
                history.append((step, s, v))
                ended = v <= enough or not one.falls(tolerance)
                if ended or step == max_iter:
                    done[s] = (min(one.seen), one.best, step, ended)
                    del running[s]
            if not running:
                break
        best = min(done, key=lambda s: (done[s][0], s))
        near = {s: apart(done[best][1], x) for s, (_, x, _, _) in done.items() if s != best}
        agreed = sorted(s for s, (rmse, most) in near.items() if rmse <= SAME_RMSE and most <= SAME_LARGEST)
    scores = _table(spark, links.names, _principal(done[best][1]), axes)
    order = sorted(done)
    stress = spark.createDataFrame(pa.table({
        "start": pa.array(order, pa.int32()), "stress": [done[s][0] for s in order],
        "iterations": pa.array([done[s][2] for s in order], pa.int32()), "ended": [done[s][3] for s in order],
    }))
    links.drop()
    return Ordination(scores, stress, history, bool(agreed) and done[best][3], agreed)


def _placed(links: Ranked, scores: DataFrame, axes: Sequence[str]) -> np.ndarray:
    table = scores.join(links.samples, "sample").select("at", *axes).toArrow()
    if table.num_rows != links.n:
        raise ValueError("every sample needs one row of scores")
    at = np.zeros((1, links.n, len(axes)))
    for i, a in enumerate(axes):
        at[0, table["at"].to_numpy(), i] = table[a].to_numpy()
    return at


def shepard(pairs: DataFrame, scores: DataFrame, axes: Sequence[str], chunk_pairs: int | None = None) -> DataFrame:
    """Per pair its dissimilarity, its distance in the ordination and the
    distance the monotone curve gives it."""
    links = Ranked(pairs, chunk_pairs)

    def listed(chunk, pairs, gap, apart, order, fit, start, stress) -> dict:
        i, j, d = (x[order] for x in pairs)
        return {"i": i, "j": j, "dissimilarity": d, "distance": apart, "fitted": fit}

    found = links.with_values(
        _placed(links, scores, axes), listed, "i int, j int, dissimilarity double, distance double, fitted double"
    )
    one = links.samples.select(F.col("sample").alias("sample_1"), F.col("at").alias("i"))
    two = links.samples.select(F.col("sample").alias("sample_2"), F.col("at").alias("j"))
    return found.join(one, "i").join(two, "j").select("sample_1", "sample_2", "dissimilarity", "distance", "fitted")


def stress(pairs: DataFrame, scores: DataFrame, axes: Sequence[str], chunk_pairs: int | None = None) -> DataFrame:
    """Stress of any configuration (sample, axes) against the dissimilarities."""
    links = Ranked(pairs, chunk_pairs)
    return links.fit(_placed(links, scores, axes)).select("stress").limit(1)


def site_scores(result: Ordination, into: Sequence[str] = (), sep: str = "_") -> DataFrame:
    """Scores with the parts of the sample name in columns of their own."""
    if not into:
        return result.scores
    return separate(result.scores, "sample", list(into), sep, keep=True)
