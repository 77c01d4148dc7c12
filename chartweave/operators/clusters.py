"""k-means in any number of dimensions: seeded starts by distance, rounds until nothing moves, the best of several starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sampling import draw, fraction, race_key

#: Most rounds of a start, as many as the reference grouping takes.
ROUNDS = 50


@dataclass(frozen=True)
class Clusters:
    """Centres in the order in which they were drawn, the sum of squared distances to them, and the rounds until they stood still."""

    centres: list[tuple[float, ...]]
    inertia: float
    rounds: int


def _d2(space: list[str], centre) -> Column:
    total = None
    for c, v in zip(space, centre):
        term = (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        total = term if total is None else total + term
    return total


def _nearest(space: list[str], centres) -> Column:
    """(d2, cluster) of the nearest centre, ties by the smaller number; the centres are numbers in the plan."""
    return F.array_min(F.array(*(F.struct(_d2(space, c).alias("d2"), F.lit(k).alias("cluster")) for k, c in enumerate(centres))))


def seeds(points: DataFrame, key: str, space: list[str], k: int, seed: int) -> list[tuple[float, ...]]:
    """k places of points: the first by the seeded order, each next one with a chance in proportion to its squared distance from those before.

    A draw is one aggregate: of exponential race keys with such rates the smallest wins. Fewer are found if there are fewer places.
    """
    chosen: list[tuple[float, ...]] = []
    for n in range(k):
        if n:
            d2 = _nearest(space, chosen)["d2"]
            candidates, rank = points.where(d2 > 0), race_key(d2, fraction(draw(seed, n, F.col(key)), 12))
        else:
            candidates, rank = points, fraction(draw(seed, n, F.col(key)), 12)
        row = candidates.agg(F.min(F.struct(rank.alias("r"), F.col(key), *space)).alias("m")).first()["m"]
        if row is None:
            break
        chosen.append(tuple(float(row[c]) for c in space))
    return chosen


def _lloyd(points: DataFrame, space: list[str], centres: list[tuple[float, ...]], rounds: int, still: float) -> Clusters:
    done = 0
    while True:
        best = _nearest(space, centres)
        sums = points.select(best.alias("b"), *space).groupBy("b.cluster").agg(*(F.avg(c).alias(c) for c in space), F.sum("b.d2").alias("d2"))
        rows = {r["cluster"]: r for r in sums.collect()}  # one row a centre
        moved = [tuple(rows[n][c] for c in space) if n in rows else c for n, c in enumerate(centres)]
        inertia = sum(r["d2"] for r in rows.values())
        far = max((abs(a - b) for old, new in zip(centres, moved) for a, b in zip(old, new)), default=0.0)
        if done == rounds or far <= still:
            return Clusters(centres, inertia, done)
        centres, done = moved, done + 1


def kmeans(points: DataFrame, key: str, space: list[str], k: int, seed: int, rounds: int = ROUNDS, starts: int = 1, still: float = 1e-12) -> Clusters:
    """The start of lowest inertia. A round is one scan with sums combined in the tasks; only k rows reach the driver.

    Points with a missing coordinate take no part. A centre without points stays where it is. Rounds end when no coordinate moves by more than ``still``.
    """
    known = materialize(points.select(key, *(F.col(c).cast("double").alias(c) for c in space)).dropna(), "kmeans")
    found = [_lloyd(known, space, own, rounds, still) for own in (seeds(known, key, space, k, seed + s) for s in range(starts)) if own]
    if not found:
        return Clusters([], 0.0, 0)
    return min(found, key=lambda c: c.inertia)


def labelled(points: DataFrame, space: list[str], clusters: Clusters) -> DataFrame:
    """Adds ``cluster``, the nearest centre; null where a coordinate is missing."""
    if not clusters.centres:
        return points.withColumn("cluster", F.lit(None).cast("int"))
    known = None
    for c in space:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    return points.withColumn("cluster", F.when(known, _nearest(space, clusters.centres)["cluster"]))
