"""Maps between the charts of neighbouring sites, from sums over the points they share.

Every operator reduces the shared points to a few sums per pair (map-side combined, so a pair
with a third of all points is no hot spot) and solves on those. Two-dimensional charts are
closed expressions; for more dimensions the d x d sums are decomposed by numpy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_covariance(shared: DataFrame, by: list[str] = ["i", "j"]) -> DataFrame:  # noqa: B006
    """c00..c11: sums of a_p * b_q over shared points (a0, a1, b0, b1), and n."""
    sums = [F.sum(F.col(f"a{p}") * F.col(f"b{q}")).alias(f"c{p}{q}") for p in range(2) for q in range(2)]
    return shared.groupBy(*by).agg(*sums, F.count("*").alias("n"))


def _matrix(df: DataFrame, m: list[Column]) -> DataFrame:
    return df.select("i", "j", *(v.alias(f"o{k // 2}{k % 2}") for k, v in enumerate(m)))


def nearest_rotation(c: DataFrame) -> DataFrame:
    """i, j, o00..o11: the rotation O nearest to the sums a b^T, so that a is close to O b."""
    t = F.atan2(F.col("c10") - F.col("c01"), F.col("c00") + F.col("c11"))
    return _matrix(c, [F.cos(t), -F.sin(t), F.sin(t), F.cos(t)])


def nearest_orthogonal(c: DataFrame) -> DataFrame:
    """i, j, o00..o11: as nearest_rotation, but a reflection where the determinant is negative."""
    turn = F.atan2(F.col("c10") - F.col("c01"), F.col("c00") + F.col("c11"))
    flip = F.atan2(F.col("c10") + F.col("c01"), F.col("c00") - F.col("c11"))
    proper = F.col("c00") * F.col("c11") - F.col("c01") * F.col("c10") >= 0
    t = F.when(proper, turn).otherwise(flip)
    sign = F.when(proper, F.lit(1.0)).otherwise(F.lit(-1.0))
    return _matrix(c, [F.cos(t), -sign * F.sin(t), F.sin(t), sign * F.cos(t)])


def nearest_orthogonal_any(sums: DataFrame, dims: int, rotation: bool = False) -> DataFrame:
    """i, j, r, c, v: the nearest orthogonal matrix of each pair's d x d sums (i, j, r, c, v), by SVD; one small group a pair."""

    def solve(key, frame):
        import numpy as np
        import pandas as pd

        m = np.zeros((dims, dims))
        m[frame["r"], frame["c"]] = frame["v"]
        u, _, vt = np.linalg.svd(m)
        fix = np.ones(dims)
        if rotation:
            fix[-1] = np.sign(np.linalg.det(u @ vt))
        o = u @ np.diag(fix) @ vt
        r, c = np.divmod(np.arange(dims * dims), dims)
        return pd.DataFrame({"i": key[0], "j": key[1], "r": r, "c": c, "v": o.ravel()})

    return sums.groupBy("i", "j").applyInPandas(solve, "i int, j int, r int, c int, v double")


def frame_update(shared: DataFrame, frames: DataFrame) -> DataFrame:
    """agent, t, f00..f11: every agent's frame turned to its neighbours' old frames, all at once.

    For each agent: sum over neighbours n of F_n Z_n^T Z_agent, then the nearest rotation. ``frames``: agent,
    f00..f11; agents without shared points keep theirs.
    """
    c = cross_covariance(shared)
    toward_i = c.select(F.col("i").alias("agent"), F.col("j").alias("near"), *(F.col(f"c{q}{p}").alias(f"m{p}{q}") for p in range(2) for q in range(2)))
    toward_j = c.select(F.col("j").alias("agent"), F.col("i").alias("near"), *(F.col(f"c{p}{q}").alias(f"m{p}{q}") for p in range(2) for q in range(2)))
    other = frames.select(F.col("agent").alias("near"), *(F.col(f"f{p}{q}").alias(f"g{p}{q}") for p in range(2) for q in range(2)))
    turned = toward_i.unionByName(toward_j).join(F.broadcast(other), "near")
    product = [F.sum(F.col(f"g{p}0") * F.col(f"m0{q}") + F.col(f"g{p}1") * F.col(f"m1{q}")).alias(f"s{p}{q}") for p in range(2) for q in range(2)]
    sums = turned.groupBy("agent").agg(*product)
    t = F.atan2(F.col("s10") - F.col("s01"), F.col("s00") + F.col("s11"))
    new = [F.cos(t), -F.sin(t), F.sin(t), F.cos(t)]
    names = ["f00", "f01", "f10", "f11"]
    return frames.join(sums, "agent", "left").select("agent", *(F.coalesce(v, F.col(n)).alias(n) for v, n in zip(new, names)))


def diagonal_map(shared: DataFrame, weight: float = 1e-3) -> DataFrame:
    """i, j, d0, d1: scales that take b to a, d = (s + sqrt(s^2 + 2 w q)) / (2 q) with s = sum a b, q = sum b^2."""
    sums = shared.groupBy("i", "j").agg(*(F.sum(F.col(f"a{k}") * F.col(f"b{k}")).alias(f"s{k}") for k in range(2)), *(F.sum(F.col(f"b{k}") * F.col(f"b{k}")).alias(f"q{k}") for k in range(2)))
    scale = lambda k: (F.col(f"s{k}") + F.sqrt(F.col(f"s{k}") * F.col(f"s{k}") + 2 * weight * F.col(f"q{k}"))) / (2 * F.col(f"q{k}"))
    return sums.select("i", "j", scale(0).alias("d0"), scale(1).alias("d1"))


def _few(maps: DataFrame) -> DataFrame:
    return F.broadcast(maps)  # a row a site pair


def map_with(shared: DataFrame, maps: DataFrame | None, kind: str) -> DataFrame:
    """``shared`` with b0, b1 mapped into the chart of a: identity, matrix (o00..), diagonal (d0, d1) or
    affine (both sides (M x - t) / exp(s), columns <side>m00.., <side>t0.., <side>s0..)."""
    if kind == "identity":
        return shared
    met = shared.join(_few(maps), ["i", "j"])
    if kind == "matrix":
        new = {f"b{p}": F.col(f"o{p}0") * F.col("b0") + F.col(f"o{p}1") * F.col("b1") for p in range(2)}
    elif kind == "diagonal":
        new = {f"b{p}": F.col(f"d{p}") * F.col(f"b{p}") for p in range(2)}
    elif kind == "affine":
        new = {f"{s}{p}": (F.col(f"{s}m{p}0") * F.col(f"{s}0") + F.col(f"{s}m{p}1") * F.col(f"{s}1") - F.col(f"{s}t{p}")) / F.exp(F.col(f"{s}s{p}")) for s in "ab" for p in range(2)}
    else:
        raise ValueError(f"unknown kind of map: {kind}")
    return met.withColumns(new).select(*shared.columns)


def in_frames(shared: DataFrame, frames: DataFrame) -> DataFrame:
    """Both charts of each pair in their agents' reference frames: z -> F z."""
    out = shared
    for side, agent in (("a", "i"), ("b", "j")):
        own = F.broadcast(frames.select(F.col("agent").alias(agent), *(F.col(f"f{p}{q}").alias(f"g{p}{q}") for p in range(2) for q in range(2))))
        turned = {f"{side}{p}": F.col(f"g{p}0") * F.col(f"{side}0") + F.col(f"g{p}1") * F.col(f"{side}1") for p in range(2)}
        out = out.join(own, agent).withColumns(turned).drop("g00", "g01", "g10", "g11")
    return out.select(*shared.columns)


def alignment_loss(shared: DataFrame) -> DataFrame:
    """i, j, loss: mean squared distance of aligned charts."""
    d0, d1 = F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")
    return shared.groupBy("i", "j").agg(F.avg(d0 * d0 + d1 * d1).alias("loss"))


def neighbours(pairs: DataFrame, closed: bool = True) -> DataFrame:
    """agent, near: both directions of the pairs, with the agent itself if ``closed``."""
    both = pairs.select(F.col("i").alias("agent"), F.col("j").alias("near")).unionByName(pairs.select(F.col("j").alias("agent"), F.col("i").alias("near")))
    if closed:
        both = both.unionByName(both.select("agent", F.col("agent").alias("near")))
    return both.distinct()


def averaged(params: DataFrame, pairs: DataFrame, shared_keys: list[str] | None = None) -> DataFrame:
    """agent, key, pos, v: every parameter averaged over the closed neighbourhood, all agents at once.

    ``shared_keys``: only these are averaged; an agent keeps its other parameters.
    """
    mine = params if shared_keys is None else params.where(F.col("key").isin(shared_keys))
    met = F.broadcast(neighbours(pairs)).join(mine.withColumnRenamed("agent", "near"), "near")
    mean = met.groupBy("agent", "key", "pos").agg(F.avg("v").alias("v"))
    alone = mine.join(F.broadcast(neighbours(pairs).select("agent").distinct()), "agent", "left_anti")
    out = mean.unionByName(alone.select("agent", "key", "pos", "v"))
    return out if shared_keys is None else out.unionByName(params.where(~F.col("key").isin(shared_keys)).select("agent", "key", "pos", "v"))


def late_layers(keys: list[str], share: float) -> list[str]:
    """Keys of the last layers, ``share`` of all; weight and bias of a layer stay together. Keys: <layer>.<name>."""
    layers = sorted({k.rsplit(".", 1)[0] for k in keys})
    late = layers[len(layers) - round(share * len(layers)) :]
    return [k for k in keys if k.rsplit(".", 1)[0] in late]


def same_shape(params: DataFrame) -> bool:
    """Whether all agents have the same keys and positions."""
    agents = params.select("agent").distinct().count()
    return params.groupBy("key", "pos").agg(F.countDistinct("agent").alias("n")).where(F.col("n") != agents).isEmpty()
