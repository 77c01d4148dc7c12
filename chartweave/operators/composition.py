"""From trajectories to the data sets of sites and pairs, fold by fold, in one lineage.

Trajectories are walked once. A fold keeps all anchors and draws their positives and negatives anew from a stream of its own,
so folds differ in samples and in nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import coherent_samples
from .layers import near_samples
from .near import Near
from .sampling import draw, integer


def anchors_of(steps: DataFrame, margin: int) -> DataFrame:
    """walker, node, t, length: the steps of each walk that are ``margin`` from either end; of a place visited again the last visit counts."""
    sized = steps.join(steps.groupBy("walker").agg((F.max("t") + 1).alias("length")), "walker")
    inner = sized.where((F.col("t") >= margin) & (F.col("t") < F.col("length") - margin))
    return inner.groupBy("walker", "node").agg(F.max("t").alias("t"), F.max("length").alias("length"))


def _ranks(anchors: DataFrame, folds: int, seed: int, kind: str, have: str, wanted: int, more: list[str]) -> DataFrame:
    """fold, walker, node, k, rank: ``wanted`` different ranks below ``have`` for each anchor and fold, all sets with the same chance; nothing is listed."""
    every = anchors.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def step(taken, d):
        below = F.col(have) - wanted + d
        rank = integer(draw(seed, F.col("fold"), F.lit(kind), F.col("walker"), F.col("node"), d), below)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, rank), below - 1).otherwise(rank).cast("long")))

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(wanted)), F.array().cast("array<long>"), step)
    return every.select("fold", "walker", "node", "t", *more, F.posexplode(drawn).alias("k", "rank"))


def walk_triplets(steps: DataFrame, near: int, far: int, n_pos: int, n_neg: int, folds: int, seed: int) -> DataFrame:
    """fold, walker, node, kind, k, other: the drawn positives and negatives of every anchor.

    Positives are places at most ``near`` steps away on the same walk, negatives places more than ``far`` away; anchors stand ``far``
    from the walk's ends and have as many of each as are wanted. Samples are different steps, and so may repeat a place. A rank turns into a step by
    arithmetic, and a step into its place by an equi-join.
    """
    t, n = F.col("t"), F.col("length")
    low, high = F.greatest(t - near, F.lit(0)), F.least(t + near, n - 1)
    sized = anchors_of(steps, far).withColumns({"low": low, "pos_n": high - low, "left": F.greatest(t - far, F.lit(0)), "neg_n": F.greatest(t - far, F.lit(0)) + F.greatest(n - 1 - t - far, F.lit(0))})
    enough = sized.where((F.col("pos_n") >= n_pos) & (F.col("neg_n") >= n_neg))
    pos = _ranks(enough, folds, seed, "pos", "pos_n", n_pos, ["low"]).withColumn("at", F.col("low") + F.col("rank") + (F.col("low") + F.col("rank") >= t).cast("int"))
    neg = _ranks(enough, folds, seed, "neg", "neg_n", n_neg, ["left"]).withColumn("at", F.when(F.col("rank") < F.col("left"), F.col("rank")).otherwise(t + far + 1 + F.col("rank") - F.col("left")))
    both = pos.select("fold", "walker", "node", F.lit("pos").alias("kind"), "k", "at").unionByName(neg.select("fold", "walker", "node", F.lit("neg").alias("kind"), "k", "at"))
    places = steps.select("walker", F.col("t").alias("at"), F.col("node").alias("other"))
    return both.join(places, ["walker", "at"]).select("fold", "walker", "node", "kind", "k", "other")


def coherent_triplets(steps: DataFrame, edges: DataFrame | Near, pos_hops: int, neg_hops: int, margin: int, n_pos: int, n_neg: int, folds: int, seed: int, points: DataFrame | None = None, key: str = "") -> DataFrame:
    """fold, walker, node, kind, k, other: positives 1 to ``pos_hops`` hops from the anchor, negatives exactly ``neg_hops``.

    On a graph by reach, of ``points``, an anchor's samples are drawn where its layers are found, so neither is a table.
    """
    anchors = anchors_of(steps, margin).select("walker", "node")
    if isinstance(edges, Near):
        return near_samples(points, key, edges, anchors, pos_hops, neg_hops, n_pos, n_neg, folds, seed)
    found = coherent_samples(edges, anchors.select(F.col("node").alias("start")).distinct(), pos_hops, neg_hops)
    sizes = found.groupBy("start").pivot("kind", ["pos", "neg"]).count().where((F.col("pos") >= n_pos) & (F.col("neg") >= n_neg)).select("start")
    reached = found.join(sizes, "start").select("start", F.col("node").alias("other"), "kind")
    every = anchors.select("walker", F.col("node").alias("start")).join(reached, "start").withColumnRenamed("start", "node")
    every = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    order = Window.partitionBy("fold", "walker", "node", "kind").orderBy(draw(seed, F.col("fold"), F.col("kind"), F.col("walker"), F.col("node"), F.col("other")), "other")
    ranked = every.withColumn("k", F.row_number().over(order) - 1)
    return ranked.where(F.col("k") < F.when(F.col("kind") == "pos", n_pos).otherwise(n_neg)).select("fold", "walker", "node", "kind", "k", "other")


def local_samples(triplets: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """bs_id and the samples of the anchors that it sees; positives and negatives may lie where it sees nothing."""
    return triplets.join(covered.select("bs_id", F.col(key).alias("node")), "node").select("bs_id", *triplets.columns)


def shared_anchors(triplets: DataFrame, covered: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """i, j, node: places of anchors that both sites of a pair see; the same in every fold."""
    from .sites import shared_keys

    anchors = triplets.select(F.col("node").alias(key)).distinct()
    return shared_keys(covered.join(anchors, key, "left_semi"), pairs, key).withColumnRenamed(key, "node")
