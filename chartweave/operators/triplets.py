"""Positive and negative samples around anchors: bands in time, windows of rows, and their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .sampling import draw, integer, sample_per_group


def ordered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``ord``, the position within the group from 0, and ``n``, the group's rows."""
    w = Window.partitionBy(group)
    return df.withColumn("ord", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))


def band_counts(df: DataFrame, group: str, time: str, reach: int) -> DataFrame:
    """Adds lo, hi: the positions [lo, hi) of the group's rows within ``reach`` in time, the row itself included.

    A RANGE frame; no join.
    """
    frame = Window.partitionBy(group).orderBy(time).rangeBetween(-reach, reach)
    return df.withColumn("lo", F.min("ord").over(frame)).withColumn("hi", F.max("ord").over(frame) + 1)


def band_join(left: DataFrame, right: DataFrame, group: str, time: str, key: str, reach: int) -> DataFrame:
    """group, key, other: pairs of rows of a group at most ``reach`` apart, without the row itself.

    The band is an equi-join: buckets of width ``reach``, the right side laid into its own and the two
    beside it; the residual decides.
    """
    bucket = lambda c: F.floor(F.col(c) / reach)
    a = left.select(group, F.col(key), F.col(time).alias("__t"), bucket(time).alias("__b"))
    b = right.select(group, F.col(key).alias("other"), F.col(time).alias("__u"), F.explode(F.array(*(bucket(time) + k for k in (-1, 0, 1)))).alias("__b"))
    met = a.join(b, [group, "__b"]).where((F.abs(F.col("__t") - F.col("__u")) <= reach) & (F.col(key) != F.col("other")))
    return met.select(group, key, "other")


def row_window(df: DataFrame, group: str, reach: int) -> DataFrame:
    """group, ord, pos_ord: rows at most ``reach`` positions away, without the row itself."""
    offsets = F.explode(F.array(*(F.lit(k) for k in range(-reach, reach + 1) if k)))
    moved = df.select(group, "ord", "n", offsets.alias("o")).withColumn("pos_ord", F.col("ord") + F.col("o"))
    return moved.where((F.col("pos_ord") >= 0) & (F.col("pos_ord") < F.col("n"))).select(group, "ord", "pos_ord")


def trim_ends(df: DataFrame, margin: int) -> DataFrame:
    """Anchors that are ``margin`` rows from either end of their group."""
    return df.where((F.col("ord") >= margin) & (F.col("ord") < F.col("n") - margin))


def complement_sample(df: DataFrame, lo: Column, hi: Column, n: Column, draws: int, seed: int, key: list[str]) -> DataFrame:
    """key, draw_no, neg_ord: positions outside [lo, hi), drawn without replacement and without listing the complement.

    Of the m = n - (hi - lo) ranks of the complement k = min(draws, m) are drawn: draw d takes a rank t below m - k + d,
    or the last of these if t was taken before, which gives every set of k ranks the same chance. Ranks from
    lo on skip the band. Rows without a complement have no negatives, rows with a small one have it whole.
    """
    width = hi - lo
    most, count = n - width, F.least(F.lit(draws), n - width).cast("int")

    def step(taken: Column, d: Column) -> Column:
        below = most - count + d
        rank = integer(draw(seed, *(F.col(k) for k in key), d), below)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, rank), below - 1).otherwise(rank).cast("long")))

    ranks = F.aggregate(F.sequence(F.lit(1), count), F.array().cast("array<long>"), step)
    drawn = df.where(most > 0).select("*", F.posexplode(ranks).alias("__d", "__rank"))
    rank = F.col("__rank")
    return drawn.select(*key, (F.col("__d") + 1).alias("draw_no"), F.when(rank < lo, rank).otherwise(rank + width).alias("neg_ord"))


def enough(df: DataFrame, n_pos: int | None, n_neg: int | None) -> DataFrame:
    """Anchors with at least one, or the wanted number, of positives and of negatives (columns pos_n, neg_n)."""
    return df.where((F.col("pos_n") >= (n_pos or 1)) & (F.col("neg_n") >= (n_neg or 1)))


def time_triplets(df: DataFrame, group: str, time: str, key: str, reach: int, n_pos: int, n_neg: int, seed: int) -> DataFrame:
    """group, key, pos array, neg array: triplets by coherence in time.

    Positives: within ``reach``; negatives: outside it; n of each, seeded; anchors with too few of either
    are left out. Arrays are in draw order, so position k of one goes with position k of the other.
    """
    base = band_counts(ordered(df, group, [time, key]), group, time, reach)
    anchors = enough(base.withColumn("pos_n", F.col("hi") - F.col("lo") - 1).withColumn("neg_n", F.col("n") - F.col("hi") + F.col("lo")), n_pos, n_neg)
    near = band_join(anchors, base, group, time, key, reach)
    gather = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("draw_no", c))), lambda s: s[c])
    pos = sample_per_group(near, [group, key], "other", n_pos, seed).groupBy(group, key).agg(gather("other").alias("pos"))
    drawn = complement_sample(anchors, F.col("lo"), F.col("hi"), F.col("n"), n_neg, seed + 1, [group, key])
    named = drawn.join(base.select(group, F.col("ord").alias("neg_ord"), F.col(key).alias("negative")), [group, "neg_ord"])
    neg = named.groupBy(group, key).agg(gather("negative").alias("neg"))
    return pos.join(neg, [group, key])


def triplet_loss(positive: Column, negative: Column, margin: float) -> Column:
    """Aggregate: mean of max(0, d(anchor, positive) - d(anchor, negative) + margin)."""
    return F.avg(F.greatest(F.lit(0.0), positive - negative + F.lit(margin)))


def contrastive_loss(y: Column, distance: Column, margin: float) -> Column:
    """Aggregate: mean of y d^2 + (1 - y) max(0, margin - d)^2."""
    gap = F.greatest(F.lit(0.0), F.lit(margin) - distance)
    return F.avg(y * distance * distance + (F.lit(1) - y) * gap * gap)


def distance_to_group(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Adds ``d``, the sum of squared distances of a row's vector to all vectors of its group.

    n |a - m|^2 + Q with the group's count, mean m and sum Q of squares about it: aggregates that are combined
    before the shuffle, so no group is gathered, and that stay exact far from the origin. Null vectors count for nothing and get null.
    """
    cells = df.where(F.col(group).isNotNull()).select(group, F.posexplode(vector).alias("__at", "__v")).withColumn("__v", F.col("__v").cast("double"))
    sums = cells.groupBy(group, "__at").agg(F.avg("__v").alias("__m"), (F.var_pop("__v") * F.count("*")).alias("__q"), F.count("*").alias("__n"))
    ordered_means = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__m"))), lambda c: c["__m"])  # one entry a dimension
    whole = sums.groupBy(group).agg(ordered_means.alias("__mean"), F.sum("__q").alias("__squares"), F.max("__n").alias("__rows"))
    gap = F.zip_with(vector, "__mean", lambda a, m: a - m)
    d = F.col("__rows") * V.dot(gap, gap) + F.col("__squares")
    return df.join(whole, group).withColumn("d", d).drop("__mean", "__squares", "__rows")


def lock_step(loaders: dict[str, DataFrame], order: str, batch: int) -> DataFrame:
    """step, loader, order: batches in lock step; shorter loaders start again until the longest ends."""
    from .sampling import global_index

    cut, sizes = {}, {}
    for name, df in loaders.items():
        cut[name] = global_index(df.select(order), [order], "__r").select(order, F.floor(F.col("__r") / batch).alias("own"))
        sizes[name] = -(-df.count() // batch)
    most, out = max(sizes.values(), default=0), None
    for name, df in cut.items():
        if sizes[name]:
            repeats = F.explode(F.sequence(F.lit(0), F.lit((most - 1) // sizes[name])))
            part = df.withColumn("again", repeats).select((F.col("own") + F.col("again") * sizes[name]).alias("step"), F.lit(name).alias("loader"), order).where(F.col("step") < most)
            out = part if out is None else out.unionByName(part)
    return out
