"""Reproducible randomness by md5, indexes over all rows and seeded splits.

md5 of seed and key gives the same order in every engine; nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A hex string that orders rows at random but reproducibly."""
    return F.md5(F.concat_ws(":", *(F.lit(p).cast("string") if isinstance(p, int) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def fraction(hexes: Column, digits: int = 8) -> Column:
    """The first hex digits as a number in [0, 1)."""
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("double") / float(16**digits)


def integer(hexes: Column, below: Column | int, digits: int = 12) -> Column:
    """A number in [0, below)."""
    n = F.lit(below) if isinstance(below, int) else below
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long") % n


def race_key(weight: Column, u: Column) -> Column:
    """An exponential key of rate ``weight`` from a number in [0, 1): the smallest key of all is each row's with a chance in proportion to its weight."""
    return F.when(weight > 0, -F.log((u * 1e12 + 0.5) / (1e12 + 1)) / weight)


def weighted_draws(df: DataFrame, key: str, weight: Column, draws: int, seed: int) -> DataFrame:
    """draw_no, key: for each draw a row with a chance in proportion to its weight, with replacement from draw to draw.

    Every row races in every draw and each task sends its winners on, one a draw; nothing is summed or normalised first. Rows with
    no weight, or less, are never drawn.
    """
    runners = df.select(F.col(key), weight.alias("__w")).where("__w > 0").withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    rank = race_key(F.col("__w"), fraction(draw(seed, F.col("draw_no"), F.col(key)), 12))
    return runners.groupBy("draw_no").agg(F.min(F.struct(rank.alias("r"), F.col(key))).alias("m")).select("draw_no", f"m.{key}")


def global_index(df: DataFrame, order: list[str], name: str = "gidx") -> DataFrame:
    """Adds the position of each row in the order of all rows, from 0.

    The rows are range-partitioned and counted by partition; offsets, one number a
    partition, go back to the tasks. No window without a key, so no single task.
    """
    from ..session import materialize

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed.withColumn("__row", F.monotonically_increasing_id()), "ordered")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") - F.col("low") + F.col("offset")).drop("__part", "__row", "low", "offset")


def seeded_split(df: DataFrame, key: str, shares: tuple[float, float], seed: int) -> DataFrame:
    """Adds ``split``: the first floor(share * N) rows of the seeded order are train, the next val, the rest test."""
    n = df.count()
    drawn = global_index(df.withColumn("__draw", draw(seed, F.col(key))), ["__draw", key], "__rank")
    first, second = int(shares[0] * n), int(shares[0] * n) + int(shares[1] * n)
    return drawn.withColumn("split", F.when(F.col("__rank") < first, "train").when(F.col("__rank") < second, "val").otherwise("test")).drop("__draw", "__rank")


def sample_per_group(df: DataFrame, group: list[str], candidate: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group without replacement, by the seeded order of (group, candidate)."""
    order = draw(seed, *(F.col(g) for g in group), F.col(candidate))
    w = Window.partitionBy(*group).orderBy(order, candidate)
    return df.withColumn("draw_no", F.row_number().over(w)).where(F.col("draw_no") <= n)


def bootstrap(n: int, draws: int, size: int, seed: int, spark) -> DataFrame:
    """s, m, idx: for each of ``draws`` repetitions ``size`` row numbers below n, with replacement."""
    grid = spark.range(draws).select(F.col("id").cast("int").alias("s")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.withColumn("idx", integer(draw(seed, F.col("s"), F.col("m")), n))


def down_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The rows whose draw falls below ``share``."""
    return df.where(fraction(draw(seed, F.col(key))) < share)


def contrastive_labels(df: DataFrame, key: str, p_positive: float, seed: int) -> DataFrame:
    """Adds ``y``: 1 with probability ``p_positive``."""
    return df.withColumn("y", (fraction(draw(seed, F.col(key))) < p_positive).cast("int"))
