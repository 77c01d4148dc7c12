"""Data sets of single sites and of site pairs, spatial ranks and the rules that mix them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import squared


def local_sets(anchors: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """bs_id and the anchors that it sees."""
    return anchors.join(covered.select("bs_id", key), key)


def shared_keys(covered: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """i, j, key: points that both sites of a pair see. Pairs are few; each side joins on its own site, then on the key."""
    a = covered.select(F.col("bs_id").alias("i"), key).join(F.broadcast(pairs), "i")
    b = covered.select(F.col("bs_id").alias("j"), key)
    return a.join(b, ["j", key]).select("i", "j", key)


def shared_sets(values: DataFrame, pairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """i, j, key and both sites' columns a_<c>, b_<c> at the points they share."""
    a = values.select(F.col("bs_id").alias("i"), key, *(F.col(c).alias(f"a_{c}") for c in columns)).join(F.broadcast(pairs), "i")
    b = values.select(F.col("bs_id").alias("j"), key, *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b, ["j", key])


def valid_pairs(pairs: DataFrame, groups: int) -> DataFrame:
    """Pairs of existing groups, as i < j."""
    both = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where(F.col("i") != F.col("j"))
    return both.where(F.col("j") < groups).distinct()


def virtual_sites(parts: DataFrame, groups: DataFrame, key: str, site: str = "bs_id", vector: str = "x", width: int | None = None) -> DataFrame:
    """group_id, key, vector: the parts of a group's sites one after the other, in the group's order.

    ``groups`` has group_id, place and site, a row a member, and goes to every task (a handful of rows); ``parts`` has a vector for a site and key. A key for which a member has no
    part, or a null one, is left out; with ``width`` so many zeros stand in its place, as long as any member has a part.
    """
    members = groups.select("group_id", "place", F.col(site).alias("__site"))
    sizes = members.groupBy("group_id").agg(F.array_sort(F.collect_list("place")).alias("__places"))
    met = parts.where(F.col(vector).isNotNull()).join(F.broadcast(members), F.col(site) == F.col("__site")).groupBy("group_id", key).agg(F.map_from_entries(F.collect_list(F.struct("place", vector))).alias("__parts"))
    joined = met.join(F.broadcast(sizes), "group_id")
    if width is None:
        joined = joined.where(F.size("__parts") == F.size("__places"))
    zeros = F.array_repeat(F.lit(0.0), width or 0)
    whole = F.flatten(F.transform("__places", lambda p: F.coalesce(F.element_at("__parts", p), zeros)))
    return joined.select("group_id", key, whole.alias(vector))


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds the nearest centre (ties: the smaller id). Centres (cluster, cx, cy) are few and go to every task inside the plan."""
    held = F.broadcast(centres.agg(F.collect_list(F.struct("cluster", "cx", "cy")).alias("__c")))
    d2 = lambda c: squared((F.col("x"), c["cx"]), (F.col("y"), c["cy"]))
    best = F.array_min(F.transform("__c", lambda c: F.struct(d2(c).alias("d2"), c["cluster"].alias("cluster"))))
    return points.join(held).withColumn("cluster", best["cluster"]).drop("__c")


def lloyd(points: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    """Centres after ``rounds`` of assignment and mean; a centre without points stays."""
    for _ in range(rounds):
        moved = assign(points, centres).groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        centres = centres.join(moved, "cluster", "left").select("cluster", F.coalesce("mx", "cx").alias("cx"), F.coalesce("my", "cy").alias("cy"))
        rows = centres.collect()  # a handful of centres; cuts the plan
        centres = points.sparkSession.createDataFrame([tuple(r) for r in rows], centres.schema)
    return centres


def ranked(centres: DataFrame, slope: float = 0.852) -> DataFrame:
    """Centres with ``rank`` by cx - slope * cy."""
    return centres.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cx") - slope * F.col("cy"), "cluster")) - 1)


def site_policy(groups: int) -> list[tuple[int, list[int]]]:
    """Spatial ranks that each site may use: two groups take {1, 2} and {0, 1}; of four single ones
    sites 1 and 3 take 0 and 1, sites 0 and 2 take 1 and 2; any other number takes all."""
    if groups == 2:
        return [(0, [1, 2]), (1, [0, 1])]
    if groups == 4:
        return [(s, [0, 1] if s % 2 else [1, 2]) for s in range(4)]
    return [(s, [0, 1, 2]) for s in range(groups)]


def pair_policy(groups: int) -> list[tuple[int, int, list[int]]]:
    """Ranks that a pair shares: those of both its sites."""
    own = dict(site_policy(groups))
    return [(i, j, sorted(set(own[i]) & set(own[j]))) for i in range(groups) for j in range(i + 1, groups)]


def by_policy(points: DataFrame, spark, groups: int, key: str) -> DataFrame:
    """bs_id, key: points (with ``rank``) that the policy gives to each site."""
    rows = [(s, r) for s, ranks in site_policy(groups) for r in ranks]
    return points.join(F.broadcast(spark.createDataFrame(rows, "bs_id int, rank int")), "rank").select("bs_id", key)


def pairs_by_policy(points: DataFrame, spark, groups: int, key: str) -> DataFrame:
    rows = [(i, j, r) for i, j, ranks in pair_policy(groups) for r in ranks]
    return points.join(F.broadcast(spark.createDataFrame(rows, "i int, j int, rank int")), "rank").select("i", "j", key)
