"""Assertions about data sets: mismatches and violations as counts, so a check is one small row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import euclidean


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows, missing, wrong, worst: keys of either side, keys of one side only, keys with unequal columns, largest difference.

    Equality is exact; nulls are equal to nulls. ``worst`` is null where no column is a number.
    """
    numbers = {c for c, kind in left.dtypes if c in columns and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    a = left.select(*keys, F.lit(True).alias("__a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = right.select(*keys, F.lit(True).alias("__b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = a.join(b, keys, "full")
    here = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    equal = F.lit(True)
    for c in columns:
        equal &= F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    gaps = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).cast("double") for c in columns if c in numbers]
    worst = F.max(F.greatest(*gaps, F.lit(0.0))) if gaps else F.lit(None).cast("double")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(F.count("*").alias("rows"), count(~here).alias("missing"), count(here & ~equal).alias("wrong"), worst.alias("worst"))


def ordering_violations(samples: DataFrame, anchor: str, positive: Column, negative: Column) -> DataFrame:
    """anchors, violations: anchors whose mean distance to positives is not below that to negatives."""
    per = samples.groupBy(anchor).agg(F.avg(positive).alias("p"), F.avg(negative).alias("n"))
    return per.agg(F.count("*").alias("anchors"), F.coalesce(F.sum((~(F.col("p") < F.col("n"))).cast("long")), F.lit(0)).cast("long").alias("violations"))


def shared_inconsistencies(shared: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """i, j, n, strangers: per pair the shared keys that one of its sites does not hold locally."""
    held = local.select("bs_id", key).distinct()
    strangers = lambda c: shared.join(held.withColumnRenamed("bs_id", c), [c, key], "left_anti").select("i", "j", key)
    bad = strangers("i").unionByName(strangers("j")).distinct().groupBy("i", "j").agg(F.count("*").alias("strangers"))
    total = shared.groupBy("i", "j").agg(F.count("*").alias("n"))
    return total.join(bad, ["i", "j"], "left").select("i", "j", "n", F.coalesce("strangers", F.lit(0)).alias("strangers"))


def feature_ordering(samples: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """anchors, violations: as ordering_violations, by the distance of feature vectors.

    ``samples``: anchor, pos, neg, keys of ``features`` (key, f). Samples with a key that has no features are left out.
    """
    named = lambda c: features.select(F.col(key).alias(c), F.col("f").alias(f"f_{c}"))
    met = samples.join(named("anchor"), "anchor").join(named("pos"), "pos").join(named("neg"), "neg")
    return ordering_violations(met, "anchor", euclidean(F.col("f_anchor"), F.col("f_pos")), euclidean(F.col("f_anchor"), F.col("f_neg")))


def items(index: DataFrame, wanted: DataFrame, source: DataFrame, place: str, key: str) -> DataFrame:
    """The rows of ``source`` at the ``wanted`` places of an index (place, key), with the place."""
    return index.select(place, key).join(wanted.select(place).distinct(), place).join(source, key)


def fingerprint_join(left: DataFrame, right: DataFrame, key: str, columns: list[str], digits: int = 6) -> DataFrame:
    """key, found: for each row of ``right`` the first row of ``left`` that prints alike in ``columns``; rows without one are left out.

    Left rows collapse to one a fingerprint before they meet, so repeated rows are no hot key.
    """
    printed = F.concat_ws(",", *(F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in columns))
    firsts = left.select(printed.alias("__print"), key).groupBy("__print").agg(F.min(key).alias("found"))
    return right.select(printed.alias("__print"), key).join(firsts, "__print").select(key, "found")
