"""Streaming variants: coverage of arriving points, and pairs close in time with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import coverage


def live_coverage(points: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """bs_id, key of a stream of points; stateless."""
    return coverage(points, sites, key)


def live_positives(left: DataFrame, right: DataFrame, group: str, key: str, time: str, reach: str, late: str) -> DataFrame:
    """group, key, other: pairs of a group within ``reach`` of two streams of the same events.

    Watermarks of ``late`` and the interval condition let the state store forget rows that can meet no more.
    """
    a = left.withWatermark(time, late).select(F.col(group), F.col(key), F.col(time).alias("t"))
    b = right.withWatermark(time, late).select(F.col(group).alias("g2"), F.col(key).alias("other"), F.col(time).alias("u"))
    near = F.expr(f"u between t - interval {reach} and t + interval {reach}")
    return a.join(b, (F.col(group) == F.col("g2")) & near & (F.col(key) != F.col("other"))).select(group, key, "other")


def live_counts(events: DataFrame, group: str, time: str, width: str, late: str) -> DataFrame:
    """group, start, n: events of each window; late ones count until the watermark passes."""
    return events.withWatermark(time, late).groupBy(group, F.window(time, width)).agg(F.count("*").alias("n")).select(group, F.col("window.start").alias("start"), "n")
