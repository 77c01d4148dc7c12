"""Areas met by grid cells: which points lie in which hulls and circles, which segments run through which hulls.

An area's bounding box goes to the grid whose cells are a power of two not smaller than the box, so it covers four cells
at most, however large it is. Points and segments look into each grid that has areas; there are as many as areas have
orders of size. All meetings are equi-joins on cells, and an exact test follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of areas that go to every task (some tens of MB); more of them meet points and segments in a shuffle.
BROADCAST_ROWS = 200_000
#: What a box is widened by, as a share of the extent of all data: no rounding of a clip or a cell loses a meeting.
MARGIN = 1e-9


def extent_of(df: DataFrame, xs: list[str], ys: list[str]) -> tuple[float, float, float, float] | None:
    """(low x, low y, high x, high y) over columns; None without any place."""
    low = lambda cs: F.min(F.least(*map(F.col, cs)) if len(cs) > 1 else F.col(cs[0]))
    high = lambda cs: F.max(F.greatest(*map(F.col, cs)) if len(cs) > 1 else F.col(cs[0]))
    known = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in xs + ys))
    row = known.agg(low(xs).alias("a"), low(ys).alias("b"), high(xs).alias("c"), high(ys).alias("d")).first()
    return None if row["a"] is None else tuple(row)


def clipped(corners: list[tuple[float, float]], planes: list[tuple[float, float, float]], slack: float) -> list[tuple[float, float]]:
    """A convex polygon cut by half-planes a x + b y + c <= 0, one after the other; points up to ``slack`` outside stay."""
    for a, b, c in planes:
        size = math.hypot(a, b) * slack
        sides = [a * x + b * y + c for x, y in corners]
        kept = []
        for k, (p, s) in enumerate(zip(corners, sides)):
            q, t = corners[k - 1], sides[k - 1]
            if (s <= size) != (t <= size):
                w = t / (t - s)
                kept.append((q[0] + w * (p[0] - q[0]), q[1] + w * (p[1] - q[1])))
            if s <= size:
                kept.append(p)
        corners = kept
    return corners


def hull_boxes(hulls: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """hull_id, planes, low_x, low_y, high_x, high_y: the box of each hull within the extent; hulls outside it are left out.

    A hull is its half-planes, one a row, and may be unbounded. One hull's half-planes meet in a list.
    """
    x0, y0, x1, y1 = extent
    slack = MARGIN * max(x1 - x0, y1 - y0, abs(x0), abs(x1), abs(y0), abs(y1), 1e-300)
    corners = [(x0 - slack, y0 - slack), (x1 + slack, y0 - slack), (x1 + slack, y1 + slack), (x0 - slack, y1 + slack)]
    kind = dict(hulls.dtypes)["hull_id"]
    planes = "planes array<struct<a:double,b:double,c:double>>"

    def boxes(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for hull, own in zip(frame["hull_id"], frame["planes"]):
                left = clipped(corners, [(p["a"], p["b"], p["c"]) for p in own], slack)
                if left:
                    xs, ys = zip(*left)
                    rows.append((hull, list(own), min(xs) - slack, min(ys) - slack, max(xs) + slack, max(ys) + slack))
            yield pd.DataFrame(rows, columns=["hull_id", "planes", "low_x", "low_y", "high_x", "high_y"])

    listed = hulls.groupBy("hull_id").agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in "abc"))).alias("planes"))
    return listed.mapInPandas(boxes, f"hull_id {kind}, {planes}, low_x double, low_y double, high_x double, high_y double")


def _place(value: Column, size: Column | float) -> Column:
    return F.floor(value / size)


def area_cells(boxes: DataFrame) -> tuple[DataFrame, list[float]]:
    """``boxes`` with size, gx, gy - four rows a box at most - as a written table, marked for every task if small; and the sizes of all grids."""
    side = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"), F.lit(2.0**-500))
    sized = boxes.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(side))))
    spans = sized.withColumn("gx", F.explode(F.sequence(_place(F.col("low_x"), F.col("size")), _place(F.col("high_x"), F.col("size")))))
    spans = spans.withColumn("gy", F.explode(F.sequence(_place(F.col("low_y"), F.col("size")), _place(F.col("high_y"), F.col("size")))))
    cells = materialize(spans.drop("low_x", "low_y", "high_x", "high_y"), "area-cells")
    sizes = [r[0] for r in cells.select("size").distinct().orderBy("size").collect()]
    return (F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells), sizes


def within(planes: str, x: str, y: str) -> Column:
    return F.forall(planes, lambda p: p["a"] * F.col(x) + p["b"] * F.col(y) + p["c"] <= 0)


def meeting(points: DataFrame, cells: DataFrame, size: float, exact: Column, how: str) -> DataFrame:
    """Points (x, y) joined with the areas of one grid that pass the exact test; ``how`` is inner or left_anti."""
    own = cells.where(F.col("size") == size).withColumnRenamed("gx", "__gx").withColumnRenamed("gy", "__gy").drop("size")
    met = (_place(F.col("x"), size) == F.col("__gx")) & (_place(F.col("y"), size) == F.col("__gy")) & exact
    return points.join(own, met, how)


def segment_cells(segments: DataFrame, sizes: list[float]) -> DataFrame:
    """``segments`` (x0, y0, x1, y1) with size, gx, gy of each cell they run through in each grid.

    Column by column of the grid, the heights between which the segment runs in it, widened by a part of a cell.
    """
    grid = segments.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    near, far = F.least("x0", "x1"), F.greatest("x0", "x1")
    columns = grid.withColumn("gx", F.explode(F.sequence(_place(near - F.col("size") * 1e-6, F.col("size")), _place(far + F.col("size") * 1e-6, F.col("size")))))
    slope = F.when(F.col("x1") != F.col("x0"), (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    at = lambda x: F.col("y0") + slope * (F.least(F.greatest(x, near), far) - F.col("x0"))
    edge = F.col("size") * 1e-6
    one, two = at(F.col("gx") * F.col("size") - edge), at((F.col("gx") + 1) * F.col("size") + edge)
    low, high = F.coalesce(F.least(one, two), F.least("y0", "y1")), F.coalesce(F.greatest(one, two), F.greatest("y0", "y1"))
    return columns.withColumn("gy", F.explode(F.sequence(_place(low - edge, F.col("size")), _place(high + edge, F.col("size")))))


def crosses(planes: str, eps: float) -> Column:
    """Whether the segment (x0, y0, x1, y1) runs through the hull: each half-plane cuts the range of its parameter."""
    start = lambda p: p["a"] * F.col("x0") + p["b"] * F.col("y0") + p["c"]
    slope = lambda p: p["a"] * (F.col("x1") - F.col("x0")) + p["b"] * (F.col("y1") - F.col("y0"))
    enter = F.aggregate(planes, F.lit(0.0), lambda m, p: F.greatest(m, F.when(slope(p) < -eps, -start(p) / slope(p)).otherwise(0.0)))
    leave = F.aggregate(planes, F.lit(1.0), lambda m, p: F.least(m, F.when(slope(p) > eps, -start(p) / slope(p)).otherwise(1.0)))
    outside = F.exists(planes, lambda p: (F.abs(slope(p)) <= eps) & (start(p) > eps))
    return (enter <= leave) & ~outside
