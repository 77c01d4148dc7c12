"""Coverage, membership and radius operators over positions (columns ``x``, ``y``, optionally ``z``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cells import MARGIN, area_cells, crosses, extent_of, hull_boxes, meeting, segment_cells, within
from .near import close_side, nearest_within, placed


def squared(*pairs: tuple[Column, Column]) -> Column:
    """Sum of squared differences, in the order given."""
    total = None
    for a, b in pairs:
        term = (a - b) * (a - b)
        total = term if total is None else total + term
    return total


def coverage(points: DataFrame, sites: DataFrame, key: str, r_min: float = 0.0) -> DataFrame:
    """bs_id, key: the points within a site's radius and not nearer than ``r_min``.

    Circles meet points by grid cells; a null place or site covers nothing.
    """
    d2 = squared((F.col("x"), F.col("cx")), (F.col("y"), F.col("cy")))
    inside = d2 <= F.col("radius") * F.col("radius")
    if r_min > 0:
        inside &= d2 >= r_min * r_min
    r = F.abs("radius") * (1 + MARGIN)
    box = {"low_x": F.col("cx") - r, "low_y": F.col("cy") - r, "high_x": F.col("cx") + r, "high_y": F.col("cy") + r}
    circles, sizes = area_cells(sites.where("cx is not null and cy is not null and radius is not null").withColumns(box))
    found = None
    for size in sizes:
        part = meeting(points.select(key, "x", "y"), circles, size, inside, "inner").select("bs_id", key)
        found = part if found is None else found.unionByName(part)
    if found is None:  # no site
        return points.where(F.lit(False)).select(F.lit(None).cast(dict(sites.dtypes)["bs_id"]).alias("bs_id"), key)
    return found


def coverage_radius(points: DataFrame, share: float) -> DataFrame:
    """One row ``radius``: ``share`` of the shorter side of the points' bounding box."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie in [0, 1]")
    return points.agg((share * F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).alias("radius"))


def height_band(points: DataFrame, z_col: str, low: float | None, high: float | None) -> DataFrame:
    """Points whose height lies in [low, high]; None leaves a side open."""
    keep = F.lit(True)
    if low is not None:
        keep &= F.col(z_col) >= low
    if high is not None:
        keep &= F.col(z_col) <= high
    return points.where(keep)


def covered_by_any(points: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Points that at least one site covers."""
    return points.join(covered.select(key), key, "left_semi")


def extent(points: DataFrame) -> DataFrame:
    """One row: centroid and ranges."""
    return points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"), F.count("*").alias("n"))


def inscribed_ellipse(points: DataFrame, sites: DataFrame, boundary: int = 720, steps: int = 64) -> tuple[float, float, float, float]:
    """(cx, cy, a, b): the largest axis-aligned ellipse about the centroid, with the box's aspect, whose boundary
    the site circles cover. Only the one-row extent and the site table reach the driver; bisection is arithmetic there."""
    e = extent(points).first()
    if not e["n"]:
        raise ValueError("no points")
    circles = [(r["cx"], r["cy"], r["radius"]) for r in sites.collect()]
    angles = [2 * math.pi * k / boundary for k in range(boundary)]

    def fits(scale: float) -> bool:
        a, b = scale * e["dx"] / 2, scale * e["dy"] / 2
        return all(any(math.hypot(e["mx"] + a * math.cos(t) - x, e["my"] + b * math.sin(t) - y) <= r for x, y, r in circles) for t in angles)

    low, high = 0.0, 1.0
    while fits(high) and high < 1e6:
        high *= 2
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return e["mx"], e["my"], low * e["dx"] / 2, low * e["dy"] / 2


def in_ellipse(points: DataFrame, cx: float, cy: float, a: float, b: float) -> DataFrame:
    u, v = (F.col("x") - cx) / a, (F.col("y") - cy) / b
    return points.where(u * u + v * v <= 1)


def outside_hulls(points: DataFrame, hulls: DataFrame, key: str) -> DataFrame:
    """Points that lie in no convex hull; a hull is its half-planes a*x + b*y + c <= 0, one a row. Points without a place stay.

    Hulls meet points by grid cells: an anti-join for each order of size that hulls have.
    """
    extent = extent_of(points, ["x"], ["y"])
    if extent is None:
        return points
    cells, sizes = area_cells(hull_boxes(hulls, extent).withColumnsRenamed({"hull_id": "__hull", "planes": "__planes"}))
    for size in sizes:
        points = meeting(points, cells, size, within("__planes", "x", "y"), "left_anti")
    return points


def _corners(points) -> list[tuple[float, float]]:
    """Corners of the convex hull (monotone chain), counter-clockwise; one or two points are their own."""
    points = sorted(set(points))

    def half(ordered):
        out = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1]) if len(points) > 2 else points


def partial_corners(vertices: DataFrame, key: str) -> DataFrame:
    """key, x, y: the hull corners of each group within each input partition; the hull of these is the group's."""
    kind = dict(vertices.dtypes)[key]

    def reduce(frames):
        import pandas as pd

        held: dict = {}
        for frame in frames:
            for group, part in frame.groupby(key, dropna=False, sort=False):
                group = None if pd.isna(group) else group
                held[group] = _corners(held.get(group, []) + list(zip(part["x"], part["y"])))
        rows = [(group, *p) for group, points in held.items() for p in points]
        out = pd.DataFrame(rows, columns=[key, "x", "y"])
        yield out.astype({key: "object"}) if None in held else out

    return vertices.select(key, "x", "y").mapInPandas(reduce, f"{key} {kind}, x double, y double")


def convex_hulls(vertices: DataFrame, key: str = "hull_id", least_area: float = 0.0, most_area: float = 1000.0) -> DataFrame:
    """key, a, b, c: half-planes of each group's convex hull (monotone chain), counter-clockwise.

    Only hull corners leave the partitions of the input, so a group may have any number of points. Repeated vertices count once; hulls of fewer
    than three corners or an area outside the bounds are left out.
    """

    def hull(group, frame):
        import pandas as pd

        ring = _corners(zip(frame["x"], frame["y"]))
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
        rows = []
        if len(ring) > 2 and least_area <= area <= most_area:
            for p, q in zip(ring, ring[1:] + ring[:1]):
                a, b = q[1] - p[1], p[0] - q[0]
                n = math.hypot(a, b)
                rows.append((group[0], a / n, b / n, -(a * p[0] + b * p[1]) / n))
        return pd.DataFrame(rows, columns=[key, "a", "b", "c"])

    kind = dict(vertices.dtypes)[key]
    return partial_corners(vertices, key).groupBy(key).applyInPandas(hull, f"{key} {kind}, a double, b double, c double")


def cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the grid cell of each point."""
    return df.withColumn("gx", F.floor(F.col(x) / size)).withColumn("gy", F.floor(F.col(y) / size))


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_key: str, right_key: str) -> DataFrame:
    """left_key, right_key, d2 of all pairs within ``radius``: an equi-join of grid cells, not all pairs.

    The right side is laid into its cell and the eight around it; both tables have x and y.
    """
    shifts = F.array(*(F.struct(F.lit(a).cast("long").alias("ox"), F.lit(b).cast("long").alias("oy")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    near = cells(right, radius).withColumn("o", F.explode(shifts)).select((F.col("gx") + F.col("o.ox")).alias("gx"), (F.col("gy") + F.col("o.oy")).alias("gy"), F.col(right_key).alias("__right"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    here = cells(left, radius).select("gx", "gy", F.col(left_key).alias("__left"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    d2 = squared((F.col("lx"), F.col("rx")), (F.col("ly"), F.col("ry")))
    met = here.join(near, ["gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return met.select(F.col("__left").alias(left_key), F.col("__right").alias(right_key), "d2")


def near_any(points: DataFrame, others: DataFrame, radius: float, key: str) -> DataFrame:
    """Points with one of ``others`` nearer than ``radius`` (streets: those near a building's inside)."""
    named = others.select(F.monotonically_increasing_id().alias("__other"), "x", "y")
    met = radius_join(points, named, radius, key, "__other").where(F.col("d2") < radius * radius)
    return points.join(met.select(key), key, "left_semi")


def segments_crossing(segments: DataFrame, hulls: DataFrame, key: str, eps: float = 1e-10) -> DataFrame:
    """Keys of segments (x0, y0, x1, y1) that run through a convex hull: each half-plane clips the parameter range.

    A segment meets the hulls of the grid cells that it runs through; one without an end crosses nothing.
    """
    known = segments.select(key, "x0", "y0", "x1", "y1").where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    extent = extent_of(known, ["x0", "x1"], ["y0", "y1"])
    if extent is None:
        return known.select(key)
    cells, sizes = area_cells(hull_boxes(hulls, extent))
    if not sizes:
        return known.select(key).limit(0)
    met = segment_cells(known, sizes).join(cells, ["size", "gx", "gy"])
    return met.where(crosses("planes", eps)).select(key).distinct()


def snap(queries: DataFrame, points: DataFrame, query_key: str, key: str, reach: float) -> DataFrame:
    """query_key, key, d2: the nearest point of each query (ties: the smaller key); queries without a place have none.

    The nearest of the points in a query's cell and the eight around it is the nearest of all if it is within one cell's
    size. Cells begin as small as the points are close, ``reach`` at most; a task looks through its cells by itself, so no pair is a row. Queries for
    which no point is so near go on to larger cells, of twice the size or, if they are few, up to eight times; each round is written down. A query far from all points meets those of the first cells that hold any.
    """
    kind, known = dict(points.dtypes)[key], "x is not null and y is not null and not isnan(x) and not isnan(y)"
    open_queries = materialize(queries.select(query_key, "x", "y").where(known), "snap")
    # of points at one place only the smallest key can be anyone's nearest
    places = materialize(placed(points, key).groupBy("x", "y").agg(F.min("id").alias("id")), "snap")
    extent = extent_of(places, ["x"], ["y"])
    if extent is not None:
        n, asked, reach, found = places.count(), open_queries.count(), close_side(places, reach), None
        left = asked
        while True:
            best = materialize(nearest_within(open_queries, query_key, places, reach, left > n, left + n), "snapped")
            found = best if found is None else found.unionByName(best)
            open_queries = materialize(open_queries.join(best.select(query_key), query_key, "left_anti"), "snap")
            left = open_queries.count()
            reach *= 2 if 64 * left > max(asked, 10_000) else 8
            if not left:
                return found.select(query_key, F.col("id").cast(kind).alias(key), "d2")
    return queries.join(points.select(key), F.lit(False)).select(query_key, key, F.lit(0.0).alias("d2"))


def typical_step(points: DataFrame, key: str, reach: float, first: int = 500) -> DataFrame:
    """One row ``step``: median distance to the nearest other point, over the ``first`` points by key (a feature of the measure)."""
    some = points.orderBy(key).limit(first)
    met = radius_join(some.select(F.col(key).alias("__own"), "x", "y"), points, reach, "__own", key).where(F.col("__own") != F.col(key))
    nearest = met.groupBy("__own").agg(F.sqrt(F.min("d2")).alias("d"))
    return nearest.agg(F.percentile("d", F.lit(0.5)).alias("step"))


def histogram2d(points: DataFrame, low: tuple[float, float], high: tuple[float, float], bins: int) -> DataFrame:
    """bx, by_, n: counts in equal bins; the last bin is closed on the right, points outside do not count."""
    def place(c, a, b):
        k = F.floor((F.col(c) - a) / ((b - a) / bins))
        return F.when((F.col(c) < a) | (F.col(c) > b), None).otherwise(F.least(k, F.lit(bins - 1))).cast("int")

    binned = points.select(place("x", low[0], high[0]).alias("bx"), place("y", low[1], high[1]).alias("by_"))
    return binned.dropna().groupBy("bx", "by_").agg(F.count("*").alias("n"))


def blur(histogram: DataFrame, bins: int, sigma: float, reach: int | None = None) -> DataFrame:
    """bx, by_, density: Gaussian blur of a histogram, scaled to a maximum of 1; cells outside the grid are lost."""
    reach = reach or math.ceil(3 * sigma)
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)
    kernel = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights))))
    out = histogram.withColumn("v", F.col("n").cast("double"))
    for c in ("bx", "by_"):
        other = "by_" if c == "bx" else "bx"
        moved = out.withColumn("s", kernel).select((F.col(c) + F.col("s.k")).alias(c), other, (F.col("v") * F.col("s.w")).alias("v"))
        out = moved.where((F.col(c) >= 0) & (F.col(c) < bins)).groupBy("bx", "by_").agg(F.sum("v").alias("v"))
    top = out.agg(F.max("v").alias("top"))
    return out.join(F.broadcast(top)).select("bx", "by_", (F.col("v") / F.col("top")).alias("density"))


def raster(areas: DataFrame, low: tuple[float, float], high: tuple[float, float], bins: int) -> DataFrame:
    """Each row of ``areas`` with bx, by_ and px, py: the cells of a square raster and their centres."""
    number = F.sequence(F.lit(0), F.lit(bins - 1))
    cells_ = areas.withColumn("bx", F.explode(number)).withColumn("by_", F.explode(number))
    centre = lambda c, k: F.lit(low[k]) + (F.col(c) + 0.5) * F.lit((high[k] - low[k]) / bins)
    return cells_.withColumn("px", centre("bx", 0)).withColumn("py", centre("by_", 1))


def tube(lines: DataFrame, line: str, low: tuple[float, float], high: tuple[float, float], bins: int, sigma: float, amplitude: float) -> DataFrame:
    """line, bx, by_, density: a Gaussian of the distance from each raster cell to a polyline, all cells of each line.

    ``lines`` has the polyline's segments (line, x0, y0, x1, y1), one a row; the nearest segment counts, found by an aggregate. A
    segment of no length is a point.
    """
    ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    vx, vy, size = F.col("px") - F.col("x0"), F.col("py") - F.col("y0"), ex * ex + ey * ey
    t = F.when(size > 0, F.least(F.greatest((vx * ex + vy * ey) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    d2 = squared((vx, t * ex), (vy, t * ey))
    near = raster(lines.select(line, "x0", "y0", "x1", "y1"), low, high, bins).groupBy(line, "bx", "by_").agg(F.min(d2).alias("d2"))
    return near.select(line, "bx", "by_", (F.lit(amplitude) * F.exp(-F.col("d2") / F.lit(2 * sigma * sigma))).alias("density"))


def bridges(sites: DataFrame, points: DataFrame, key: str, reach: float) -> DataFrame:
    """bs_id, x0, y0, x1, y1: from each site (bs_id, cx, cy) to the nearest point; a site that stands on a point has none."""
    placed = sites.select("bs_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    found = snap(placed, points, "bs_id", key, reach).join(points.select(key, F.col("x").alias("x1"), F.col("y").alias("y1")), key)
    return found.where("d2 >= 1e-12").join(placed, "bs_id").select("bs_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def gradient_colour(points: DataFrame) -> DataFrame:
    """Adds ``colour``: mean of x and y, each scaled to its range."""
    r = points.agg(F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.min("y").alias("y_low"), F.max("y").alias("y_high"))
    part = lambda c: (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low") + 1e-8)
    return points.join(F.broadcast(r)).withColumn("colour", (part("x") + part("y")) / 2).drop("x_low", "x_high", "y_low", "y_high")


def path_lengths(points: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``path``: distance walked up to each point of its group, and ``origin``: distance from the origin."""
    w = Window.partitionBy(group).orderBy(order)
    step = F.sqrt(squared((F.col("x"), F.lag("x").over(w)), (F.col("y"), F.lag("y").over(w))))
    stepped = points.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    path = F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("path", path).withColumn("origin", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).drop("__step")
