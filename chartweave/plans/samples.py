"""Queries of features, triplets, sites, geometry and graphs, with their oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import graph as N
from ..operators import sampling as R
from ..operators import sites as S
from ..operators import triplets as T
from ..operators.layers import near_layers
from ..operators.near import Near
from ..session import table
from .fixtures import ANTENNAS, SITES, SQL_VIEWS, SUBCARRIERS, charts, hulls, site_pairs, sites, snapshots, trajectories
from .quality import r6

HOURS6 = 6 * 3600 * 1_000_000
LAGS = (0, 2, 4)
VIRTUAL = [(0, 0, 0), (0, 1, 1), (1, 0, 3), (1, 1, 2)]
STO, CPO = [0.5, -1.0, 2.0, 0.25], [0.1, 0.2, -0.3, 0.4]


def _long(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row an element: keys, pos, v."""
    return df.select(*keys, F.posexplode(column).alias("pos", "v"))


def _complex(df: DataFrame, column: str) -> DataFrame:
    out = _long(df, column, "vec_id")
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("v.re", "re"), r6("v.im", "im"))


def csi_slice_group(spark, sf_dir):
    """Antennas 1 and 2 of every snapshot."""
    return _complex(snapshots(spark, sf_dir).select("vec_id", V.antennas(F.col("csi"), 1, 2, SUBCARRIERS).alias("h")), "h")


def fftshift(spark, sf_dir):
    return _complex(snapshots(spark, sf_dir).select("vec_id", V.fft_shift(F.col("csi"), ANTENNAS, SUBCARRIERS).alias("h")), "h")


def calibration_phase(spark, sf_dir):
    turned = V.calibrate(V.fft_shift(F.col("csi"), ANTENNAS, SUBCARRIERS), F.array(*map(F.lit, STO)), F.array(*map(F.lit, CPO)), SUBCARRIERS, SUBCARRIERS)
    return _complex(snapshots(spark, sf_dir).select("vec_id", turned.alias("h")), "h")


def _features(spark, sf_dir, method):
    found = V.features(F.col("csi"), method, ANTENNAS, SUBCARRIERS, chunk=4, lags=LAGS)
    return _long(snapshots(spark, sf_dir).select("vec_id", found.alias("f")), "f", "vec_id").select("vec_id", F.col("pos").cast("long").alias("pos"), r6("v", "v"))


def chunk_average_features(spark, sf_dir):
    return _features(spark, sf_dir, "chunks")


def autocorr_features(spark, sf_dir):
    return _features(spark, sf_dir, "lags")


def _distance(spark, sf_dir, kind):
    """Each vector against those of the next three ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = e.select(F.explode(F.array(*(F.col("vec_id") - k for k in (1, 2, 3)))).alias("anchor"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(near, e.vec_id == near.anchor).select("anchor", "other", r6(V.DISTANCES[kind](F.col("embedding"), F.col("b")), "d"))


def distance_euclidean(spark, sf_dir):
    return _distance(spark, sf_dir, "euclidean")


def distance_euclidean2(spark, sf_dir):
    return _distance(spark, sf_dir, "squared")


def distance_cosine(spark, sf_dir):
    return _distance(spark, sf_dir, "cosine")


def distance_summed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return T.distance_to_group(e, "label", "embedding").select("vec_id", r6("d", "d"))


def _ordered(spark, sf_dir):
    return T.ordered(trajectories(spark, sf_dir), "user_id", ["t_us", "event_id"])


def time_coherence_counts(spark, sf_dir):
    found = T.band_counts(_ordered(spark, sf_dir), "user_id", "t_us", HOURS6)
    return found.select("user_id", "event_id", *(F.col(c).cast("long").alias(c) for c in ("lo", "hi", "n")))


def positives_band_join(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return T.band_join(t, t, "user_id", "t_us", "event_id", HOURS6)


def negatives_complement_sample(spark, sf_dir):
    found = T.band_counts(_ordered(spark, sf_dir), "user_id", "t_us", HOURS6)
    drawn = T.complement_sample(found, F.col("lo"), F.col("hi"), F.col("n"), 2, 42, ["user_id", "event_id"])
    return drawn.select("user_id", "event_id", *(F.col(c).cast("long").alias(c) for c in ("draw_no", "neg_ord")))


def _triplets(spark, sf_dir):
    return T.time_triplets(trajectories(spark, sf_dir), "user_id", "t_us", "event_id", HOURS6, 2, 2, 42)


def triplet_map(spark, sf_dir):
    pairs = _triplets(spark, sf_dir).select("user_id", "event_id", F.posexplode(F.arrays_zip("pos", "neg")).alias("k", "x"))
    return pairs.select("user_id", "event_id", F.col("k").cast("long").alias("k"), "x.pos", "x.neg")


def row_window_pos(spark, sf_dir):
    found = T.row_window(_ordered(spark, sf_dir), "user_id", 3)
    return found.select("user_id", F.col("ord").cast("long").alias("ord"), F.col("pos_ord").cast("long").alias("pos_ord"))


def endpoint_trim(spark, sf_dir):
    return T.trim_ends(_ordered(spark, sf_dir), 6).select("user_id", F.col("ord").cast("long").alias("ord"))


def min_count_filter(spark, sf_dir):
    found = T.band_counts(_ordered(spark, sf_dir), "user_id", "t_us", HOURS6)
    counted = found.withColumn("pos_n", F.col("hi") - F.col("lo") - 1).withColumn("neg_n", F.col("n") - F.col("hi") + F.col("lo"))
    return T.enough(counted, 2, 2).select("user_id", "event_id", F.col("pos_n").cast("long").alias("pos_n"), F.col("neg_n").cast("long").alias("neg_n"))


def _valued(spark, sf_dir):
    t, v = triplet_map(spark, sf_dir), trajectories(spark, sf_dir)
    at = lambda k: v.select(F.col("event_id").alias(k), F.col("value").alias(f"v_{k}"))
    return t.join(at("event_id"), "event_id").join(at("pos"), "pos").join(at("neg"), "neg")


def triplet_loss(spark, sf_dir):
    d = lambda k: F.abs(F.col("v_event_id") - F.col(f"v_{k}"))
    return _valued(spark, sf_dir).agg(r6(T.triplet_loss(d("pos"), d("neg"), 1.0), "loss"), F.count("*").alias("n"))


def contrastive_loss(spark, sf_dir):
    rows = R.contrastive_labels(_valued(spark, sf_dir), "event_id", 0.5, 9)
    d = F.when(F.col("y") == 1, F.abs(F.col("v_event_id") - F.col("v_pos"))).otherwise(F.abs(F.col("v_event_id") - F.col("v_neg")))
    return rows.agg(r6(T.contrastive_loss(F.col("y"), d, 1.0), "loss"), F.sum("y").alias("positives"))


def verify_spatial_ordering(spark, sf_dir):
    """Anchors whose positives are, on average, not nearer in time than their negatives: none."""
    t, v = triplet_map(spark, sf_dir), trajectories(spark, sf_dir)
    at = lambda k: v.select(F.col("event_id").alias(k), F.col("t_us").alias(f"t_{k}"))
    from ..operators.checks import ordering_violations

    rows = t.join(at("event_id"), "event_id").join(at("pos"), "pos").join(at("neg"), "neg")
    return ordering_violations(rows, "event_id", F.abs(F.col("t_event_id") - F.col("t_pos")), F.abs(F.col("t_event_id") - F.col("t_neg")))


def global_time_index(spark, sf_dir):
    return R.global_index(trajectories(spark, sf_dir).select("event_id", "t_us"), ["t_us", "event_id"]).select("event_id", F.col("gidx").cast("long").alias("gidx"))


def seeded_split(spark, sf_dir):
    return R.seeded_split(charts(spark, sf_dir).select("vec_id"), "vec_id", (0.7, 0.15), 27).select("vec_id", "split")


def down_sample(spark, sf_dir):
    return R.down_sample(charts(spark, sf_dir).select("vec_id"), "vec_id", 0.35, 3)


def coverage_circle(spark, sf_dir):
    return G.coverage(charts(spark, sf_dir), sites(spark), "vec_id").groupBy(F.col("bs_id").cast("long").alias("bs_id")).agg(F.count("*").alias("n"))


def coverage_ring(spark, sf_dir):
    return G.coverage(charts(spark, sf_dir), sites(spark), "vec_id", r_min=0.08).select(F.col("bs_id").cast("long").alias("bs_id"), "vec_id")


def coverage_radius(spark, sf_dir):
    return G.coverage_radius(charts(spark, sf_dir), 0.2).select(r6("radius", "radius"))


def height_band(spark, sf_dir):
    return G.height_band(charts(spark, sf_dir), "u3", -0.1, 0.12).select("vec_id")


def union_mask(spark, sf_dir):
    c = charts(spark, sf_dir)
    return G.covered_by_any(c, G.coverage(c, sites(spark), "vec_id"), "vec_id").select("vec_id")


def _split(spark, sf_dir):
    return R.seeded_split(charts(spark, sf_dir).select("vec_id"), "vec_id", (0.7, 0.15), 27).where("split = 'train'")


def local_datasets(spark, sf_dir):
    covered = G.coverage(charts(spark, sf_dir), sites(spark), "vec_id")
    return S.local_sets(_split(spark, sf_dir), covered, "vec_id").select(F.col("bs_id").cast("long").alias("bs_id"), "vec_id")


def shared_datasets(spark, sf_dir):
    covered = G.coverage(charts(spark, sf_dir), sites(spark), "vec_id")
    found = S.shared_keys(covered, S.valid_pairs(site_pairs(spark), 4), "vec_id")
    return found.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "vec_id")


CENTRES = [(0, -0.1, -0.1), (1, 0.0, 0.1), (2, 0.1, -0.05)]


def _centres(spark):
    return spark.createDataFrame(CENTRES, "cluster int, cx double, cy double")


def kmeans_assign_step(spark, sf_dir):
    return S.assign(charts(spark, sf_dir), _centres(spark)).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


def kmeans_rank(spark, sf_dir):
    found = S.ranked(S.lloyd(charts(spark, sf_dir), _centres(spark), 2))
    return found.select(F.col("cluster").cast("long").alias("cluster"), r6("cx", "cx"), r6("cy", "cy"), F.col("rank").cast("long").alias("rank"))


def spatial_rank_policy(spark, sf_dir):
    """Points of each site by the rule for four single sites; ranks from the first assignment."""
    by = S.ranked(_centres(spark)).select("cluster", "rank")
    points = S.assign(charts(spark, sf_dir), _centres(spark)).join(F.broadcast(by), "cluster")
    return S.by_policy(points, spark, 4, "vec_id").select(F.col("bs_id").cast("long").alias("bs_id"), "vec_id")


def spatial_pair_policy(spark, sf_dir):
    by = S.ranked(_centres(spark)).select("cluster", "rank")
    points = S.assign(charts(spark, sf_dir), _centres(spark)).join(F.broadcast(by), "cluster")
    return S.pairs_by_policy(points, spark, 4, "vec_id").groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.count("*").alias("n"))


def ellipse_filter(spark, sf_dir):
    return G.in_ellipse(charts(spark, sf_dir), 0.01, -0.02, 0.15, 0.1).select("vec_id")


def inscribed_ellipse(spark, sf_dir):
    cx, cy, a, b = G.inscribed_ellipse(charts(spark, sf_dir), sites(spark).withColumn("radius", F.col("radius") * 2))
    return spark.createDataFrame([(round(cx, 6), round(cy, 6), round(a, 6), round(b, 6))], "cx double, cy double, a double, b double")


def outside_hulls(spark, sf_dir):
    return G.outside_hulls(charts(spark, sf_dir), hulls(spark), "vec_id").select("vec_id")


def convex_hull(spark, sf_dir):
    """The sides of the hull of each label's points, as half-planes a x + b y + c <= 0 with normals of length 1."""
    planes = G.convex_hulls(charts(spark, sf_dir).select("label", "x", "y"), "label")
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return planes.select(F.col("label").cast("long").alias("label"), *(r6(F.col(k) / size, k) for k in "abc"))


def streets_within(spark, sf_dir):
    """Outside points nearer than 0.03 to a point inside the building."""
    c = charts(spark, sf_dir)
    outside = G.outside_hulls(c, hulls(spark), "vec_id")
    inside = c.join(outside.select("vec_id"), "vec_id", "left_anti")
    return G.near_any(outside, inside, 0.03, "vec_id").select("vec_id")


def _segments(spark, sf_dir):
    return charts(spark, sf_dir).select("vec_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("u0").alias("x1"), F.col("v0").alias("y1"))


def segment_crosses_hull(spark, sf_dir):
    return G.segments_crossing(_segments(spark, sf_dir), hulls(spark), "vec_id")


def snap_nearest(spark, sf_dir):
    """The nearest position to each point of the first chart."""
    c = charts(spark, sf_dir)
    found = G.snap(c.select(F.col("vec_id").alias("q"), F.col("u0").alias("x"), F.col("v0").alias("y")), c.select("vec_id", "x", "y"), "q", "vec_id", 0.02)
    return found.select("q", "vec_id", r6("d2", "d2"))


def typical_step(spark, sf_dir):
    return G.typical_step(charts(spark, sf_dir), "vec_id", 0.1).select(r6("step", "step"))


REACH = 0.03


def neighbor_graph(spark, sf_dir):
    return N.neighbour_graph(charts(spark, sf_dir), "vec_id", REACH, hulls(spark))


def bfs_layers(spark, sf_dir):
    points = charts(spark, sf_dir)
    found = near_layers(points, "vec_id", Near(REACH, hulls(spark)), points.select(F.col("vec_id").alias("start")), 4)
    return found.select("start", "node", F.col("hops").cast("long").alias("hops"))


def graph_diameter_est(spark, sf_dir):
    found = N.diameter_estimate(Near(0.05), charts(spark, sf_dir), "vec_id")
    return spark.createDataFrame([(found, N.negative_hops(500, found))], "diameter long, neg_hops long")


def coherent_pos_neg(spark, sf_dir):
    points = charts(spark, sf_dir)
    return N.coherent_samples(Near(REACH, hulls(spark)), points.select(F.col("vec_id").alias("start")), 2, 3, points, "vec_id")


def trajectory_walks(spark, sf_dir):
    c = charts(spark, sf_dir)
    walkers = c.select(F.col("vec_id").alias("walker"), F.col("vec_id").alias("node"))
    return N.graph_walks(Near(0.05), c, walkers, "vec_id", 5, 11)


def trajectory_paths(spark, sf_dir):
    """Free paths of three kinds, snapped to positions."""
    c = charts(spark, sf_dir)
    box = [(k, -0.2, -0.2, 0.2, 0.2, 12) for k in range(8)]
    users = spark.createDataFrame(box, "user_id long, x0 double, y0 double, x1 double, y1 double, length int")
    out = None
    for kind in ("linear", "circular", "random"):
        path = N.path_points(users, kind, 27).withColumn("q", F.concat_ws(":", F.lit(kind), "user_id", "t"))
        snapped = G.snap(path, c.select("vec_id", "x", "y"), "q", "vec_id", 0.05)
        part = path.join(snapped, "q").select(F.lit(kind).alias("kind"), "user_id", "t", "vec_id")
        out = part if out is None else out.unionByName(part)
    return out


def histogram2d_density(spark, sf_dir):
    found = G.histogram2d(charts(spark, sf_dir), (-0.2, -0.2), (0.2, 0.2), 8)
    return found.select(F.col("bx").cast("long").alias("bx"), F.col("by_").cast("long").alias("by_"), "n")


def blurred_density(spark, sf_dir):
    found = G.blur(G.histogram2d(charts(spark, sf_dir), (-0.2, -0.2), (0.2, 0.2), 8), 8, 1.0, 1)
    return found.select(F.col("bx").cast("long").alias("bx"), F.col("by_").cast("long").alias("by_"), r6("density", "density"))


def bridge_density(spark, sf_dir):
    """A tube from each site to the nearest point that it covers, on a raster."""
    from functools import reduce

    c = charts(spark, sf_dir).select("vec_id", "x", "y")
    covered = G.coverage(c, sites(spark), "vec_id").join(c, "vec_id")
    lines = [G.bridges(sites(spark).where(F.col("bs_id") == s[0]), covered.where(F.col("bs_id") == s[0]), "vec_id", 0.05) for s in SITES]
    found = G.tube(reduce(DataFrame.unionByName, lines), "bs_id", (-0.3, -0.3), (0.3, 0.3), 12, 0.03, 0.16)
    return found.select(*(F.col(k).cast("long").alias(k) for k in ("bs_id", "bx", "by_")), r6("density", "density"))


def virtual_site_features(spark, sf_dir):
    """Sites 0 and 1, and 3 and 2, as one site each: features of every site's own antenna, in the group's order; points that a member does not cover are left out."""
    c = snapshots(spark, sf_dir).join(G.coverage(charts(spark, sf_dir), sites(spark), "vec_id"), "vec_id")
    own = F.element_at(F.array(*(V.features(V.antennas(F.col("csi"), a, 1, SUBCARRIERS), "chunks", 1, SUBCARRIERS, chunk=4, lags=LAGS) for a in range(ANTENNAS))), F.col("bs_id") + 1)
    groups = spark.createDataFrame(VIRTUAL, "group_id int, place int, bs_id int")
    whole = S.virtual_sites(c.select("bs_id", "vec_id", own.alias("x")), groups, "vec_id")
    return _long(whole, "x", "group_id", "vec_id").select(F.col("group_id").cast("long").alias("group_id"), "vec_id", F.col("pos").cast("long").alias("pos"), r6("v", "v"))


def gradient_colour(spark, sf_dir):
    return G.gradient_colour(charts(spark, sf_dir)).select("vec_id", r6("colour", "colour"))


def path_length(spark, sf_dir):
    found = G.path_lengths(charts(spark, sf_dir), "label", "vec_id")
    return found.select(F.col("label").cast("long").alias("label"), "vec_id", r6("path", "path"), r6("origin", "origin"))


QUERIES = {
    f.__name__: f
    for f in (
        csi_slice_group, fftshift, calibration_phase, chunk_average_features, autocorr_features, distance_euclidean, distance_euclidean2,
        distance_cosine, distance_summed, time_coherence_counts, positives_band_join, negatives_complement_sample, triplet_map, row_window_pos,
        endpoint_trim, min_count_filter, triplet_loss, contrastive_loss, verify_spatial_ordering, global_time_index, seeded_split, down_sample,
        coverage_circle, coverage_ring, coverage_radius, height_band, union_mask, local_datasets, shared_datasets, kmeans_assign_step, kmeans_rank,
        spatial_rank_policy, spatial_pair_policy, ellipse_filter, inscribed_ellipse, outside_hulls, convex_hull, streets_within,
        segment_crosses_hull, snap_nearest, typical_step, neighbor_graph, bfs_layers, graph_diameter_est, coherent_pos_neg, trajectory_walks,
        trajectory_paths, bridge_density, virtual_site_features, histogram2d_density, blurred_density, gradient_colour, path_length,
    )
}

_SHIFTED = ", shifted AS (SELECT vec_id, antenna, (f + 4) % 8 AS f, re, im FROM csi)"
_PI2 = repr(2 * math.pi)
_LIST = lambda v: "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in v) + "]"
_BANDED = f""", banded AS (SELECT *, min(ord) OVER w AS lo, max(ord) OVER w + 1 AS hi, count(*) OVER (PARTITION BY user_id) AS n
  FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {HOURS6} PRECEDING AND {HOURS6} FOLLOWING))"""
_NEG = """, drawn AS (SELECT user_id, event_id, d AS draw_no, CASE WHEN r < lo THEN r ELSE r + hi - lo END AS neg_ord FROM (
  SELECT *, CASE WHEN d = 1 THEN r1 WHEN h2 %% m = r1 THEN m - 1 ELSE h2 %% m END AS r FROM (SELECT *, h1 %% (m - least(2, m) + 1) AS r1 FROM (
    SELECT *, n - hi + lo AS m, CAST('0x' || substr(md5('%d:' || user_id || ':' || event_id || ':1'), 1, 12) AS BIGINT) AS h1,
           CAST('0x' || substr(md5('%d:' || user_id || ':' || event_id || ':2'), 1, 12) AS BIGINT) AS h2 FROM banded) WHERE m > 0 %s),
  (SELECT unnest([1, 2]) AS d) WHERE d <= m))"""
_PAIRS_BAND = f"SELECT a.user_id, a.event_id, b.event_id AS other FROM traj a JOIN traj b ON a.user_id = b.user_id AND abs(a.t_us - b.t_us) <= {HOURS6} AND a.event_id <> b.event_id"
_TRIPLETS = _BANDED + _NEG % (43, 43, "AND hi - lo - 1 >= 2 AND n - hi + lo >= 2") + f""", near AS (SELECT * FROM (
  SELECT p.user_id, p.event_id, other, row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY md5('42:' || p.user_id || ':' || p.event_id || ':' || other), other) AS draw_no
  FROM ({_PAIRS_BAND}) p JOIN banded b ON b.event_id = p.event_id WHERE hi - lo - 1 >= 2 AND n - hi + lo >= 2) WHERE draw_no <= 2),
triplets AS (SELECT near.user_id, near.event_id, near.draw_no - 1 AS k, near.other AS pos, t.event_id AS neg
  FROM near JOIN drawn ON drawn.user_id = near.user_id AND drawn.event_id = near.event_id AND drawn.draw_no = near.draw_no
  JOIN traj t ON t.user_id = near.user_id AND t.ord = neg_ord)"""
_VALUED = _TRIPLETS + ", valued AS (SELECT t.*, a.value AS va, b.value AS vp, c.value AS vn, a.t_us AS ta, b.t_us AS tp, c.t_us AS tn FROM triplets t JOIN traj a ON a.event_id = t.event_id JOIN traj b ON b.event_id = t.pos JOIN traj c ON c.event_id = t.neg)"
_SPLIT = ", split AS (SELECT vec_id, CASE WHEN r < CAST(floor(0.7 * n) AS BIGINT) THEN 'train' WHEN r < CAST(floor(0.7 * n) AS BIGINT) + CAST(floor(0.15 * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('27:' || vec_id), vec_id) - 1 AS r, count(*) OVER () AS n FROM charts))"
_C = ", centres AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for k, x, y in CENTRES) + ") AS t(cluster, cx, cy))"


def _assign(name: str, centres: str) -> str:
    return f", {name} AS (SELECT vec_id, x, y, arg_min(cluster, (d2, cluster)) AS cluster FROM (SELECT vec_id, x, y, cluster, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM charts, {centres}) GROUP BY vec_id, x, y)"


def _moved(name: str, assigned: str, centres: str) -> str:
    return f", {name} AS (SELECT cluster, coalesce(mx, cx) AS cx, coalesce(my, cy) AS cy FROM {centres} LEFT JOIN (SELECT cluster, avg(x) AS mx, avg(y) AS my FROM {assigned} GROUP BY cluster) USING (cluster))"


_RANKED = _C + _assign("a0", "centres") + ", ranked AS (SELECT cluster, row_number() OVER (ORDER BY cx - 0.852 * cy, cluster) - 1 AS rank FROM centres), placed AS (SELECT vec_id, rank FROM a0 JOIN ranked USING (cluster))"
_INSIDE = ", inside AS (SELECT vec_id, x, y FROM charts, hulls GROUP BY vec_id, x, y HAVING bool_and(a * x + b * y + c <= 0))"
_SEG = lambda source, key: f"SELECT DISTINCT {key} FROM (SELECT {key}, hull_id, greatest(max(CASE WHEN u < -1e-10 THEN -s / u ELSE 0 END), 0) AS enter, least(min(CASE WHEN u > 1e-10 THEN -s / u ELSE 1 END), 1) AS leave, max(CASE WHEN abs(u) <= 1e-10 AND s > 1e-10 THEN 1 ELSE 0 END) AS outside FROM (SELECT {key}, hull_id, a * x0 + b * y0 + c AS s, a * (x1 - x0) + b * (y1 - y0) AS u FROM {source}, hulls) GROUP BY {key}, hull_id) WHERE enter <= leave AND outside = 0"
_GRAPH = f""", cand AS (SELECT p.vec_id AS src, q.vec_id AS dst, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM charts p JOIN charts q ON p.vec_id < q.vec_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {REACH} * {REACH}),
blocked AS ({_SEG('cand', 'src, dst')}), clear AS (SELECT src, dst FROM cand ANTI JOIN blocked USING (src, dst)), graph AS (SELECT src, dst FROM clear UNION ALL SELECT dst, src FROM clear)"""


def _bfs(depth: int) -> str:
    return f""", walk AS (SELECT vec_id AS start, vec_id AS node, 0 AS hops FROM charts UNION SELECT start, dst, hops + 1 FROM walk JOIN graph ON src = node WHERE hops < {depth}),
layers AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY start, node)"""


_HIST = ", hist AS (SELECT least(floor((x + 0.2) / 0.05), 7)::BIGINT AS bx, least(floor((y + 0.2) / 0.05), 7)::BIGINT AS by_, count(*) AS n FROM charts WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 GROUP BY 1, 2)"
_E1 = math.exp(-0.5)
_KERNEL = f", kernel AS (SELECT * FROM (VALUES (-1, {_E1 / (1 + 2 * _E1)!r}), (0, {1 / (1 + 2 * _E1)!r}), (1, {_E1 / (1 + 2 * _E1)!r})) AS t(k, w))"
_DIST = "SELECT a.vec_id AS anchor, b.vec_id AS other, round({}, 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 3"
_DOT = lambda p, q: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_SQ = lambda p, q: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"

ORACLES = {
    "bridge_density": SQL_VIEWS + """, near AS (SELECT bs_id, cx, cy, arg_min(x, (d2, vec_id)) AS x1, arg_min(y, (d2, vec_id)) AS y1 FROM (SELECT *, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM coverage JOIN bs USING (bs_id) JOIN charts USING (vec_id)) GROUP BY bs_id, cx, cy),
      grid AS (SELECT *, x1 - cx AS ex, y1 - cy AS ey, -0.3 + (bx + 0.5) * 0.05 - cx AS vx, -0.3 + (by_ + 0.5) * 0.05 - cy AS vy FROM near, (SELECT unnest(range(12)) AS bx), (SELECT unnest(range(12)) AS by_)),
      cut AS (SELECT *, least(greatest((vx * ex + vy * ey) / (ex * ex + ey * ey), 0), 1) AS t FROM grid)
      SELECT CAST(bs_id AS BIGINT) AS bs_id, bx, by_, round(0.16 * exp(-((vx - t * ex) * (vx - t * ex) + (vy - t * ey) * (vy - t * ey)) / (2 * 0.03 * 0.03)), 6) AS density FROM cut""",
    "virtual_site_features": SQL_VIEWS + f""", groups AS (SELECT * FROM (VALUES {', '.join(map(str, VIRTUAL))}) AS t(group_id, place, bs_id)),
      own AS (SELECT csi.vec_id, bs_id, f, re, im FROM csi JOIN coverage ON coverage.vec_id = csi.vec_id AND bs_id = antenna),
      scale AS (SELECT vec_id, bs_id, sqrt(sum(re * re + im * im) / 8) + 1e-12 AS s FROM own GROUP BY vec_id, bs_id),
      m AS (SELECT vec_id, bs_id, f // 4 AS c, sum(re) / 4 AS re, sum(im) / 4 AS im FROM own GROUP BY 1, 2, 3),
      whole AS (SELECT group_id, vec_id FROM coverage JOIN groups USING (bs_id) GROUP BY group_id, vec_id HAVING count(*) = 2)
      SELECT CAST(group_id AS BIGINT) AS group_id, vec_id, CAST(4 * place + 2 * c + part AS BIGINT) AS pos, round((CASE part WHEN 0 THEN re ELSE im END) / s, 6) AS v
      FROM m JOIN scale USING (vec_id, bs_id) JOIN groups USING (bs_id) JOIN whole USING (group_id, vec_id), (SELECT unnest([0, 1]) AS part)""",
    "graph_diameter_est": SQL_VIEWS + """, link AS (SELECT p.vec_id AS src, q.vec_id AS dst FROM charts p JOIN charts q ON p.vec_id <> q.vec_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.05 * 0.05),
      starts AS (SELECT vec_id FROM charts ORDER BY md5('7:' || vec_id), vec_id LIMIT 50),
      walk AS (SELECT vec_id AS start, vec_id AS node, 0 AS hops FROM starts UNION SELECT start, dst, hops + 1 FROM walk JOIN link ON src = node WHERE hops < 40),
      deep AS (SELECT max(hops) AS d FROM (SELECT min(hops) AS hops FROM walk GROUP BY start, node))
      SELECT CAST(d AS BIGINT) AS diameter, CAST(CASE WHEN 500 <= d THEN 500 ELSE greatest(1, floor(0.8 * d)) END AS BIGINT) AS neg_hops FROM deep""",
    "csi_slice_group": SQL_VIEWS + "SELECT vec_id, CAST((antenna - 1) * 8 + f AS BIGINT) AS pos, round(re, 6) AS re, round(im, 6) AS im FROM csi WHERE antenna IN (1, 2)",
    "fftshift": SQL_VIEWS + _SHIFTED + "SELECT vec_id, CAST(antenna * 8 + f AS BIGINT) AS pos, round(re, 6) AS re, round(im, 6) AS im FROM shifted",
    "calibration_phase": SQL_VIEWS + _SHIFTED + f", ph AS (SELECT *, {_LIST(STO)}[antenna + 1] * {_PI2} * f / 8 + {_LIST(CPO)}[antenna + 1] AS p FROM shifted) SELECT vec_id, CAST(antenna * 8 + f AS BIGINT) AS pos, round(re * cos(p) - im * sin(p), 6) AS re, round(re * sin(p) + im * cos(p), 6) AS im FROM ph",
    "chunk_average_features": SQL_VIEWS + ", scale AS (SELECT vec_id, sqrt(sum(re * re + im * im) / 32) + 1e-12 AS s FROM csi GROUP BY vec_id), m AS (SELECT vec_id, (antenna * 8 + f) // 4 AS c, sum(re) / 4 AS re, sum(im) / 4 AS im FROM csi GROUP BY 1, 2) SELECT vec_id, CAST(2 * c + part AS BIGINT) AS pos, round((CASE part WHEN 0 THEN re ELSE im END) / s, 6) AS v FROM m JOIN scale USING (vec_id), (SELECT unnest([0, 1]) AS part)",
    "autocorr_features": SQL_VIEWS + f""", beams AS (SELECT vec_id, b, f, sum(re * cos({_PI2} * antenna * b / 4) + im * sin({_PI2} * antenna * b / 4)) AS re, sum(im * cos({_PI2} * antenna * b / 4) - re * sin({_PI2} * antenna * b / 4)) AS im FROM csi, (SELECT unnest([0, 1, 2, 3]) AS b) GROUP BY vec_id, b, f),
      corr AS (SELECT p.vec_id, p.b, lag, sum(p.re * q.re + p.im * q.im) / (8 - lag) AS re, sum(p.im * q.re - p.re * q.im) / (8 - lag) AS im FROM beams p, (SELECT unnest([0, 2, 4]) AS lag), beams q WHERE q.vec_id = p.vec_id AND q.b = p.b AND q.f = p.f + lag GROUP BY p.vec_id, p.b, lag)
      SELECT vec_id, CAST(b * 3 + lag // 2 AS BIGINT) AS pos, round(ln(sqrt(re * re + im * im) + 1e-12), 6) AS v FROM corr""",
    "distance_euclidean": _DIST.format(f"sqrt({_SQ('a.embedding', 'b.embedding')})"),
    "distance_euclidean2": _DIST.format(_SQ("a.embedding", "b.embedding")),
    "distance_cosine": _DIST.format(f"1 - {_DOT('a.embedding', 'b.embedding')} / (sqrt({_DOT('a.embedding', 'a.embedding')}) * sqrt({_DOT('b.embedding', 'b.embedding')}))"),
    "distance_summed": f"SELECT a.vec_id, round(sum({_SQ('a.embedding', 'b.embedding')}), 6) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.vec_id",
    "time_coherence_counts": SQL_VIEWS + _BANDED + "SELECT user_id, event_id, lo, hi, n FROM banded",
    "positives_band_join": SQL_VIEWS + _PAIRS_BAND,
    "negatives_complement_sample": SQL_VIEWS + _BANDED + _NEG % (42, 42, "") + "SELECT user_id, event_id, CAST(draw_no AS BIGINT) AS draw_no, neg_ord FROM drawn",
    "triplet_map": SQL_VIEWS + _TRIPLETS + "SELECT * FROM triplets",
    "row_window_pos": SQL_VIEWS + "SELECT a.user_id, a.ord, b.ord AS pos_ord FROM traj a JOIN traj b ON a.user_id = b.user_id AND abs(a.ord - b.ord) BETWEEN 1 AND 3",
    "endpoint_trim": SQL_VIEWS + "SELECT user_id, ord FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM traj) WHERE ord >= 6 AND ord < n - 6",
    "min_count_filter": SQL_VIEWS + _BANDED + "SELECT user_id, event_id, hi - lo - 1 AS pos_n, n - hi + lo AS neg_n FROM banded WHERE hi - lo - 1 >= 2 AND n - hi + lo >= 2",
    "triplet_loss": SQL_VIEWS + _VALUED + "SELECT round(avg(greatest(0, abs(va - vp) - abs(va - vn) + 1)), 6) AS loss, count(*) AS n FROM valued",
    "contrastive_loss": SQL_VIEWS + _VALUED + ", y AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('9:' || event_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN 1 ELSE 0 END AS y FROM valued) SELECT round(avg(CASE y WHEN 1 THEN (va - vp) * (va - vp) ELSE greatest(0, 1 - abs(va - vn)) * greatest(0, 1 - abs(va - vn)) END), 6) AS loss, CAST(sum(y) AS BIGINT) AS positives FROM y",
    "verify_spatial_ordering": SQL_VIEWS + _VALUED + "SELECT count(*) AS anchors, CAST(coalesce(sum(CASE WHEN p < n THEN 0 ELSE 1 END), 0) AS BIGINT) AS violations FROM (SELECT event_id, avg(abs(ta - tp)) AS p, avg(abs(ta - tn)) AS n FROM valued GROUP BY event_id)",
    "global_time_index": SQL_VIEWS + "SELECT event_id, row_number() OVER (ORDER BY t_us, event_id) - 1 AS gidx FROM traj",
    "seeded_split": SQL_VIEWS + _SPLIT + "SELECT vec_id, split FROM split",
    "down_sample": SQL_VIEWS + "SELECT vec_id FROM charts WHERE CAST('0x' || substr(md5('3:' || vec_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.35",
    "coverage_circle": SQL_VIEWS + "SELECT CAST(bs_id AS BIGINT) AS bs_id, count(*) AS n FROM coverage GROUP BY bs_id",
    "coverage_ring": SQL_VIEWS + "SELECT CAST(bs_id AS BIGINT) AS bs_id, vec_id FROM charts, bs WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) BETWEEN 0.08 * 0.08 AND radius * radius",
    "coverage_radius": SQL_VIEWS + "SELECT round(0.2 * least(max(x) - min(x), max(y) - min(y)), 6) AS radius FROM charts",
    "height_band": SQL_VIEWS + "SELECT vec_id FROM charts WHERE u3 BETWEEN -0.1 AND 0.12",
    "union_mask": SQL_VIEWS + "SELECT vec_id FROM charts SEMI JOIN coverage USING (vec_id)",
    "local_datasets": SQL_VIEWS + _SPLIT + "SELECT CAST(bs_id AS BIGINT) AS bs_id, vec_id FROM coverage JOIN split USING (vec_id) WHERE split = 'train'",
    "shared_datasets": SQL_VIEWS + "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, vec_id FROM shared",
    "kmeans_assign_step": SQL_VIEWS + _C + _assign("a0", "centres") + "SELECT vec_id, CAST(cluster AS BIGINT) AS cluster FROM a0",
    "kmeans_rank": SQL_VIEWS + _C + _assign("a0", "centres") + _moved("c1", "a0", "centres") + _assign("a1", "c1") + _moved("c2", "a1", "c1") + "SELECT CAST(cluster AS BIGINT) AS cluster, round(cx, 6) AS cx, round(cy, 6) AS cy, row_number() OVER (ORDER BY cx - 0.852 * cy, cluster) - 1 AS rank FROM c2",
    "spatial_rank_policy": SQL_VIEWS + _RANKED + "SELECT CAST(s AS BIGINT) AS bs_id, vec_id FROM placed, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE CASE WHEN s % 2 = 1 THEN rank IN (0, 1) ELSE rank IN (1, 2) END",
    "spatial_pair_policy": SQL_VIEWS + _RANKED + "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, count(*) AS n FROM placed, edges WHERE CASE WHEN i % 2 = j % 2 THEN CASE WHEN i % 2 = 1 THEN rank IN (0, 1) ELSE rank IN (1, 2) END ELSE rank = 1 END GROUP BY i, j",
    "ellipse_filter": SQL_VIEWS + "SELECT vec_id FROM charts WHERE ((x - 0.01) / 0.15) * ((x - 0.01) / 0.15) + ((y - -0.02) / 0.1) * ((y - -0.02) / 0.1) <= 1",
    "outside_hulls": SQL_VIEWS + _INSIDE + "SELECT vec_id FROM charts ANTI JOIN inside USING (vec_id)",
    "convex_hull": SQL_VIEWS + ", side AS (SELECT p.label, p.x AS px, p.y AS py, q.y - p.y AS a, p.x - q.x AS b FROM charts p JOIN charts q ON p.label = q.label AND p.vec_id <> q.vec_id), hull AS (SELECT label, px, py, a, b, sqrt(a * a + b * b) AS size FROM side WHERE NOT EXISTS (SELECT 1 FROM charts r WHERE r.label = side.label AND side.a * (r.x - side.px) + side.b * (r.y - side.py) > 1e-15)) SELECT CAST(label AS BIGINT) AS label, round(a / size, 6) AS a, round(b / size, 6) AS b, round(-(a * px + b * py) / size, 6) AS c FROM hull",
    "streets_within": SQL_VIEWS + _INSIDE + "SELECT DISTINCT p.vec_id FROM charts p ANTI JOIN inside USING (vec_id) JOIN inside q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < 0.03 * 0.03",
    "segment_crosses_hull": SQL_VIEWS + ", seg AS (SELECT vec_id, x AS x0, y AS y0, u0 AS x1, v0 AS y1 FROM charts) " + _SEG("seg", "vec_id"),
    "snap_nearest": SQL_VIEWS + "SELECT q, vec_id, round(d2, 6) AS d2 FROM (SELECT p.vec_id AS q, c.vec_id, (p.u0 - c.x) * (p.u0 - c.x) + (p.v0 - c.y) * (p.v0 - c.y) AS d2, row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.u0 - c.x) * (p.u0 - c.x) + (p.v0 - c.y) * (p.v0 - c.y), c.vec_id) AS r FROM charts p, charts c) WHERE r = 1",
    "typical_step": SQL_VIEWS + "SELECT round(median(d), 6) AS step FROM (SELECT sqrt(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS d FROM (SELECT * FROM charts ORDER BY vec_id LIMIT 500) p JOIN charts q ON p.vec_id <> q.vec_id WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.01 GROUP BY p.vec_id)",
    "neighbor_graph": SQL_VIEWS + _GRAPH + "SELECT src, dst FROM graph",
    "bfs_layers": SQL_VIEWS + _GRAPH + _bfs(4) + "SELECT start, node, CAST(hops AS BIGINT) AS hops FROM layers",
    "coherent_pos_neg": SQL_VIEWS + _GRAPH + _bfs(3) + "SELECT start, node, CASE WHEN hops = 3 THEN 'neg' ELSE 'pos' END AS kind FROM layers WHERE hops BETWEEN 1 AND 3",
    "histogram2d_density": SQL_VIEWS + _HIST + "SELECT * FROM hist",
    "blurred_density": SQL_VIEWS + _HIST + _KERNEL + ", b1 AS (SELECT bx + k AS bx, by_, sum(n * w) AS v FROM hist, kernel WHERE bx + k BETWEEN 0 AND 7 GROUP BY 1, 2), b2 AS (SELECT bx, by_ + k AS by_, sum(v * w) AS v FROM b1, kernel WHERE by_ + k BETWEEN 0 AND 7 GROUP BY 1, 2) SELECT bx, by_, round(v / (SELECT max(v) FROM b2), 6) AS density FROM b2",
    "gradient_colour": SQL_VIEWS + "SELECT vec_id, round(((x - x0) / (x1 - x0 + 1e-8) + (y - y0) / (y1 - y0 + 1e-8)) / 2, 6) AS colour FROM charts, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM charts)",
    "path_length": SQL_VIEWS + "SELECT CAST(label AS BIGINT) AS label, vec_id, round(sum(coalesce(s, 0)) OVER (PARTITION BY label ORDER BY vec_id), 6) AS path, round(sqrt(x * x + y * y), 6) AS origin FROM (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s FROM charts WINDOW w AS (PARTITION BY label ORDER BY vec_id))",
}
