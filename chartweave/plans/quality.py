"""Queries of chart quality and alignment, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import metrics as M
from .fixtures import SQL_VIEWS, charts, site_charts, site_pairs

POSITION, CHART = ["x", "y"], ["u0", "v0"]
#: The neighbourhood sizes of the evaluation, and the draws and points of its bootstrap.
GRID = list(range(2, 39, 4))
DRAWS = SAMPLE = 1000


def r6(c: str | F.Column, name: str):
    return F.round(c, 6).alias(name)


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sites import shared_sets

    return shared_sets(site_charts(spark, sf_dir), site_pairs(spark), "vec_id", ["z0", "z1"]).select("i", "j", "vec_id", *(F.col(f"{s}_z{k}").alias(f"{s}{k}") for s in "ab" for k in range(2)))


def continuity_k10(spark, sf_dir):
    return M.continuity(charts(spark, sf_dir), "vec_id", POSITION, CHART, [10]).select(F.col("k").cast("long").alias("k"), r6("score", "score"))


def trustworthiness_k10(spark, sf_dir):
    return M.trustworthiness(charts(spark, sf_dir), "vec_id", POSITION, CHART, [10]).select(F.col("k").cast("long").alias("k"), r6("score", "score"))


def ct_tw_all_k(spark, sf_dir):
    """Both metrics of every site's covered points for the whole grid of k."""
    points = site_charts(spark, sf_dir)
    ct = M.continuity(points, "vec_id", POSITION, ["z0", "z1"], GRID, ["bs_id"]).withColumn("metric", F.lit("CT"))
    tw = M.trustworthiness(points, "vec_id", POSITION, ["z0", "z1"], GRID, ["bs_id"]).withColumn("metric", F.lit("TW"))
    return ct.unionByName(tw).select("metric", F.col("bs_id").cast("long").alias("bs_id"), F.col("k").cast("long").alias("k"), r6("score", "score"))


def knn_k(spark, sf_dir):
    c = charts(spark, sf_dir)
    return M.nearest(c, "vec_id", POSITION, 5, c.count()).select("vec_id", "other", F.col("place").cast("long").alias("place"))


def rank_self_join(spark, sf_dir):
    c = charts(spark, sf_dir)
    n = c.count()
    pairs = M.nearest(c, "vec_id", POSITION, 3, n).select("vec_id", "other")
    return M.ranks(c, pairs, "vec_id", CHART, n).select("vec_id", "other", F.col("rank").cast("long").alias("rank"))


def kruskal_stress_full(spark, sf_dir):
    return M.kruskal(M.distance_sums(charts(spark, sf_dir), "vec_id", POSITION, CHART)).select(r6("stress", "stress"))


def kruskal_stress_single_agent_beta(spark, sf_dir):
    return M.kruskal(M.distance_sums(charts(spark, sf_dir), "vec_id", POSITION, CHART), best=False).select(r6("stress", "stress"))


def kruskal_stress_bootstrap(spark, sf_dir):
    """The mean stress of DRAWS samples of SAMPLE points, drawn with replacement."""
    found = M.kruskal_bootstrap(charts(spark, sf_dir), "vec_id", POSITION, CHART, DRAWS, SAMPLE, 42)
    return found.agg(F.count("*").alias("draws"), F.round(F.avg("stress"), 6).alias("stress"))


def kruskal_per_site(spark, sf_dir):
    sums = M.distance_sums(site_charts(spark, sf_dir), "vec_id", POSITION, ["z0", "z1"], ["bs_id"])
    return M.kruskal(sums, ["bs_id"]).select(F.col("bs_id").cast("long").alias("bs_id"), r6("stress", "stress"))


def _pairs(df, *columns):
    return df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *columns)


def foscttm_one_sided(spark, sf_dir):
    return _pairs(M.matching(shared(spark, sf_dir), two_sided=False), "n", r6("foscttm", "foscttm"))


def foscttm_two_sided(spark, sf_dir):
    return _pairs(M.matching(shared(spark, sf_dir)), "n", r6("foscttm", "foscttm"))


def cross_covariance_edges(spark, sf_dir):
    return _pairs(A.cross_covariance(shared(spark, sf_dir)), *(r6(f"c{p}{q}", f"c{p}{q}") for p in range(2) for q in range(2)), "n")


_O = ["o00", "o01", "o10", "o11"]


def procrustes_o2(spark, sf_dir):
    return _pairs(A.nearest_orthogonal(A.cross_covariance(shared(spark, sf_dir))), *(r6(o, o) for o in _O))


def kabsch_so2(spark, sf_dir):
    return _pairs(A.nearest_rotation(A.cross_covariance(shared(spark, sf_dir))), *(r6(o, o) for o in _O))


def procrustes_svd(spark, sf_dir):
    """The same maps by decomposition of d x d sums, the way for more dimensions; equal to the closed form."""
    c = A.cross_covariance(shared(spark, sf_dir))
    cells = F.explode(F.array(*(F.struct(F.lit(p).alias("r"), F.lit(q).alias("c"), F.col(f"c{p}{q}").alias("v")) for p in range(2) for q in range(2))))
    long = c.select("i", "j", cells.alias("x")).select("i", "j", "x.r", "x.c", "x.v")
    found = A.nearest_orthogonal_any(long, 2)
    wide = found.groupBy("i", "j").agg(*(F.max(F.when((F.col("r") == int(o[1])) & (F.col("c") == int(o[2])), F.col("v"))).alias(o) for o in _O))
    return _pairs(wide, *(r6(o, o) for o in _O))


def diag_map_closed_form(spark, sf_dir):
    return _pairs(A.diagonal_map(shared(spark, sf_dir)), r6("d0", "d0"), r6("d1", "d1"))


def cover_identity_loss(spark, sf_dir):
    return _pairs(A.alignment_loss(shared(spark, sf_dir)), r6("loss", "loss"))


def alignment_loss_bundle(spark, sf_dir):
    s = shared(spark, sf_dir)
    return _pairs(A.alignment_loss(A.map_with(s, A.nearest_orthogonal(A.cross_covariance(s)), "matrix")), r6("loss", "loss"))


def alignment_loss_diag(spark, sf_dir):
    s = shared(spark, sf_dir)
    return _pairs(A.alignment_loss(A.map_with(s, A.diagonal_map(s), "diagonal")), r6("loss", "loss"))


AFFINE = {"am00": 1.1, "am01": 0.2, "am10": -0.1, "am11": 0.9, "at0": 0.01, "at1": -0.02, "as0": 0.1, "as1": -0.1, "bm00": 0.8, "bm01": 0.0, "bm10": 0.3, "bm11": 1.2, "bt0": 0.0, "bt1": 0.03, "bs0": 0.05, "bs1": 0.2}


def alignment_loss_affine(spark, sf_dir):
    maps = site_pairs(spark).select("i", "j", *(F.lit(v).alias(k) for k, v in AFFINE.items()))
    return _pairs(A.alignment_loss(A.map_with(shared(spark, sf_dir), maps, "affine")), r6("loss", "loss"))


def _identity_frames(spark):
    return spark.createDataFrame([(k, 1.0, 0.0, 0.0, 1.0) for k in range(4)], "agent int, f00 double, f01 double, f10 double, f11 double")


def flat_frames(spark, sf_dir):
    found = A.frame_update(shared(spark, sf_dir), _identity_frames(spark))
    return found.select(F.col("agent").cast("long").alias("agent"), *(r6(f, f) for f in ("f00", "f01", "f10", "f11")))


def alignment_loss_flat(spark, sf_dir):
    s = shared(spark, sf_dir)
    return _pairs(A.alignment_loss(A.in_frames(s, A.frame_update(s, _identity_frames(spark)))), r6("loss", "loss"))


def foscttm_aligned(spark, sf_dir):
    """Matching after the bundle's maps."""
    s = shared(spark, sf_dir)
    return _pairs(M.matching(A.map_with(s, A.nearest_orthogonal(A.cross_covariance(s)), "matrix")), "n", r6("foscttm", "foscttm"))


def recovered_rotation(spark, sf_dir):
    """A chart and its turned, mirrored copy: the map is found and every point matches itself."""
    c = charts(spark, sf_dir)
    s = c.select(F.lit(0).alias("i"), F.lit(1).alias("j"), "vec_id", F.col("u0").alias("a0"), F.col("v0").alias("a1"), (0.6 * F.col("u0") + 0.8 * F.col("v0")).alias("b0"), (0.8 * F.col("u0") - 0.6 * F.col("v0")).alias("b1"))
    o = A.nearest_orthogonal(A.cross_covariance(s))
    loss = A.alignment_loss(A.map_with(s, o, "matrix"))
    return _pairs(o.join(loss, ["i", "j"]), *(r6(k, k) for k in _O), r6("loss", "loss"))


def _weights(spark, sf_dir):
    """Rows of embeddings as parameters of four agents: two layers of a weight and a bias."""
    c = charts(spark, sf_dir)
    key = F.element_at(F.array(*(F.lit(k) for k in ("l0.w", "l0.b", "l1.w", "l1.b"))), (F.col("vec_id") % 4 + 1).cast("int"))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.col(f"u{a}").alias("v")) for a in range(4))))
    return c.select(key.alias("key"), F.col("vec_id").alias("pos"), cells.alias("x")).select("x.agent", "key", "pos", "x.v")


def _params(df):
    return df.select(F.col("agent").cast("long").alias("agent"), "key", "pos", r6("v", "v"))


def fedavg_params(spark, sf_dir):
    return _params(A.averaged(_weights(spark, sf_dir), site_pairs(spark).where("i = 0 or j = 3")))


def partial_fedavg_params(spark, sf_dir):
    late = A.late_layers(["l0.w", "l0.b", "l1.w", "l1.b"], 0.5)
    return _params(A.averaged(_weights(spark, sf_dir), site_pairs(spark).where("i = 0 or j = 3"), late))


def alignment_report(spark, sf_dir):
    """The flagship: of every site pair the points shared, matching and loss before and after alignment, and the sites' quality."""
    s = shared(spark, sf_dir)
    aligned = A.map_with(s, A.nearest_orthogonal(A.cross_covariance(s)), "matrix")
    before = M.matching(s).join(A.alignment_loss(s), ["i", "j"]).select("i", "j", "n", F.col("foscttm").alias("foscttm_before"), F.col("loss").alias("loss_before"))
    after = M.matching(aligned).join(A.alignment_loss(aligned), ["i", "j"]).select("i", "j", F.col("foscttm").alias("foscttm_after"), F.col("loss").alias("loss_after"))
    stress = M.kruskal(M.distance_sums(site_charts(spark, sf_dir), "vec_id", POSITION, ["z0", "z1"], ["bs_id"]), ["bs_id"])
    mean = stress.agg(F.avg("stress").alias("stress"))
    joined = before.join(after, ["i", "j"]).join(F.broadcast(mean))
    names = ["foscttm_before", "foscttm_after", "loss_before", "loss_after", "stress"]
    return _pairs(joined, "n", *(r6(c, c) for c in names))


QUERIES = {
    f.__name__: f
    for f in (
        continuity_k10, trustworthiness_k10, ct_tw_all_k, knn_k, rank_self_join, kruskal_stress_full, kruskal_stress_single_agent_beta,
        kruskal_stress_bootstrap, kruskal_per_site, foscttm_one_sided, foscttm_two_sided, cross_covariance_edges, procrustes_o2, kabsch_so2,
        procrustes_svd, diag_map_closed_form, cover_identity_loss, alignment_loss_bundle, alignment_loss_diag, alignment_loss_affine,
        flat_frames, alignment_loss_flat, foscttm_aligned, recovered_rotation, fedavg_params, partial_fedavg_params, alignment_report,
    )
}


def _d(a: str, b: str, cols) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols)


def _neighbourhood_sql(source: str, by: str, near, ranked, grid, metric: str | None = None) -> str:
    """Continuity or trustworthiness as a self-join with two windows."""
    same = f"AND a.{by} = b.{by}" if by else ""
    part = f"{by}, " if by else ""
    head = f"'{metric}' AS metric, " if metric else ""
    cast = f"CAST(m.{by} AS BIGINT) AS {by}, " if by else ""
    pick = f"a.{by} AS {by}, " if by else ""
    return f"""SELECT {head}{cast}CAST(k AS BIGINT) AS k, round(avg_score, 6) AS score FROM (
      SELECT {part}k, CASE WHEN 2 * N - 3 * k - 1 > 0 THEN 1 - 2.0 / (k * (2 * N - 3 * k - 1)) * sum(greatest(r - k, 0)) / N END AS avg_score FROM (
        SELECT {part}vec_id, other, place, r, count(DISTINCT vec_id) OVER ({'PARTITION BY ' + by if by else ''}) AS N FROM (
          SELECT {pick}a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY {part and 'a.' + part}a.vec_id ORDER BY {_d('a', 'b', near)}, b.vec_id) AS place,
                 rank() OVER (PARTITION BY {part and 'a.' + part}a.vec_id ORDER BY {_d('a', 'b', ranked)}) AS r
          FROM {source} a JOIN {source} b ON a.vec_id <> b.vec_id {same})), (SELECT unnest({list(grid)}) AS k)
      WHERE place <= k GROUP BY {part}k, N) m"""


_SHARED_PAIRS = "shared p JOIN shared q USING (i, j)"


def _matching_sql(source: str, two: bool) -> str:
    true = "(p.b0 - p.a0) * (p.b0 - p.a0) + (p.b1 - p.a1) * (p.b1 - p.a1)"
    one = f"CASE WHEN (p.b0 - q.a0) * (p.b0 - q.a0) + (p.b1 - q.a1) * (p.b1 - q.a1) < {true} THEN 1 ELSE 0 END"
    other = f"CASE WHEN (p.a0 - q.b0) * (p.a0 - q.b0) + (p.a1 - q.b1) * (p.a1 - q.b1) < {true} THEN 1 ELSE 0 END"
    total = f"sum({one}) + sum({other})" if two else f"sum({one})"
    return f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(sqrt(count(*)) AS BIGINT) AS n, round(({total}) / (count(*) * {2.0 if two else 1.0}), 6) AS foscttm FROM {source} p JOIN {source} q USING (i, j) GROUP BY i, j"


_COV = ", cov AS (SELECT i, j, count(*) AS n, " + ", ".join(f"sum(a{p} * b{q}) AS c{p}{q}" for p in range(2) for q in range(2)) + " FROM shared GROUP BY i, j)"
_ORTHO = """, ortho AS (SELECT i, j, cos(t) AS o00, -s * sin(t) AS o01, sin(t) AS o10, s * cos(t) AS o11 FROM (
  SELECT i, j, CASE WHEN c00 * c11 - c01 * c10 >= 0 THEN 1 ELSE -1 END AS s,
         CASE WHEN c00 * c11 - c01 * c10 >= 0 THEN atan2(c10 - c01, c00 + c11) ELSE atan2(c10 + c01, c00 - c11) END AS t FROM cov))"""
_BUNDLED = """, bundled AS (SELECT i, j, vec_id, a0, a1, o00 * b0 + o01 * b1 AS b0, o10 * b0 + o11 * b1 AS b1 FROM shared JOIN ortho USING (i, j))"""
_DIAG = """, diag AS (SELECT i, j, (s0 + sqrt(s0 * s0 + 0.002 * q0)) / (2 * q0) AS d0, (s1 + sqrt(s1 * s1 + 0.002 * q1)) / (2 * q1) AS d1 FROM (
  SELECT i, j, sum(a0 * b0) AS s0, sum(a1 * b1) AS s1, sum(b0 * b0) AS q0, sum(b1 * b1) AS q1 FROM shared GROUP BY i, j))"""
_FRAMES = """, toward AS (
  SELECT i AS agent, j AS near, c00 AS m00, c10 AS m01, c01 AS m10, c11 AS m11 FROM cov UNION ALL SELECT j, i, c00, c01, c10, c11 FROM cov
), frames AS (SELECT agent, cos(t) AS f00, -sin(t) AS f01, sin(t) AS f10, cos(t) AS f11 FROM (
  SELECT agent, atan2(sum(m10) - sum(m01), sum(m00) + sum(m11)) AS t FROM toward GROUP BY agent))"""
_IJ = "CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j"
_O_SQL = ", ".join(f"round({o}, 6) AS {o}" for o in _O)
_LOSS = "round(avg((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1)), 6) AS loss"


def _sums_sql(source: str, by: str = "", cols=("u0", "v0")) -> str:
    same = f" ON a.{by} = b.{by}" if by else " ON true"
    d, e = _d("a", "b", POSITION), _d("a", "b", cols)
    return f"SELECT {f'a.{by} AS {by}, ' if by else ''}sum({d}) AS dd, sum(sqrt(({d}) * ({e}))) AS de, sum({e}) AS ee FROM {source} a JOIN {source} b{same}{f' GROUP BY a.{by}' if by else ''}"


_W = """, w AS (SELECT a AS agent, ['l0.w', 'l0.b', 'l1.w', 'l1.b'][CAST(vec_id % 4 + 1 AS INT)] AS key, vec_id AS pos, [u0, u1, u2, u3][a + 1] AS v
  FROM charts, (SELECT unnest([0, 1, 2, 3]) AS a)),
near AS (SELECT i AS agent, j AS other FROM edges WHERE i = 0 OR j = 3 UNION SELECT j, i FROM edges WHERE i = 0 OR j = 3 UNION SELECT a, a FROM (SELECT unnest([0, 1, 2, 3]) AS a)),
mean AS (SELECT near.agent, key, pos, avg(v) AS v FROM near JOIN w ON w.agent = near.other GROUP BY near.agent, key, pos)"""

ORACLES = {
    "continuity_k10": SQL_VIEWS + _neighbourhood_sql("charts", "", POSITION, CHART, [10]),
    "trustworthiness_k10": SQL_VIEWS + _neighbourhood_sql("charts", "", CHART, POSITION, [10]),
    "ct_tw_all_k": SQL_VIEWS + _neighbourhood_sql("site_charts", "bs_id", POSITION, ["z0", "z1"], GRID, "CT") + " UNION ALL " + _neighbourhood_sql("site_charts", "bs_id", ["z0", "z1"], POSITION, GRID, "TW"),
    "knn_k": SQL_VIEWS + f"SELECT * FROM (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d('a', 'b', POSITION)}, b.vec_id) AS place FROM charts a JOIN charts b ON a.vec_id <> b.vec_id) WHERE place <= 5",
    "rank_self_join": SQL_VIEWS + f"SELECT vec_id, other, r AS rank FROM (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d('a', 'b', POSITION)}, b.vec_id) AS place, rank() OVER (PARTITION BY a.vec_id ORDER BY {_d('a', 'b', CHART)}) AS r FROM charts a JOIN charts b ON a.vec_id <> b.vec_id) WHERE place <= 3",
    "kruskal_stress_full": SQL_VIEWS + f"SELECT round(sqrt(greatest(1 - de * de / (dd * ee), 0)), 6) AS stress FROM ({_sums_sql('charts')})",
    "kruskal_stress_single_agent_beta": SQL_VIEWS + f"SELECT round(sqrt((dd - 2 * de / dd * de + de / dd * de / dd * ee) / dd), 6) AS stress FROM ({_sums_sql('charts')})",
    "kruskal_stress_bootstrap": SQL_VIEWS + f", placed AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n, * FROM charts), drawn AS (SELECT s, m, CAST('0x' || substr(md5('42:' || s || ':' || m), 1, 12) AS BIGINT) % n AS idx FROM (SELECT unnest(range({DRAWS})) AS s), (SELECT unnest(range({SAMPLE})) AS m), (SELECT count(*) AS n FROM charts)), pts AS (SELECT s, m, x, y, u0, v0 FROM drawn JOIN placed USING (idx)) " + f"SELECT count(*) AS draws, round(avg(sqrt(greatest(1 - de * de / (dd * ee), 0))), 6) AS stress FROM ({_sums_sql('pts', 's')})",
    "kruskal_per_site": SQL_VIEWS + f"SELECT CAST(bs_id AS BIGINT) AS bs_id, round(sqrt(greatest(1 - de * de / (dd * ee), 0)), 6) AS stress FROM ({_sums_sql('site_charts', 'bs_id', ('z0', 'z1'))})",
    "foscttm_one_sided": SQL_VIEWS + _matching_sql("shared", False),
    "foscttm_two_sided": SQL_VIEWS + _matching_sql("shared", True),
    "cross_covariance_edges": SQL_VIEWS + _COV + f"SELECT {_IJ}, " + ", ".join(f"round(c{p}{q}, 6) AS c{p}{q}" for p in range(2) for q in range(2)) + ", n FROM cov",
    "procrustes_o2": SQL_VIEWS + _COV + _ORTHO + f"SELECT {_IJ}, {_O_SQL} FROM ortho",
    "procrustes_svd": SQL_VIEWS + _COV + _ORTHO + f"SELECT {_IJ}, {_O_SQL} FROM ortho",
    "kabsch_so2": SQL_VIEWS + _COV + f"SELECT {_IJ}, round(cos(t), 6) AS o00, round(-sin(t), 6) AS o01, round(sin(t), 6) AS o10, round(cos(t), 6) AS o11 FROM (SELECT i, j, atan2(c10 - c01, c00 + c11) AS t FROM cov)",
    "diag_map_closed_form": SQL_VIEWS + _DIAG + f"SELECT {_IJ}, round(d0, 6) AS d0, round(d1, 6) AS d1 FROM diag",
    "cover_identity_loss": SQL_VIEWS + f"SELECT {_IJ}, {_LOSS} FROM shared GROUP BY i, j",
    "alignment_loss_bundle": SQL_VIEWS + _COV + _ORTHO + _BUNDLED + f"SELECT {_IJ}, {_LOSS} FROM bundled GROUP BY i, j",
    "alignment_loss_diag": SQL_VIEWS + _DIAG + f"SELECT {_IJ}, {_LOSS} FROM (SELECT i, j, a0, a1, d0 * b0 AS b0, d1 * b1 AS b1 FROM shared JOIN diag USING (i, j)) GROUP BY i, j",
    "alignment_loss_affine": SQL_VIEWS + f"SELECT {_IJ}, {_LOSS} FROM (SELECT i, j, " + ", ".join(f"({AFFINE[f'{s}m{p}0']} * {s}0 + {AFFINE[f'{s}m{p}1']} * {s}1 - {AFFINE[f'{s}t{p}']}) / exp({AFFINE[f'{s}s{p}']}) AS {s}{p}" for s in "ab" for p in range(2)) + " FROM shared) GROUP BY i, j",
    "flat_frames": SQL_VIEWS + _COV + _FRAMES + "SELECT CAST(agent AS BIGINT) AS agent, round(f00, 6) AS f00, round(f01, 6) AS f01, round(f10, 6) AS f10, round(f11, 6) AS f11 FROM frames",
    "alignment_loss_flat": SQL_VIEWS + _COV + _FRAMES + f"SELECT {_IJ}, {_LOSS} FROM (SELECT i, j, f.f00 * a0 + f.f01 * a1 AS a0, f.f10 * a0 + f.f11 * a1 AS a1, g.f00 * b0 + g.f01 * b1 AS b0, g.f10 * b0 + g.f11 * b1 AS b1 FROM shared JOIN frames f ON f.agent = i JOIN frames g ON g.agent = j) GROUP BY i, j",
    "foscttm_aligned": SQL_VIEWS + _COV + _ORTHO + _BUNDLED + _matching_sql("bundled", True),
    "recovered_rotation": "SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0.6 AS DOUBLE) AS o00, CAST(0.8 AS DOUBLE) AS o01, CAST(0.8 AS DOUBLE) AS o10, CAST(-0.6 AS DOUBLE) AS o11, CAST(0 AS DOUBLE) AS loss",
    "fedavg_params": SQL_VIEWS + _W + "SELECT CAST(agent AS BIGINT) AS agent, key, pos, round(v, 6) AS v FROM mean",
    "partial_fedavg_params": SQL_VIEWS + _W + "SELECT CAST(agent AS BIGINT) AS agent, key, pos, round(v, 6) AS v FROM mean WHERE key LIKE 'l1.%' UNION ALL SELECT CAST(agent AS BIGINT), key, pos, round(v, 6) FROM w WHERE key LIKE 'l0.%'",
    "alignment_report": SQL_VIEWS + _COV + _ORTHO + _BUNDLED + f""", m0 AS ({_matching_sql('shared', True)}), m1 AS ({_matching_sql('bundled', True)}),
      l0 AS (SELECT i, j, {_LOSS} FROM shared GROUP BY i, j), l1 AS (SELECT i, j, {_LOSS} FROM bundled GROUP BY i, j),
      ks AS (SELECT avg(sqrt(greatest(1 - de * de / (dd * ee), 0))) AS stress FROM ({_sums_sql('site_charts', 'bs_id', ('z0', 'z1'))}))
      SELECT m0.i, m0.j, m0.n, m0.foscttm AS foscttm_before, m1.foscttm AS foscttm_after, l0.loss AS loss_before, l1.loss AS loss_after, round(stress, 6) AS stress
      FROM m0 JOIN m1 USING (i, j) JOIN l0 USING (i, j) JOIN l1 USING (i, j), ks""",
}
