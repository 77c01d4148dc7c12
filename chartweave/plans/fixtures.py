"""The library's operators run over views of the driver's tables; here are these views, in Spark and as SQL.

``embeddings`` stands for positions, charts and snapshots of channel state, ``events`` for
trajectories; sites, site pairs and a building are literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SITES = [(0, 0.08, -0.08, 0.15), (1, -0.08, -0.02, 0.15), (2, -0.01, -0.10, 0.15), (3, -0.09, 0.08, 0.15)]
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
HULLS = [(0, 1.0, 0.0, -0.08), (0, -1.0, 0.0, 0.02), (0, 0.0, 1.0, -0.04), (0, 0.0, -1.0, -0.04)]
ANTENNAS, SUBCARRIERS = 4, 8


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, position x, y and the 2-D chart u<s>, v<s> of each site s."""
    element = lambda k: F.element_at("embedding", k).cast("double")
    names = ["x", "y", *(f"{c}{s}" for s in range(4) for c in "uv")]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(element(k).alias(n) for k, n in enumerate(names, 1)))


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, "bs_id int, cx double, cy double, radius double")


def site_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "i int, j int")


def hulls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HULLS, "hull_id int, a double, b double, c double")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, t_us: events of each user in microseconds."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and csi: ANTENNAS * SUBCARRIERS complex numbers, antenna-major, as structs (re, im)."""
    pair = lambda k: F.struct(F.element_at("embedding", 2 * k + 1).cast("double").alias("re"), F.element_at("embedding", 2 * k + 2).cast("double").alias("im"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(pair(k) for k in range(ANTENNAS * SUBCARRIERS))).alias("csi"))


def site_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: bs_id, vec_id, z0, z1 for the points that a site covers."""
    from ..operators.geometry import coverage

    wide = charts(spark, sf_dir)
    covered = coverage(wide, sites(spark), "vec_id")
    pick = lambda c: F.element_at(F.array(*(F.col(f"{c}{s}") for s in range(4))), F.col("bs_id") + 1)
    return covered.join(wide, "vec_id").select("bs_id", "vec_id", "x", "y", pick("u").alias("z0"), pick("v").alias("z1"))


def _rows(values) -> str:
    return ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in row) + ")" for row in values)


_COLUMNS = ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS {n}" for k, n in enumerate(["x", "y", *(f"{c}{s}" for s in range(4) for c in "uv")], 1))

#: The same views for DuckDB, to put in front of an oracle's own text.
SQL_VIEWS = f"""
WITH RECURSIVE charts AS (SELECT vec_id, label, {_COLUMNS} FROM embeddings),
bs AS (SELECT * FROM (VALUES {_rows(SITES)}) AS t(bs_id, cx, cy, radius)),
edges AS (SELECT * FROM (VALUES {_rows(PAIRS)}) AS t(i, j)),
hulls AS (SELECT * FROM (VALUES {_rows(HULLS)}) AS t(hull_id, a, b, c)),
coverage AS (SELECT bs_id, vec_id FROM charts, bs WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius),
site_charts AS (
  SELECT bs_id, vec_id, x, y, CASE bs_id WHEN 0 THEN u0 WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END AS z0,
         CASE bs_id WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS z1 FROM coverage JOIN charts USING (vec_id)),
shared AS (
  SELECT i, j, a.vec_id, a.z0 AS a0, a.z1 AS a1, b.z0 AS b0, b.z1 AS b1
  FROM edges JOIN site_charts a ON a.bs_id = i JOIN site_charts b ON b.bs_id = j AND b.vec_id = a.vec_id),
traj AS (SELECT user_id, event_id, epoch_us(ts) AS t_us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
csi AS (
  SELECT vec_id, (p // 16)::INT AS antenna, ((p % 16) // 2)::INT AS f, CAST(embedding[p + 1] AS DOUBLE) AS re, CAST(embedding[p + 2] AS DOUBLE) AS im
  FROM embeddings, (SELECT unnest(generate_series(0, 62, 2)) AS p))
"""
