"""Queries of schedules, result tables, checks and streams, with their oracles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedules as H
from ..functions import vectors as V
from ..operators import checks as C
from ..operators import graph as N
from ..operators import report as E
from ..operators.sampling import global_index
from ..operators.sites import shared_keys
from ..operators.triplets import lock_step
from ..session import shared_dir, table
from ..streaming import live
from .fixtures import ANTENNAS, PAIRS, SQL_VIEWS, SUBCARRIERS, charts, site_charts, site_pairs, sites, snapshots, trajectories
from .quality import r6

EPOCHS, LOW, HIGH, STEEPNESS = 6, 0.01, 2.0, 1.5
#: metric, k -> the value of a site's chart (u, v) that stands for it.
METRICS = {("KS", None): "u", ("CT", 2): "v", ("CT", 6): "u * v", ("TW", 2): "u + v"}
COLUMNS = ["KS", "CT@2", "CT@6", "TW@2"]
LONG = ["method", "metric", "k", "agent", "value"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as methods: method, metric, k, agent, value."""
    cells = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).cast("int").alias("k"), F.lit(a).alias("agent"), F.expr(text.replace("u", f"u{a}").replace("v", f"v{a}")).alias("value"))
        for (m, k), text in METRICS.items()
        for a in range(4)
    ]
    rows = charts(spark, sf_dir).select(F.concat(F.lit("m"), "label").alias("method"), F.explode(F.array(*cells)).alias("x")).select("method", "x.*")
    return rows.groupBy("method", "metric", "k", "agent").agg(F.avg("value").alias("value"))


def _long(df: DataFrame) -> DataFrame:
    return df.select("method", "metric", F.col("k").cast("long").alias("k"), F.col("agent").cast("long").alias("agent"), r6("value", "value"))


def metrics_wide(spark, sf_dir):
    wide = E.metrics_wide(results(spark, sf_dir))
    return wide.select("method", *(r6(c, c) for c in wide.columns if c != "method"))


def metrics_long(spark, sf_dir):
    return _long(E.metrics_long(E.metrics_wide(results(spark, sf_dir))))


def top3_per_metric(spark, sf_dir):
    best = E.best(results(spark, sf_dir))
    return best.select("metric", F.col("k").cast("long").alias("k"), F.col("place").cast("long").alias("place"), "method", r6("value", "value"))


def mean_std_by_k(spark, sf_dir):
    return E.mean_deviation(results(spark, sf_dir)).select("method", "metric", F.col("k").cast("long").alias("k"), r6("mean", "mean"), r6("deviation", "deviation"))


def summary_lines(spark, sf_dir):
    """Table rows as text."""
    return E.latex_rows(E.mean_deviation(results(spark, sf_dir)), COLUMNS)


def best_checkpoint(spark, sf_dir):
    name = F.concat(F.lit("run"), "vec_id", F.when(F.col("vec_id") % 3 == 0, F.lit("_last")).otherwise(F.concat(F.lit("_loss"), "label", F.lit("."), F.col("vec_id") % 97, F.lit("_"))), F.lit(".ckpt"))
    return E.best_checkpoint(table(spark, sf_dir, "embeddings").select(name.alias("path")))


def batch_weighted_means(spark, sf_dir):
    """Means of l_tax over orders' lines weighted by quantity, by ship flag; stands for losses over batches."""
    found = E.weighted_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_quantity")
    return found.select("l_returnflag", r6("mean", "mean"), "batches")


def total_losses(spark, sf_dir):
    c = charts(spark, sf_dir)
    loss = E.total_loss(F.col("u0"), F.col("u1"), F.lit(0.3), F.col("v0"), F.abs("v1"))
    return c.select("vec_id", r6(loss, "loss"))


def lambda_schedules(spark, sf_dir):
    kinds = [F.struct(F.lit(k).alias("kind"), H.ramp(k, F.col("id"), EPOCHS, LOW, HIGH).alias("v")) for k in ("none", "linear", "exponential", "cosine")]
    return spark.range(EPOCHS).select(F.col("id").alias("epoch"), F.explode(F.array(*kinds)).alias("x")).select("epoch", "x.kind", r6("x.v", "value"))


def alpha_schedule(spark, sf_dir):
    return spark.range(EPOCHS).select(F.col("id").alias("epoch"), r6(H.sigmoid_ramp(F.col("id"), EPOCHS, STEEPNESS), "alpha"))


def fold_schedule(spark, sf_dir):
    rows = [(k, *b) for k, b in enumerate(H.fold_bounds(4, LOW, HIGH))]
    return spark.createDataFrame(rows, "fold long, low double, high double").select("fold", r6("low", "low"), r6("high", "high"))


def lock_step_batches(spark, sf_dir):
    """All sites' points in batches of 16; shorter lists start again until the longest ends."""
    from ..session import materialize

    own = materialize(site_charts(spark, sf_dir).select("bs_id", "vec_id"), "covered")
    found = lock_step({s: own.where(F.col("bs_id") == int(s)).select("vec_id") for s in "0123"}, "vec_id", 16)
    return found.select(F.col("step").cast("long").alias("step"), "loader", "vec_id")


def verify_position_mapping(spark, sf_dir):
    """Indexed positions against a table with planted faults: every 13th row is missing, every 11th is half a unit off."""
    c = charts(spark, sf_dir)
    index = global_index(c.select("vec_id", "x", "y"), ["vec_id"])
    off = c.where("vec_id % 13 > 0").withColumn("y", F.when(F.col("vec_id") % 11 == 0, F.col("y") + 0.5).otherwise(F.col("y")))
    return C.mismatches(index, off, ["vec_id"], ["x", "y"]).select("rows", "missing", "wrong", r6("worst", "worst"))


def verify_channel_mapping(spark, sf_dir):
    """Snapshots against a table with planted faults: every 7th row is missing, every 9th is in reverse order."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.where("vec_id % 7 > 0").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    return C.mismatches(other, rows, ["vec_id"], ["embedding"]).select("rows", "missing", "wrong")


def verify_csi_ordering(spark, sf_dir):
    """Whether the features of a snapshot are nearer to those of the next two than to those 100 and 200 on; behind the last id comes the first."""
    c = snapshots(spark, sf_dir)
    features = c.select("vec_id", V.chunk_features(F.col("csi"), 4, ANTENNAS * SUBCARRIERS).alias("f"))
    steps = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in ((1, 100), (2, 200)))))
    n = c.count()
    samples = c.select(F.col("vec_id").alias("anchor"), steps.alias("s")).select("anchor", ((F.col("anchor") + F.col("s.p")) % n).alias("pos"), ((F.col("anchor") + F.col("s.n")) % n).alias("neg"))
    return C.feature_ordering(samples, features, "vec_id")


def getitem_round_trip(spark, sf_dir):
    """Every row of the order in time, fetched by its place."""
    t = trajectories(spark, sf_dir)
    index = global_index(t.select("t_us", "event_id"), ["t_us", "event_id"])
    return C.items(index, index.select("gidx"), t.select("event_id", "user_id", "value"), "gidx", "event_id").select("gidx", "event_id", "user_id", "value")


def shared_fingerprints(spark, sf_dir):
    """The points that two sites share, for every pair, found again in the first site's chart by what their coordinates print."""
    from ..session import materialize

    own = materialize(site_charts(spark, sf_dir).select("bs_id", "vec_id", "z0", "z1"), "charts")
    out = None
    for i, j in PAIRS:
        local, other = own.where(F.col("bs_id") == i).drop("bs_id"), own.where(F.col("bs_id") == j).select("vec_id")
        part = C.fingerprint_join(local, local.join(other, "vec_id", "left_semi"), "vec_id", ["z0", "z1"]).select(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), "vec_id", "found")
        out = part if out is None else out.unionByName(part)
    return out


def stuck_rows(spark, sf_dir):
    """Rows, one every 8 of a user, whose last 8 points of (value, 0) hardly vary."""
    t = trajectories(spark, sf_dir).select("user_id", "event_id", "t_us", F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return N.stuck(t.withColumn("__t", F.struct("t_us", "event_id")), "user_id", "__t", 8, 25.0).select("user_id", "event_id", r6("spread", "spread"))


def verify_shared_consistency(spark, sf_dir):
    own = site_charts(spark, sf_dir)
    keys = shared_keys(own.select("bs_id", "vec_id"), site_pairs(spark), "vec_id")
    found = C.shared_inconsistencies(keys, own.where("not (bs_id = 1 and vec_id % 5 = 0)"), "vec_id")
    return found.select(*(F.col(k).cast("long").alias(k) for k in ("i", "j", "n", "strangers")))


def _drained(stream: DataFrame) -> DataFrame:
    """All that a stream of the files there are gives, in a table of the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may name one file, a plain path may not


def stream_coverage(spark, sf_dir):
    e = lambda k: F.element_at("embedding", k).cast("double")
    points = _arriving(spark, sf_dir, "embeddings").select("vec_id", e(1).alias("x"), e(2).alias("y"))
    found = _drained(live.live_coverage(points, sites(spark), "vec_id"))
    return found.select(F.col("bs_id").cast("long").alias("bs_id"), "vec_id")


def stream_positives(spark, sf_dir):
    events = lambda: _arriving(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(live.live_positives(events(), events(), "user_id", "event_id", "ts", "6 hours", "1 day"))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_wide, metrics_long, top3_per_metric, mean_std_by_k, summary_lines, best_checkpoint, batch_weighted_means, total_losses, lambda_schedules,
        alpha_schedule, fold_schedule, lock_step_batches, verify_position_mapping, verify_channel_mapping, verify_shared_consistency, verify_csi_ordering, getitem_round_trip,
        shared_fingerprints, stuck_rows, stream_coverage, stream_positives,
    )
}

_CELLS = " UNION ALL ".join(
    f"SELECT 'm' || label AS method, '{m}' AS metric, CAST({'NULL' if k is None else k} AS BIGINT) AS k, CAST({a} AS BIGINT) AS agent, avg({text.replace('u', f'u{a}').replace('v', f'v{a}')}) AS value FROM charts GROUP BY label"
    for (m, k), text in METRICS.items()
    for a in range(4)
)
_RESULTS = SQL_VIEWS + f", results AS ({_CELLS}), means AS (SELECT metric, k, method, avg(value) AS value FROM results GROUP BY ALL)"
_CURVE = lambda k: "" if k is None else f"_K{k}"
_WIDE = ", ".join(
    [f"round(max(CASE WHEN metric = '{m}' AND k IS NOT DISTINCT FROM {'NULL' if k is None else k} AND agent = {a} THEN value END), 6) AS {m}{_CURVE(k)}_agent_{a}" for m, k in METRICS for a in range(4)]
    + [f"round(avg(CASE WHEN metric = '{m}' AND k IS NOT DISTINCT FROM {'NULL' if k is None else k} THEN value END), 6) AS {m}{_CURVE(k) or '_mean'}" for m, k in METRICS]
)
_T = f"CAST(e AS DOUBLE) / {EPOCHS - 1}"
_RAMPS = {"none": f"{HIGH}", "linear": f"{LOW} + {HIGH - LOW} * {_T}", "exponential": f"{LOW} * pow({HIGH / LOW!r}, {_T})", "cosine": f"{LOW} + {HIGH - LOW} * (1 - cos({math.pi!r} * {_T})) / 2"}
_COS = lambda k: f"{LOW} + {HIGH - LOW} * (1 - cos({math.pi!r} * {k} / 4)) / 2"

_LABELLED = """, sums AS (SELECT method, metric, metric || coalesce('@' || k, '') AS label, avg(value) AS mean, stddev_samp(value) AS deviation FROM results GROUP BY method, metric, k),
cells AS (SELECT method, label, coalesce(['\\cellcolor{best}', '\\cellcolor{second}', '\\cellcolor{third}'][row_number() OVER (PARTITION BY label ORDER BY CASE WHEN metric = 'KS' THEN mean ELSE -mean END, method)], '')
  || printf('%.3f', mean) || coalesce(' $\\pm$ ' || printf('%.3f', deviation), '') AS cell FROM sums) """
_LINES = _LABELLED + "SELECT method, method || ' & ' || " + " || ' & ' || ".join(f"coalesce(max(CASE WHEN label = '{c}' THEN cell END), '--')" for c in COLUMNS) + " || ' \\\\' AS line FROM cells GROUP BY method"

ORACLES = {
    "metrics_wide": _RESULTS + f"SELECT method, {_WIDE} FROM results GROUP BY method",
    "metrics_long": _RESULTS + "SELECT method, metric, k, agent, round(value, 6) AS value FROM results",
    "top3_per_metric": _RESULTS + "SELECT metric, k, place, method, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric, k ORDER BY CASE WHEN metric = 'KS' THEN value ELSE -value END, method) AS place FROM means) WHERE place <= 3",
    "mean_std_by_k": _RESULTS + "SELECT method, metric, k, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM results GROUP BY ALL",
    "best_checkpoint": "SELECT path, loss FROM (SELECT 'run' || vec_id || '_loss' || label || '.' || (vec_id % 97) || '_.ckpt' AS path, CAST(label || '.' || (vec_id % 97) AS DOUBLE) AS loss FROM embeddings WHERE vec_id % 3 <> 0) ORDER BY loss, path LIMIT 1",
    "batch_weighted_means": "SELECT l_returnflag, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS mean, count(*) AS batches FROM lineitem GROUP BY l_returnflag",
    "total_losses": SQL_VIEWS + "SELECT vec_id, round((1 - abs(v1)) * v0 + abs(v1) * u0 + 0.3 * u1, 6) AS loss FROM charts",
    "lambda_schedules": " UNION ALL ".join(f"SELECT e AS epoch, '{k}' AS kind, round(CAST({v} AS DOUBLE), 6) AS value FROM range({EPOCHS}) AS t(e)" for k, v in _RAMPS.items()),
    "alpha_schedule": f"SELECT e AS epoch, round(1 / (1 + exp(-{STEEPNESS} * (e - {EPOCHS / 2}))), 6) AS alpha FROM range({EPOCHS}) AS t(e)",
    "fold_schedule": f"SELECT k AS fold, round({_COS('k')}, 6) AS low, round({_COS('(k + 1)')}, 6) AS high FROM range(4) AS t(k)",
    "verify_position_mapping": SQL_VIEWS + "SELECT count(*) AS rows, count(*) FILTER (vec_id % 13 = 0) AS missing, count(*) FILTER (vec_id % 11 = 0 AND vec_id % 13 > 0) AS wrong, round(max(CASE WHEN vec_id % 11 = 0 AND vec_id % 13 > 0 THEN abs(y - (y + 0.5)) ELSE 0 END), 6) AS worst FROM charts",
    "verify_channel_mapping": "SELECT count(*) AS rows, count(*) FILTER (vec_id % 7 = 0) AS missing, count(*) FILTER (vec_id % 7 > 0 AND vec_id % 9 = 0 AND list_reverse(embedding) <> embedding) AS wrong FROM embeddings",
    "verify_shared_consistency": SQL_VIEWS + "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, count(*) AS n, CAST(sum(CASE WHEN (i = 1 OR j = 1) AND vec_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS strangers FROM shared GROUP BY i, j",
    "verify_csi_ordering": SQL_VIEWS + """, scale AS (SELECT vec_id, sqrt(sum(re * re + im * im) / 32) + 1e-12 AS s FROM csi GROUP BY vec_id),
      f AS (SELECT csi.vec_id, (antenna * 8 + f) // 4 AS c, sum(re) / 4 / any_value(s) AS re, sum(im) / 4 / any_value(s) AS im FROM csi JOIN scale USING (vec_id) GROUP BY 1, 2),
      d AS (SELECT a.vec_id, o, sqrt(sum((a.re - b.re) * (a.re - b.re) + (a.im - b.im) * (a.im - b.im))) AS d FROM f a, (SELECT unnest([1, 2, 100, 200]) AS o), (SELECT count(*) AS n FROM embeddings) JOIN f b ON a.c = b.c AND b.vec_id = (a.vec_id + o) % n GROUP BY 1, 2),
      per AS (SELECT p.vec_id, avg(p.d) AS p, avg(n.d) AS n FROM d p JOIN d n ON p.vec_id = n.vec_id AND n.o = 100 * p.o WHERE p.o < 3 GROUP BY 1)
      SELECT count(*) AS anchors, count(*) FILTER (NOT p < n) AS violations FROM per""",
    "getitem_round_trip": SQL_VIEWS + "SELECT * FROM (SELECT row_number() OVER (ORDER BY t_us, event_id) - 1 AS gidx, event_id, user_id, value FROM traj)",
    "shared_fingerprints": SQL_VIEWS + "SELECT CAST(r.i AS BIGINT) AS i, CAST(r.j AS BIGINT) AS j, r.vec_id, min(l.vec_id) AS found FROM shared r JOIN site_charts l ON l.bs_id = r.i AND printf('%.6f,%.6f', l.z0, l.z1) = printf('%.6f,%.6f', r.a0, r.a1) GROUP BY r.i, r.j, r.vec_id",
    "lock_step_batches": SQL_VIEWS + ", own AS (SELECT bs_id, vec_id, (row_number() OVER (PARTITION BY bs_id ORDER BY vec_id) - 1) // 16 AS b FROM coverage), sizes AS (SELECT bs_id, max(b) + 1 AS n FROM own GROUP BY bs_id), most AS (SELECT max(n) AS m FROM sizes) SELECT CAST(b + k * n AS BIGINT) AS step, CAST(bs_id AS VARCHAR) AS loader, vec_id FROM own JOIN sizes USING (bs_id), most, (SELECT unnest(range(1000)) AS k) WHERE b + k * n < m",
    "summary_lines": _RESULTS + _LINES,
    "stuck_rows": SQL_VIEWS + "SELECT user_id, event_id, round(spread, 6) AS spread FROM (SELECT *, stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS spread FROM traj) WHERE (ord + 1) % 8 = 0 AND spread < 25",
    "stream_coverage": SQL_VIEWS + "SELECT CAST(bs_id AS BIGINT) AS bs_id, vec_id FROM coverage",
    "stream_positives": "SELECT a.user_id, a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR",
}
