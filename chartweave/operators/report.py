"""Results: wide and long metric tables, rankings, means with deviations, checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of metric columns: <metric>, with _K<k> for curves and _agent_<a> for one site; means carry neither.
NAME = re.compile(r"(KS|CT|TW)(?:_K(\d+))?(?:_(agent_(\d+)|mean))?")


def metrics_wide(long: DataFrame) -> DataFrame:
    """One row a method: columns KS_agent_<a>, KS_mean, CT_K<k>_agent_<a>, CT_K<k> and so on from (method, metric, k, agent, value).

    The names to pivot are the table's own distinct ones, a bounded report.
    """
    curve = F.when(F.col("k").isNotNull(), F.concat(F.lit("_K"), F.col("k").cast("string"))).otherwise(F.lit(""))
    own = long.select("method", F.concat("metric", curve, F.lit("_agent_"), F.col("agent").cast("string")).alias("name"), "value")
    tail = F.when(F.col("k").isNull(), F.lit("_mean")).otherwise(F.lit(""))
    mean = long.groupBy("method", "metric", "k").agg(F.avg("value").alias("value")).select("method", F.concat("metric", curve, tail).alias("name"), "value")
    rows = own.unionByName(mean)
    names = sorted(r[0] for r in rows.select("name").distinct().collect())
    return rows.groupBy("method").pivot("name", names).agg(F.first("value"))


def metrics_long(wide: DataFrame) -> DataFrame:
    """method, metric, k, agent, value: per-site columns; where a method has none of a metric and k, its mean as agent 0."""
    named = [(c, m) for c in wide.columns if (m := NAME.fullmatch(c))]
    if not named:
        raise ValueError("no metric columns")
    parts = []
    for c, m in named:
        k = F.lit(int(m[2])) if m[2] else F.lit(None).cast("int")
        parts.append(F.struct(F.lit(m[1]).alias("metric"), k.alias("k"), F.lit(int(m[4]) if m[4] else 0).alias("agent"), F.lit(m[4] is None).alias("mean"), F.col(c).cast("double").alias("value")))
    rows = wide.select("method", F.explode(F.array(*parts)).alias("x")).select("method", "x.*").where("value is not null and not isnan(value)")
    w = Window.partitionBy("method", "metric", "k")
    keep = rows.withColumn("own", F.max((~F.col("mean")).cast("int")).over(w))
    return keep.where((F.col("own") == 0) | ~F.col("mean")).select("method", "metric", "k", "agent", "value")


def best(long: DataFrame, n: int = 3, falling: tuple[str, ...] = ("CT", "TW")) -> DataFrame:
    """metric, k, place, method, value: the n best methods of each metric by mean over sites; NaN never ranks."""
    mean = long.where(~F.isnan("value")).groupBy("metric", "k", "method").agg(F.avg("value").alias("value"))
    order = F.when(F.col("metric").isin(*falling), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("metric", "k").orderBy(order, "method")
    return mean.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def mean_deviation(long: DataFrame) -> DataFrame:
    """method, metric, k, mean, deviation (null below two values) over sites."""
    return long.groupBy("method", "metric", "k").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))


def best_checkpoint(files: DataFrame, path: str = "path") -> DataFrame:
    """path, loss: of file names with ``_loss<number>_`` the one with the smallest loss (ties: the smaller name)."""
    loss = F.regexp_extract(path, r"_loss(\d+\.\d+)_", 1)
    rows = files.select(F.col(path).alias("path"), F.when(loss != "", loss.cast("double")).alias("loss")).where("loss is not null")
    return rows.agg(F.min(F.struct("loss", "path")).alias("m")).where("m is not null").select("m.path", "m.loss")


def weighted_means(steps: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Means over batches weighted by their sizes; with ``dropped`` true a batch does not count."""
    return steps.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count("*").alias("batches"))


def total_loss(private: Column, alignment: Column, share: Column, reconstruction: Column | None = None, alpha: Column | None = None) -> Column:
    """private + share * alignment; with a reconstruction loss the private part is (1 - alpha) rec + alpha private."""
    own = private if reconstruction is None else (1 - alpha) * reconstruction + alpha * private
    return own + share * alignment


def formatted(value: Column, digits: int = 3, missing: str = "--") -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(missing)).otherwise(F.format_number(value, digits))


#: Fixed names of the colours of the three best methods of a column.
PLACES = ("best", "second", "third")


def latex_rows(summary: DataFrame, metrics: list[str], digits: int = 3, falling: tuple[str, ...] = ("CT", "TW")) -> DataFrame:
    """method, line: a table row of each method, cells "mean $\\pm$ deviation" with the colours of the three best.

    Columns are metrics, or ``metric@k``. Of ``falling`` metrics the largest mean is best, else the smallest; equal means go by name, and
    means that are missing have no place.
    """
    label = F.concat("metric", F.coalesce(F.concat(F.lit("@"), F.col("k").cast("string")), F.lit("")))
    summary = summary.withColumn("label", label).where(F.col("label").isin(*metrics))
    known = F.col("mean").isNotNull() & ~F.isnan("mean")
    order = F.when(F.col("metric").isin(*falling), -F.col("mean")).otherwise(F.col("mean"))
    place = F.when(known, F.row_number().over(Window.partitionBy("label").orderBy((~known).cast("int"), order, "method")))
    colour = F.lit("")
    for n, name in enumerate(PLACES, 1):
        colour = F.when(place == n, rf"\cellcolor{{{name}}}").otherwise(colour)
    summary = summary.withColumn("__colour", colour)
    cell = F.concat("__colour", formatted(F.col("mean"), digits), F.when(F.col("deviation").isNotNull(), F.concat(F.lit(r" $\pm$ "), formatted(F.col("deviation"), digits))).otherwise(F.lit("")))
    wide = summary.withColumn("cell", cell).groupBy("method").pivot("label", metrics).agg(F.first("cell"))
    return wide.select("method", F.concat(F.concat_ws(" & ", "method", *(F.coalesce(F.col(f"`{m}`"), F.lit("--")) for m in metrics)), F.lit(r" \\")).alias("line"))
