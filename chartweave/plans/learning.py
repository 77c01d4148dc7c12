"""Queries of training: encoders of the sites by every method, and what they make of the points. Rows only: training is iterative."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import metrics as M
from ..operators import training as L
from ..operators.sampling import draw
from ..session import materialize, table
from .fixtures import SUBCARRIERS, site_charts, site_pairs

#: Numbers of an antenna's snapshot: every site sees the antenna of its own number.
WIDTH = 2 * SUBCARRIERS
SPEC = L.Training(epochs=4, rate=0.02, margin=0.5, layers=2)


def site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, key, label, x: the part of every covered point's snapshot that belongs to the site's antenna."""
    seen = site_charts(spark, sf_dir).select("bs_id", "vec_id")
    whole = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    own = F.transform(F.slice("embedding", F.col("bs_id") * WIDTH + 1, F.lit(WIDTH)), lambda v: v.cast("double"))
    return seen.join(whole, "vec_id").select(F.col("bs_id").alias("site"), F.col("vec_id").alias("key"), "label", own.alias("x"))


def samples(features: DataFrame) -> DataFrame:
    """site, key, xa, xp, xn: each point with the next of its label in a drawn order, and the next of a drawn order of all.

    The drawn orders are within (site, label) and (site, last bits of a draw), so no window holds a whole site.
    """
    from pyspark.sql import Window

    order = draw(80, F.col("site"), F.col("key"))
    same = Window.partitionBy("site", "label").orderBy(order, "key")
    any_ = Window.partitionBy("site", F.pmod(F.xxhash64("key"), F.lit(16))).orderBy(order, "key")
    out = features.select("site", "key", F.col("x").alias("xa"), F.lead("x").over(same).alias("xp"), F.lead("x").over(any_).alias("xn"))
    return out.where("xp is not null and xn is not null")


def shared_features(spark: SparkSession, features: DataFrame) -> DataFrame:
    """i, j, key, xi, xj of the points that both sites of a pair cover."""
    own = features.select("site", "key", "x")
    pairs = F.broadcast(site_pairs(spark))
    left = own.select(F.col("site").alias("i"), "key", F.col("x").alias("xi")).join(pairs, "i")
    right = own.select(F.col("site").alias("j"), "key", F.col("x").alias("xj"))
    return left.join(right, ["j", "key"]).select("i", "j", "key", "xi", "xj")


def trained(spark: SparkSession, sf_dir: str, method: str, **more) -> tuple[L.Model, DataFrame, DataFrame]:
    features = materialize(site_features(spark, sf_dir), "features")
    rows, shared = materialize(samples(features), "triplets"), materialize(shared_features(spark, features), "shared")
    return L.train(rows, shared, site_pairs(spark), replace(SPEC, method=method, **more), WIDTH), features, shared


def _history(method: str, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, _, _ = trained(spark, sf_dir, method, **more)
        return spark.createDataFrame(model.history, "epoch int, private double, pair double")

    run.__name__ = f"train_{method}"
    run.__doc__ = f"epoch, private, pair: mean losses while training by '{method}'."
    return run


def train_single_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, epoch, private: each site trained by itself, without pairs."""
    features = materialize(site_features(spark, sf_dir), "features")
    rows = materialize(samples(features), "triplets")
    none = site_pairs(spark).limit(0)
    alone = {s: L.train(rows.where(F.col("site") == s), None, none, replace(SPEC, method="vanilla"), WIDTH) for s in range(4)}
    return spark.createDataFrame([(s, e, p) for s, model in alone.items() for e, p, _ in model.history], "site int, epoch int, private double")


def encoded_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, key, z of every covered point by encoders trained with frames."""
    model, features, _ = trained(spark, sf_dir, "flat", epochs=2)
    return L.encode(features, model)


def decoded_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, key, x: reconstructions by autoencoders."""
    model, features, _ = trained(spark, sf_dir, "vanilla", epochs=2, decoder=True)
    return L.decode(L.encode(features, model), model)


def train_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, private, pair of autoencoders with normalised layers and dropout."""
    model, _, _ = trained(spark, sf_dir, "vanilla", epochs=2, decoder=True, norm=True, dropout=0.1)
    return spark.createDataFrame(model.history, "epoch int, private double, pair double")


def trained_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, n, foscttm of charts trained with orthogonal maps, b mapped into a's chart."""
    model, _, shared = trained(spark, sf_dir, "bundle")
    both = L.encode_shared(shared, model).withColumnRenamed("key", "vec_id")
    both = materialize(both, "charts")
    return M.matching(A.map_with(both, A.nearest_orthogonal(A.cross_covariance(both)), "matrix"))


QUERIES = {f"train_{m}": _history(m) for m in L.METHODS} | {
    "train_autoencoder": _history("cover", decoder=True, epochs=3),
    "train_normalised": train_normalised,
    "train_single_site": train_single_site,
    "encoded_charts": encoded_charts,
    "decoded_charts": decoded_charts,
    "trained_matching": trained_matching,
}
ORACLES: dict = {}
