"""Metric rows, latent charts and checkpoints as tables; paths by the setting of a run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunConfig:
    """Defaults of a run; ``merged`` lays given values over them."""

    batch_size: int = 64
    tc_pos: float = 1.5
    in_window: int = 3
    out_window: int = 6
    pos_distance: int = 2
    neg_distance: int = 500
    n_pos: int | None = None
    n_neg: int | None = None
    splits: tuple[float, float, float] = (0.7, 0.15, 0.15)
    seeds: tuple[int, int, int] = (27, 42, 123)
    coverage_area: float = 0.2
    full_cover: bool = False
    groups: tuple[tuple[int, ...], ...] = ((0,), (1,), (2,), (3,))
    extra: dict[str, Any] = field(default_factory=dict)

    def merged(self, **values: Any) -> RunConfig:
        known = {k: v for k, v in values.items() if k in self.__dataclass_fields__}
        rest = {k: v for k, v in values.items() if k not in known}
        out = replace(self, **known, extra={**self.extra, **rest})
        if out.out_window <= out.in_window:
            raise ValueError("out_window must exceed in_window")
        if not 0 <= out.coverage_area <= 1:
            raise ValueError("coverage_area must lie in [0, 1]")
        return out


def setting_dir(root: str, groups: int, full_cover: bool) -> str:
    """The folder of a setting: two or four groups, with all points or each site's own."""
    if groups not in (2, 4):
        raise ValueError(f"no setting for {groups} groups")
    return f"{root}/{groups}_sites/{'full' if full_cover else 'local'}"


def save_metrics(row: DataFrame, path: str, method: str) -> None:
    """A method's row in its own partition; other methods' rows stay."""
    row.withColumn("method", F.lit(method)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def load_metrics(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All rows under ``path`` with the method from the folder's name and the setting above it; columns may differ by row."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    file = F.col("_metadata.file_path")
    named = rows.withColumn("method", F.regexp_extract(file, r"/(?:method=)?([^/]+)/[^/]+$", 1)).withColumn("setting", F.regexp_extract(file, r"/([^/]+/[^/]+)/[^/]+/[^/]+$", 1))
    return named.where(~F.col("method").isin(*exclude)) if exclude else named


def save_latents(charts: DataFrame, path: str, by: list[str]) -> None:
    """Charts by agent, or shared charts by pair."""
    charts.write.mode("overwrite").partitionBy(*by).parquet(path)


def load_latents(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """All charts below ``path`` with the ids that their folders carry (``agent=3`` or ``i=0/j=2``), as text; files without them are left out.

    The ids come from each file's own path, so folders of several runs or settings may be read together.
    """
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    place = F.col("_metadata.file_path")
    named = rows.withColumns({c: F.url_decode(F.regexp_extract(place, rf"/{c}=([^/]+)/", 1)) for c in by})
    return named.where(" and ".join(f"{c} <> ''" for c in by))


def save_table(summary: DataFrame, path: str) -> None:
    """A report as CSV with a header; reports are small, so one file."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a result is there already, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
