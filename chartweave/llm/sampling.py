"""A bounded, reproducible sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The hash decides by so many steps between 0 and 1.
STEPS = 1 << 30


def stratified(df: DataFrame, stratum: str, per_stratum: int, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """At most ``per_stratum`` rows of each value of ``stratum``, chosen by a hash of the id.

    The values are counted first (column pruning leaves the texts unread). A threshold on the
    hash then keeps about twice the wanted rows before any row moves, so the final ranking
    sees a bounded number of rows whatever the table's size. Strata of null are left out.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    if not counts:
        return df.limit(0)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(STEPS))
    below = [(F.col(stratum) == value) & (place < min(STEPS, 2 * per_stratum * STEPS // count + 1)) for value, count in counts.items()]
    thinned = df.where(reduce(lambda a, b: a | b, below))
    order = Window.partitionBy(stratum).orderBy(place, F.col(id_col))
    return thinned.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_stratum).drop("__rank")
