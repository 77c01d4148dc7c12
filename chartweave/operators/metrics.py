"""Chart quality: continuity, trustworthiness, Kruskal stress and matching across sites.

Nearest neighbours are found in square cells with a rim: a neighbour within the rim's width is proven. What needs all pairs - ranks,
sums over distances, matches - deals out one side only: its blocks stream the other side's points from files of the shared folder. So
shuffles grow with the points and their neighbours, nothing gathers all points in one task, and no pair is a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cells import extent_of

#: Points of a block, and points of the other side that are met at once: a few million distances.
BLOCK = 2_048
#: Points that may be candidates in one cell; beyond it cells are halved, or a cell's candidates are dealt into parts.
CELL_POINTS = 4_096


def _blocks(points: DataFrame, n: int, key: str) -> DataFrame:
    count = max(1, -(-n // BLOCK))
    return points.withColumn("__b", F.pmod(F.xxhash64(*key.split(",")), F.lit(count)).cast("int"))


def _against_all(left: DataFrame, right: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """``work(block, others)`` for each block of ``left`` (column __b, within ``by``): ``others`` gives frames of at most BLOCK points of ``right``, all of the same ``by``.

    ``right`` is written once, sorted by ``by``; each task reads it from there, leaving out row groups of other ``by``.
    """
    kept = right.repartitionByRange(*by, F.xxhash64(*right.columns)).sortWithinPartitions(*by) if by else right
    stored = materialize(kept, "points")
    files = stored.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        def others():
            where, path = fs.FileSystem.from_uri(folder)
            same = None
            for c in by:
                value = frame[c].iloc[0]
                one = pc.field(c) == (value.item() if hasattr(value, "item") else value)
                same = one if same is None else same & one
            for batch in ds.dataset(path, filesystem=where, format="parquet").to_batches(filter=same, batch_size=BLOCK):
                if batch.num_rows:
                    yield batch.to_pandas()

        return work(frame, others())

    return left.groupBy(*by, "__b").applyInPandas(run, schema)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = 0.0
    for k in range(a.shape[1]):
        d = a[:, k : k + 1] - b[None, :, k]
        total = total + d * d
    return total


def _best(d2: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of each row that are finite, ties by the smaller of ``others``: what may count is partitioned off, and only that is sorted."""
    if d2.shape[1] > k:
        least = np.partition(d2, k - 1, axis=1)[:, k - 1]
        rows, columns = np.nonzero((d2 <= least[:, None]) & np.isfinite(d2))
    else:
        rows, columns = np.nonzero(np.isfinite(d2))
    order = np.lexsort((others[columns], d2[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def _first_size(candidates: DataFrame, by: list[str], extent: tuple[float, float, float, float]) -> float:
    """The largest cell side, a part of the extent by a power of two, at which no cell holds more than CELL_POINTS candidates."""
    width = max(extent[2] - extent[0], extent[3] - extent[1]) or 1.0
    levels = candidates.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(40))))
    size = F.lit(width) / F.pow(F.lit(2.0), F.col("__level"))
    counts = levels.groupBy(*by, "__level", F.floor((F.col("__x") - extent[0]) / size).alias("gx"), F.floor((F.col("__y") - extent[1]) / size).alias("gy")).count()
    full = counts.groupBy("__level").agg(F.max("count").alias("most")).where(F.col("most") <= CELL_POINTS)
    level = full.agg(F.min("__level")).first()[0]
    return width / 2.0 ** (40 if level is None else level)


def nearest(points: DataFrame, key: str, space: list[str], k: int, count: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, key, other, place: the k nearest other points of each (ties: the smaller key), place from 1; a point without a place has none.

    In rounds: points are queries of their cell and candidates of it and of the cells whose rim, half a cell wide, they lie in. A query whose
    k-th neighbour is no farther than the edge of the rim is done; the others go on to cells of twice the size. Of points at one place
    only the k + 1 smallest keys can be anyone's neighbours, so no place is a hot cell; a query that is still open has few points about it, so open queries
    are few wherever candidates are many, and those of one cell are dealt into parts of CELL_POINTS. Other than two dimensions meet all points.
    """
    if len(space) != 2:
        return _nearest_of_all(points, key, space, k, count, by)
    kinds = dict(points.dtypes)
    x, y = (F.col(c).cast("double") for c in space)
    own = points.select(*by, key, x.alias("__x"), y.alias("__y")).where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
    open_queries = materialize(own, "queries")
    extent = extent_of(open_queries, ["__x"], ["__y"])
    if extent is None:
        return points.select(*by, key, F.col(key).alias("other"), F.lit(0.0).alias("d2"), F.lit(1).alias("place")).limit(0)
    at_place = Window.partitionBy(*by, "__x", "__y").orderBy(key)
    candidates = open_queries.withColumn("__n", F.row_number().over(at_place)).where(F.col("__n") <= k + 1).drop("__n")
    candidates = materialize(candidates, "candidates")
    size, whole = _first_size(candidates, by, extent), 2 * max(extent[2] - extent[0], extent[3] - extent[1], 1e-300)
    head = "".join(f"{c} {kinds[c]}, " for c in by)
    columns = [*by, key, "other", "d2", "proven"]

    def place(column: str, origin: float, size: float, shift: float = 0.0):
        return F.floor((F.col(column) - origin + shift * size) / size)

    def work_at(size: float, last: bool):
        def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            frames = []
            if len(q) and len(c):
                others, there = c[key].to_numpy(), c[["__x", "__y"]].to_numpy()
                for low in range(0, len(q), BLOCK):
                    part = q.iloc[low : low + BLOCK]
                    here, keys = part[["__x", "__y"]].to_numpy(), part[key].to_numpy()
                    d2 = _squared(here, there)
                    d2[keys[:, None] == others[None, :]] = np.inf
                    rows, found = _best(d2, others, k)
                    corner = np.stack([part["gx"], part["gy"]], 1) * size + np.array(extent[:2]) - size / 2
                    rim = np.minimum(here - corner, corner + 2 * size - here).min(1) * (1 - 1e-9)
                    frame = pd.DataFrame({c: np.repeat(part[c].iloc[0], len(rows)) for c in by} | {key: keys[rows], "other": others[found], "d2": d2[rows, found]})
                    frame["proven"] = last | (frame["d2"].to_numpy() <= rim[rows] * rim[rows])
                    frames.append(frame)
            return pd.concat(frames) if frames else pd.DataFrame(columns=columns)

        return work

    out = None
    while True:
        last = size >= whole
        shifts = F.array_distinct(F.array(*(F.struct(place("__x", extent[0], size, a).alias("gx"), place("__y", extent[1], size, b).alias("gy")) for a in (-0.5, 0.5) for b in (-0.5, 0.5))))
        laid = candidates.withColumn("__c", F.explode(shifts)).select(*by, key, "__x", "__y", F.col("__c.gx").alias("gx"), F.col("__c.gy").alias("gy"))
        sizes = laid.groupBy(*by, "gx", "gy").agg(F.ceil(F.count("*") / CELL_POINTS).alias("__parts"))
        cells = open_queries.withColumns({"gx": place("__x", extent[0], size), "gy": place("__y", extent[1], size)})
        asked = cells.join(sizes, [*by, "gx", "gy"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts").cast("int") - 1)))
        dealt = laid.join(sizes, [*by, "gx", "gy"]).join(cells.select(*by, "gx", "gy").distinct(), [*by, "gx", "gy"], "left_semi")
        dealt = dealt.withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")).drop("__parts")
        keys = [*by, "gx", "gy", "__part"]
        met = asked.drop("__parts").groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(work_at(size, last), f"{head}{key} {kinds[key]}, other {kinds[key]}, d2 double, proven boolean")
        order = Window.partitionBy(*by, key).orderBy("d2", "other")
        best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        best = materialize(best, "nearest")
        done = best.groupBy(*by, key).agg(F.count("*").alias("n"), F.bool_and("proven").alias("proven")).where(F.col("proven") & ((F.col("n") == k) | F.lit(last)))
        done = done.select(*by, key)
        part = best.join(done, [*by, key], "left_semi").select(*by, key, "other", "d2", "place")
        out = part if out is None else out.unionByName(part)
        open_queries = materialize(open_queries.join(done, [*by, key], "left_anti"), "queries")
        if last or open_queries.isEmpty():
            return out
        size *= 2


def _nearest_of_all(points: DataFrame, key: str, space: list[str], k: int, count: int, by: list[str]) -> DataFrame:
    """The k nearest in any number of dimensions: each block keeps its best while all points pass by."""
    chosen = points.select(*by, key, *space)
    kinds = dict(points.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in by)

    def work(x, others):
        own, here = x[key].to_numpy(), x[space].to_numpy(float)
        d2, names = np.full((len(x), k), np.inf), np.zeros((len(x), k), own.dtype)
        for y in others:
            new, other = _squared(here, y[space].to_numpy(float)), y[key].to_numpy()
            new[own[:, None] == other[None, :]] = np.inf
            both, labels = np.concatenate([d2, new], 1), np.concatenate([names, np.broadcast_to(other, new.shape)], 1)
            order = np.lexsort((labels, both), axis=1)[:, :k]
            d2, names = np.take_along_axis(both, order, 1), np.take_along_axis(labels, order, 1)
        rows, place = np.nonzero(np.isfinite(d2))
        out = {c: np.repeat(x[c].iloc[0], len(rows)) for c in by} | {key: own[rows], "other": names[rows, place], "d2": d2[rows, place], "place": place + 1}
        return pd.DataFrame(out)

    return _against_all(_blocks(chosen, count, key), chosen, by, work, f"{head}{key} {kinds[key]}, other {kinds[key]}, d2 double, place int")


def ranks(points: DataFrame, pairs: DataFrame, key: str, space: list[str], count: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``rank`` to pairs (key, other): 1 + number of other points strictly nearer to key in ``space``."""
    at = lambda name, mark: points.select(*by, F.col(key).alias(name), *(F.col(c).alias(f"{mark}{c}") for c in space))
    d2 = None
    placed = pairs.join(at(key, "p_"), [*by, key]).join(at("other", "q_"), [*by, "other"])
    for c in space:
        term = (F.col(f"p_{c}") - F.col(f"q_{c}")) * (F.col(f"p_{c}") - F.col(f"q_{c}"))
        d2 = term if d2 is None else d2 + term
    wanted = placed.groupBy(*by, key).agg(F.collect_list(F.struct(d2.alias("e"), "other")).alias("w"))
    anchors = points.select(*by, key, *space).join(wanted.select(*by, key, F.transform("w", lambda s: s["e"]).alias("e"), F.transform("w", lambda s: s["other"]).alias("others")), [*by, key])
    kinds = dict(points.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in by)

    def work(x, others):
        own, here = x[key].to_numpy(), x[space].to_numpy(float)
        size = [len(e) for e in x["e"]]
        nearer = np.zeros(sum(size), np.int64)
        for y in others:
            d2 = _squared(here, y[space].to_numpy(float))
            d2[own[:, None] == y[key].to_numpy()[None, :]] = np.inf
            d2.sort(1)
            nearer += np.concatenate([np.searchsorted(row, e, side="left") for row, e in zip(d2, x["e"])])
        out = {c: np.repeat(x[c].iloc[0], sum(size)) for c in by}
        return pd.DataFrame(out | {key: np.repeat(own, size), "other": np.concatenate(list(x["others"])), "rank": nearer + 1})

    total = _against_all(_blocks(anchors, count, key), points.select(*by, key, *space), by, work, f"{head}{key} {kinds[key]}, other {kinds[key]}, rank long")
    return pairs.join(total, [*by, key, "other"])


def neighbourhood(points: DataFrame, key: str, near: list[str], ranked: list[str], grid: list[int], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, k, score for all k of the grid: 1 - 2 / (k (2N - 3k - 1)) * sum of max(rank - k, 0) over each point's k nearest, averaged.

    near: the space of neighbours, ranked: the space of ranks. Ranks are found once for the largest k.
    Defined for N > (3k + 1) / 2; other k give null.
    """
    sizes = points.groupBy(*by).agg(F.count("*").alias("N")) if by else points.agg(F.count("*").alias("N"))
    most = sizes.agg(F.max("N")).first()[0] or 0
    found = ranks(points, nearest(points, key, near, max(grid), most, by).select(*by, key, "other", "place"), key, ranked, most, by)
    per = found.withColumn("k", F.explode(F.array(*(F.lit(k) for k in grid)))).where(F.col("place") <= F.col("k"))
    sums = per.groupBy(*by, "k").agg(F.sum(F.greatest(F.col("rank") - F.col("k"), F.lit(0))).alias("penalty"))
    joined = sums.join(sizes, by) if by else sums.join(F.broadcast(sizes))
    norm = F.col("k") * (2 * F.col("N") - 3 * F.col("k") - 1)
    return joined.select(*by, "k", F.when(norm > 0, 1 - 2.0 / norm * F.col("penalty") / F.col("N")).alias("score"))


def continuity(points, key, position, embedding, grid, by=()):
    """Neighbours in position, ranks in the chart."""
    return neighbourhood(points, key, position, embedding, grid, list(by))


def trustworthiness(points, key, position, embedding, grid, by=()):
    """Neighbours in the chart, ranks in position."""
    return neighbourhood(points, key, embedding, position, grid, list(by))


def distance_sums(points: DataFrame, key: str, position: list[str], embedding: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, dd, de, ee, n: sums over all ordered pairs of D^2, D E and E^2 (D in position, E in the chart)."""
    sizes = points.groupBy(*by).agg(F.count("*").alias("n")) if by else points.agg(F.count("*").alias("n"))
    chosen = points.select(*by, key, *dict.fromkeys(position + embedding))
    kinds = dict(points.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in by)

    def work(x, others):
        dd = de = ee = 0.0
        for y in others:
            d2, e2 = (_squared(x[s].to_numpy(float), y[s].to_numpy(float)) for s in (position, embedding))
            dd, de, ee = dd + d2.sum(), de + np.sqrt(d2 * e2).sum(), ee + e2.sum()
        return pd.DataFrame({c: [x[c].iloc[0]] for c in by} | {"dd": [dd], "de": [de], "ee": [ee]})

    met = _against_all(_blocks(chosen, sizes.agg(F.max("n")).first()[0] or 0, key), chosen, by, work, f"{head}dd double, de double, ee double")
    sums = [F.sum(c).alias(c) for c in ("dd", "de", "ee")]
    total = met.groupBy(*by).agg(*sums) if by else met.agg(*sums)
    return total.join(sizes, by) if by else total.join(F.broadcast(sizes))


def kruskal(sums: DataFrame, by: list[str] = [], best: bool = True) -> DataFrame:  # noqa: B006
    """Stress from the three sums: with the best scale DE / EE, or with DE / DD (the one-site variant)."""
    if best:
        value = F.sqrt(F.greatest(1 - F.col("de") * F.col("de") / (F.col("dd") * F.col("ee")), F.lit(0.0)))
    else:
        beta = F.col("de") / F.col("dd")
        value = F.sqrt(F.greatest(F.col("dd") - 2 * beta * F.col("de") + beta * beta * F.col("ee"), F.lit(0.0)) / F.col("dd"))
    return sums.select(*by, value.alias("stress"))


def kruskal_bootstrap(points: DataFrame, key: str, position: list[str], embedding: list[str], draws: int, size: int, seed: int, best: bool = True) -> DataFrame:
    """s, stress for each of ``draws`` samples of ``size`` points with replacement; their mean is the score."""
    from .sampling import bootstrap, global_index

    placed = global_index(points.select(key, *dict.fromkeys(position + embedding)), [key], "idx")
    drawn = bootstrap(placed.count(), draws, size, seed, points.sparkSession).join(placed.drop(key), "idx")
    sums = distance_sums(drawn.select("s", F.col("m").alias("m"), *dict.fromkeys(position + embedding)), "m", position, embedding, ["s"])
    return kruskal(sums, ["s"], best)


def matching(shared: DataFrame, two_sided: bool = True) -> DataFrame:
    """i, j, n, foscttm: the share of points nearer than the true match, averaged; both directions if ``two_sided``.

    ``shared``: i, j, vec_id and aligned charts a0, a1 (of i) and b0, b1 (of j).
    """
    sizes = shared.groupBy("i", "j").agg(F.count("*").alias("n"))
    count = sizes.agg(F.max("n")).first()[0] or 0
    chosen = shared.select("i", "j", "vec_id", "a0", "a1", "b0", "b1")

    def work(x, others):
        a, b = x[["a0", "a1"]].to_numpy(float), x[["b0", "b1"]].to_numpy(float)
        true, nearer = ((b - a) ** 2)[:, 0] + ((b - a) ** 2)[:, 1], 0
        for y in others:
            nearer += int((_squared(b, y[["a0", "a1"]].to_numpy(float)) < true[:, None]).sum())
            if two_sided:
                nearer += int((_squared(a, y[["b0", "b1"]].to_numpy(float)) < true[:, None]).sum())
        return pd.DataFrame({"i": [x["i"].iloc[0]], "j": [x["j"].iloc[0]], "nearer": [nearer]})

    met = _against_all(_blocks(chosen, count, "vec_id"), chosen, ["i", "j"], work, "i int, j int, nearer long")
    total = met.groupBy("i", "j").agg(F.sum("nearer").alias("nearer")).join(sizes, ["i", "j"])
    share = F.col("nearer") / (F.col("n") * F.col("n") * (2 if two_sided else 1))
    return total.select("i", "j", "n", share.alias("foscttm"))
