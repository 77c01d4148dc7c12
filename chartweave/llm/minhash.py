"""Near-duplicates by b-bit MinHash.

Every text becomes a set of word shingles and FUNCTIONS minima. Full minima make the band
keys; of each minimum only BITS bits stay in the packed signature, and similarities are
estimated from signatures by bit counts, corrected for bits that agree by chance. A link
counts once it is confirmed on the full sets.

Which pairs are compared:

1. Equal sets are one class from the start, represented by its smallest id.
2. In each band bucket every member is estimated against the bucket's smallest member; each
   keeps its best such pair, which is confirmed. Components of these links follow.
3. Only buckets that still hold several components are left. A pair at the threshold must share
   one of the first few shingles of both sets in any common order (the prefix principle);
   with frequent shingles last, hardly any other pair does. Pairs across components that share
   one and pass the estimate are confirmed. Nothing is capped, and no bucket is paired out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, drop_rows, frequent, map_batches, numbered
from .components import connected_components
from .shingles import minima, mix, shingle_sets

WIDTH, THRESHOLD = 5, 80
#: With 28 bands of 4 minima a pair at 0.8 misses all buckets once in 2.5 million.
BANDS, ROWS, BITS = 28, 4, 2
FUNCTIONS = BANDS * ROWS
#: A signature of 112 minima strays from 0.8 by 0.045; the estimate passes pairs from 4.5 deviations below.
SLACK = 0.2
#: Order of the prefixes: counts on one document in four, and as many shingles as are listed as frequent.
ORDER_SAMPLE, ORDER_LISTED = 4, 1 << 18

#: Text that is hashed at once: the arrays take some 25 times its bytes.
HASHED_BYTES = 2 << 20

SIGNATURE = [f"s{k}" for k in range(2 * BITS)]


def sketches(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set, the packed signature and the band keys."""

    def make():
        def apply(batch):
            flat, sizes = shingle_sets(batch.column("data").to_pylist(), width)
            low = minima(flat, sizes, FUNCTIONS)
            firsts = np.minimum(np.cumsum(sizes) - sizes, max(len(flat) - 1, 0))
            sums = [np.add.reduceat(x, firsts) if len(flat) else np.zeros(len(sizes), np.uint64) for x in (flat, mix(flat))]
            out = {"doc_id": batch.column("doc_id"), "n_shingles": sizes}
            out |= {name: np.where(sizes > 0, x, 0).astype(np.uint64).view(np.int64) for name, x in zip(("key1", "key2"), sums)}
            for bit in range(BITS):
                plane = np.zeros((len(sizes), 128), np.uint8)
                plane[:, :FUNCTIONS] = low >> np.uint32(bit) & np.uint32(1)
                packed = np.packbits(plane, axis=1).view(np.int64)
                out |= {f"s{2 * bit + k}": packed[:, k] for k in range(2)}
            key = np.zeros((len(sizes), BANDS), np.uint64)
            for r in range(ROWS):
                key = mix(key * np.uint64(31) + low[:, r::ROWS])
            key += np.arange(BANDS, dtype=np.uint64)
            out["bands"] = list(mix(key).view(np.int64))
            return out

        return apply

    docs = documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    columns = ", ".join(f"{s} long" for s in SIGNATURE)
    return map_batches(docs, make, f"doc_id long, n_shingles long, key1 long, key2 long, {columns}, bands array<long>", HASHED_BYTES)


def estimate(a: str, b: str) -> Column:
    """Similarity of the signatures of columns with prefixes ``a`` and ``b``, corrected for chance."""
    differ = F.lit(0)
    for word in range(2):
        planes = [F.col(f"{a}s{2 * bit + word}").bitwiseXOR(F.col(f"{b}s{2 * bit + word}")) for bit in range(BITS)]
        every = planes[0]
        for plane in planes[1:]:
            every = every.bitwiseOR(plane)
        differ = differ + F.bit_count(every)
    chance = 0.5**BITS
    return ((FUNCTIONS - differ) / FUNCTIONS - chance) / (1 - chance)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _sizes_fit(a: Column, b: Column, threshold: int) -> Column:
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the threshold: 100 * intersection >= threshold * union."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def make():
        def apply(batch):
            good = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            keep = np.array(good, bool)
            return {c: batch.column(c).to_numpy()[keep] for c in ("a", "b")}

        return apply

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), make, "a long, b long")


def _full_sets(df: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """rep, shingles (packed sorted hashes) of the wanted documents, computed again from whole texts."""

    def make():
        def apply(batch):
            flat, sizes = shingle_sets(batch.column("data").to_pylist(), width)
            packed, ends = flat.tobytes(), (np.cumsum(sizes) * 8).tolist()
            return {"rep": batch.column("doc_id"), "shingles": [packed[a:b] for a, b in zip([0, *ends], ends)]}

        return apply

    docs = documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    found = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return map_batches(found, make, "rep long, shingles binary", HASHED_BYTES).dropDuplicates(["rep"])


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles of the most sampled sets, the most frequent last. Any list keeps the search exact; a good one keeps it short."""

    def make():
        def apply(batch):
            return {"shingle": np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()] or [np.empty(0, np.int64)])}

        return apply

    sample = sets.where(F.pmod(F.xxhash64("rep"), F.lit(ORDER_SAMPLE)) == 0).select("shingles")
    counted = map_batches(sample, make, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    return frequent(materialize(counted, "shingle-counts"), "shingle", ORDER_LISTED)[0][::-1]


def _prefixes(sets: DataFrame, frequent: np.ndarray, threshold: int) -> DataFrame:
    """rep, shingle, place: the first shingles of each set, as many as any partner at the threshold must meet."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def make():
        rank = np.argsort(shared.value, kind="stable")
        listed = shared.value[rank]

        def apply(batch):
            reps, shingles, places = [], [], []
            for rep, packed in zip(batch.column("rep").to_pylist(), batch.column("shingles").to_pylist()):
                own = np.frombuffer(packed, np.int64)
                weight = np.zeros(len(own), np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
                    weight = np.where(listed[at] == own, rank[at] + 1, 0)
                first = own[np.lexsort((own, weight))][: len(own) + threshold * -len(own) // 100 + 1]
                reps.append(np.full(len(first), rep))
                shingles.append(first)
                places.append(np.arange(len(first)))
            return {"rep": np.concatenate(reps), "shingle": np.concatenate(shingles), "place": np.concatenate(places)}

        return apply

    return map_batches(sets, make, "rep long, shingle long, place long")


def _across(sets: DataFrame, info: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a prefix shingle and pass the estimate.

    ``info``: rep, component, n_shingles and signature. For each shingle the component with most
    members need not be paired within: the others' members meet all members.
    """
    rows = _prefixes(sets, _frequent(sets), threshold).join(info.select("rep", "component", F.col("n_shingles").alias("n")), "rep")
    rows = materialize(rows, "prefixes")
    held = rows.groupBy("shingle", "component").count()
    most = held.groupBy("shingle").agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("components"))
    mixed = materialize(most.where("components > 1").select("shingle", F.col("most.component").alias("main")), "mixed")
    live = rows.join(mixed, "shingle")
    a, b = _prefixed(live.where("component <> main"), "a_"), _prefixed(live, "b_")
    need = F.ceil(threshold * (F.col("a_n") + F.col("b_n")) / (100 + threshold) - 1e-9)
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    meet = (
        (F.col("a_shingle") == F.col("b_shingle"))
        & (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("b_main")) | (F.col("a_rep") < F.col("b_rep")))
        & _sizes_fit(F.col("a_n"), F.col("b_n"), threshold)
        & (rest >= need)
    )
    pairs = a.join(b, meet).select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()
    return _estimated(pairs, info, threshold).select("a", "b")


def _estimated(pairs: DataFrame, info: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures come near it, with the estimate."""
    slim = info.select("rep", "n_shingles", *SIGNATURE)
    a, b = _prefixed(slim, "a_"), _prefixed(slim, "b_")
    met = pairs.join(a, F.col("a") == F.col("a_rep")).join(b, F.col("b") == F.col("b_rep"))
    near = _sizes_fit(F.col("a_n_shingles"), F.col("b_n_shingles"), threshold)
    return met.where(near).select("a", "b", estimate("a_", "b_").alias("estimate")).where(F.col("estimate") >= threshold / 100 - SLACK)


def near_duplicates(df: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (it is that id).

    Linked: 100 * |A and B| >= threshold * |A or B| on sets of ``width``-word shingles in lower case. A text
    of fewer words has its whole sequence as one shingle; null, empty and blank texts have
    no shingle and no link. Rows with the same id and text appear as often as they are given,
    with one result; a row without an id is linked with nothing and kept. Ties cannot occur: the
    smallest id stays.
    """
    sketch = materialize(sketches(df, width, id_col, text_col), "sketches")
    filled = sketch.where("n_shingles > 0")
    classes = filled.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    classes = materialize(classes, "classes")
    shared = classes.where("members > 1").select("key1", "key2", "rep")
    reps = filled.join(shared.withColumnRenamed("rep", "first"), ["key1", "key2"], "left").where("first is null or first = doc_id")
    reps = reps.withColumn("rep", F.col("doc_id")).dropDuplicates(["rep"])
    info = materialize(reps.select("rep", "n_shingles", *SIGNATURE, "bands"), "reps")
    rows = info.select("rep", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    members = materialize(rows.join(buckets.select("bucket", "first"), "bucket"), "members")
    slim = info.drop("bands")
    stars = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    best = _estimated(stars, slim, threshold).groupBy("b").agg(F.max(F.struct("estimate", F.col("a"))).alias("top")).select(F.col("top.a").alias("a"), "b")
    sets = materialize(_full_sets(df, members.select("rep").distinct(), width, id_col, text_col), "sets")
    links = materialize(confirm(best, sets, threshold), "links")
    labels = connected_components(links)
    joined = slim.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(joined, "placed")
    within = members.join(placed.select("rep", "component"), "rep")
    open_buckets = within.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    play = within.join(open_buckets, "bucket", "left_semi").select("rep").distinct()
    more = confirm(_across(materialize(sets.join(play, "rep", "left_semi"), "play"), placed, threshold), sets, threshold)
    labels = connected_components(links.unionByName(more))
    final = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"), "rep", "members")
    final = final.where("members > 1 or component <> rep").select("key1", "key2", "component")
    out = sketch.select("doc_id", "n_shingles", "key1", "key2").join(final, ["key1", "key2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``df`` with all its columns; the rest goes, row by row.

    The row with the smallest id stays - or, in a table with null or repeated ids, the one that comes
    first in the table. Rows without a word are linked with nothing and stay.
    """
    rows, key = numbered(df, id_col)
    gone = near_duplicates(rows, width, threshold, key, text_col).where("not kept").select("doc_id")
    return drop_rows(rows, key, gone).select(*df.columns)
