"""What the operators share: documents in, Arrow batches through a function, held-out folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Columns whose bytes decide how a batch is cut.
LARGE = ("text", "data", "shingles", "sa", "content")
#: Bytes of text that one call of a batch function sees at most (one text may exceed it).
BATCH_BYTES = 8 << 20

#: ASCII white space of the contracts: space and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows of a histogram that comes to the driver.
HISTOGRAM = 4_096

#: Rows to take away whose ids are broadcast (some 64 MB as a hash table); more of them meet the table in a shuffle.
BROADCAST_ROWS = 500_000


#: Bits of the key map for each shared key, and at most (32 MB). A fuller map passes more lines and loses none.
MAP_BITS, MAP_MOST = 16, 1 << 28
#: Positions that one row of the map's aggregate holds (fixed by bitmap_construct_agg).
MAP_ROW = 1 << 15


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator needs, as ``doc_id`` long and ``text`` (null: empty).

    Other columns, whatever their names, are left behind here and so cannot clash.
    """
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *(F.col(c) for c in more),
    )


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the folds of the contracts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``most`` bytes of text."""
    if not batch.num_rows:
        return
    values = batch.column(batch.schema.get_field_index(column))
    if not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        values = values.cast(pa.string())
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0))
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def release() -> None:
    """Give back what this worker process freed. Workers are used again by later stages, and would else keep the largest task's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others give memory back themselves
    if trim:
        trim(0)


#: What this worker process keeps between tasks, by name, and the names that its present task asked for.
_kept: dict = {}
_asked: set = set()


def kept(name, build: Callable):
    """``build()``, made once in this worker process. To be asked for in a ``make()``: a task that does not ask drops it."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = build()
    return _kept[name]


def begin(make: Callable[[], Callable]) -> Callable:
    """``make()`` of a task. What the worker kept for stages that are over goes, else tables of all stages add up."""
    _asked.clear()
    made = make()
    over = _kept.keys() - _asked
    for name in over:
        del _kept[name]
    if over:
        release()
    return made


def stream_batches(df: DataFrame, make: Callable[[], Callable], schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``make()`` runs once in each task and gives a function from the task's RecordBatches, as an iterator, to an iterator of
    {column: array-like}; so rows can wait for others of their task.

    Batches that hold much text come in pieces, so memory follows the longest text and not the batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    sized = next((c for c in LARGE if c in df.columns), None)

    def run(batches):
        pieces = (batch for whole in batches for batch in (slices(whole, sized, batch_bytes) if sized else [whole]) if batch.num_rows)
        for out in begin(make)(pieces):
            yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in kinds], schema=kinds)
        pieces = out = None
        release()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``make()`` runs once in each task and gives a function from a RecordBatch to {column: array-like}; batches as in stream_batches."""

    def each():
        apply = make()
        return lambda pieces: map(apply, pieces)

    return stream_batches(df, each, schema, batch_bytes)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(df: DataFrame, make: Callable[[], Callable], text_col: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of ``df`` that a function takes, with all columns as they are; no shuffle.

    ``make()`` runs once in each task and gives a function from a list of whole texts (null: empty) to
    booleans. Every row is judged by itself, whatever its other columns hold or are called.
    """

    def run(batches):
        apply = begin(make)
        for whole in batches:
            for batch in slices(whole, text_col, batch_bytes):
                texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()]
                yield batch.filter(pa.array(apply(texts), pa.bool_()))
        apply = whole = batch = texts = None
        release()

    return df.mapInArrow(run, df.schema)


def numbered(df: DataFrame, id_col: str, by_id: bool = False) -> tuple[DataFrame, str]:
    """``df`` and the column that tells its rows apart.

    That is the id where it is never null and never repeated; else a row number, which a written copy
    of ``df`` then carries as a further column. With ``by_id`` row numbers ascend with the ids, null ids last; the copy is sorted by
    ranges in which a repeated id may be cut.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    rows, distinct = ids.agg(F.count("*"), F.count_distinct("id")).first()
    if rows == distinct:
        return df, id_col
    name = unused(df, "row_number")
    if by_id:
        order = [F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(name)]
        df = df.withColumn(name, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def drop_rows(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in the one column of ``gone``.

    ``gone`` is written and counted first: up to BROADCAST_ROWS it goes to every task and ``df`` stays where it is.
    """
    name = unused(df, "gone")
    gone = materialize(gone.toDF(name), "gone")
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col(key).cast("long") == F.col(name), "left_anti")


def key_map(keys: DataFrame, probes: int = 1) -> np.ndarray:
    """Bytes of a map with ``probes`` bits for each of ``keys``, which folds them by their low bits; MAP_MOST bits at most. A full map finds too much and misses nothing."""
    bits = min(MAP_MOST, max(MAP_ROW, 1 << (MAP_BITS * keys.count()).bit_length()))
    last = F.lit(bits - 1)
    place, step = F.col("key").bitwiseAND(last), F.shiftright("key", 32).bitwiseAND(last)
    more = [(place + k * step).bitwiseAND(last) for k in range(1, probes)]
    place = keys.select((F.explode(F.array(place, *more)) if more else place).alias("place"))
    rows = place.groupBy(F.floor(F.col("place") / MAP_ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("place") % MAP_ROW).alias("map")).toArrow()
    out = np.zeros((bits // MAP_ROW, MAP_ROW // 8), np.uint8)
    for row, data in zip(rows.column("row").to_pylist(), rows.column("map").to_pylist()):
        out[row] = np.frombuffer(data, np.uint8)
    return out.ravel()


def on_map(bits: np.ndarray, keys: np.ndarray, probes: int = 1) -> np.ndarray:
    """Which of ``keys`` (signed 64-bit hashes) have all their bits on a key_map of as many ``probes``."""
    last = np.int64(8 * len(bits) - 1)
    place, step, found = keys & last, keys >> np.int64(32) & last, np.ones(keys.shape, bool)
    for _ in range(probes):
        found &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        place = place + step & last
    return found


def frequent(counts: DataFrame, word: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of the most frequent words, in descending order, equal counts by the word; ``most`` at most.

    ``counts`` is a written table (word long, n long). All of it is listed if it has no more rows; else every word that occurs at least t times, for the smallest t
    that so many words reach - of words that tie below it none. Histograms of HISTOGRAM rows at most find t, so no task sorts the table; one
    is enough unless more than ``most`` words occur as often as that.
    """
    low, above, high = 1, 0, None  # ``above`` words, not too many, reach high; too many reach low
    while high is None or low + 1 < high:
        width = 1 if high is None else -(-(high - low) // HISTOGRAM)
        place = F.least(F.floor((F.col("n") - low) / width), F.lit(HISTOGRAM - 1))
        rows = (counts if high is None else counts.where((F.col("n") >= low) & (F.col("n") < high))).groupBy(place.alias("place")).agg(F.count("*").alias("words"), F.max("n").alias("n")).collect()
        top = high or max((r["n"] for r in rows), default=0) + 1
        for row in sorted(rows, reverse=True):
            if above + row["words"] > most:
                last = row["place"] == HISTOGRAM - 1
                low, high = low + row["place"] * width, top if last else min(top, low + (row["place"] + 1) * width)
                break
            above += row["words"]
        else:  # all that are left fit
            high = low
            break
    low = high
    found = counts.where(F.col("n") >= low).select(word, "n").toArrow()
    words, n = found.column(word).to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((words, -n))
    return words[order], n[order]
