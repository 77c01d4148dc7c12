"""Exact deduplication by Grace hashing.

A record's content is its text without the white space of the contract. Records are
partitioned by a hash of the content - first over the cluster by a shuffle, then inside a
task to spill files, again and again with other bits - until a bucket fits an
open-addressing table, which compares complete contents.

Most contents stand alone. So hashes of all contents meet first, eight bytes each, and only records with a hash that
another record has, too, bring their contents along.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACES, documents, drop_rows, key_map, map_batches, numbered, release, slices

#: Bytes of content that a bucket may hold for its table; a larger one is partitioned again.
BUCKET_BYTES = 32 << 20
#: Spill files of each partitioning, and the bits of the hash that choose one.
FANOUT_BITS = 4
#: Bytes that wait for each spill file before they are written.
WRITE_BYTES = 64 << 10
#: A hot group's records go to so many tasks before its remaining records meet in one.
SALTS = 32


class OpenTable:
    """Linear probing over slots of (hash, content, summary); equal means equal content."""

    def __init__(self):
        self.slots: list = [None] * 64
        self.filled = 0
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, best: tuple, count: int) -> None:
        """Fold a record into its group: ``best`` is (-length, id is null, id), the smallest stays."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (slot := self.slots[at]) is not None:
            if slot[0] == digest and slot[1] == content:
                slot[2] = min(slot[2], best)
                slot[3] += count
                return
            at = (at + 1) & mask
        self.slots[at] = [digest, content, best, count]
        self.filled += 1
        self.bytes += len(content)
        if 3 * self.filled > 2 * len(self.slots):
            old, self.slots, self.filled, self.bytes = self.slots, [None] * (2 * len(self.slots)), 0, 0
            for slot in filter(None, old):
                self.add(*slot)

    def groups(self) -> Iterator[list]:
        return filter(None, self.slots)


def grace(records: Iterable[tuple], bucket_bytes: int = BUCKET_BYTES, depth: int = 0) -> Iterator[list]:
    """Groups [digest, content, best, count] of records (digest, content, best, count).

    Equal contents collapse as they come, so a bucket outgrows its bytes only by distinct
    contents; then what it holds and what follows goes to spill files by the hash's next
    bits. Contents of one digest cannot be parted by bits and are all compared.
    """
    held, records = OpenTable(), iter(records)
    limit = depth * FANOUT_BITS >= 8 * 32 - FANOUT_BITS
    for record in records:
        held.add(*record)
        if held.bytes > bucket_bytes and held.filled > 1 and not limit:
            break
    else:
        yield from held.groups()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [Path(folder, str(k)).open("wb+") for k in range(1 << FANOUT_BITS)]
        try:
            waiting = [[0] for _ in files]

            def flush(k: int) -> None:
                pickle.dump(waiting[k][1:], files[k])
                waiting[k] = [0]

            def put(record) -> None:
                place = int.from_bytes(record[0], "big") >> (256 - FANOUT_BITS * (depth + 1)) & (1 << FANOUT_BITS) - 1
                waiting[place].append(record)
                waiting[place][0] += len(record[1])
                if waiting[place][0] > WRITE_BYTES:
                    flush(place)

            for record in held.groups():
                put(record)
            del held
            for record in records:
                put(record)

            def read(spilled) -> Iterator[tuple]:
                spilled.seek(0)
                while True:
                    try:
                        yield from pickle.load(spilled)
                    except EOFError:
                        return

            for k, spilled in enumerate(files):
                flush(k)
                yield from grace(read(spilled), bucket_bytes, depth + 1)
                spilled.truncate(0)
        finally:
            for spilled in files:
                spilled.close()


#: A group as it travels: its content, the record that stays so far, and its members.
GROUP = "digest binary, content binary, length long, doc_id long, members long"


def _emit(groups: Iterator[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for digest, content, (length, unnamed, doc_id), count in groups:
        rows.append((digest, content, -length, None if unnamed else doc_id, count))
        size += len(content)
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def shared_hashes(docs: DataFrame) -> DataFrame:
    """key: the hashes that more than one record of ``docs`` (data) has; of each record eight bytes are shuffled."""

    def make():
        def apply(batch):
            return {"key": [_hash(hashlib.sha256(t.translate(None, SPACES)).digest()) for t in batch.column("data").to_pylist()]}

        return apply

    keys = map_batches(docs.select("data"), make, "key long")
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def _grouped(df: DataFrame, raw: bool, shared: Broadcast | None = None) -> DataFrame:
    """One row for each content of each partition; ``raw``: rows are documents and not groups yet, and only those on the map ``shared`` count."""
    schema = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("length", pa.int64()), ("doc_id", pa.int64()), ("members", pa.int64())])

    def rank(length, doc_id):
        return -length, doc_id is None, doc_id or 0

    def fresh(batches):
        bits = shared.value
        last = 8 * len(bits) - 1
        for batch in batches:
            for doc_id, text, length in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "length"))):
                content = text.translate(None, SPACES)
                digest = hashlib.sha256(content).digest()
                place = _hash(digest) & last
                if bits[place >> 3] >> (place & 7) & 1:
                    yield digest, content, rank(length, doc_id), 1

    def again(batches):
        for batch in batches:
            for digest, content, length, doc_id, members in zip(*(batch.column(c).to_pylist() for c in schema.names)):
                yield digest, content, rank(length, doc_id), members

    def run(batches):
        pieces = (piece for batch in batches for piece in slices(batch, "data" if raw else "content"))
        yield from _emit(grace((fresh if raw else again)(pieces)), schema)
        release()

    return df.mapInArrow(run, GROUP)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, length and doc_id of the row that stays, and members of each content that several rows have; of a few that one row has, besides.

    Hashes decide what can have a copy at all; a map of them, of bounded size, goes to every task. What is on it passes three Grace
    tables, each a stronger meeting: inside the input partitions (no shuffle), over
    (digest, salt), over the digest. Copies collapse before each shuffle, so a group that
    holds a third of all rows brings at most one row of each task, and SALTS at the end.
    """
    docs = documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"), F.length("text").cast("long").alias("length"))
    shared = df.sparkSession.sparkContext.broadcast(key_map(materialize(shared_hashes(docs), "shared-hashes")).tobytes())
    local = _grouped(docs, True, shared)
    salted = local.withColumn("salt", F.spark_partition_id() % SALTS).repartition("digest", "salt").drop("salt")
    met = _grouped(salted, False).repartition("digest")
    return _grouped(met, False)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digest (SHA-256 of the content) of every row; no shuffle."""

    def make():
        def apply(batch):
            data = (t.translate(None, SPACES) for t in batch.column("data").to_pylist())
            return {"doc_id": batch.column("doc_id"), "digest": [hashlib.sha256(d).digest() for d in data]}

        return apply

    docs = documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    return map_batches(docs, make, "doc_id long, digest binary")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty text; all empty texts are one group. The row with the most code
    points in its original text stays, on a tie the one with the smallest id; null ids come
    last. Rows that repeat both id and text count as members each and are all marked as the row they
    repeat. An empty table gives an empty result; further columns are ignored.

    The Grace tables decide the groups, comparing complete contents of all rows whose hash is not theirs alone. Their result has one row
    a content and carries its SHA-256, by which every document then finds its group.
    """
    found = groups(df, id_col, text_col).select("digest", F.col("doc_id").alias("keep_id"), F.col("members").alias("group_size"))
    rows = fingerprints(df, id_col, text_col)
    shared = found.where("group_size > 1")
    joined = rows.join(shared, "digest", "left")
    return joined.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each content, with all its columns; the rest of ``df`` goes, row by row.

    The row with the most code points stays, on a tie the one with the smallest id - or, in a
    table with null or repeated ids, the one that comes first in the table.
    """
    rows, key = numbered(df, id_col)
    gone = exact_duplicates(rows, key, text_col).where("not kept").select("doc_id")
    return drop_rows(rows, key, gone).select(*df.columns)
