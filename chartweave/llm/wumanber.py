"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and benchmark items are reduced to their words with one space between; the patterns
are windows of consecutive item words, with a space at either end. Patterns of similar length
share tables: SHIFT says, for the block of bytes that ends at the scan position, how far no
pattern can end; where it says zero, the block's bucket names the patterns that end so, and
bytes are compared directly.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, drop_rows, keep_rows, kept, map_batches, numbered

#: Words of a window; an item of fewer words is one window.
WINDOW_WORDS = 10
#: Bytes of item text whose tables one pass over the documents holds; more items take more passes.
#: A byte of item text takes some 20 to 50 bytes of tables, so a pass stays near 200 MB a worker.
PASS_BYTES = 4 << 20
#: Slots of a SHIFT table for each block of a pattern, and the longest shift that a slot's byte can hold.
SLOTS, FURTHEST = 4, 255

#: Bytes of words in lower case; any other byte is a space. Bytes from 0x80 belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ShiftTables:
    """SHIFT and buckets for patterns whose shortest has ``least`` bytes; all are searched by its first ``least``.

    Patterns are stretches of ``data``. SHIFT has a byte a slot; blocks that fall on one slot leave
    the smaller shift there, which finds no less. A bucket's patterns lie together in the order of slots.
    """

    def __init__(self, data: bytes, starts: list[int], sizes: list[int], names: list[int]):
        self.data = data
        self.least = least = min(sizes)
        self.block = block = max(2, min(12, least // 2 - 1))
        self.most = most = min(least - block + 1, FURTHEST)
        self.mask = mask = (1 << (SLOTS * len(starts) * (least - block + 1)).bit_length()) - 1
        self.shift = shift = bytearray([most]) * (mask + 1)
        suffix = []
        for start in starts:
            for end in range(block, least + 1):
                slot = hash(data[start + end - block : start + end]) & mask
                if least - end < shift[slot]:
                    shift[slot] = least - end
            suffix.append(slot)
        order = sorted(range(len(starts)), key=suffix.__getitem__)
        self.slots, self.starts, self.sizes, self.names = (array("q", [x[k] for k in order]) for x in (suffix, starts, sizes, names))

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """Every occurrence: where it starts and ends, and the pattern's name."""
        found, shift, mask, block, least, slots, data = [], self.shift, self.mask, self.block, self.least, self.slots, self.data
        at, length = least, len(text)
        while at <= length:
            slot = hash(text[at - block : at]) & mask
            skip = shift[slot]
            if skip:
                at += skip
                continue
            start, k = at - least, bisect_left(slots, slot)
            while k < len(slots) and slots[k] == slot:
                if text.startswith(data[self.starts[k] : self.starts[k] + self.sizes[k]], start):
                    found.append((start, start + self.sizes[k], self.names[k]))
                k += 1
            at += 1
        return found


class Contamination:
    """Finds windows of benchmark items in texts. Windows are stretches of the items' words, equal ones are one pattern."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = WINDOW_WORDS):
        lines, starts, ends, owners, at = [], [], [], [], 0
        for item_id, text in items:
            parts = words(text)
            if parts:
                n = min(width, len(parts))
                line = b" " + b" ".join(parts) + b" "
                edge = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                starts.append(at + edge[:-n])
                ends.append(at + edge[n:] + 1)
                owners.append(np.full(len(edge) - n, item_id))
                lines.append(line)
                at += len(line)
        data = b"".join(lines)
        starts, ends, owners = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (starts, ends, owners))
        digests = np.fromiter((hash(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
        _, first, name = np.unique(digests, return_index=True, return_inverse=True)
        other = [k for k, (a, b, f) in enumerate(zip(starts.tolist(), ends.tolist(), first[name].tolist())) if f != k and data[a:b] != data[starts[f] : ends[f]]]
        name[other] = len(first) + np.arange(len(other))  # one hash, another text: a pattern of its own
        first = np.concatenate([first, np.array(other, np.int64)])
        order = np.argsort(name, kind="stable")
        self.owners, self.begins = owners[order], np.searchsorted(name[order], np.arange(len(first) + 1))
        sizes = (ends - starts)[first]
        kind = np.frexp(sizes.astype(float))[1]
        self.tables = [ShiftTables(data, *(x[kind == k].tolist() for x in (starts[first], sizes, np.arange(len(first))))) for k in np.unique(kind)]

    def search(self, parts: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of word positions, end exclusive, and the items with an occurring window."""
        text = b" " + b" ".join(parts) + b" "
        found = [hit for table in self.tables for hit in table.search(text)]
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = np.searchsorted(spaces, [a for a, _, _ in found]).tolist()
        last = np.searchsorted(spaces, [b - 1 for _, b, _ in found]).tolist()
        names = {name for _, _, name in found}
        return sorted(set(zip(first, last))), set().union(*(self.owners[self.begins[n] : self.begins[n + 1]].tolist() for n in names))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def make():
        search = kept(key, lambda: Contamination(shared.value))

        def apply(batch):
            n_words, spans, ids = [], [], []
            for text in batch.column("data").to_pylist():
                parts = words(text)
                hit, owners = search.search(parts)
                n_words.append(len(parts))
                spans.append([{"first": a, "last": b} for a, b in merged(hit)])
                ids.append(sorted(owners))
            return {"doc_id": batch.column("doc_id"), "n_words": n_words, "spans": spans, "item_ids": ids}

        return apply

    schema = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, item_ids array<long>"
    return map_batches(docs, make, schema)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """item_id, data of the items with an id and a text, and the passes that their bytes take."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("data")).where("item_id is not null and data is not null")
    total = items.agg(F.sum(F.length("data"))).first()[0] or 0
    return items, -(-total // PASS_BYTES) or 1


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (hit ranges of word positions, ``last`` exclusive), item_ids.

    Null and empty texts have no words; an item without words has no window, one without an id or a text is left out; windows that
    items share count for each of them; repeated rows give repeated results. The items'
    bytes are summed first. Up to PASS_BYTES the tables go to every task; beyond it the
    items are dealt by a hash of their id into passes of about that size, one scan each of a written copy
    of the documents with row numbers, and the passes' spans are united per row.
    """
    items, passes = _items(benchmark, item_col, item_text_col)
    docs = documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    if passes == 1:
        return _scan(docs, [tuple(r) for r in items.collect()])
    docs = materialize(docs.withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    parts = []
    for k in range(passes):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()]
        keyed = docs.select(F.col("row_id").alias("doc_id"), "data")
        parts.append(materialize(_scan(keyed, own), "pass").withColumnRenamed("doc_id", "row_id"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    spans = union.groupBy("row_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    joined = spans.join(docs.select("row_id", "doc_id"), "row_id")

    def make():
        def apply(batch):
            pairs = [merged([(s["first"], s["last"]) for s in row]) for row in batch.column("spans").to_pylist()]
            return {c: batch.column(c) for c in ("doc_id", "n_words", "item_ids")} | {"spans": [[{"first": a, "last": b} for a, b in row] for row in pairs]}

        return apply

    schema = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, item_ids array<long>"
    return map_batches(joined.select("doc_id", "n_words", "spans", "item_ids"), make, schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns of what find_contamination returns; no Python."""
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_span: int = 1) -> DataFrame:
    """The rows of ``df`` without a run of ``least_span`` words that lie in benchmark windows, with all their columns.

    Items of one pass are searched where each row is read, without a shuffle and whatever its id; more passes meet by row.
    """
    items, passes = _items(benchmark, "item_id", "text")
    if passes > 1:
        rows, key = numbered(df, id_col)
        found = find_contamination(rows, benchmark, key, text_col)
        hit = found.where(F.exists("spans", lambda s: s["last"] - s["first"] >= least_span)).select("doc_id")
        return drop_rows(rows, key, hit).select(*df.columns)
    shared, name = df.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex

    def make():
        search = kept(name, lambda: Contamination(shared.value))

        def apply(texts):
            spans = (merged(search.search(words(text.encode("utf-8", "surrogatepass")))[0]) for text in texts)
            return [all(b - a < least_span for a, b in own) for own in spans]

        return apply

    return keep_rows(df, make, text_col)
