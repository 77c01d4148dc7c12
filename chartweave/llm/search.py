"""Ranked lexical search over document-sharded postings with integer impacts.

The index is a table: a row holds a block of documents as compressed sparse rows, term by term - the block's terms in
order, where each term's postings begin, and for each posting the document's place in the block and its impact, a
whole number that needs only the document and the mean length. A search first sums the query terms' postings to document
frequencies, reading the columns of terms and bounds alone. Then each block adds weight times impact term after term into a dense
array of its documents, keeps the best of each query, and the blocks' best meet.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, map_batches

#: Text of one block: its postings are sorted at once, and its scores are one array.
BLOCK_BYTES = 4 << 20
#: Bytes of query text that one pass over the index answers; more queries take more passes.
PASS_BYTES = 4 << 20
#: The share of length in the document's part of a score, in hundredths, and the scales of impact and weight.
LENGTH_SHARE, SATURATION, IMPACT_SCALE, WEIGHT_SCALE = 90, 8, 1_000_000_000, 1000
#: Parts that the merge of a query's best is dealt over before they meet.
MERGE_PARTS = 64
#: Stands for a null id inside a block, and sorts last.
NO_ID = np.iinfo(np.int64).max

#: Bytes of terms, with A-Z in lower case; any other byte is a space. Bytes from 0x80 belong to terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX_SCHEMA = "ids binary, terms binary, bounds binary, places binary, impacts binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Index:
    """``blocks`` (INDEX_SCHEMA) with the number of documents that have a term, and the sum of their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def _data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))


def _lengths(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with their repeats, over all documents."""

    def make():
        def apply(batch):
            n = [len(terms_of(text)) for text in batch.column("data").to_pylist()]
            return {"documents": [sum(x > 0 for x in n)], "terms": [sum(n)]}

        return apply

    sums = map_batches(docs.select("data"), make, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Of each posting, whole numbers throughout; at most IMPACT_SCALE / 1000."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // terms
    return (IMPACT_SCALE * tf) // (1000 * tf + SATURATION * m)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of every row of ``df``, written to the shared folder; no shuffle.

    Two passes over the text: lengths, then postings. Rows without a term are in no posting. Each row is a document
    of its own, whatever its id (null, repeated).
    """
    docs = _data(df, id_col, text_col)
    n_docs, n_terms = _lengths(docs)

    def make():
        def apply(batch):
            number: defaultdict = defaultdict(count().__next__)
            lengths, numbers = [], []
            for text in batch.column("data").to_pylist():
                own = terms_of(text)
                lengths.append(len(own))
                numbers.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
            size = len(lengths)
            n = np.array(lengths, np.int64)
            keys, tf = np.unique(np.concatenate(numbers) * size + np.repeat(np.arange(size), n), return_counts=True)
            term, place = keys // size, keys % size
            bounds = np.searchsorted(term, np.arange(len(number) + 1)).astype(np.int32)
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID), np.int64)
            parts = ids, bounds, place.astype(np.int32), impacts_of(tf, n[place], n_docs, max(n_terms, 1)).astype(np.int32)
            ids, bounds, place, impacts = (pa.array([x.tobytes()], pa.binary()) for x in parts)
            return {"ids": ids, "terms": [b" ".join(number)], "bounds": bounds, "places": place, "impacts": impacts}

        return apply

    return Index(materialize(map_batches(docs, make, INDEX_SCHEMA, BLOCK_BYTES), "postings"), n_docs, n_terms)


def _frequencies(index: Index, wanted: DataFrame) -> dict[bytes, int]:
    """term -> documents that hold it, over all blocks, for the terms of one pass."""
    shared = index.blocks.sparkSession.sparkContext.broadcast({r[0] for r in wanted.collect()})

    def make():
        terms = shared.value

        def apply(batch):
            names, counts = [], []
            for line, bounds in zip(batch.column("terms").to_pylist(), batch.column("bounds").to_pylist()):
                sizes = np.diff(np.frombuffer(bounds, np.int32)).tolist()
                for term, size in zip(line.split(b" "), sizes):
                    if term in terms:
                        names.append(term)
                        counts.append(size)
            return {"term": names, "n": counts}

        return apply

    found = map_batches(index.blocks.select("terms", "bounds"), make, "term binary, n long")
    return {bytes(r[0]): r[1] for r in found.groupBy("term").agg(F.sum("n")).collect()}


def weight(documents: int, frequency: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * frequency + 1)))


def best_places(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores above 0, equal scores by the smaller id: argpartition finds the least score that counts, and all that tie with it are ordered."""
    if len(scores) > most:
        least = max(scores[np.argpartition(scores, len(scores) - most)[len(scores) - most]], 1)
        found = np.flatnonzero(scores >= least)
    else:
        found = np.flatnonzero(scores > 0)
    return found[np.lexsort((ids[found], -scores[found]))[:most]]


def _block_best(index: Index, queries: list[tuple[int, list[tuple[bytes, int]]]], most: int) -> DataFrame:
    """query, doc_id, score: the best of each block and query. ``queries``: number and weighted terms."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries)

    def make():
        asked = shared.value
        known = {term for _, own in asked for term, _ in own}

        def apply(batch):
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids, bounds, places, impacts = (np.frombuffer(row[c], kind) for c, kind in (("ids", np.int64), ("bounds", np.int32), ("places", np.int32), ("impacts", np.int32)))
                at = {term: k for k, term in enumerate(row["terms"].split(b" ")) if term in known}
                scores = np.empty(len(ids), np.int64)
                for number, own in asked:
                    scores.fill(0)
                    for term, w in own:
                        k = at.get(term)
                        if k is not None:  # a document stands once among a term's postings
                            scores[places[bounds[k] : bounds[k + 1]]] += np.int64(w) * impacts[bounds[k] : bounds[k + 1]]
                    best = best_places(scores, ids, most)
                    out.append((np.full(len(best), number), ids[best], scores[best]))
            query, doc_id, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
            return {"query": query, "doc_id": pa.array(doc_id, mask=doc_id == NO_ID), "score": score}

        return apply

    return map_batches(index.blocks, make, "query long, doc_id long, score long")


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query: first within MERGE_PARTS parts, then of these; tasks cut their own rows before either shuffle."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    for keys in (["query", "part"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return found.drop("part")


def search(index: Index, items: DataFrame, most: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``most`` documents with the highest score above 0, equal scores by ascending id, null ids last.

    An item's score of a document sums weight times impact over its distinct terms. Rows that repeat an item with its text count
    once; one id with two texts has a ranking for each; items with a null id, a null text or no term, and terms that no document holds, give
    nothing. Items are dealt by a hash of their id into passes of PASS_BYTES of text, whose terms and weights go to every task.
    """
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("data")).where("item_id is not null and data is not null").distinct()
    items = materialize(items.withColumn("query", F.monotonically_increasing_id()), "items")
    passes = -(-(items.agg(F.sum(F.length("data"))).first()[0] or 0) // PASS_BYTES) or 1

    def make():
        def apply(batch):
            pairs = [(number, term) for number, text in zip(batch.column("query").to_pylist(), batch.column("data").to_pylist()) for term in dict.fromkeys(terms_of(text))]
            return {"query": [p[0] for p in pairs], "term": [p[1] for p in pairs]}

        return apply

    asked = materialize(map_batches(items.select("query", "data"), make, "query long, term binary"), "asked")
    parts = []
    for k in range(passes):
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == k)
        weights = {term: weight(index.documents, n) for term, n in _frequencies(index, own.select("term").distinct()).items()}
        queries: defaultdict = defaultdict(list)
        for number, term in own.orderBy("query", "term").collect():
            if bytes(term) in weights:
                queries[number].append((bytes(term), weights[bytes(term)]))
        best = _merged(_block_best(index, list(queries.items()), most), most)
        parts.append(best if passes == 1 else materialize(best, "best"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
