"""Periodic runs of words in linear time over an ordered alphabet (Ellert and Fischer).

A run's root that is smallest among its rotations is a Lyndon word, and the longest one that starts at its first
word, for the order of the words or for the reversed order. So the edges (i, next smaller suffix of i) of two
Lyndon arrays hold a root of every run. One sweep from left to right finds them by a stack of smaller
suffixes, and with each edge the length over which both its suffixes agree. Three rules keep the sweep linear: the
agreement with the next suffix on the stack follows from two known ones unless these are equal; within a stretch that was
already matched with an earlier one it is that of the earlier pair; and else words are compared from there on only. No suffix
array or tree, no hashing of word sequences; words are compared as whole numbers given in the order in which they turn up.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches

#: Words that a run has at least; its length is at least twice its period besides.
LEAST_LENGTH = 12
#: Text that is swept at once; lists of numbers take some 30 times its bytes.
SWEPT_BYTES = 2 << 20
#: Steps to the left that are compared for all edges together before single edges are followed.
TOGETHER = 6

RUNS = "runs array<struct<start:long,length:long,period:long>>"


def lyndon_edges(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one with a smaller suffix, and over how many places both suffixes agree.

    The last value of ``w`` must be smaller than all before it; it also ends the stack at place -1.
    """
    n = len(w)
    smaller, agree = [n - 1] * n, [0] * n  # of the next smaller suffix
    below, shared = [-1] * n, [0] * n  # of the nearest smaller suffix to the left, which is what the stack is made of
    a = b = end = 0  # w[a : a + end - b] == w[b:end] is the match that reaches farthest to the right
    for i in range(1, n):
        c, p = w[i], i - 1
        while w[p] > c:
            smaller[p] = i
            p = below[p]
        below[i] = p
        if w[p] < c or p < 0:
            continue
        known = 1
        while True:
            at = i + known
            if at < end and p >= b:
                old_p, old_i = p - b + a, i - b + a
                old = agree[old_p] if smaller[old_p] == old_i else shared[old_i] if below[old_i] == old_p else known
                if old > known:
                    known = min(old, end - i)
                    at = i + known
            while w[p + known] == w[at]:
                known += 1
                at += 1
            if at > end:
                a, b, end = p, i, at
            if w[p + known] < w[at]:
                break
            smaller[p], agree[p] = i, known
            other, p = shared[p], below[p]
            while p >= 0 and known < other:  # what left the stack agrees longer with the next: that is larger, too
                smaller[p], agree[p] = i, known
                other, p = shared[p], below[p]
            if known > other or p < 0:  # it agrees less long with the next: that is smaller
                known = other if p >= 0 else 0
                break
        below[i], shared[i] = p, known
    return smaller, agree


def find_runs_of(documents_words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of some word lists: bounds [lists + 1] of each list's rows, and rows [start, length, period] by start, then period.

    The lists are swept as one, each closed by a value smaller than all before it, so that nothing agrees across lists.
    """
    number = defaultdict(count().__next__).__getitem__
    upward: list[int] = []
    begins = []
    for k, words in enumerate(documents_words):
        begins.append(len(upward))
        upward += map(number, words)
        upward.append(-1 - k)
    if not upward:
        return np.zeros(1, np.int64), np.empty((0, 3), np.int64)
    w = np.array(upward, np.int64)
    top = int(w.max())
    downward = np.where(w >= 0, top - w, w).tolist()
    edges = [_promising(w, *lyndon_edges(values)) for values in (upward, downward)]
    i, j, right = (np.concatenate(x) for x in zip(*edges))
    order = np.argsort(i, kind="stable")
    last: dict[int, tuple[int, int]] = {}  # of each period, the last run
    matched: dict[int, tuple[int, int]] = {}  # of each period, the last stretch of places that equal those a period on
    found = []
    for at, to, agree in zip(i[order].tolist(), j[order].tolist(), right[order].tolist()):
        q = to - at
        start, end = last.get(q, (0, 0))
        if start <= at and to <= end:
            continue
        low, high = matched.get(q, (0, 0))
        x = at - 1
        while upward[x] == upward[x + q]:
            x = low - 1 if low <= x < high else x - 1
        matched[q] = x + 1, at
        start, end = x + 1, to + agree
        if end - start >= max(LEAST_LENGTH, 2 * q):
            last[q] = start, end
            found.append((start, end - start, q))
    rows = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    begins = np.array([*begins, len(upward)])
    bounds = np.searchsorted(rows[:, 0], begins)
    rows[:, 0] -= np.repeat(begins[:-1], np.diff(bounds))
    return bounds, rows


def _promising(w: np.ndarray, smaller: list[int], agree: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that agree to the right far enough for a run, or may with what agrees to the left."""
    i = np.flatnonzero(w >= 0)
    j, right = np.array(smaller)[i], np.array(agree)[i]
    q = j - i
    wanting = np.maximum(q, LEAST_LENGTH - q) - right
    for k in range(TOGETHER):
        keep = wanting <= k
        keep[~keep] = w[i[~keep] - 1 - k] == w[j[~keep] - 1 - k]
        i, j, right, wanting = i[keep], j[keep], right[keep], wanting[keep]
    return i, j, right


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), text: the words that stay, with one space between.

    Words are parted by [\\x20\\x09-\\x0D]. A run is a stretch with smallest period q, of max(LEAST_LENGTH, 2 q) words at least, that no
    neighbouring word extends; of each run the first q words stay, and a word goes if it lies behind them in any run. One row a row of
    ``df``, whatever its id (null, repeated); null and empty texts have no words. Rows never meet: no shuffle, and memory follows the
    longest text.
    """
    docs = documents(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))

    def make():
        def apply(batch):
            words = [text.split() for text in batch.column("data").to_pylist()]
            bounds, rows = find_runs_of(words)
            texts = []
            for k, own in enumerate(words):
                runs = rows[bounds[k] : bounds[k + 1]].tolist()
                if runs:
                    stays = bytearray(b"\1") * len(own)
                    for start, length, q in runs:
                        stays[start + q : start + length] = bytes(length - q)
                    own = [word for word, stay in zip(own, stays) if stay]
                texts.append(b" ".join(own))
            fields = [pa.array(rows[:, c]) for c in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            return {"doc_id": batch.column("doc_id"), "n_words": [len(x) for x in words], "runs": runs, "text": texts}

        return apply

    return map_batches(docs, make, f"doc_id long, n_words long, {RUNS}, text string", SWEPT_BYTES)


def digest_columns(collapsed: DataFrame) -> DataFrame:
    """The contract's columns of what collapse_runs returns; no Python."""
    ranked = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], (b["length"] - a["length"]).cast("int")).when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((a["period"] - b["period"]).cast("int")))
    longest = F.get(ranked, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        "longest.start",
        "longest.length",
        "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
