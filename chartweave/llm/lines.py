"""Line deduplication by a deletion-neighbourhood join.

Lines within one edit - a word inserted, deleted or replaced - share a variant: the line itself
or the line less one word. Variants are hashed keys; lines with an equal key meet in
aggregates, the earliest line of each key wins, and the edit distance of each winner
and loser is verified on their words.

Variants of all lines would be as many as the corpus has words. A filter that loses nothing goes
first: a line of n words has as keys its first and its last k words for k = n // 2 and (n - 1) // 2. Of
two lines within one edit, the shorter of n words, either the first or the last n // 2 words
are the same, and both lines have them as a key. Keys that different lines share set bits of a map of bounded size, PROBES each;
only lines with a key on it emit their variants.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, key_map, map_batches, numbered, on_map
from .shingles import constants, hashed_words, mix

#: Equal lines of at least so many words go, so only blank ones stay; one edit counts from NEAR_WORDS words on.
LEAST_WORDS, NEAR_WORDS = 1, 8
#: Scripts written without spaces (Thai to Tibetan, Myanmar, Khmer, kana, Han and their extensions): each code point is a word.
UNSPACED = re.compile("[฀-໿ༀ-࿿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
#: All bytes but those that code points of these scripts begin with in UTF-8.
OTHERS = bytes(b for b in range(256) if b not in (0xE0, 0xE1, 0xEF, 0xF0) and not 0xE3 <= b <= 0xE9)
#: The contract's white space as a space.
SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: Bits of the map for a key. With one, a line of keys that nothing shares has one of them on it by chance in some 15 of 100 cases, with four in less than one.
PROBES = 4
#: Text that is hashed at once; the arrays take some 25 times its bytes.
HASHED_BYTES = 2 << 20
AHEAD, BEHIND, SIDE, LENGTH, STEP = constants(21, 5)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def spread(text: bytes) -> bytes:
    """The text with spaces around the code points of scripts that have none."""
    if not text.translate(None, OTHERS):
        return text
    return UNSPACED.sub(r" \g<0> ", text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


class Lines:
    """The lines of a batch of texts: word hashes, and where each line's words begin. O(words) throughout."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n" + b"\n".join(map(spread, texts)) + b"\n"
        self.breaks = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)
        starts, self.hashes = hashed_words(np.frombuffer(self.raw.translate(SPACED), np.uint8))
        begin = np.searchsorted(starts, self.breaks)
        self.begin, self.n = begin[:-1], np.diff(begin)
        held = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        self.text = np.repeat(np.arange(len(texts)), held)
        self.number = np.arange(len(self.n)) - np.repeat(np.cumsum(held) - held, held)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.begin, self.n)

    def _sums(self, place: np.ndarray, by: np.uint64) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes + (place + 1).astype(np.uint64) * by))])

    def ids(self) -> np.ndarray:
        """A hash of each line's words and their order."""
        self.ahead = self._sums(self.place, AHEAD)
        return mix(self.ahead[self.begin + self.n] - self.ahead[self.begin] + self.n.astype(np.uint64) * LENGTH).view(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """[lines, 4] hashes of first and last words, and which of them count; call after ids."""
        behind = self._sums(np.repeat(self.n, self.n) - 1 - self.place, BEHIND)
        keys, counts = np.zeros((len(self.n), 4), np.uint64), np.zeros((len(self.n), 4), bool)
        end, near = self.begin + self.n, self.n >= NEAR_WORDS
        for half in range(2):
            k = np.maximum(self.n - half, 0) // 2
            tag = (2 * k).astype(np.uint64)
            keys[:, 2 * half] = mix(self.ahead[self.begin + k] - self.ahead[self.begin] + tag * SIDE)
            keys[:, 2 * half + 1] = mix(behind[end] - behind[end - k] + (tag + np.uint64(1)) * SIDE)
            counts[:, 2 * half : 2 * half + 2] = (near if half == 0 else near & (self.n % 2 == 0))[:, None]
        return keys.view(np.int64), counts

    def variants(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all lines, then of every line less each of its words."""
        powers = np.cumprod(np.full(int(self.n.max(initial=0)) + 1, STEP), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[self.place])])
        total = sums[self.begin + self.n] - sums[self.begin]
        line = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(self.hashes))
        left = sums[at] - sums[self.begin[line]] + (sums[self.begin[line] + self.n[line]] - sums[at + 1]) * STEP_BACK
        size = self.n.astype(np.uint64)
        return mix(total + size * LENGTH).view(np.int64), mix(left + (size[line] - np.uint64(1)) * LENGTH).view(np.int64)


def within_one_edit(a: list, b: list) -> bool:
    """Word edit distance at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts.sum(1))]).astype(np.int32)), pa.array(values[counts]))


def _data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(df, id_col, text_col).where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("data"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (hash of its words), keys of every line with enough words."""

    def make():
        def apply(batch):
            lines = Lines(batch.column("data").to_pylist())
            ids, (keys, counts) = lines.ids(), lines.keys()
            use = lines.n >= LEAST_WORDS
            return {"doc_id": batch.column("doc_id").take(pa.array(lines.text[use])), "line_no": lines.number[use], "line": ids[use], "keys": _lists(keys[use], counts[use])}

        return apply

    return map_batches(docs, make, "doc_id long, line_no long, line long, keys array<long>", HASHED_BYTES)


def _close_lines(docs: DataFrame, key_map: np.ndarray) -> DataFrame:
    """line, doc_id, line_no, data: the first place and the text of every line with a key on the map."""
    shared = docs.sparkSession.sparkContext.broadcast(key_map)

    def make():
        bits = shared.value

        def apply(batch):
            lines = Lines(batch.column("data").to_pylist())
            ids, (keys, counts) = lines.ids(), lines.keys()
            found = np.flatnonzero((counts & on_map(bits, keys, PROBES)).any(1))
            data = [lines.raw[a + 1 : b] for a, b in zip(lines.breaks[found].tolist(), lines.breaks[found + 1].tolist())]
            return {"line": ids[found], "doc_id": batch.column("doc_id").take(pa.array(lines.text[found])), "line_no": lines.number[found], "data": data}

        return apply

    found = map_batches(docs, make, "line long, doc_id long, line_no long, data binary", HASHED_BYTES)
    return found.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "data")).alias("first")).select("line", "first.*")


def _variants(texts: DataFrame, key_map: np.ndarray | None = None) -> DataFrame:
    """variant, gone (the word left out, -1 for the whole line), doc_id, line_no; with a map only the variants on it."""
    shared = None if key_map is None else texts.sparkSession.sparkContext.broadcast(key_map)

    def make():
        bits = shared and shared.value

        def apply(batch):
            lines = Lines(batch.column("data").to_pylist())
            whole, less = lines.variants()
            variant = np.concatenate([whole, less])
            own = np.concatenate([np.arange(len(whole)), np.repeat(np.arange(len(whole)), lines.n)])
            gone = np.concatenate([np.full(len(whole), -1), lines.place])
            if bits is not None:
                found = on_map(bits, variant, PROBES)
                variant, own, gone = variant[found], own[found], gone[found]
            return {"variant": variant, "gone": gone, "doc_id": batch.column("doc_id").take(pa.array(own)), "line_no": batch.column("line_no").take(pa.array(own))}

        return apply

    return map_batches(texts.select("doc_id", "line_no", "data"), make, "variant long, gone int, doc_id long, line_no long", HASHED_BYTES)


def _place(prefix: str = ""):
    return F.struct(F.col(prefix + "doc_id"), F.col(prefix + "line_no"))


def _near_lines(texts: DataFrame) -> DataFrame:
    """line: those of ``texts`` that an earlier one is one edit away from."""
    spans = (f(c).alias(f.__name__ + c) for c in ("doc_id", "line_no") for f in (F.min, F.max))
    met = _variants(texts).groupBy("variant").agg(*spans).where("mindoc_id < maxdoc_id or minline_no < maxline_no").select("variant")
    met = materialize(met, "met")
    live = materialize(_variants(texts, key_map(met.withColumnRenamed("variant", "key"), PROBES)).join(met, "variant"), "variants")
    replaced = live.where("gone >= 0").groupBy("variant", "gone").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first < last")
    whole = F.when(F.col("gone") < 0, _place())
    part = F.when(F.col("gone") >= 0, _place())
    changed = live.groupBy("variant").agg(F.min(whole).alias("whole"), F.min(part).alias("part")).where("whole is not null and part is not null")
    first = live.join(replaced.drop("last"), ["variant", "gone"]).select("doc_id", "line_no", "first")
    second = live.join(changed, "variant").select("doc_id", "line_no", F.when(F.col("gone") < 0, F.col("part")).otherwise(F.col("whole")).alias("first"))
    pairs = first.unionByName(second).where(F.col("first") < _place()).groupBy("doc_id", "line_no").agg(F.min("first").alias("first"))
    pairs = pairs.select("doc_id", "line_no", F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("n"))
    other = texts.select(F.col("doc_id").alias("d"), F.col("line_no").alias("n"), F.col("data").alias("other"))

    def verify():
        def apply(batch):
            good = [within_one_edit(a.split(), b.split()) for a, b in zip(batch.column("data").to_pylist(), batch.column("other").to_pylist())]
            return {"line": batch.column("line").to_numpy()[np.array(good, bool)]}

        return apply

    return map_batches(pairs.join(texts, ["doc_id", "line_no"]).join(other, ["d", "n"]).select("line", "data", "other"), verify, "line long").distinct()


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no of every line that goes.

    A line goes if an earlier one (by doc_id, then line number from 0) has equal words, or has
    NEAR_WORDS words at least, like itself, and is one word edit away. Lines are split at line feeds;
    [\\x20\\x09-\\x0D] only separates words, and of scripts without spaces each code point is a word. Blank lines, null and
    empty texts lose nothing. The result names a line by its document's id, so rows without one are left out and rows that repeat one are the
    same lines; dedup_lines tells such rows apart. A group of equal lines or of lines with a common variant meets only in combined
    aggregates and in joins, whatever its size. Lines meet the verdicts as a written table, so a join of two plain shuffles, which adaptive
    execution cuts where a line is very frequent.
    """
    docs = _data(df, id_col, text_col)
    lines = materialize(_lines(docs), "lines")
    keys = lines.select(F.explode("keys").alias("key"), "line")
    met = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("key")
    texts = materialize(_close_lines(docs, key_map(materialize(met, "keys"), PROBES)), "close-lines")
    near = _near_lines(texts).withColumn("near", F.lit(True))
    firsts = lines.groupBy("line").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    verdict = materialize(firsts.join(near, "line", "left").where("n > 1 or near").select("line", "first", "near"), "verdicts")
    return lines.select("doc_id", "line_no", "line").join(verdict, "line").where(F.col("near") | (_place() != F.col("first"))).select("doc_id", "line_no").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every text without its duplicate lines; one row a row of ``df``.

    Lines go row by row. Where ids are null or repeated, rows are numbered in the order of ids, null ids last: a line goes from a row
    if it stands in an earlier row or line, whatever other rows of the same id lose.
    """
    rows, key = numbered(df, id_col, by_id=True)
    gone = duplicate_lines(rows, key, text_col).groupBy(F.col("doc_id").alias("row")).agg(F.collect_set("line_no").alias("numbers"))
    own = rows.select(F.col(key).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = own.join(gone, "row", "left").drop("row")

    def make():
        def apply(batch):
            texts, counts, dropped = [], [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist()):
                split, numbers = text.split("\n"), set(numbers or ())
                texts.append("\n".join(x for k, x in enumerate(split) if k not in numbers))
                counts.append(len(split))
                dropped.append(len(numbers))
            return {"doc_id": batch.column("doc_id"), "text": texts, "n_lines": counts, "n_dropped": dropped}

        return apply

    return map_batches(docs, make, "doc_id long, text string, n_lines long, n_dropped long")


def digest_columns(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
