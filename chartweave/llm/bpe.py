"""Byte-level BPE by ranks: encoding with a segment tree over byte positions, and decoding.

Each leaf of the tree holds the rank of the pair that starts at its byte position; the root
gives the leftmost smallest rank. A merge changes three leaves (the merged part, its live
predecessor and the part that is swallowed) and their ancestors: logarithmic work a merge,
so a piece of a million bytes without a space is no worse than its words.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import documents, kept, map_batches

#: No pair here.
FREE = 1 << 60
#: Pieces kept with their ids in each Python worker, before the memory starts anew.
KEPT_PIECES = 200_000
#: And so many of their characters; longer memories go after the batch that made them.
KEPT_CHARS = 8 << 20
#: Text that is cut into pieces at once; as strings these take some 20 times its bytes.
ENCODED_BYTES = 512 << 10
#: From so many bytes on, or in groups smaller than LOCKSTEP, a piece gets a tree of its own.
LONG = 256
LOCKSTEP = 24


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankTable:
    """Token bytes of an id, and the id that two neighbouring ids merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = dict(map(reversed, ranks.items()))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], FREE)
        self.merged = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], FREE)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; FREE where there is none (a negative id is no part)."""
        want = left << 20 | right
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.merged[at], FREE)


def merge_one(piece: bytes, table: RankTable) -> list[int]:
    """Ids of one piece by its own tree."""
    n = len(piece)
    ids = [int(table.byte_id[b]) for b in piece]
    size = 1 << max(0, n - 1).bit_length()
    tree, pairs = [FREE] * (2 * size), table.pairs
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, j: int) -> None:
        rank = pairs.get(ids[i] << 20 | ids[j]) if j < n else None
        node, value = size + i, FREE if rank is None else rank * size + i
        while node and tree[node] != value:
            tree[node] = value
            node >>= 1
            if node:
                value = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] < FREE:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        ids[at], after[at] = rank, after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        ids[gone] = -1
        put(gone, n)
        put(at, after[at])
        if before[at] >= 0:
            put(before[at], at)
    return [i for i in ids if i >= 0]


def merge_many(data: bytes, lengths: np.ndarray, size: int, table: RankTable) -> tuple[bytes, np.ndarray]:
    """Packed ids of the pieces that lie one after the other in ``data``, and how many ids each has.

    Each piece has 2 to ``size`` bytes (a power of two). One tree a row, all merged in lockstep.
    """
    count, none = len(lengths), np.int32(2**31 - 1)
    inside = np.arange(size) < lengths[:, None]
    ids = np.full((count, size + 1), -1, np.int32)  # the last column stands for "past the end"
    ids[:, :size][inside] = table.byte_id[np.frombuffer(data, np.uint8)]
    place = np.arange(size, dtype=np.int32)
    after = np.where(place + 1 < lengths[:, None], place + 1, np.int32(size))
    before = np.repeat(place[None, :] - 1, count, 0)
    tree = np.full((count, 2 * size), none, np.int32)

    def leaf(rows: np.ndarray, at: np.ndarray, then: np.ndarray) -> np.ndarray:
        rank = table.lookup(ids[rows, at].astype(np.int64), ids[rows, then].astype(np.int64))
        return np.where(rank < FREE, rank * size + at, none).astype(np.int32)

    rows, at = np.nonzero(inside[:, 1:])
    tree[rows, size + at] = leaf(rows, at, at + 1)
    width = size // 2
    while width:
        level = tree[:, 2 * width : 4 * width]
        tree[:, width : 2 * width] = np.minimum(level[:, ::2], level[:, 1::2])
        width //= 2
    flat = tree.reshape(-1)

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        base, node = rows * (2 * size), at + size
        flat[base + node] = value
        for _ in range(size.bit_length() - 1):  # all leaves lie at one depth
            node = node >> 1
            low = base + 2 * node
            flat[base + node] = np.minimum(flat[low], flat[low + 1])

    while len(rows := np.flatnonzero(tree[:, 1] != none)):
        rank, at = np.divmod(tree[rows, 1], np.int32(size))
        gone = after[rows, at]
        then = after[rows, gone]
        prior = before[rows, at]
        ids[rows, at], ids[rows, gone], after[rows, at] = rank, -1, then
        inner, led = then < size, prior >= 0
        before[rows[inner], then[inner]] = at[inner]
        put(rows, gone, none)
        put(rows, at, leaf(rows, at, then))
        rows, at, prior = rows[led], at[led], prior[led]
        put(rows, prior, leaf(rows, prior, at))
    live = ids[:, :size] >= 0
    return ids[:, :size][live].astype("<u4").tobytes(), live.sum(1)


#: A text of one-byte code points.
LATIN = re.compile(r"[\x00-\xff]*\Z")


def narrow_pattern(pattern: str):
    """``findall`` of the standard library for Latin-1 texts, with the classes written out.

    Within Latin-1 the classes \\p{L}, \\p{N} and \\s have few members. None if the pattern uses
    other properties, which these sets do not cover.
    """
    narrow = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe"}
    spaces = r"\x09-\x0d\x20\x85\xa0"
    classes = {r"[^\s\p{L}\p{N}]": f"[^{spaces}{narrow[chr(92) + 'p{L}']}{narrow[chr(92) + 'p{N}']}]", r"\S": f"[^{spaces}]", r"\s": f"[{spaces}]"}
    for name, members in (classes | {k: f"[{v}]" for k, v in narrow.items()}).items():
        pattern = pattern.replace(name, members)
    return None if re.search(r"\\[pPwWdDbBXR]", pattern) else re.compile(pattern).findall


class Tokenizer:
    """``encode`` and ``decode`` whole texts; special tokens do not exist here."""

    def __init__(self, path: str, pattern: str):
        self.table = RankTable(load_ranks(path))
        self.findall = regex.compile(pattern).findall
        self.narrow = narrow_pattern(pattern)
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        """The pieces of a text. Where a text has Latin-1 only, the standard library finds the same ones sooner."""
        if self.narrow is not None and LATIN.match(text):
            return self.narrow(text)
        return self.findall(text)

    def _learn(self, pieces: set[str]) -> None:
        if len(self.memory) + len(pieces) > KEPT_PIECES:
            self.memory.clear()
            self.held = 0
        self.held += sum(map(len, pieces))
        ranks, memory, groups = self.table.ranks, self.memory, {}
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            whole = ranks.get(data)
            if whole is not None:
                memory[piece] = whole.to_bytes(4, "little")
            elif len(data) < LONG:
                names, parts = groups.setdefault((len(data) - 1).bit_length(), ([], []))
                names.append(piece)
                parts.append(data)
            else:
                memory[piece] = np.array(merge_one(data, self.table), "<u4").tobytes()
        for bits, (names, parts) in groups.items():
            if len(parts) < LOCKSTEP:
                memory.update((n, np.array(merge_one(d, self.table), "<u4").tobytes()) for n, d in zip(names, parts))
                continue
            packed, counts = merge_many(b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts)), 1 << bits, self.table)
            ends = (np.cumsum(counts) * 4).tolist()
            memory.update((n, packed[a:b]) for n, a, b in zip(names, [0, *ends], ends))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        pieces = list(map(self.split, texts))
        new = set().union(*pieces).difference(self.memory)
        if new:
            if len(self.memory) + len(new) > KEPT_PIECES:
                new = set().union(*pieces)
            self._learn(new)
        get = self.memory.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        if self.held > KEPT_CHARS:
            self.memory.clear()
            self.held = 0
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids that are packed as ``encode_batch`` packs them."""
        return b"".join(map(self.table.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer a Python process and vocabulary: tables and memory outlive a task, but not the stage."""
    return kept((path, pattern), lambda: Tokenizer(path, pattern))


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the tokens of every whole text.

    Null and empty texts give an empty list. Rows are independent of each other: repeated
    rows give repeated results, and an empty table gives an empty one. No shuffle.
    """

    def make():
        own = tokenizer(path, pattern)

        def apply(batch):
            packed = own.encode_batch(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "ids": [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "doc_id long, ids array<int>", ENCODED_BYTES)


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts that lists of ids stand for (null: empty); bytes that are no UTF-8 become U+FFFD."""

    def make():
        own = tokenizer(path, pattern)

        def apply(batch):
            texts = [own.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "text": texts}

        return apply

    slim = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids")
    return map_batches(slim, make, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and keep the digests of both.

    doc_id, n_tokens, ids_sha256, decoded_sha256, lossless (decoded bytes equal the text's).
    The ids stay in the task, so the plan is one scan and one Arrow stage.
    """

    def make():
        own = tokenizer(path, pattern)

        def apply(batch):
            texts = batch.column("text").to_pylist()
            packed = own.encode_batch(texts)
            decoded = list(map(own.decode, packed))
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(p) // 4 for p in packed],
                "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
                "lossless": [d == t.encode() for d, t in zip(decoded, texts)],
            }

        return apply

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    return map_batches(documents(df, id_col, text_col), make, schema, ENCODED_BYTES)
