"""Word shingles of whole texts as sorted sets of 64-bit hashes, and their minima."""

from __future__ import annotations

import numpy as np

#: ASCII capitals in lower case, the white space of the contract as a space, all else as it is.
PLAIN = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))

_MASK = (1 << 64) - 1


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers by splitmix64."""
    out = []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = seed
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        out.append((z ^ z >> 31) | 1)
    return np.array(out, np.uint64)


BYTE_VALUES = constants(1, 256)
PLACE = constants(2, 16)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Words whose letters are hashed at once; the arrays take some 25 times their bytes.
BLOCK_WORDS = 1 << 17


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` starts, and its hash. Spaces (32) part words; ``data`` begins and ends with one."""
    word = data != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), BLOCK_WORDS):
        a, b = starts[at : at + BLOCK_WORDS], ends[at : at + BLOCK_WORDS]
        lengths = b - a
        letters = data[a[0] : b[-1]][word[a[0] : b[-1]]]
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(len(letters), dtype=np.int32)
        place -= np.repeat(firsts.astype(np.int32), lengths)
        powers = np.cumprod(np.full(int(lengths.max()), PLACE[0]), dtype=np.uint64)
        values = powers.take(place)
        values *= BYTE_VALUES.take(letters)
        hashes[at : at + BLOCK_WORDS] = mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    return starts, hashes


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and the number of words of each text."""
    data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(PLAIN), np.uint8)
    starts, hashes = hashed_words(data)
    begins = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, begins))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other; and the size of each set.

    A text of fewer words than ``width``, but some, has its whole sequence as the one shingle.
    """
    words, count = word_hashes(texts)
    if not len(words):
        return words, count
    total = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        total += mix(padded[k : k + len(words)] * PLACE[k + 1]) * PLACE[k + 2]
    begins = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < width)):
        own = words[begins[d] : begins[d] + count[d]]
        total[begins[d]] = (mix(own * PLACE[1 : 1 + len(own)]) * PLACE[2 : 2 + len(own)]).sum() + np.uint64(count[d])
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    firsts = np.cumsum(number) - number
    keep = np.repeat(begins - firsts, number) + np.arange(int(number.sum()))
    flat = mix(total[keep])
    for a, b in zip(firsts.tolist(), (firsts + number).tolist()):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[firsts[number > 0]] = True
    owner = np.repeat(np.arange(len(texts)), number)
    return flat[fresh], np.bincount(owner[fresh], minlength=len(texts))


def minima(flat: np.ndarray, sizes: np.ndarray, functions: int) -> np.ndarray:
    """[texts, functions] 32-bit minima; rows of empty sets are all ones."""
    out = np.full((len(sizes), functions), 0xFFFFFFFF, np.uint32)
    has = sizes > 0
    if has.any():
        firsts = (np.cumsum(sizes) - sizes)[has]
        short = (flat >> np.uint64(32)).astype(np.uint32)
        scale, shift = constants(7, functions), constants(8, functions)
        for k in range(functions):
            out[has, k] = np.minimum.reduceat(short * np.uint32(int(scale[k]) >> 32 | 1) ^ np.uint32(int(shift[k]) >> 32), firsts)
    return out
