"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's score for a language sums the weights of its character n-grams, of its affixes and of
the lexicons that hold it; learned transitions tie neighbouring words. Forward-backward gives
each word its distribution over languages, and a document's language is the one with the
largest share of the words' probability.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep_rows, map_batches
from .sampling import stratified

#: Buckets that the n-gram and affix features are hashed into.
BUCKETS = 1 << 17
#: Labelled documents of each language, whole, that the model is fitted on.
PER_LANGUAGE = 400
#: How often the sample of a language must hold a word of its lexicon.
LEXICON_LEAST = 3
#: Words of one language in a row in the training chains, and words of a chain.
STRETCH, CHAIN = 64, 128
EPOCHS, BATCH, RATE, DECAY = 3, 128, 0.25, 1e-6
#: Words whose scores each Python worker keeps; a longer memory goes after the batch that made it.
KEPT_WORDS = 200_000
#: And so many of their characters.
KEPT_CHARS = 8 << 20
#: Text that is labelled at once, and words whose features are taken at once; both bound a worker's memory.
LABELLED_BYTES, FEATURE_WORDS = 2 << 20, 1 << 14
UNDETERMINED = "und"

_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters. Fractions, superscripts and numerals such as U+2167 are no letters and part words."""
    found = _runs(text)
    if "".join(found).isalpha():
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all features, and the word that each belongs to (ascending).

    Bigrams and trigrams of the word between edge marks; first and last three letters.
    """
    marked = "\x02" + "\x03\x02".join(words) + "\x03"
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(code))  # code points up to the word's end, this one included
    first = np.arange(len(code)) - np.repeat(ends - size, size)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        value = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for n in (2, 3, 4):
            tail = np.roll(code, 1 - n)
            value = (value ^ (tail + np.uint64(n))) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(29)
            fits = left >= n
            if n == 4:
                fits &= (first == 0) | (left == 4)
            hashes.append((value[fits] >> np.uint64(20)) % np.uint64(BUCKETS))
            owners.append(word[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order].astype(np.int64), owner[order]


def forward_backward(score: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position's distribution over labels, and the expected transitions summed over chains.

    ``score``: exponentials of emission scores, chains one after the other. The chains step
    together, longest first, in a layout by time, so a step is a slice and costs its live chains.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
    offset = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    time = np.arange(len(score)) - np.repeat(begins, lengths)
    place = offset[time] + np.repeat(rank, lengths)
    x = np.empty_like(score)
    x[place] = score
    ahead = np.empty_like(x)
    back = np.ones_like(x)
    now = np.empty((0, score.shape[1]))
    bounds = offset.tolist()
    for t in range(steps):
        a, b = bounds[t], bounds[t + 1]
        now = x[a:b] * (start if t == 0 else now[: b - a] @ move)
        now /= now.sum(1, keepdims=True)
        ahead[a:b] = now
    expected = np.zeros_like(move)
    for t in range(steps - 2, -1, -1):
        a, b, c = bounds[t], bounds[t + 1], bounds[t + 2]
        n = c - b
        right = x[b:c] * back[b:c]
        then = right @ move.T
        scale = then.sum(1, keepdims=True)
        back[a : a + n] = then / scale
        mass = (ahead[a : a + n] * then).sum(1, keepdims=True)
        expected += (ahead[a : a + n] / mass).T @ right
    ahead *= back
    ahead /= ahead.sum(1, keepdims=True)
    return ahead[place], expected * move


class WordField:
    """The fitted model: labels, hashed weights, lexicon weights, start and transition scores."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.lexicon: dict[str, int] = {}
        self.member = np.zeros((1, n), np.float32)  # lexicons that hold a word, one row a word of any
        self.lexicon_weights = np.zeros((n, n), np.float32)
        self.start = np.zeros(n)
        self.move = np.zeros((n, n))

    def emissions(self, words: list[str]) -> np.ndarray:
        parts = [self._emissions(words[k : k + FEATURE_WORDS]) for k in range(0, len(words), FEATURE_WORDS)]
        return np.concatenate(parts)

    def _emissions(self, words: list[str]) -> np.ndarray:
        found, owner = features(words)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        out = np.add.reduceat(self.weights[found], cuts, axis=0)
        rows = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        return out + self.member[rows] @ self.lexicon_weights

    def fit(self, texts: list[tuple[str, str]], seed: int = 3) -> WordField:
        """Learn from (label, text): stochastic gradients of the chains' log-likelihood, steps by AdaGrad."""
        rng = np.random.default_rng(seed)
        number = {label: k for k, label in enumerate(self.labels)}
        index: dict[str, int] = {}
        stretches = []
        counts = [Counter() for _ in self.labels]
        for label, text in texts:
            own = words_of(text.lower())
            counts[number[label]].update(own)
            ids = np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own))
            stretches += [(number[label], ids[k : k + STRETCH]) for k in range(0, len(ids), STRETCH)]
        if not stretches:
            return self
        lexicons = [{w for w, c in count.items() if c >= LEXICON_LEAST} for count in counts]
        self.lexicon = {w: k for k, w in enumerate(sorted(set().union(*lexicons)), 1)}
        self.member = np.zeros((len(self.lexicon) + 1, len(self.labels)), np.float32)
        for k, own in enumerate(lexicons):
            self.member[[self.lexicon[w] for w in own], k] = 1
        words = list(index)
        found, owner = features(words)
        begin = np.searchsorted(owner, np.arange(len(words) + 1))
        lexical = self.member[[self.lexicon.get(w, 0) for w in words]]
        weight_sum, lexicon_sum = np.full_like(self.weights, 1e-3), np.full_like(self.lexicon_weights, 1e-3)
        start_sum, move_sum = np.full_like(self.start, 1e-3), np.full_like(self.move, 1e-3)
        n = len(self.labels)
        for _ in range(EPOCHS):
            mixed = [stretches[k] for k in rng.permutation(len(stretches))]
            word = np.concatenate([ids for _, ids in mixed])
            gold = np.repeat([label for label, _ in mixed], [len(ids) for _, ids in mixed])
            for at in range(0, len(word), CHAIN * BATCH):
                part, truth = word[at : at + CHAIN * BATCH], gold[at : at + CHAIN * BATCH]
                lengths = np.full(-(-len(part) // CHAIN), CHAIN)
                lengths[-1] = len(part) - CHAIN * (len(lengths) - 1)
                used, place = np.unique(part, return_inverse=True)
                sizes = begin[used + 1] - begin[used]
                own = np.repeat(np.arange(len(used)), sizes)
                which = found[np.repeat(begin[used], sizes) + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                score = np.add.reduceat(self.weights[which], np.cumsum(sizes) - sizes, axis=0) + lexical[used] @ self.lexicon_weights
                score = score[place].astype(float)
                post, expected = forward_backward(np.exp(score - score.max(1, keepdims=True)), lengths, np.exp(self.start - self.start.max()), np.exp(self.move - self.move.max()))
                firsts = np.cumsum(lengths) - lengths
                error = post.copy()
                error[np.arange(len(truth)), truth] -= 1
                per_word = np.stack([np.bincount(place, error[:, k], len(used)) for k in range(n)], 1)
                touched, spot = np.unique(which, return_inverse=True)
                grad = np.stack([np.bincount(spot, per_word[own, k], len(touched)) for k in range(n)], 1) / len(lengths)
                grad += DECAY * self.weights[touched]
                weight_sum[touched] += grad**2
                self.weights[touched] -= RATE * grad / np.sqrt(weight_sum[touched])
                inner = np.ones(len(part), bool)
                inner[firsts] = False
                seen = np.zeros((n, n))
                np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
                for value, total, g in (
                    (self.lexicon_weights, lexicon_sum, lexical[used].T @ per_word / len(lengths)),
                    (self.start, start_sum, error[firsts].sum(0) / len(lengths)),
                    (self.move, move_sum, (expected - seen) / len(lengths)),
                ):
                    total += g**2
                    value -= RATE * g / np.sqrt(total)
        return self


class Labeller:
    """Applies a field to batches of texts and keeps the scores of frequent words."""

    def __init__(self, field: WordField):
        self.field = field
        self.start, self.move = np.exp(field.start - field.start.max()), np.exp(field.move - field.move.max())
        self._forget()

    def _forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__  # a new word gets the next row of the table
        self.held = 0
        self.table = np.empty((0, len(self.field.labels)), np.float32)

    def _scores(self, ids: list[np.ndarray]) -> np.ndarray:
        new = list(islice(self.index, len(self.table), None))
        if new:
            score = self.field.emissions(new)
            self.table = np.concatenate([self.table, np.exp(score - score.max(1, keepdims=True)).astype(np.float32)])
            self.held += sum(map(len, new))
        found = self.table[np.concatenate(ids)]
        if self.held > KEPT_CHARS or len(self.index) > KEPT_WORDS:
            self._forget()
        return found

    def posteriors(self, words: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of all words of the batch one after the other, and the number of words of each text.

        Words become numbers text by text, so a batch's words need not be held as strings.
        """
        ids = [np.fromiter(map(self.index.__getitem__, own), np.int32, len(own)) for own in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        has = lengths > 0
        if not has.any():
            return np.empty((0, len(self.field.labels))), lengths
        post, _ = forward_backward(self._scores(ids), lengths[has], self.start, self.move)
        return post, lengths

    def languages(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Each text's language and its share of the words' probability; ``und`` and 0 without a letter."""
        post, lengths = self.posteriors(words_of(t.lower()) for t in texts)
        owner = np.repeat(np.arange(len(texts)), lengths)
        share = np.stack([np.bincount(owner, post[:, k], len(texts)) for k in range(len(self.field.labels))], 1)
        best = share.argmax(1)
        score = share[np.arange(len(texts)), best] / np.maximum(lengths, 1)
        return [self.field.labels[b] if n else UNDETERMINED for b, n in zip(best, lengths)], np.clip(score, 0, 1).tolist()


def fit_languages(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> WordField:
    """Fit a field on a bounded sample of labelled rows: ``per_language`` documents of each language.

    Rows with null label or text teach nothing. With no labelled row the field has no label and
    every document is ``und``.
    """
    labelled = documents(df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), id_col, text_col, lang_col)
    sample = stratified(labelled, lang_col, per_language).select(lang_col, "text")
    rows = sorted(tuple(r) for r in sample.collect())
    return WordField(sorted({lang for lang, _ in rows})).fit(rows)


def identify(df: DataFrame, field: WordField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language of every whole text.

    Texts that are null, empty or without a letter are ``und`` with score 0. Each row is judged
    alone: repeated rows repeat the result, an empty table gives an empty one. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        label = Labeller(shared.value) if shared.value.labels else None

        def apply(batch):
            texts = batch.column("text").to_pylist()
            names, scores = label.languages(texts) if label else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "doc_id long, lang_pred string, score double", LABELLED_BYTES)


def drop_unidentified(df: DataFrame, field: WordField, least_share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose language has ``least_share`` of the words' probability, with all their columns.

    Every row is judged alone by its whole text, in the pass that reads it; ids do not matter. Null
    and empty texts and those without a letter go; with a field that knows no language every row goes.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        if not shared.value.labels:
            return lambda texts: [False] * len(texts)
        label = Labeller(shared.value)

        def apply(texts):
            names, scores = label.languages(texts)
            return [name != UNDETERMINED and score >= least_share for name, score in zip(names, scores)]

        return apply

    return keep_rows(df, make, text_col, LABELLED_BYTES)


def label_words(df: DataFrame, field: WordField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words, langs: every word of every text in order, with the likeliest language of each."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        label = Labeller(shared.value)

        def apply(batch):
            words = [words_of(t.lower()) for t in batch.column("text").to_pylist()]
            post, lengths = label.posteriors(words)
            best = iter(post.argmax(1).tolist())
            langs = [[shared.value.labels[next(best)] for _ in range(n)] for n in lengths]
            return {"doc_id": batch.column("doc_id"), "words": words, "langs": langs}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "doc_id long, words array<string>, langs array<string>", LABELLED_BYTES)
