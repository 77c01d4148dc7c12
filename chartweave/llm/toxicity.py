"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the distinct hashed terms
of a text (its words and their beginnings): beside each term's own weight every pair of terms has one, the product of their
vectors, so that two terms that are harmless alone can count together.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, remainder
from .sampling import stratified

#: Buckets of the hashed terms, and length of a term's vector.
BUCKETS = 1 << 20
FACTORS = 4
#: Labelled documents of each class, whole, that the machine is fitted on.
PER_CLASS = 2_000
#: Sample documents that must hold a term.
TERM_LEAST = 3
LINEAR_EPOCHS, PAIR_EPOCHS, BATCH = 16, 8, 256
RATE, SPARSE, SHRINK = 0.3, 1e-3, 1e-3
#: Every term starts with a vector of such random parts; the penalty on a vector's length takes those to zero that no pair needs.
PAIR_START, PAIR_SPARSE = 0.05, 4e-3
#: Texts of more terms have their pairs weighed down in proportion.
PAIR_TERMS = 64
THRESHOLD = 0.3
#: Words whose rows a worker keeps, and so many of their characters; longer memories go after the batch that made them.
KEPT_WORDS, KEPT_CHARS = 400_000, 8 << 20

words_of = re.compile(r"\w+").findall

#: Letters of the beginnings that count as terms beside the whole word: inflected and compound forms share them.
STEMS = (4, 5, 6, 7, 8)


def word_terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def words_in(text: str) -> set[str]:
    return set(words_of(text.lower()))


def buckets_of(text: str) -> np.ndarray:
    return np.array(sorted({bucket(t) for w in words_in(text) for t in word_terms(w)}), np.int32)


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def pair_scale(terms: np.ndarray) -> np.ndarray:
    """What pairs count for in a text of so many terms: chance pairs of a long text grow with its square."""
    return np.minimum(1.0, PAIR_TERMS / np.maximum(terms, 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class FactorizationMachine:
    """Weights and vectors of the terms that training kept, by bucket."""

    def __init__(self):
        self.bias = 0.0
        self.place: dict[int, int] = {}  # bucket -> row, 1 and up
        self.weight = np.zeros(1)
        self.vector = np.zeros((1, FACTORS))

    def fit(self, rows: list[tuple[int, np.ndarray, float]], seed: int = 11) -> FactorizationMachine:
        """rows: (class, buckets, importance). Proximal AdaGrad: first the linear part with an L1
        penalty, then both parts, where every term has a vector."""
        rng = np.random.default_rng(seed)
        if not rows:
            return self
        truth = np.array([r[0] for r in rows], float)
        importance = np.array([r[2] for r in rows])
        importance /= importance.mean()
        prior = float(np.clip((truth * importance).mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(prior / (1 - prior)))
        if truth.min() == truth.max():
            return self
        flat = np.concatenate([r[1] for r in rows])
        size = np.array([len(r[1]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), size)
        kept, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
        use = seen[column] >= TERM_LEAST
        kept = kept[seen >= TERM_LEAST]
        owner, column = owner[use], np.searchsorted(kept, flat[use])
        n = len(kept)
        begin = np.searchsorted(owner, np.arange(len(rows) + 1))
        w, w_sum = np.zeros(n), np.full(n, 1e-4)
        v, v_sum = np.zeros((n, FACTORS)), np.full((n, FACTORS), 1e-2)
        b_sum = 1e-2

        def epoch(pairs: bool) -> None:
            nonlocal b_sum
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                sizes = begin[part + 1] - begin[part]
                own = np.repeat(np.arange(len(part)), sizes)
                col = column[np.repeat(begin[part], sizes) + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                value = self.bias + np.bincount(own, w[col], len(part))
                if pairs:
                    vec = v[col]
                    total = np.stack([np.bincount(own, vec[:, f], len(part)) for f in range(FACTORS)], 1)
                    scale = pair_scale(sizes)
                    value += 0.5 * scale * ((total**2).sum(1) - np.bincount(own, (vec**2).sum(1), len(part)))
                error = (sigmoid(value) - truth[part]) * importance[part] / len(part)
                used, spot = np.unique(col, return_inverse=True)
                grad = np.bincount(spot, error[own], len(used))
                w_sum[used] += grad**2
                step = RATE / np.sqrt(w_sum[used])
                new = w[used] - step * grad
                w[used] = np.sign(new) * np.maximum(np.abs(new) - step * SPARSE, 0)
                b_sum += error.sum() ** 2
                self.bias -= RATE * error.sum() / np.sqrt(b_sum)
                if pairs:
                    inner = (error * scale)[own][:, None] * (total[own] - vec)
                    slope = np.stack([np.bincount(spot, inner[:, f], len(used)) for f in range(FACTORS)], 1)
                    slope = (slope + SHRINK * v[used]) * (v[used] != 0)
                    v_sum[used] += slope**2
                    pace = 0.5 * RATE / np.sqrt(v_sum[used])
                    new = v[used] - pace * slope
                    length = np.sqrt((new**2).sum(1)) + 1e-12
                    v[used] = new * np.maximum(0, 1 - pace.mean(1) * PAIR_SPARSE / length)[:, None]

        for _ in range(LINEAR_EPOCHS):
            epoch(False)
        v[:] = rng.normal(0, PAIR_START, v.shape)
        for _ in range(PAIR_EPOCHS):
            epoch(True)
        self.place = {int(b): k for k, b in enumerate(kept, 1)}
        self.weight = np.concatenate([[0], w])
        self.vector = np.concatenate([np.zeros((1, FACTORS)), v])
        return self


class Scorer:
    """Scores batches of texts; remembers which rows a word has."""

    def __init__(self, machine: FactorizationMachine):
        self.machine, self.memory, self.held = machine, {}, 0

    def scores(self, texts: list[str]) -> np.ndarray:
        words = [words_in(t) for t in texts]
        new = set().union(*words).difference(self.memory)
        if len(self.memory) + len(new) > KEPT_WORDS:
            self.memory.clear()
            new, self.held = set().union(*words), 0
        self.held += sum(map(len, new))
        place = self.machine.place
        for word in new:
            self.memory[word] = tuple(place[b] for t in word_terms(word) if (b := bucket(t)) in place)
        get = self.memory.__getitem__
        rows = [set().union(*map(get, own)) for own in words]  # a bucket counts once
        if self.held > KEPT_CHARS:
            self.memory.clear()
            self.held = 0
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        col = np.fromiter((r for own in rows for r in own), np.int64, int(size.sum()))
        own = np.repeat(np.arange(len(rows)), size)
        value = self.machine.bias + np.bincount(own, self.machine.weight[col], len(rows))
        vec, scale = self.machine.vector[col], pair_scale(size)
        for f in range(vec.shape[1]):
            value += 0.5 * scale * (np.bincount(own, vec[:, f], len(rows)) ** 2 - np.bincount(own, vec[:, f] ** 2, len(rows)))
        return sigmoid(value)


def fit_toxicity(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fit on a bounded sample of labelled rows: ``per_class`` documents of either class.

    Classes count by their shares among all labelled rows, so scores are calibrated to these
    although the sample is balanced. Tasks turn whole texts into their distinct terms; only these reach the driver. An id with contrary labels counts as 1; null labels and ids
    without a document teach nothing. Without labels of both classes every score is the prior.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    share = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    sample = F.broadcast(stratified(known, "label", per_class))  # 2 * per_class ids at most
    texts = documents(df, id_col, text_col).join(sample, "doc_id").select("label", "text")

    def make():
        return lambda batch: {"label": batch.column("label"), "terms": [buckets_of(t).tobytes() for t in batch.column("text").to_pylist()]}

    found = sorted(tuple(r) for r in map_batches(texts, make, "label int, terms binary").collect())
    drawn = {label: sum(r[0] == label for r in found) for label in share}
    rows = [(label, np.frombuffer(terms, np.int32), share[label] / drawn[label]) for label, terms in found]
    return FactorizationMachine().fit(rows)


def score_toxicity(df: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: every whole text on its own, no shuffle.

    Null and empty texts get the score of no terms, the bias. Repeated rows repeat the result;
    an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def make():
        scorer = Scorer(shared.value)

        def apply(batch):
            score = scorer.scores(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

        return apply

    return map_batches(documents(df, id_col, text_col), make, "doc_id long, score double, predicted int")


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: those outside the held-out fold."""
    return labels.where(remainder(id_col, 4) != 2)
