"""Language-model scores of whole documents: a gated recurrent network over corpus counts.

The corpus is counted in full: every word of every training document, distributed. The most
frequent words are the network's vocabulary; its biases start at their counts. All other words
share one id whose probability is divided by their own counts, so that every text has a
proper probability. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, frequent, map_batches, stream_batches
from .gru import GatedModel
from .shingles import word_hashes

#: Ids of the network: 0 for any word outside its vocabulary, 1 for the end of a text, then words.
VOCABULARY = 2_048
OTHER, END = 0, 1
#: Frequent words whose counts go to every task (16 bytes each); all other words meet their counts in a join.
LISTED = 1 << 18
#: Rounds of training; each training document is learnt from in exactly one of them.
ROUNDS = 2
#: Training tokens that one copy of the network learns from in a round, about.
GROUP_TOKENS = 1_000_000
#: Groups of a round at most, on any cluster; beyond some 60 GB of text a group reads more.
MOST_GROUPS = 1 << 15
#: Text that is hashed at once when counting or learning, and when scoring.
COUNT_BYTES, SCORE_BYTES = 6 << 20, 8 << 20
#: A text of more ids waits until its task holds WAITING ids of such texts: a step of the network costs a call however few texts
#: are that long, so the few longest of each piece would cost more than all others.
LONG, WAITING = 1_024, 1_500_000
#: Models that one task averages.
FAN_IN = 8
#: Tokens that wait for one pass of local training.
TRAIN_TOKENS = 600_000


def count_words(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word (hash), n: how often each word occurs in the documents of ``df``; combined before the shuffle."""

    def make():
        def apply(batch):
            words, n = np.unique(word_hashes(batch.column("data").to_pylist())[0], return_counts=True)
            return {"word": words.view(np.int64), "n": n}

        return apply

    docs = documents(df, id_col, text_col).select(F.col("text").cast("binary").alias("data"))
    return map_batches(docs, make, "word long, n long", COUNT_BYTES).groupBy("word").agg(F.sum("n").alias("n"))


class Places:
    """Finds hashes among distinct ones in ascending order. They are spread evenly, so buckets by their first bits hold about one each."""

    def __init__(self, words: np.ndarray):
        bits = len(words).bit_length() + 1
        self.shift, self.size = np.uint64(64 - bits), len(words)
        self.first = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.words = np.append(words, ~np.uint64(0))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for those that are not there."""
        at = self.first.take((words >> self.shift).view(np.int64))
        met = self.words.take(at)
        below = np.flatnonzero(met < words)
        while len(below):
            at[below] += 1
            met[below] = self.words.take(at[below])
            below = below[met[below] < words[below]]
        return np.where((met == words) & (at < self.size), at, np.int32(-1))


class Lexicon:
    """Counts of the listed words by hash, the ids of those in the vocabulary, and the corpus totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, texts: int):
        """words: hashes in descending order of ``counts``; tokens and distinct words without the ends of ``texts`` texts."""
        words, named = words.view(np.uint64), min(len(words), VOCABULARY - 2)
        ids = np.zeros(len(words), np.int32)
        ids[:named] = np.arange(2, 2 + named)
        order = np.argsort(words)
        self.listed, self.counts = Places(words[order]), counts[order]
        self.ids = np.append(ids[order], np.int32(OTHER))  # place -1: not listed
        own = np.argsort(words[:named])
        self.named, self.named_ids = Places(words[:named][own]), np.append(ids[:named][own], np.int32(OTHER))
        self.ends = texts
        self.tokens = tokens + texts
        self.distinct = distinct + (texts > 0)
        self.other_tokens = tokens - int(counts[:named].sum())
        self.other_distinct = distinct - named
        self.start_counts = np.concatenate([[self.other_tokens, texts], counts[:named]]).astype(float)

    def id_lists(self, words: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """Each text's ids with its end."""
        return _with_ends(self.named_ids.take(self.named.find(words)), count)

    def id_lists_and_places(self, words: np.ndarray, count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's ids with its end, and the places of all words among the listed ones, -1 for others."""
        place = self.listed.find(words)
        return _with_ends(self.ids.take(place), count), place


def _with_ends(ids: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    return [np.append(part, np.int32(END)) for part in np.split(ids, np.cumsum(count)[:-1])]


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    return Lexicon(*frequent(counts, "word", LISTED), int(total["n"]), total["v"], texts)


def _average(models: DataFrame) -> DataFrame:
    """Weighted mean of packed models in groups of FAN_IN."""

    def mean(key, frame):
        import pandas as pd

        weight, total = 0.0, 0.0
        frame = frame.sort_values("spot")
        for data, tokens in zip(frame["model"], frame["tokens"]):
            total = total + np.frombuffer(data, np.float32).astype(float) * tokens
            weight += tokens
        return pd.DataFrame({"place": [key[0]], "model": [(total / weight).astype(np.float32).tobytes()], "tokens": [int(weight)]})

    grouped = models.withColumn("spot", F.col("place")).withColumn("place", F.floor(F.col("place") / FAN_IN))
    return grouped.groupBy("place").applyInPandas(mean, "place long, model binary, tokens long")


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS, group_tokens: int = GROUP_TOKENS) -> GatedModel:
    """Train the network on all ``docs`` (doc_id, data). The documents are dealt by a hash of their id into rounds and,
    within a round, into groups; each group trains a copy of the network in the order of ids, and the round's copies are averaged in a
    tree. So the rounds together learn from every row once - the model's ``seen`` says from how many tokens - and
    the outcome depends on the documents, not on how the table lies in files.
    """
    spark = docs.sparkSession
    model, seen_before = GatedModel(lex.start_counts), 0
    shared_lexicon = spark.sparkContext.broadcast(lex)
    groups = min(MOST_GROUPS, -(-lex.tokens // (rounds * group_tokens)) or 1)

    def encode():
        def apply(batch):
            ids = shared_lexicon.value.id_lists(*word_hashes(batch.column("data").to_pylist()))
            return {"place": batch.column("place"), "doc_id": batch.column("doc_id"), "ids": [x.astype(np.uint16).tobytes() for x in ids]}

        return apply

    schema = pa.schema([("place", pa.int64()), ("model", pa.binary()), ("tokens", pa.int64())])
    number = F.coalesce("doc_id", F.xxhash64("data"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        own = docs.where(F.pmod(F.xxhash64(number), F.lit(rounds)) == k).withColumn("place", F.pmod(F.xxhash64(F.lit(1), number), F.lit(groups)))
        dealt = map_batches(own, encode, "place long, doc_id long, ids binary", COUNT_BYTES).repartition(groups, "place").sortWithinPartitions("place", "doc_id", "ids")

        def learn(batches, shared=shared):
            local, group, seen, waiting, tokens = None, None, 0, [], 0

            def flush():
                nonlocal seen, waiting, tokens
                seen += local.train(waiting)
                waiting, tokens = [], 0

            def done():
                if waiting:
                    flush()
                if local is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([local.packed()], pa.binary()), pa.array([seen], pa.int64())], schema=schema)

            for batch in batches:
                for place, ids in zip(batch.column("place").to_pylist(), batch.column("ids")):
                    if place != group:
                        yield from done()
                        local, group, seen = GatedModel(shared_lexicon.value.start_counts).unpack(shared.value.packed()), place, 0
                    waiting.append(np.frombuffer(ids.as_py(), np.uint16).astype(np.int32))
                    tokens += len(waiting[-1])
                    if tokens >= TRAIN_TOKENS:
                        flush()
            yield from done()

        models = materialize(dealt.mapInArrow(learn, "place long, model binary, tokens long"), "models")
        while models.limit(2).count() > 1:
            models = materialize(_average(models), "models")
        found = models.first()
        if found is not None:
            model = GatedModel(lex.start_counts).unpack(bytes(found["model"]))
            seen_before += found["tokens"]
    model.seen = seen_before
    return model


def score_parts(parts: Iterator[tuple[pa.RecordBatch, list[np.ndarray]]], model: GatedModel) -> Iterator[dict]:
    """{column: array} of all rows of ``parts`` (columns, ids of each row), with the log10 probability as "network"; long texts wait for each other."""

    def scored(group):
        found = model.score([x for _, ids in group for x in ids]) / np.log(10)
        for (columns, _), network in zip(group, np.split(found, np.cumsum([len(ids) for _, ids in group])[:-1])):
            yield {**dict(zip(columns.schema.names, columns.columns)), "network": network}

    waiting, held = [], 0
    for columns, ids in parts:
        long = np.fromiter((len(x) > LONG for x in ids), bool, len(ids))
        if not long.all():
            yield from scored([(columns.filter(pa.array(~long)), [x for x in ids if len(x) <= LONG])])
        if long.any():
            waiting.append((columns.filter(pa.array(long)), [x for x in ids if len(x) > LONG]))
            held += sum(map(len, waiting[-1][1]))
        if held >= WAITING:
            yield from scored(waiting)
            waiting, held = [], 0
    if waiting:
        yield from scored(waiting)


def score_documents(df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``training``: boolean column that says which rows may be learnt from. Tokens are the words in lower case
    (ASCII) and one end. base_score: log10 probability by add-one counts of the training tokens;
    score: by the network. Null, empty and blank texts have the end as their only token. Repeated
    rows are scored, and counted, as often as they are given. With nothing to learn from, no
    token is known and every text has its probability under one unseen token.
    """
    learnable = F.coalesce(training, F.lit(False))
    docs = documents(df.withColumn("__training", learnable), id_col, text_col, "__training")
    source = docs.where("__training")
    counts = materialize(count_words(source), "words")
    lex = lexicon(counts, source.count())
    data = docs.select("doc_id", F.col("text").cast("binary").alias("data"), "__training")
    model = train(data.where("__training"), lex)
    sc = df.sparkSession.sparkContext
    shared_lexicon, shared_model = sc.broadcast(lex), sc.broadcast(model)

    def make():
        lex, model = shared_lexicon.value, shared_model.value
        known = np.append(np.log10(lex.counts + 1.0), 0.0)  # place -1: not listed
        named = lex.ids > 0
        row = TaskContext.get().partitionId() << 40

        def counted(batch):
            """All columns but "network", and the ids of each text."""
            nonlocal row
            words, count = word_hashes(batch.column("data").to_pylist())
            ids, place = lex.id_lists_and_places(words, count)
            n = len(count)
            owner = np.repeat(np.arange(n), count)
            rare = place < 0
            whose, which = owner[rare], words[rare]
            bits = n.bit_length()
            order = np.argsort(whose.view(np.uint64) << np.uint64(64 - bits) | which >> np.uint64(bits))  # words that agree in these bits may part a word's places; their times are summed all the same
            whose, which = whose[order], which[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (whose[1:] != whose[:-1]) | (which[1:] != which[:-1])
            begins = np.flatnonzero(fresh)
            times = np.diff(np.append(begins, len(order)))
            offsets = pa.array(np.searchsorted(whose[begins], np.arange(n + 1)).astype(np.int32))
            out = {
                "row": row + np.arange(n),
                "doc_id": batch.column("doc_id"),
                "training": batch.column("__training"),
                "n_tokens": count + 1,
                "known": np.bincount(owner, ~rare, n).astype(np.int64) + (lex.ends > 0),
                "listed": np.bincount(owner, known[place], n) + np.log10(lex.ends + 1),
                "outside": np.bincount(owner, np.where(named[place], 0, known[place]), n),
                "n_outside": np.bincount(owner, rare | ~named[place], n).astype(np.int64),
                "words": pa.ListArray.from_arrays(offsets, pa.array(which[begins].view(np.int64))),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
            }
            row += n
            return pa.RecordBatch.from_pydict(out), ids

        return lambda batches: score_parts(map(counted, batches), model)

    schema = "row long, doc_id long, training boolean, n_tokens long, known long, listed double, outside double, n_outside long, network double, words array<long>, times array<long>"
    scored = materialize(stream_batches(data, make, schema, SCORE_BYTES), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_sum"))
    joined = scored.drop("words", "times").join(met, "row", "left").fillna(0, ["rare_known", "rare_sum"])
    return joined.select(
        "doc_id",
        "training",
        "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("listed") + F.col("rare_sum") - F.col("n_tokens") * float(np.log10(lex.tokens + lex.distinct + 1))).alias("base_score"),
        (F.col("network") + F.col("outside") + F.col("rare_sum") - F.col("n_outside") * float(np.log10(lex.other_tokens + lex.other_distinct + 1))).alias("score"),
    )
