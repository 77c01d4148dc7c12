"""From raw documents to tokens: five stages over all documents, each kept as a table.

Every stage reads all that its predecessor kept, and its decisions take effect: what it
rejects is gone from the next one's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartweave.llm import bpe, crf, exact, minhash, queries, wumanber
from chartweave.session import materialize, table

#: A document is rejected if its likeliest language has less than this share of its words' probability.
LEAST_SHARE = 0.3
#: A document goes if so many words in a row lie in benchmark windows; an item of a word or two removes nothing.
LEAST_SPAN = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Rejected: no letter, null text, or no language with LEAST_SHARE."""
    return crf.drop_unidentified(docs, crf.fit_languages(docs), LEAST_SHARE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return wumanber.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least_span=LEAST_SPAN)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of every document left."""
    return bpe.round_trip(docs, *queries.tokenizer_files())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; between them the rows lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Language model and similarity components cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
