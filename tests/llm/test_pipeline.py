"""The pipeline's stages against brute force on a small fixture."""

import hashlib
import random

import corpus_pipeline
from chartweave.llm import queries

from .test_operators import brute_components
from .util import SCHEMA, documents, prose


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(rng, 30)
    docs = documents(spark).where("doc_id is not null")
    leaked = spark.createDataFrame([(900 + k, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "x", 0) for k in range(3)], SCHEMA)
    docs.unionByName(leaked).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
    assert not {-1, -2, -3} & set(kept["language_id"]) and 0 in kept["language_id"]
    before = kept["exact_dedup"]
    assert len({"".join(r.text.split()) for r in kept["language_id"].values()}) == len(before)
    parts = brute_components([(i, r.text) for i, r in before.items()], 5)
    assert set(kept["near_dedup"]) == {c for _, c in parts.values()}
    assert set(kept["near_dedup"]) - set(kept["decontaminate"]) == {900, 901, 902}
    for i, r in kept["tokenize"].items():
        assert r.decoded_sha256 == hashlib.sha256(kept["decontaminate"][i].text.encode()).hexdigest()
    assert set(kept["tokenize"]) == set(kept["decontaminate"])
    whole = {r.doc_id for r in queries.pipeline(spark, str(tmp_path)).collect()}
    assert whole == set(kept["tokenize"])
