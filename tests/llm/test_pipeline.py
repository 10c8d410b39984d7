"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_components
from tokenizers import Tokenizer

from strandline.llm import jaccard_join, language_id, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "toxicity":
            lexicon = toxicity.learn(docs, labels)
            wanted = toxicity.score(docs, lexicon).where("predicted = 0")
        elif name == "language_id":
            wanted = language_id.identify(docs, language_id.learn(docs)).where("lang_pred <> 'und' and score >= 0.02")
        elif name == "jaccard_join":
            roots = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert sorted(kept[name]) == sorted(i for i, (_, root) in roots.items() if i == root)
            wanted = jaccard_join.jaccard_components(docs).where("doc_id = component_id")
        else:
            wanted = docs
        assert sorted(kept[name]) == sorted(r.doc_id for r in wanted.select("doc_id").collect())
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert pieces.agg(F.sum("length")).first()[0] == tokens
    assert sorted({r.doc_id for r in pieces.collect()}) == sorted(kept["mixing"])


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert np.all([r.length > 0 for r in out.collect()])
