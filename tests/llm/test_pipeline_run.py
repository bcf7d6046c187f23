"""All five stages, one after the other, on the smallest tables."""

import corpus_pipeline
from tessera.llm import token_ids

SF = "/root/testdata/sf0.001"


def test_the_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coder = token_ids.tokenizer(token_ids.public_tokenizers.path(token_ids.TOKENIZER))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.common.cut(stage(spark, docs, SF))
        if i < 4:
            assert docs.columns == before.columns, name
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(texts[r.doc_id] == r.text for r in docs.collect()), name  # rows of the stage before
        if i < 3:
            assert 0.5 * before.count() < docs.count() <= before.count() and docs.count() == docs.select("doc_id").distinct().count(), name
    read, at = {}, 0
    for r in before.collect():
        read.setdefault(r.doc_id, []).append(len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1)
    for r in docs.orderBy("start").collect():
        assert r.start == at and r.n_tokens in read[r.doc_id]
        at += r.n_tokens
    assert at == sum(map(sum, read.values()))
