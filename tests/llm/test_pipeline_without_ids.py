"""Each stage of the pipeline on rows without an id, and on repeated ids."""

from collections import Counter

import corpus_pipeline
from tessera.llm import source_mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], SCHEMA).repartition(3)


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxic_rows_without_an_id_are_removed(spark, tmp_path):
    some = lambda i: " ".join(f"w{(7 * i + 13 * k * k) % 97}" for k in range(30))
    toxic = lambda i: f"{some(i)} nasty foul vile {some(i + 1)}"
    rows = [(i, toxic(i) if i % 3 == 0 else some(i), "s") for i in range(400)]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = [(None, toxic(900), "s"), (None, some(901), "s"), (1, toxic(902), "s")]
    got = counted(corpus_pipeline.ordinary(spark, table(spark, rows + extra), str(tmp_path)))
    assert (None, toxic(900)) not in got and got[(None, some(901))] == 1
    assert (1, toxic(902)) not in got and got[(1, rows[1][1])] == 1


def test_passages_in_rows_without_an_id_are_removed(spark, tmp_path):
    passage = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"a {passage}", "s"), (None, f"a {passage}", "s"), (None, "clean", "s"), (None, None, "s"), (3, "clean", "s"), (3, f"{passage} b", "s")]
    got = counted(corpus_pipeline.unseen(spark, table(spark, rows), str(tmp_path)))
    assert got == Counter({(None, "clean"): 1, (None, None): 1, (3, "clean"): 1})


def test_near_copies_without_an_id_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "s"), (None, text, "s"), (2, text, "s"), (1, text + " z", "s"), (1, text + " z", "s"), (4, "other", "s"), (4, "another", "s")]
    got = counted(corpus_pipeline.one_of_each(spark, table(spark, rows), ""))
    assert got == Counter({(None, text): 2, (1, text + " z"): 1, (4, "other"): 1, (4, "another"): 1})


def test_the_mix_takes_rows_without_an_id(spark):
    rows = [(None if i % 3 == 0 else i // 2, f"t{i} " * (i % 40 + 1), "abc"[i % 2]) for i in range(300)]
    docs = table(spark, rows)
    want = sum(r.taken for r in source_mixing.mix(docs).collect())
    got = counted(corpus_pipeline.mixed(spark, docs, ""))
    assert sum(len((t or "").split()) * n for (_, t), n in got.items()) == want
    assert sum(n for (i, _), n in got.items() if i is None) > 50


def test_rows_without_an_id_are_encoded(spark):
    got = corpus_pipeline.encoded(spark, table(spark, [(None, "one two", "s"), (1, "three", "s"), (None, None, "s")]), "")
    assert sorted(r.n_tokens > 1 for r in got.collect()) == [False, True, True]
