"""Every operator on nulls in any column, empty and long texts, repeated rows and ids, empty tables and clashing columns."""

import random
from collections import Counter

import pytest

from tessera.llm import decontamination, licenses, pii, quality_rules, simhash_dedup, source_mixing, substring_dedup, suffix_dedup, token_ids, toxicity

CLASHES = "row blobs key mark component copies size tier rank target score predicted n items set n_found n_changed text_ _key _d _k _range _place _found _new label fold ids held_out".split()


def base():
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    long, some = text(120_000), text(90)
    rows = [(1, some, "en", "a"), (1, some, "en", "a"), (1, text(50), "de", "b"), (2, some + " x", "en", None), (None, some, "en", "a"), (None, None, None, None), (3, "", "en", "a"), (4, " \n\t", "en", "b")]
    rows += [(5, long, "en", "b"), (6, long[: len(long) // 2] + " end", None, "b"), (7, "one", "en", "a"), (8, "One", "en", "a"), (9, "call 555-123-4567 under the MIT License", "en", "c")]
    return rows + [(i, text(r.randrange(1, 80)), "en", "abc"[i % 3]) for i in range(10, 60)]


@pytest.fixture(scope="module")
def tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    plain = spark.createDataFrame(base(), schema).repartition(3).cache()
    wide = spark.createDataFrame([(*r, *[(None, "x")[i % 2] for i in range(len(CLASHES))]) for r in base()], schema + "".join(f", {c} string" for c in CLASHES)).repartition(2).cache()
    return plain, wide, plain.limit(0)


def labelled(spark):
    return spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 60)] + [(None, 1), (7, None)], "doc_id long, toxic int")


def benchmark(spark):
    words = base()[0][1].split()
    return spark.createDataFrame([(1, " ".join(words[10:40])), (2, " ".join(words[12:20])), (None, "one"), (3, None), (4, "")], "item_id long, text string")


OPERATORS = {
    "pii": lambda s, d: pii.pseudonymise(d, "k").select("doc_id", "text"),
    "licenses": lambda s, d: licenses.scan(d),
    "decontamination": lambda s, d: decontamination.decontaminate(d, benchmark(s)),
    "simhash": lambda s, d: simhash_dedup.cluster(d),
    "substring": lambda s, d: substring_dedup.dedup(d, with_text=False),
    "suffix": lambda s, d: suffix_dedup.dedup(d, with_text=False),
    "tokens": lambda s, d: token_ids.round_trip(d).drop("start"),
    "mixing": lambda s, d: source_mixing.mix(d).select("doc_id", "source", "size", "source_size", "target"),
    "toxicity": lambda s, d: toxicity.score(d, labelled(s)),
    "quality": lambda s, d: quality_rules.judge(d),
}


def counted(df):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, tables, name):
    plain, wide, none = tables
    run = OPERATORS[name]
    got = counted(run(spark, plain))
    assert Counter(r[0] for r in got.elements()) == Counter(r[0] for r in base())  # a row for each, with or without an id
    assert counted(run(spark, wide)) == got  # whatever else the table has
    assert run(spark, none).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    got = simhash_dedup.cluster(spark.createDataFrame([(5, "a b c d e f"), (5, "u v w x y z"), (6, "u v w x y z"), (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id} == {5} and [r.component_id for r in got if r.doc_id is None] == [None]


def test_scores_don_t_depend_on_ids(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i % 50} nasty" if i % 3 == 0 else f"plain words number {i % 50}") for i in range(1, 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 400)], "doc_id long, toxic int")
    by_text = {}
    for r in toxicity.score(docs, labels).join(docs, "doc_id").collect():
        assert by_text.setdefault(r.text, r.score) == r.score
