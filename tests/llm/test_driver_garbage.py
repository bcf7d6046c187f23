"""The stages with the most queries have the driver's heap collected between their passes, not only when it is full."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string"


def collections(spark):
    """Full collections of the driver's heap so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_the_drivers_heap_is_collected_between_passes(spark):
    rows = [(i, " ".join(f"w{(i // 2 * 31 + k * k) % 997}" for k in range(40 + i % 7)), "en", "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for stage in (corpus_pipeline.one_of_each, corpus_pipeline.mixed):
        before = collections(spark)
        assert 0 < stage(spark, docs, "").count() and collections(spark) - before >= 2, stage.__name__
