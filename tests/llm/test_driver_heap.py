"""A table is written after a collection of the driver's heap if that has filled since the last one, not after every one."""

from tessera.llm import common


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_full_heap_is_collected_before_a_table_is_written(spark, monkeypatch):
    common.tidy(spark)
    before = collections(spark)
    monkeypatch.setattr(common, "FULL", 2.0)  # never
    common.cut(spark.range(3))
    assert collections(spark) == before
    monkeypatch.setattr(common, "FULL", 0.0)
    monkeypatch.setattr(common, "SINCE", -1.0)  # always
    common.cut(spark.range(3))
    assert collections(spark) == before + 1
