"""Session helpers: the shared folder, written tables, dealing of texts."""

import time

from pyspark.sql import functions as F

from adeptus.operators import stats
from adeptus.session import CLEAN_UP, TEXT_PARTITIONS, dealt, shared_folder, written


def test_written_table(spark):
    folder = shared_folder(spark)
    assert folder and shared_folder(spark) == folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            runs.add(len(pdf))
            yield pdf

    table = written(spark.range(100).mapInPandas(seen, "id long"), "t")
    assert table.count() == 100 and table.agg(F.sum("id")).first()[0] == 4950
    assert runs.value == 100                                  # computed once, read twice


def test_dealt(spark):
    one = spark.range(100).coalesce(1)
    assert dealt(one) is one                                  # as it is where the session names no number
    spark.conf.set(TEXT_PARTITIONS, "3")
    try:
        assert dealt(one).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(TEXT_PARTITIONS)


def test_entity_popularity_subset(corpus):
    pop = stats.entity_popularity(corpus.doc_entities(), ["X", "W", "Nope"])
    assert sorted((r.entity, r.entity_popularity) for r in pop.collect()) == [("W", 1), ("X", 3)]


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, own = files(), spark.conf.get(CLEAN_UP, None)
    out = written(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counts", "zstd")
    assert spark.conf.get(CLEAN_UP, None) == own
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)                                # they go in the background
    assert not left and out.count() == 10
