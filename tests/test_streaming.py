"""Continuous ingest: file stream -> store, ids continue, replays do not duplicate."""

import os

from adeptus.operators import linking
from adeptus.sources.store import Store
from adeptus.streaming import ingest_stream


def _csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(",".join('"' + x.replace('"', '""') + '"' for x in r) + "\n")


def test_stream_ingest(spark, tmpdir_path):
    gaz = spark.createDataFrame([("graph", "Graph", 1.0, 0.9)],
                                "surface string, entity string, commonness double, link_prob double")

    def annotator(df):
        return linking.link_entities(df, gaz)

    inp, store_path, ckpt = f"{tmpdir_path}/in", f"{tmpdir_path}/store", f"{tmpdir_path}/ckpt"
    _csv(f"{inp}/f1.csv", [("d1", "au1", "a graph of graph things"), ("d2", "au2", "no entity here at all")])
    _csv(f"{inp}/f2.csv", [("d3", "au1", "tiny")])  # rejected: not longer than 10 characters
    q = ingest_stream.start_tu_ingest(spark, inp, store_path, ckpt, annotator, trigger_once=True)
    q.awaitTermination(120)
    st = Store(spark, store_path)
    docs = sorted((r.document_id, r.author_id) for r in st.read("documents").collect())
    assert docs == [(0, "au1"), (1, "au2")]
    assert st.read("entity_occurrences").count() == 2

    _csv(f"{inp}/f3.csv", [("d4", "au3", "graph theory for everybody")])
    q = ingest_stream.start_tu_ingest(spark, inp, store_path, ckpt, annotator, trigger_once=True)
    q.awaitTermination(120)
    docs = sorted((r.document_id, r.author_id) for r in st.read("documents").collect())
    assert docs == [(0, "au1"), (1, "au2"), (2, "au3")]
    assert {r.author_id for r in st.read("authors").collect()} == {"au1", "au2", "au3"}

    # replaying a batch id rewrites it: same ids, no duplicates
    batch = st.batches()[-1]
    replay = spark.read.schema(ingest_stream.TU_SCHEMA).option("escape", '"').csv(f"{inp}/f3.csv")
    from pyspark.sql import functions as F
    replay = ingest_stream.tu_papers(replay.withColumn("input_file", F.lit("f3")))
    ingest_stream.ingest_batch(spark, replay, store_path, batch, annotator)
    docs = sorted((r.document_id, r.author_id) for r in st.read("documents").collect())
    assert docs == [(0, "au1"), (1, "au2"), (2, "au3")]
    inst = {r.institution: r.document_count for r in st.read("institutions").collect()}
    assert inst == {"TU": 3}
