import random

import corpus_pipeline
from .conftest import SCHEMA, row


def test_stages(spark, words, odd_rows, tmp_path):
    """Every stage on odd rows: rejects go, one copy stays, columns stay, the last gives ids."""
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(100, 500):
        w = [rnd.choice(words) for _ in range(60)]
        junk, bad = i % 8 == 0, i % 8 == 1
        text = " @@@ ".join(w) if junk else " ".join(w[:30] + ["bmupzkk"] * bad + w[30:])
        rows.append(row(i, text))
        labels.append((i, int(not junk), int(bad)))
    rows += odd_rows + [row(1000 + r[0], r[1] + " x") for r in rows[2:40:8]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), SCHEMA)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        if name == "quality":
            assert not [i for i in ids if i and 100 <= i < 500 and i % 8 == 0]
        if name == "toxicity":
            assert not [i for i in ids if i and 100 <= i < 500 and i % 8 == 1]
        if name == "near_dedup":
            assert not [i for i in ids if i and i >= 1000] and {102, 103, 110} <= ids
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert len(last) == kept.count() and all(r.round_trip for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in last}


def test_empty(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
