"""Plan shape and skew: the properties the operators are designed for."""

import math
import random
from collections import defaultdict

from adeptus import schemas
from adeptus.corpus import Corpus
from adeptus.operators import scoring, stats


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_shape(corpus, qe):
    # no product of any kind in the scoring plans
    for df in (scoring.vector_scores(corpus, qe), scoring.relatedness_geom_score(corpus, qe)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the decile histogram's range join is against the 10 decile bins only
    hist = _plan(stats.paper_count_histogram(corpus.papers()))
    assert "CartesianProduct" not in hist


def test_scan_pruning(spark, tmpdir_path):
    import adeptus.fixtures as fx
    rows = [(i, i % 7, i % 5, 1, 1.0, 1.0, 0.05, 0.0, "A", "F", None) for i in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                "l_returnflag string, l_linestatus string, l_shipdate timestamp") \
        .write.parquet(f"{tmpdir_path}/lineitem.parquet")
    spark.createDataFrame([(i, i % 3, "O", 1.0, None, "1") for i in range(50)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmpdir_path}/orders.parquet")
    spark.createDataFrame([(i, f"p{i}", "b", "t", 1, 1.0) for i in range(7)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
                          "p_retailprice double").write.parquet(f"{tmpdir_path}/part.parquet")
    plan = _plan(fx.mentions(spark, tmpdir_path))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_discount:double>" in plan
    assert "l_shipdate" not in plan and "o_totalprice" not in plan and "p_brand" not in plan


def test_hot_author_and_entity(spark):
    """One author holds a third of all mentions, one entity most of them."""
    rnd = random.Random(7)
    mentions, documents = [], []
    doc = 0
    for a in range(30):
        ndocs = 80 if a == 0 else 4
        for _ in range(ndocs):
            documents.append((doc, f"a{a}", 2000 + doc % 3, None, f"U{doc % 3}"))
            for _ in range(rnd.randint(1, 4)):
                e = "HOT" if rnd.random() < 0.7 else f"e{rnd.randint(0, 9)}"
                mentions.append((e, f"a{a}", doc, 2000 + doc % 3, round(rnd.random(), 2)))
            doc += 1
    authors = [(f"a{a}", f"A{a}", f"U{a % 3}") for a in range(30)]
    c = Corpus(spark.createDataFrame(authors, schemas.AUTHORS), spark.createDataFrame(documents, schemas.DOCUMENTS),
               spark.createDataFrame(mentions, schemas.MENTIONS))
    assert sum(1 for m in mentions if m[1] == "a0") * 3 >= len(mentions)

    # brute force
    strong = defaultdict(set)
    papers = defaultdict(set)
    pop = defaultdict(set)
    for e, a, d, y, r in mentions:
        papers[a].add(d)
        pop[e].add(d)
        if r > 0.2:
            strong[(a, e)].add(d)
    got = {(r.author_id, r.entity): r.author_freq for r in c.author_entity().collect()}
    assert got == {k: len(v) for k, v in strong.items()}
    assert {r.author_id: r.papers for r in c.papers().collect()} == {a: len(v) for a, v in papers.items()}
    qe = spark.createDataFrame([("q", "HOT"), ("q", "e1")], "query_id string, entity string")
    n = len(documents)
    qw = {e: 0.5 * math.log(n / len(pop[e])) for e in ("HOT", "e1")}
    want = {}
    for (a, e), ds in strong.items():
        if e in qw:
            want[a] = want.get(a, 0.0) + len(ds) * qw[e]
    got = {r.author_id: r.score for r in scoring.eciaf_score(c, qe).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[a], want[a]) for a in want)
