"""Evaluation measures against values computed by hand from their definitions."""

import math

from adeptus.operators import evaluate


def test_measures_hand_computed(spark):
    # q1 ranking (score desc, then author id desc): b(rel 2), a(0), d(unjudged), c(1), e(0)
    run = spark.createDataFrame([
        ("q1", "a", 0.9), ("q1", "b", 0.9), ("q1", "c", 0.5), ("q1", "d", 0.7), ("q1", "e", 0.1),
        ("q2", "x", 1.0),
    ], "query_id string, author_id string, score double")
    qrels = spark.createDataFrame([
        ("q1", "a", 0), ("q1", "b", 2), ("q1", "c", 1), ("q1", "e", 0), ("q1", "f", 1),
        ("q2", "y", 1),
        ("q3", "z", 1),   # judged, no run: counts 0 in 'all'
        ("q4", "w", 0),   # no relevant author: counts 0 in 'all'
    ], "query_id string, author_id string, rel int")
    m = {r.query_id: r for r in evaluate.per_query_measures(run, qrels).collect()}
    q1 = m["q1"]
    assert (q1.num_ret, q1.num_rel, q1.num_rel_ret) == (5, 3, 2)
    ap = (1 / 1 + 2 / 4) / 3
    assert math.isclose(q1.map, ap)
    assert math.isclose(q1.gm_map, math.log(ap))
    assert math.isclose(q1.Rprec, 1 / 3)          # one relevant in the top 3
    assert math.isclose(q1.recip_rank, 1.0)
    assert math.isclose(q1.P_5, 2 / 5) and math.isclose(q1.P_10, 2 / 10)
    assert math.isclose(q1.recall_5, 2 / 3) and q1.success_1 == 1.0
    # bpref: R=3, N(judged non-relevant)=2; b: 0 non-rel above; c: 1 above -> 1 - 1/2
    assert math.isclose(q1.bpref, (1 + 0.5) / 3)
    dcg = 2 / math.log2(2) + 1 / math.log2(5)
    idcg = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert math.isclose(q1.ndcg, dcg / idcg) and math.isclose(q1.ndcg_cut_5, dcg / idcg)
    # precision at relevant ranks: 1.0 (recall 1/3), 0.5 (recall 2/3)
    assert q1.iprec_at_recall_0_00 == 1.0 and q1.iprec_at_recall_0_30 == 1.0
    assert q1.iprec_at_recall_0_40 == 0.5 and q1.iprec_at_recall_0_70 == 0.0
    assert math.isclose(q1.set_P, 2 / 5) and math.isclose(q1.set_recall, 2 / 3)
    assert math.isclose(q1.set_F, 2 * 0.4 * (2 / 3) / (0.4 + 2 / 3))
    assert m["q2"].map == 0.0 and m["q2"].recip_rank == 0.0

    te = {(r.measure, r.query_id): r.value for r in evaluate.trec_eval(run, qrels).collect()}
    assert ("map", "q4") not in te and ("map", "q3") not in te
    assert math.isclose(te[("map", "all")], ap / 4)            # q1, q2 (0), q3 and q4 (absent, 0)
    assert te[("num_rel", "all")] == 5.0 and te[("num_ret", "all")] == 6.0
    assert math.isclose(te[("gm_map", "all")], math.exp((math.log(ap) + 3 * math.log(1e-5)) / 4))
    assert ("iprec_at_recall_0.10", "all") in te


def test_ranking_cap_and_tie_order(spark):
    run = spark.createDataFrame([("q", f"a{i:04d}", float(i % 7)) for i in range(1500)],
                                "query_id string, author_id string, score double")
    from adeptus.operators.ranking import ranked_run
    r = ranked_run(run, 1000).orderBy("rank").collect()
    assert len(r) == 1000 and r[0].rank == 1
    assert all((x.score, x.author_id) > (y.score, y.author_id) for x, y in zip(r, r[1:]))


def test_decimals_summary_is_exact(spark):
    # twenty queries with P_5 in {0.2, 0.4}: the mean is exact in decimal
    run = spark.createDataFrame([(f"q{i}", f"a{j}", float(5 - j)) for i in range(20) for j in range(5)],
                                "query_id string, author_id string, score double")
    qrels = spark.createDataFrame([(f"q{i}", f"a{j}", 1) for i in range(20) for j in range(1 + i % 2)],
                                  "query_id string, author_id string, rel int")
    te = {(r.measure, r.query_id): r.value for r in evaluate.trec_eval(run, qrels, decimals=6).collect()}
    assert te[("P_5", "all")] == 0.3
