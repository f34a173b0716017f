"""End to end on the driver's smallest tables: scoring beats the random baseline."""

import os

import pytest

from adeptus import fixtures as fx
from adeptus.operators import evaluate, linking, relatedness, scoring

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_eciaf_beats_random_on_map(spark):
    c = fx.corpus(spark, SF).write_derived()
    gaz = linking.title_gazetteer(c.popularity().select("entity"))
    qe = linking.query_entities(fx.topics(spark, SF), gaz)
    qrels = fx.qrels(spark, SF)

    def map_all(run):
        te = evaluate.trec_eval(run, qrels)
        return te.where("measure = 'map' AND query_id = 'all'").first().value

    m_eciaf = map_all(scoring.eciaf_score(c, qe))
    m_random = map_all(scoring.random_score(c, qe))
    assert m_eciaf > m_random

    # invariants: relatedness symmetric and within [0, 1]
    src = qe.select("entity").distinct()
    rel = {(r.source, r.other): r.rel for r in relatedness.cooccurrence_relatedness(c, src).collect()}
    assert all(0.0 <= v <= 1.0 for v in rel.values())
    assert all(abs(v - rel[(b, a)]) < 1e-12 for (a, b), v in rel.items() if (b, a) in rel)
