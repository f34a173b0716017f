"""Scoring functions against arithmetic written out from their definitions.

Hand-made corpus (conftest.py): N = 6 documents; pop X=3, Y=3, Z=2, W=1;
P(a1)=2, P(a2)=2, P(a3)=1; confident (ec, max_rho): a1 X(2,.9) Z(1,.25),
a2 Y(2,.7), a3 X(1,.21) W(1,.4).
"""

import math

import pytest

from adeptus.operators import ranking, relatedness, scoring

N = 6
POP = {"X": 3, "Y": 3, "Z": 2, "W": 1}
P = {"a1": 2, "a2": 2, "a3": 1}
AE = {"a1": {"X": (2, 0.9), "Z": (1, 0.25)}, "a2": {"Y": (2, 0.7)}, "a3": {"X": (1, 0.21), "W": (1, 0.4)}}
Q = {"q1": {"X", "Unknown"}, "q2": {"Y", "Z"}, "q3": {"Unknown"}}


def qw(q):
    return {e: 1.0 / len(Q[q]) * math.log(N / POP[e]) for e in Q[q] if e in POP}


def expected(q, a):
    w = qw(q)
    ents = AE[a]
    common = set(w) & set(ents)
    efiaf_a = {e: ec / P[a] * math.log(N / POP[e]) for e, (ec, _) in ents.items()}
    return {
        "eciaf": sum(ents[e][0] * w[e] for e in common),
        "efiaf": sum(ents[e][0] / P[a] * w[e] for e in common),
        "log_ec_ef_iaf": sum((math.log(ents[e][0]) + ents[e][0] / P[a]) * w[e] for e in common),
        "cossim_efiaf": sum(efiaf_a[e] * w[e] for e in common)
        / (math.sqrt(sum(efiaf_a.values())) * math.sqrt(sum(w.values()))),
    }


def candidates(q):
    return {a for a, ents in AE.items() if set(ents) & Q[q]}


def test_query_weights(corpus, qe):
    got = {(r.query_id, r.entity): r.qw for r in scoring.query_weights(corpus, qe).collect()}
    want = {(q, e): v for q in Q for e, v in qw(q).items()}
    assert got.keys() == want.keys()  # unknown entities have no weight but count in |Q|
    for k in want:
        assert math.isclose(got[k], want[k])


def test_vector_scores(corpus, qe):
    got = {(r.query_id, r.author_id): r for r in scoring.vector_scores(corpus, qe).collect()}
    assert set(got) == {(q, a) for q in Q for a in candidates(q)}
    for (q, a), r in got.items():
        for k, v in expected(q, a).items():
            assert math.isclose(r[k], v, rel_tol=1e-12), (q, a, k)
    # E5 = P * E4 per (query, author)
    for (q, a), r in got.items():
        assert math.isclose(r.eciaf, P[a] * r.efiaf)


def test_citing_authors_and_empty_query(corpus, qe):
    got = {(r.query_id, r.author_id) for r in scoring.citing_authors(corpus, qe).collect()}
    assert got == {("q1", "a1"), ("q1", "a3"), ("q2", "a1"), ("q2", "a2")}
    assert not any(q == "q3" for q, _ in got)


def _rel(a, b):
    docs = {0: {"X", "Y"}, 1: {"X", "Z"}, 2: {"Y", "Z"}, 3: {"Y"}, 4: {"X", "W"}}
    if a == b:
        return 1.0
    A = {d for d, es in docs.items() if a in es}
    B = {d for d, es in docs.items() if b in es}
    both = len(A & B)
    if not A or not B or both == 0:
        return 0.0
    return max(0.0, 1 - (math.log(max(len(A), len(B))) - math.log(both))
               / (math.log(N) - math.log(min(len(A), len(B)))))


def test_cooccurrence_relatedness(corpus, spark):
    src = spark.createDataFrame([("X",), ("Y",)], "entity string")
    got = {(r.source, r.other): r.rel for r in relatedness.cooccurrence_relatedness(corpus, src).collect()}
    together = {("X", "Y"), ("X", "Z"), ("X", "W"), ("Y", "X"), ("Y", "Z")}
    assert set(got) == {p for p in together if _rel(*p) > 0}            # an absent pair means 0
    for (a, b), v in got.items():
        assert math.isclose(v, _rel(a, b), abs_tol=1e-12)
        assert 0.0 <= v <= 1.0
    assert got[("X", "W")] > 0 and _rel("X", "Z") == 0.0 and ("X", "Z") not in got


def test_relatedness_geom(corpus, qe):
    alpha, x = 1e-5, 10.0
    got = {(r.query_id, r.author_id): r.score for r in scoring.relatedness_geom_score(corpus, qe).collect()}
    assert set(got) == {(q, a) for q in Q for a in candidates(q)}
    for (q, a), score in got.items():
        terms = []
        for qent in Q[q]:
            vw = [(1 - _rel(qent, e) ** x + alpha, ec * mr) for e, (ec, mr) in AE[a].items()]
            g = math.exp(sum(w * math.log(v) for v, w in vw) / sum(w for _, w in vw))
            t = min(max(1 - g + alpha, 0.0), 1.0) ** (1 / x)
            # an entity unrelated to every author entity scores exactly 0 (the
            # reference's direct formula leaves float noise of ~1e-16 ** 0.1 there)
            if all(_rel(qent, e) == 0 for e in AE[a]):
                t = 0.0
            terms.append(t)
        assert math.isclose(score, sum(terms) / len(terms), rel_tol=1e-9, abs_tol=1e-12), (q, a)
        assert 0.0 <= score <= 1.0


def test_find_experts_ranks_and_names(corpus, qe):
    out = ranking.find_experts(corpus, qe, "eciaf_score").collect()
    q1 = [(r.author_id, r.name) for r in out if r.query_id == "q1"]
    assert q1 == [("a1", "Alice"), ("a3", "Carol")]  # 2*qw > 1*qw
    top = ranking.find_experts(corpus, qe, "efiaf_score", k=1, sort=False).collect()
    # q1: a1 and a3 tie on efiaf; the tie goes to the smaller author id
    assert {(r.query_id, r.author_id, r.rank) for r in top} == {("q1", "a1", 1), ("q2", "a2", 1)}


def test_all_scorings_long_form(corpus, qe):
    s = scoring.all_scorings(corpus, qe)
    names = {r.scoring for r in s.select("scoring").distinct().collect()}
    assert names == {"cossim_efiaf", "efiaf", "eciaf", "log_ec_ef_iaf", "relatedness_geom"}
    assert s.count() == 5 * 4


def test_registry(corpus, qe):
    with pytest.raises(ValueError):
        scoring.get_scoring("nope")
    scoring.register_scoring("const", lambda c, q, **_: scoring.citing_authors(c, q).selectExpr(
        "query_id", "author_id", "1.0 AS score"))
    assert ranking.find_experts(corpus, qe, "const").count() == 4
    r = scoring.random_score(corpus, qe).collect()
    assert all(0.0 <= x.score < 1.0 for x in r)
    assert sorted(r) == sorted(scoring.random_score(corpus, qe).collect())  # reproducible


def test_profiles_and_top(corpus):
    prof = {(r.author_id, r.entity): r for r in scoring.author_profiles(corpus).collect()}
    r = prof[("a3", "W")]
    assert math.isclose(r.ef, 1.0) and math.isclose(r.iaf, math.log(6)) and math.isclose(r.ef_iaf, math.log(6))
    assert all(p.iaf >= 0 and p.entity_popularity <= N for p in prof.values())
    top = ranking.author_profile_top(corpus, 1).collect()
    assert {(t.author_id, t.entity) for t in top} == {("a1", "X"), ("a2", "Y"), ("a3", "W")}
    a1x = [t for t in ranking.author_profile_top(corpus, 5).collect() if t.author_id == "a1" and t.entity == "X"][0]
    assert a1x.years_text == "2010(x2), 2011"


def test_missing_pairs(corpus, qe, spark):
    memo = spark.createDataFrame([("X", "Z", 0.5)], "entity_a string, entity_b string, rel double")
    need = {(r.entity_a, r.entity_b) for r in relatedness.needed_pairs(corpus, qe).collect()}
    # q1 x {a1: X, Z; a3: X, W}; q2 x {a1: X, Z; a2: Y} (Unknown pairs included)
    assert ("X", "Z") in need and ("W", "X") in need and ("Unknown", "X") in need
    miss = {(r.entity_a, r.entity_b) for r in relatedness.missing_pairs(relatedness.needed_pairs(corpus, qe), memo)
            .collect()}
    assert ("X", "Z") not in miss and miss == need - {("X", "Z")}
    upd = relatedness.update_memo(memo, spark.createDataFrame([("X", "Z", 0.9), ("W", "X", 0.1)],
                                                              "entity_a string, entity_b string, rel double"))
    assert sorted(tuple(r) for r in upd.collect()) == [("W", "X", 0.1), ("X", "Z", 0.5)]
