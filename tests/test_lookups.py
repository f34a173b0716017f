"""Lookups and result shapes."""

import json

import pytest

from adeptus.operators import lookups, ranking, scoring, stats


def test_completion(spark):
    authors = spark.createDataFrame(
        [(f"a{i:03d}", n, "U") for i, n in enumerate(
            ["John Smith", "JOHN  smithson", "Jo Smith", "Mary 50% Jones", "back\\slash", "Ann_Lee", "AnnXLee"])],
        "author_id string, name string, institution string")
    assert lookups.completion_pattern("john   smith") == "%john%smith%"

    def names(term):
        return [r.name for r in lookups.author_completion(authors, term).collect()]
    assert names("john smith") == ["John Smith", "JOHN  smithson"]     # case-insensitive, runs of space -> %
    assert names("50%") == ["Mary 50% Jones"]
    assert names("ann_lee") == ["Ann_Lee", "AnnXLee"]                  # '_' stays a wildcard
    assert names("back\\slash") == ["back\\slash"]                     # backslash is literal
    many = spark.createDataFrame([(f"x{i:03d}", "Same Name", "U") for i in range(80)],
                                 "author_id string, name string, institution string")
    got = lookups.author_completion(many, "same").collect()
    assert len(got) == 50 and got[0].author_id == "x000" and got[-1].author_id == "x049"


def test_ids_by_name_and_document_json(spark, corpus):
    ids = lookups.author_ids_by_name(corpus.authors, ["Alice", "Nobody"]).collect()
    assert [(r.name, r.author_id) for r in ids] == [("Alice", "a1")]
    doc = {r.document_id: json.loads(r.json) for r in lookups.document_json(corpus.documents).collect()}
    assert doc[2] == {"author_id": "a2", "ret_doc_id": 2, "year": 2010}


def test_author_card(corpus):
    card = {(r.author_id, r.entity): r for r in lookups.author_card(corpus).collect()}
    r = card[("a1", "X")]
    assert (r.name, r.papers_count, r.rank, r.frequency, r.years) == ("Alice", 2, 1, 2, "2010:2,2011:1")
    assert card[("a1", "Z")].rank == 2
    assert ("a4", "X") not in card and ("a1", "Y") not in card   # rho exactly 0.20 is not confident


def test_experts_json(corpus, qe):
    ranked = ranking.find_experts(corpus, qe, "eciaf_score", sort=False)
    out = {r.query_id: json.loads(r.json) for r in lookups.experts_json(ranked, k=1).collect()}
    assert [e["author_id"] for e in out["q1"]] == ["a1"]
    assert out["q1"][0]["rank"] == 1 and out["q1"][0]["name"] == "Alice"


def test_single_keys(spark, corpus, tmpdir_path):
    corpus.documents.write.parquet(f"{tmpdir_path}/d")
    one = lookups.documents_by_id(spark.read.parquet(f"{tmpdir_path}/d"), [2])
    assert [(r.author_id, r.year) for r in one.collect()] == [("a2", 2010)]
    assert "EqualTo(document_id,2)" in one._jdf.queryExecution().executedPlan().toString()    # pushed to the scan
    assert [(r.name, r.institution) for r in lookups.authors_by_id(corpus.authors, ["a3"]).collect()] == [("Carol", "UniA")]
    assert lookups.author_mentions(corpus.mentions, ["a1"]).count() == 5
    assert [r.papers for r in lookups.author_papers_count(corpus.papers(), ["a2"]).collect()] == [2]
    counts = stats.institution_document_count(corpus.documents)
    assert [r.document_count for r in lookups.institution_papers_count(counts, ["UniA", "Nope"]).collect()] == [3]


def test_entity_lists(spark):
    asked = spark.createDataFrame([("r1", '["X", "a b"]'), ("r2", "[]"), ("r3", "nonsense")], "r string, entities string")
    got = sorted((r.r, r.entity) for r in lookups.entity_lists(asked).collect() if r.entity is not None)
    assert got == [("r1", "X"), ("r1", "a b")]


def test_response_shapes(corpus, qe):
    rows = {(r.author_id, r.rank): json.loads(r.json) for r in lookups.author_rows_json(corpus).collect()}
    assert rows[("a1", 0)] == {"id": "a1", "name": "Alice", "papers_count": 2}
    assert rows[("a1", 1)] == {"entity": "X", "frequency": 2, "years": [[2010, 2], [2011, 1]]}
    names = json.loads(lookups.completion_json(corpus.authors, "a").first().json)["authors"]
    assert names[0] == {"id": "a1", "name": "Alice", "institution": "UniA"} and len(names) == 3
    hits = {(r.query_id, r.scoring, r.rank): json.loads(r.json)["author_id"]
            for r in lookups.query_rows_json(scoring.all_scorings(corpus, qe), corpus.authors).collect()}
    assert hits[("q1", "eciaf", 1)] == "a1" and hits[("q1", "eciaf", 2)] == "a3"


@pytest.mark.parametrize("page_rows", [1, 2, 1000])
def test_nested_answers(spark, corpus, qe, page_rows):
    """Pages hold every row of the long forms once, in their order, at most ``page_rows`` each."""
    flat = {}
    for r in sorted(lookups.author_rows_json(corpus).collect(), key=lambda r: (r.author_id, r.rank)):
        flat.setdefault(r.author_id, []).append(json.loads(r.json))
    nested = {}
    for r in sorted(lookups.author_answers_json(corpus, page_rows).collect(), key=lambda r: (r.author_id, r.page)):
        one = json.loads(r.json)
        assert r.page == len(nested.get(r.author_id, ())) and len(one["entities"]) <= page_rows
        nested.setdefault(r.author_id, []).append(one)
    assert nested.keys() == flat.keys()
    for a, pages in nested.items():
        assert [e for p in pages for e in p.pop("entities")] == flat[a][1:] and all(p == flat[a][0] for p in pages)

    asked = qe.unionByName(spark.createDataFrame([("q0", "nowhere"), ("q0", "at all")], "query_id string, entity string"),
                           allowMissingColumns=True)
    scores = scoring.all_scorings(corpus, asked)
    hits = {}
    for r in sorted(lookups.query_rows_json(scores, corpus.authors).collect(), key=lambda r: r["rank"]):
        hits.setdefault((r.query_id, r.scoring), []).append(json.loads(r.json))
    got = {}
    for r in sorted(lookups.query_answers_json(scores, corpus.authors, asked, page_rows).collect(), key=lambda r: r.page):
        one = json.loads(r.json)
        assert list(one) == [f"experts_{s}" for s in lookups.ANSWER_SCORINGS] + ["query_entities"]
        if r.query_id == "q0":
            assert r.page == 0 and one.pop("query_entities") == ["at all", "nowhere"] and not any(one.values())
        for s in lookups.ANSWER_SCORINGS:
            assert len(one[f"experts_{s}"]) <= page_rows
            got.setdefault((r.query_id, s), []).extend(one[f"experts_{s}"])
    assert {k: v for k, v in got.items() if v} == hits and hits


def test_query_answers_of_groups_of_queries(corpus, qe):
    scores = scoring.all_scorings(corpus, qe, authors=corpus.authors)
    whole = lookups.query_answers_json(scores, corpus.authors, qe, 1)
    few = lookups.query_answers_json(scores, corpus.authors, qe, 1, hits_together=2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))


def test_timed_run(corpus, qe):
    run, lines = ranking.timed_run(corpus, qe, "eciaf_score")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, ranking.find_experts(corpus, qe, "eciaf_score").collect()))
    lines = [r.value.split(" ") for r in lines.collect()]
    assert sorted(q for q, _ in lines) == sorted(r.query_id for r in qe.select("query_id").distinct().collect())
    assert len({s for _, s in lines}) == 1 and all(float(s) > 0 for _, s in lines)


def test_profile_report_and_topics(spark, corpus):
    rep = ranking.profile_report(corpus, ["Alice", "Nobody"], 1).collect()
    assert [(r.name, r.institution, r.entity) for r in rep] == [("Alice", "UniA", "X")]
    topics = spark.createDataFrame([("t2", "b"), ("t1", "a"), ("t3", "c")], "query_id string, text string")
    qrels = spark.createDataFrame([("t3", "x", 1), ("t1", "x", 0), ("t9", "x", 1)], "query_id string, author_id string, rel int")
    assert sorted((r.position, r.query_id) for r in ranking.judged_topics(qrels, topics).collect()) == [(0, "t1"), (1, "t3")]
    assert [r.query_id for r in ranking.unknown_topics(qrels, topics).collect()] == ["t9"]
