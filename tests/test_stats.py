"""Corpus statistics on the hand-made corpus (conftest.py)."""

import math

from pyspark.sql import functions as F

from adeptus.operators import stats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_author_entity_frequency(corpus):
    ae = corpus.author_entity()
    got = {(r.author_id, r.entity): (r.author_freq, r.max_rho, [(y.year, y.n) for y in r.years])
           for r in ae.collect()}
    assert got == {
        ("a1", "X"): (2, 0.9, [(2010, 2), (2011, 1)]),  # two confident mentions in d0, one in d1
        ("a1", "Z"): (1, 0.25, [(2011, 1)]),
        ("a2", "Y"): (2, 0.7, [(2010, 1), (2012, 1)]),  # Y in d0 (rho exactly 0.20) is not a1's
        ("a3", "X"): (1, 0.21, [(2011, 1)]),
        ("a3", "W"): (1, 0.4, [(2011, 1)]),
    }


def test_papers_popularity_total(corpus):
    assert rows(corpus.papers(), "author_id", "papers") == [("a1", 2), ("a2", 2), ("a3", 1)]
    assert rows(corpus.popularity(), "entity", "entity_popularity") == [("W", 1), ("X", 3), ("Y", 3), ("Z", 2)]
    assert corpus.total().first()["total_papers"] == 6  # d5 has no mention but counts


def test_institution_tables(corpus):
    d2 = stats.entity_institution_frequency(corpus.doc_entities(), corpus.documents)
    assert rows(d2, "entity", "institution", "frequency") == [
        ("W", "UniA", 1), ("X", "UniA", 2), ("X", "UniC", 1), ("Y", "UniA", 1), ("Y", "UniB", 2), ("Z", "UniB", 1),
        ("Z", "UniC", 1)]
    d3 = stats.institution_document_count(corpus.documents)
    assert rows(d3, "institution", "document_count") == [("UniA", 3), ("UniB", 2), ("UniC", 1)]
    assert sum(r.document_count for r in d3.collect()) == corpus.total().first()[0]
    d8 = stats.institution_author_count(corpus.authors)
    assert rows(d8, "institution", "authors") == [("UniA", 2), ("UniB", 2)]


def test_grouped_entities(corpus):
    g = stats.grouped_entities(corpus.mentions, min_freq=2)
    assert rows(g, "author_id", "entity", "year", "count") == [("a1", "X", 2010, 2)]
    r = g.first()
    assert math.isclose(r.avg_rho, 0.4) and r.min_rho == 0.3 and r.max_rho == 0.5
    g2 = stats.grouped_entities(corpus.mentions, year=2011)
    assert {(r.author_id, r.entity) for r in g2.collect()} == {("a1", "X"), ("a1", "Z"), ("a3", "X"), ("a3", "W")}
    rh = stats.grouped_entity_rhos(corpus.mentions).where("author_id = 'a1' AND entity = 'X'")
    assert rows(rh, "year", "rho", "n") == [(2010, 0.3, 1), (2010, 0.5, 1), (2011, 0.9, 1)]


def test_author_documents(corpus, spark):
    d = stats.author_documents(corpus.doc_entities(), ["X", "Z"])
    assert rows(d.where("author_id = 'a1'"), "document_id", "year", "entity", "count") == [
        (0, 2010, "X", 2), (1, 2011, "X", 1), (1, 2011, "Z", 1)]
    nested = stats.author_documents_nested(d).where("document_id = 1").first()
    assert [(e.entity, e["count"]) for e in nested.entities] == [("X", 1), ("Z", 1)]


def _mquantiles(values, probs, a=0.4, b=0.4):
    x = sorted(values)
    n = len(x)
    if n == 1:
        return [float(x[0])] * len(probs)
    out = []
    for p in probs:
        h = n * p + a + p * (1 - a - b)
        k = math.floor(min(max(h, 1), n - 1))
        g = min(max(h - k, 0), 1)
        out.append((1 - g) * x[k - 1] + g * x[k])
    return out


def test_quantiles_and_histogram(spark):
    counts = [1, 1, 1, 2, 2, 3, 5, 8, 13, 40, 1, 2]
    papers = spark.createDataFrame([(f"a{i}", c) for i, c in enumerate(counts)], "author_id string, papers long")
    q = stats.paper_count_quantiles(papers)
    got = [r.quantile for r in q.orderBy("i").collect()]
    want = _mquantiles(counts, [i / 10 for i in range(10)])
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want))
    h = stats.paper_count_histogram(papers, q).orderBy("i").collect()
    for i, r in enumerate(h):
        begin = int(want[i])
        end = int(want[i + 1]) - 1 if i < 9 else max(counts)
        assert (r.begin, r.end, r.authors) == (begin, end, sum(1 for c in counts if begin <= c <= end))
    cs = stats.corpus_stats(papers).first()
    assert (cs.documents, cs.authors) == (sum(counts), len(counts))


def test_quantiles_single_value(spark):
    papers = spark.createDataFrame([("a", 7)], "author_id string, papers long")
    assert {r.quantile for r in stats.paper_count_quantiles(papers).collect()} == {7.0}


def test_weighted_geom_mean(spark):
    df = spark.createDataFrame([("g", 2.0, 1.0), ("g", 8.0, 3.0)], "k string, v double, w double")
    got = df.groupBy("k").agg(stats.weighted_geom_mean("v", "w").alias("m")).first().m
    assert math.isclose(got, math.exp((1 * math.log(2) + 3 * math.log(8)) / 4))
    zero = df.where("k = 'none'").agg(stats.weighted_geom_mean(F.col("v"), F.col("w")).alias("m")).first().m
    assert zero is None
