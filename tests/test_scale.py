"""Skew, bitmaps, ranks of large groups, sorted batches that appear whole, postings, sketches."""

import glob
import itertools
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adeptus import fixtures, schemas, session
from adeptus.corpus import Corpus
from adeptus.operators import ingest, linking, lookups, ranking, relatedness, scoring, skew, stats
from adeptus.sources import store
from adeptus.sources.store import UNIT, Store


def _corpus(spark, sets: dict) -> Corpus:
    """A corpus of documents with the given entity sets."""
    return Corpus(spark.createDataFrame([(f"a{i}", f"N{i}", "U") for i in range(7)], schemas.AUTHORS),
                  spark.createDataFrame([(d, f"a{d % 7}", 2000, None, "U") for d in sets], schemas.DOCUMENTS),
                  spark.createDataFrame([(e, f"a{d % 7}", d, 2000, 0.5) for d, es in sets.items() for e in es], schemas.MENTIONS))


def _related(sets: dict) -> dict:
    having = {}
    for d, es in sets.items():
        for e in es:
            having.setdefault(e, set()).add(d)
    out, n = {}, len(sets)
    for a, b in itertools.permutations(having, 2):
        both = len(having[a] & having[b])
        if both:
            hi, lo = max(len(having[a]), len(having[b])), min(len(having[a]), len(having[b]))
            rel = max(0.0, 1 - (math.log(hi) - math.log(both)) / (math.log(n) - math.log(lo))) if lo < n else float(both == hi)
            if rel > 0:
                out[a, b] = rel
    return out


def test_dealing_of_a_heavy_key(spark):
    """A key with a third of the rows: no (key, salt) has more rows than a task should get; the join is the same."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
                                    F.col("id").alias("v")).union(spark.createDataFrame([(None, 1)], "k string, v long"))
    heavy = skew.heavy_keys(rows, "k", per_task=100)
    assert [tuple(r) for r in heavy.collect()] == [("hot", 10)]
    dealt = skew.salted(rows, "k", "v", heavy)
    largest = dealt.groupBy("k", "salt").count().agg(F.max("count")).first()[0]
    assert largest < 150 and dealt.count() == 3001
    other = rows.select("k").distinct()
    joined = skew.replicated(other, "k", heavy).join(dealt, ["k", "salt"])
    assert joined.count() == 3000 and joined.where("k = 'hot'").select("v").distinct().count() == 1000
    assert skew.replicated(other, "k", heavy).count() == other.count() + 9
    assert skew.heavy_keys(rows, "k", per_task=1, most=10).count() == 1            # never more keys than that
    assert skew.heavy_keys(rows.where("false"), "k").count() == 0


@pytest.mark.parametrize("dense", [1e9, relatedness.DENSE, 1e-9])
def test_relatedness_by_bitmaps(spark, dense):
    """All pairs by bitmaps, the dense ones, none: always the same, with a document that has all entities."""
    rnd = random.Random(5)
    sets = {d * 3 + 1: {f"e{k}" for k in range(12) if rnd.random() < 0.8 / (k + 1)} for d in range(200)}
    sets[500] = {f"e{k}" for k in range(40)}
    c = _corpus(spark, sets)
    src = spark.createDataFrame([("e0",), ("e3",), ("e9",), ("nope",)], "entity string")
    got = {(r.source, r.other): r.rel for r in relatedness.cooccurrence_relatedness(c, src, dense, per_task=10).collect()}
    want = {p: r for p, r in _related(sets).items() if p[0] in ("e0", "e3", "e9")}
    assert set(got) == set(want) and all(math.isclose(got[p], want[p], abs_tol=1e-12) for p in want)


def test_pairs_of_bitmaps_are_few(spark):
    """Two entities of 6400 documents meet in 100 rows, a row for 64 documents, however many documents there are."""
    rows = spark.range(6400).select(F.col("id").alias("document_id"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("entity"))
    words = relatedness.bitmaps(rows)
    assert words.count() == 200 and words.agg(F.sum(F.bit_count("bits"))).first()[0] == 12800
    low = relatedness.bitmaps(spark.createDataFrame([(-1, "x"), (-64, "x"), (63, "x")], "document_id long, entity string"))
    assert sorted((r.word, bin(r.bits % 2**64).count("1")) for r in low.collect()) == [(-1, 2), (0, 1)]


def test_links_of_named_pages(spark):
    pages = [("p1", "A"), ("p1", "B"), ("p2", "A"), ("p2", "B"), ("p3", "C"), ("p4", "A"), ("p4", "C")]
    links = spark.createDataFrame(pages, "page string, entity string")
    numbers = spark.createDataFrame([(int(p[1:]), e) for p, e in pages], "page int, entity string")
    assert sorted(map(tuple, relatedness.link_relatedness(links).collect())) == \
        sorted(map(tuple, relatedness.link_relatedness(numbers).collect())) != []


def test_heavy_entity_scores_the_same(corpus, qe):
    want = sorted(scoring.relatedness_geom_score(corpus, qe).collect())
    assert sorted(scoring.relatedness_geom_score(corpus, qe, per_task=1).collect()) == want


def test_batch_of_scorings(corpus, qe):
    """One plan for several scorings gives what each gives alone; own scorings may be among them."""
    scoring.register_scoring("one", lambda c, q, **_: scoring.citing_authors(c, q).selectExpr("query_id", "author_id", "1.0D AS score"))
    names = [*scoring.FIVE, "one"]
    got = {(r.scoring, r.query_id, r.author_id): (r.name, r.score) for r in ranking.find_experts_batch(corpus, qe, names).collect()}
    want = {(n, r.query_id, r.author_id): (r.name, r.score) for n in names for r in ranking.find_experts(corpus, qe, n, sort=False).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)
    plan = ranking.find_experts_batch(corpus, qe, list(scoring.FIVE)[:4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand [") <= 1 and "Union" not in plan


def test_rank_within_large_groups(spark):
    """One group with a third of the rows, many small ones and null keys: the same as a window, over many ranges."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 200)).alias("k"),
                                  (F.col("id") % 2).alias("j"), F.col("id"))
    got = sorted(map(str, ingest.ranked_within(df, ["k", "j"], [F.desc("id")], "place", ranges=16).collect()))
    from pyspark.sql import Window
    want = sorted(map(str, df.withColumn("place", F.row_number().over(Window.partitionBy("k", "j").orderBy(F.desc("id")))).collect()))
    assert got == want
    assert ingest.ranked_within(df.where("false"), ["k"], [F.desc("id")], "place").count() == 0


def test_pairs_needed_beyond_the_memo(spark, corpus, qe):
    covered = spark.createDataFrame([("X",), ("Unknown",)], "entity string")
    every = {(r.entity_a, r.entity_b) for r in relatedness.needed_pairs(corpus, qe).collect()}
    left = {(r.entity_a, r.entity_b) for r in relatedness.needed_pairs(corpus, qe, covered).collect()}
    assert left == {p for p in every if not {"X", "Unknown"} & set(p)} and left
    assert relatedness.needed_pairs(corpus, qe, qe.select("entity").distinct()).count() == 0


def test_memo_of_sources(spark, corpus, qe, tmpdir_path):
    """Sources in two batches: the memo scores as without one, and holds each pair once."""
    st = store.open_store(spark, f"{tmpdir_path}/s")
    st.remember_relatedness(corpus, spark.createDataFrame([("X",), ("Y",)], "entity string"), "0")
    rel = st.remember_relatedness(corpus, qe, "1")
    assert sorted(r.entity for r in st.read("relatedness_sources").collect()) == ["Unknown", "X", "Y", "Z"]
    memo = st.read("relatedness_memo")
    assert memo.count() == memo.select("entity_a", "entity_b").distinct().count() > 0
    assert sorted(scoring.relatedness_geom_score(corpus, qe, rel).collect()) == sorted(scoring.relatedness_geom_score(corpus, qe).collect())


def test_batch_appears_whole(spark, corpus, tmpdir_path, monkeypatch):
    """A write broken after two tables is invisible; a retry replaces it; a batch written again is replaced."""
    st = store.open_store(spark, f"{tmpdir_path}/s")
    st.write(corpus, "b0")
    monkeypatch.setattr(stats, "paper_sketches", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        st.write(corpus, "b1")
    other = Corpus(corpus.authors, corpus.documents.where("document_id < 2"), corpus.mentions.where("document_id < 2"))
    with pytest.raises(ZeroDivisionError):
        st.write(other, "b0")
    assert st.batches() == ["b0"] and st.read("documents").count() == 6 and st.read("entity_occurrences").count() == 11
    monkeypatch.undo()
    monkeypatch.setattr(Store, "_mark", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        st.write(other, "b1")                                  # all tables, but no mark
    assert st.batches() == ["b0"]
    monkeypatch.undo()
    st.write(other, "b0")
    assert st.read("documents").count() == 2 and st.read("institutions").agg(F.sum("document_count")).first()[0] == 2
    st.vacuum()
    assert {t: len(glob.glob(f"{tmpdir_path}/s/{t}/*/*")) for t in UNIT} == dict.fromkeys(UNIT, 1)
    assert len(glob.glob(f"{tmpdir_path}/s/_units/b0~*")) == 1 and st.read("documents").count() == 2
    with pytest.raises(ValueError):
        st.add("documents", corpus.documents, "b2")


def test_lookups_read_one_file_of_many(spark, tmpdir_path):
    """Ranges of keys: files don't overlap, and a hot author's mentions are spread over several of them."""
    docs = spark.range(4000).select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 400)).alias("author_id"),
                                    F.lit(2000).alias("year"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("body"), F.lit("U").alias("institution"))
    mentions = docs.select(F.lit("E").alias("entity"), "author_id", "document_id", "year", F.lit(0.5).alias("rho"))
    c = Corpus(docs.select("author_id", F.lit("n").alias("name"), "institution").distinct(), docs, mentions)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        st = store.open_store(spark, f"{tmpdir_path}/s")
        st.write(c)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])

    def files(table: str, column: str, value) -> tuple[int, int]:
        """Files of a table, and those whose statistics allow the value."""
        stats_of = []
        for f in glob.glob(f"{tmpdir_path}/s/{table}/*/*/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index(column)
            stats_of += [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        return len(stats_of), sum(s.min <= value <= s.max for s in stats_of)

    assert files("documents", "document_id", 1234) == (8, 1)
    assert files("entity_occurrences", "author_id", "a101")[1] == 1 and files("entity_occurrences", "author_id", "hot")[1] >= 2
    found = lookups.documents_by_id(st.read("documents"), [1234])
    assert found.count() == 1 and "EqualTo(document_id,1234)" in found._jdf.queryExecution().executedPlan().toString()
    assert lookups.author_mentions(st.read("entity_occurrences"), ["hot"]).count() == 1334


def test_completion_by_postings(spark):
    rnd = random.Random(9)
    names = ["".join(rnd.choice("abAB _%\\é") for _ in range(rnd.randint(0, 9))) for _ in range(400)] + [None, "İstanbul Örs", "ΟΔΟΣ"]
    authors = spark.createDataFrame([(f"x{i:03d}", n, "U") for i, n in enumerate(names)], "author_id string, name string, institution string")
    postings = lookups.trigram_index(authors)
    for term in ("aba", "ab ba", "B_a", "a%b", "\\ab", "éab", "", "a", "istanbul", "örs", "οδος", "aBAb", "none such"):
        want = lookups.author_completion(authors, term, 1000).collect()
        assert lookups.author_completion(authors, term, 1000, postings).collect() == want, term
    plan = lookups.author_completion(authors, "aba", postings=postings)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(trigram,aba)]" in plan or "EqualTo(trigram,aba)" in plan


def test_paper_sketches_merge(spark, tmpdir_path):
    """Batches of 20000 and 10000 documents, 5000 in both: 25000 within three standard errors; mentions aren't read."""
    def batch(lo, hi):
        m = spark.range(lo, hi).select(F.lit("E").alias("entity"), F.when(F.col("id") < 3, "few").otherwise("many").alias("author_id"),
                                       F.col("id").alias("document_id"), F.lit(2000).alias("year"), F.lit(0.5).alias("rho"))
        return Corpus(spark.createDataFrame([("few", "F", "U"), ("many", "M", "U")], schemas.AUTHORS),
                      spark.createDataFrame([], schemas.DOCUMENTS), m)
    st = store.open_store(spark, f"{tmpdir_path}/s")
    st.write(batch(0, 20000))
    st.write(batch(15000, 25000))
    got = {r.author_id: r.papers for r in st.approx_papers_count().collect()}
    assert got["few"] == 3 and abs(got["many"] - 24997) < 24997 * 3 / math.sqrt(2 ** stats.SKETCH_PRECISION)
    plan = st.approx_papers_count()._jdf.queryExecution().executedPlan().toString()
    assert "paper_sketches" in plan and "entity_occurrences" not in plan


def test_corpus_build_deals_by_rows(spark, tmp_path, monkeypatch):
    """Line items are joined in tasks of few rows, however few bytes they are; null and repeated keys as in a plain join."""
    monkeypatch.setattr(session, "SPREAD_ROWS", 200)
    items = [(i % 500 if i % 50 else None, i % 7 if i % 60 else None, float(i % 3), .1) for i in range(3000)]
    orders = [(k % 499, k % 11) for k in range(500)]                  # order 0 twice, 499 absent
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("1997-01-01").cast("timestamp")) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"part {k % 3}") for k in range(7)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = fixtures.mentions(spark, str(tmp_path))
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 600 and len(items) / most > 4
    by_order = {}
    for o, c in orders:
        by_order.setdefault(o, []).append(c)
    want = sorted((f"part {p % 3}", str(c), o) for o, p, _, _ in items if o is not None and p is not None for c in by_order.get(o, []))
    assert sorted((r.entity, r.author_id, r.document_id) for r in found.collect()) == want


def test_linking_deals_by_characters(spark, monkeypatch):
    """Texts are split into words, and spans ordered, in tasks of few of them, however well they compress."""
    monkeypatch.setattr(linking, "TASK_CHARS", 4000)
    monkeypatch.setattr(linking, "TASK_SPANS", 500)
    texts = spark.createDataFrame([(i, "a big, big apple " * 20) for i in range(120)], "id long, text string")
    rows = linking.tokenize(texts).groupBy(F.spark_partition_id()).count()
    assert rows.agg(F.max("count")).first()[0] < 20 * 80 and rows.count() > 8
    gaz = spark.createDataFrame([("big apple", "NYC", 1.0, 1.0), ("apple", "Fruit", 1.0, 1.0), ("a", "A", 1.0, 1.0)],
                                "surface string, entity string, commonness double, link_prob double")
    spans = linking.longest_spans(texts, gaz, "id", "text")
    assert spans.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20 * 80
    assert spans.count() == 120 * 40                       # 'apple' lies in 'big apple'


def test_senses_are_voted_once_a_surface(spark, monkeypatch):
    """What meets the relatedness rows is a row per surface and sense of a text, however often it is mentioned."""
    kept = {}

    def keep(df, name):
        kept[name] = session.written(df, name)
        return kept[name]

    monkeypatch.setattr(linking, "written", keep)
    texts = spark.createDataFrame([(i, "jaguar lion " * (50 + i)) for i in range(4)], "id long, text string")
    gaz = spark.createDataFrame([("jaguar", "Car", 0.8, 0.5), ("jaguar", "Cat", 0.2, 0.5), ("lion", "Lion", 1.0, 0.4)],
                                "surface string, entity string, commonness double, link_prob double")
    rel = spark.createDataFrame([("Cat", "Lion", 0.9), ("Lion", "Cat", 0.9)], "source string, other string, rel double")
    got = linking.link_entities_voted(texts, gaz, rel).collect()
    assert kept["candidates"].count() == 4 * 3
    assert len(got) == sum(2 * (50 + i) for i in range(4)) and {r.entity for r in got} == {"Car", "Cat", "Lion"} - {"Car"}


def test_ranks_of_large_groups_in_one_shuffle(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 200)).alias("k"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("j"), "id")
    ranked = ingest.ranked_within(df, ["k", "j"], [F.desc("id")], "place", ranges=16, large_groups=True)
    plain = df.withColumn("place", F.row_number().over(Window.partitionBy("k", "j").orderBy(F.desc("id"))))
    assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.collect()))
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ingest.ranked_within(df.where("false"), ["k"], [F.desc("id")], "place", large_groups=True).count() == 0


def test_scorings_with_names(spark, corpus, qe):
    """Names joined to the wide rows are those of a join with the long ones; unknown authors have null."""
    who = corpus.authors.where("author_id <> 'a2'")
    long = scoring.all_scorings(corpus, qe)
    want = long.join(who.select("author_id", "name"), "author_id", "left").select("query_id", "author_id", "scoring", F.round("score", 9), "name")
    got = scoring.all_scorings(corpus, qe, authors=who).select("query_id", "author_id", "scoring", F.round("score", 9), "name")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []
