"""Ingest operators, file readers and the store."""

import os
import random

import pandas as pd
from pyspark.sql import functions as F

from adeptus.operators import ingest, linking, relatedness, scoring
from adeptus.sources import readers, store


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_assign_ids_consecutive(spark):
    df = spark.createDataFrame([(o, f"a{o % 3}") for o in [5, 1, 99, 42, 7, 1000, 3]], "ordinal long, author_id string")
    got = {r.ordinal: r.document_id for r in ingest.assign_document_ids(df, start=10, ranges=3).collect()}
    assert got == {o: 10 + i for i, o in enumerate(sorted(got))}


def test_first_wins_last_wins_pending(spark):
    papers = spark.createDataFrame([("a", "A2", "U2", 2), ("a", "A1", "U1", 1), ("b", "B", "V", 3)],
                                   "author_id string, name string, institution string, ordinal long")
    first = {r.author_id: (r.name, r.institution) for r in ingest.authors_first_wins(papers).collect()}
    assert first == {"a": ("A1", "U1"), "b": ("B", "V")}
    existing = spark.createDataFrame([("b", "Old", "W")], "author_id string, name string, institution string")
    merged = {r.author_id: r.name for r in ingest.authors_first_wins(papers, existing).collect()}
    assert merged == {"a": "A1", "b": "Old"}
    assoc = spark.createDataFrame([("d1", "x", 1), ("d1", "y", 2), ("d2", "z", 3)],
                                  "document_id string, author_id string, line_no long")
    assert {r.document_id: r.author_id for r in ingest.last_wins(assoc).collect()} == {"d1": "y", "d2": "z"}
    done = spark.createDataFrame([("d1",)], "document_id string")
    assert [r.document_id for r in ingest.pending(assoc.select("document_id").distinct(), done, "document_id")
            .collect()] == ["d2"]


def test_ingest_summary(spark):
    papers = spark.createDataFrame([
        ("f", 2005, "x" * 20, None), ("f", 2010, "x" * 20, "10/1"), ("f", 2010, "short", "10/2"),
        ("f", 2010, None, ""), ("g", 2017, None, "10/3")],
        "input_file string, year int, abstract string, doi string")
    got = {r.input_file: tuple(r)[1:] for r in ingest.ingest_summary(papers, 2006, 2017).collect()}
    assert got == {"f": (4, 3, 1, 1), "g": (1, 1, 0, 1)}


def test_semicolon_reader(spark, tmpdir_path):
    def row(fields):
        return ";".join(fields)
    base = ["id1", "rossi", "mario", "x", "Univ Pisa", "x", "2010", "x", "x", "x", "x", "10.1/abc", "x",
            '"An abstract; with a semicolon\nand a newline and a ""quote"" € è"', "x", "x", "x", "x", "x", "x"]
    assert len(base) == 20
    short = base[:19]
    long = base + ["extra"]
    bad_year = list(base)
    bad_year[0], bad_year[6] = "id4", "20x0"
    second = list(base)
    second[0], second[1], second[2] = "id2", "d'àngelo", "nicolò"
    text = "\n".join(row(r) for r in [base, short, long, bad_year, second]) + "\n"
    _write(f"{tmpdir_path}/in/a.csv", text.encode("cp1252"))
    p = readers.read_papers(spark, f"{tmpdir_path}/in/*.csv", "unipi").orderBy("ordinal").collect()
    assert [r.author_id for r in p] == ["id1", "id2"]
    assert p[0].name == "Mario Rossi" and p[1].name == "Nicolò D àngelo"
    assert p[0].abstract == 'An abstract; with a semicolon\nand a newline and a "quote" € è'
    assert (p[0].institution, p[0].year, p[0].doi) == ("Univ Pisa", 2010, "10.1/abc")
    lost = readers.rejected_papers(spark, f"{tmpdir_path}/in/*.csv", "unipi").first()
    assert (lost.records, lost.bad_fields, lost.bad_year) == (5, 2, 1)
    try:
        readers.read_papers(spark, tmpdir_path, "nope")
        raise AssertionError("unknown format accepted")
    except ValueError:
        pass


def test_tu_reader_and_writer_roundtrip(spark, tmpdir_path):
    rows = spark.createDataFrame([("d1", "au1", 'text, with "quotes"\nand lines'), ("d2", "au2", "plain")],
                                 "doc_id string, author_id string, text string")
    store.write_papers_csv(rows, f"{tmpdir_path}/merged")
    p = readers.read_papers(spark, f"{tmpdir_path}/merged/*.csv", "tu").collect()
    got = {r.author_id: (r.name, r.institution, r.year, r.abstract, r.doi) for r in p}
    assert got["au1"] == ("Name of au1", "TU", 2017, 'text, with "quotes"\nand lines', None)
    _write(f"{tmpdir_path}/tu/a.csv", b"d1,au1,fine\nd2,au2\nd3,au3,one,two\n")
    assert readers.read_papers(spark, f"{tmpdir_path}/tu/*.csv", "tu").count() == 1
    lost = readers.rejected_papers(spark, f"{tmpdir_path}/tu/*.csv", "tu").first()
    assert (lost.records, lost.bad_fields, lost.bad_year) == (3, 2, 0)


def test_xml_topics_qrels_assoc_text_dir(spark, tmpdir_path):
    _write(f"{tmpdir_path}/xml/a/1.xml", b"<doc><docno>D1</docno><title>T</title><body>hello <b>bold</b> world</body></doc>")
    _write(f"{tmpdir_path}/xml/a/2.xml", b"<doc><body>no number</body></doc>")
    _write(f"{tmpdir_path}/xml/b/3.xml", b"<doc><body>broken</doc>")
    x = {r.docno: r.text for r in readers.read_xml_dump(spark, f"{tmpdir_path}/xml/*/*.xml").collect()}
    assert x == {"D1": "hello  bold  world", "NONE_2.xml": "no number"}  # document order
    assert readers.broken_xml_files(spark, f"{tmpdir_path}/xml/*/*.xml").count() == 1
    plan = readers.read_xml_dump(spark, f"{tmpdir_path}/xml/*/*.xml")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    _write(f"{tmpdir_path}/topics.tsv", "1\tdata structures\n2\tmachine learning \n\n".encode())
    t = {r.query_id: r.text for r in readers.read_topics(spark, f"{tmpdir_path}/topics.tsv").collect()}
    assert t == {"topic-1": "data structures", "topic-2": "machine learning"}
    _write(f"{tmpdir_path}/topics.csv", "7;a;b c\n".encode())
    t2 = readers.read_topics(spark, f"{tmpdir_path}/topics.csv", sep=";").collect()
    assert [(r.query_id, r.text) for r in t2] == [("7", "a;b c")]
    _write(f"{tmpdir_path}/q.qrel", "topic-1\t0\tau1\t1\ntopic-1\t0\tau2\t0\nthree\tfields\tonly\n".encode())
    q = readers.read_qrels(spark, f"{tmpdir_path}/q.qrel").collect()
    assert sorted(tuple(r) for r in q) == [("topic-1", "au1", 1), ("topic-1", "au2", 0)]
    assert [r.record for r in readers.rejected_qrels(spark, f"{tmpdir_path}/q.qrel").collect()] == ["three\tfields\tonly"]
    assert readers.rejected_topics(spark, f"{tmpdir_path}/topics.csv").count() == 1     # no tab in it
    _write(f"{tmpdir_path}/all.assoc", b"au1 d1 x\nau2 d1\nau3 d2\n")
    a = ingest.last_wins(readers.read_assoc(spark, f"{tmpdir_path}/all.assoc"))
    assert {r.document_id: r.author_id for r in a.collect()} == {"d1": "au2", "d2": "au3"}
    _write(f"{tmpdir_path}/txt/d1.txt", b"first text")
    _write(f"{tmpdir_path}/txt/d2.txt", b"")
    texts = readers.read_text_dir(spark, f"{tmpdir_path}/txt/*.txt")
    merged = ingest.merge_documents_authors(a, texts.withColumnRenamed("doc_id", "document_id"))
    assert [(r.document_id, r.author_id) for r in merged.collect()] == [("d1", "au2")]


def test_build_corpus_and_store_append(spark, tmpdir_path):
    gaz = spark.createDataFrame([("graph", "Graph", 1.0, 0.9), ("data", "Data", 1.0, 0.1)],
                                "surface string, entity string, commonness double, link_prob double")

    def annotator(df):
        return linking.link_entities(df, gaz)

    papers = spark.createDataFrame([
        ("a1", "Ann", "U", 2010, "graph data & more graph", None, 1),
        ("a1", "Ann X", "V", 2011, "too short", None, 2),
        ("a2", "Bo", "U", 2012, "nothing to link here", "10/x", 3),
        ("a3", "Cy", "W", 2001, "graph graph graph graph", None, 4)],
        "author_id string, name string, institution string, year int, abstract string, doi string, ordinal long")
    c = ingest.build_corpus(papers, annotator, 2006, 2017)
    assert {r.author_id: r.name for r in c.authors.collect()} == {"a1": "Ann", "a2": "Bo"}
    docs = {r.document_id: r for r in c.documents.collect()}
    assert sorted(docs) == [0, 1]
    assert docs[0].body.startswith("<span class='annotation' entity='Graph' score='0.9'>graph</span> ")
    assert "&amp;" in docs[0].body
    assert c.mentions.count() == 3
    st = store.write_store(store.open_store(spark, f"{tmpdir_path}/store", erase=True), c)
    assert st.next_document_id() == 2
    more = spark.createDataFrame([("a2", "Bo New", "Z", 2015, "graph theory graph", None, 1),
                                  ("a4", "Di", "Z", 2015, "more data here", None, 2)], papers.schema)
    c2 = ingest.build_corpus(more, annotator, start_id=st.next_document_id())
    st.write(c2)
    back = st.corpus()
    assert {r.author_id: r.name for r in back.authors.collect()} == {"a1": "Ann", "a2": "Bo", "a4": "Di"}
    assert sorted(r.document_id for r in back.documents.collect()) == [0, 1, 2, 3]
    ent = {(r.entity, r.institution): r.frequency for r in st.read("entities").collect()}
    assert (ent[("Graph", "U")], ent[("Graph", "Z")]) == (1, 1)  # a2's new paper is from Z
    inst = {r.institution: r.document_count for r in st.read("institutions").collect()}
    assert inst == {"U": 2, "Z": 2}
    store.write_topics(spark.createDataFrame([("1", " x\ty ")], "query_id string, text string"), f"{tmpdir_path}/t")
    assert spark.read.text(f"{tmpdir_path}/t").first().value == "1;x y"
    lines = store.evaluation_report_lines(spark.createDataFrame([("map", "all", 0.5)], "measure string, "
                                                                "query_id string, value double")).first().value
    assert lines.split("\t") == ["map" + " " * 19, "all", "0.5000"]


def test_write_texts_and_lines(spark, tmpdir_path):
    texts = spark.createDataFrame([("D1", "first"), ("NONE_2.xml", "second")], "docno string, text string")
    store.write_texts(texts, f"{tmpdir_path}/texts")
    back = {r.docno: r.text for r in spark.read.parquet(f"{tmpdir_path}/texts").collect()}
    assert back == {"D1": "first", "NONE_2.xml": "second"}
    store.write_lines(spark.createDataFrame([("a b",), ("c",)], "value string"), f"{tmpdir_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmpdir_path}/lines").collect()) == ["a b", "c"]


def test_input_order_over_many_splits(spark, tmpdir_path):
    """Two files in more than 400 splits keep file and line order, without repeats."""
    os.makedirs(f"{tmpdir_path}/assoc")
    want = []
    for name in ("b", "a"):
        lines = [f"{name}{k:05d} doc{k}" for k in range(3000)]
        with open(f"{tmpdir_path}/assoc/{name}.txt", "w") as f:
            f.write("\n".join(lines) + "\n")
        want = [x.split(" ")[0] for x in lines] + want
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = readers.read_assoc(spark, f"{tmpdir_path}/assoc/*.txt")
        assert spark.read.text(f"{tmpdir_path}/assoc/*.txt").rdd.getNumPartitions() > 400
        got = df.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len({r.line_no for r in got}) == len(got) == 6000
    assert [r.author_id for r in sorted(got, key=lambda r: r.line_no)] == want


def test_texts_are_annotated_once(spark, tmpdir_path):
    """100 documents: 100 annotator rows on the build, none on a second build with the memo."""
    rows = spark.sparkContext.accumulator(0)

    def annotator(df):
        def run(batches):
            for pdf in batches:
                rows.add(len(pdf))
                yield pd.DataFrame({"id": pdf["id"], "begin": 0, "end": 4, "entity": "E", "rho": 0.5})
        return df.mapInPandas(run, "id string, begin int, end int, entity string, rho double")

    papers = spark.createDataFrame([(f"a{i % 9}", "N", f"U{i % 4}", 2010, f"text number {i} of many", None, i) for i in range(100)],
                                   "author_id string, name string, institution string, year int, abstract string, doi string, ordinal long")
    st = store.open_store(spark, f"{tmpdir_path}/store")
    for k, want in (("000000", 100), ("000001", 100)):
        c = ingest.build_corpus(papers, st.remembering(annotator, k), start_id=st.next_document_id())
        st.write(c, k)
        assert rows.value == want
    assert st.read("documents").count() == st.read("entity_occurrences").count() == 200
    assert st.corpus().popularity().collect() == [("E", 200)]
    assert st.read("institutions").agg(F.sum("document_count")).first()[0] == 200


def test_relatedness_memo(spark, corpus, qe, tmpdir_path):
    st = store.open_store(spark, f"{tmpdir_path}/store")
    rel = relatedness.cooccurrence_relatedness(corpus, qe)
    st.add("relatedness_memo", relatedness.symmetric_pairs(rel), "000000")
    from_memo = scoring.relatedness_geom_score(corpus, qe, st.relatedness()).collect()
    assert sorted(from_memo) == sorted(scoring.relatedness_geom_score(corpus, qe).collect())


def test_numbered_hot_key(spark):
    """A key with a third of the rows is spread over the ranges, since the order goes on within it."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    got = ingest.numbered(df, [F.col("k"), F.desc("id")], "place", ranges=16).collect()
    want = sorted(((("hot" if i % 3 == 0 else f"k{i}"), -i) for i in range(3000)))
    assert [(r.k, -r.id) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(3000))


def test_quoted_csv_in_splits(spark, tmpdir_path):
    """Fields with quotes, line breaks and blank lines in them, cut into many splits: the same as one task reads."""
    rnd, rows = random.Random(8), []
    pieces = ["plain", 'say ""yes""', "two\nlines", "a\r\nb", ",", "x\n\n\ny", "é文", '""', "z" * 300]
    for i in range(600):
        text = " ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6)))
        rows.append(f'{i},a{i % 7},"{text}"' if i % 50 else f"{i},short")      # some have a field too few
    os.makedirs(f"{tmpdir_path}/q")
    with open(f"{tmpdir_path}/q/a.csv", "w", newline="", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\n")
    with open(f"{tmpdir_path}/q/b.csv", "w", newline="", encoding="utf-8") as f:
        f.write("".join(f"{r}\r\n" for r in rows[:40]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = readers.csv_options(spark.read.schema(readers.csv_schema(readers.TU_FIELDS))).csv(f"{tmpdir_path}/q/*.csv")
    want = sorted((r.doc_id, r.text) for r in one.where(f"{readers.BAD} IS NULL").collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        splits = spark.read.text(f"{tmpdir_path}/q/*.csv").rdd.getNumPartitions()
        papers = readers.read_papers_tu(spark, f"{tmpdir_path}/q/*.csv").orderBy("ordinal").collect()
        bad = {r.input_file[-5:]: (r.records, r.bad_fields) for r in readers.rejected_papers(spark, f"{tmpdir_path}/q/*.csv", "tu").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 10 and len(want) == 588 + 39
    assert sorted((r.name[8:], r.abstract) for r in papers) == sorted(("a%d" % (int(i) % 7), t) for i, t in want)
    first = readers.csv_options(spark.read.schema(readers.csv_schema(readers.TU_FIELDS))).csv(f"{tmpdir_path}/q/a.csv")
    first = sorted((int(r.doc_id), r.text) for r in first.where(f"{readers.BAD} IS NULL").collect())
    assert [r.abstract for r in papers if r.input_file.endswith("a.csv")] == [t for _, t in first]      # in input order
    assert bad == {"a.csv": (600, 12), "b.csv": (40, 1)}
