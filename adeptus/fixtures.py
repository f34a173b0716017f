"""Stand-in inputs built from the driver's TPC-H-like tables (see FIXTURES.md).

These functions only shape rows into the schemas the operators expect; all
the work of a query happens in the library's operators.

* authors    <- customer ⋈ nation: author_id = c_custkey, name = c_name,
                institution = n_name
* documents  <- orders: document_id = o_orderkey, author_id = o_custkey,
                year = year(o_orderdate), body null (orders have no text),
                institution = name of nation o_orderkey % 25 (an author's papers
                come from several institutions)
* mentions   <- lineitem ⋈ orders ⋈ part: one mention of entity p_name per
                line item, rho = 10 * l_discount (0.0 .. 1.0)
* topics     <- one topic per distinct part name: query_id =
                'topic-' || smallest p_partkey with that name, text = p_name
* qrels      <- judged (topic, customer) pairs where the customer bought the
                topic's part name; rel = 2 for >= 100 units, 1 for >= 50, else 0
* papers     <- orders ⋈ customer ⋈ nation, abstract = documents.text of the
                document whose doc_id equals o_orderkey (null when none),
                doi = '10.0/' || o_orderkey for finished orders
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adeptus.corpus import Corpus
from adeptus.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # 25 rows by definition
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").cast("string").alias("author_id"),
                    F.col("c_name").alias("name"), F.col("n_name").alias("institution")))


def _orders(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("o_year"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.join(_institutions(spark, sf_dir), o.o_orderkey % 25 == F.col("place"), "left").select(
        F.col("o_orderkey").cast("long").alias("document_id"),
        F.col("o_custkey").cast("string").alias("author_id"),
        F.col("o_year").alias("year"),
        F.lit(None).cast("string").alias("body"), "institution")


def _institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The institution that a paper was written at: that of nation ``o_orderkey % 25``, so authors move."""
    n = read_table(spark, sf_dir, "nation")  # 25 rows by definition
    return F.broadcast(n.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("institution")))


def _bought(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    """Line items with part name, buyer and year; a task joins and groups the rows of its orders.

    The rows that a task gets are bounded by their number, not by their bytes: few bytes
    of a shuffle can be millions of line items, which a task's sorts and aggregates hold unpacked.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", measure)
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    o = _orders(spark, sf_dir)
    rows = li.count()                                  # from the files' footers
    named = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "p_name", measure)
    return spread(named, rows, "l_orderkey").join(spread(o, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_bought(spark, sf_dir, "l_discount")
            .select(F.col("p_name").alias("entity"),
                    F.col("o_custkey").cast("string").alias("author_id"),
                    F.col("l_orderkey").cast("long").alias("document_id"),
                    F.col("o_year").alias("year"),
                    (F.col("l_discount") * F.lit(10.0)).alias("rho")))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(authors(spark, sf_dir), documents(spark, sf_dir), mentions(spark, sf_dir))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (p.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
            .select(F.concat(F.lit("topic-"), F.col("k").cast("string")).alias("query_id"),
                    F.col("p_name").alias("text")))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = (_bought(spark, sf_dir, "l_quantity")
             .groupBy("p_name", "o_custkey").agg(F.sum("l_quantity").alias("units")))
    t = topics(spark, sf_dir).withColumnRenamed("text", "p_name")
    return (units.join(t, "p_name")
            .select("query_id", F.col("o_custkey").cast("string").alias("author_id"),
                    F.when(F.col("units") >= 100, 2).when(F.col("units") >= 50, 1).otherwise(0)
                    .cast("int").alias("rel")))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper rows (author_id, name, institution, year, abstract, doi, input_file)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").cast("int").alias("year"))
    a = authors(spark, sf_dir).drop("institution")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (o.join(a, o.o_custkey.cast("string") == a.author_id)
            .join(_institutions(spark, sf_dir), o.o_orderkey % 25 == F.col("place"), "left")
            .join(d, o.o_orderkey == d.doc_id, "left")
            .select("author_id", "name", "institution", "year",
                    F.col("text").alias("abstract"),
                    F.when(F.col("o_orderstatus") == "F",
                           F.concat(F.lit("10.0/"), F.col("o_orderkey").cast("string"))).alias("doi"),
                    F.col("o_orderkey").alias("ordinal"),
                    F.concat(F.lit("orders-"), F.col("o_orderstatus")).alias("input_file")))
