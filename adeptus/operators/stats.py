"""Corpus statistics (counts, frequencies, popularity, quantiles).

Plan shape.  Mentions are collapsed once to one row per (document, entity)
keeping both the unfiltered mention count ``n_all`` and the count of
confident mentions ``n_strong`` (rho > min_rho).  Every statistic is then an
aggregation of that table, so ``COUNT(DISTINCT document_id)`` becomes a plain
``count`` and each shuffle carries map-side pre-aggregated rows: a hot author,
entity or document costs one row per map task, never one task per key.
Lists the reference builds with ``GROUP_CONCAT`` are kept as bounded
histograms (year -> count) or as long-form rows, never as unbounded arrays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adeptus.corpus import DEFAULT_MIN_RHO
from adeptus.operators.ingest import ranked_within

#: Base-2 logarithm of a paper sketch's registers: a relative error of about 1.6 %.
SKETCH_PRECISION = 12


def _entity_set(spark, entities) -> DataFrame:
    """A one-column ``entity`` DataFrame from a DataFrame or a Python list (the planner picks the join)."""
    if isinstance(entities, DataFrame):
        return entities.select("entity").distinct()
    return spark.createDataFrame([(e,) for e in set(entities)], "entity string")


# --------------------------------------------------------------------------
# D4 / D7 / D5 building blocks
# --------------------------------------------------------------------------
def doc_entities(mentions: DataFrame, min_rho: float = DEFAULT_MIN_RHO) -> DataFrame:
    """One row per (document, entity): mention counts and max rho.

    Columns: author_id, document_id, year, entity, n_all, n_strong, max_rho.
    A document has exactly one author and one year, so grouping by them too
    changes nothing but keeps the columns.  Null entities are dropped.
    """
    strong = F.col("rho") > F.lit(float(min_rho))
    return (mentions.where(F.col("entity").isNotNull())
            .groupBy("author_id", "document_id", "year", "entity")
            .agg(F.count(F.lit(1)).alias("n_all"),
                 F.count_if(strong).alias("n_strong"),
                 F.max("rho").alias("max_rho")))


def author_entity_frequency(doc_ent: DataFrame) -> DataFrame:
    """D4 for all authors: per (author, entity) over confident mentions.

    ``author_freq`` = distinct documents with a mention rho > min_rho,
    ``max_rho`` = highest such rho, ``years`` = year histogram with one count
    per confident mention (the reference's year list, as sorted
    ``array<struct<year,n>>`` whose size is bounded by the distinct years).
    """
    per_year = (doc_ent.where(F.col("n_strong") > 0)
                .groupBy("author_id", "entity", "year")
                .agg(F.count(F.lit(1)).alias("docs"),
                     F.sum("n_strong").alias("n"),
                     F.max("max_rho").alias("max_rho")))
    return (per_year.groupBy("author_id", "entity")
            .agg(F.sum("docs").alias("author_freq"),
                 F.max("max_rho").alias("max_rho"),
                 F.array_sort(F.collect_list(F.struct("year", "n"))).alias("years")))


def papers_count(doc_ent: DataFrame) -> DataFrame:
    """Distinct documents with at least one mention (any rho) per author."""
    return (doc_ent.groupBy("author_id")
            .agg(F.count_distinct("document_id").alias("papers")))


def paper_sketches(doc_ent: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """D7, approximate: (author_id, papers), a HyperLogLog sketch of each author's documents.

    Sketches of batches merge, so a new batch needs no old mentions
    (:func:`approx_papers_count`).  The relative error is about 1 / sqrt(2**precision);
    a sketch has at most about 2**precision bytes, and few where an author has few documents.
    """
    return doc_ent.groupBy("author_id").agg(F.hll_sketch_agg("document_id", F.lit(int(precision))).alias("papers"))


def approx_papers_count(sketches: DataFrame) -> DataFrame:
    """(author_id, papers): the estimate of each author's merged sketches."""
    return sketches.groupBy("author_id").agg(F.hll_sketch_estimate(F.hll_union_agg("papers")).alias("papers"))


def total_papers(documents: DataFrame) -> DataFrame:
    """One-row DataFrame ``total_papers`` (all accepted documents)."""
    return documents.agg(F.count(F.lit(1)).alias("total_papers"))


def entity_popularity(doc_ent: DataFrame, entities=None) -> DataFrame:
    """Documents mentioning each entity (any rho), optionally restricted.

    Equals the sum over institutions of D2, since every document has exactly
    one author and so one institution.
    """
    pop = doc_ent.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_popularity"))
    if entities is not None:
        pop = pop.join(_entity_set(doc_ent.sparkSession, entities), "entity", "left_semi")
    return pop


def entity_institution_frequency(doc_ent: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per (entity, institution of the paper), no rho filter."""
    of = documents.select("document_id", "institution")
    return (doc_ent.join(of, "document_id").groupBy("entity", "institution")
            .agg(F.count(F.lit(1)).alias("frequency")))


def institution_document_count(documents: DataFrame) -> DataFrame:
    """D3: accepted documents per institution of the paper (documents without mentions count)."""
    return documents.groupBy("institution").agg(F.count(F.lit(1)).alias("document_count"))


def institution_author_count(authors: DataFrame) -> DataFrame:
    """Authors per institution."""
    return authors.groupBy("institution").agg(F.count(F.lit(1)).alias("authors"))


def grouped_entities(mentions: DataFrame, year: int | None = None,
                     min_freq: int | None = None) -> DataFrame:
    """Per (author, entity, year) avg/min/max/count of rho, no rho filter.

    ``year`` filters a grouping key, so Catalyst pushes it below the
    aggregate (and into the scan); ``min_freq`` is a HAVING on the count.
    The reference also concatenates every rho; that unbounded list is given
    by :func:`grouped_entity_rhos` as long-form rows instead.
    """
    m = mentions.where(F.col("entity").isNotNull())
    if year is not None:
        m = m.where(F.col("year") == F.lit(int(year)))
    g = (m.groupBy("author_id", "entity", "year")
         .agg(F.avg("rho").alias("avg_rho"), F.min("rho").alias("min_rho"),
              F.max("rho").alias("max_rho"), F.count(F.lit(1)).alias("count")))
    if min_freq is not None:
        g = g.where(F.col("count") >= F.lit(int(min_freq)))
    return g


def grouped_entities_in_order(grouped: DataFrame) -> DataFrame:
    """Rows of :func:`grouped_entities` with their ``position`` within the author's year.

    By count descending, ties by entity; an author's list is ordered by (year, position).
    """
    return ranked_within(grouped, ["author_id", "year"], [F.desc("count"), F.col("entity")], "position")


def grouped_entity_rhos(mentions: DataFrame, year: int | None = None) -> DataFrame:
    """The rho list of D10 in long form: (author, entity, year, rho, n)."""
    m = mentions.where(F.col("entity").isNotNull())
    if year is not None:
        m = m.where(F.col("year") == F.lit(int(year)))
    return m.groupBy("author_id", "entity", "year", "rho").agg(F.count(F.lit(1)).alias("n"))


def author_documents(doc_ent: DataFrame, entities=None) -> DataFrame:
    """Mention count per (document, entity) with year, no rho filter.

    Optionally restricted to an entity set (semi-join).
    """
    out = doc_ent.select("author_id", "document_id", "year", "entity",
                         F.col("n_all").alias("count"))
    if entities is not None:
        out = out.join(_entity_set(doc_ent.sparkSession, entities), "entity", "left_semi")
    return out


def author_documents_nested(author_docs: DataFrame) -> DataFrame:
    """Per (author, document) the year and the sorted (entity, count) list.

    The list size is bounded by the entities of one document.
    """
    return (author_docs.groupBy("author_id", "document_id")
            .agg(F.first("year").alias("year"),
                 F.array_sort(F.collect_list(F.struct("entity", "count"))).alias("entities")))


# --------------------------------------------------------------------------
# Corpus statistics of the per-author paper counts
# --------------------------------------------------------------------------
DECILES = [i / 10.0 for i in range(10)]


def _value_histogram(papers: DataFrame) -> DataFrame:
    """(value, cnt, cum): sorted histogram of paper counts with running total.

    The histogram has one row per distinct paper count, at most
    sqrt(2 * documents) rows, so the single ordered window over it is
    bounded regardless of the number of authors.
    """
    hist = papers.groupBy(F.col("papers").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cum", F.sum("cnt").over(w))


def paper_count_quantiles(papers: DataFrame, probs: Iterable[float] = DECILES,
                          alphap: float = 0.4, betap: float = 0.4) -> DataFrame:
    """Plotting-position quantiles of the per-author paper counts.

    Rule (Hyndman-Fan with parameters alphap, betap; defaults 0.4/0.4): with
    n sorted values, ``h = n*p + alphap + p*(1 - alphap - betap)``,
    ``k = floor(clip(h, 1, n-1))``, ``g = clip(h - k, 0, 1)``,
    ``q = (1-g)*x_k + g*x_{k+1}`` (1-based).  Order statistics x_k are read
    from the value histogram, so no global sort of the authors is needed.
    Columns: i (0-based), prob, quantile.
    """
    spark = papers.sparkSession
    hist = _value_histogram(papers)
    n = papers.agg(F.count(F.lit(1)).alias("n"))
    probs_df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probs)], "i int, prob double")
    m = F.lit(1.0 - alphap - betap)
    h = F.col("n") * F.col("prob") + F.lit(alphap) + F.col("prob") * m
    k = F.floor(F.least(F.greatest(h, F.lit(1.0)), F.greatest(F.col("n") - 1, F.lit(1)).cast("double"))).cast("long")
    targets = (probs_df.withColumn("n", n.scalar())
               .withColumn("k", k)
               .withColumn("g", F.least(F.greatest(h - F.col("k"), F.lit(0.0)), F.lit(1.0)))
               .withColumn("k2", F.least(F.col("k") + 1, F.col("n"))))

    def order_stat(kcol: str, alias: str) -> DataFrame:
        hb = hist.withColumn("prev", F.col("cum") - F.col("cnt"))
        return (F.broadcast(targets.select("i", kcol)).join(
            hb, (F.col(kcol) > F.col("prev")) & (F.col(kcol) <= F.col("cum")))
            .select("i", F.col("value").cast("double").alias(alias)))

    x1 = order_stat("k", "x1")
    x2 = order_stat("k2", "x2")
    return (targets.join(x1, "i").join(x2, "i")
            .select("i", "prob",
                    ((1.0 - F.col("g")) * F.col("x1") + F.col("g") * F.col("x2")).alias("quantile")))


def paper_count_histogram(papers: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Authors per decile bin ``[int(q_i), int(q_{i+1}) - 1]``, last bin to max.

    Ties between deciles give empty bins (count 0), as in the reference.
    Columns: i, begin, end, authors.
    """
    q = quantiles if quantiles is not None else paper_count_quantiles(papers)
    mx = papers.agg(F.max("papers").alias("mx"))
    w = Window.orderBy("i")
    bins = (q.select("i", F.floor("quantile").cast("long").alias("begin"))
            .withColumn("nxt", F.lead("begin").over(w))
            .withColumn("mx", mx.scalar())
            .select("i", "begin",
                    F.coalesce(F.col("nxt") - 1, F.col("mx").cast("long")).alias("end")))
    hist = papers.groupBy(F.col("papers").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    joined = F.broadcast(bins).join(
        hist, (F.col("value") >= F.col("begin")) & (F.col("value") <= F.col("end")), "left")
    return (joined.groupBy("i", "begin", "end")
            .agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("authors")))


def corpus_stats(papers: DataFrame) -> DataFrame:
    """Number of documents (sum of D7) and number of authors."""
    return papers.agg(F.sum("papers").cast("long").alias("documents"),
                      F.count(F.lit(1)).alias("authors"))


# --------------------------------------------------------------------------
# Weighted geometric mean as an aggregate expression
# --------------------------------------------------------------------------
def weighted_geom_mean(value, weight):
    """``exp(sum(w * ln v) / sum(w))`` as an aggregate Column."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.exp(F.try_divide(F.sum(w * F.ln(v)), F.sum(w)))
