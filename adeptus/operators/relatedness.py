"""Entity relatedness from document co-occurrence, and the relatedness memo.

Link-based relatedness (Milne & Witten 2008) computed on the corpus's own
documents instead of Wikipedia links:

    rel(a, b) = max(0, 1 - (ln max(|A|,|B|) - ln |A∩B|) / (ln N - ln min(|A|,|B|)))

with |A| the documents mentioning a, |A∩B| the documents mentioning both and
N the number of documents; 1 for the same entity, 0 when never together.

Only pairs with one side in a given *source* set and relatedness above 0 are
produced (an absent pair means 0).  |A∩B| is counted in two ways:

* two *dense* entities, each in one of ``DENSE`` documents or more: an entity's
  documents are bitmaps, a row for every 64 document ids; the bits of two
  entities' maps are joined by word and counted.  A pair costs a row for 64 documents.
* other pairs: rows of one document are joined.  A bitmap of a rarer entity has
  hardly more than one bit a word, so that words would only add pairs that never meet.

In the second join the entities of a document with very many of them are dealt
to as many tasks as their measured number asks for (:mod:`adeptus.operators.skew`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.corpus import Corpus
from adeptus.operators.ingest import numbered
from adeptus.operators.skew import ROWS_PER_TASK, heavy_keys, replicated, salted
from adeptus.session import written

#: An entity in one of so many documents or more is dense: two of them meet in one of 64 documents, if independent.
DENSE = 8


def _rel_expr(a: str, b: str, both: str, n: str):
    hi = F.greatest(F.col(a), F.col(b)).cast("double")
    lo = F.least(F.col(a), F.col(b)).cast("double")
    num = F.ln(hi) - F.ln(F.col(both).cast("double"))
    den = F.ln(F.col(n).cast("double")) - F.ln(lo)
    return (F.when(den > 0, F.greatest(F.lit(0.0), F.lit(1.0) - num / den))
            .otherwise(F.when(num == 0, F.lit(1.0)).otherwise(F.lit(0.0))))


def cooccurrence_relatedness(corpus: Corpus, sources: DataFrame, dense: float = DENSE,
                             per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Oriented rows (source, other, rel > 0) for entities that co-occur in a
    document with a source entity (source != other).

    ``sources``: DataFrame with an ``entity`` column (e.g. query entities).
    """
    de, popularity = corpus.doc_entities(), corpus.popularity()
    heavy = corpus.memo(f"heavy_documents_{per_task}", lambda: heavy_keys(de, "document_id", per_task))
    often = corpus.memo(f"dense_entities_{dense}", lambda: dense_entities(popularity, corpus.total(), dense))
    return document_relatedness(de, sources, popularity, corpus.total(), often, heavy)


def dense_entities(popularity: DataFrame, total: DataFrame, dense: float = DENSE) -> DataFrame:
    """Written (entity): those in one of ``dense`` documents or more, so at most ``dense`` times a document's mean entities."""
    return written(popularity.withColumn("_total", total.scalar())
                   .where(F.col("entity_popularity") * F.lit(float(dense)) >= F.col("_total")).select("entity"), "dense")


def bitmaps(doc_entities: DataFrame) -> DataFrame:
    """(entity, word, bits): bit ``d % 64`` of word ``d // 64`` is set for every document d of the entity."""
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(document_id & 63 AS INT))")
    return (doc_entities.groupBy("entity", F.shiftright("document_id", 6).alias("word"))
            .agg(F.bit_or(bit).alias("bits")))


def _met_by_words(dense: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, other, both) of dense entities, of which one is a source, by their bitmaps."""
    words = bitmaps(dense)
    mine = (words.join(sources, "entity", "left_semi")
            .select("word", F.col("entity").alias("source"), F.col("bits").alias("source_bits")))
    return (mine.join(words.withColumnRenamed("entity", "other"), "word")
            .where(F.col("source") != F.col("other"))
            .groupBy("source", "other")
            .agg(F.sum(F.bit_count(F.col("source_bits").bitwiseAND(F.col("bits")))).alias("both"))
            .where(F.col("both") > 0))


def _met_by_documents(rows: DataFrame, sources: DataFrame, heavy: DataFrame) -> DataFrame:
    """(source, other, both) of pairs with an entity that isn't dense; ``rows`` has (document_id, entity, dense)."""
    mine = (rows.join(sources, "entity", "left_semi")
            .select("document_id", F.col("entity").alias("source"), F.col("dense").alias("source_dense")))
    others = salted(rows.withColumnRenamed("entity", "other"), "document_id", "other", heavy)
    return (replicated(mine, "document_id", heavy).join(others, ["document_id", "salt"])
            .where((F.col("source") != F.col("other")) & ~(F.col("source_dense") & F.col("dense")))
            .groupBy("source", "other").agg(F.count(F.lit(1)).alias("both")))


def document_relatedness(doc_entities: DataFrame, sources: DataFrame, popularity: DataFrame, total: DataFrame,
                         often: DataFrame | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """The same from (document_id, entity) rows, each once, ids integers; ``total`` is one row with the number of documents.

    ``often``, ``heavy``: :func:`dense_entities`, and :func:`~adeptus.operators.skew.heavy_keys` of the rows by
    document, where the caller has them.
    """
    pop = popularity
    de = doc_entities.select("document_id", "entity")
    sources = sources.select("entity").distinct()
    often = dense_entities(popularity, total) if often is None else often
    heavy = heavy_keys(de, "document_id") if heavy is None else heavy
    marked = (de.join(often.withColumn("dense", F.lit(True)), "entity", "left")
              .withColumn("dense", F.coalesce("dense", F.lit(False))))
    co = (_met_by_words(de.join(often, "entity", "left_semi"), sources)
          .unionByName(_met_by_documents(marked, sources, heavy)))
    return (co.join(pop.select(F.col("entity").alias("source"), F.col("entity_popularity").alias("pa")), "source")
            .join(pop.select(F.col("entity").alias("other"), F.col("entity_popularity").alias("pb")), "other")
            .withColumn("total_papers", total.scalar())
            .select("source", "other", _rel_expr("pa", "pb", "both", "total_papers").alias("rel"))
            .where(F.col("rel") > 0))


def link_relatedness(links: DataFrame) -> DataFrame:
    """Oriented rows (source, other, rel > 0) of entities that the same pages link to; ``links`` has (page, entity).

    Pages whose id isn't an integer are numbered first, since bitmaps need numbers.
    """
    if isinstance(links.schema["page"].dataType, T.IntegralType):
        rows = links.select(F.col("page").cast("long").alias("document_id"), "entity")
    else:
        rows = (links.select("page", "entity")
                .join(numbered(links.select("page").distinct(), [F.col("page")], "document_id"), "page")
                .select("document_id", "entity"))
    rows = written(rows.distinct(), "links")
    popularity = written(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_popularity")), "popularity")
    return document_relatedness(rows, popularity, popularity, rows.agg(F.count_distinct("document_id")))


def symmetric_pairs(oriented: DataFrame) -> DataFrame:
    """Memo key form (B14): (entity_a <= entity_b, rel), one row per pair."""
    return (oriented.select(F.least("source", "other").alias("entity_a"),
                            F.greatest("source", "other").alias("entity_b"), "rel")
            .groupBy("entity_a", "entity_b").agg(F.max("rel").alias("rel")))


def oriented_from_memo(memo: DataFrame) -> DataFrame:
    """Both orientations (source, other, rel) of a symmetric memo table."""
    return (memo.select(F.col("entity_a").alias("source"), F.col("entity_b").alias("other"), "rel")
            .unionByName(memo.select(F.col("entity_b").alias("source"),
                                     F.col("entity_a").alias("other"), "rel")))


def needed_pairs(corpus: Corpus, query_entities: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Pairs E7 looks up: every query entity x every confident entity of each
    candidate author, as symmetric keys (entity_a <= entity_b), distinct.

    The pairs are a product of two factors, a query's entities and its
    candidates' entities; they are listed only where something has to be fetched.
    ``covered`` (entity) names the sources whose related entities a memo has
    all: pairs with one of them at either end aren't needed, and queries that
    have no other source cost nothing.
    """
    qe = query_entities.select("query_id", "entity").distinct()
    asked = qe
    if covered is not None:
        asked = qe.join(covered.select("entity"), "entity", "left_anti")
        qe = qe.join(asked.select("query_id").distinct(), "query_id", "left_semi")
    ae = corpus.author_entity().select("author_id", "entity")
    cands = ae.join(qe, "entity").select("query_id", "author_id").distinct()
    cand_entities = (cands.join(ae, "author_id").select("query_id", F.col("entity").alias("other"))
                     .distinct())
    if covered is not None:
        cand_entities = cand_entities.join(covered.select(F.col("entity").alias("other")), "other", "left_anti")
    pairs = asked.join(cand_entities, "query_id").select(F.col("entity").alias("source"), "other")
    return (pairs.select(F.least("source", "other").alias("entity_a"),
                         F.greatest("source", "other").alias("entity_b"))
            .distinct())


def missing_pairs(needed: DataFrame, memo: DataFrame) -> DataFrame:
    """Needed symmetric pairs not yet in the memo (left anti join)."""
    return needed.join(memo.select("entity_a", "entity_b"), ["entity_a", "entity_b"], "left_anti")


def update_memo(memo: DataFrame, fetched: DataFrame) -> DataFrame:
    """Memo after adding newly computed pairs; existing keys are kept."""
    new = fetched.join(memo.select("entity_a", "entity_b"), ["entity_a", "entity_b"], "left_anti")
    return memo.select("entity_a", "entity_b", "rel").unionByName(new.select("entity_a", "entity_b", "rel"))
