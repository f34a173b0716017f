"""Lookups and result shapes of the query endpoints.

A lookup takes its keys as a Python list, a filter that is pushed to the
Parquet scan, or as a DataFrame, a semi-join.  Nested result shapes are
bounded by one document, one query's top-k or one page; the author card is kept in
long form (one row per author and entity) because an author's entity list
is not bounded.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adeptus.corpus import Corpus
from adeptus.operators.ingest import numbered, ranked_within
from adeptus.session import written

COMPLETION_LIMIT = 50
#: Entities of an author, or hits of a query and scoring, in one page of a nested answer.
PAGE_ROWS = 1000
#: Hits of the nested answers that are ranked and put into pages at a time.
HITS_TOGETHER = 25_000_000
#: Names of the scorings in the /query shape.
ANSWER_SCORINGS = ("efiaf", "eciaf", "log_ec_ef_iaf", "cossim_efiaf", "relatedness_geom")


def completion_pattern(terms: str) -> str:
    """``%``-wrapped LIKE pattern; runs of whitespace / ``%`` become ``%``.

    ``_`` and ``%`` in the terms stay wildcards; backslash is escaped so it
    stays literal.
    """
    t = terms.replace("\\", "\\\\")
    return "%" + re.sub(r"[%\s]+", "%", t) + "%"


def trigram_index(authors: DataFrame) -> DataFrame:
    """Written postings (trigram, author_id): every three characters in a row of each lower-cased name.

    Sorted by trigram, so that a lookup reads the row groups of its trigrams only.
    """
    low = F.lower("name")
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3))
    rows = authors.where(F.length(low) >= 3).select(F.explode(F.array_distinct(grams)).alias("trigram"), "author_id")
    return written(rows.repartitionByRange("trigram", "author_id").sortWithinPartitions("trigram", "author_id"), "trigrams")


def pattern_trigrams(spark: SparkSession, pattern: str) -> list[str]:
    """Trigrams that a name must have to match the pattern: those of its parts between wildcards."""
    low = spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first()["p"]      # as ILIKE lowers it
    parts = re.split("[%_]", low.replace("\\\\", "\\"))
    return sorted({p[i:i + 3] for p in parts for i in range(len(p) - 2)})


def author_completion(authors: DataFrame, terms: str, limit: int = COMPLETION_LIMIT,
                      postings: DataFrame | None = None) -> DataFrame:
    """Authors whose name matches the terms case-insensitively, at most ``limit``.

    The reference returns the first ``limit`` rows in storage order; ours are
    the ``limit`` smallest author ids (deterministic).  With ``postings``
    (:func:`trigram_index` of the same authors) only authors that have all the
    terms' trigrams are checked; terms without three characters in a row scan.
    """
    pat = completion_pattern(terms)
    grams = pattern_trigrams(authors.sparkSession, pat) if postings is not None else []
    if grams:
        having = (postings.where(F.col("trigram").isin(grams)).groupBy("author_id")
                  .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)))
        authors = authors.join(having, "author_id", "left_semi")
    return (authors.where(F.col("name").ilike(pat))
            .orderBy("author_id").limit(limit)
            .select("author_id", "name", "institution"))


def _requested(df: DataFrame, column: str, keys) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among the keys (a list, or a DataFrame with that column)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def author_ids_by_name(authors: DataFrame, names) -> DataFrame:
    """(name, author_id) for the requested names."""
    return _requested(authors, "name", names).select("name", "author_id")


def documents_by_id(documents: DataFrame, ids) -> DataFrame:
    """(author_id, document_id, year, body) of the requested documents."""
    return _requested(documents, "document_id", ids).select("author_id", "document_id", "year", "body")


def authors_by_id(authors: DataFrame, ids) -> DataFrame:
    """Name and institution of the requested authors."""
    return _requested(authors, "author_id", ids).select("author_id", "name", "institution")


def institution_papers_count(counts: DataFrame, institutions) -> DataFrame:
    """(institution, document_count) of the requested institutions; ``counts`` is D3."""
    return _requested(counts, "institution", institutions).select("institution", "document_count")


def author_mentions(mentions: DataFrame, ids) -> DataFrame:
    """Every mention of the requested authors, no rho filter."""
    return _requested(mentions, "author_id", ids).select("author_id", "document_id", "year", "entity", "rho")


def author_papers_count(papers: DataFrame, ids) -> DataFrame:
    """(author_id, papers) of the requested authors; ``papers`` is D7."""
    return _requested(papers, "author_id", ids).select("author_id", "papers")


def entity_lists(requests: DataFrame, json_col: str = "entities") -> DataFrame:
    """The JSON entity list argument: one row per entity of each request, null for what is no list of strings."""
    return requests.withColumn("entity", F.explode_outer(F.from_json(json_col, "array<string>"))).drop(json_col)


def document_json(documents: DataFrame) -> DataFrame:
    """A20 /document shape: author_id, ret_doc_id, year, body."""
    return documents.select("document_id", F.to_json(F.struct(
        "author_id", F.col("document_id").alias("ret_doc_id"), "year", "body")).alias("json"))


def author_card(corpus: Corpus) -> DataFrame:
    """The author card in long form.

    Per (author, entity): name, papers_count (D6), frequency (D4 author_freq),
    rank of the entity by frequency desc (ties by entity), and the year
    histogram of confident mentions as text ``year:count,...`` sorted by year.
    The rank is the distance from the author's first row in the order of all
    rows, so that an author with very many entities isn't one task.
    """
    years = F.array_join(F.transform("years", lambda y: F.concat(y["year"].cast("string"), F.lit(":"),
                                                                 y["n"].cast("string"))), ",")
    rows = corpus.author_entity().select("author_id", "entity", F.col("author_freq").alias("frequency"), years.alias("years"))
    rows = numbered(rows, [F.col("author_id"), F.desc("frequency"), F.col("entity")], "_place")
    first = rows.groupBy("author_id").agg(F.min("_place").alias("_first"))
    return (rows.join(first, "author_id")
            .join(corpus.papers().withColumnRenamed("papers", "papers_count"), "author_id")
            .join(corpus.authors.select("author_id", "name"), "author_id", "left")
            .select("author_id", "name", "papers_count", (F.col("_place") - F.col("_first") + 1).cast("int").alias("rank"),
                    "entity", "frequency", "years"))


def author_rows_json(corpus: Corpus) -> DataFrame:
    """A20 /author shape: (author_id, rank, json), rank 0 for id, name and papers_count, then a row per entity.

    An entity's ``years`` are [year, count] pairs by year.  One row per entity,
    so that an author with very many isn't one value.
    """
    card = author_card(corpus)
    pairs = F.transform(F.split("years", ","), lambda y: F.split(y, ":").cast("array<int>"))
    entities = card.select("author_id", "rank", F.to_json(F.struct("entity", "frequency", pairs.alias("years"))).alias("json"))
    head = (corpus.papers().join(corpus.authors.select("author_id", "name"), "author_id", "left")
            .select("author_id", F.lit(0).alias("rank"),
                    F.to_json(F.struct(F.col("author_id").alias("id"), "name", F.col("papers").alias("papers_count")))
                    .alias("json")))
    return head.unionByName(entities)


def _page(rank, page_rows: int):
    """Page number, from 0, of a rank."""
    return F.floor((F.col(rank) - 1) / F.lit(page_rows)).cast("int")


def author_answers_json(corpus: Corpus, page_rows: int = PAGE_ROWS) -> DataFrame:
    """A20 /author shape, nested: (author_id, page, json) with id, name, papers_count and the page's entities.

    Entities come by frequency, highest first.  An author with at most
    ``page_rows`` of them is one value; the others go on over further pages, so
    no value and no group grows with the author.  Without entities: one empty page.
    """
    card = author_card(corpus)
    pairs = F.transform(F.split("years", ","), lambda y: F.split(y, ":").cast("array<int>"))
    pages = card.groupBy("author_id", _page("rank", page_rows).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "entity", "frequency", pairs.alias("years")))).alias("entities"))
    none = F.array().cast("array<struct<entity:string,frequency:bigint,years:array<array<int>>>>")
    listed = F.transform("entities", lambda e: F.struct(e["entity"].alias("entity"), e["frequency"].alias("frequency"),
                                                        e["years"].alias("years")))
    return (corpus.papers().join(corpus.authors.select("author_id", "name"), "author_id", "left")
            .join(pages, "author_id", "left")
            .select("author_id", F.coalesce("page", F.lit(0)).alias("page"),
                    F.to_json(F.struct(F.col("author_id").alias("id"), "name", F.col("papers").alias("papers_count"),
                                       F.coalesce(listed, none).alias("entities"))).alias("json")))


def _named(scores: DataFrame, authors: DataFrame) -> DataFrame:
    """The hits with their authors' names, which they may have already."""
    return scores if "name" in scores.columns else scores.join(authors.select("author_id", "name"), "author_id", "left")


def query_answers_json(scores: DataFrame, authors: DataFrame, query_entities: DataFrame, page_rows: int = PAGE_ROWS,
                       score_format: str = "%.6f", hits_together: int | None = None) -> DataFrame:
    """A20 /query shape, nested: (query_id, page, json) with ``experts_<scoring>`` of all scorings and ``query_entities``.

    ``scores``: as of ``all_scorings``, read several times.  A page holds ``page_rows`` ranks of each
    scoring; a query's further hits are its next pages.  A query without hits has
    one page of empty lists.  All queries are scored at once, so there is no time of one query.

    Hits are shuffled twice, by rank and by page.  With more than ``hits_together`` (default: ``HITS_TOGETHER``)
    of them, the queries are dealt to as many groups as that takes, and each group's pages are written
    before the next group's hits are ranked: the shuffles on disk are those of one group.
    """
    named = _named(scores, authors)
    asked = query_entities.groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("query_entities"))
    groups = -(-named.count() // (hits_together or HITS_TOGETHER))
    if groups <= 1:
        return _answer_pages(named, asked, page_rows, score_format)
    own = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    return reduce(DataFrame.unionAll, [
        written(_answer_pages(named.where(own == k), asked.where(own == k), page_rows, score_format), "answers", "zstd")
        for k in range(groups)])


def _answer_pages(named: DataFrame, asked: DataFrame, page_rows: int, score_format: str) -> DataFrame:
    """(query_id, page, json) of the asked queries, from their hits with names."""
    ranked = ranked_within(named, ["query_id", "scoring"], [F.desc("score"), F.col("author_id")], "rank", large_groups=True)
    hit = F.struct("rank", "author_id", "name", F.format_string(score_format, "score").alias("score"))
    pages = ranked.groupBy("query_id", _page("rank", page_rows).alias("page")).agg(
        *(F.array_sort(F.collect_list(F.when(F.col("scoring") == s, hit))).alias(s) for s in ANSWER_SCORINGS))
    none = F.array().cast("array<struct<author_id:string,name:string,score:string>>")
    lists = (F.coalesce(F.transform(s, lambda h: F.struct(h["author_id"].alias("author_id"), h["name"].alias("name"),
                                                          h["score"].alias("score"))), none).alias(f"experts_{s}")
             for s in ANSWER_SCORINGS)
    return asked.join(pages, "query_id", "left").select(
        "query_id", F.coalesce("page", F.lit(0)).alias("page"), F.to_json(F.struct(*lists, "query_entities")).alias("json"))


def completion_json(authors: DataFrame, terms: str, limit: int = COMPLETION_LIMIT,
                    postings: DataFrame | None = None) -> DataFrame:
    """A20 /completion shape: one row ``{"authors":[{id, name, institution}, ...]}`` of at most ``limit`` authors."""
    found = author_completion(authors, terms, limit, postings)
    one = F.struct(F.col("author_id").alias("id"), "name", "institution")
    return found.agg(F.array_sort(F.collect_list(one)).alias("authors")).select(F.to_json(F.struct("authors")).alias("json"))


def query_rows_json(scores: DataFrame, authors: DataFrame, score_format: str = "%.6f") -> DataFrame:
    """A20 /query shape: (query_id, scoring, rank, json) of every hit of every scoring.

    ``scores``: (query_id, author_id, scoring, score), as of ``all_scorings``.
    """
    named = _named(scores, authors)
    hit = F.struct("author_id", "name", F.format_string(score_format, "score").alias("score"))
    return (ranked_within(named, ["query_id", "scoring"], [F.desc("score"), F.col("author_id")], "rank", large_groups=True)
            .select("query_id", "scoring", "rank", F.to_json(hit).alias("json")))


def expert_rows_json(ranked: DataFrame, score_format: str = "%.6f") -> DataFrame:
    """A20 /query shape for one scoring: (query_id, rank, json) of every hit.

    One row per hit, so that a query with many candidates is never one value;
    the score is text in a fixed format.
    """
    hit = F.struct("rank", "author_id", "name", F.format_string(score_format, "score").alias("score"))
    return (ranked_within(ranked, ["query_id"], [F.desc("score"), F.col("author_id")], "rank", large_groups=True)
            .select("query_id", "rank", F.to_json(hit).alias("json")))


def experts_json(ranked: DataFrame, k: int) -> DataFrame:
    """One page of the /query shape: per query the first k experts as a JSON array.

    ``ranked``: (query_id, author_id, name, score) -- at most k per query are
    kept (window group limit) before they are nested.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "author_id")
    top = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (top.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "author_id", "name", "score"))).alias("experts"))
            .select("query_id", F.to_json(F.col("experts")).alias("json")))
