"""Building a corpus from paper records (the reference's database build).

papers(author_id, name, institution, year, abstract, doi[, ordinal][, input_file])
  -> year filter (B1) -> authors, first row per id wins (C9)
  -> accepted papers (B2) -> consecutive document ids in input order (F2)
  -> annotation (M1 or any annotator) -> mentions, documents (body = B13)

``ordinal`` is the input order, of any type that can be sorted (the readers give
file, split and row); when absent the order is undefined but ids are still
consecutive and unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adeptus.corpus import Corpus
from adeptus.functions.text import annotated_text, legit_document
from adeptus.session import written

# Reference ingest window (inclusive years).
MIN_YEAR, MAX_YEAR = 2006, 2017


def year_filter(papers: DataFrame, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """B1: keep papers with min_year <= year <= max_year (each bound optional)."""
    cond = F.lit(True)
    if min_year is not None:
        cond = cond & (F.col("year") >= F.lit(int(min_year)))
    if max_year is not None:
        cond = cond & (F.col("year") <= F.lit(int(max_year)))
    return papers.where(cond)


def accepted(papers: DataFrame) -> DataFrame:
    """B2: papers whose abstract is accepted as a document."""
    return papers.where(legit_document("abstract"))


def ingest_summary(papers: DataFrame, min_year: int | None = None, max_year: int | None = None,
                   by: str | None = "input_file") -> DataFrame:
    """Total; in year range; in range with accepted abstract; in range
    without accepted abstract but with a non-empty DOI -- one pass, per file."""
    in_range = F.lit(True)
    if min_year is not None:
        in_range = in_range & (F.col("year") >= F.lit(int(min_year)))
    if max_year is not None:
        in_range = in_range & (F.col("year") <= F.lit(int(max_year)))
    legit = legit_document("abstract")
    has_doi = F.col("doi").isNotNull() & (F.length("doi") > 0)
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(in_range).alias("in_range"),
            F.count_if(in_range & legit).alias("with_abstract"),
            F.count_if(in_range & ~F.coalesce(legit, F.lit(False)) & has_doi).alias("doi_without_abstract")]
    return papers.groupBy(by).agg(*aggs) if by else papers.agg(*aggs)


def numbered(df: DataFrame, order: list, out: str, start: int = 0, ranges: int | None = None) -> DataFrame:
    """Consecutive numbers ``start``, ``start + 1``, ... in the given order, without one task for all rows.

    The rows are sorted into ``ranges`` partitions of about equal size (default:
    ``spark.sql.shuffle.partitions``) and written; the only window over the
    whole input is over the ``ranges`` partition sizes.  A key that holds many
    rows is spread over several ranges if the order goes on within it.
    """
    n = int(ranges or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(_in_places(df, n, order), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
             .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (parts.join(F.broadcast(sizes), "_range")         # a row for each range
            .withColumn(out, (F.lit(int(start)) + F.col("_before") + F.col("_spot")).cast("long"))
            .drop("_range", "_spot", "_before"))


def _in_places(df: DataFrame, ranges: int, order: list) -> DataFrame:
    """The rows in ``ranges`` sorted ranges, with the ``_range`` and the row's ``_spot`` in it, from 0.

    The identifier of a row is its partition and, in the lower 33 bits, its place there,
    so the places need no window and no further shuffle.
    """
    at = F.col("_at")
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("_range", F.shiftright(at, 33).cast("int")).withColumn("_spot", at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def ranked_within(df: DataFrame, keys: list[str], order: list, out: str, ranges: int | None = None,
                  large_groups: bool = False) -> DataFrame:
    """``row_number()`` from 1 within each group of ``keys`` in the given order, for groups of any size.

    As in :func:`numbered` the rows, sorted by keys and order, are cut into equal
    ranges, so a group with a third of all rows is several tasks.  A row's place is
    its place in its range plus the group's rows in the ranges before; a range
    continues at most one group, so there are no more of these sums than ranges.
    Nulls are a group.  With ``large_groups`` the rows aren't shuffled again for the
    place in their range: each group's first place in a range is a written table with a
    row per group and range, which Catalyst joins by its size.  Right for groups of any
    size, cheaper if they are few and large.
    """
    n = int(ranges or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys]
    if large_groups:
        parts = written(_in_places(df, n, [*by, *order]), "ranges", "zstd")
        groups = parts.groupBy("_range", *keys).agg(F.min("_spot").alias("_first"), F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = written(groups.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
                                       (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift")), "starts")
        own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
        return parts.join(starts, own).withColumn(out, (F.col("_spot") + F.col("_shift")).cast("int")).select(*df.columns, out)
    parts = written(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (parts.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.sum("_n").over(before)).where("_before > 0")
               .select("_before", F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col("_range") == F.col("_r"))
    within = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return (parts.withColumn("_row", within)
            .join(F.broadcast(carried), same, "left")       # at most a row for each range
            .withColumn(out, (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("int"))
            .select(*df.columns, out))


def assign_document_ids(papers: DataFrame, ordinal: str = "ordinal", start: int = 0,
                        ranges: int | None = None) -> DataFrame:
    """consecutive ``document_id`` = start, start+1, ... in ``ordinal`` order."""
    return numbered(papers, [F.col(ordinal)], "document_id", start, ranges)


def next_document_id(documents: DataFrame) -> DataFrame:
    """One row ``next_id`` = max(document_id) + 1 over stored documents, or 0."""
    return documents.agg((F.coalesce(F.max("document_id"), F.lit(-1)) + 1).cast("long").alias("next_id"))


def authors_first_wins(papers: DataFrame, existing: DataFrame | None = None,
                       ordinal: str = "ordinal") -> DataFrame:
    """One author row per id, the first in input order; existing ids are kept."""
    first = (papers.groupBy("author_id")
             .agg(F.min_by(F.struct("name", "institution"), F.col(ordinal)).alias("a"))
             .select("author_id", F.col("a.name").alias("name"), F.col("a.institution").alias("institution")))
    if existing is None:
        return first
    new = first.join(existing.select("author_id"), "author_id", "left_anti")
    return existing.select("author_id", "name", "institution").unionByName(new)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not yet in the sink (left anti join)."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def last_wins(assoc: DataFrame, key: str = "document_id", value: str = "author_id",
              order: str = "line_no") -> DataFrame:
    """One value per key, the one on the last line (max line number).

    Equal line numbers (not possible within one file) are broken by the
    larger value, so the result is deterministic.
    """
    return assoc.groupBy(key).agg(F.max_by(F.col(value), F.struct(F.col(order), F.col(value))).alias(value))


def merge_documents_authors(assoc: DataFrame, texts: DataFrame, key: str = "document_id") -> DataFrame:
    """Association joined with document texts; missing or empty texts dropped."""
    return assoc.join(texts, key).where(F.col("text").isNotNull() & (F.length("text") > 0))


def papers_from_documents(docs: DataFrame, *carry: str) -> DataFrame:
    """A2 mapping: (doc_id, author_id, text) -> paper rows with fixed name, institution, year.

    ``carry``: further columns to keep; without an ``ordinal`` among them, doc_id is the input order.
    """
    author = F.col("author_id").cast("string")
    order = [] if "ordinal" in carry else [F.col("doc_id").alias("ordinal")]
    return docs.select(
        author.alias("author_id"), F.concat(F.lit("Name of "), author).alias("name"),
        F.lit("TU").alias("institution"), F.lit(2017).alias("year"),
        F.col("text").alias("abstract"), F.lit(None).cast("string").alias("doi"), *order, *carry)


def build_corpus(papers: DataFrame, annotator, min_year: int | None = MIN_YEAR,
                 max_year: int | None = MAX_YEAR, start_id: int = 0,
                 existing_authors: DataFrame | None = None) -> Corpus:
    """Papers -> Corpus.  ``annotator(df(id, text)) -> (id, begin, end, entity, rho)``.

    Numbered documents and their annotations are written as one table, from
    which documents and mentions are read: the annotator sees each document once.
    """
    p = year_filter(papers, min_year, max_year)
    if "ordinal" not in p.columns:
        p = p.withColumn("ordinal", F.monotonically_increasing_id())
    authors = authors_first_wins(p, existing_authors)
    docs = assign_document_ids(accepted(p), start=start_id).select(
        "document_id", "author_id", "year", "abstract", "institution")
    ann = annotator(docs.select(F.col("document_id").cast("string").alias("id"), F.col("abstract").alias("text")))
    arrays = (ann.groupBy(F.col("id").cast("long").alias("document_id"))
              .agg(F.collect_list(F.struct("begin", "end", "entity", "rho")).alias("anns")))
    annotated = written(docs.join(arrays, "document_id", "left"), "annotated")
    mentions = (annotated.select("author_id", "document_id", "year", F.inline("anns"))
                .select("entity", "author_id", "document_id", "year", "rho"))
    documents = annotated.select("document_id", "author_id", "year", annotated_text("abstract", "anns").alias("body"),
                                 "institution")
    return Corpus(authors, documents, mentions)
