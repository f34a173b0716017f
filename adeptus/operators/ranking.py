"""Ranking: expert search over many queries, top-k, profiles, TREC run lines.

Top-k per group uses ``row_number() <= k`` over a window partitioned by the
group; Spark plans this with a partial window group limit before the
shuffle, so a query with a huge candidate set ships at most k rows per map
task instead of all its candidates.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adeptus.corpus import Corpus
from adeptus.operators.ingest import numbered
from adeptus.operators.lookups import author_ids_by_name
from adeptus.operators.scoring import author_profiles, get_scoring, scorings
from adeptus.session import written


def attach_names(scores: DataFrame, authors: DataFrame) -> DataFrame:
    """C4: one join with the authors table after scoring (not a lookup per author)."""
    return scores.join(authors.select("author_id", "name"), "author_id", "left")


def top_k(df: DataFrame, k: int, partition: str = "query_id", order=None,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first k rows of each partition in the given order (default:
    score desc, author_id asc), with their rank."""
    order = order if order is not None else (F.desc("score"), F.asc("author_id"))
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= F.lit(int(k)))


def find_experts(corpus: Corpus, query_entities: DataFrame, scoring: str = "eciaf_score",
                 k: int | None = None, sort: bool = True, **kw) -> DataFrame:
    """Score every candidate of every query, attach names, rank.

    Returns (query_id, author_id, name, score[, rank]) ordered by query,
    score descending, author_id ascending (our deterministic tie-break).
    """
    scores = get_scoring(scoring)(corpus, query_entities, **kw)
    out = attach_names(scores, corpus.authors).select("query_id", "author_id", "name", "score")
    if k is not None:
        out = top_k(out, k)
    if sort:
        out = out.orderBy("query_id", F.desc("score"), "author_id")
    return out


def find_experts_batch(corpus: Corpus, query_entities: DataFrame, names) -> DataFrame:
    """Every hit of every query for each of the named scorings, with the scoring's name.

    One plan for all scorings that share an aggregation, and one join with the authors.
    """
    found = scorings(corpus, query_entities, names)
    return attach_names(found, corpus.authors).select("query_id", "author_id", "name", "score", "scoring")


def ranked_run(run: DataFrame, max_rank: int = 1000) -> DataFrame:
    """Evaluator order (score desc, author_id desc), at most ``max_rank`` per query."""
    return top_k(run, max_rank, order=(F.desc("score"), F.desc("author_id")))


def author_profile_top(corpus: Corpus, k: int = 50) -> DataFrame:
    """Each author's top-k entities by ef*iaf (ties by entity name).

    Columns: author_id, rank, entity, freq_pct (100*ef), importance (100*ef*iaf),
    rarity (iaf), max_rho, years_text such as ``1996(x3), 1997``.
    """
    prof = author_profiles(corpus)
    top = top_k(prof, k, partition="author_id", order=(F.desc("ef_iaf"), F.asc("entity")))
    years_text = F.array_join(F.transform(
        "years", lambda y: F.concat(y["year"].cast("string"),
                                    F.when(y["n"] > 1, F.concat(F.lit("(x"), y["n"].cast("string"), F.lit(")")))
                                    .otherwise(F.lit("")))), ", ")
    return top.select("author_id", "rank", "entity",
                      (F.col("ef") * 100.0).alias("freq_pct"),
                      (F.col("ef_iaf") * 100.0).alias("importance"),
                      F.col("iaf").alias("rarity"), "max_rho",
                      years_text.alias("years_text"))


def profile_report(corpus: Corpus, names, k: int = 50) -> DataFrame:
    """E13 for authors given by name: name and institution beside each row of :func:`author_profile_top`."""
    who = (author_ids_by_name(corpus.authors, names).select("author_id").distinct()
           .join(corpus.authors, "author_id").select("author_id", "name", "institution"))
    return who.join(author_profile_top(corpus, k), "author_id")


def judged_topics(qrels: DataFrame, topics: DataFrame) -> DataFrame:
    """Judged topics with their text and their ``position`` (from 0) by id and text."""
    known = topics.join(qrels.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "text")
    return numbered(known, [F.col("query_id"), F.col("text")], "position")


def unknown_topics(qrels: DataFrame, topics: DataFrame) -> DataFrame:
    """Ids of judged topics that have no text (the reference stops there; check that this has no rows)."""
    return qrels.select("query_id").distinct().join(topics.select("query_id"), "query_id", "left_anti")


def trec_run_lines(run: DataFrame, run_name_col: str = "scoring", score_format: str = "%.6f") -> DataFrame:
    """``qid 0 author 0 score runname`` lines (one column ``value``).

    The score is printed with a fixed format (default 6 decimals).
    """
    return run.select(F.concat_ws(" ", "query_id", F.lit("0"), "author_id", F.lit("0"),
                                  F.format_string(score_format, F.col("score")),
                                  F.col(run_name_col)).alias("value"))


def timed_run(corpus: Corpus, query_entities: DataFrame, scoring: str = "eciaf_score", **kw) -> tuple[DataFrame, DataFrame]:
    """(every hit of every query, written to the shared folder; ``qid seconds`` lines, column ``value``).

    All queries are scored by one job, so the seconds are those of that job
    divided by the number of queries.
    """
    start = time.monotonic()
    run = written(find_experts(corpus, query_entities, scoring, sort=False, **kw), "run")
    took = time.monotonic() - start
    queries = query_entities.select("query_id").distinct()
    each = queries.agg((F.lit(took) / F.count("*")).alias("seconds"))
    return run, queries.crossJoin(F.broadcast(each)).select(        # one row
        F.concat_ws(" ", "query_id", F.format_string("%.6f", "seconds")).alias("value"))


def query_entity_lines(query_entities: DataFrame) -> DataFrame:
    """Per query ``qid e1; e2; ...`` (entities sorted; bounded by the query size)."""
    return (query_entities.groupBy("query_id")
            .agg(F.array_join(F.array_sort(F.collect_set("entity")), "; ").alias("entities"))
            .select("query_id", "entities",
                    F.concat_ws(" ", "query_id", "entities").alias("value")))
