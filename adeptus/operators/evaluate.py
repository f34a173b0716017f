"""Retrieval evaluation of a run against relevance judgements (TREC-style).

Inputs: ``run(query_id, author_id, score)`` and ``qrels(query_id, author_id,
rel)``; a judgement with rel >= ``relevance_level`` (default 1) is relevant.
The run is first ranked with the evaluator's order (score desc, author_id
desc) and cut at ``max_rank`` (1000) per query; every measure is then a
window or an aggregation partitioned by query -- each partition holds at
most ``max_rank`` ranked rows, whatever the size of the candidate set.

Per-query measures (public definitions):

* num_ret, num_rel, num_rel_ret
* map (average precision), gm_map (per query ln(max(AP, 1e-5)); the
  summary is exp of the mean)
* Rprec, recip_rank, bpref
* P_k, recall_k for k in CUTOFFS; success_k for k in 1, 5, 10
* iprec_at_recall_x for x in 0.0 .. 1.0
* ndcg, ndcg_cut_k (gain = judged rel value, discount log2(rank + 1))
* set_P, set_recall, set_F

Summary row ``query_id = 'all'``: mean over every judged query with at least
one relevant author; queries without a run count 0 (complete-set averaging).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adeptus.operators.ranking import ranked_run

CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
SUCCESS = (1, 5, 10)
RECALL_POINTS = tuple(i / 10.0 for i in range(11))
GM_FLOOR = 1e-5


def judged_run(run: DataFrame, qrels: DataFrame, max_rank: int = 1000,
               relevance_level: int = 1) -> DataFrame:
    """Ranked run left-joined with judgements.

    Columns: query_id, author_id, rank, rel (null = unjudged), is_rel (0/1),
    is_nonrel (judged, not relevant), cum_rel (relevant at or above rank).
    """
    r = ranked_run(run.select("query_id", "author_id", "score"), max_rank)
    j = r.join(qrels.select("query_id", "author_id", "rel"), ["query_id", "author_id"], "left")
    is_rel = F.when(F.col("rel") >= F.lit(relevance_level), 1).otherwise(0)
    is_non = F.when(F.col("rel").isNotNull() & (F.col("rel") < F.lit(relevance_level)), 1).otherwise(0)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (j.withColumn("is_rel", is_rel).withColumn("is_nonrel", is_non)
            .withColumn("cum_rel", F.sum("is_rel").over(w))
            .withColumn("cum_nonrel", F.sum("is_nonrel").over(w)))


def qrel_stats(qrels: DataFrame, relevance_level: int = 1) -> DataFrame:
    """Per judged query: num_rel (relevant), num_nonrel (judged non-relevant)."""
    return (qrels.groupBy("query_id")
            .agg(F.count_if(F.col("rel") >= relevance_level).alias("num_rel"),
                 F.count_if(F.col("rel") < relevance_level).alias("num_nonrel")))


IDCG_CHUNK = 100_000  # ideal ranks generated per row (spreads a topic with many judgements)


def ideal_dcg(qrels: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """Per query: idcg (all relevant) and idcg_k of the ideal ranking (rel desc).

    No sort of a topic's judgements: the ideal ranking puts each relevance
    level in one contiguous block of ranks, so only the count per (query,
    level) is aggregated (map-side), the few levels get their first rank by
    a window, and each block's ranks are generated in chunks of IDCG_CHUNK
    that are spread over the tasks before being summed.
    """
    levels = (qrels.where(F.col("rel") > 0).groupBy("query_id", "rel")
              .agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = levels.withColumn("start", F.coalesce(F.sum("c").over(w), F.lit(0)) + 1)  # first rank
    chunks = (blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / IDCG_CHUNK))))
              .select("query_id", "rel",
                      (F.col("start") + F.col("k") * IDCG_CHUNK).alias("lo"),
                      F.least(F.col("start") + F.col("c") - 1,
                              F.col("start") + (F.col("k") + 1) * IDCG_CHUNK - 1).alias("hi")))
    ranks = (chunks.repartition(F.col("query_id"), F.col("rel"), F.col("lo"))
             .select("query_id", "rel", F.explode(F.sequence("lo", "hi")).alias("irank")))
    gain = F.col("rel") / F.log2(F.col("irank") + 1)
    aggs = [F.sum(gain).alias("idcg")] + [
        F.sum(F.when(F.col("irank") <= k, gain).otherwise(0.0)).alias(f"idcg_{k}") for k in cutoffs]
    return ranks.groupBy("query_id").agg(*aggs)


def per_query_measures(run: DataFrame, qrels: DataFrame, max_rank: int = 1000,
                       relevance_level: int = 1) -> DataFrame:
    """One wide row of measures per query that has a run (see module doc)."""
    jr = judged_run(run, qrels, max_rank, relevance_level)
    qs = qrel_stats(qrels, relevance_level)
    x = jr.join(qs, "query_id", "left").fillna(0, ["num_rel", "num_nonrel"])
    rank = F.col("rank")
    prec_here = F.col("cum_rel") / rank
    # bpref term for each relevant retrieved author (judged non-relevant above it, capped at R)
    bden = F.least(F.col("num_rel"), F.col("num_nonrel"))
    nonrel_above = F.least(F.col("cum_nonrel"), F.col("num_rel"))
    bterm = F.when(bden > 0, F.lit(1.0) - nonrel_above / bden).otherwise(F.lit(1.0))
    gain = F.coalesce(F.col("rel"), F.lit(0)).cast("double")
    gain = F.when(gain > 0, gain).otherwise(0.0) / F.log2(rank + 1)
    aggs = [
        F.count(F.lit(1)).alias("num_ret"),
        F.max("num_rel").alias("num_rel"),
        F.max("num_nonrel").alias("num_nonrel"),
        F.sum("is_rel").alias("num_rel_ret"),
        F.sum(F.when(F.col("is_rel") == 1, prec_here).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when((rank <= F.col("num_rel")), F.col("is_rel")).otherwise(0)).alias("rprec_hits"),
        F.min(F.when(F.col("is_rel") == 1, rank)).alias("first_rel"),
        F.sum(F.when(F.col("is_rel") == 1, bterm).otherwise(0.0)).alias("bpref_sum"),
        F.sum(gain).alias("dcg"),
    ]
    for k in sorted(set(CUTOFFS) | set(SUCCESS)):
        aggs.append(F.sum(F.when(rank <= k, F.col("is_rel")).otherwise(0)).alias(f"hits_{k}"))
    for k in CUTOFFS:
        aggs.append(F.sum(F.when(rank <= k, gain).otherwise(0.0)).alias(f"dcg_{k}"))
    recall_here = F.when(F.col("num_rel") > 0, F.col("cum_rel") / F.col("num_rel")).otherwise(0.0)
    for i, p in enumerate(RECALL_POINTS):
        aggs.append(F.max(F.when((F.col("is_rel") == 1) & (recall_here >= F.lit(p) - 1e-12), prec_here))
                    .alias(f"iprec_{i}"))
    g = x.groupBy("query_id").agg(*aggs)
    idcg = ideal_dcg(qrels)
    g = g.join(idcg, "query_id", "left")
    R = F.col("num_rel")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    ap = ratio(F.col("ap_sum"), R)
    cols = [
        "query_id", "num_ret", "num_rel", "num_rel_ret",
        ap.alias("map"),
        F.ln(F.greatest(ap, F.lit(GM_FLOOR))).alias("gm_map"),
        ratio(F.col("rprec_hits"), R).alias("Rprec"),
        ratio(F.lit(1.0), F.col("first_rel")).alias("recip_rank"),
        ratio(F.col("bpref_sum"), R).alias("bpref"),
        ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        ratio(F.col("num_rel_ret"), F.col("num_ret")).alias("set_P"),
        ratio(F.col("num_rel_ret"), R).alias("set_recall"),
    ]
    for k in CUTOFFS:
        cols.append((F.col(f"hits_{k}") / F.lit(float(k))).alias(f"P_{k}"))
        cols.append(ratio(F.col(f"hits_{k}"), R).alias(f"recall_{k}"))
        cols.append(ratio(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")).alias(f"ndcg_cut_{k}"))
    for k in SUCCESS:
        cols.append(F.when(F.col(f"hits_{k}") > 0, 1.0).otherwise(0.0).alias(f"success_{k}"))
    # interpolated precision: max precision at any rank whose recall >= point
    for i, p in enumerate(RECALL_POINTS):
        cols.append(F.coalesce(F.col(f"iprec_{i}"), F.lit(0.0)).alias(iprec_column(p)))
    out = g.select(*cols)
    sp, sr = F.col("set_P"), F.col("set_recall")
    return out.withColumn("set_F", ratio(2 * sp * sr, sp + sr))


def iprec_column(p: float) -> str:
    """Column name of interpolated precision at recall p (``iprec_at_recall_0_10``)."""
    return f"iprec_at_recall_{p:.2f}".replace(".", "_")


def measure_names(measures: DataFrame) -> list[str]:
    return [c for c in measures.columns if c != "query_id"]


def trec_eval(run: DataFrame, qrels: DataFrame, max_rank: int = 1000,
              relevance_level: int = 1, decimals: int | None = None) -> DataFrame:
    """Long form (measure, query_id, value), per query plus ``all``.

    ``all`` averages over every judged query (those without a run or without a
    relevant author count 0); num_* measures are summed; gm_map is exp(mean(ln AP)).
    With ``decimals``, per-query values are rounded half up to that many
    decimals (as printed) and ``all`` averages the printed values exactly
    (integer sums), so the summary does not depend on summation order.
    """
    per = per_query_measures(run, qrels, max_rank, relevance_level)
    names = measure_names(per)
    judged = qrel_stats(qrels, relevance_level).select("query_id", F.col("num_rel").cast("double").alias("nr"))
    long = (per.join(judged.select("query_id"), "query_id", "left_semi")
            .unpivot("query_id", names, "measure", "value")
            .withColumn("value", F.col("value").cast("double"))
            # the evaluator's measure names: iprec_at_recall_0.10
            .withColumn("measure", F.regexp_replace("measure", r"^(iprec_at_recall_\d)_(\d\d)$", "$1.$2")))
    scale = float(10 ** decimals) if decimals is not None else None
    if scale:
        long = long.withColumn("v", F.floor(F.col("value") * F.lit(scale) + F.lit(0.5)))
    else:
        long = long.withColumn("v", F.col("value"))
    # one pass: rollup gives the per-query rows (grouping id 0) and the
    # per-measure summary (grouping id 1) together
    g = (long.rollup("measure", "query_id")
         .agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"), F.grouping_id().alias("gid"))
         .where(F.col("gid") < 2)
         .withColumn("n_judged", judged.agg(F.count(F.lit(1)).cast("double")).scalar())
         .withColumn("total_rel", judged.agg(F.sum("nr")).scalar()))
    absent = F.col("n_judged") - F.col("c")
    s_val = F.col("s") / F.lit(scale) if scale else F.col("s")
    mean = F.col("s") / (F.col("n_judged") * F.lit(scale)) if scale else F.col("s") / F.col("n_judged")
    summary = (F.when(F.col("measure").isin("num_ret", "num_rel_ret"), s_val)
               .when(F.col("measure") == "num_rel", F.col("total_rel"))
               .when(F.col("measure") == "gm_map",
                     F.exp((s_val + absent * F.lit(math.log(GM_FLOOR))) / F.col("n_judged")))
               .otherwise(mean))
    if scale:
        summary = F.floor(summary * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    value = F.when(F.col("gid") == 0, s_val).otherwise(summary)
    return g.select("measure", F.coalesce(F.col("query_id"), F.lit("all")).alias("query_id"), value.alias("value"))
