"""Author profiles, query weights and the expertise scoring functions.

Symbols: N = total documents, pop(e) = documents mentioning e, P(a) =
documents of author a with any mention, ec(a,e) = documents of a with a
confident mention of e, mr(a,e) = max confident rho, Q = distinct query
entities (|Q| counts entities unknown to the corpus too).

All functions score every (query, candidate author) pair in one plan; the
final ``groupBy(query_id, author_id)`` aggregates map-side first.  Pass query
entities as a stored table: several joins read them, and Catalyst then picks
the join by their size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adeptus.corpus import Corpus
from adeptus.operators.relatedness import cooccurrence_relatedness
from adeptus.operators.skew import ROWS_PER_TASK, heavy_keys, replicated, salted
from adeptus.session import written

# Fixed parameters of the relatedness scoring (values from the reference).
RELATEDNESS_ALPHA = 1e-5
RELATEDNESS_X = 10.0


def author_profiles(corpus: Corpus) -> DataFrame:
    """E1 for all authors: per (author, entity) ef, iaf, ef*iaf, max_rho, years.

    ``ef = ec / P``, ``iaf = ln(N / pop)``.  Only confident entities appear.
    """
    def build():
        ae = corpus.author_entity()
        return (ae.join(corpus.papers(), "author_id")
                .join(corpus.popularity(), "entity")
                .withColumn("total_papers", corpus.total().scalar())  # scalar subquery
                .withColumn("ef", F.col("author_freq") / F.col("papers"))
                .withColumn("iaf", F.ln(F.col("total_papers") / F.col("entity_popularity")))
                .withColumn("ef_iaf", F.col("ef") * F.col("iaf"))
                .select("author_id", "entity", "author_freq", "papers", "entity_popularity",
                        "total_papers", "ef", "iaf", "ef_iaf", "max_rho", "years"))
    return corpus.memo("profiles", build)


def author_norms(corpus: Corpus) -> DataFrame:
    """Sum of ef*iaf over all confident entities of each author (E3 denominator)."""
    return corpus.memo("norms", lambda: author_profiles(corpus)
                       .groupBy("author_id").agg(F.sum("ef_iaf").alias("efiaf_sum")))


def query_entity_counts(query_entities: DataFrame) -> DataFrame:
    """|Q| per query: distinct query entities, known or not."""
    return (query_entities.select("query_id", "entity").distinct()
            .groupBy("query_id").agg(F.count(F.lit(1)).alias("n_query_entities")))


def query_weights(corpus: Corpus, query_entities: DataFrame) -> DataFrame:
    """``qw(e) = (1/|Q|) * ln(N / pop(e))`` for query entities known to the corpus."""
    return (corpus.popularity().join(query_entities.select("query_id", "entity").distinct(), "entity")
            .join(query_entity_counts(query_entities), "query_id")
            .withColumn("total_papers", corpus.total().scalar())
            .select("query_id", "entity",
                    (F.lit(1.0) / F.col("n_query_entities")
                     * F.ln(F.col("total_papers") / F.col("entity_popularity"))).alias("qw")))


def citing_authors(corpus: Corpus, query_entities: DataFrame) -> DataFrame:
    """Distinct (query, author) with a confident mention of a query entity."""
    return corpus.author_entity().join(query_entities, "entity").select("query_id", "author_id").distinct()


def vector_sums(corpus: Corpus, query_entities: DataFrame) -> DataFrame:
    """Per (query, candidate author): dot = sum efiaf*qw, efiaf, eciaf, log_ec_ef_iaf.

    * efiaf          = sum (ec/P) * qw
    * eciaf          = sum ec * qw
    * log_ec_ef_iaf  = sum (ln ec + ec/P) * qw

    Candidates are exactly the authors with a confident mention of a known
    query entity, i.e. the rows of the profile ⋈ query-weight join.
    """
    joined = author_profiles(corpus).join(query_weights(corpus, query_entities), "entity")
    return (joined.groupBy("query_id", "author_id")
            .agg(F.sum(F.col("ef_iaf") * F.col("qw")).alias("dot"),
                 F.sum(F.col("ef") * F.col("qw")).alias("efiaf"),
                 F.sum(F.col("author_freq") * F.col("qw")).alias("eciaf"),
                 F.sum((F.ln(F.col("author_freq")) + F.col("ef")) * F.col("qw")).alias("log_ec_ef_iaf")))


def vector_scores(corpus: Corpus, query_entities: DataFrame) -> DataFrame:
    """E3-E6 in one pass: one row per (query, candidate author).

    Columns: query_id, author_id, cossim_efiaf, efiaf, eciaf, log_ec_ef_iaf, where
    cossim_efiaf = sum efiaf*qw / (sqrt(sum_A efiaf) * sqrt(sum_Q qw)) -- roots
    of plain sums, as defined by the reference; 0/0 -> 0.0.  The author norm
    is aggregated once for all authors (memoised per corpus).
    """
    qnorm = query_weights(corpus, query_entities).groupBy("query_id").agg(F.sum("qw").alias("qw_sum"))
    denom = F.sqrt(F.col("efiaf_sum")) * F.sqrt(F.col("qw_sum"))
    return (vector_sums(corpus, query_entities).join(author_norms(corpus), "author_id")
            .join(qnorm, "query_id")
            .select("query_id", "author_id",
                    F.coalesce(F.try_divide(F.col("dot"), denom), F.lit(0.0)).alias("cossim_efiaf"),
                    "efiaf", "eciaf", "log_ec_ef_iaf"))


def _single(column: str) -> Callable[[Corpus, DataFrame], DataFrame]:
    def fn(corpus: Corpus, query_entities: DataFrame, **_) -> DataFrame:
        src = vector_scores(corpus, query_entities) if column == "cossim_efiaf" \
            else vector_sums(corpus, query_entities)  # no norm join needed
        return src.select("query_id", "author_id", F.col(column).alias("score"))
    fn.__name__ = f"{column}_score"
    fn.__doc__ = f"Score = ``{column}`` column of :func:`vector_scores`."
    return fn


cossim_efiaf_score = _single("cossim_efiaf")
efiaf_score = _single("efiaf")
eciaf_score = _single("eciaf")
log_ec_ef_iaf_score = _single("log_ec_ef_iaf")


def relatedness_geom_score(corpus: Corpus, query_entities: DataFrame,
                           relatedness: DataFrame | None = None,
                           alpha: float = RELATEDNESS_ALPHA, x: float = RELATEDNESS_X,
                           per_task: int = ROWS_PER_TASK, **_) -> DataFrame:
    """Relatedness-weighted geometric score of each candidate author.

    For query entity q: ``g_q`` = weighted geometric mean over the author's
    confident entities a of ``1 - rel(q,a)^x + alpha`` with weights
    ``ec(a)*mr(a)``; score = mean over all q in Q of
    ``clip(1 - g_q + alpha, 0, 1) ** (1/x)``.  Unrelated pairs (rel = 0)
    contribute the constant ``ln(1 + alpha)``, so with ``W = sum w`` and
    ``D = sum_{rel>0} w * (ln(1 - r^x + alpha) - ln(1 + alpha))``:
    ``1 - g_q + alpha = -(1 + alpha) * expm1(D / W)``.  Only related pairs
    whose term is not exactly 0.0 are joined (no |Q| x |A| product) and the
    unrelated case is exactly 0.

    ``D`` depends on the query entity and the author alone: it is summed once
    for each, over candidate authors only, and joined with the queries last.
    The authors of an entity that has more than ``per_task`` of them are dealt to
    as many tasks as that takes.

    ``relatedness``: oriented rows (source, other, rel) covering the query
    entities as ``source``, such as a stored memo; default is co-occurrence
    relatedness (M3) of the corpus.  The identity rel(q, q) = 1 is always added.
    """
    qe = query_entities.select("query_id", "entity").distinct()
    sources = qe.select("entity").distinct()
    if relatedness is None:
        relatedness = cooccurrence_relatedness(corpus, sources)
    rel = (relatedness.select("source", "other", "rel")
           .join(sources.withColumnRenamed("entity", "source"), "source", "left_semi")
           .where(F.col("source") != F.col("other"))
           .unionByName(sources.select(F.col("entity").alias("source"),
                                       F.col("entity").alias("other"), F.lit(1.0).alias("rel"))))
    # ln(1 + alpha) with the very same double operations as the term, so an
    # unrelated pair (r = 0) gives exactly 0.0
    ln1a = F.ln(F.lit(1.0) - F.pow(F.lit(0.0), F.lit(x)) + F.lit(alpha))
    # per related pair, the constant part of its term; pairs whose term is
    # exactly 0.0 in floating point (r^x below the precision of 1 + alpha)
    # add nothing and are dropped before the author join
    terms = (rel.select("source", "other",
                        (F.ln(F.lit(1.0) - F.pow(F.col("rel"), F.lit(x)) + F.lit(alpha)) - ln1a).alias("term"))
             .where(F.col("term") != 0.0))
    ae = corpus.author_entity().select(
        "author_id", "entity", (F.col("author_freq") * F.col("max_rho")).alias("w"))
    candidates = ae.join(qe, "entity").select("query_id", "author_id").distinct()
    own = ae.join(ae.join(sources, "entity", "left_semi").select("author_id").distinct(), "author_id", "left_semi")
    wsum = own.groupBy("author_id").agg(F.sum("w").alias("W"))
    heavy = corpus.memo(f"heavy_entities_{per_task}", lambda: heavy_keys(corpus.author_entity().select(
        F.col("entity").alias("other")), "other", per_task))
    others = salted(own.select("author_id", F.col("entity").alias("other"), "w"), "other", "author_id", heavy)
    gap = -(1.0 + alpha) * F.expm1(F.col("D") / F.col("W"))
    per_source = (replicated(terms, "other", heavy).join(others, ["other", "salt"])
                  .groupBy("source", "author_id").agg(F.sum(F.col("w") * F.col("term")).alias("D"))
                  .join(wsum, "author_id")
                  .select("source", "author_id",
                          F.pow(F.least(F.greatest(gap, F.lit(0.0)), F.lit(1.0)), F.lit(1.0 / x)).alias("t")))
    return (per_source.join(qe.withColumnRenamed("entity", "source"), "source")
            .join(candidates, ["query_id", "author_id"], "left_semi")
            .groupBy("query_id", "author_id").agg(F.sum("t").alias("t_sum"))
            .join(query_entity_counts(qe), "query_id")
            .select("query_id", "author_id",
                    (F.col("t_sum") / F.col("n_query_entities")).alias("score")))


def random_score(corpus: Corpus, query_entities: DataFrame, seed: int = 42, **_) -> DataFrame:
    """Reproducible uniform [0, 1) score per (query, candidate) from a hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "query_id", "author_id", F.lit(str(int(seed))))), 1, 8), 16, 10)
    return citing_authors(corpus, query_entities).select(
        "query_id", "author_id",
        (h.cast("double") / float(1 << 32)).alias("score"))


# K1: scoring registry ------------------------------------------------------
SCORING_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "cossim_efiaf_score": cossim_efiaf_score,
    "efiaf_score": efiaf_score,
    "eciaf_score": eciaf_score,
    "log_ec_ef_iaf_score": log_ec_ef_iaf_score,
    "relatedness_geom": relatedness_geom_score,
    "random_score": random_score,
}


def register_scoring(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a user scoring ``fn(corpus, query_entities, **kw) -> (query_id, author_id, score)``."""
    SCORING_FUNCTIONS[name] = fn


def get_scoring(name: str) -> Callable[..., DataFrame]:
    try:
        return SCORING_FUNCTIONS[name]
    except KeyError:
        raise ValueError(f"unknown scoring function {name!r}; "
                         f"choose from {sorted(SCORING_FUNCTIONS)}") from None


#: The five reference scorings: name in the registry, name in the long form.
FIVE = {f"{c}_score": c for c in ("cossim_efiaf", "efiaf", "eciaf", "log_ec_ef_iaf")} | {"relatedness_geom": "relatedness_geom"}
_OWN = {name: SCORING_FUNCTIONS[name] for name in FIVE}


def scorings(corpus: Corpus, query_entities: DataFrame, names, relatedness: DataFrame | None = None,
             authors: DataFrame | None = None) -> DataFrame:
    """(query_id, author_id, scoring, score) for each of the registered ``names``.

    However many of E3-E6 are asked for, they come from one wide aggregation.  With
    ``authors`` a ``name`` comes last, null for unknown authors: it joins the wide rows, which
    are a fourth of the long ones.  These are written, so that what sorts the long rows several
    times over doesn't keep the scorings' shuffles beside its own.
    """
    ids, last = ["query_id", "author_id"], []
    if authors is not None:
        who, last = authors.select("author_id", "name"), ["name"]
        ids = [*ids, *last]

    def named(scores: DataFrame, *columns) -> DataFrame:
        if authors is None:
            return scores.select(*ids, *columns)
        return written(scores.join(who, "author_id", "left").select(*ids, *columns), "scores", "zstd")

    names = list(dict.fromkeys(names))
    wide = [n for n in names if n in FIVE and n != "relatedness_geom" and get_scoring(n) is _OWN[n]]
    parts = []
    if wide:
        scores = vector_scores(corpus, query_entities) if "cossim_efiaf_score" in wide else vector_sums(corpus, query_entities)
        scores = named(scores, *(F.col(FIVE[n]).alias(n) for n in wide))
        parts.append(scores.unpivot(ids, wide, "scoring", "score").select("query_id", "author_id", "scoring", "score", *last))
    for n in names:
        if n not in wide:
            extra = {"relatedness": relatedness} if n == "relatedness_geom" and get_scoring(n) is _OWN[n] else {}
            parts.append(named(get_scoring(n)(corpus, query_entities, **extra), "score").select(
                "query_id", "author_id", F.lit(n).alias("scoring"), "score", *last))
    return reduce(DataFrame.unionByName, parts)


def all_scorings(corpus: Corpus, query_entities: DataFrame,
                 relatedness: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """The five reference scorings in long form (query_id, author_id, scoring, score[, name])."""
    return scorings(corpus, query_entities, FIVE, relatedness, authors).withColumn("scoring", F.regexp_replace("scoring", "_score$", ""))
