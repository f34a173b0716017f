"""Mixing sources to target weights: iterative proportional fitting, in DataFrame functions only.

Documents are counted into cells (source, language, topic) by tokens.  Raking
scales the cells' weights to one margin after the other, round after round,
until every margin's shares are within ``TOLERANCE`` of their targets.  Targets that contradict
the cells (a language of one source only, say) never fit: after ``ROUNDS`` a
warning names the error that is left.  A cell's rate is its raked weight
over its tokens.  With a ``budget``, a share of the corpus's tokens, the rates are
scaled so that the sample is expected to have so many tokens; a rate above 1
means whole repeats and a drawn remainder, so a rare cell doesn't shrink the
sample of the others.  Without one, rates are divided by the largest and no
document is repeated; the size of the sample then depends on the rarest cell.
Either way the expected tokens of the sample have the target margins.  The draw
compares a hash of seed and id with the rate: the same whenever it is repeated,
and independent of how rows are dealt.

Nulls of a dimension are a value of their own (``?``).  A null or empty text has
no tokens; a cell without tokens keeps the rate 1.  Documents with
a null id are drawn by a hash of their text; repeated ids are drawn alike.
Values that a target names and the corpus lacks are left out and the rest
scaled; values that it doesn't name keep their natural share.  No documents: no rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adeptus.llm.shared import written

#: Rounds of raking at most, how many are planned at once, and the largest error of a share that ends it.
ROUNDS, AT_ONCE, TOLERANCE = 24, 4, 1e-9
#: Power of the natural shares that the default targets follow: 1 is natural, 0 equal shares.
POWER = 0.8
#: The queries': tokens of the sample over tokens of its input.
BUDGET = 1.0
TOKEN = r"[^ \t\r\n]+"
# Topic rules, the first that holds counts: name, and strings of which the lower-cased text has one.
TOPICS = [("legal", ["license", "licence"]), ("web", ["http://", "https://", "www."]), ("table", [" | "])]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        has = F.lit(False)
        for m in marks:
            has = has | F.contains(low, F.lit(m))
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def tempered(cells: DataFrame, dim: str, power: float = POWER) -> DataFrame:
    """(dim, share): natural token shares to a power, scaled to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    raised = sums.select(dim, F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("p").alias("all")))).select(
        dim, (F.col("p") / F.col("all")).alias("share"))


def margin_error(w: DataFrame, dims: list[str]) -> float:
    """The largest difference of a margin's share from its target's."""

    def of(d: str) -> DataFrame:
        m = w.groupBy(d).agg(F.sum("weight").alias("m"), F.max(f"goal_{d}").alias("g"))
        both = F.broadcast(m.agg(F.sum("m").alias("all_m"), F.sum("g").alias("all_g")))          # one row
        return m.crossJoin(both).agg(F.max(F.abs(F.col("m") / F.col("all_m") - F.col("g") / F.col("all_g"))).alias("error"))

    return reduce(DataFrame.unionAll, [of(d) for d in dims]).agg(F.max("error")).first()[0] or 0.0


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dims, tokens) with ``weight``: their share once all margins fit.

    ``targets`` has (value, share) of a dimension.  The number of cells is the
    number of combinations that occur, not of documents.
    """
    w = cells.filter("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    w = w.crossJoin(F.broadcast(w.agg(F.sum("tokens").alias("__all"))))                          # one row
    for d in dims:
        goal = targets[d].select(F.col(d), F.col("share").alias(f"goal_{d}"))
        natural = F.sum("tokens").over(Window.partitionBy(d)) / F.col("__all")
        w = w.join(goal, d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", natural))
    w = written(w, "cells")
    for r in range(rounds):
        for d in dims:
            margin = F.sum("weight").over(Window.partitionBy(d))
            w = w.withColumn("weight", F.col("weight") * F.col(f"goal_{d}") / margin)
        if (r + 1) % AT_ONCE == 0 or r == rounds - 1:
            w = written(w, "raked")
            error = margin_error(w, dims)
            if error <= TOLERANCE:
                break
    else:
        warnings.warn(f"raking: after {rounds} rounds a margin's share is still {error:.2g} off its target")
    return w.select(*dims, "tokens", "weight")


def rates(raked: DataFrame, dims: list[str], budget: float | None = None) -> DataFrame:
    """(dims, probability): each cell's expected copies of a document.

    They are scaled to ``budget`` of all tokens, or to 1 for the largest.
    """
    rate = raked.select(*dims, "tokens", "weight", (F.col("weight") / F.col("tokens")).alias("rate"))
    unit = F.max("rate") if budget is None else F.sum("weight") / (F.sum("tokens") * F.lit(float(budget)))
    one = F.broadcast(rate.agg(unit.alias("one")))                        # one row
    return rate.crossJoin(one).select(*dims, (F.col("rate") / F.col("one")).alias("probability"))


def uniform(seed: str, key: Column) -> Column:
    """A number of 0 to 1 from seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


DIMS = ["source", "lang", "topic"]


def cell_columns(text_col: str, source_col: str, lang_col: str) -> dict[str, Column]:
    """The three dimensions of a document."""
    return {"source": F.coalesce(F.col(source_col), F.lit("?")), "lang": F.coalesce(F.col(lang_col), F.lit("?")),
            "topic": topic(F.col(text_col))}


def chances(docs: DataFrame, targets: dict[str, DataFrame] | None = None, text_col: str = "text",
            source_col: str = "source", lang_col: str = "lang", budget: float | None = None,
            power: float = POWER) -> DataFrame:
    """(source, lang, topic, probability) of every cell with tokens.

    ``targets`` gives shares by dimension (``source``, ``lang``, ``topic``);
    a dimension that it lacks gets the natural shares to ``power``.
    """
    counted = docs.select(*(c.alias(d) for d, c in cell_columns(text_col, source_col, lang_col).items()),
                          tokens(F.col(text_col)).alias("tokens"))
    cells = written(counted.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    targets = targets or {}
    goals = {d: targets[d] if d in targets else tempered(cells, d, power) for d in DIMS}
    return written(rates(rake(cells, DIMS, goals), DIMS, budget), "mix-rates")


def draw(docs: DataFrame, chance: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", lang_col: str = "lang", seed: str = "mix") -> DataFrame:
    """``docs`` with ``__mix``: its cell, expected and drawn ``copies``, and whether the row is ``kept``."""
    dims = cell_columns(text_col, source_col, lang_col)
    u = uniform(seed, F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    rows = docs.select("*", *(c.alias(f"__mix_{d}") for d, c in dims.items()), u.alias("__mix_u"))
    chance = chance.select(*(F.col(d).alias(f"__mix_{d}") for d in dims), F.col("probability").alias("__mix_p"))
    p = F.coalesce("__mix_p", F.lit(1.0))
    copies = (F.floor(p) + F.when(F.col("__mix_u") < p - F.floor(p), 1).otherwise(0)).cast("int")
    return rows.join(chance, [f"__mix_{d}" for d in dims], "left").select(
        *(rows[c] for c in docs.columns),
        F.struct(*(F.col(f"__mix_{d}").alias(d) for d in dims), p.alias("probability"),
                 (copies > 0).alias("kept"), copies.alias("copies")).alias("__mix"))


def sampled(docs: DataFrame, chance: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that are drawn, each as often as it has copies."""
    drawn = draw(docs, chance, **columns).filter("__mix.kept")
    return drawn.withColumn("__mix", F.explode(F.expr("array_repeat(0, __mix.copies)"))).drop("__mix")
