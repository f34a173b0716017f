"""URL filters: gradient-boosted trees on lexical features, in DataFrame functions only.

Rules (host, path) judge the URLs that they fit; the URLs so judged are the labelled ones
from which the trees learn to judge the rest.

* Features are small integers: length of URL, host and path, depth (slashes of the path), host labels,
  digit ratio, entropy of the characters, parameters, and for the host's last
  label the share of blocked ones among its labelled URLs and its frequency.
* URLs of equal features are one vector with a count of labelled and blocked
  URLs, so the table is read once and every round reads the vectors only.
* A tree is symmetric: each of its ``DEPTH`` levels splits all nodes by one feature and
  threshold.  Per level one aggregation sums gradients and curvatures of the logistic
  loss by (node, feature, bin), a table bounded by the bins, of which the split of
  largest gain is taken; ties by the smaller feature, then threshold.
* Gradients, curvatures and leaves are integers in units of 2**-16 and 1e-6, so sums
  don't depend on the order of rows, and a repeated task gives the same trees.
* The trees are a sum of table look-ups by comparison bits, evaluated for all rows in the JVM.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by its features like any other.  Very long URLs fall into the last bins.  Without
labelled URLs of either kind there are no trees, and the prior alone decides: more blocked
than allowed.  Repeated rows are judged each.  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adeptus.llm.shared import written

#: (verdict, host, path); a rule fits its host and all subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ROUNDS, DEPTH = 8, 3
#: Step of a round in 1/1000, and the ridge of a leaf in rows.
RATE, RIDGE = 300, 4
UNIT, MICRO = 1 << 16, 1_000_000
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "params", "suffix_share", "suffix_rank"]


# ------------------------------------------------------------------ features
def host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; the rules are a short list, part of the plan."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def entropy(text: Column) -> Column:
    """Bits per character: runs of the sorted characters give their counts."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    n = F.length(text).cast("double")
    used = F.aggregate(runs, F.lit(0.0), lambda a, r: a + F.length(r) * F.log2(F.length(r).cast("double")))
    return F.when(n > 0, F.log2(n) - used / n).otherwise(0.0)


def features(url: Column, host_col: Column, path_col: Column) -> dict[str, Column]:
    """The features that a URL has by itself, as integers; the last two come from the labelled ones."""
    text = F.coalesce(url, F.lit(""))

    def count(what: Column, pattern: str) -> Column:
        return F.coalesce(F.regexp_count(what, F.lit(pattern)), F.lit(0))

    size = F.length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {"length": F.least(F.floor(size / 2), F.lit(127)), "host_length": F.least(F.length(host_col), F.lit(63)),
            "path_length": F.least(F.length(path_col), F.lit(127)), "depth": F.least(count(path_col, "/"), F.lit(31)),
            "labels": F.least(count(host_col, r"\."), F.lit(15)), "digits": F.floor(count(text, "[0-9]") * 16 / F.greatest(size, F.lit(1))),
            "entropy": F.floor(F.round(entropy(text) * 8, 6)), "params": F.least(count(query, "[^&]+"), F.lit(15))}


def suffix(host_col: Column) -> Column:
    return F.substring_index(host_col, ".", -1)


def described(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, host, path, rule, label, features) of every row; ``label`` is 1 for block, 0 for allow."""
    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"),
                         path(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = features(F.col("url"), F.col("host"), F.col("path"))
    rows = split.select("id", "host", "path", rule.alias("rule"), (verdict == "block").cast("int").alias("label"),
                        *(c.cast("int").alias(k) for k, c in own.items()), suffix(F.col("host")).alias("suffix"))
    rows = written(rows, "urls")
    ends = rows.groupBy("suffix").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"),
                                      F.count("*").alias("all"))
    # smoothed share in sixteenths; frequency as the number of decimal digits
    ends = written(ends.select("suffix", F.floor((F.col("blocked") * 2 + 1) * 8 / (F.col("n") + 1)).cast("int").alias("suffix_share"),
                               F.length(F.col("all").cast("string")).alias("suffix_rank")), "suffixes")
    return rows.join(ends, "suffix").drop("suffix")


# --------------------------------------------------------------------- trees
class Trees:
    """``prior`` in millionths, and per tree its (feature, threshold) splits and leaves in millionths."""

    def __init__(self, prior: int):
        self.prior = prior
        self.trees: list[tuple[list[tuple[int, int]], list[int]]] = []

    def margin(self) -> Column:
        """Log-odds of block in millionths."""
        total = F.lit(self.prior).cast("long")
        for splits, leaves in self.trees:
            total = total + F.element_at(F.array(*(F.lit(v).cast("long") for v in leaves)), node(splits) + 1)
        return total


def node(splits: list[tuple[int, int]]) -> Column:
    """Number of the node that the splits lead to; a value above the threshold sets the level's bit."""
    out = F.lit(0)
    for bit, (feature, threshold) in enumerate(splits):
        out = out + (F.col(FEATURES[feature]) > threshold).cast("int") * (1 << bit)
    return out


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin.cast("double") / MICRO))


def _gain(g: int, h: int) -> float:
    return float(g) * float(g) / (float(h) + RIDGE * UNIT)


def best_split(sums: dict[tuple[int, int, int], tuple[int, int]]) -> tuple[int, int]:
    """The (feature, threshold) of largest gain from sums by (node, feature, bin)."""
    nodes = sorted({k[0] for k in sums})
    best = None
    for feature in range(len(FEATURES)):
        bins = sorted({b for _, f, b in sums if f == feature})
        left = {n: (0, 0) for n in nodes}
        whole = {n: [sum(sums.get((n, feature, b), (0, 0))[i] for b in bins) for i in (0, 1)] for n in nodes}
        for b in bins:
            gain = 0
            for n in nodes:
                g, h = sums.get((n, feature, b), (0, 0))
                left[n] = (left[n][0] + g, left[n][1] + h)
                (lg, lh), (wg, wh) = left[n], whole[n]
                gain += math.floor(_gain(lg, lh) + _gain(wg - lg, wh - lh) - _gain(wg, wh))
            if best is None or (-gain, feature, b) < best:
                best = (-gain, feature, b)
    return best[1:]


def leaf_value(g: int, h: int) -> int:
    """A Newton step of the logistic loss, in millionths."""
    return math.floor(float(g) * RATE * (MICRO // 1000) / (float(h) + RIDGE * UNIT) + 0.5)


def prior_of(n: int, blocked: int) -> int:
    """Log-odds of block among ``n`` labelled rows, one of each added, in millionths."""
    return math.floor(math.log((blocked + 1) / (n - blocked + 1)) * MICRO + 0.5)


def fit(labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Boosted trees from rows with the features and ``label`` (1 for block, 0 for allow, null for none).

    The driver holds the sums by (node, feature, bin): at most 2**(depth - 1) nodes times the bins of all features.
    """
    vectors = written(labelled.filter("label IS NOT NULL").groupBy(*FEATURES).agg(
        F.count("*").alias("n"), F.sum("label").alias("y")), "vectors")
    total = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = Trees(prior_of(*total))
    if not 0 < total[1] < total[0]:
        return model
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).alias("bin")) for i, f in enumerate(FEATURES))))
    for _ in range(rounds):
        p = probability(model.margin())
        slope = vectors.select("*", (F.col("y") * UNIT - F.col("n") * F.floor(p * UNIT + 0.5)).alias("g"),
                               (F.col("n") * F.floor(p * (1 - p) * UNIT + 0.5)).alias("h"))
        splits: list[tuple[int, int]] = []
        for _ in range(depth):
            rows = slope.select(node(splits).alias("node"), bins.alias("b"), "g", "h").groupBy("node", "b.feature", "b.bin").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums = {(r["node"], r["feature"], r["bin"]): (r["g"], r["h"]) for r in rows}
            splits.append(best_split(sums))
        leaves = [(0, 0)] * (1 << depth)
        feature, threshold = splits[-1]
        for (n, f, b), (g, h) in sums.items():
            if f == feature:
                at = n + ((b > threshold) << (depth - 1))
                leaves[at] = (leaves[at][0] + g, leaves[at][1] + h)
        model.trees.append((splits, [leaf_value(g, h) for g, h in leaves]))
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; ``score`` is the trees' probability of block."""
    rows = described(pages, id_col, url_col, rules)
    margin = fit(rows).margin()
    by_trees = F.when(margin > 0, "block").otherwise("allow")
    by_rule = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, by_trees).alias("verdict"),
                       (F.floor(probability(margin) * 10_000 + 0.5) / 10_000).alias("score"))
