"""Dictionary entity linking (replaces the reference's remote annotator).

Pipeline (Spark jobs, all in the JVM):

1. ``tokenize``: texts are dealt by id, a row per word; character offsets are running
   sums of the lengths of words and gaps, in one local sort per task.
2. the gazetteer's surfaces are a trie of (node, word) edges.  Every place of a
   text whose word leaves the root follows the trie, one join a level; a place
   is dropped where no edge goes on.  So a text emits rows for places that begin
   a surface, however long the longest surface is.
3. a matched span inside a longer matched span is dropped (longest match wins) by a
   running maximum of span ends over each text's matched spans, so no pairs are formed.
4. senses: the most common one of the surface (:func:`link_entities`), or the one
   that the text's other mentions vote for (:func:`link_entities_voted`).

Gazetteers ``(surface, entity, commonness, link_prob)`` come either from entity
titles (:func:`title_gazetteer`) or from hyperlink anchors of a web corpus
(:func:`anchor_gazetteer`); pass a stored one, so that Catalyst picks joins by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adeptus.session import dealt, spread, written

#: Words, and words with the gap before them.
WORDS = r"[\p{L}\p{N}_]+"
GAP_WORD = r"[^\p{L}\p{N}_]*[\p{L}\p{N}_]+"
#: Levels of the trie that a place follows with the words that it carries, before it fetches more.
AHEAD = 8
#: Characters of the texts that one task splits into words, and spans that one task orders.
TASK_CHARS, TASK_SPANS = 6_000_000, 1_000_000


def tokenize(texts: DataFrame, id_col: str = "id", text_col: str = "text", ahead: int = 0) -> DataFrame:
    """(id, i, word, begin, end, ahead): lower-cased words and their [begin, end) in characters.

    ``i`` numbers the words from 0; ``ahead`` holds (word, end) of the next ones, so many as asked for.
    Texts are shuffled once, by id; the window's order needs no further exchange.  A task gets
    about ``TASK_CHARS`` characters: AQE would bound compressed bytes, and a task's sort holds
    its texts word by word.  Ids are unique and not null.
    """
    src = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    chars = src.agg(F.sum(F.length("text"))).first()[0] or 0
    src = spread(src, chars, "id", per_task=TASK_CHARS)
    pieces = src.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(GAP_WORD), F.lit(0))).alias("i", "piece"))
    inner = Window.partitionBy("id").orderBy("i")
    size = F.length("piece")
    rows = pieces.select("id", "i", F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int").alias("end"),
                         F.regexp_extract("piece", WORDS + "$", 0).alias("own"))
    rows = rows.select("id", "i", F.lower("own").alias("word"), (F.col("end") - F.length("own")).alias("begin"), "end")
    following = [F.struct(F.lead("word", k).over(inner).alias("word"), F.lead("end", k).over(inner).alias("end"))
                 for k in range(1, ahead + 1)]
    return rows.withColumn("ahead", F.array(*following) if following else F.lit(None).cast("array<struct<word: string, end: int>>"))


def words(text):
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)


def surface_trie(surfaces: DataFrame) -> DataFrame:
    """(depth, node, word, child, surface, more): the edges of all prefixes of the surfaces.

    A node is the digest of its prefix, the root is empty.  ``surface`` is set where
    one ends, ``more`` says whether edges leave the child.
    """
    rows = (surfaces.select("surface").distinct().select("surface", F.split("surface", " ").alias("w"))
            .select("surface", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth")))

    def node(k) -> Column:
        return F.md5(F.encode(F.array_join(F.slice("w", 1, k), " "), "UTF-8"))

    last = F.col("depth") == F.size("w")
    edges = rows.select("depth", F.when(F.col("depth") > 1, node(F.col("depth") - 1)).otherwise("").alias("node"),
                        F.element_at("w", F.col("depth")).alias("word"), node(F.col("depth")).alias("child"),
                        F.when(last, F.col("surface")).alias("surface"), (~last).alias("more"))
    return edges.groupBy("depth", "node", "word", "child").agg(F.max("surface").alias("surface"), F.max("more").alias("more"))


class Trie:
    """A gazetteer's surfaces as written edges; ``deepest`` is the number of words of the longest."""

    def __init__(self, surfaces: DataFrame):
        self.edges = written(surface_trie(surfaces), "trie")
        self.deepest = self.edges.agg(F.max("depth")).first()[0] or 0
        self.ahead = min(AHEAD - 1, max(self.deepest - 1, 0))

    def places(self, rows: DataFrame) -> DataFrame:
        """(id, i, n, begin, end, surface) of every place of a surface: word number from 0, words, characters.

        ``rows`` is as from :func:`tokenize`, with ``self.ahead`` words ahead.  One join a level, over
        the places that are still on a path; each level is written, and the walk ends
        where no place goes on.
        """
        places = rows.select("id", "i", F.lit("").alias("node"), "begin", F.col("word").alias("next"), "end", "ahead")
        found = None
        for depth in range(1, max(self.deepest, 1) + 1):
            edges = self.edges.filter(F.col("depth") == depth).select("node", F.col("word").alias("next"), "child", "surface", "more")
            step = places.join(edges, ["node", "next"]).select(
                "id", "i", F.lit(depth).alias("n"), "begin", "end", "surface", F.col("child").alias("node"), "more", "ahead")
            if self.deepest > 1:
                step = written(step, "places")
            here = step.filter("surface IS NOT NULL").select("id", "i", "n", "begin", "end", "surface")
            found = here if found is None else found.unionByName(here)
            if depth >= self.deepest:
                break
            alive = step.filter("more").select("id", "i", "node", "begin", "ahead")
            if alive.isEmpty():
                break
            if depth % AHEAD == 0:                     # the words carried are used up: fetch the next ones
                more = rows.select("id", (F.col("i") - depth).alias("i"), F.col("word").alias("next"), "end", F.col("ahead").alias("later"))
                places = alive.drop("ahead").join(more, ["id", "i"]).withColumnRenamed("later", "ahead")
            else:
                tok = F.get("ahead", F.lit(depth % AHEAD - 1))
                places = alive.select("id", "i", "node", "begin", tok["word"].alias("next"), tok["end"].alias("end"), "ahead")
        return found


def title_gazetteer(entities: DataFrame, entity_col: str = "entity") -> DataFrame:
    """Gazetteer whose surfaces are the entity titles themselves (commonness 1, link_prob 1)."""
    ents = entities.select(F.col(entity_col).alias("entity")).where(F.col("entity").isNotNull()).distinct()
    return (ents.select(F.array_join(words("entity"), " ").alias("surface"), "entity",
                        F.lit(1.0).alias("commonness"), F.lit(1.0).alias("link_prob"))
            .where(F.length("surface") > 0))


_ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def page_links(pages: DataFrame, html_col: str = "html", *carry: str) -> DataFrame:
    """(surface, entity, carried columns) of every hyperlink with a text and a target."""
    anchors = (pages.select(*carry, F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_ANCHOR), 0)).alias("a"))
               .select(*carry, F.regexp_extract("a", _ANCHOR, 1).alias("href"),
                       F.regexp_replace(F.regexp_extract("a", _ANCHOR, 2), "<[^>]*>", "").alias("label")))
    anchors = anchors.select(
        F.regexp_replace(F.regexp_replace("href", r"[?#].*$", ""), r"^.*/", "").alias("entity"),
        F.array_join(words("label"), " ").alias("surface"), *carry)
    return anchors.where((F.length("entity") > 0) & (F.length("surface") > 0))


def anchor_gazetteer(pages: DataFrame, html_col: str = "html", min_anchor_count: int = 1) -> DataFrame:
    """Gazetteer from hyperlinks of a web corpus (anchor text -> link target).

    * entity     = link target (href path without leading ``/``, query, fragment)
    * commonness = P(entity | anchor surface)
    * link_prob  = (#times the surface is an anchor) / (#times it occurs as an
                   n-gram in the pages' text), capped at 1.
    """
    pages = dealt(pages.select(html_col))
    anchors = page_links(pages, html_col)
    # (surface, entity) counts, read several times below
    sense = written(anchors.groupBy("surface", "entity").agg(F.count(F.lit(1)).alias("links")), "senses")
    per_surface = sense.groupBy("surface").agg(F.sum("links").alias("as_anchor"))
    # occurrences of anchor surfaces anywhere in the visible text of the pages
    visible = pages.select(F.monotonically_increasing_id().alias("id"), F.regexp_replace(F.col(html_col), r"(?s)<[^>]*>", " ").alias("text"))
    trie = Trie(per_surface)
    toks = F.transform(words("text"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("end")))
    rows = visible.select("id", toks.alias("toks")).select("id", "toks", F.posexplode("toks").alias("i", "tok")).select(
        "id", "i", "tok.word", F.lit(0).alias("begin"), "tok.end", F.slice("toks", F.col("i") + 2, trie.ahead).alias("ahead"))
    occ = trie.places(rows).groupBy("surface").agg(F.count(F.lit(1)).alias("occurrences"))
    return (sense.join(per_surface, "surface").join(occ, "surface", "left")
            .where(F.col("links") >= F.lit(int(min_anchor_count)))
            .select("surface", "entity",
                    (F.col("links") / F.col("as_anchor")).alias("commonness"),
                    F.least(F.lit(1.0), F.col("as_anchor") / F.greatest(F.col("occurrences"), F.col("as_anchor")))
                    .alias("link_prob")))


def longest_spans(texts: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, i, begin, end, surface): surfaces of the texts that lie in no longer one.

    A span is dropped when an earlier-starting (or same-start, longer) matched
    span reaches at least as far; one window per text over its matched spans only.
    """
    trie = Trie(gazetteer)
    places = trie.places(tokenize(texts, id_col, text_col, trie.ahead))
    if trie.deepest > 1:                               # written by level, so no longer dealt by id
        places = spread(places, places.count(), "id", per_task=TASK_SPANS)
    w = (Window.partitionBy("id").orderBy(F.col("i").asc(), F.col("n").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    kept = places.withColumn("_reach", F.max(F.col("i") + F.col("n")).over(w)).where(
        F.col("_reach").isNull() | (F.col("_reach") < F.col("i") + F.col("n")))
    return kept.select("id", "i", "begin", "end", "surface")


def link_entities(texts: DataFrame, gazetteer: DataFrame, id_col: str = "id", text_col: str = "text",
                  min_link_prob: float = 0.0) -> DataFrame:
    """M1: annotations (id, begin, end, entity, rho) of every text, by the surfaces' most common senses.

    ``id`` is returned as a string, rho is the link probability.  Overlapping spans that are
    not nested are both kept; a span inside a longer matched span is dropped.
    """
    gaz = gazetteer.where(F.col("link_prob") >= F.lit(float(min_link_prob)))
    # one sense per surface: highest commonness, then entity name
    best = (gaz.groupBy("surface")
            .agg(F.max_by(F.struct("entity", "link_prob"),
                          F.struct("commonness", F.col("entity").alias("e"))).alias("s"))
            .select("surface", F.col("s.entity").alias("entity"), F.col("s.link_prob").alias("rho")))
    return longest_spans(texts, gaz, id_col, text_col).join(best, "surface").select("id", "begin", "end", "entity", "rho")


def link_entities_voted(texts: DataFrame, gazetteer: DataFrame, related: DataFrame, id_col: str = "id",
                        text_col: str = "text", min_link_prob: float = 0.0) -> DataFrame:
    """M2: annotations (id, begin, end, entity, rho) whose senses are chosen by the text's other mentions.

    ``related`` has oriented rows (source, other, rel); an entity is related to itself by 1.
    Every mention votes for a sense with the commonness-weighted relatedness of its own
    senses; a sense's coherence is the mean vote of the other mentions of the text (0 if
    there are none).  The most coherent sense is taken, then the more common one, then the later name;
    rho is the mean of link probability and coherence.

    No pairs of mentions are formed: a text has one row per candidate sense with the summed
    commonness of its mentions, which meets the sparse relatedness rows; what a mention gave
    to its own senses depends on its surface only and is subtracted.  So a vote depends on text,
    surface and sense: senses are chosen once for each surface of a text, then its mentions take them.
    """
    gaz = gazetteer.where(F.col("link_prob") >= F.lit(float(min_link_prob)))
    spans = written(longest_spans(texts, gaz, id_col, text_col), "spans")
    rows = spans.count()                               # from the files' footers
    mentions = spans.groupBy("id").agg(F.size(F.collect_set("i")).alias("mentions"))
    surfaces = spread(spans.select("id", "surface"), rows, "id", per_task=TASK_SPANS).groupBy("id", "surface").agg(
        F.count(F.lit(1)).alias("times"))
    candidates = written(surfaces.join(gaz, "surface"), "candidates")
    weight = candidates.groupBy("id", "entity").agg(F.sum(F.col("commonness") * F.col("times")).alias("weight"))
    near = related.where("source <> other").select("source", "other", "rel")

    def gathered(weights: DataFrame, key: str) -> DataFrame:
        """(key, entity, gain): for each sense of a key the related senses' weights of the same key, with its own."""
        given = weights.join(near, F.col("entity") == F.col("other")).select(
            key, F.col("source").alias("entity"), (F.col("rel") * F.col("weight")).alias("weight"))
        given = given.join(weights.select(key, "entity"), [key, "entity"], "left_semi")
        return given.unionByName(weights).groupBy(key, "entity").agg(F.sum("weight").alias("gain"))

    support = gathered(weight, "id").withColumnRenamed("gain", "support")
    own = written(gathered(gaz.groupBy("surface", "entity").agg(F.sum("commonness").alias("weight")), "surface"), "own")
    others = F.col("mentions") - 1
    vote = F.when(others > 0, F.round(F.greatest((F.col("support") - F.col("gain")) / others, F.lit(0.0)), 9)).otherwise(0.0)
    voted = (candidates.join(support, ["id", "entity"]).join(own, ["surface", "entity"]).join(mentions, "id")
             .select("id", "surface", F.struct(vote.alias("vote"), "commonness", "entity", "link_prob").alias("sense")))
    best = voted.groupBy("id", "surface").agg(F.max("sense").alias("sense"))
    taken = spans.join(best, ["id", "surface"]).select("id", "i", F.struct(F.col("sense"), "begin", "end").alias("s"))
    return spread(taken, rows, "id", per_task=TASK_SPANS).groupBy("id", "i").agg(F.max("s").alias("s")).select(
        "id", "s.begin", "s.end", F.col("s.sense.entity").alias("entity"),
        ((F.col("s.sense.link_prob") + F.col("s.sense.vote")) / 2).alias("rho"))


def annotations_array(annotations: DataFrame) -> DataFrame:
    """(id, annotations array<struct<begin,end,entity,rho>>) sorted by begin."""
    return (annotations.groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("begin", "end", "entity", "rho"))).alias("annotations")))


def annotated_bodies(texts: DataFrame, annotations: DataFrame, id_col: str = "id",
                     text_col: str = "text") -> DataFrame:
    """B13 for every text: (id, body) with its annotations wrapped in spans.

    Texts without annotations keep their (escaped) text.
    """
    from adeptus.functions.text import annotated_text
    arrays = annotations_array(annotations)
    t = dealt(texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    return t.join(arrays, "id", "left").select("id", annotated_text("text", "annotations").alias("body"))


def query_entities(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Distinct (query_id, entity) found by linking each query text."""
    ann = link_entities(queries, gazetteer, "query_id", "text")
    return ann.select(F.col("id").alias("query_id"), "entity").distinct()


# --------------------------------------------------------------------------
# Annotation memo keyed by the text's SHA-256
# --------------------------------------------------------------------------
def annotate_with_memo(texts: DataFrame, memo: DataFrame | None, annotator, id_col: str = "id",
                       text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Annotate only texts whose hash is not in ``memo``; return (annotations, new_memo_rows).

    ``memo`` rows: (text_hash, begin, end, entity, rho) plus a marker row with
    null entity for texts without annotations.  ``annotator(df(id, text))``
    returns (id, begin, end, entity, rho); it runs once, since its new rows are
    written before they are read.
    """
    keyed = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                         F.sha2(F.col(text_col), 256).alias("text_hash"))
    hashes = keyed.select("text_hash", "text").dropDuplicates(["text_hash"])
    todo = hashes if memo is None else hashes.join(memo.select("text_hash").distinct(), "text_hash", "left_anti")
    fresh = annotator(todo.select(F.col("text_hash").alias("id"), "text"))
    fresh_rows = written(todo.select("text_hash").join(fresh.withColumnRenamed("id", "text_hash"), "text_hash", "left")
                         .select("text_hash", "begin", "end", "entity", "rho"), "annotations")
    all_memo = fresh_rows if memo is None else memo.unionByName(fresh_rows)
    out = (keyed.join(all_memo, "text_hash").where(F.col("entity").isNotNull())
           .select("id", "begin", "end", "entity", "rho"))
    return out, fresh_rows
