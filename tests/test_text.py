"""Text column functions, language profiles and dictionary linking vs brute force."""

import math
import re
import time

from pyspark.sql import functions as F

from adeptus.functions import text as T
from adeptus.operators import language, linking, relatedness


def span(entity, score, text):
    return f"<span class='annotation' entity='{entity}' score='{score}'>{text}</span>"


def test_annotated_text(spark):
    cases = [  # text, annotations, the body written out by hand
        ("Tom & Jerry <3 cats", [(0, 3, "Tom_Cat", 0.5), (16, 20, "Cat's", 0.25)],
         span("Tom_Cat", 0.5, "Tom") + " &amp; Jerry &lt;3 c" + span("Cat&#x27;s", 0.25, "ats")),
        ("no annotations & here", [], "no annotations &amp; here"),
        ("abc def ghi", [(4, 7, "D", 1.0), (0, 3, "A", 0.5)],  # unsorted input
         span("A", 0.5, "abc") + " " + span("D", 1.0, "def") + " ghi"),
        ("x" * 15, [(2, 5, "P", 0.5), (3, 4, "Q", 0.75)],  # overlapping spans
         "xx" + span("P", 0.5, "xxx") + span("Q", 0.75, "x") + "x" * 11),
        ("è😀 ünï & <code> €", [(1, 2, "Smile", 0.5), (3, 6, "U", 0.5)],  # non-ASCII offsets
         "è" + span("Smile", 0.5, "😀") + " " + span("U", 0.5, "ünï") + " &amp; &lt;code&gt; €"),
        ("", [], ""),
    ]
    schema = "t string, a array<struct<begin:int,end:int,entity:string,rho:double>>"
    df = spark.createDataFrame([c[:2] for c in cases], schema)
    got = [r.body for r in df.select(T.annotated_text("t", "a").alias("body")).collect()]
    assert got == [c[2] for c in cases]


def test_normalize_author_and_snippets(spark):
    df = spark.createDataFrame([("  jOHN   paul ", "o'BRIEN-smith"), ("nicolò", "d'àngelo"), ("ann", "lee.")],
                               "f string, l string")
    got = [r.n for r in df.select(T.normalize_author("f", "l").alias("n")).collect()]
    assert got == ["John Paul O brien smith", "Nicolò D àngelo", "Ann Lee "]
    s = spark.createDataFrame([("a\tb\nc",), ("y" * 84,), ("z" * 83,)], "s string")
    sn = [r.x for r in s.select(T.snippet("s").alias("x")).collect()]
    assert sn == ["a b c", "y" * 80 + "...", "z" * 83]
    assert s.select(F.length(T.truncate("s", 5))).first()[0] == 5
    assert spark.range(1).select(T.normalize_space(F.lit("\t a\nb \r")).alias("x")).first().x == "a b"
    legit = spark.createDataFrame([(None,), ("x" * 10,), ("x" * 11,)], "s string")
    assert [r.ok for r in legit.select(T.legit_document("s").alias("ok")).collect()] == [False, False, True]


def test_language_detection(spark):
    docs = spark.createDataFrame([
        (1, "The cat and the dog are in the house of my friend."),
        (2, "Der Hund und die Katze sind nicht in dem Haus."),
        (3, "Le chat et le chien sont dans la maison pour les enfants."),
        (4, "El perro y el gato no están en la casa con los niños."),
        (5, "Xyzzy plugh qwerty."),
        (6, None),
    ], "doc_id long, text string")
    got = {r.doc_id: r.detected for r in language.with_language(docs).collect()}
    assert got == {1: "en", 2: "de", 3: "fr", 4: "es", 5: "broken", 6: "broken"}
    counts = {r.lang: r.documents for r in language.language_counts(language.with_language(docs)).collect()}
    assert counts["broken"] == 2
    assert {r.doc_id for r in language.route_non_english(language.with_language(docs)).collect()} == {2, 3, 4, 5, 6}


def py_link(text, gaz, max_n=4):
    """Brute force: every n-gram, best sense per surface, drop spans inside longer matches."""
    toks = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w+", text or "")]
    best = {}
    for s, e, c, lp in gaz:
        cur = best.get(s)
        if cur is None or (c, e) > (cur[1], cur[0]):
            best[s] = (e, c, lp)
    spans = []
    for i in range(len(toks)):
        for n in range(1, max_n + 1):
            if i + n <= len(toks):
                surf = " ".join(t[2] for t in toks[i:i + n])
                if surf in best:
                    spans.append((i, n, toks[i][0], toks[i + n - 1][1], best[surf][0], best[surf][2]))
    keep = [s for s in spans if not any(o[1] > s[1] and o[0] <= s[0] and o[0] + o[1] >= s[0] + s[1] for o in spans)]
    return sorted((b, e, ent, rho) for _, _, b, e, ent, rho in keep)


def test_link_entities_brute_force(spark):
    gaz = [("new york", "New_York", 0.9, 0.5), ("york", "York", 1.0, 0.3), ("new york city", "NYC", 1.0, 0.8),
           ("city", "City", 1.0, 0.1), ("apple", "Apple_Inc", 0.6, 0.4), ("apple", "Apple_fruit", 0.4, 0.4),
           ("big apple", "NYC", 1.0, 0.7)]
    texts = ["I love New York City and the big Apple.", "York, new york; YORK!", "", None, "apple apple pie city"]
    tdf = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    gdf = spark.createDataFrame(gaz, "surface string, entity string, commonness double, link_prob double")
    got = {}
    for r in linking.link_entities(tdf, gdf).collect():
        got.setdefault(int(r.id), []).append((r.begin, r.end, r.entity, r.rho))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == py_link(t, gaz), t


def test_title_gazetteer_and_query_entities(spark):
    ents = spark.createDataFrame([("red widget",), ("Blue  Bolt",), ("widget",)], "entity string")
    gaz = linking.title_gazetteer(ents)
    assert {(r.surface, r.entity) for r in gaz.collect()} == {
        ("red widget", "red widget"), ("blue bolt", "Blue  Bolt"), ("widget", "widget")}
    qs = spark.createDataFrame([("q1", "Red widget and a blue bolt"), ("q2", "nothing")], "query_id string, text string")
    got = {(r.query_id, r.entity) for r in linking.query_entities(qs, gaz).collect()}
    assert got == {("q1", "red widget"), ("q1", "Blue  Bolt")}  # 'widget' is inside 'red widget'


def test_anchor_gazetteer(spark):
    pages = spark.createDataFrame([
        ('<p>see <a href="/Paris">Paris</a> and <a href="/wiki/Paris_(city)?x=1">paris</a> in paris</p>',),
        ('<a href="/Paris_Hilton">Paris</a> <a href="#">empty</a>',)], "html string")
    g = {(r.surface, r.entity): (r.commonness, r.link_prob) for r in linking.anchor_gazetteer(pages).collect()}
    # 'paris' is an anchor 3 times, occurs 4 times as text
    assert set(g) == {("paris", "Paris"), ("paris", "Paris_(city)"), ("paris", "Paris_Hilton")}
    assert all(abs(c - 1 / 3) < 1e-12 and abs(lp - 3 / 4) < 1e-12 for c, lp in g.values())


def test_annotation_memo(spark):
    texts = spark.createDataFrame([(1, "New York"), (2, "New York"), (3, "nothing")], "id long, text string")
    gdf = spark.createDataFrame([("new york", "NY", 1.0, 0.5)], "surface string, entity string, commonness double, "
                                "link_prob double")
    calls = []

    def annotator(df):
        calls.append(df)
        return linking.link_entities(df, gdf)

    out, fresh = linking.annotate_with_memo(texts, None, annotator)
    assert sorted((r.id, r.entity) for r in out.collect()) == [("1", "NY"), ("2", "NY")]
    memo = fresh
    assert calls[0].count() == 2  # identical texts are annotated once
    out2, fresh2 = linking.annotate_with_memo(texts, memo, annotator)
    assert fresh2.count() == 0 and out2.count() == 2


def test_link_long_title(spark):
    """A title of six tokens is linked whole, and its anchor counts all its places in the text."""
    title = "theory of computation and formal languages"
    gaz = linking.title_gazetteer(spark.createDataFrame([(title,), ("graph",)], "entity string"))
    q = spark.createDataFrame([("q", f"a graph in {title} today")], "query_id string, text string")
    assert sorted(r.entity for r in linking.query_entities(q, gaz).collect()) == ["graph", title]
    pages = spark.createDataFrame([(f"<p><a href='/T'>{title}</a> {title} or {title}</p>",)], "html string")
    row = linking.anchor_gazetteer(pages).first()
    assert (row.surface, round(row.link_prob, 9)) == (title, round(1 / 3, 9))


def test_tokenize_offsets(spark):
    """Offsets of every word of odd and of long texts, as a plain scan finds them."""
    texts = ["", None, "  a", "a ", "Ünï-çödé 文字 🙂x", "### !!", "ab" * 3000 + " " * 500 + "c", "x y-z " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, word int")
    rows = linking.tokenize(df, ahead=2).collect()
    for i, t in enumerate(texts):
        want = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t or "")]
        own = sorted((r for r in rows if r.id == str(i)), key=lambda r: r.i)
        assert [(r.word, r.begin, r.end) for r in own] == want
        for k, r in list(enumerate(own))[-5:]:
            assert [(a.word, a.end) for a in r.ahead if a.word is not None] == [(w, e) for w, _, e in want[k + 1:k + 3]]
    plan = linking.tokenize(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_one_long_surface_costs_no_rows(spark):
    """A surface of 19 words: only places that begin it are followed, and it is found whole."""
    long = [f"w{k % 7}" for k in range(19)]
    gaz = [(" ".join(long), "Long", 1.0, 1.0), ("w1 w2", "Short", 1.0, 0.5), ("zebra", "Z", 1.0, 0.2)]
    gdf = spark.createDataFrame(gaz, "surface string, entity string, commonness double, link_prob double")
    text = "zebra " + " ".join(long) + " w1 w2 " + " ".join(long[:15]) + " zebra"
    tdf = spark.createDataFrame([(0, text), (1, "plain words " * 2000)], "id long, text string")
    trie = linking.Trie(gdf)
    assert trie.deepest == 19 and trie.ahead == linking.AHEAD - 1
    places = sorted((r.i, r.n, r.surface) for r in trie.places(linking.tokenize(tdf, ahead=trie.ahead)).collect())
    toks = text.split()
    assert places == sorted((i, len(s.split()), s) for s, *_ in gaz for i in range(len(toks)) if toks[i:i + len(s.split())] == s.split())


def py_vote(text, gaz, rel, max_n=4):
    """Voting by pairs of mentions: every other mention's commonness-weighted relatedness."""
    senses = {}
    for s, e, c, lp in gaz:
        senses.setdefault(s, []).append((e, c, lp))
    one = [(s, s, 1.0, 1.0) for s in senses]           # spans do not depend on senses
    spans = [(b, e, s) for b, e, s, _ in py_link(text, one, max_n)]
    out = []
    for k, (b, e, s) in enumerate(spans):
        scored = []
        for ent, c, lp in senses[s]:
            votes = [sum(oc * (1.0 if oe == ent else rel.get((ent, oe), 0.0)) for oe, oc, _ in senses[os])
                     for j, (_, _, os) in enumerate(spans) if j != k]
            vote = round(sum(votes) / len(votes), 9) if votes else 0.0
            scored.append((vote, c, ent, (lp + vote) / 2))
        best = max(scored)
        out.append((b, e, best[2], round(best[3], 8)))
    return out


def test_votes_flip_the_sense(spark):
    """'jaguar' is mostly the car, but among animals it is the cat; alone it stays the car."""
    gaz = [("jaguar", "Car", 0.8, 0.5), ("jaguar", "Cat", 0.2, 0.5), ("lion", "Lion", 1.0, 0.4), ("engine", "Engine", 0.9, 0.3),
           ("engine", "Search_engine", 0.1, 0.3), ("lion king", "Film", 1.0, 0.6)]
    pairs = {("Cat", "Lion"): 0.9, ("Car", "Engine"): 0.8, ("Film", "Lion"): 0.3, ("Car", "Cat"): 0.1}
    rel = {**pairs, **{(b, a): r for (a, b), r in pairs.items()}}
    texts = ["The jaguar and the lion, a Lion!", "jaguar", "Jaguar engine", "a jaguar, lion king, jaguar; engine lion", "", None, "none"]
    gdf = spark.createDataFrame(gaz, "surface string, entity string, commonness double, link_prob double")
    rdf = spark.createDataFrame([(a, b, r) for (a, b), r in rel.items()], "source string, other string, rel double")
    tdf = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, vote string")
    got = {}
    for r in linking.link_entities_voted(tdf, gdf, rdf).collect():
        got.setdefault(int(r.id), []).append((r.begin, r.end, r.entity, round(r.rho, 8)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == (py_vote(t, gaz, rel) if t else []), t
    assert [x[2] for x in sorted(got[0])] == ["Cat", "Lion", "Lion"] and got[1][0][2] == "Car" and sorted(got[2])[0][2] == "Car"
    common = {r.begin: r.entity for r in linking.link_entities(tdf.filter("id = 0"), gdf).collect()}
    assert common[4] == "Car"


def test_link_relatedness(spark):
    links = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A"), (2, "A"), (2, "B"), (3, "C"), (4, "A"), (4, "C")], "page long, entity string")
    got = {(r.source, r.other): r.rel for r in relatedness.link_relatedness(links).collect()}
    # A in 3 of 4 pages, B in 2, both in 2; A and C meet once: 1 - ln(3)/ln(2) < 0
    want = 1 - (math.log(3) - math.log(2)) / (math.log(4) - math.log(2))
    assert set(got) == {("A", "B"), ("B", "A")} and abs(got["A", "B"] - want) < 1e-12


def _wrapped(text, anns):
    """B13 by slices of the whole text."""
    def esc(s):
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out, at = [], 0
    for begin, end, entity in sorted(anns):
        out.append(f"{esc(text[at:begin])}<span class='annotation' entity='{entity}' score='0.5'>{esc(text[begin:end])}</span>")
        at = end
    return "".join(out) + esc(text[at:])


def test_annotated_text_cuts_across_parts(spark):
    n = T.PART_CHARS
    text = "".join("aé<😀&z\n"[k % 7] for k in range(3 * n + 5))
    spans = [[(0, n)], [(n - 1, n + 1), (n + 1, 2 * n), (2 * n, 3 * n + 5)], [(5, 2 * n + 7), (9, 20), (n, n + 3)], [(3 * n, 3 * n + 99)],
             [(4, 4), (3 * n + 5, 3 * n + 5)], [(4 * n + 1, 4 * n + 3)], []]
    rows = [(i, text, [(b, e, f"e{b}", 0.5) for b, e in s]) for i, s in enumerate(spans)]
    rows += [(len(rows), "", [(0, 2, "e0", 0.5)]), (len(rows) + 1, text[:n], [(0, n, "e0", 0.5), (n, n + 2, f"e{n}", 0.5)])]
    df = spark.createDataFrame(rows, "i int, t string, a array<struct<begin:int,end:int,entity:string,rho:double>>")
    got = {r.i: r.body for r in df.select("i", T.annotated_text("t", "a").alias("body")).collect()}
    assert got == {i: _wrapped(t, [x[:3] for x in a]) for i, t, a in rows}


def test_annotated_text_of_a_long_text_takes_no_longer_than_its_pieces(spark):
    def took(texts, size):
        one = F.expr(f"transform(sequence(0, {size - 10}, 10), x -> struct(x + 2 AS begin, x + 6 AS end, 'e' AS entity, 0.5D AS rho))")
        df = spark.range(0, texts, 1, 1).select(T.annotated_text(F.expr(f"repeat('0123456789', {size // 10})"), one).alias("body"))
        times = []
        for _ in range(2):
            start = time.monotonic()
            assert df.agg(F.sum(F.length("body"))).first()[0] > texts * size
            times.append(time.monotonic() - start)
        return min(times)

    assert took(1, 200_000) < 5 * took(50, 4_000) + 2
