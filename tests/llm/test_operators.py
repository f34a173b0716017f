import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from adeptus.llm import archive, bpe, fingerprint, language, licenses, mixing, neardup, quality, search, textblock, toxicity
from adeptus.llm.shared import scratch_path
from .conftest import SCHEMA, row

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# ------------------------------------------------------------------ 1: search
def test_search_is_exact(spark, words):
    rnd = random.Random(1)
    texts = {i: " ".join(rnd.choice(words[:80]) for _ in range(rnd.randint(1, 40))) for i in range(300)}
    texts[50] = texts[51]                              # a tie
    old = search.SHARD_DOCS, search.BLOCK
    search.SHARD_DOCS, search.BLOCK = 64, 8
    try:
        docs = spark.createDataFrame([row(i, t) for i, t in texts.items()], SCHEMA)
        index, idf = search.build_index(docs)
        found = search.search(index, search.query_vectors(docs.filter("doc_id % 20 = 0"), idf, "doc_id", "text"), 5).collect()
    finally:
        search.SHARD_DOCS, search.BLOCK = old
    tf = {i: collections.Counter(t.split()) for i, t in texts.items()}
    size = {i: sum(c.values()) for i, c in tf.items()}
    mean, df = sum(size.values()) / len(tf), collections.Counter(w for c in tf.values() for w in c)
    for q in range(0, 300, 20):
        score = {i: sum(math.log(1 + (300 - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2 / (c[w] + 1.2 * (.25 + .75 * size[i] / mean))
                        for w in tf[q] if w in c) for i, c in tf.items()}
        want = sorted((-round(s, 9), i) for i, s in score.items() if s > 0)[:5]
        have = [(-round(r.score, 9), r.doc_id) for r in sorted(found, key=lambda r: r.rank) if r.query == q]
        assert [i for _, i in have] == [i for _, i in want] and np.allclose([s for s, _ in have], [s for s, _ in want])


def test_search_odd(odd, empty):
    index, idf = search.build_index(odd)
    hits = search.search(index, search.query_vectors(odd.filter("doc_id = 1"), idf, "doc_id", "text"), 10).collect()
    assert [r.doc_id for r in sorted(hits, key=lambda r: r["rank"])][:3] == [1, 1, 2]
    index, idf = search.build_index(empty)
    assert search.search(index, search.query_vectors(empty, idf, "doc_id", "text"), 10).count() == 0


def test_search_many_at_a_time():
    """A shard's frequent terms are scored only in blocks that can still gain; the hits are those of the whole product."""
    rnd = np.random.default_rng(3)
    n, k = 512, 5
    impacts = np.zeros((60, n))
    for d in range(n):                                 # two languages of 25 words, interleaved, and ten rarer words
        own = rnd.choice(25, 12, replace=False) + 25 * (d % 2)
        impacts[own, d] = rnd.uniform(.5, 2, 12)
        impacts[50 + rnd.integers(10), d] = 1.5 * (rnd.random() < .1)
    impacts = impacts[:, search.alike(impacts)]
    term, doc = np.nonzero(impacts)
    first = np.searchsorted(term, np.arange(61))
    frequent = search.frequent_terms(first, n)
    maxima = np.maximum.reduceat(impacts[frequent], np.arange(0, n, 32), axis=1)
    kinds = {"ids": np.arange(n), "no_id": np.zeros(n, bool), "terms": np.arange(60, dtype="<u8"), "first": first.astype("<i4"),
             "docs": doc.astype("<i4"), "impacts": impacts[term, doc], "frequent": frequent.astype("<i4"), "maxima": maxima.astype("<f4")}
    shard = search.Shard({name: v.tobytes() for name, v in kinds.items()}, 32)
    assert 0 < len(frequent) <= 50
    query = np.repeat(np.arange(40), 60)
    weights = rnd.uniform(.2, 1, (40, 60)) * ((np.arange(60) < 25) ^ (np.arange(40) % 2 == 1)[:, None])
    whole = np.round(weights @ impacts, 9)
    bar = np.sort(whole, axis=1)[:, -k]
    for low in (np.zeros(40), bar):                    # no threshold, and one that leaves blocks out
        products = []
        real = shard.single

        class Counted(np.ndarray):
            def __getitem__(self, at):
                products.append(at)
                return np.asarray(real)[at]

        shard.single = real.view(Counted)
        q, d, score = shard.best(query, np.tile(np.arange(60), 40), weights.ravel(), low, k)
        shard.single = real
        for i in range(40):
            want = sorted((-s, j) for j, s in enumerate(whole[i]) if s >= max(bar[i], 1e-9))[:k]
            assert d[q == i].tolist() == [j for _, j in want] and np.allclose(score[q == i], [-s for s, _ in want])
    assert products                                    # with the threshold, block by block


def test_search_blocks_of_queries(spark, words, monkeypatch):
    """Several blocks of queries, tasks of several shards and batches of postings give what one of each gives."""
    rnd = random.Random(5)
    docs = spark.createDataFrame([row(i, " ".join(rnd.choice(words[:300]) for _ in range(rnd.randint(0, 30)))) for i in range(400)], SCHEMA)
    found = []
    for sizes in ((2048, 64, 4096, 512, 1 << 20, 16, .7), (50, 8, 30, 4, 64, 2, .7), (50, 8, 30, 4, 64, 3, 1.1)):
        for name, size in zip(("SHARD_DOCS", "BLOCK", "QUERY_BLOCK", "TOGETHER", "POSTINGS", "TASK_SHARDS", "MOST"), sizes):
            monkeypatch.setattr(search, name, size)
        index, idf = search.build_index(docs)
        rows = search.search(index, search.query_vectors(docs.filter("doc_id % 4 = 0"), idf, "doc_id", "text"), 6).collect()
        found.append({(r.query, r["rank"]): (r.doc_id, round(r.score, 6)) for r in rows})
    assert found[0] and found[0] == found[1] == found[2]


def test_word_count():
    texts = pa.array(["a b", "", "b", "\u00e9!x", None, "c", "!!", " d ", "E", "x" * 10]).slice(1)
    assert search.word_count(texts) == search.terms_of(texts)[3].sum() == 7


# --------------------------------------------------------------------- 2: BPE
def test_bpe_equals_tiktoken(odd, odd_rows, empty):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN, carry=["doc_id", "text"]), RANKS).collect()
    assert len(encoded) == len(odd_rows)
    for r in encoded:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_perfect_hash_and_merge():
    vocabulary = bpe.read_ranks(RANKS)
    table = bpe.PerfectHash(vocabulary[:5000])
    assert (table.find(vocabulary[:5000]) == np.arange(5000)).all() and len(set(table.key_at.tolist())) == 5000


def test_short_matches_merge_together(monkeypatch):
    """A slice's short matches are merged many at a time, as one by one; only long ones go through the heap."""
    vocabulary = bpe.read_ranks(RANKS)
    rank_of = {t: i for i, t in enumerate(vocabulary)}
    draw = random.Random(5)
    tokens = [b"".join(draw.choices(vocabulary, k=draw.randint(1, 6))) for _ in range(3000)]
    tokens += [bytes(draw.choices(b"ethan os", k=draw.randint(1, 60))) for _ in range(3000)] + [b"a" * n for n in range(1, 120)]
    pairs, alone = bpe.Pairs(vocabulary), bpe.merge
    one_by_one = [np.array(alone(t, rank_of), "<u4").tobytes() for t in tokens]
    assert pairs.merge(tokens) == one_by_one
    heaped = []
    monkeypatch.setattr(bpe, "merge", lambda token, ranks: heaped.append(token) or alone(token, ranks))
    encoder = bpe.Encoder(vocabulary, bpe.PerfectHash(vocabulary), pairs, public_tokenizers.PATTERN)
    text = " qzxv thhedin éüß x" + "y" * 100
    assert encoder.encode([text, ""])[0] == b"".join(np.array(alone(m.encode(), rank_of), "<u4").tobytes() for m in encoder.find(text))
    assert heaped == [b" x" + b"y" * 100]


# ------------------------------------------------------------------ 3: mixing
def test_mixing_margins(spark, odd, empty):
    rows = [row(i, "w " * (1 + i % 7), "en" if i % 3 else "de", "a" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    goal = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double")}
    chance = mixing.chances(docs, goal)
    drawn = mixing.draw(docs, chance).select("doc_id", "source", "lang", mixing.tokens(F.col("text")).alias("n"), "__mix.*").collect()
    mass = collections.Counter()
    for r in drawn:
        mass[r[4]] += r.n * r.probability
    assert abs(mass["a"] / (mass["a"] + mass["b"]) - 0.5) < 1e-6
    assert max(r.probability for r in drawn) == pytest.approx(1)
    again = {r.doc_id for r in mixing.sampled(docs.repartition(5), chance).collect()}
    assert again == {r.doc_id for r in drawn if r.kept}
    assert mixing.draw(odd, mixing.chances(odd)).count() == odd.count()
    assert mixing.sampled(empty, mixing.chances(empty)).count() == 0


def test_mixing_budget(spark):
    """A stray source doesn't shrink the sample: it is repeated, and the margins and the token budget hold."""
    rows = [row(i, "w " * 50, "en", "abc"[min(i % 10 // 4, 2)]) for i in range(2000)] + [row(9999, "w", "en", "stray")]
    docs = spark.createDataFrame(rows, SCHEMA)
    chance = mixing.chances(docs, budget=1.0, power=0.8)
    drawn = mixing.draw(docs, chance).select("source", mixing.tokens(F.col("text")).alias("n"), "__mix.probability", "__mix.copies").collect()
    mass = collections.Counter()
    for r in drawn:
        mass[r.source] += r.n * r.probability
        assert r.copies in (math.floor(r.probability), math.floor(r.probability) + 1)
    natural = collections.Counter()
    for r in rows:
        natural[r[3]] += r[1].count("w")
    raised = {s: t ** 0.8 for s, t in natural.items()}
    assert sum(mass.values()) == pytest.approx(sum(natural.values()))
    for s in natural:
        assert mass[s] / sum(mass.values()) == pytest.approx(raised[s] / sum(raised.values()))
    kept = mixing.sampled(docs, chance)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in drawn)
    assert kept.filter("source <> 'stray'").count() > 1900 and kept.filter("source = 'stray'").count() > 1


def test_mixing_rakes_until_margins_fit(spark):
    """Sources that nearly fix the language need more than a few rounds; contradicting targets are reported."""
    counts = {("a", "en"): 6000, ("a", "de"): 100, ("b", "en"): 80, ("b", "de"): 3000}
    cells = spark.createDataFrame([(*k, n) for k, n in counts.items()], "source string, lang string, tokens long")
    goals = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"),
             "lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "lang string, share double")}
    mass = collections.Counter()
    for r in mixing.rake(cells, ["source", "lang"], goals, 400).collect():
        mass[r.source] += r.weight
        mass[r.lang] += r.weight
    assert [mass[k] for k in ("a", "b", "en", "de")] == pytest.approx([0.5, 0.5, 0.6, 0.4], abs=1e-8)
    apart = cells.filter("source = 'a' AND lang = 'en' OR source = 'b' AND lang = 'de'")
    with pytest.warns(UserWarning, match="0.1 off"):
        mixing.rake(apart, ["source", "lang"], goals, 4).collect()


# ----------------------------------------------------------------- 4: archives
def test_archive_round_trip(spark):
    body = "<p>" + "same " * 40
    pages = [(1, "http://a/x y", body), (2, "http://b", body), (3, None, None), (None, "http://c", "short"), (4, "http://d", "short"),
             (5, "http://e", "WARC/1.1\r\n\r\nContent-Length: 3\n" + "é" * 60), (6, "http://f", "z" * 300_000), (2, "http://b", body)]
    df = spark.createDataFrame([p + ("x",) for p in pages], "page_id long, url string, html string, record_id string")
    arc = archive.write_arc(df, scratch_path(spark, "arc"), "page_id", "url", "html")
    seen = archive.read_arc(spark, arc)
    refers = archive.revisits(seen, F.col("key").cast("long"))
    warc = archive.convert(seen, refers, 1, scratch_path(spark, "warc"))
    back = [r for r in archive.read_warc(spark, warc, with_blocks=True).collect() if r.type != "warcinfo"]
    assert len(back) == len(pages) and all(r.digest_ok and r.problem is None for r in back)
    by_type = collections.Counter(r.type for r in back)
    assert by_type == {"response": 6, "revisit": 2}
    first = next(r for r in back if r.key == "1")
    assert all(r.refers_to == first.record_id for r in back if r.type == "revisit")
    payload = {r.key: archive.http_payload(r.block)[1].decode() for r in back if r.type == "response"}
    assert payload["5"] == pages[5][2] and payload["6"] == pages[6][2] and payload["3"] == ""


def test_archive_damage():
    arc = (b"filedesc://x.arc 0.0.0.0 20080101000000 text/plain 14\n1 0 example\nU\n\nnot a header\n"
           b"http://a 1.2.3.4 20080101000000 text/html 3\nabc\n\nhttp://b 1.2.3.4 20080101000000 text/html 99\nshort")
    rows = list(archive.parse_arc(io.BytesIO(arc)))
    assert [bool(r["problem"]) for r in rows] == [True, False, True] and rows[1]["block"] == b"abc"
    warc = b"junk\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [r["block"] for r in archive.parse_warc(io.BytesIO(warc))] == [None, b"hi"]
    assert list(archive.parse_arc(io.BytesIO(b""))) == []


# ------------------------------------------------------------- 5, 7: classifiers
def labelled(spark, words, mark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [rnd.choice(words) for _ in range(40)]
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), mark())
        rows.append(row(i, ". ".join(" ".join(w[k:k + 10]) for k in range(0, len(w), 10))))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, None), (5000, None, None)],
                                                                      "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, words, odd, empty):
    docs, labels = labelled(spark, words, lambda: "@@@")
    learn = F.crc32(F.col("k").cast("string")) % 3 != 1
    model = quality.fit(quality.labelled_sample(docs, labels, "quality", learn, 1000))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 5 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(empty, model).count() == 0
    blank = quality.fit(quality.labelled_sample(empty, labels.limit(0), "quality", learn, 10))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}


def test_quality_equals_plain_regression():
    """Training and scores equal follow-the-regularised-leader on dictionaries of words and pairs of words."""
    rnd = random.Random(41)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(15)]
    texts, labels = [], []
    for i in range(60):
        good = i % 3 > 0
        texts.append([rnd.choice(vocabulary[:10] if good else vocabulary[5:]) for _ in range(rnd.randint(1, 25))])
        labels.append(float(good))

    def values(t):
        count = collections.Counter(t) + collections.Counter("same" if a == b else (a, b) for a, b in zip(t, t[1:]))
        norm = math.sqrt(sum(count.values()))
        return {f: math.sqrt(c) / norm for f, c in count.items()}

    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    z, n = collections.Counter(), collections.Counter()

    def weight(f):
        least = 0.0 if f is None else l1                    # the intercept isn't shrunk
        if abs(z[f]) <= least:
            return 0.0
        return -(z[f] - math.copysign(least, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items()) - weight(None)))

    rows = [values(t) for t in texts]
    for _ in range(4):
        for x, y in zip(rows, labels):
            off = chance(x) - y
            for f, v in [*x.items(), (None, 1.0)]:
                g, w = off * v, weight(f)
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w
                n[f] += g * g
    column = pa.array([" ".join(t) for t in texts])
    model = quality.train(column, np.array(labels), quality.BITS, steps=4 * len(texts))
    found = quality.scores(model, *textblock.column_bytes(column), quality.BITS)
    assert np.abs(found - [chance(x) for x in rows]).max() < 1e-6 and found.std() > 0.1


def test_toxicity_held_out(spark, words, odd, empty):
    docs, labels = labelled(spark, words, lambda: "bmupzkk")
    learn = F.crc32(F.col("k").cast("string")) % 5 != 0
    model = toxicity.fit(quality.labelled_sample(docs, labels, "toxic", learn, 400, by_label=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    texts = ["such bmu-pzkk here", "such bmuxpzkk here", "such b m u p z k k here", "such stone here"]
    probe = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    p = [r.score for r in toxicity.score(probe, model).orderBy("doc_id").collect()]
    assert min(p[:3]) > 0.5 > p[3]
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(quality.labelled_sample(empty, labels.limit(0), "toxic", learn, 10, by_label=True))
    assert max(r.score for r in toxicity.score(docs, none).collect()) < 1e-9


def probabilities(model, texts):
    raw = "".join(texts).encode()
    return toxicity.scores(model, np.cumsum([0] + [len(t.encode()) for t in texts]), np.frombuffer(raw, np.uint8))


def mixed_texts(words, marks, n=400):
    rnd = random.Random(12)
    texts, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 4 == 0:
            w.insert(rnd.randrange(30), marks[i // 4 % len(marks)])
        texts.append(". ".join(" ".join(w[k:k + 10]) for k in range(0, len(w), 10)))
        labels.append(int(i % 4 == 0))
    return pa.array(texts), np.array(labels)


def test_split_and_spelled_out_insults(words):
    """Insults in two pieces, spelled out with letters of several bytes, or within a spelled-out sentence."""
    model = toxicity.train(*mixed_texts(words, ["bmupzkk", "imbécile", "дурачина"]))
    bad = ["such bmu pzkk here", "such i m b é c i l e here", "such д у р а ч и н а here", "such " + " ".join("stonebmupzkkareston") + " here"]
    p = probabilities(model, [*bad, "such stone here", "such " + " ".join("stonearestonarestone")])
    assert min(p[:4]) > 0.5 > max(p[4:]), p


def test_characters_of_all_scripts(words):
    """Case, marks and scripts: codes are by character, and an insult in capitals or with a gap is the insult."""
    def code(text):
        return toxicity._codes(toxicity.LOWER[np.frombuffer(text.encode(), np.uint8)]).tolist()
    assert code("ДУРАЧИНА") == code("дурачина") and code("а") != code("ж") and code("ÉÈ") == code("ee") == code("Ee")
    alphabet = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    assert len({c for x in alphabet for c in code(x)}) >= 25
    mixed = "aé文ж😀9"
    assert len(code(mixed)) == len(mixed) and all(1 <= c < toxicity.BORDER for c in code(mixed))
    assert code(mixed) == [c for x in mixed for c in code(x)]                 # a character's code doesn't depend on its neighbours
    model = toxicity.train(*mixed_texts(words, ["imbécile", "дурачина"]))
    bad = ["such ДУРАЧИНА here", "such Imbecile here", "such дура-чина here", "such дуржачина here", "such IMBÉCILE here"]
    p = probabilities(model, [*bad, "such хороший here", "such stone here", "文字 文字"])
    assert min(p[:5]) > 0.5 > max(p[5:]), p


def test_every_toxic_document_trains(words):
    """Insults of ordinary words, and insults that only two documents of the sample have, are learnt."""
    clean = {w for w in words}
    phrase = f"{words[7]} {words[11]}"
    assert set(phrase.split()) <= clean
    p = probabilities(toxicity.train(*mixed_texts(words, [phrase])), [f"such {phrase} here", words[7], words[11], "such stone here"])
    assert p[0] > 0.5 > max(p[1:]), p
    rnd = random.Random(13)
    rare = ["".join(rnd.choice("bcdfghkmpqvwxz") for _ in range(7)) for _ in range(50)]
    p = probabilities(toxicity.train(*mixed_texts(words, rare)), [f"such {w} here" for w in rare] + ["such stone here"])
    assert (p[:50] > 0.5).all() and p[50] < 0.5, p


def test_folded_weights_equal_the_kernel():
    """The folded machine's value is the weighted sum of kernels with the landmarks."""
    def kernel(s, t):
        def feats(x):
            out = collections.Counter()
            for a, b in toxicity.STEPS:
                for i in range(len(x) - a - b):
                    out[x[i], x[i + a], x[i + a + b]] += toxicity.DECAY ** (a + b + 1)
            return out
        f, g = feats(s), feats(t)
        norm = toxicity._norms(50)
        return sum(f[k] * g[k] for k in f) / norm[len(s)] / norm[len(t)]

    code = lambda s: bytes([63] + [int(toxicity.CODE[c]) for c in s.encode()] + [63])
    marks, probe = [code("idiot"), code("stone")], code("idxiot")
    weights = np.zeros(64 ** 3)
    norm = toxicity._norms(50)
    for mark, alpha in zip(marks, (2.0, -1.0)):
        for a, b in toxicity.STEPS:
            for i in range(len(mark) - a - b):
                weights[mark[i] * 4096 + mark[i + a] * 64 + mark[i + a + b]] += alpha * toxicity.DECAY ** (a + b + 1) / norm[len(mark)]
    got = toxicity.segment_values(*toxicity._joined([probe]), weights)[0]
    assert got == pytest.approx(2 * kernel(probe, marks[0]) - kernel(probe, marks[1]))


# ----------------------------------------------------------------- 6: licenses
def test_licenses(spark, odd, empty):
    texts = ["Released under the MIT License. mit  license", "Licensd under the Apach License, Version 2.0", "GENERAL public license",
             "mit. license", "mitlicense", None, "all rights reserve"]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        w = words_of(t)
        places = [k for p in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        base = sorted({label for p, label in licenses.PHRASES.items() if any(w[k:k + len(p.split())] == p.split() for k in range(len(w)))})
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert (got[i].first_word, got[i].last_word) == ((min(places), max(places)) if places else (None, None))
        assert got[i].base_labels == ",".join(base)
    assert got[1].labels == "apache" and got[1].spans[0].edits == 2 and got[6].labels == "reserved"
    assert got[0].labels == "mit" and got[0].n_base == 2 and got[5].labels == ""
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_license_score_is_of_the_notice_matched(spark):
    """Two edits of 45 characters, whatever shorter notices the label has; labels of the longer list."""
    text = "permision is hereby granted, free of chrge"
    notice = "permission is hereby granted, free of charge"
    texts = [text, "MIT license. " + text, "this is free and unencumbred software released into the public domain", "", None]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got[0].score == pytest.approx(1 - 2 / len(notice)) and got[0].spans[0].edits == 2 and got[1].score == 1.0
    assert got[2].labels == "unlicense" and got[2].score == pytest.approx(1 - 1 / 70)
    assert [got[i].score for i in (3, 4)] == [0.0, 0.0] and got[4].spans == []
    for notice, label, edits in licenses.NOTICES:
        assert min(len(p) for _, p in licenses.split_notice(notice, edits)) >= 6
        assert (label, 0, len(notice), 0) in licenses.Scanner(licenses.NOTICES).spans(notice)


def test_licenses_equal_matching_everywhere(words):
    """Every label that a match of the whole text finds, without seeds and windows, is found, and no other."""
    rnd = random.Random(21)
    scanner = licenses.Scanner(licenses.NOTICES)
    whole = [(licenses.notice_pattern(n, k), label) for n, label, k in licenses.NOTICES]
    for _ in range(60):
        parts = []
        for notice, _, edits in rnd.sample(licenses.NOTICES, 2):
            chars = list(notice)
            for _ in range(rnd.randint(0, edits + 1)):
                at = rnd.randrange(len(chars))
                chars[at:at + rnd.randint(0, 1)] = rnd.choice(["", "x", " "])
            parts += [rnd.choice(words), "".join(chars)]
        text = rnd.choice([" ", "\n  "]).join(parts)
        flat = licenses.folded(text)[0]
        assert {s[0] for s in scanner.spans(text)} == {label for p, label in whole if p.search(flat)}, text


def test_wrapped_notices():
    """White space of any length is a space at no cost, spans are the text's, and every place counts."""
    scanner = licenses.Scanner(licenses.NOTICES)
    for text in ("all\nrights\nreserved", "x  all rights\n         reserved.", "all\r\n\t rights \u00a0 reserved"):
        (label, start, end, edits), = scanner.spans(text)
        assert (label, edits, text[start:end].split()) == ("reserved", 0, ["all", "rights", "reserved"])
    wrapped = "gnu\n   lesser\n   generl\n   public\n   license"
    assert scanner.spans(wrapped) == [("lgpl", 0, len(wrapped), 1)]
    notice = "licensed under cc\n    by-nc 4.0"
    assert scanner.spans("\n\n" + notice) == [("cc-by-nc", 2, 2 + len(notice), 0)]
    near = "all rights reservd all rights reserved all  rights reserved"
    assert [(near[a:b], e) for _, a, b, e in scanner.spans(near)] == [
        ("all rights reservd", 1), ("all rights reserved", 0), ("all  rights reserved", 0)]


# ----------------------------------------------------------------- 8: language
def test_language(spark, odd, empty):
    rnd = random.Random(4)
    parts = {"aa": ["ka", "to", "mi", "su"], "bb": ["ber", "gen", "sch", "eit"]}
    rows = [row(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang)
            for i, lang in enumerate(["aa", "bb", "bb"] * 60)]
    docs = spark.createDataFrame(rows + [row(999, None, "aa"), row(998, "123 !", "aa")], SCHEMA)
    model = language.fit(language.training_rows(docs, F.crc32(F.col("k").cast("string")) % 4 != 2, 50))
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows) and got[999] == got[998] == "und"
    assert language.identify(odd, model).count() == odd.count() and language.identify(empty, model).count() == 0
    none = language.fit(language.training_rows(empty, F.lit(True), 5))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_language_equals_plain_sets(spark):
    """Predictions equal counting each text's n-grams in exact sets, one for each language."""
    rnd = random.Random(21)
    parts = {"aa": ["ka", "to", "mi", "su"], "bb": ["to", "mi", "na", "re"], "cc": ["na", "re", "ka", "lo"]}
    rows = [row(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(2)) for _ in range(rnd.randint(1, 12))) + ".", lang)
            for i, lang in enumerate(sorted(parts) * 60)]

    def ngrams(text):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        found = [padded[k:k + language.GRAM] for k in range(len(padded) - language.GRAM + 1)]
        return [g for g in found if " " not in g[1:-1]]

    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(language.training_rows(docs, F.crc32(F.col("k").cast("string")) % 4 != 2, 50))
    learnt = {lang: [r for r in rows if r[2] == lang and zlib.crc32(str(r[0]).encode()) % 4 != 2] for lang in parts}
    assert all(0 < len(r) <= 50 for r in learnt.values()) and set(model.languages) == set(parts)
    kept = {}
    for lang, texts in learnt.items():
        seen = collections.Counter(g for r in texts for g in set(ngrams(r[1])))
        kept[lang] = {g for g, n in seen.items() if n >= max(1, language.LEAST_SHARE * len(texts))}
    for r in language.identify(docs, model).collect():
        hits = {lang: sum(g in kept[lang] for g in ngrams(rows[r.doc_id][1])) for lang in parts}
        first, second = sorted(hits.values(), reverse=True)[:2]
        assert hits[r.lang_pred] == first
        assert abs(r.score - ((first - second) / first if first else 0.0)) < 0.01


def test_more_languages_than_a_mask(spark):
    """All of 70 languages are learnt and told apart."""
    rnd = random.Random(11)
    parts = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(5)] for k in range(70)}
    rows = [row(len(parts) * c + k, " ".join(rnd.choice(w) for _ in range(20)), lang)
            for c in range(6) for k, (lang, w) in enumerate(parts.items())]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(language.training_rows(docs, F.lit(True), 50))
    assert len(model.languages) == 70 and model.table.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_borders_of_a_text():
    """A text's first and last n-grams touch its ends, also in texts shorter than an n-gram, and none spans two texts."""
    def hashes(*texts):
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        h, first = language.grams(offsets, np.frombuffer("".join(texts).encode(), np.uint8), 0, len(texts))
        return [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]

    alone = hashes("De.", "word", "a", "", "Re")
    assert [len(h) for h in alone] == [1, 3, 0, 0, 1]
    assert alone[1] == hashes(". word, ")[0] and alone[0] == hashes("de")[0]


# -------------------------------------------------------------- 9: fingerprints
def test_fingerprints(spark, words, odd, empty):
    rnd = random.Random(3)
    ids = rnd.sample(range(-5000, 300_000), 80)        # several buckets, with gaps
    texts = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for i in ids}
    texts[ids[1]] = texts[ids[0]]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(spark.createDataFrame([row(i, t) for i, t in texts.items()], SCHEMA)).collect()}
    down = sorted(ids, reverse=True)
    shingles = lambda t: (lambda w: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})(t.split())
    errors = []
    for i, nxt in zip(down, down[1:] + down[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[:len(t) - half] + texts[nxt][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = shingles(t), shingles(edited)
        errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12
    assert got[ids[0]].fingerprint == got[ids[1]].fingerprint and len(got[ids[0]].fingerprint) == fingerprint.BINS
    assert fingerprint.edited_pairs(odd).count() == odd.count() and fingerprint.edited_pairs(empty).count() == 0
    alone = fingerprint.edited_pairs(spark.createDataFrame([row(1, "a b c d")], SCHEMA)).first()
    assert alone.near_next == 1.0


# ---------------------------------------------------------------- 10: near-dedup
def test_near_duplicates_equal_all_pairs(spark, words):
    """Classes are the components of the pairs whose weighted Jaccard similarity, computed for all pairs, is 0.8 or more."""
    rnd = random.Random(31)
    texts = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 250))]
        for _ in range(6):
            v = list(base)
            for k in rnd.sample(range(len(v)), rnd.randint(0, 1 + len(v) // 30)):
                v[k] = rnd.choice(words)
            texts.append(v)
    df = collections.Counter(w for t in texts for w in set(t))
    n = len(texts)
    idf = {w: 1 + math.log1p(n / d) / math.log1p(n) for w, d in df.items()}
    bags = []
    for t in texts:
        count = collections.Counter(tuple(t[k:k + 5]) for k in range(len(t) - 4))
        bags.append({s: (1 + math.log(c)) * sum(idf[w] for w in s) / 5 for s, c in count.items()})

    def alike(a, b):
        low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        return low / (sum(a.values()) + sum(b.values()) - low)

    sims = {(i, j): alike(bags[i], bags[j]) for i in range(n) for j in range(i)}
    near = neardup.THRESHOLD

    def classes(least):
        root = list(range(n))
        for _ in range(n):
            before = list(root)
            for (i, j), x in sims.items():
                if x >= least:
                    root[i] = root[j] = min(root[i], root[j])
            if root == before:
                return root

    assert sum(0.5 < x < near for x in sims.values()) > 30 and sum(x >= near for x in sims.values()) > 30
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(
        spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)).collect()}
    strict, loose = classes(near + 1e-3), classes(near - 1e-3)     # weights of hashed words are rounded
    assert all(got[i] == got[j] for (i, j), x in sims.items() if x >= near + 0.02)
    assert all(loose[i] == loose[got[i]] for i in range(n))
    assert sum(got[i] == strict[i] for i in range(n)) >= 0.98 * n


def test_near_duplicates(spark, words, odd, empty):
    rnd = random.Random(8)
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(60)]
    rows, group = [], {}
    for g, w in enumerate(base):
        for c in range(6):
            v = list(w)
            for k in rnd.sample(range(200), c % 3):      # up to two words changed
                v[k] = rnd.choice(words) + "q"
            group[len(rows)] = g
            rows.append(row(len(rows), " ".join(v)))
    old = neardup.BLOCK
    neardup.BLOCK = 3                                   # units of several blocks
    try:
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        neardup.BLOCK = old
    assert len(got) == len(rows) and all(got[i] == 6 * g for i, g in group.items())
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(odd).collect() if r.doc_id is not None}
    assert classes[1] == classes[2] == 1 and classes[3] == classes[4] == 3 and classes[5] == 5
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7, 8, 9, 10] and len(ids) == len(set(ids))


def test_components(spark):
    chain = [(bytes([0, k]), bytes([0, k + 1])) for k in range(100)] + [(b"\x05", b"\x07"), (b"\x06", b"\x05")]
    got = {bytes(r.entry): bytes(r.root) for r in neardup.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert all(got[bytes([0, k])] == bytes([0, 0]) for k in range(1, 101)) and got[b"\x06"] == got[b"\x07"] == b"\x05"
