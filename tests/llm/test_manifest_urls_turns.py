"""Operators 11 to 13 against plain versions of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adeptus.llm import merkle, oracle, queries, turns, urls
from .conftest import SCHEMA, row


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key_of(x):
    return (x is not None, x if x is not None else 0)


# ------------------------------------------------------------ 11: manifest
def test_addresses():
    """A block's places are a permutation; every lower part is one run; the upper part comes first."""
    for levels in range(1, 6):
        at = merkle.addresses(levels)
        assert sorted(np.concatenate(at).tolist()) == list(range(merkle.nodes_of(levels)))
        if levels > 1:
            upper = levels // 2
            assert max(a.max() for a in at[:upper]) == merkle.nodes_of(upper) - 1
            size = merkle.nodes_of(levels - upper)
            for j in range(8 ** upper):
                part = np.concatenate([at[upper + d][j * 8 ** d:(j + 1) * 8 ** d] for d in range(levels - upper)])
                assert part.max() - part.min() == size - 1 and part.min() == merkle.nodes_of(upper) + j * size


def plain_manifest(rows):
    """doc order list of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def climb(nodes):
        """(root, siblings by leaf): siblings are (before, after) by level."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf, i in enumerate(where):
                first = i - i % 8
                paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + 8])))
            where = [i // 8 for i in where]
            nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        head = part(doc_id) + part(source) + part(lang) + part(n_chars)
        low = None if text is None else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups[lang].append((doc_id, sha(head + part(text)), sha(head + part(low if bad else text))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in names:
        groups[lang].sort(key=lambda r: (key_of(r[0]), r[1]))
    trees = {lang: climb([r[1] for r in groups[lang]]) for lang in names}
    root, above = climb([trees[lang][0] for lang in names])
    out = []
    for i, lang in enumerate(names):
        subroot, paths = trees[lang]
        for (doc_id, leaf, own), path in zip(groups[lang], paths):
            path = path + above[i]
            for before, after in path:
                own = sha(before + own + after)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in path)), own, own == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = queries.op11_merkle_manifest(spark, f"{tmp_path}/{name}").collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, tmp_path, odd_rows, monkeypatch, height):
    """Small blocks take the recursion over block roots; languages of 1 to 600 rows, more than one run of them."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SIZE", 8 ** height)
    rnd = random.Random(3)
    rows = [row(i, f"Text {i} AbC", rnd.choice(["en"] * 20 + ["de", "fr", None, "", "é"])) for i in range(700)]
    rows += odd_rows + [row(5000 + i, "x", f"l{i}") for i in range(12)] + [row(7, "twice", "en"), row(7, "Twice", "en")]
    assert manifest_rows(spark, rows, tmp_path, "d") == plain_manifest(rows)


def test_manifest_small(spark, tmp_path):
    assert manifest_rows(spark, [], tmp_path, "none") == []
    one = [row(3, None, None)]
    assert manifest_rows(spark, one, tmp_path, "one") == plain_manifest(one)


def test_manifest_sql(spark, tmp_path, odd_rows):
    rows = [row(i, f"Text {i}", "en" if i % 3 else "de") for i in range(100)] + [r for r in odd_rows if "\0" not in (r[1] or "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(oracle.ORACLE["op11_merkle_manifest"]).fetchall(), key=repr) == plain_manifest(rows)


# ---------------------------------------------------------------- 12: URLs
ODD_URLS = [None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "http://a.net/x", "http://anet/x",
            "http://Example.NET/en/1", "http://www.example.net/EN/1", "http://example.com/de/?a=1&b=2&&c", "http://example.com",
            "https://x.org/fr/#f", "https://x.org/en/#f", "http://a.b/c://d.net/", "http://ünï.org/é?ß", "http://x.org?y/fr/",
            "http://x\n.net/\n", "http://y.net/" + "é1" * 30_000, "http://z.net//", "http://z.net//"]


def url_table(spark, urls_, path):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls_)], "page_id long, url string, host string, label int")
    df.write.parquet(f"{path}/pages.parquet")
    return f"{path}"


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def plain_features(rows):
    """rows of (url, host, path, label) -> lists of integers."""
    ends = collections.defaultdict(lambda: [0, 0, 0])
    for _, host, _, label in rows:
        e = ends[host.split(".")[-1]]
        e[0] += 1
        e[1] += label is not None
        e[2] += label or 0
    out = []
    for url, host, path, _ in rows:
        u = url or ""
        n = len(u)
        bits = math.log2(n) - sum(k * math.log2(k) for k in collections.Counter(u).values()) / n if n else 0.0
        query = re.search(r"\?([^#]*)", u)
        every, known, bad = ends[host.split(".")[-1]]
        out.append([min(n // 2, 127), min(len(host), 63), min(len(path), 127), min(path.count("/"), 31), min(host.count("."), 15),
                    sum(c in "0123456789" for c in u) * 16 // max(n, 1), math.floor(round(bits * 8, 6)),
                    min(len(re.findall("[^&]+", query[1])) if query else 0, 15), (bad * 2 + 1) * 8 // (known + 1), len(str(every))])
    return out


def plain_margins(x, labels):
    """Boosting row by row: symmetric trees, greedy splits over every threshold."""
    x = np.array(x)
    known = [i for i, y in enumerate(labels) if y is not None]
    y = np.array([labels[i] for i in known])
    margin = np.full(len(x), urls.prior_of(len(y), int(y.sum())))
    if not 0 < y.sum() < len(y):
        return margin
    for _ in range(urls.ROUNDS):
        p = 1 / (1 + np.exp(-margin / 1e6))
        g = [int(labels[i] * 65536 - math.floor(p[i] * 65536 + .5)) for i in known]
        h = [math.floor(p[i] * (1 - p[i]) * 65536 + .5) for i in known]
        node = np.zeros(len(x), int)
        for level in range(urls.DEPTH):
            best = None
            for f in range(x.shape[1]):
                for t in sorted(set(x[known, f])):
                    sums = collections.defaultdict(lambda: [0, 0, 0, 0])
                    for j, i in enumerate(known):
                        s = sums[node[i]]
                        k = 0 if x[i, f] <= t else 2
                        s[k] += g[j]
                        s[k + 1] += h[j]
                    def part(a, b):
                        return float(a) ** 2 / (b + 4 * 65536.0)
                    gain = sum(math.floor(part(a, b) + part(c, d) - part(a + c, b + d)) for a, b, c, d in sums.values())
                    if best is None or gain > best[0]:
                        best = (gain, f, t)
            node += (x[:, best[1]] > best[2]) * (1 << level)
        for n in set(node[known]):
            gs, hs = (sum(v[j] for j, i in enumerate(known) if node[i] == n) for v in (g, h))
            margin[node == n] += math.floor(gs * 300_000.0 / (hs + 4 * 65536.0) + .5)
    return margin


def test_urls(spark, tmp_path):
    rnd = random.Random(4)
    made = [f"http{rnd.choice('s ').strip()}://{rnd.choice(['a', 'www.b', 'm.spam-farm'])}.example.{rnd.choice(['com', 'net', 'org', 'io'])}"
            f"/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randint(1, 9999)}{rnd.choice(['', '?a=1', '?a=1&b=2', '#top'])}" for _ in range(120)]
    every = ODD_URLS + made
    at = url_table(spark, every, tmp_path)
    found = {r.page_id: r for r in queries.op12_url_filter(spark, at).collect()}
    rows = []
    for u in every:
        host, path = plain_split(u)
        verdict = plain_rule(host, path)[1]
        rows.append((u, host, path, None if verdict is None else int(verdict == "block")))
    margins = plain_margins(plain_features(rows), [r[3] for r in rows])
    for i, (u, host, path, label) in enumerate(rows):
        rule, verdict = plain_rule(host, path)
        want = (host, path, rule, verdict or ("block" if margins[i] > 0 else "allow"))
        assert tuple(found[i][c] for c in ("host", "path", "rule", "verdict")) == want, u
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-margins[i] / 1e6)), abs=6e-5)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet/*.parquet')")
    sql = con.execute(oracle.ORACLE["op12_url_filter"]).fetchall()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in found.values())


def test_urls_without_labels(spark, tmp_path):
    at = url_table(spark, ["http://x.io/1", None], tmp_path / "a")
    assert [r.verdict for r in queries.op12_url_filter(spark, at).collect()] == ["allow", "allow"]
    at = url_table(spark, ["http://x.net/1", "http://y.net/2", "http://z.io/"], tmp_path / "b")   # one kind only
    assert [r.verdict for r in queries.op12_url_filter(spark, at).collect()] == ["block"] * 3
    assert queries.op12_url_filter(spark, url_table(spark, [], tmp_path / "c")).count() == 0


# -------------------------------------------------------- 13: conversations
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_audit(code):
    """Every edit script, cheapest first, then least."""
    best = (4 * len(code), "D" * len(code))

    def go(i, out, cost, audit):
        nonlocal best
        if cost > best[0] or len(out) > len(code) + 3:
            return
        if i == len(code) and GRAMMAR.fullmatch(out):
            best = min(best, (cost, audit))
        if i < len(code):
            more, role = 3 * code[i].isupper(), code[i].lower()
            go(i + 1, out, cost + 4, audit + "D")
            if role != "x":
                if role != "o":
                    go(i + 1, out + role, cost + more, audit + "K")
                for r in "ua":
                    go(i + 1, out + r, cost + 3 + more, audit + "R")
        for r in "ua":
            go(i, out + r, cost + 3, audit + "I")

    go(0, "", 0, "")
    return best


def test_alignment():
    rnd = random.Random(1)
    for _ in range(300):
        code = "".join(rnd.choice("suaUAxoSuauaua") for _ in range(rnd.randint(0, 5)))
        assert turns.align(code, "", "end")["end"] == plain_audit(code), code


def test_chunks_fold_to_the_whole():
    rnd = random.Random(2)
    for _ in range(80):
        code = "".join(rnd.choice("suaUAxo" + "ua" * 8) for _ in range(rnd.randint(1, 30)))
        size, fold, aligner = rnd.randint(1, 9), turns.Fold(), turns.Aligner()
        for lo in range(0, len(code), size):
            fold.add(aligner.table(code[lo:lo + size]))
        assert fold.result() == turns.align(code, "", "end")["end"], code


def plain_repair(rows):
    """Reports of damaged ``rows`` (conv_id, turn, role, text), from the definitions."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (key_of(r[0]), r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        counts, code, seen = collections.Counter(), "", set()
        for _, role, text in found:
            body = re.sub("[\x20\x09-\x0D]", "", text)
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            code += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        initials = [r[1][:1] for r in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [r[0] for r in found if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = turns.align(code, "", "end")["end"] if len(code) > 6 else plain_audit(code)
        lines, i, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else found[i][1:]
            i += e != "I"
            if e != "D":
                role = ("assistant" if last == "u" else "user") if e in "IR" else role
                last = role[:1]
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


CONV = "conv_id long, turn long, role string, text string"


def conversations(spark, rows, path, parts=6):
    spark.createDataFrame(rows, CONV).withColumn("audit", F.lit("clash")).repartition(parts).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def made_rows(n, rnd):
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, 8)):
            role = ["user", "assistant"][turn % 2] if rnd.random() < .85 else rnd.choice(["system", "tool", "", None, "user"])
            rows.append((conv, None if rnd.random() < .05 else turn + 3 * (rnd.random() < .1), role,
                         rnd.choice(["Yes.", "No!", "half", "", None, " \t", f"Answer {rnd.random()}."])))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (10 ** 9, None, None, None)] + rows[:5]


@pytest.mark.parametrize("hold", [2048, 3])
def test_conversations(spark, tmp_path, monkeypatch, hold):
    """A small ``HOLD`` sends most conversations the way of those that reach over ranges."""
    monkeypatch.setattr(turns, "HOLD", hold)
    monkeypatch.setattr(turns, "CHUNK", 32 if hold > 3 else 2)
    rnd = random.Random(9)
    rows = made_rows(150, rnd) + [(777, i, "uasu"[i * 7 % 4] + "x", f"line {i % 190}.") for i in range(400)]     # a large one
    found = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, conversations(spark, rows, tmp_path)).collect()}
    want = plain_repair(rows)
    assert found == want


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Me."), (1, 3, "assistant", "Yes."), (2, 1, "assistant", "So."), (3, 1, "user", "")]
    df = spark.createDataFrame(rows, CONV)
    audits = turns.repair(df)
    got = sorted((r.conv_id, r.place, r.role, r.text, r.edit) for r in turns.repaired_turns(df, audits).collect())
    assert got == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "Me.", "K"), (1, 3, "assistant", "Yes.", "K"),
                   (2, 0, "user", "", "I"), (2, 1, "assistant", "So.", "K")]


def test_conversations_empty(spark, tmp_path):
    assert queries.op13_conversation_repair(spark, conversations(spark, [], tmp_path / "a")).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    found = queries.op13_conversation_repair(spark, conversations(spark, [(gone, 1, "user", "x")], tmp_path / "b")).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_damage_of_every_kind(spark):
    """One row of each remainder 0 to 5, by the contract's table: the fifth kind sets the role, of null and "user" too."""
    kind_of = {zlib.crc32(f"{i}:1".encode()) % 20: i for i in range(2000, 0, -1)}
    role = {0: "system", 1: "assistant", 2: "system", 3: "assistant", 4: "assistant", 5: "assistant"}
    rows = [(kind_of[k], 1, role[k], "A. b! c? d") for k in role]
    null = next(i for i in range(1, 5000) if zlib.crc32(f"{i}: ".encode()) % 20 == 4)
    rows.append((null, None, None, None))
    got = collections.Counter((r.conv_id, r.turn, r.role, r.text, r.dropped)
                              for r in turns.damaged(spark.createDataFrame(rows, CONV)).collect())
    text = "A. b! c? d"
    want = {(kind_of[0], 1, "system", "", True): 1, (kind_of[1], 1, "assistant", "", False): 1,
            (kind_of[2], 1, "system", "A b c d", False): 1, (kind_of[3], 1, "assistant", text, False): 2,
            (kind_of[4], 1, "user", text, False): 1, (kind_of[5], 1, "assistant", text, False): 1,
            (null, None, "user", " ", False): 1}
    assert got == want
