"""DuckDB SQL of the registered queries of :mod:`adeptus.llm.queries`.

Missing are the operators that SQL can't express; tests/llm checks those
against a brute-force version, an exact round trip or held-out accuracy.
"""

from adeptus.llm import mixing, urls


def _topic_sql(text: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{m}')" for m in marks) + f" THEN '{name}'"
        for name, marks in mixing.TOPICS)
    return f"CASE {cases} ELSE 'prose' END"


def mixing_ctes(docs: str, seed: str = "mix") -> str:
    """CTEs that end in ``drawn``: the rows of :func:`adeptus.llm.mixing.draw` over the table ``docs``."""
    dims = ["source", "lang", "topic"]
    parts = [f"""mrows AS MATERIALIZED (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
        {_topic_sql("lower(coalesce(text, ''))")} AS topic,
        CAST(coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS BIGINT) AS n_tokens,
        CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) AS DOUBLE)
          / 4294967296.0 AS u FROM {docs})""",
             """mcells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM mrows
        GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for d in dims:
        parts.append(f"""goal_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS g_{d} FROM (
            SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {mixing.POWER}) AS p FROM mcells GROUP BY {d}))""")
    parts.append("""w0 AS MATERIALIZED (SELECT mcells.*, g_source, g_lang, g_topic, CAST(tokens AS DOUBLE) AS weight
        FROM mcells JOIN goal_source USING (source) JOIN goal_lang USING (lang) JOIN goal_topic USING (topic))""")
    step = 0
    for _ in range(mixing.ROUNDS):
        for d in dims:
            parts.append(f"""w{step + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight),
                weight * g_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM w{step})""")
            step += 1
    parts.append(f"""chance AS MATERIALIZED (SELECT source, lang, topic, (weight / tokens) * (sum(tokens) OVER () * {mixing.BUDGET} / sum(weight) OVER ())
        AS probability FROM w{step})""")
    parts.append("""drawn AS MATERIALIZED (SELECT doc_id, source, lang, topic, n_tokens,
        floor(coalesce(probability, 1.0) * 1e6 + 0.5) / 1e6 AS probability, copies > 0 AS kept, copies
        FROM (SELECT *, CAST(floor(coalesce(probability, 1.0)) AS INTEGER)
            + CAST(u < coalesce(probability, 1.0) - floor(coalesce(probability, 1.0)) AS INTEGER) AS copies
            FROM mrows LEFT JOIN chance USING (source, lang, topic)))""")
    return ",\n".join(parts)


def _tree_ctes(name: str, group: str, leaves: str, levels: int) -> list[str]:
    """CTEs ``{name}0``.. of (grp, idx, h, n) by level and ``{name}s0``.. of the siblings in each node's run."""
    parts = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(levels):
        run = "PARTITION BY grp, idx // 8 ORDER BY idx"
        parts.append(f"""{name}s{k} AS MATERIALIZED (SELECT grp, idx, n > 1 AS more,
            coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
            FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT grp, idx // 8 AS idx,
            CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE min(h) END AS h, (n + 7) // 8 AS n
            FROM {name}{k} GROUP BY grp, idx // 8, n)""")
    return parts


def merkle_sql(levels: int = 9, crown: int = 5) -> str:
    """For at most 8**levels documents of a language and 8**crown languages."""
    def part(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    columns = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of the id's digits, bit by bit (polynomial 0xEDB88320)
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, lang, sha256({columns} || {part("text")}) AS leaf,
            CASE WHEN xor({crc}, 4294967295::BIGINT) % 3 = 0 THEN sha256({columns} || {part(low)}) END AS other FROM documents)""",
             """p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS gid, count(*) OVER (PARTITION BY lang) AS n FROM d)"""]
    parts += _tree_ctes("t", "gid", "SELECT gid AS grp, pos AS idx, leaf AS h, n FROM p", levels)
    parts += _tree_ctes("c", "0", f"SELECT 0 AS grp, grp AS idx, h, count(*) OVER () AS n FROM t{levels}", crown)
    step = ("SELECT f.* REPLACE (CASE WHEN s.more THEN sha256(s.before || f.own || s.behind) ELSE f.own END AS own, "
            "f.proof || s.before || s.behind AS proof) FROM ")
    parts.append("f0 AS MATERIALIZED (SELECT doc_id, leaf, gid, pos, coalesce(other, leaf) AS own, '' AS proof FROM p)")
    for k in range(levels):
        parts.append(f"f{k + 1} AS MATERIALIZED ({step} f{k} f JOIN ts{k} s ON s.grp = f.gid AND s.idx = f.pos // {8 ** k})")
    for k in range(crown):
        parts.append(f"f{levels + k + 1} AS MATERIALIZED ({step} f{levels + k} f JOIN cs{k} s ON s.idx = f.gid // {8 ** k})")
    return f"""WITH {", ".join(parts)}
        SELECT f.doc_id, f.leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.own AS folded_root,
               f.own = r.h AS verified
        FROM f{levels + crown} f JOIN t{levels} t ON t.grp = f.gid CROSS JOIN c{crown} r"""


def urls_sql(rounds: int = urls.ROUNDS, depth: int = urls.DEPTH) -> str:
    """Rules, features and boosted trees; a level of a tree is a CTE."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    label = "CASE " + " ".join(f"WHEN {f} THEN {int(v == 'block')}" for f, (v, _, _) in zip(fits, rules)) + " END"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    text = "coalesce(url, '')"
    names = ", ".join(urls.FEATURES)

    def count(what: str, pattern: str) -> str:
        return f"len(regexp_extract_all({what}, '{pattern}'))"

    gain = f"(x{{0}}::DOUBLE * x{{0}}::DOUBLE / (y{{0}}::DOUBLE + {urls.RIDGE * urls.UNIT}))"
    parts = [f"""u0 AS MATERIALIZED (SELECT page_id, url, translate(regexp_extract(coalesce({rest}, ''), '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce({rest}, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
             f"""u1 AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {label} AS label,
            least(length({text}) // 2, 127) AS length, least(length(host), 63) AS host_length, least(length(path), 127) AS path_length,
            least({count('path', '/')}, 31) AS depth, least({count('host', '[.]')}, 15) AS labels,
            {count(text, '[0-9]')} * 16 // greatest(length({text}), 1) AS digits,
            CASE WHEN {text} = '' THEN 0 ELSE CAST(floor(round((log2(length({text})) - list_sum(list_transform(
              map_values(list_histogram(string_split({text}, ''))), lambda k: k * log2(k))) / length({text})) * 8, 6)) AS BIGINT) END AS entropy,
            least({count(f"regexp_extract({text}, '[?]([^#]*)', 1)", '[^&]+')}, 15) AS params,
            split_part(host, '.', -1) AS suffix FROM u0)""",
             """u2 AS MATERIALIZED (SELECT u1.*, suffix_share, suffix_rank FROM u1 JOIN (SELECT suffix,
            (coalesce(sum(label), 0) * 2 + 1) * 8 // (count(label) + 1) AS suffix_share,
            length(CAST(count(*) AS VARCHAR)) AS suffix_rank FROM u1 GROUP BY suffix) USING (suffix))""",
             f"""v0 AS MATERIALIZED (SELECT {names}, count(label) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS y,
            CAST(floor(ln((sum(sum(label)) OVER () + 1) / (sum(count(label)) OVER () - sum(sum(label)) OVER () + 1.0))
              * {urls.MICRO} + 0.5) AS BIGINT) AS margin FROM u2 GROUP BY {names})"""]
    for r in range(rounds):
        parts.append(f"""g{r} AS MATERIALIZED (SELECT *, y * {urls.UNIT} - n * CAST(floor(p * {urls.UNIT} + 0.5) AS BIGINT) AS g,
            n * CAST(floor(p * (1 - p) * {urls.UNIT} + 0.5) AS BIGINT) AS h, 0 AS node
            FROM (SELECT *, 1 / (1 + exp(-margin::DOUBLE / {urls.MICRO})) AS p FROM v{r}))""")
        now = f"g{r}"
        for k in range(depth):
            at = f"{r}_{k}"
            long = " UNION ALL ".join(f"SELECT node, {i} AS feature, {f} AS bin, g, h FROM {now} WHERE n > 0"
                                      for i, f in enumerate(urls.FEATURES))
            parts.append(f"h{at} AS MATERIALIZED (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM ({long}) GROUP BY ALL)")
            parts.append(f"""b{at} AS MATERIALIZED (SELECT feature, bin FROM (
                SELECT t.feature, t.bin, h.node, coalesce(sum(g) FILTER (h.bin <= t.bin), 0) AS x0, coalesce(sum(h.h) FILTER (h.bin <= t.bin), 0) AS y0,
                    sum(g) AS x2, sum(h.h) AS y2, x2 - x0 AS x1, y2 - y0 AS y1
                FROM (SELECT DISTINCT feature, bin FROM h{at}) t JOIN h{at} h USING (feature) GROUP BY ALL)
                GROUP BY feature, bin ORDER BY sum(CAST(floor({gain.format(0)} + {gain.format(1)} - {gain.format(2)}) AS HUGEINT)) DESC, feature, bin LIMIT 1)""")
            value = "CASE b.feature " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(urls.FEATURES)) + " END"
            parts.append(f"""n{at} AS MATERIALIZED (SELECT x.* REPLACE (x.node + CASE WHEN {value} > b.bin THEN {1 << k} ELSE 0 END AS node)
                FROM {now} x CROSS JOIN b{at} b)""")
            now = f"n{at}"
        parts.append(f"""v{r + 1} AS MATERIALIZED (SELECT {", ".join("x." + f for f in urls.FEATURES)}, n, y, margin + coalesce(w, 0) AS margin
            FROM {now} x LEFT JOIN (SELECT node, CAST(floor(sum(g)::DOUBLE * {urls.RATE * (urls.MICRO // 1000)} /
              (sum(h)::DOUBLE + {urls.RIDGE * urls.UNIT}) + 0.5) AS BIGINT) AS w FROM {now} WHERE n > 0 GROUP BY node) USING (node))""")
    return f"""WITH {", ".join(parts)}
        SELECT page_id, host, path, rule, CASE WHEN label = 1 OR (label IS NULL AND margin > 0) THEN 'block' ELSE 'allow' END AS verdict,
               floor(1 / (1 + exp(-margin::DOUBLE / {urls.MICRO})) * 10000 + 0.5) / 10000 AS score
        FROM u2 JOIN v{rounds} USING ({names})"""


ORACLE = {
    "op11_merkle_manifest": merkle_sql(),
    "op12_url_filter": urls_sql(),
    "op3_mixing": f"WITH {mixing_ctes('documents')} SELECT * FROM drawn",
    "op4_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
                     sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END
                 AS record_type,
               CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.payload_bytes >= 100 AND d.payload_digest = f.payload_digest""",
}
