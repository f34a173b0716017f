"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code, in the reference's own style
(COUNT(DISTINCT ...) straight on the mention table).  ``FIX`` rebuilds the
fixture tables (see FIXTURES.md) as CTEs; each oracle appends its SELECT.
Every float is rounded to 6 decimals, as in the Spark queries.
"""

from __future__ import annotations

FIX = """
WITH authors AS (
  SELECT CAST(c_custkey AS VARCHAR) AS author_id, c_name AS name, n_name AS institution
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
fx_documents AS (
  SELECT CAST(o_orderkey AS BIGINT) AS document_id, CAST(o_custkey AS VARCHAR) AS author_id,
         CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS institution
  FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 25),
mentions AS (
  SELECT p_name AS entity, CAST(o_custkey AS VARCHAR) AS author_id, CAST(l_orderkey AS BIGINT) AS document_id,
         CAST(year(o_orderdate) AS INTEGER) AS year, l_discount * CAST(10.0 AS DOUBLE) AS rho
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
topics AS (
  SELECT 'topic-' || CAST(min(p_partkey) AS VARCHAR) AS query_id, p_name AS text FROM part GROUP BY p_name),
titles AS (
  SELECT array_to_string(regexp_extract_all(lower(entity), '[\\p{L}\\p{N}_]+'), ' ') AS surface, max(entity) AS entity
  FROM (SELECT DISTINCT entity FROM mentions WHERE entity IS NOT NULL) GROUP BY 1 HAVING surface <> ''),
topic_words AS (
  SELECT query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS words FROM topics),
topic_grams AS (
  SELECT query_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS surface
  FROM (SELECT query_id, words, i, unnest(range(1, len(words) - i + 2)) AS n
        FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM topic_words))),
qe AS (
  SELECT DISTINCT query_id, entity FROM (
    SELECT g.query_id, t.entity, i, n, max(i + n) OVER (
             PARTITION BY g.query_id ORDER BY i, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM topic_grams g JOIN titles t USING (surface))
  WHERE reach IS NULL OR reach < i + n),
nq AS (SELECT query_id, count(*) AS n FROM qe GROUP BY query_id),
strong_year AS (
  SELECT author_id, entity, year, count(DISTINCT document_id) AS docs, count(*) AS n, max(rho) AS mr
  FROM mentions WHERE rho > CAST(0.2 AS DOUBLE) AND entity IS NOT NULL
  GROUP BY author_id, entity, year),
ae AS (
  SELECT author_id, entity, CAST(sum(docs) AS BIGINT) AS author_freq, max(mr) AS max_rho,
         string_agg(CAST(year AS VARCHAR) || 'x' || CAST(n AS VARCHAR), ',' ORDER BY year) AS years
  FROM strong_year GROUP BY author_id, entity),
paper_rows AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS author_id, a.name, pn.n_name AS institution,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, d.text AS abstract,
         CASE WHEN o.o_orderstatus = 'F' THEN '10.0/' || CAST(o.o_orderkey AS VARCHAR) END AS doi,
         o.o_orderkey AS ordinal, 'orders-' || o.o_orderstatus AS input_file
  FROM orders o JOIN authors a ON CAST(o.o_custkey AS VARCHAR) = a.author_id
       LEFT JOIN nation pn ON pn.n_nationkey = o.o_orderkey % 25
       LEFT JOIN documents d ON o.o_orderkey = d.doc_id),
papers AS (
  SELECT author_id, count(DISTINCT document_id) AS papers FROM mentions
  WHERE entity IS NOT NULL GROUP BY author_id),
pop AS (
  SELECT entity, count(DISTINCT document_id) AS entity_popularity FROM mentions
  WHERE entity IS NOT NULL GROUP BY entity),
total AS (SELECT count(*) AS total_papers FROM fx_documents),
prof AS (
  SELECT ae.author_id, ae.entity, ae.author_freq, p.papers, pp.entity_popularity, t.total_papers,
         ae.author_freq / p.papers AS ef,
         ln(t.total_papers / pp.entity_popularity) AS iaf,
         (ae.author_freq / p.papers) * ln(t.total_papers / pp.entity_popularity) AS ef_iaf,
         ae.max_rho, ae.years
  FROM ae JOIN papers p USING (author_id) JOIN pop pp USING (entity), total t),
qw AS (
  SELECT qe.query_id, qe.entity,
         (CAST(1.0 AS DOUBLE) / nq.n) * ln(t.total_papers / pp.entity_popularity) AS qw
  FROM qe JOIN pop pp USING (entity) JOIN nq USING (query_id), total t),
vec AS (
  SELECT j.query_id, j.author_id,
         sum(j.ef_iaf * j.qw) AS dot, sum(j.ef * j.qw) AS efiaf, sum(j.author_freq * j.qw) AS eciaf,
         sum((ln(j.author_freq) + j.ef) * j.qw) AS log_ec_ef_iaf
  FROM (SELECT prof.*, qw.query_id, qw.qw FROM prof JOIN qw USING (entity)) j
  GROUP BY j.query_id, j.author_id),
norms AS (SELECT author_id, sum(ef_iaf) AS efiaf_sum FROM prof GROUP BY author_id),
qnorm AS (SELECT query_id, sum(qw) AS qw_sum FROM qw GROUP BY query_id),
scores AS (
  SELECT v.query_id, v.author_id,
         CASE WHEN sqrt(n.efiaf_sum) * sqrt(q.qw_sum) = 0 THEN CAST(0.0 AS DOUBLE)
              ELSE v.dot / (sqrt(n.efiaf_sum) * sqrt(q.qw_sum)) END AS cossim_efiaf,
         v.efiaf, v.eciaf, v.log_ec_ef_iaf
  FROM vec v JOIN norms n USING (author_id) JOIN qnorm q USING (query_id)),
doc_ent AS (
  SELECT DISTINCT document_id, entity FROM mentions WHERE entity IS NOT NULL),
cooc AS (
  SELECT s.entity AS source, o.entity AS other, count(*) AS both_docs
  FROM doc_ent s JOIN doc_ent o ON s.document_id = o.document_id AND s.entity <> o.entity
  WHERE s.entity IN (SELECT entity FROM qe)
  GROUP BY s.entity, o.entity),
rel AS (
  SELECT c.source, c.other,
         CASE WHEN ln(t.total_papers) - ln(least(a.entity_popularity, b.entity_popularity)) > 0
              THEN greatest(CAST(0.0 AS DOUBLE), 1.0 - (ln(greatest(a.entity_popularity, b.entity_popularity)) - ln(c.both_docs))
                                / (ln(t.total_papers) - ln(least(a.entity_popularity, b.entity_popularity))))
              WHEN ln(greatest(a.entity_popularity, b.entity_popularity)) - ln(c.both_docs) = 0 THEN CAST(1.0 AS DOUBLE)
              ELSE CAST(0.0 AS DOUBLE) END AS rel
  FROM cooc c JOIN pop a ON a.entity = c.source JOIN pop b ON b.entity = c.other, total t)
"""

ORACLE: dict[str, str] = {}


def _r6(text: str) -> str:
    """Rewrite every ``round(X, 6)`` as ``(floor((X) * 1e6 + 0.5) / 1e6)`` (see queries.r6)."""
    out, i = [], 0
    while True:
        j = text.find("round(", i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        if j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_"):
            out.append(text[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            ch = text[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = text[j + 6:k]
        head, sep, digits = inner.rpartition(",")
        if sep and digits.strip() == "6":
            out.append(text[i:j] + f"(floor(({_r6(head)}) * 1e6 + 0.5) / 1e6)")
        else:
            out.append(text[i:j] + "round(" + _r6(inner) + ")")
        i = k + 1


def sql(name: str, body: str) -> None:
    ORACLE[name] = _r6(FIX + body)


# ---------------------------------------------------------------- D: stats
sql("author_entity_frequency", """
SELECT author_id, entity, author_freq, round(max_rho, 6) AS max_rho, years FROM ae""")

sql("papers_count", "SELECT author_id, papers FROM papers")

sql("total_papers", "SELECT total_papers FROM total")

sql("entity_popularity", "SELECT entity, entity_popularity FROM pop")

sql("entity_institution_frequency", """
SELECT m.entity, d.institution, count(DISTINCT m.document_id) AS frequency
FROM mentions m JOIN fx_documents d USING (document_id)
WHERE m.entity IS NOT NULL
GROUP BY m.entity, d.institution""")

sql("institution_document_count", """
SELECT institution, count(*) AS document_count FROM fx_documents GROUP BY institution""")

sql("institution_author_count", """
SELECT institution, count(*) AS authors FROM authors GROUP BY institution""")

sql("grouped_entities", """
SELECT author_id, entity, year, round(avg(rho), 6) AS avg_rho, round(min(rho), 6) AS min_rho,
       round(max(rho), 6) AS max_rho, count(*) AS count
FROM mentions WHERE entity IS NOT NULL
GROUP BY author_id, entity, year HAVING count(*) >= 2""")

sql("grouped_entities_in_order", """
SELECT author_id, entity, year, round(avg(rho), 6) AS avg_rho, round(min(rho), 6) AS min_rho,
       round(max(rho), 6) AS max_rho, count(*) AS count,
       CAST(row_number() OVER (PARTITION BY author_id, year ORDER BY count(*) DESC, entity) AS INTEGER) AS position
FROM mentions WHERE entity IS NOT NULL
GROUP BY author_id, entity, year""")

sql("grouped_entities_year", """
SELECT author_id, entity, year, round(avg(rho), 6) AS avg_rho, round(min(rho), 6) AS min_rho,
       round(max(rho), 6) AS max_rho, count(*) AS count
FROM mentions WHERE entity IS NOT NULL
GROUP BY author_id, entity, year HAVING year = 1998""")

sql("grouped_entity_rhos", """
SELECT author_id, entity, year, round(rho, 6) AS rho, count(*) AS n
FROM mentions WHERE entity IS NOT NULL GROUP BY author_id, entity, year, rho""")

sql("author_documents", """
SELECT author_id, document_id, year, entity, count(*) AS count
FROM mentions WHERE entity IN (SELECT entity FROM qe)
GROUP BY author_id, document_id, year, entity""")

sql("author_documents_json", """
SELECT author_id, document_id,
       '{"year":' || CAST(any_value(year) AS VARCHAR) || ',"entities":['
       || string_agg('{"entity":' || to_json(entity) || ',"count":' || CAST(cnt AS VARCHAR) || '}', ','
                     ORDER BY entity, cnt) || ']}' AS json
FROM (SELECT author_id, document_id, year, entity, count(*) AS cnt FROM mentions
      WHERE entity IS NOT NULL GROUP BY ALL)
GROUP BY author_id, document_id""")

_SORTED = """
sorted AS (SELECT papers AS x, row_number() OVER (ORDER BY papers) AS k FROM papers),
n AS (SELECT count(*) AS n FROM papers),
probs AS (SELECT i, i / 10.0 AS prob FROM range(10) t(i)),
h AS (SELECT i, prob, n, n * prob + 0.4 + prob * (1.0 - 0.4 - 0.4) AS h FROM probs, n),
kk AS (SELECT i, prob, n, h, CAST(floor(least(greatest(h, 1.0), greatest(n - 1, 1))) AS BIGINT) AS k FROM h),
qs AS (
  SELECT kk.i, kk.prob,
         (1.0 - least(greatest(kk.h - kk.k, 0.0), 1.0)) * s1.x + least(greatest(kk.h - kk.k, 0.0), 1.0) * s2.x AS quantile
  FROM kk JOIN sorted s1 ON s1.k = kk.k JOIN sorted s2 ON s2.k = least(kk.k + 1, kk.n))
"""

sql("paper_count_quantiles", ", " + _SORTED + """
SELECT CAST(i AS INTEGER) AS i, round(CAST(prob AS DOUBLE), 6) AS prob, round(CAST(quantile AS DOUBLE), 6) AS quantile
FROM qs""")

sql("paper_count_histogram", ", " + _SORTED + """,
bins AS (
  SELECT i, CAST(floor(quantile) AS BIGINT) AS b,
         coalesce(lead(CAST(floor(quantile) AS BIGINT)) OVER (ORDER BY i) - 1,
                  (SELECT max(papers) FROM papers)) AS e
  FROM qs)
SELECT CAST(i AS INTEGER) AS i, b AS "begin", e AS "end",
       (SELECT count(*) FROM papers WHERE papers BETWEEN b AND e) AS authors
FROM bins""")

sql("corpus_stats", """
SELECT CAST(sum(papers) AS BIGINT) AS documents, count(*) AS authors FROM papers""")

sql("weighted_geom_mean", """
SELECT author_id, round(exp(sum(max_rho * ln(CAST(author_freq AS DOUBLE))) / sum(max_rho)), 6) AS wgm
FROM ae GROUP BY author_id""")

sql("query_entities", "SELECT query_id, entity FROM qe")

# ------------------------------------------------------------ E: scoring
sql("ef_iaf_author", """
SELECT author_id, entity, round(ef, 6) AS ef, round(iaf, 6) AS iaf, round(ef_iaf, 6) AS ef_iaf,
       round(max_rho, 6) AS max_rho, years FROM prof""")

sql("author_entity_freq_popularity", """
SELECT ae.author_id, ae.entity, ae.author_freq, pop.entity_popularity, round(ae.max_rho, 6) AS max_rho, ae.years
FROM ae JOIN pop USING (entity)""")

sql("ef_iaf_query", "SELECT query_id, entity, round(qw, 6) AS qw FROM qw")

sql("citing_authors", """
SELECT DISTINCT qe.query_id, m.author_id
FROM mentions m JOIN qe USING (entity) WHERE m.rho > CAST(0.2 AS DOUBLE)""")

for _name, _col in [("score_cossim_efiaf", "cossim_efiaf"), ("score_efiaf", "efiaf"),
                    ("score_eciaf", "eciaf"), ("score_log_ec_ef_iaf", "log_ec_ef_iaf")]:
    sql(_name, f"SELECT query_id, author_id, round({_col}, 6) AS score FROM scores")

_GEOM = """,
cands AS (
  SELECT DISTINCT qe.query_id, ae.author_id FROM ae JOIN qe USING (entity)),
w AS (SELECT author_id, entity, author_freq * max_rho AS w FROM ae),
wsum AS (SELECT author_id, sum(w) AS W FROM w GROUP BY author_id),
relq AS (
  SELECT source, other, rel FROM rel
  UNION ALL SELECT DISTINCT entity, entity, CAST(1.0 AS DOUBLE) FROM qe),
d AS (
  SELECT c.query_id, q.entity AS q, c.author_id,
         sum(w.w * (ln(1.0 - pow(coalesce(r.rel, 0.0), 10.0) + 1e-5) - ln(1.0 + 1e-5))) AS D
  FROM cands c JOIN qe q ON q.query_id = c.query_id
       JOIN w ON w.author_id = c.author_id
       LEFT JOIN relq r ON r.source = q.entity AND r.other = w.entity
  GROUP BY c.query_id, q.entity, c.author_id),
t AS (
  SELECT d.query_id, d.author_id,
         pow(least(greatest(-(1.0 + 1e-5) * (exp(d.D / ws.W) - 1.0), 0.0), 1.0), 1.0 / 10.0) AS t
  FROM d JOIN wsum ws USING (author_id)),
geom AS (
  SELECT t.query_id, t.author_id, sum(t.t) / any_value(nq.n) AS score
  FROM t JOIN nq USING (query_id) GROUP BY t.query_id, t.author_id)
"""

sql("score_relatedness_geom", _GEOM + """
SELECT query_id, author_id, round(score, 6) AS score FROM geom""")

sql("find_experts", """
SELECT s.query_id, s.author_id, a.name, round(s.eciaf, 6) AS score
FROM scores s LEFT JOIN authors a USING (author_id)""")

sql("find_experts_top10", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, author_id, name, round(score, 6) AS score FROM (
  SELECT s.query_id, s.author_id, a.name, s.efiaf AS score,
         row_number() OVER (PARTITION BY s.query_id ORDER BY s.efiaf DESC, s.author_id) AS rank
  FROM scores s LEFT JOIN authors a USING (author_id)) WHERE rank <= 10""")

sql("find_experts_all_scorings", _GEOM + """
SELECT query_id, author_id, scoring, round(score, 6) AS score FROM (
  SELECT query_id, author_id, 'cossim_efiaf' AS scoring, cossim_efiaf AS score FROM scores
  UNION ALL SELECT query_id, author_id, 'efiaf', efiaf FROM scores
  UNION ALL SELECT query_id, author_id, 'eciaf', eciaf FROM scores
  UNION ALL SELECT query_id, author_id, 'log_ec_ef_iaf', log_ec_ef_iaf FROM scores
  UNION ALL SELECT query_id, author_id, 'relatedness_geom', score FROM geom)""")

sql("entity_relatedness", "SELECT source, other, round(rel, 6) AS rel FROM rel WHERE rel > 0")

sql("relatedness_missing_pairs", """,
cands AS (SELECT DISTINCT qe.query_id, ae.author_id FROM ae JOIN qe USING (entity)),
needed AS (
  SELECT DISTINCT least(q.entity, a.entity) AS entity_a, greatest(q.entity, a.entity) AS entity_b
  FROM cands c JOIN qe q ON q.query_id = c.query_id JOIN ae a ON a.author_id = c.author_id),
memo AS (
  SELECT DISTINCT least(source, other) AS entity_a, greatest(source, other) AS entity_b FROM rel WHERE rel > 0)
SELECT entity_a, entity_b FROM needed
WHERE NOT EXISTS (SELECT 1 FROM memo m WHERE m.entity_a = needed.entity_a AND m.entity_b = needed.entity_b)""")

sql("author_profile_top50", """
SELECT author_id, CAST(rank AS INTEGER) AS rank, entity, round(freq_pct, 6) AS freq_pct, round(importance, 6) AS importance,
       round(rarity, 6) AS rarity, round(max_rho, 6) AS max_rho, years_text FROM (
  SELECT author_id, entity, ef * 100.0 AS freq_pct, ef_iaf * 100.0 AS importance, iaf AS rarity, max_rho,
         row_number() OVER (PARTITION BY author_id ORDER BY ef_iaf DESC, entity) AS rank,
         (SELECT string_agg(CAST(year AS VARCHAR) || CASE WHEN n > 1 THEN '(x' || CAST(n AS VARCHAR) || ')' ELSE '' END,
                            ', ' ORDER BY year)
          FROM strong_year sy WHERE sy.author_id = prof.author_id AND sy.entity = prof.entity) AS years_text
  FROM prof) WHERE rank <= 50""")

# --------------------------------------------------------- 2.L evaluation
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
SUCCESS = (1, 5, 10)
RECALL_POINTS = tuple(i / 10.0 for i in range(11))

_EVAL = """,
qrels AS (
  SELECT t.query_id, CAST(u.o_custkey AS VARCHAR) AS author_id,
         CAST(CASE WHEN u.units >= 100 THEN 2 WHEN u.units >= 50 THEN 1 ELSE 0 END AS INTEGER) AS rel
  FROM (SELECT p_name, o_custkey, sum(l_quantity) AS units
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY p_name, o_custkey) u
  JOIN topics t ON t.text = u.p_name),
run AS (SELECT query_id, author_id, eciaf AS score FROM scores),
rr AS (
  SELECT * FROM (
    SELECT query_id, author_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, author_id DESC) AS rank
    FROM run) WHERE rank <= 1000),
qs AS (
  SELECT query_id, count(*) FILTER (WHERE rel >= 1) AS num_rel, count(*) FILTER (WHERE rel < 1) AS num_nonrel
  FROM qrels GROUP BY query_id),
cj AS (
  SELECT r.query_id, r.author_id, r.rank, q.rel,
         CASE WHEN q.rel >= 1 THEN 1 ELSE 0 END AS is_rel,
         coalesce(s.num_rel, 0) AS num_rel, coalesce(s.num_nonrel, 0) AS num_nonrel,
         sum(CASE WHEN q.rel >= 1 THEN 1 ELSE 0 END) OVER w AS cum_rel,
         sum(CASE WHEN q.rel IS NOT NULL AND q.rel < 1 THEN 1 ELSE 0 END) OVER w AS cum_nonrel
  FROM rr r LEFT JOIN qrels q USING (query_id, author_id) LEFT JOIN qs s USING (query_id)
  WINDOW w AS (PARTITION BY r.query_id ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
idcg AS (
  SELECT query_id, sum(rel / log2(irank + 1)) AS idcg,
         {idcg_k}
  FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, author_id) AS irank
        FROM qrels WHERE rel > 0) GROUP BY query_id),
pq AS (
  SELECT query_id, count(*) AS num_ret, max(num_rel) AS num_rel, CAST(sum(is_rel) AS BIGINT) AS num_rel_ret,
         sum(CASE WHEN is_rel = 1 THEN cum_rel / rank ELSE 0.0 END) AS ap_sum,
         sum(CASE WHEN rank <= num_rel THEN is_rel ELSE 0 END) AS rprec_hits,
         min(CASE WHEN is_rel = 1 THEN rank END) AS first_rel,
         sum(CASE WHEN is_rel = 1 THEN
               CASE WHEN least(num_rel, num_nonrel) > 0
                    THEN 1.0 - least(cum_nonrel, num_rel) / least(num_rel, num_nonrel) ELSE 1.0 END
             ELSE 0.0 END) AS bpref_sum,
         sum((CASE WHEN rel > 0 THEN CAST(rel AS DOUBLE) ELSE 0.0 END) / log2(rank + 1)) AS dcg,
         {hits_k},
         {iprec_i}
  FROM cj GROUP BY query_id),
m AS (
  SELECT pq.query_id, num_ret, num_rel, num_rel_ret,
         CASE WHEN num_rel > 0 THEN ap_sum / num_rel ELSE 0.0 END AS map,
         ln(greatest(CASE WHEN num_rel > 0 THEN ap_sum / num_rel ELSE 0.0 END, 1e-5)) AS gm_map,
         CASE WHEN num_rel > 0 THEN rprec_hits / num_rel ELSE 0.0 END AS Rprec,
         coalesce(1.0 / first_rel, 0.0) AS recip_rank,
         CASE WHEN num_rel > 0 THEN bpref_sum / num_rel ELSE 0.0 END AS bpref,
         CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg,
         CASE WHEN num_ret > 0 THEN num_rel_ret / num_ret ELSE 0.0 END AS set_P,
         CASE WHEN num_rel > 0 THEN num_rel_ret / num_rel ELSE 0.0 END AS set_recall,
         {final_k},
         {final_iprec}
  FROM pq LEFT JOIN idcg USING (query_id)),
mf AS (
  SELECT m.*, CASE WHEN set_P + set_recall > 0 THEN 2 * set_P * set_recall / (set_P + set_recall) ELSE 0.0 END AS set_F
  FROM m)
"""


def _fmt_eval() -> str:
    idcg_k = ",\n         ".join(
        f"sum(CASE WHEN irank <= {k} THEN rel / log2(irank + 1) ELSE 0.0 END) AS idcg_{k}" for k in CUTOFFS)
    hits_k = ",\n         ".join(
        [f"sum(CASE WHEN rank <= {k} THEN is_rel ELSE 0 END) AS hits_{k}" for k in sorted(set(CUTOFFS) | set(SUCCESS))]
        + [f"sum(CASE WHEN rank <= {k} THEN (CASE WHEN rel > 0 THEN CAST(rel AS DOUBLE) ELSE 0.0 END) / log2(rank + 1) "
           f"ELSE 0.0 END) AS dcg_{k}" for k in CUTOFFS])
    iprec_i = ",\n         ".join(
        f"max(CASE WHEN is_rel = 1 AND (CASE WHEN num_rel > 0 THEN cum_rel / num_rel ELSE 0.0 END) >= {p!r} - 1e-12 "
        f"THEN cum_rel / rank END) AS iprec_{i}" for i, p in enumerate(RECALL_POINTS))
    final = []
    for k in CUTOFFS:
        final.append(f"hits_{k} / {float(k)!r} AS P_{k}")
        final.append(f"CASE WHEN num_rel > 0 THEN hits_{k} / num_rel ELSE 0.0 END AS recall_{k}")
        final.append(f"CASE WHEN coalesce(idcg_{k}, 0) > 0 THEN dcg_{k} / idcg_{k} ELSE 0.0 END AS ndcg_cut_{k}")
    for k in SUCCESS:
        final.append(f"CASE WHEN hits_{k} > 0 THEN 1.0 ELSE 0.0 END AS success_{k}")
    final_iprec = ",\n         ".join(
        f'coalesce(iprec_{i}, 0.0) AS "iprec_at_recall_{p:.2f}"'.replace(f"{p:.2f}", f"{p:.2f}".replace(".", "_"))
        for i, p in enumerate(RECALL_POINTS))
    return _EVAL.format(idcg_k=idcg_k, hits_k=hits_k, iprec_i=iprec_i,
                        final_k=",\n         ".join(final), final_iprec=final_iprec)


EVAL = _fmt_eval()
_INT_MEASURES = {"num_ret", "num_rel", "num_rel_ret"}
EVAL_GROUPS = {
    "eval_counts": ["num_ret", "num_rel", "num_rel_ret"],
    "eval_precision_at_k": [f"P_{k}" for k in CUTOFFS] + [f"recall_{k}" for k in CUTOFFS]
    + [f"success_{k}" for k in SUCCESS],
    "eval_map": ["map", "gm_map"],
    "eval_rprec_rr": ["Rprec", "recip_rank"],
    "eval_bpref": ["bpref"],
    "eval_iprec": [f"iprec_at_recall_{p:.2f}".replace(".", "_") for p in RECALL_POINTS],
    "eval_ndcg": ["ndcg"] + [f"ndcg_cut_{k}" for k in CUTOFFS],
    "eval_set_measures": ["set_P", "set_recall", "set_F"],
}
for _q, _cols in EVAL_GROUPS.items():
    sel = ", ".join(f'"{c}"' if c in _INT_MEASURES else f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in _cols)
    sql(_q, EVAL + f"SELECT query_id, {sel} FROM mf")

_ALL_MEASURES = [c for cols in EVAL_GROUPS.values() for c in cols]


def _trec_all() -> str:
    unions = "\n  UNION ALL ".join(
        f"SELECT query_id, '{c[:-3] + '.' + c[-2:] if c.startswith('iprec') else c}' AS measure, "
        f"floor(CAST(\"{c}\" AS DOUBLE) * 1e6 + 0.5) AS units FROM mf" for c in _ALL_MEASURES)
    return EVAL + f""",
long AS (
  SELECT * FROM ({unions}) WHERE query_id IN (SELECT query_id FROM qs)),
judged AS (SELECT CAST(count(*) AS DOUBLE) AS nj, CAST(sum(num_rel) AS DOUBLE) AS total_rel FROM qs),
summ AS (
  SELECT measure, 'all' AS query_id,
         floor(1e6 * CASE WHEN measure IN ('num_ret', 'num_rel_ret') THEN sum(units) / 1e6
              WHEN measure = 'num_rel' THEN any_value(total_rel)
              WHEN measure = 'gm_map' THEN exp((sum(units) / 1e6 + (any_value(nj) - count(*)) * ln(1e-5)) / any_value(nj))
              ELSE sum(units) / (any_value(nj) * 1e6) END + 0.5) / 1e6 AS value
  FROM long, judged GROUP BY measure)
SELECT measure, query_id, units / 1e6 AS value FROM long
UNION ALL SELECT measure, query_id, value FROM summ"""


sql("trec_eval_all", _trec_all())

sql("ranked_run", EVAL + "SELECT query_id, author_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rr")

sql("topics_with_qrels", EVAL + """
SELECT query_id, text, row_number() OVER (ORDER BY query_id, text) - 1 AS position
FROM topics WHERE query_id IN (SELECT query_id FROM qrels)""")

sql("topics_without_text", EVAL + """
SELECT DISTINCT query_id FROM qrels WHERE query_id NOT IN (
  SELECT query_id FROM topics WHERE text IN (SELECT p_name FROM part WHERE p_size > 25))""")

sql("trec_run_lines", EVAL + """
SELECT query_id || ' 0 ' || author_id || ' 0 ' || printf('%.6f', round(score, 6)) || ' eciaf_score' AS value FROM run""")

sql("query_entity_list", """
SELECT query_id, string_agg(entity, '; ' ORDER BY entity) AS entities FROM qe GROUP BY query_id""")

sql("batch_topics", EVAL + _GEOM + """
SELECT query_id, author_id, scoring, round(score, 6) AS score FROM (
  SELECT query_id, author_id, 'cossim_efiaf_score' AS scoring, cossim_efiaf AS score FROM scores
  UNION ALL SELECT query_id, author_id, 'efiaf_score', efiaf FROM scores
  UNION ALL SELECT query_id, author_id, 'eciaf_score', eciaf FROM scores
  UNION ALL SELECT query_id, author_id, 'log_ec_ef_iaf_score', log_ec_ef_iaf FROM scores
  UNION ALL SELECT query_id, author_id, 'relatedness_geom', score FROM geom)
WHERE query_id IN (SELECT query_id FROM qrels)""")

# ------------------------------------------------- text path (documents table)
_WS = "[ \\t\\n\\x0B\\f\\r]"  # the reference's whitespace class

sql("text_snippets", f"""
SELECT doc_id, regexp_replace(CASE WHEN length(text) > 83 THEN substr(text, 1, 80) || '...' ELSE text END,
                              '{_WS}', ' ', 'g') AS snippet
FROM documents""")

sql("truncate_texts", "SELECT doc_id, substr(text, 1, 5000) AS text FROM documents")


def _lang_sql() -> str:
    from adeptus.operators.language import STOPWORDS
    toks = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) > 0)"
    rows = []
    for lang, words in sorted(STOPWORDS.items()):
        lst = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
        rows.append(f"SELECT doc_id, lang, '{lang}' AS l, len(list_filter(tokens, lambda w: list_contains({lst}, w))) AS n "
                    f"FROM toks")
    union = "\n  UNION ALL ".join(rows)
    return f""",
toks AS (SELECT doc_id, lang, {toks} AS tokens FROM documents),
scored AS ({union}),
best AS (
  SELECT doc_id, lang, l, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, l) AS rk FROM scored),
detected AS (
  SELECT doc_id, lang, CASE WHEN n > 0 THEN l ELSE 'broken' END AS detected FROM best WHERE rk = 1)
"""


_LANG = _lang_sql()
sql("detect_language", _LANG + "SELECT doc_id, lang, detected FROM detected")
sql("language_counts", _LANG + "SELECT detected AS lang, count(*) AS documents FROM detected GROUP BY detected")
sql("route_non_english", _LANG + "SELECT doc_id, detected FROM detected WHERE detected <> 'en'")

# ------------------------------------------------------ ingest path (papers)
sql("papers_year_filter", """
SELECT author_id, year, ordinal FROM paper_rows WHERE year BETWEEN 1996 AND 2000""")

sql("legit_documents", """
SELECT author_id, year, ordinal, CAST(length(abstract) AS INTEGER) AS abstract_chars FROM paper_rows
WHERE abstract IS NOT NULL AND length(abstract) > 10""")

sql("ingest_summary", """
SELECT input_file, count(*) AS total,
       count(*) FILTER (WHERE year BETWEEN 1996 AND 2000) AS in_range,
       count(*) FILTER (WHERE year BETWEEN 1996 AND 2000 AND abstract IS NOT NULL AND length(abstract) > 10)
         AS with_abstract,
       count(*) FILTER (WHERE year BETWEEN 1996 AND 2000 AND NOT coalesce(abstract IS NOT NULL AND length(abstract) > 10, false)
                        AND doi IS NOT NULL AND length(doi) > 0) AS doi_without_abstract
FROM paper_rows GROUP BY input_file""")

sql("assign_document_ids", """
SELECT ordinal, author_id, CAST(row_number() OVER (ORDER BY ordinal) - 1 AS BIGINT) AS document_id
FROM paper_rows
WHERE year BETWEEN 1996 AND 2000 AND abstract IS NOT NULL AND length(abstract) > 10""")

sql("authors_first_wins", """
SELECT author_id, arg_min(name, ordinal) AS name, arg_min(institution, ordinal) AS institution
FROM paper_rows GROUP BY author_id""")

sql("normalize_author_names", """
SELECT CAST(c_custkey AS VARCHAR) AS author_id,
       regexp_replace(
         array_to_string(list_transform(
           string_split(trim(regexp_replace(c_mktsegment || ' ' || c_name, '\\s+', ' ', 'g')), ' '),
           lambda w: upper(w[1]) || lower(w[2:])), ' '),
         '[^\\p{L}\\p{N}_]+', ' ', 'g') AS name
FROM customer""")

sql("papers_from_documents", """
SELECT source AS author_id, 'Name of ' || source AS name, 'TU' AS institution, 2017 AS year,
       text AS abstract, CAST(NULL AS VARCHAR) AS doi, doc_id AS ordinal
FROM documents""")

_ASSOC = """,
assoc AS (
  SELECT l_orderkey AS document_id, CAST(l_suppkey AS VARCHAR) AS author_id, l_orderkey * 8 + l_linenumber AS line_no
  FROM lineitem),
last_wins AS (
  SELECT document_id, author_id FROM (
    SELECT document_id, author_id,
           row_number() OVER (PARTITION BY document_id ORDER BY line_no DESC, author_id DESC) AS rk
    FROM assoc) WHERE rk = 1)
"""

sql("document_author_last_wins", _ASSOC + "SELECT document_id, author_id FROM last_wins")

sql("merge_documents_authors", _ASSOC + """
SELECT l.document_id, l.author_id, CAST(length(d.text) AS INTEGER) AS text_chars
FROM last_wins l JOIN documents d ON d.doc_id = l.document_id
WHERE d.text IS NOT NULL AND length(d.text) > 0""")

# ------------------------------------------------------------ B: lookups
sql("author_ids_by_name", """
SELECT name, author_id FROM authors WHERE name IN (
  SELECT a.name FROM authors a WHERE a.author_id IN (SELECT author_id FROM fx_documents WHERE year BETWEEN 1996 AND 2000))""")

sql("document_by_id", """
SELECT author_id, document_id, year, CAST(NULL AS VARCHAR) AS body FROM fx_documents
WHERE document_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")

sql("author_lookup", """
SELECT author_id, name, institution FROM authors
WHERE author_id IN (SELECT author_id FROM mentions WHERE entity IS NOT NULL AND rho > 0.9)""")

sql("institution_papers", """
SELECT institution, count(*) AS document_count FROM fx_documents
WHERE institution IN (SELECT institution FROM authors) GROUP BY institution""")

sql("author_mentions", """
SELECT author_id, document_id, year, entity, round(rho, 6) AS rho FROM mentions
WHERE author_id IN (SELECT author_id FROM fx_documents WHERE year BETWEEN 1996 AND 2000)""")

sql("documents_by_entity_list", """
SELECT qe.query_id, m.author_id, m.document_id, m.year, m.entity, count(*) AS count
FROM mentions m JOIN qe USING (entity) GROUP BY qe.query_id, m.author_id, m.document_id, m.year, m.entity""")

sql("author_completion", """
SELECT author_id, name, institution FROM authors WHERE name ILIKE '%customer%00001%'
ORDER BY author_id LIMIT 50""")

sql("author_card", """
SELECT ae.author_id, a.name, p.papers AS papers_count,
       CAST(row_number() OVER (PARTITION BY ae.author_id ORDER BY ae.author_freq DESC, ae.entity) AS INTEGER) AS rank,
       ae.entity, ae.author_freq AS frequency,
       (SELECT string_agg(CAST(year AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY year)
        FROM strong_year sy WHERE sy.author_id = ae.author_id AND sy.entity = ae.entity) AS years
FROM ae JOIN papers p USING (author_id) LEFT JOIN authors a USING (author_id)""")

# ------------------------------------------------------ A20: result shapes
sql("document_json", """
SELECT document_id, '{"author_id":' || to_json(author_id) || ',"ret_doc_id":' || CAST(document_id AS VARCHAR)
       || ',"year":' || CAST(year AS VARCHAR) || '}' AS json
FROM fx_documents""")

sql("find_experts_json", """
SELECT query_id, CAST(rk AS INTEGER) AS rank,
       '{"rank":' || CAST(rk AS VARCHAR) || ',"author_id":"' || author_id || '","name":"' || name ||
       '","score":"' || printf('%.6f', score) || '"}' AS json
FROM (SELECT s.query_id, s.author_id, a.name, round(s.eciaf, 6) AS score,
             row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.eciaf, 6) DESC, s.author_id) AS rk
      FROM scores s JOIN authors a USING (author_id))""")

sql("score_random", """
SELECT query_id, author_id,
       CAST(CAST('0x' || substr(md5(query_id || '|' || author_id || '|42'), 1, 8) AS BIGINT) AS DOUBLE)
         / 4294967296.0 AS score
FROM scores""")

sql("query_json", _GEOM + """,
five AS (
  SELECT query_id, author_id, 'cossim_efiaf' AS scoring, cossim_efiaf AS score FROM scores
  UNION ALL SELECT query_id, author_id, 'efiaf', efiaf FROM scores
  UNION ALL SELECT query_id, author_id, 'eciaf', eciaf FROM scores
  UNION ALL SELECT query_id, author_id, 'log_ec_ef_iaf', log_ec_ef_iaf FROM scores
  UNION ALL SELECT query_id, author_id, 'relatedness_geom', score FROM geom)
SELECT query_id, scoring, CAST(row_number() OVER (PARTITION BY query_id, scoring ORDER BY s DESC, author_id) AS INTEGER) AS rank,
       '{"author_id":"' || author_id || '","name":"' || name || '","score":"' || printf('%.6f', s) || '"}' AS json
FROM (SELECT f.*, a.name, round(score, 6) AS s FROM five f JOIN authors a USING (author_id))""")

sql("author_json", """
SELECT p.author_id, 0 AS rank,
       '{"id":"' || p.author_id || '","name":"' || a.name || '","papers_count":' || CAST(p.papers AS VARCHAR) || '}' AS json
FROM papers p JOIN authors a USING (author_id)
UNION ALL
SELECT ae.author_id,
       CAST(row_number() OVER (PARTITION BY ae.author_id ORDER BY ae.author_freq DESC, ae.entity) AS INTEGER),
       '{"entity":' || to_json(ae.entity) || ',"frequency":' || CAST(ae.author_freq AS VARCHAR) || ',"years":['
       || (SELECT string_agg('[' || CAST(year AS VARCHAR) || ',' || CAST(n AS VARCHAR) || ']', ',' ORDER BY year)
           FROM strong_year sy WHERE sy.author_id = ae.author_id AND sy.entity = ae.entity) || ']}'
FROM ae""")

sql("author_answers_json", """,
ranked AS (
  SELECT ae.author_id, row_number() OVER (PARTITION BY ae.author_id ORDER BY ae.author_freq DESC, ae.entity) AS rk,
         '{"entity":' || to_json(ae.entity) || ',"frequency":' || CAST(ae.author_freq AS VARCHAR) || ',"years":['
         || (SELECT string_agg('[' || CAST(year AS VARCHAR) || ',' || CAST(n AS VARCHAR) || ']', ',' ORDER BY year)
             FROM strong_year sy WHERE sy.author_id = ae.author_id AND sy.entity = ae.entity) || ']}' AS one
  FROM ae),
paged AS (SELECT author_id, (rk - 1) // 5 AS page, string_agg(one, ',' ORDER BY rk) AS list FROM ranked GROUP BY ALL)
SELECT p.author_id, CAST(coalesce(page, 0) AS INTEGER) AS page,
       '{"id":"' || p.author_id || '","name":"' || a.name || '","papers_count":' || CAST(p.papers AS VARCHAR)
       || ',"entities":[' || coalesce(list, '') || ']}' AS json
FROM papers p JOIN authors a USING (author_id) LEFT JOIN paged USING (author_id)""")

sql("query_answers_json", _GEOM + """,
five AS (
  SELECT query_id, author_id, 'cossim_efiaf' AS scoring, cossim_efiaf AS score FROM scores
  UNION ALL SELECT query_id, author_id, 'efiaf', efiaf FROM scores
  UNION ALL SELECT query_id, author_id, 'eciaf', eciaf FROM scores
  UNION ALL SELECT query_id, author_id, 'log_ec_ef_iaf', log_ec_ef_iaf FROM scores
  UNION ALL SELECT query_id, author_id, 'relatedness_geom', score FROM geom),
hits AS (
  SELECT query_id, scoring, row_number() OVER (PARTITION BY query_id, scoring ORDER BY s DESC, author_id) AS rk,
         '{"author_id":"' || author_id || '","name":"' || name || '","score":"' || printf('%.6f', s) || '"}' AS one
  FROM (SELECT f.*, a.name, round(score, 6) AS s FROM five f JOIN authors a USING (author_id))),
lists AS (
  SELECT query_id, (rk - 1) // 1000 AS page, """ + ", ".join(
      f"coalesce(string_agg(one, ',' ORDER BY rk) FILTER (scoring = '{s}'), '') AS l{i}" for i, s in enumerate(
          ("efiaf", "eciaf", "log_ec_ef_iaf", "cossim_efiaf", "relatedness_geom"))) + """
  FROM hits GROUP BY ALL),
asked AS (SELECT query_id, string_agg(CAST(to_json(entity) AS VARCHAR), ',' ORDER BY entity) AS entities FROM qe GROUP BY query_id)
SELECT query_id, CAST(coalesce(page, 0) AS INTEGER) AS page,
       '{"experts_efiaf":[' || coalesce(l0, '') || '],"experts_eciaf":[' || coalesce(l1, '')
       || '],"experts_log_ec_ef_iaf":[' || coalesce(l2, '') || '],"experts_cossim_efiaf":[' || coalesce(l3, '')
       || '],"experts_relatedness_geom":[' || coalesce(l4, '') || '],"query_entities":[' || entities || ']}' AS json
FROM asked LEFT JOIN lists USING (query_id)""")

sql("completion_json", """
SELECT '{"authors":[' || string_agg('{"id":"' || author_id || '","name":"' || name || '","institution":"' || institution || '"}',
                                    ',' ORDER BY author_id) || ']}' AS json
FROM (SELECT author_id, name, institution FROM authors WHERE name ILIKE '%customer%00001%' ORDER BY author_id LIMIT 50)""")

# ------------------------------------------------- M1: linking against the anchors of the pages
_ANCHORS = r""",
anchor AS (
  SELECT unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>')) AS a FROM pages),
link AS (
  SELECT regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1),
                                       '[?#].*$', ''), '^.*/', '') AS entity,
         array_to_string(regexp_extract_all(lower(regexp_replace(
           regexp_extract(a, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2), '<[^>]*>', '', 'g')),
           '[\p{L}\p{N}_]+'), ' ') AS surface
  FROM anchor),
sense AS (SELECT surface, entity, count(*) AS links FROM link WHERE entity <> '' AND surface <> '' GROUP BY ALL),
per_surface AS (SELECT surface, sum(links) AS as_anchor FROM sense GROUP BY surface),
longest AS (SELECT coalesce(max(len(string_split(surface, ' '))), 1) AS m FROM per_surface),
page_words AS (
  SELECT regexp_extract_all(lower(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')), '[\p{L}\p{N}_]+') AS words FROM pages),
page_grams AS (
  SELECT array_to_string(words[i:i + n - 1], ' ') AS surface
  FROM (SELECT words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM (SELECT words, unnest(range(1, (SELECT m FROM longest) + 1)) AS n FROM page_words) WHERE len(words) >= n)),
occ AS (SELECT surface, count(*) AS occurrences FROM page_grams SEMI JOIN per_surface USING (surface) GROUP BY surface),
gaz AS (
  SELECT s.surface, s.entity, s.links / p.as_anchor AS commonness,
         least(1.0, p.as_anchor / greatest(coalesce(o.occurrences, 0), p.as_anchor)) AS link_prob
  FROM sense s JOIN per_surface p USING (surface) LEFT JOIN occ o USING (surface)),
best AS (
  SELECT surface, entity, link_prob AS rho FROM (
    SELECT *, row_number() OVER (PARTITION BY surface ORDER BY commonness DESC, entity DESC) AS rk FROM gaz) WHERE rk = 1),
piece AS (
  SELECT doc_id, unnest(pieces) AS p, unnest(range(1, len(pieces) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+') AS pieces FROM documents)),
token AS (
  SELECT doc_id, i, lower(w) AS w, e - length(w) AS b, e
  FROM (SELECT doc_id, i, regexp_extract(p, '[\p{L}\p{N}_]+$') AS w,
               sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM piece)),
doc_words AS (
  SELECT doc_id, list(w ORDER BY i) AS ws, list(b ORDER BY i) AS bs, list(e ORDER BY i) AS es FROM token GROUP BY doc_id),
doc_grams AS (
  SELECT doc_id, i, n, bs[i] AS b, es[i + n - 1] AS e, array_to_string(ws[i:i + n - 1], ' ') AS surface
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i
        FROM (SELECT *, unnest(range(1, (SELECT m FROM longest) + 1)) AS n FROM doc_words) WHERE len(ws) >= n)),
linked AS (
  SELECT doc_id, CAST(b AS INTEGER) AS b, CAST(e AS INTEGER) AS e, entity, rho FROM (
    SELECT g.*, s.entity, s.rho, max(i + n) OVER (
             PARTITION BY doc_id ORDER BY i, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM doc_grams g JOIN best s USING (surface))
  WHERE reach IS NULL OR reach < i + n)
"""

sql("anchor_gazetteer", _ANCHORS + """
SELECT surface, entity, round(commonness, 6) AS commonness, round(link_prob, 6) AS link_prob FROM gaz""")

sql("link_entities", _ANCHORS + """
SELECT doc_id, b AS "begin", e AS "end", entity, round(rho, 6) AS rho FROM linked""")


_PAGE_REL = r""",
page_link AS (
  SELECT DISTINCT page_id, regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1),
                                       '[?#].*$', ''), '^.*/', '') AS entity,
         array_to_string(regexp_extract_all(lower(regexp_replace(
           regexp_extract(a, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2), '<[^>]*>', '', 'g')),
           '[\p{L}\p{N}_]+'), ' ') AS surface
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>')) AS a FROM pages)),
page_entity AS MATERIALIZED (SELECT DISTINCT page_id, entity FROM page_link WHERE entity <> '' AND surface <> ''),
entity_pages AS (SELECT entity, count(*) AS n FROM page_entity GROUP BY entity),
together AS (
  SELECT x.entity AS source, y.entity AS other, count(*) AS both_pages
  FROM page_entity x JOIN page_entity y ON x.page_id = y.page_id AND x.entity <> y.entity GROUP BY ALL),
page_rel AS MATERIALIZED (
  SELECT source, other, CASE WHEN den > 0 THEN greatest(0.0, 1.0 - num / den) WHEN num = 0 THEN 1.0 ELSE 0.0 END AS rel FROM (
    SELECT source, other, ln(greatest(p.n, q.n)::DOUBLE) - ln(both_pages::DOUBLE) AS num,
           ln((SELECT count(DISTINCT page_id) FROM page_entity)::DOUBLE) - ln(least(p.n, q.n)::DOUBLE) AS den
    FROM together JOIN entity_pages p ON p.entity = source JOIN entity_pages q ON q.entity = other) WHERE rel > 0)"""

sql("link_relatedness", _ANCHORS + _PAGE_REL + """
SELECT source, other, round(rel, 6) AS rel FROM page_rel""")

sql("link_entities_voted", _ANCHORS + _PAGE_REL + """,
v_kept AS (
  SELECT doc_id, i, b, e, surface FROM (
    SELECT g.*, max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM doc_grams g SEMI JOIN gaz USING (surface))
  WHERE reach IS NULL OR reach < i + n),
v_cand AS MATERIALIZED (SELECT k.*, g.entity, g.commonness, g.link_prob FROM v_kept k JOIN gaz g USING (surface)),
v_rel AS (SELECT source, other, rel FROM page_rel UNION ALL SELECT DISTINCT entity, entity, 1.0 FROM gaz),
v_weight AS (SELECT doc_id, entity, sum(commonness) AS w FROM v_cand GROUP BY ALL),
v_support AS (
  SELECT s.doc_id, s.entity, sum(rel * o.w) AS support
  FROM v_weight s JOIN v_rel ON source = s.entity JOIN v_weight o ON o.doc_id = s.doc_id AND o.entity = other GROUP BY ALL),
v_own AS (
  SELECT s.surface, s.entity, sum(rel * o.commonness) AS own
  FROM gaz s JOIN v_rel ON source = s.entity JOIN gaz o ON o.surface = s.surface AND o.entity = other GROUP BY ALL),
v_counted AS (SELECT doc_id, count(DISTINCT i) AS mentions FROM v_cand GROUP BY doc_id),
v_voted AS (
  SELECT v_cand.*, CASE WHEN mentions > 1 THEN round(greatest((support - own) / (mentions - 1), 0.0), 9) ELSE 0.0 END AS vote
  FROM v_cand JOIN v_support USING (doc_id, entity) JOIN v_own USING (surface, entity) JOIN v_counted USING (doc_id))
SELECT doc_id, CAST(b AS INTEGER) AS "begin", CAST(e AS INTEGER) AS "end", entity, round((link_prob + vote) / 2, 6) AS rho
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY vote DESC, commonness DESC, entity DESC) AS rk FROM v_voted)
WHERE rk = 1""")


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


sql("annotated_bodies", _ANCHORS + f""",
span AS (
  SELECT l.*, d.text, coalesce(lag(e) OVER (PARTITION BY l.doc_id ORDER BY b, e, entity), 0) AS prev,
         regexp_replace(CAST(CAST(round(rho, 6) AS DECIMAL(38, 12)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1') AS printed
  FROM linked l JOIN documents d USING (doc_id)),
body AS (
  SELECT doc_id, arg_max(e, (b, e, entity)) AS last_end,
         string_agg({_escaped("substr(text, prev + 1, greatest(b - prev, 0))")} || '<span class=''annotation'' entity='''
                    || replace(replace({_escaped("entity")}, '"', '&quot;'), '''', '&#x27;') || ''' score=''' || printed || '''>'
                    || {_escaped("substr(text, b + 1, e - b)")} || '</span>', '' ORDER BY b, e, entity) AS spans
  FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.spans, '') || {_escaped("substr(d.text, coalesce(x.last_end, 0) + 1)")} AS body
FROM documents d LEFT JOIN body x USING (doc_id)""")
