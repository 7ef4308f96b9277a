"""DuckDB SQL that recomputes each registered query from the driver tables.

The SQL restates the derivation rules of ``tagweave.sources.derived`` and
then computes every operator independently (long-form GROUP BY / joins /
list functions), so it does not share code paths with the Spark jobs.
"""

from __future__ import annotations

import re

from tagweave.operators.prompts import TEMPLATES

# Derived tag records (same rules as tagweave.sources.derived).
DOCS = """
d AS (
  SELECT doc_id, source AS file_name, lang, n_chars AS c, text,
         'lines' || CAST(len(string_split(text, chr(10))) AS VARCHAR) AS topic
  FROM documents)"""

GEN_POS = """
gen_all AS (
  SELECT doc_id, file_name, pos,
    CASE WHEN doc_id % 11 = 0 THEN NULL
         WHEN pos = 0 THEN CASE WHEN doc_id % 97 = 0 THEN 'Rare' || CAST(doc_id AS VARCHAR)
                                WHEN doc_id % 4 = 0 THEN 'Health_Care' WHEN doc_id % 4 = 1 THEN 'LegalTech'
                                WHEN doc_id % 4 = 2 THEN 'code - review' ELSE 'Finance / Banking' END
         WHEN pos = 1 THEN CASE WHEN c % 3 = 0 THEN 'Question' ELSE 'Summary' END
         WHEN pos = 2 THEN CASE WHEN c < 853 THEN 'Easy' WHEN c < 2676 THEN 'Medium' ELSE 'Hard' END
         WHEN pos = 3 AND doc_id % 13 <> 0 THEN lang
         WHEN pos = 4 AND doc_id % 13 <> 0 THEN topic END AS tag
  FROM d CROSS JOIN range(5) r(pos)),
gen_pos AS (SELECT * FROM gen_all WHERE tag IS NOT NULL)"""

GOLD_POS = """
gold_all AS (
  SELECT doc_id, file_name, pos,
    CASE WHEN doc_id % 17 = 0 THEN NULL
         WHEN pos = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'General' WHEN doc_id % 4 = 0 THEN 'Health Care'
                                WHEN doc_id % 4 = 1 THEN 'Legal Tech' WHEN doc_id % 4 = 2 THEN 'code-review'
                                ELSE 'Finance/Banking' END
         WHEN pos = 1 THEN 'QUESTION'
         WHEN pos = 2 THEN CASE WHEN c < 1475 THEN 'Easy' ELSE 'Hard' END
         WHEN pos = 3 THEN ' ' || upper(lang) || ' '
         WHEN pos = 4 AND doc_id % 3 <> 0 THEN topic END AS tag
  FROM d CROSS JOIN range(5) r(pos)),
gold_pos AS (SELECT * FROM gold_all WHERE tag IS NOT NULL)"""

# What the evaluation extractor must recover from each model output.
PRED_POS = """
stage AS (
  SELECT doc_id, file_name,
    CASE WHEN doc_id % 23 = 0 THEN 'default'
         WHEN doc_id % 5 IN (0, 1, 2) THEN 'list'
         WHEN doc_id % 11 = 0 THEN 'default'
         WHEN doc_id % 5 = 3 THEN 'object' ELSE 'lines' END AS parse_stage
  FROM d),
pred_pos AS (
  SELECT g.doc_id, g.file_name, g.pos, g.tag,
         CASE g.pos WHEN 0 THEN 'the domain' WHEN 1 THEN 'the task type' WHEN 2 THEN 'the difficulty'
                    WHEN 3 THEN 'the language' ELSE 'the topic' END AS explanation
  FROM gen_pos g JOIN stage s USING (doc_id) WHERE s.parse_stage <> 'default'
  UNION ALL
  SELECT doc_id, file_name, 0, 'General', 'Unable to parse' FROM stage WHERE parse_stage = 'default')"""

LISTS = """
lists AS (
  SELECT d.doc_id, d.file_name,
         coalesce(p.names, []::VARCHAR[]) AS pred, coalesce(g.names, []::VARCHAR[]) AS gold
  FROM d
  LEFT JOIN (SELECT doc_id, list(tag ORDER BY pos) AS names FROM pred_pos GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, list(tag ORDER BY pos) AS names FROM gold_pos GROUP BY doc_id) g USING (doc_id)),
sets AS (
  SELECT *, list_distinct(list_transform(pred, lambda x: trim(lower(x)))) AS ps,
            list_distinct(list_transform(gold, lambda x: trim(lower(x)))) AS gs
  FROM lists),
prf0 AS (
  SELECT *, CAST(len(list_intersect(ps, gs)) AS DOUBLE) AS inter FROM sets),
prf AS (
  SELECT doc_id, file_name, pred, gold,
    CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 1.0 WHEN len(pred) = 0 OR len(gold) = 0 THEN 0.0
         ELSE inter / len(ps) END AS p,
    CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 1.0 WHEN len(pred) = 0 OR len(gold) = 0 THEN 0.0
         ELSE inter / len(gs) END AS r
  FROM prf0),
scored AS (
  SELECT *, CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 1.0 WHEN len(pred) = 0 OR len(gold) = 0 THEN 0.0
                 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1
  FROM prf)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


EVAL_BASE = _with(DOCS, GEN_POS, GOLD_POS, PRED_POS, LISTS)

FILE_METRICS = """
fm AS (
  SELECT file_name, count(*) AS total_samples, count(*) FILTER (WHERE len(gold) > 0) AS valid_samples,
         avg(p) FILTER (WHERE len(gold) > 0) AS ep, avg(r) FILTER (WHERE len(gold) > 0) AS er,
         avg(f1) FILTER (WHERE len(gold) > 0) AS ef,
         count(*) FILTER (WHERE len(gold) > 0 AND f1 < 0.5) AS failed_cases_count
  FROM scored GROUP BY file_name HAVING count(*) FILTER (WHERE len(gold) > 0) > 0)"""

QUERIES: dict[str, str] = {}

QUERIES["parse_stage_counts"] = _with(DOCS, PRED_POS.split("pred_pos AS")[0].rstrip().rstrip(",")) + """
SELECT file_name, parse_stage, count(*) AS n FROM stage GROUP BY file_name, parse_stage"""

QUERIES["parsed_tag_rows"] = _with(DOCS, GEN_POS, PRED_POS) + """
SELECT doc_id, pos, trim(tag) AS tag, explanation FROM pred_pos"""

QUERIES["exact_prf_by_doc"] = EVAL_BASE + """
SELECT doc_id, file_name, round(p, 6) AS exact_match_precision, round(r, 6) AS exact_match_recall,
       round(f1, 6) AS exact_match_f1 FROM scored"""

QUERIES["file_metrics_exact"] = _with(DOCS, GEN_POS, GOLD_POS, PRED_POS, LISTS, FILE_METRICS) + """
SELECT file_name, total_samples, valid_samples, round(ep, 6) AS exact_match_precision,
       round(er, 6) AS exact_match_recall, round(ef, 6) AS exact_match_f1, failed_cases_count FROM fm"""

QUERIES["overall_macro"] = _with(DOCS, GEN_POS, GOLD_POS, PRED_POS, LISTS, FILE_METRICS) + """
SELECT count(*) AS n_files, CAST(sum(total_samples) AS BIGINT) AS total_samples,
       CAST(sum(valid_samples) AS BIGINT) AS valid_samples,
       round(avg(ep), 6) AS exact_match_precision, round(avg(er), 6) AS exact_match_recall,
       round(avg(ef), 6) AS exact_match_f1, CAST(sum(failed_cases_count) AS BIGINT) AS failed_cases_count FROM fm"""

QUERIES["failed_cases"] = EVAL_BASE + """,
toks AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS tk FROM d),
trunc AS (SELECT doc_id, {TRUNC600} AS truncated_input FROM toks),
failed AS (
  SELECT s.*, t.truncated_input,
         row_number() OVER (PARTITION BY s.file_name ORDER BY s.doc_id) AS case_rank
  FROM scored s JOIN trunc t USING (doc_id) WHERE len(s.gold) > 0 AND s.f1 < 0.5)
SELECT file_name, case_rank, doc_id, round(f1, 6) AS exact_match_f1,
       array_to_string(pred, '|') AS predicted, array_to_string(gold, '|') AS ground_truth,
       substr(truncated_input, 1, 300) || '...' AS input_preview
FROM failed WHERE case_rank <= 5"""


# --- cleaning and rare-tag filter -------------------------------------------


def _norm(x: str) -> str:
    """Tag normalisation in DuckDB regex (no look-behind): a space before every
    capital, then trim, gives the same result as 'not at the start'."""
    t = f"trim(replace({x}, '_', ' '))"
    t = f"regexp_replace({t}, '([A-Z])', ' \\1', 'g')"
    t = f"regexp_replace({t}, '\\s*-\\s*', '-', 'g')"
    t = f"regexp_replace({t}, '\\s*/\\s*', '/', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return f"trim({t})"


# Responses of a generation record: 1 = the model output (parses leniently
# only when it is a bare or fenced JSON list), 2 = the gold JSON list.
RESP = f"""
resp AS (
  SELECT doc_id AS index, file_name, CAST(1 AS BIGINT) AS response_id, 0 AS response_pos, pos, tag AS raw_tag,
         {_norm('tag')} AS tag
  FROM gen_pos WHERE doc_id % 5 IN (0, 1) AND doc_id % 23 <> 0
  UNION ALL
  SELECT doc_id, file_name, 2, 1, pos, tag, {_norm('tag')} FROM gold_pos)"""

RARE = """
freq AS (SELECT pos, tag, count(*) AS n FROM resp WHERE pos < 4 GROUP BY pos, tag),
bad AS (
  SELECT r.index, r.response_pos, r.pos, r.tag, f.n FROM resp r
  JOIN freq f ON f.pos = r.pos AND f.tag IS NOT DISTINCT FROM r.tag
  WHERE r.pos < 4 AND f.n < 2)"""

PREF_BASE = _with(DOCS, GEN_POS, GOLD_POS, RESP, RARE)

QUERIES["normalise_tags"] = _with(DOCS, GEN_POS, GOLD_POS, RESP) + """
SELECT index, response_id, pos, raw_tag, tag FROM resp"""

QUERIES["tag_variant_map"] = _with(DOCS, GEN_POS, GOLD_POS, RESP) + """
SELECT raw_tag, tag, count(*) AS n FROM resp GROUP BY raw_tag, tag"""

QUERIES["tag_freq"] = PREF_BASE + "SELECT pos, tag, n FROM freq"

QUERIES["rare_filter_kept"] = PREF_BASE + """
SELECT doc_id AS index, file_name FROM d WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.index = d.doc_id)"""

QUERIES["rare_filter_reasons"] = PREF_BASE + """
SELECT index, reason_rank, pos, tag, n FROM (
  SELECT *, row_number() OVER (PARTITION BY index ORDER BY response_pos, pos) AS reason_rank FROM bad)
WHERE reason_rank <= 3"""

QUERIES["rare_filter_stats"] = PREF_BASE + """
SELECT count(*) AS original_count,
       count(*) FILTER (WHERE doc_id NOT IN (SELECT index FROM bad)) AS kept_count,
       count(*) FILTER (WHERE doc_id IN (SELECT index FROM bad)) AS removed_count,
       round(100.0 * count(*) FILTER (WHERE doc_id NOT IN (SELECT index FROM bad)) / count(*), 6)
         AS retention_pct
FROM d"""


# --- reports ----------------------------------------------------------------

SIDES = """
sides AS (
  SELECT file_name, 'gen' AS side, pos, tag FROM pred_pos
  UNION ALL SELECT file_name, 'gold', pos, tag FROM gold_pos)"""

QUERIES["tag_distribution"] = _with(DOCS, GEN_POS, GOLD_POS, PRED_POS, SIDES) + """,
c AS (SELECT file_name, side, pos, tag, count(*) AS n FROM sides WHERE pos < 4 GROUP BY ALL)
SELECT file_name, side, pos, tag, n,
       CAST(sum(n) OVER (PARTITION BY file_name, side, pos) AS BIGINT) AS total,
       count(*) OVER (PARTITION BY file_name, side, pos) AS n_distinct,
       round(n * 100.0 / sum(n) OVER (PARTITION BY file_name, side, pos), 6) AS pct
FROM c"""

QUERIES["topic_top30"] = _with(DOCS, GEN_POS, PRED_POS) + """,
c AS (SELECT file_name, tag, count(*) AS n FROM pred_pos WHERE pos >= 4 GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file_name) AS BIGINT) AS total,
             count(*) OVER (PARTITION BY file_name) AS n_distinct,
             row_number() OVER (PARTITION BY file_name ORDER BY n DESC, tag) AS rank FROM c)
SELECT file_name, rank, tag, n, total, n_distinct FROM r WHERE rank <= 30"""

QUERIES["generation_quality"] = EVAL_BASE + """
SELECT file_name, count(*) AS records, count(*) FILTER (WHERE len(pred) = 0) AS empty,
       count(*) FILTER (WHERE len(pred) BETWEEN 1 AND 4) AS incomplete,
       count(*) FILTER (WHERE len(pred) >= 5) AS complete,
       round(count(*) FILTER (WHERE len(pred) >= 5) * 100.0 / count(*), 6) AS success_pct
FROM lists GROUP BY file_name"""

QUERIES["position_compare"] = EVAL_BASE + """,
pairs AS (
  SELECT l.doc_id, l.file_name, (len(l.pred) = 0 OR len(l.gold) = 0) AS skip, len(l.gold) AS ng,
         p.pos, (p.tag IS NOT NULL AND g.tag IS NOT NULL AND trim(lower(p.tag)) = trim(lower(g.tag))) AS hit
  FROM lists l
  LEFT JOIN pred_pos p ON p.doc_id = l.doc_id AND p.pos < 5
  LEFT JOIN gold_pos g ON g.doc_id = l.doc_id AND g.pos = p.pos),
per_doc AS (
  SELECT doc_id, file_name, any_value(skip) AS skip, any_value(ng) AS ng,
         count(*) FILTER (WHERE hit) AS m,
         bool_or(hit AND pos = 0) AS h0, bool_or(hit AND pos = 1) AS h1, bool_or(hit AND pos = 2) AS h2,
         bool_or(hit AND pos = 3) AS h3, bool_or(hit AND pos = 4) AS h4
  FROM pairs GROUP BY doc_id, file_name)
SELECT file_name, count(*) AS total_samples,
       count(*) FILTER (WHERE NOT skip AND m = ng) AS exact_matches,
       count(*) FILTER (WHERE NOT skip AND m <> ng AND m > 0) AS partial_matches,
       count(*) FILTER (WHERE NOT skip AND m <> ng AND m = 0) AS no_matches,
       count(*) FILTER (WHERE NOT skip AND h0) AS match_pos0, count(*) FILTER (WHERE NOT skip AND h1) AS match_pos1,
       count(*) FILTER (WHERE NOT skip AND h2) AS match_pos2, count(*) FILTER (WHERE NOT skip AND h3) AS match_pos3,
       count(*) FILTER (WHERE NOT skip AND h4) AS match_pos4,
       round(count(*) FILTER (WHERE NOT skip AND h0) * 100.0 / count(*), 6) AS rate_pos0,
       round(count(*) FILTER (WHERE NOT skip AND h1) * 100.0 / count(*), 6) AS rate_pos1,
       round(count(*) FILTER (WHERE NOT skip AND h2) * 100.0 / count(*), 6) AS rate_pos2,
       round(count(*) FILTER (WHERE NOT skip AND h3) * 100.0 / count(*), 6) AS rate_pos3,
       round(count(*) FILTER (WHERE NOT skip AND h4) * 100.0 / count(*), 6) AS rate_pos4
FROM per_doc GROUP BY file_name"""


# --- judging and exports ----------------------------------------------------

PAIRS = """
answers AS (
  SELECT conv_id, turn, text AS response1, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response2
  FROM conversations WHERE role = 'assistant'),
pairs AS (
  SELECT u.conv_id * 100000 + u.turn AS id, u.text AS prompt, a.response1, a.response2
  FROM (SELECT * FROM conversations WHERE role = 'user' AND text IS NOT NULL) u
  ASOF JOIN answers a ON u.conv_id = a.conv_id AND u.turn < a.turn
  WHERE a.response1 IS NOT NULL)"""

JUDGED = """
j AS (
  SELECT *, CASE WHEN id % 19 = 0 THEN 0 WHEN length(response1) >= length(response2) THEN 1 ELSE 2 END AS chosen,
         CAST(length(response1) % 11 AS DOUBLE) AS q1, CAST(length(response2) % 11 AS DOUBLE) AS q2,
         CAST(id % 6 + 3 AS DOUBLE) AS d1, CAST(id % 4 + 4 AS DOUBLE) AS d2,
         CAST(10 - id % 5 AS DOUBLE) AS p1, CAST(10 - id % 3 AS DOUBLE) AS p2
  FROM pairs WHERE response2 IS NOT NULL)"""

ORIENTED = """
o AS (
  SELECT id, prompt, chosen,
    CASE chosen WHEN 1 THEN response1 WHEN 2 THEN response2 END AS chosen_text,
    CASE chosen WHEN 1 THEN response2 WHEN 2 THEN response1 END AS rejected_text,
    CASE chosen WHEN 1 THEN q1 WHEN 2 THEN q2 END AS qc, CASE chosen WHEN 1 THEN q2 WHEN 2 THEN q1 END AS qr,
    CASE chosen WHEN 1 THEN d1 WHEN 2 THEN d2 END AS dc, CASE chosen WHEN 1 THEN d2 WHEN 2 THEN d1 END AS dr,
    CASE chosen WHEN 1 THEN p1 WHEN 2 THEN p2 END AS pc, CASE chosen WHEN 1 THEN p2 WHEN 2 THEN p1 END AS pr
  FROM j),
oc AS (
  SELECT *, abs(dc - dr) AS gap,
    CASE WHEN chosen IS NULL OR chosen NOT IN (1, 2) THEN 'failed'
         WHEN abs(dc - dr) < 2.0 THEN 'low_diversity'
         WHEN pc < 7.0 OR pr < 7.0 THEN 'low_privacy' ELSE 'kept' END AS outcome
  FROM o),
kept AS (SELECT * FROM oc WHERE outcome = 'kept')"""

JUDGE_BASE = _with(PAIRS, JUDGED, ORIENTED)

QUERIES["judge_outcomes"] = JUDGE_BASE + "SELECT outcome, count(*) AS n FROM oc GROUP BY outcome"

QUERIES["judge_kept_scores"] = JUDGE_BASE + """
SELECT id AS index, qc AS quality_chosen, qr AS quality_rejected, dc AS diversity_chosen,
       dr AS diversity_rejected, gap AS diversity_gap, pc AS privacy_chosen, pr AS privacy_rejected FROM kept"""

QUERIES["judge_averages"] = JUDGE_BASE + """
SELECT count(*) AS kept, round(avg(gap), 6) AS avg_diversity_gap, round(avg(pc), 6) AS avg_privacy_chosen,
       round(avg(pr), 6) AS avg_privacy_rejected FROM kept"""

QUERIES["export_dpo"] = JUDGE_BASE + """
SELECT prompt, chosen_text AS chosen, rejected_text AS rejected FROM kept"""

QUERIES["export_weighted"] = JUDGE_BASE + """
SELECT prompt, chosen_text AS chosen, rejected_text AS rejected,
       round(0.6 * gap / 10.0 + 0.4 * abs(pc - pr) / 10.0, 6) AS weight,
       round(gap / 10.0, 6) AS diversity_weight, round(abs(pc - pr) / 10.0, 6) AS privacy_weight FROM kept"""

QUERIES["export_ppo"] = JUDGE_BASE + """
SELECT prompt AS query, chosen_text AS response, round(qc * dc * pc / 1000.0, 6) AS reward FROM kept"""

QUERIES["weighted_loss"] = JUDGE_BASE + """,
l AS (SELECT ln(1 + exp(-(qc - qr) / 10.0)) AS loss, 0.6 * gap / 10.0 + 0.4 * abs(pc - pr) / 10.0 AS weight
      FROM kept)
SELECT count(*) AS n, round(avg(loss * weight), 6) AS mean_weighted_loss,
       round(avg(loss) * avg(weight), 6) AS loss_times_mean_weight FROM l"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE = r"\d{3}[-. ]\d{3}[-. ]\d{4}"


def _rule(t: str, s: str) -> str:
    w = f"regexp_extract_all(lower({t}), '\\S+')"
    return (f"least(10.0, CAST(floor(length({t}) / 50) AS DOUBLE)) AS q{s}, "
            f"CASE WHEN len({w}) > 0 THEN 10.0 * len(list_distinct({w})) / len({w}) ELSE 0.0 END AS d{s}, "
            f"CAST(greatest(0, 10 - 3 * (len(regexp_extract_all({t}, '{_EMAIL}')) "
            f"+ len(regexp_extract_all({t}, '{_PHONE}')))) AS DOUBLE) AS p{s}")


QUERIES["rule_judge_outcomes"] = _with(PAIRS) + f""",
s AS (SELECT id, prompt, response1, response2, {_rule('response1', '1')}, {_rule('response2', '2')}
      FROM pairs WHERE response2 IS NOT NULL),
j AS (SELECT *, CASE WHEN q1 + d1 + p1 >= q2 + d2 + p2 THEN 1 ELSE 2 END AS chosen FROM s),""" + ORIENTED + """
SELECT outcome, count(*) AS n, round(avg(gap), 6) AS avg_gap FROM oc GROUP BY outcome"""


# --- semantic metrics over embedding-derived records ------------------------

VEC = """
vt AS (
  SELECT vec_id // 8 AS rec_id, 'part' || CAST(vec_id // 96 AS VARCHAR) AS file_name,
         'v' || CAST(vec_id AS VARCHAR) AS tag, vec_id, s.side,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings CROSS JOIN (VALUES ('gold'), ('pred')) s(side)
  WHERE (s.side = 'gold' AND label < 6) OR (s.side = 'pred' AND label >= 4)),
recs AS (
  SELECT rec_id, any_value(file_name) AS file_name,
         count(*) FILTER (WHERE side = 'gold') AS ng, count(*) FILTER (WHERE side = 'pred') AS np
  FROM vt GROUP BY rec_id),
sims AS (
  SELECT g.rec_id, g.vec_id AS gid, g.tag AS gtag, p.vec_id AS pid, p.tag AS ptag,
         list_dot_product(g.v, p.v) / (sqrt(list_dot_product(g.v, g.v)) * sqrt(list_dot_product(p.v, p.v))) AS sim
  FROM vt g JOIN vt p ON g.rec_id = p.rec_id AND g.side = 'gold' AND p.side = 'pred'),
hits AS (
  SELECT r.rec_id, r.file_name, r.ng, r.np,
    (SELECT count(DISTINCT gid) FROM sims s WHERE s.rec_id = r.rec_id AND s.sim > 0.25) AS gh,
    (SELECT count(DISTINCT pid) FROM sims s WHERE s.rec_id = r.rec_id AND s.sim > 0.25) AS ph,
    (SELECT count(DISTINCT gid) FROM sims s WHERE s.rec_id = r.rec_id AND s.sim >= 0.25) AS gh2,
    (SELECT count(DISTINCT pid) FROM sims s WHERE s.rec_id = r.rec_id AND s.sim >= 0.25) AS ph2,
    (SELECT count(*) FROM sims s WHERE s.rec_id = r.rec_id AND s.gid = s.pid) AS inter
  FROM recs r),
m0 AS (
  SELECT *,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0 ELSE inter / np END AS ep,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0 ELSE inter / ng END AS er,
    CASE WHEN ng = 0 OR np = 0 THEN 0.0 ELSE gh / ng END AS sr,
    CASE WHEN ng = 0 OR np = 0 THEN 0.0 ELSE ph / np END AS sp,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0 ELSE gh / ng END AS sa,
    CASE WHEN ng = 0 OR np = 0 THEN 0.0 ELSE gh2 / ng END AS sr2,
    CASE WHEN ng = 0 OR np = 0 THEN 0.0 ELSE ph2 / np END AS sp2
  FROM hits),
m AS (
  SELECT *,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0
         WHEN ep + er > 0 THEN 2 * ep * er / (ep + er) ELSE 0.0 END AS ef,
    CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END AS sf,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0
         WHEN sp2 + sr2 > 0 THEN 2 * sp2 * sr2 / (sp2 + sr2) ELSE 0.0 END AS sft
  FROM m0)"""

QUERIES["semantic_by_record"] = _with(VEC) + """
SELECT rec_id, file_name, ng AS n_gold, np AS n_pred, round(ef, 6) AS exact_match_f1,
       round(sa, 6) AS semantic_accuracy, round(sf, 6) AS semantic_f1, round(sp, 6) AS semantic_precision,
       round(sr, 6) AS semantic_recall, round(sft, 6) AS sft_semantic_f1 FROM m"""

QUERIES["semantic_best_match"] = _with(VEC) + """,
ranked AS (
  SELECT rec_id, gid, gtag, ptag, sim,
         row_number() OVER (PARTITION BY rec_id, gid ORDER BY sim DESC, pid) AS rk FROM sims),
gpos AS (
  SELECT rec_id, vec_id AS gid, row_number() OVER (PARTITION BY rec_id ORDER BY vec_id) - 1 AS gold_pos
  FROM vt WHERE side = 'gold')
SELECT r.rec_id, g.gold_pos, r.gtag AS gold_tag, r.ptag AS pred_tag, round(r.sim, 6) AS similarity
FROM ranked r JOIN gpos g ON g.rec_id = r.rec_id AND g.gid = r.gid WHERE r.rk = 1"""

QUERIES["semantic_file_metrics"] = _with(VEC) + """
SELECT file_name, count(*) AS total_samples, count(*) FILTER (WHERE ng > 0) AS valid_samples,
  round(avg(ep) FILTER (WHERE ng > 0), 6) AS exact_match_precision,
  round(avg(er) FILTER (WHERE ng > 0), 6) AS exact_match_recall,
  round(avg(ef) FILTER (WHERE ng > 0), 6) AS exact_match_f1,
  round(avg(sa) FILTER (WHERE ng > 0), 6) AS semantic_accuracy,
  round(avg(sf) FILTER (WHERE ng > 0), 6) AS semantic_f1,
  round(avg(sp) FILTER (WHERE ng > 0), 6) AS semantic_precision,
  round(avg(sr) FILTER (WHERE ng > 0), 6) AS semantic_recall,
  count(*) FILTER (WHERE ng > 0 AND (ef < 0.5 OR sa < 0.5)) AS failed_cases_count
FROM m GROUP BY file_name HAVING count(*) FILTER (WHERE ng > 0) > 0"""


# --- prompts, budgets, splits, samples --------------------------------------

_MARK = "chr(10) || chr(10) || '[Content truncated]' || chr(10) || chr(10)"


def _trunc(text: str, tk: str, max_tokens: int) -> str:
    half = max_tokens // 2
    first = f"'^(?:\\s*\\S+){{{half}}}'"
    return (f"CASE WHEN len({tk}) <= {max_tokens} THEN {text} ELSE regexp_extract({text}, {first}, 0) || "
            f"{_MARK} || reverse(regexp_extract(reverse({text}), {first}, 0)) END")


_EVAL_TEMPLATE_SQL = (
    "'Assign tags to the text below. Answer with a JSON list of objects with the keys ' || "
    "'\"tag\" and \"explanation\", in this order: domain, task type, difficulty, language, ' || "
    "'then topics.' || chr(10) || chr(10) || 'Text:' || chr(10) || {t} || chr(10) || chr(10) || 'Tags:'")

QUERIES["prompt_build"] = """
WITH src AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN text END AS input, '[' || lang || '] ' || text AS prompt,
         CASE WHEN doc_id % 2 = 0 THEN 'source ' || source ELSE '' END AS context
  FROM documents),
ctx AS (
  SELECT doc_id, CASE WHEN context <> '' THEN coalesce(input, prompt) || chr(10) || chr(10) || context
                      ELSE coalesce(input, prompt) END AS ic FROM src),
tk AS (SELECT doc_id, ic, regexp_extract_all(ic, '\\S+') AS tk FROM ctx)
SELECT doc_id, len(tk) AS n_tokens, len(tk) > 300 AS truncated,
  '<start_of_turn>user' || chr(10) || """ + _EVAL_TEMPLATE_SQL.format(t=_trunc("ic", "tk", 300)) + """
  || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt_text
FROM tk"""

QUERIES["truncate_head_tail"] = """
WITH tk AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS tk FROM documents)
SELECT doc_id, len(tk) AS n_tokens, len(tk) > 600 AS truncated,
       """ + _trunc("text", "tk", 600) + """ AS truncated_text FROM tk"""

QUERIES["token_budget"] = _with(DOCS, GOLD_POS) + """,
gj AS (
  SELECT doc_id, to_json(list({'tag': tag, 'explanation':
           CASE pos WHEN 0 THEN 'the domain' WHEN 1 THEN 'the task type' WHEN 2 THEN 'the difficulty'
                    WHEN 3 THEN 'the language' ELSE 'the topic' END} ORDER BY pos)) AS target
  FROM gold_pos GROUP BY doc_id),
b0 AS (
  SELECT d.doc_id, d.file_name, regexp_extract_all(d.text, '\\S+') AS qt,
         coalesce(gj.target, '[]') || ' <eos>' AS target
  FROM d LEFT JOIN gj USING (doc_id)),
b1 AS (
  SELECT doc_id, file_name,
         len(regexp_extract_all('Tag this query.' || chr(10) || 'Query: ' || array_to_string(qt[1:1800], ' ')
                                || chr(10) || 'Tags:', '\\S+')) AS n_prompt,
         len(regexp_extract_all(target, '\\S+')) AS n_target FROM b0),
b AS (
  SELECT *, n_prompt + n_target AS n_total, least(n_prompt + n_target, 2048) AS n_kept,
         greatest(least(n_prompt + n_target, 2048) - n_prompt, 0) AS n_loss FROM b1)
SELECT file_name, count(*) AS rows, round(quantile_cont(n_kept, 0.5), 6) AS p50_len,
       round(quantile_cont(n_kept, 0.9), 6) AS p90_len, max(n_total) AS max_total,
       count(*) FILTER (WHERE n_total > 2048) AS truncated, count(*) FILTER (WHERE n_loss = 0) AS no_loss
FROM b GROUP BY file_name"""

QUERIES["per_file_limit"] = """
SELECT doc_id, file_name, rn FROM (
  SELECT doc_id, source AS file_name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM documents) WHERE rn <= 10"""

QUERIES["hash_split"] = """
SELECT doc_id, CASE WHEN substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccd' THEN 'train' ELSE 'eval' END AS split FROM documents"""

QUERIES["prefix_split"] = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < CAST(floor(0.8 * count(*) OVER ()) AS BIGINT)
                    THEN 'train' ELSE 'eval' END AS split FROM documents"""

QUERIES["eval_sample"] = """
SELECT doc_id FROM documents ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50"""

QUERIES["difference_score_top"] = """
WITH s AS (SELECT doc_id, -(n_chars % 97) / 10.0 - -(n_chars % 89) / 10.0 AS d FROM documents),
r AS (SELECT doc_id, d, row_number() OVER (ORDER BY d DESC, doc_id) AS rn, count(*) OVER () AS n FROM s)
SELECT doc_id, round(d, 6) AS score_diff FROM r WHERE rn <= CAST(floor(0.5 * n) AS BIGINT)"""

QUERIES["resume_remaining"] = """
SELECT doc_id, source AS file_name FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

QUERIES["run_delta"] = EVAL_BASE + """,
before_lists AS (
  SELECT l.doc_id, l.file_name, coalesce(g.names, []::VARCHAR[]) AS pred, l.gold FROM lists l
  LEFT JOIN (SELECT doc_id, list(tag ORDER BY pos) AS names FROM gen_pos GROUP BY doc_id) g USING (doc_id)),
bs AS (
  SELECT *, list_distinct(list_transform(pred, lambda x: trim(lower(x)))) AS ps,
            list_distinct(list_transform(gold, lambda x: trim(lower(x)))) AS gs FROM before_lists),
bp AS (
  SELECT *, CAST(len(list_intersect(ps, gs)) AS DOUBLE) AS inter FROM bs),
bq AS (
  SELECT file_name, gold, pred,
    CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 1.0 WHEN len(pred) = 0 OR len(gold) = 0 THEN 0.0
         ELSE inter / len(ps) END AS p,
    CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 1.0 WHEN len(pred) = 0 OR len(gold) = 0 THEN 0.0
         ELSE inter / len(gs) END AS r FROM bp),
bf AS (
  SELECT file_name, avg(CASE WHEN len(pred) = 0 AND len(gold) = 0 THEN 1.0 WHEN len(pred) = 0 OR len(gold) = 0
                             THEN 0.0 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END)
                    FILTER (WHERE len(gold) > 0) AS before_f1
  FROM bq GROUP BY file_name),
af AS (SELECT file_name, avg(f1) FILTER (WHERE len(gold) > 0) AS after_f1 FROM scored GROUP BY file_name)
SELECT file_name, round(before_f1, 6) AS before_f1, round(after_f1, 6) AS after_f1,
       round(after_f1 - before_f1, 6) AS delta FROM bf JOIN af USING (file_name)"""


# --- model-call and file round trips ----------------------------------------

QUERIES["two_temperature_responses"] = """
SELECT doc_id, r.response_id, r.temperature,
       '[{"tag": "words' || CAST(len(regexp_extract_all(text, '\\S+')) AS VARCHAR)
       || '", "explanation": "sampled at ' || CAST(r.temperature AS VARCHAR) || '"}]' AS text
FROM documents CROSS JOIN (VALUES (1::BIGINT, 0.5::DOUBLE), (2::BIGINT, 0.9::DOUBLE)) r(response_id, temperature)"""

QUERIES["jsonl_roundtrip"] = """
SELECT source AS file_name, count(*) AS records, 2 * count(*) AS responses,
       count(*) + count(*) FILTER (WHERE doc_id % 5 IN (0, 1) AND doc_id % 23 <> 0) AS parsed_lists
FROM documents GROUP BY source"""

QUERIES["preference_file_load"] = JUDGE_BASE + """
SELECT prompt, chosen_text AS chosen, rejected_text AS rejected,
       round(0.6 * gap / 10.0 + 0.4 * abs(pc - pr) / 10.0, 6) AS weight FROM kept"""

QUERIES["sft_extract_f1"] = _with(DOCS, GEN_POS, GOLD_POS) + """,
exp AS (SELECT doc_id, pos, tag FROM gen_pos WHERE doc_id % 5 IN (0, 1, 2, 3) AND doc_id % 23 <> 0),
lists AS (
  SELECT d.doc_id, d.file_name, coalesce(p.names, []::VARCHAR[]) AS pred, coalesce(g.names, []::VARCHAR[]) AS gold
  FROM d
  LEFT JOIN (SELECT doc_id, list(tag ORDER BY pos) AS names FROM exp GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, list(tag ORDER BY pos) AS names FROM gold_pos GROUP BY doc_id) g USING (doc_id)),
s AS (SELECT *, list_distinct(pred) AS ps, list_distinct(gold) AS gs FROM lists),
q AS (SELECT *, CAST(len(list_intersect(ps, gs)) AS DOUBLE) AS inter FROM s),
f AS (
  SELECT file_name, len(pred) AS np,
    CASE WHEN len(ps) = 0 AND len(gs) = 0 THEN 1.0 WHEN len(ps) = 0 OR len(gs) = 0 THEN 0.0
         WHEN inter = 0 THEN 0.0
         ELSE 2 * (inter / len(ps)) * (inter / len(gs)) / (inter / len(ps) + inter / len(gs)) END AS f1
  FROM q)
SELECT file_name, count(*) AS n, round(coalesce(avg(f1), 0.0), 6) AS mean_f1, CAST(sum(np) AS BIGINT) AS n_pred_tags
FROM f GROUP BY file_name"""


# --- additional report, judge and target queries ----------------------------

QUERIES["labelled_judgements"] = """
WITH l AS (
  SELECT doc_id AS id, CASE WHEN quality = 1 THEN 1 ELSE 2 END AS chosen,
         CAST(4 + 4 * quality AS DOUBLE) AS q1, CAST(8 - 4 * quality AS DOUBLE) AS q2,
         CAST(doc_id % 7 + 2 AS DOUBLE) AS d1, CAST(doc_id % 3 + 4 AS DOUBLE) AS d2,
         CAST(10 - 6 * toxic AS DOUBLE) AS p1, 9.0 AS p2 FROM labels),
j AS (SELECT d.doc_id AS id, d.source AS file_name, l.* EXCLUDE (id) FROM documents d LEFT JOIN l ON l.id = d.doc_id),
o AS (
  SELECT *, CASE chosen WHEN 1 THEN d1 WHEN 2 THEN d2 END AS dc, CASE chosen WHEN 1 THEN d2 WHEN 2 THEN d1 END AS dr,
            CASE chosen WHEN 1 THEN p1 WHEN 2 THEN p2 END AS pc, CASE chosen WHEN 1 THEN p2 WHEN 2 THEN p1 END AS pr
  FROM j)
SELECT CASE WHEN chosen IS NULL THEN 'failed' WHEN abs(dc - dr) < 2.0 THEN 'low_diversity'
            WHEN pc < 7.0 OR pr < 7.0 THEN 'low_privacy' ELSE 'kept' END AS outcome, count(*) AS n
FROM o GROUP BY 1"""

QUERIES["filter_top_tags"] = PREF_BASE + """
SELECT pos, rank, tag, n, CASE WHEN pos IN (0, 1, 2) THEN n >= 2 END AS passes FROM (
  SELECT pos, tag, n, row_number() OVER (PARTITION BY pos ORDER BY n DESC, tag) AS rank FROM freq)
WHERE pos IN (0, 1, 2) OR rank <= 10"""

QUERIES["report_long_form"] = _with(DOCS, GEN_POS, GOLD_POS, PRED_POS) + """,
sides AS (
  SELECT file_name, 'generated' AS section, pos, tag FROM pred_pos
  UNION ALL SELECT file_name, 'ground_truth', pos, tag FROM gold_pos),
c AS (SELECT file_name, section, pos, tag, count(*) AS n FROM sides WHERE pos < 4 GROUP BY ALL),
t0 AS (SELECT file_name, tag, count(*) AS n FROM pred_pos WHERE pos >= 4 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY file_name) AS total,
             row_number() OVER (PARTITION BY file_name ORDER BY n DESC, tag) AS rk FROM t0)
SELECT file_name, section, pos, tag, n,
       round(n * 100.0 / sum(n) OVER (PARTITION BY file_name, section, pos), 6) AS pct FROM c
UNION ALL
SELECT file_name, 'topics', 4, tag, n, round(n * 100.0 / total, 6) FROM t WHERE rk <= 30"""

QUERIES["rows_per_file"] = "SELECT source AS file_name, count(*) AS rows FROM documents GROUP BY source"

QUERIES["sft_targets"] = _with(DOCS, GOLD_POS) + """,
gj AS (
  SELECT doc_id, to_json(list({'tag': tag, 'explanation':
           CASE pos WHEN 0 THEN 'the domain' WHEN 1 THEN 'the task type' WHEN 2 THEN 'the difficulty'
                    WHEN 3 THEN 'the language' ELSE 'the topic' END} ORDER BY pos)) AS j
  FROM gold_pos GROUP BY doc_id)
SELECT d.doc_id, coalesce(gj.j, '[]') || ' <eos>' AS target FROM d LEFT JOIN gj USING (doc_id)"""


# Bag-of-letters vectors of the document tags (same encoder as metrics.letter_bag).
DOC_VEC = """
sides AS (
  SELECT doc_id, file_name, 'gold' AS side, pos, tag FROM gold_pos
  UNION ALL SELECT doc_id, file_name, 'pred', pos, tag FROM pred_pos),
sv AS (SELECT *, [CAST(length(lower(tag)) - length(replace(lower(tag), 'a', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'b', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'c', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'd', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'e', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'f', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'g', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'h', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'i', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'j', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'k', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'l', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'm', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'n', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'o', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'p', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'q', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'r', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 's', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 't', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'u', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'v', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'w', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'x', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'y', '')) AS DOUBLE), CAST(length(lower(tag)) - length(replace(lower(tag), 'z', '')) AS DOUBLE)] AS v FROM sides),
svn AS (SELECT *, sqrt(list_dot_product(v, v)) AS nv FROM sv),
dsims AS (
  SELECT g.doc_id, g.pos AS gpos, p.pos AS ppos,
         CASE WHEN g.nv = 0 OR p.nv = 0 THEN 0.0 ELSE list_dot_product(g.v, p.v) / (g.nv * p.nv) END AS sim
  FROM svn g JOIN svn p ON g.doc_id = p.doc_id AND g.side = 'gold' AND p.side = 'pred'),
dh AS (
  SELECT doc_id,
    count(DISTINCT gpos) FILTER (WHERE sim > 0.8) AS gh, count(DISTINCT ppos) FILTER (WHERE sim > 0.8) AS ph
  FROM dsims GROUP BY doc_id),
dm0 AS (
  SELECT s.doc_id, s.file_name, s.p, s.r, s.f1, len(s.gold) AS ng, len(s.pred) AS np,
         coalesce(dh.gh, 0) AS gh, coalesce(dh.ph, 0) AS ph
  FROM scored s LEFT JOIN dh USING (doc_id)),
dm AS (
  SELECT *,
    CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng = 0 OR np = 0 THEN 0.0 ELSE gh / ng END AS sa,
    CASE WHEN ng = 0 OR np = 0 THEN 0.0 ELSE gh / ng END AS sr,
    CASE WHEN ng = 0 OR np = 0 THEN 0.0 ELSE ph / np END AS sp
  FROM dm0),
dmf AS (SELECT *, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END AS sf FROM dm)"""

QUERIES["semantic_doc_file_metrics"] = EVAL_BASE + "," + DOC_VEC + """
SELECT file_name, count(*) AS total_samples, count(*) FILTER (WHERE ng > 0) AS valid_samples,
  round(avg(p) FILTER (WHERE ng > 0), 6) AS exact_match_precision,
  round(avg(r) FILTER (WHERE ng > 0), 6) AS exact_match_recall,
  round(avg(f1) FILTER (WHERE ng > 0), 6) AS exact_match_f1,
  round(avg(sa) FILTER (WHERE ng > 0), 6) AS semantic_accuracy,
  round(avg(sf) FILTER (WHERE ng > 0), 6) AS semantic_f1,
  round(avg(sp) FILTER (WHERE ng > 0), 6) AS semantic_precision,
  round(avg(sr) FILTER (WHERE ng > 0), 6) AS semantic_recall,
  count(*) FILTER (WHERE ng > 0 AND (f1 < 0.5 OR sa < 0.5)) AS failed_cases_count
FROM dmf GROUP BY file_name HAVING count(*) FILTER (WHERE ng > 0) > 0"""


QUERIES["prompt_truncation_counts"] = """
WITH src AS (
  SELECT doc_id, source AS file_name, CASE WHEN lang = 'en' THEN text END AS input,
         '[' || lang || '] ' || text AS prompt,
         CASE WHEN doc_id % 2 = 0 THEN 'source ' || source ELSE '' END AS context
  FROM documents),
ctx AS (
  SELECT file_name, CASE WHEN context <> '' THEN coalesce(input, prompt) || chr(10) || chr(10) || context
                         ELSE coalesce(input, prompt) END AS ic FROM src),
tk AS (SELECT file_name, len(regexp_extract_all(ic, '\\S+')) AS n FROM ctx)
SELECT file_name, count(*) AS rows, count(*) FILTER (WHERE n > 300) AS truncated,
       round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens FROM tk GROUP BY file_name"""

# Every eligible judged pair is written; a failed reply has no weight (JSON
# null), which the loader rejects; the other checks pass for these rows.
QUERIES["preference_load_reasons"] = JUDGE_BASE + """
SELECT CASE WHEN chosen IN (1, 2) THEN 'ok' ELSE 'weight' END AS reason, count(*) AS n
FROM oc GROUP BY 1"""


QUERIES["failed_cases"] = QUERIES["failed_cases"].replace("{TRUNC600}", _trunc("text", "tk", 600))



# --- files, jobs and streams ----------------------------------------------

QUERIES["json_document_rows"] = """
SELECT doc_id, n_chars, length(text) AS text_length FROM documents"""

QUERIES["tolerant_reader_rows"] = "SELECT doc_id AS index FROM documents WHERE doc_id % 8 IN (4, 5, 7)"

QUERIES["tolerant_reader_rejects"] = """
SELECT CASE doc_id % 8 WHEN 0 THEN 'blank' WHEN 2 THEN 'empty_object' WHEN 3 THEN 'not_object' ELSE 'invalid' END AS reason,
       count(*) AS n
FROM documents WHERE doc_id % 8 IN (0, 1, 2, 3, 6) GROUP BY reason"""

QUERIES["judge_input_rows"] = "SELECT doc_id AS index, n_chars AS second_item FROM documents"

QUERIES["row_range_rows"] = """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100"""

QUERIES["concat_counts"] = """
SELECT 'documents' AS origin, count(*) AS n, count(lang) AS with_lang, CAST(0 AS BIGINT) AS with_role,
       CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
UNION ALL SELECT 'conversations', count(*), 0, count(role), CAST(sum(length(text)) AS BIGINT) FROM conversations"""

QUERIES["evaluate_files_metrics"] = """
SELECT count(*) AS total_samples, count(*) AS valid_samples,
       round(avg(CASE WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_match_f1,
       count(*) FILTER (WHERE n_chars % 2 <> 0) AS failed_cases_count
FROM documents WHERE doc_id % 7 <> 0"""

QUERIES["resume_twice"] = "SELECT doc_id, n_chars FROM documents"

QUERIES["running_tag_counts"] = """
SELECT CAST(pos AS BIGINT) AS pos, tag, count(*) AS n
FROM (SELECT 0 AS pos, lang AS tag FROM documents UNION ALL SELECT 1, source FROM documents) GROUP BY pos, tag"""

QUERIES["generation_record_rows"] = """
SELECT doc_id AS index, '{"index":' || doc_id || ',"lang":"' || lang || '"}' AS original_data,
       length(text) AS prompt_chars, CAST(2 AS BIGINT) AS n_responses,
       '[{"tag": "words' || len(regexp_extract_all(text, '\\S+')) || '", "explanation": "sampled at 0.9"}]' AS second_text,
       CAST(NULL AS VARCHAR) AS error
FROM documents"""

QUERIES["sft_run_record"] = """
WITH s AS (SELECT n_chars % 2 = 0 AS yes, substr(md5('0:' || doc_id), 1, 8) >= 'cccccccd' AS held FROM documents)
SELECT 'sft' AS run, count(*) FILTER (WHERE NOT held) AS n_train, count(*) FILTER (WHERE held) AS n_eval,
       round(coalesce(avg(CAST(yes AS INTEGER)) FILTER (WHERE held), 0), 6) AS before_f1,
       round(coalesce(avg(CAST(NOT yes AS INTEGER)) FILTER (WHERE held), 0), 6) AS after_f1 FROM s"""

QUERIES["resume_failed_rounds"] = """
WITH f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS first FROM documents)
SELECT CASE WHEN doc_id % 7 > 0 THEN doc_id END AS key, CAST(doc_id AS VARCHAR) AS body, n_chars,
       CAST(first + CASE WHEN (n_chars + first) % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS round FROM f"""

QUERIES["generation_job"] = f"""
SELECT doc_id AS index, length(text) AS prompt_chars, length(text) + {len(TEMPLATES['generation']) - len('{query}')} AS tagging_chars,
       'stand-in' AS model, CAST(2 AS BIGINT) AS n_responses,
       CASE WHEN length(text) % 2 = 0 THEN 'round 1' ELSE 'round 2' END AS second_text, true AS timed, CAST(NULL AS VARCHAR) AS error
FROM documents"""

QUERIES["first_failed_cases"] = """
SELECT source, case_rank, truncated_input FROM (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS case_rank, doc_id || ' ' || lang AS truncated_input
  FROM documents WHERE n_chars % 3 <> 0)
WHERE case_rank <= 5"""

PIECES = r"""'[^\x20\x09-\x0D]{1,3}|[\x20\x09-\x0D]'"""

QUERIES["subword_truncation"] = f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, {PIECES}) AS tk FROM documents)
SELECT doc_id, len(tk) AS n_tokens, md5(CASE WHEN len(tk) <= 600 THEN text ELSE array_to_string(tk[1:300], '')
    || chr(10) || chr(10) || '[Content truncated]' || chr(10) || chr(10) || array_to_string(tk[len(tk) - 299:len(tk)], '') END) AS truncated_md5
FROM t"""

QUERIES["subword_budget"] = f"""
WITH t AS (SELECT doc_id, lang || ' ' || source AS target, array_to_string(regexp_extract_all(text, {PIECES})[1:1800], '') AS query FROM documents),
p AS (SELECT doc_id, target, 'Tag this query.' || chr(10) || 'Query: ' || query || chr(10) || 'Tags:' AS prompt FROM t),
n AS (SELECT doc_id, len(regexp_extract_all(prompt, {PIECES})) AS n_prompt,
             len(regexp_extract_all(prompt || target || ' <eos>', {PIECES})) AS n_total FROM p),
k AS (SELECT *, least(n_total, 2048) AS n_kept FROM n)
SELECT *, greatest(n_kept - n_prompt, 0) AS n_loss, n_total > 2048 AS truncated, greatest(n_kept - n_prompt, 0) = 0 AS no_loss FROM k"""


def _filled(template: str, **fields: str) -> str:
    """A template as a SQL concatenation."""
    quoted = ["'" + x.replace("'", "''").replace(chr(10), "' || chr(10) || '") + "'" if i % 2 == 0 else fields[x]
              for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return " || ".join(quoted)


QUERIES["template_prompts"] = "SELECT doc_id, " + ", ".join(
    f"md5({_filled(TEMPLATES[n], query='text', tags='lang', first='lang', second='source')}) AS {n}_md5"
    for n in ("generation", "preference", "judge")) + " FROM documents"

QUERIES["concurrent_responses"] = QUERIES["two_temperature_responses"]

QUERIES["embedding_cache_reuse"] = """
WITH t AS (SELECT source || '-' || lang || '-' || (n_chars % 50) AS tag, min(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END) AS mark
           FROM documents GROUP BY 1)
SELECT tag, round(length(tag) / sqrt(length(tag) * length(tag) + mark * mark), 6) AS v0,
       round(mark / sqrt(length(tag) * length(tag) + mark * mark), 6) AS v1 FROM t"""

QUERIES["preference_dir_rows"] = """
SELECT CAST(doc_id AS VARCHAR) AS prompt, lang AS chosen, source AS rejected,
       CASE WHEN doc_id % 4 = 3 THEN n_chars END AS weight, doc_id % 4 = 3 AS has_weight
FROM documents WHERE doc_id % 4 >= 2"""

QUERIES["positional_record_rows"] = """
SELECT doc_id AS index, length(text) AS prompt_chars, lang AS first_tag, source AS second_tag
FROM documents WHERE doc_id % 3 < 2"""

QUERIES["judge_model_outcomes"] = _with(PAIRS) + """,
called AS (
  SELECT *, length(response1) AS a, length(response2) AS b FROM pairs WHERE response2 IS NOT NULL),
replied AS (
  SELECT a, b, (a + b) % 19 <> 0 AS reply, (a + b) % 19 <> 0 AND (a + b) % 17 <> 0 AS usable,
         abs(a % 8 - b % 8) AS gap, least(10 - a % 5, 10 - b % 5) AS privacy FROM called)
SELECT CASE WHEN NOT usable THEN 'failed' WHEN gap < 2 THEN 'low_diversity' WHEN privacy < 7 THEN 'low_privacy' ELSE 'kept' END AS outcome,
       count(*) AS n, count(*) FILTER (WHERE reply) AS with_reasoning, round(avg(CASE WHEN usable THEN gap END), 6) AS avg_gap
FROM replied GROUP BY 1"""

# The vectors of some names are missing: their pairs have similarity 0, and
# records without any pair of vectors fall back to the exact F1.
_KNOWN = "(({0} % 3 <> 0) AND ({0} // 8 % 5 <> 0))"
QUERIES["semantic_missing_vectors"] = _with(VEC.replace(" AS sim\n", f" * CAST({_KNOWN.format('g.vec_id')} AND {_KNOWN.format('p.vec_id')} AS INTEGER) AS sim,"
    f" {_KNOWN.format('g.vec_id')} AND {_KNOWN.format('p.vec_id')} AS known\n")) + """,
enc AS (SELECT rec_id, bool_or(known) AS encoded FROM sims GROUP BY rec_id)
SELECT m.rec_id, coalesce(encoded, false) AS encoded, round(sa, 6) AS semantic_accuracy, round(sf, 6) AS semantic_f1,
       round(CASE WHEN ng > 0 AND np > 0 AND NOT coalesce(encoded, false) THEN ef ELSE sft END, 6) AS sft_semantic_f1
FROM m LEFT JOIN enc USING (rec_id)"""

QUERIES["encoded_tags"] = _with(DOCS, GEN_POS) + """,
t AS (SELECT DISTINCT tag FROM gen_pos),
c AS (SELECT tag, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: CAST(length(tag) - length(replace(tag, v, '')) AS DOUBLE)) AS n FROM t),
u AS (SELECT tag, n, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS len FROM c)
SELECT tag, """ + ", ".join(f"round(CASE WHEN len > 0 THEN n[{i + 1}] / len ELSE 0 END, 6) AS v{i}" for i in range(5)) + " FROM u"
