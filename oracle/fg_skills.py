"""Skills, review gate and match scores."""

from oracle.e_flags import FLAG, ctx_sql, flag_sql, lack_sql
from rolefit import refdata as R


def _hint_sql(skill: str) -> str:
    rows = []
    for i, (names, _) in enumerate(R.SKILL_HINTS):
        rows.append(f"WHEN {' OR '.join(f'''contains(lower({skill}), '{n}')''' for n in names)} THEN {i}")
    return "CASE " + " ".join(rows) + " END"


def _score_sql(group: str, text: str) -> str:
    rows = []
    for i, (_, terms) in enumerate(R.SKILL_HINTS):
        rows.append(f"WHEN {i} THEN " + " + ".join(f"CAST(contains(lower({text}), '{t}') AS INT)" for t in terms))
    return f"CASE {group} " + " ".join(rows) + " END"


HELPERS = {
    "ctx1_v": ctx_sql("pair_v"),
    "lackcert1_v": lack_sql("ctx1_v"),
    "flag1_v": flag_sql("ctx1_v", "lackcert1_v", domain=True),
    "orderedflag1_v": f"""SELECT resume_id, job_id, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY prio, check_ord, item_ord) - 1 AS ord,
  {FLAG} FROM flag1_v""",
    "ack_v": """SELECT resume_id, job_id, category FROM confirmation_v, (SELECT unnest(['experience_gap', 'certification_missing', 'domain_mismatch']) AS category)
WHERE CASE category WHEN 'experience_gap' THEN ack_experience WHEN 'domain_mismatch' THEN ack_domain ELSE ack_certification END""",
    # status per pair and distinct job skill; the hit rule is the one of the keywords
    "item_v": """
SELECT h.resume_id, h.job_id, h.keyword AS skill, CASE WHEN in_skills THEN 'matched' WHEN in_all THEN 'can_add'
    WHEN g.own IS NOT NULL THEN 'partial' ELSE 'missing' END AS status, CASE WHEN NOT in_all THEN g.own END AS related_skill
FROM (SELECT resume_id, job_id, keyword, bool_or(hit) FILTER (scope = 'all') AS in_all, bool_or(hit) FILTER (scope = 'skills') AS in_skills
      FROM hit_v GROUP BY ALL) h
LEFT JOIN (SELECT resume_id, regexp_replace(s, '(ation|tion|ment|ing|ed|er|al|ly|s)$', '') AS grp, min(s) AS own FROM (
    SELECT resume_id, unnest(list_concat(skills, tech_stack)) AS s FROM resume_v) GROUP BY ALL) g
  ON g.resume_id = h.resume_id AND g.grp = regexp_replace(h.keyword, '(ation|tion|ment|ing|ed|er|al|ly|s)$', '')""",
    "decision_v": """SELECT resume_id, job_id, skill, CASE WHEN length(skill) <= 7 THEN job_id % 2 = 0 END AS add FROM item_v
WHERE status IN ('can_add', 'partial')""",
    "present2_v": """
SELECT p.resume_id, p.job_id, k.i - 1 AS pos, k.keyword FROM pair_v p
JOIN (SELECT job_id, unnest(range(1, len(hard_keywords) + 1)) AS i, unnest(hard_keywords) AS keyword FROM job_v) k USING (job_id)
JOIN (SELECT resume_id, lower(coalesce(summary, '') || ' ' || array_to_string(skills, ' ') || ' ' || array_to_string(tech_stack, ' ')
  || ' ' || array_to_string(bullets, ' ')) AS text FROM rewritten_v) t USING (resume_id)
WHERE contains(t.text, lower(k.keyword))""",
    "addition_v": """
SELECT resume_id, job_id, skill, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY kind, pos, skill) AS n FROM (
  SELECT resume_id, job_id, 0 AS kind, 0 AS pos, skill FROM decision_v WHERE add
  UNION ALL SELECT resume_id, job_id, 1, pos, keyword FROM present2_v)""",
    "firstaddition_v": """SELECT resume_id, job_id, skill, n FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_id, job_id, lower(skill) ORDER BY n) AS k FROM addition_v) WHERE k = 1""",
    "newskill_v": """SELECT doc_id, unnest(range(5)) AS ord,
  unnest(['Docker', 'PostgreSQL', 'GPT-4 API', 'Leadership', 'System design']) AS skill FROM documents""",
    "category_v": rf"""
SELECT doc_id, page, block, entry, text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY page, block, entry) AS k FROM entry_v
  WHERE length(text) > 20 AND regexp_matches(first_line, '{R.CATEGORY_LABEL_RE}') AND NOT regexp_matches(first_line, '^[{R.BULLET_CHARS}]\s')
    AND length(trim(string_split(first_line, ':')[1])) <= 50
    AND regexp_extract(ltrim(lower(substr(first_line, length(trim(string_split(first_line, ':')[1])) + 2))), '^\S*') NOT IN {R.SENTENCE_VERBS!r})
WHERE k = 1""",
    "route_v": f"""
SELECT doc_id, ord, skill, CASE WHEN grp IS NULL THEN longest WHEN best > 0 THEN by_hint ELSE first_line END AS target FROM (
  SELECT doc_id, ord, skill, any_value(grp) AS grp, bool_or(contains(lower(text), lower(skill))) AS named, max(score) AS best,
    first(text ORDER BY score DESC, page, block, entry) AS by_hint, first(text ORDER BY page, block, entry) AS first_line,
    first(text ORDER BY length(text) DESC, page, block, entry) AS longest
  FROM (SELECT *, {_score_sql('grp', 'text')} AS score FROM (
    SELECT s.doc_id, s.ord, s.skill, c.text, c.page, c.block, c.entry, {_hint_sql('s.skill')} AS grp
    FROM newskill_v s JOIN category_v c USING (doc_id)))
  GROUP BY ALL) WHERE NOT named""",
    "match_v": """
SELECT p.resume_id, p.job_id, round_even(greatest(coalesce(dot / nullif(rn * jn, 0), 0), 0) * 100, 2) AS match_score FROM (
  SELECT p.resume_id, p.job_id, list_sum(list_transform(list_zip(r.embedding, j.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS dot,
    sqrt(list_sum(list_transform(r.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS rn,
    sqrt(list_sum(list_transform(j.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS jn
  FROM (SELECT DISTINCT l_partkey AS resume_id, l_suppkey AS job_id FROM lineitem) p
  JOIN embeddings r ON r.vec_id = p.resume_id JOIN embeddings j ON j.vec_id = p.job_id) p""",
    "uplift_v": """
SELECT resume_id, job_id, match_before, match_after, round_even(match_after - match_before, 2) AS match_delta FROM (
  SELECT resume_id, job_id, match_score AS match_before,
    CASE WHEN match_score > 0 THEN greatest(round_even(100 - match_score, 2), match_score) ELSE least(match_score + 15, 98) END AS match_after
  FROM match_v)""",
    "evidence_v": """
SELECT p.resume_id, p.job_id,
  coalesce(nullif(concat_ws(chr(10), CASE WHEN c.summary <> '' THEN 'Summary: ' || c.summary END, h.jobs), ''), 'No resume text available.') AS evidence,
  c.primary_domain AS domain_candidate, coalesce(c.total_years, 0) AS years, '' AS tech_stack, array_to_string(c.skills, ', ') AS skills,
  q.seniority_raw AS job_title, q.primary_domain AS domain_job, coalesce(q.min_years, 0) AS min_years, coalesce(q.max_years, 0) AS max_years,
  array_to_string(q.certifications_required, ', ') AS required_skills, '' AS technologies
FROM pair2_v p JOIN candidate_v c USING (resume_id) JOIN posting_v q USING (job_id)
LEFT JOIN (SELECT resume_id, string_agg(title || ' @ ' || company || ': Worked as ' || title || '; At ' || company, chr(10) ORDER BY pos) AS jobs
           FROM history_v GROUP BY 1) h USING (resume_id)""",
}

QUERIES = {
    "g1_top_jobs_all": """
SELECT resume_id, job_id, match_score, row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, job_id) AS rank FROM (
  SELECT a.vec_id AS resume_id, b.vec_id AS job_id, round_even(greatest(list_inner_product(a.v, b.v)
    / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0), 0) * 100, 2) AS match_score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b WHERE a.vec_id % 50 = 0)
QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, job_id) <= 5""",
    "e9_flag_gate": """
SELECT p.resume_id, p.job_id, coalesce(f.n, 0) AS open_red, coalesce(s.n, 0) AS open_skills,
  coalesce(f.n, 0) = 0 AND coalesce(s.n, 0) = 0 AS can_proceed
FROM pair_v p
LEFT JOIN (SELECT resume_id, job_id, count(*) AS n FROM flag1_v LEFT JOIN ack_v a USING (resume_id, job_id, category)
           WHERE flag_type = 'red' AND requires_acknowledgement AND a.resume_id IS NULL GROUP BY ALL) f USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, count(*) AS n FROM item_v WHERE status IN ('can_add', 'partial') AND length(skill) > 7 GROUP BY ALL) s
  USING (resume_id, job_id)""",
    "e9_known_gaps": "SELECT resume_id, job_id, ord, title FROM orderedflag1_v JOIN ack_v USING (resume_id, job_id, category)",
    "f1_skill_breakdown": "SELECT resume_id, job_id, skill, status, related_skill FROM item_v",
    "f2_skill_summary": """
SELECT resume_id, job_id, coalesce(matched, 0) AS matched, coalesce(can_add, 0) AS can_add, coalesce(partial, 0) AS partial,
  coalesce(missing, 0) AS missing, coalesce(d.n_add, 0) AS n_add, coalesce(d.n_skip, 0) AS n_skip FROM pair_v LEFT JOIN (
  SELECT resume_id, job_id, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'can_add') AS can_add,
    count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'missing') AS missing FROM item_v GROUP BY ALL) i USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, count(*) FILTER (add) AS n_add, count(*) FILTER (NOT add) AS n_skip FROM decision_v GROUP BY ALL) d
  USING (resume_id, job_id)""",
    "f3_skill_merge": """
SELECT resume_id, job_id, concat_ws('|', nullif(array_to_string(any_value(skills), '|'), ''),
    string_agg(skill, '|' ORDER BY n) FILTER (skill IS NOT NULL AND NOT list_contains(list_transform(skills, lambda s: lower(s)), lower(skill)))) AS skills,
  concat_ws('|', nullif(array_to_string(any_value(tech_stack), '|'), ''),
    string_agg(skill, '|' ORDER BY n) FILTER (skill IS NOT NULL AND NOT list_contains(list_transform(tech_stack, lambda s: lower(s)), lower(skill)))) AS tech_stack
FROM pair_v LEFT JOIN firstaddition_v USING (resume_id, job_id) JOIN resume_v USING (resume_id) GROUP BY resume_id, job_id""",
    "f4_skill_route": "SELECT doc_id, ord, skill, target FROM route_v",
    "f4_routed_lines": r"""
SELECT doc_id, target AS original, regexp_replace(target, '[. ]+$', '') || ', ' || string_agg(skill, ', ' ORDER BY ord) AS updated
FROM route_v GROUP BY doc_id, target""",
    "f5_category_lines": "SELECT doc_id, page, block, entry, text FROM category_v",
    "g1_semantic_match": "SELECT * FROM match_v",
    "g1_top_jobs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, job_id) AS rank FROM match_v)
WHERE rank <= 3""",
    "g2_match_uplift": "SELECT * FROM uplift_v",
    "g3_evidence_table": "SELECT * FROM evidence_v",
    "g3_evidence_sizes": """SELECT job_id, count(*) AS n, min(length(evidence)) AS min_chars, max(length(evidence)) AS max_chars,
  CAST(sum(length(evidence)) AS BIGINT) AS sum_chars FROM evidence_v GROUP BY 1""",
}
