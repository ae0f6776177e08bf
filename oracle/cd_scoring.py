"""Keyword matching and scores: brute-force forms of the rules."""

_SUFFIXES = "['ation','tion','ment','ing','ed','er','al','ly','s']"
_ENDINGS = "['','s','es','d','ed','ing','r','er','ment','tion','ation','al','ly']"


def scope_sql(resumes: str) -> str:
    return f"""
SELECT resume_id, 'all' AS scope, lower(array_to_string(skills, ' ') || ' ' || array_to_string(tech_stack, ' ') || ' '
    || array_to_string(bullets, ' ') || ' ' || coalesce(summary, '')) AS text FROM {resumes}
UNION ALL SELECT resume_id, 'summary', lower(coalesce(summary, '')) FROM {resumes}
UNION ALL SELECT resume_id, 'skills', lower(array_to_string(list_concat(skills, tech_stack), ' ')) FROM {resumes}"""


def token_sql(scope: str) -> str:
    return f"""SELECT DISTINCT resume_id, scope, token FROM (
  SELECT resume_id, scope, unnest(regexp_split_to_array(text, '[^a-z0-9]+')) AS token FROM {scope}) WHERE token <> ''"""


def hit_sql(scope: str, token: str, pairs: str = "pair_v") -> str:
    """Hits per pair, keyword and scope: literal, or every long word has a form among the tokens."""
    return f"""
SELECT p.resume_id, p.job_id, k.kind, k.pos, k.keyword, s.scope,
  contains(s.text, k.keyword) OR ((w.n_words > 1 OR (w.n_words = 1 AND w.n_long > 0))
    AND w.n_long = coalesce(f.n_found, 0)) AS hit
FROM {pairs} p JOIN jobkw_v k USING (job_id) JOIN kwsize_v w USING (keyword) JOIN {scope} s USING (resume_id)
LEFT JOIN (
  SELECT m.resume_id, m.scope, kw.keyword, count(*) AS n_found FROM (
    SELECT DISTINCT t.resume_id, t.scope, v.word FROM {token} t JOIN variant_v v ON t.token = v.variant) m
  JOIN (SELECT DISTINCT keyword, word FROM kwword_v WHERE length(word) >= 3) kw USING (word)
  GROUP BY ALL) f ON f.resume_id = p.resume_id AND f.scope = s.scope AND f.keyword = k.keyword"""


def score_sql(hits: str, pairs: str = "pair_v") -> str:
    return f"""
SELECT p.resume_id, p.job_id,
  CASE WHEN c.job_id IS NULL THEN 15.0::DOUBLE ELSE least(round_even(
    c.hard_all::DOUBLE / greatest(c.n_hard, 1) * 20 + c.soft_all::DOUBLE / greatest(c.n_soft, 1) * 10, 1), 30.0) END AS keyword_match,
  CASE WHEN coalesce(c.n_hard, 0) = 0 THEN 8.0::DOUBLE ELSE least(round_even(
    c.first_sum::DOUBLE / greatest(c.n_first, 1) * 8 + c.first_skl::DOUBLE / greatest(c.n_first, 1) * 7, 1), 15.0) END AS keyword_placement
FROM {pairs} p LEFT JOIN (
  SELECT resume_id, job_id,
    count(*) FILTER (kind = 'hard' AND scope = 'all') AS n_hard, count(*) FILTER (kind = 'soft' AND scope = 'all') AS n_soft,
    count(*) FILTER (kind = 'hard' AND scope = 'all' AND hit) AS hard_all,
    count(*) FILTER (kind = 'soft' AND scope = 'all' AND hit) AS soft_all,
    count(*) FILTER (kind = 'hard' AND scope = 'all' AND pos < 15) AS n_first,
    count(*) FILTER (kind = 'hard' AND scope = 'summary' AND pos < 15 AND hit) AS first_sum,
    count(*) FILTER (kind = 'hard' AND scope = 'skills' AND pos < 15 AND hit) AS first_skl
  FROM {hits} GROUP BY resume_id, job_id) c USING (resume_id, job_id)"""


def completeness_sql(header: str, history: str) -> str:
    return f"""
SELECT h.resume_id, least(round_even(
    CASE WHEN coalesce(h.full_name, '') NOT IN ('', 'Unknown') THEN 1.0::DOUBLE ELSE 0 END
    + CASE WHEN coalesce(h.email, '') <> '' THEN 1.5 ELSE 0 END + CASE WHEN coalesce(h.phone, '') <> '' THEN 1.5 ELSE 0 END
    + CASE WHEN length(coalesce(h.summary, '')) > 30 THEN 4 ELSE 0 END
    + CASE WHEN len(h.skills) >= 3 THEN 4 WHEN len(h.skills) > 0 THEN 2 ELSE 0 END
    + CASE WHEN x.dated IS NULL THEN 0 WHEN x.dated THEN 4 ELSE 2 END
    + CASE WHEN e.dated IS NULL THEN 0 WHEN e.dated THEN 4 ELSE 2 END, 1), 20.0::DOUBLE) AS section_completeness
FROM {header} h
LEFT JOIN (SELECT resume_id, bool_and(coalesce(start_date, '') <> '' AND coalesce(end_date, '') <> '') AS dated
           FROM {history} GROUP BY 1) x USING (resume_id)
LEFT JOIN (SELECT resume_id, bool_and(coalesce(year, '') <> '') AS dated FROM education_v GROUP BY 1) e USING (resume_id)"""


HELPERS = {
    "jobkw_v": """
SELECT job_id, 'hard' AS kind, i - 1 AS pos, lower(hard_keywords[i]) AS keyword
  FROM job_v, LATERAL (SELECT unnest(range(1, len(hard_keywords) + 1)) AS i)
UNION ALL
SELECT job_id, 'soft', i - 1, lower(soft_keywords[i])
  FROM job_v, LATERAL (SELECT unnest(range(1, len(soft_keywords) + 1)) AS i)""",
    "kwword_v": """SELECT keyword, word FROM (
  SELECT keyword, unnest(regexp_split_to_array(keyword, '[^a-z0-9]+')) AS word FROM (SELECT DISTINCT keyword FROM jobkw_v))
WHERE word <> ''""",
    "kwsize_v": """SELECT k.keyword, count(w.word) AS n_words, count(DISTINCT w.word) FILTER (length(w.word) >= 3) AS n_long
FROM (SELECT DISTINCT keyword FROM jobkw_v) k LEFT JOIN kwword_v w USING (keyword) GROUP BY 1""",
    "variant_v": f"""
SELECT DISTINCT word, stem || ending AS variant FROM (
  SELECT word, stem, unnest({_ENDINGS}) AS ending FROM (
    SELECT word, word AS stem FROM (SELECT DISTINCT word FROM kwword_v WHERE length(word) >= 3)
    UNION ALL SELECT word, unnest([left(word, length(word) - length(suffix)), left(word, length(word) - length(suffix)) || 'e'])
    FROM (SELECT word, unnest({_SUFFIXES}) AS suffix FROM (SELECT DISTINCT word FROM kwword_v WHERE length(word) >= 3))
    WHERE ends_with(word, suffix) AND length(word) - length(suffix) >= 3))""",
    "scope_v": scope_sql("resume_v"),
    "token_v": token_sql("scope_v"),
    "hit_v": hit_sql("scope_v", "token_v"),
    "kwscore_v": score_sql("hit_v"),
    "scope2_v": scope_sql("rewritten_v"),
    "token2_v": token_sql("scope2_v"),
    "hit2_v": hit_sql("scope2_v", "token2_v"),
    "kwscore2_v": score_sql("hit2_v"),
    "complete_v": completeness_sql("candidate_v", "history_v"),
    "header2_v": """SELECT r.resume_id, c.full_name, c.email, c.phone, coalesce(r.summary, '') AS summary, r.skills
FROM rewritten_v r LEFT JOIN candidate_v c USING (resume_id)""",
    "complete2_v": completeness_sql("header2_v", "history_v"),
    "format_v": """
SELECT d.doc_id, CASE WHEN contains(lower(content_type), 'pdf') THEN CASE WHEN n_bytes > 500000 THEN 15.0::DOUBLE ELSE 20.0 END
  WHEN NOT readable THEN 12.0
  ELSE greatest(round_even(20.0 - CASE WHEN n_tables > 3 THEN 4 ELSE 0 END - CASE WHEN has_textbox THEN 4 ELSE 0 END
    - 2 * coalesce(s.hits, 0) - CASE WHEN coalesce(s.cols, 0) > 1 THEN 5 ELSE 0 END, 1), 0.0) END::DOUBLE AS format_parsability
FROM doc_facts_v d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (contains(lower(header_text), 'name') OR contains(lower(header_text), 'email')
    OR contains(lower(header_text), 'phone')) AS hits, max(n_cols) AS cols FROM section_facts_v GROUP BY 1) s USING (doc_id)""",
    "dates_v": r"""
SELECT c.resume_id, CASE WHEN h.resume_id IS NULL THEN 5.0::DOUBLE ELSE greatest(10.0::DOUBLE - CASE WHEN n_formats > 1 THEN 4 ELSE 0 END
    - CASE WHEN years <> list_reverse_sort(years) THEN 3 ELSE 0 END, 0) END AS date_consistency
FROM candidate_v c LEFT JOIN (
  SELECT resume_id, coalesce(list(TRY_CAST(regexp_extract(start_date, '\d{4}') AS INT) ORDER BY pos)
      FILTER (regexp_matches(start_date, '\d{4}')), []) AS years,
    any_value(n_formats) AS n_formats
  FROM history_v LEFT JOIN (
    SELECT resume_id, count(DISTINCT fmt) AS n_formats FROM (
      SELECT resume_id, CASE WHEN d = '' OR lower(d) = 'present' THEN NULL
        WHEN regexp_matches(d, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}') THEN 'a'
        WHEN regexp_matches(d, '\d{2}/\d{4}') THEN 'b' WHEN regexp_matches(trim(d), '^\d{4}$') THEN 'c' END AS fmt
      FROM (SELECT resume_id, unnest([start_date, end_date]) AS d FROM history_v)) GROUP BY 1) USING (resume_id)
  GROUP BY resume_id) h USING (resume_id)""",
    "health_v": """
SELECT doc_id, source, CASE WHEN length(text) < 100 THEN 0.0::DOUBLE
  WHEN length(regexp_replace(text, '[^\\x{FDE9}-\\x{10FFFF}]', '', 'g')) > 10 THEN 3.0 ELSE 5.0 END AS file_health FROM documents""",
    "score_v": """
SELECT k.resume_id, k.job_id, keyword_match, section_completeness, format_parsability, keyword_placement, date_consistency,
  file_health, round_even(keyword_match + section_completeness + format_parsability + keyword_placement + date_consistency
    + file_health, 1) AS total
FROM kwscore_v k LEFT JOIN completefull_v USING (resume_id) LEFT JOIN datesfull_v USING (resume_id)
JOIN format_v f ON f.doc_id = k.resume_id JOIN health_v h ON h.doc_id = k.resume_id""",
    "completefull_v": """SELECT r.resume_id, coalesce(section_completeness, 0) AS section_completeness
FROM resume_v r LEFT JOIN complete_v USING (resume_id)""",
    "datesfull_v": "SELECT r.resume_id, coalesce(date_consistency, 5) AS date_consistency FROM resume_v r LEFT JOIN dates_v USING (resume_id)",
    "rescore_v": """
SELECT k.resume_id, k.job_id, keyword_match, section_completeness, 20.0::DOUBLE AS format_parsability, keyword_placement,
  date_consistency, 5.0::DOUBLE AS file_health,
  round_even(keyword_match + section_completeness + 20.0 + keyword_placement + date_consistency + 5.0, 1) AS total
FROM kwscore2_v k JOIN complete2_v USING (resume_id) LEFT JOIN datesfull_v USING (resume_id)""",
}

QUERIES: dict[str, str] = {
    "c1_token_index": "SELECT resume_id, scope, token FROM token_v",
    "c2_variant_index": "SELECT word, variant FROM variant_v",
    "c3_keyword_hits": """
SELECT resume_id, job_id, kind, pos, keyword, bool_or(hit) FILTER (scope = 'all') AS in_all,
  bool_or(hit) FILTER (scope = 'summary') AS in_summary, bool_or(hit) FILTER (scope = 'skills') AS in_skills
FROM hit_v GROUP BY ALL""",
    "c4_keyword_match": "SELECT resume_id, job_id, keyword_match FROM kwscore_v",
    "c5_keyword_placement": "SELECT resume_id, job_id, keyword_placement FROM kwscore_v",
    "c6_keyword_gap": "SELECT resume_id, job_id, kind, pos, keyword FROM hit_v WHERE scope = 'all' AND NOT hit",
    "c6_most_missed": """
SELECT job_id, keyword, n_missing, rank FROM (
  SELECT job_id, keyword, n_missing, row_number() OVER (PARTITION BY job_id ORDER BY n_missing DESC, keyword) AS rank FROM (
    SELECT job_id, keyword, count(DISTINCT resume_id) AS n_missing FROM hit_v WHERE scope = 'all' AND NOT hit GROUP BY ALL))
WHERE rank <= 5""",
    "c7_keywords_present": """
SELECT p.resume_id, p.job_id, k.i - 1 AS pos, k.keyword FROM pair_v p
JOIN (SELECT job_id, unnest(range(1, len(hard_keywords) + 1)) AS i, unnest(hard_keywords) AS keyword FROM job_v) k USING (job_id)
JOIN (SELECT resume_id, lower(coalesce(summary, '') || ' ' || array_to_string(skills, ' ') || ' ' || array_to_string(tech_stack, ' ')
  || ' ' || array_to_string(bullets, ' ')) AS text FROM rewritten_v) t USING (resume_id)
WHERE contains(t.text, lower(k.keyword))""",
    "c7_keywords_injected": """
SELECT DISTINCT p.resume_id, p.job_id, k.keyword FROM pair_v p
JOIN (SELECT job_id, unnest(hard_keywords) AS keyword FROM job_v) k USING (job_id)
JOIN (SELECT resume_id, lower(coalesce(summary, '') || ' ' || array_to_string(skills, ' ') || ' ' || array_to_string(tech_stack, ' ')
  || ' ' || array_to_string(bullets, ' ')) AS text FROM rewritten_v) a USING (resume_id)
JOIN (SELECT resume_id, lower(coalesce(summary, '') || ' ' || array_to_string(skills, ' ') || ' ' || array_to_string(tech_stack, ' ')
  || ' ' || array_to_string(bullets, ' ')) AS text FROM resume_v) b USING (resume_id)
WHERE contains(a.text, lower(k.keyword)) AND NOT contains(b.text, lower(k.keyword))""",
    "d1_section_completeness": "SELECT resume_id, section_completeness FROM complete_v",
    "d1_completeness_by_source": """
SELECT d.source, count(*) AS n, round_even(avg(section_completeness), 4) AS mean_completeness
FROM complete_v c JOIN documents d ON d.doc_id = c.resume_id GROUP BY 1""",
    "d2_format_parsability": "SELECT doc_id, format_parsability FROM format_v",
    "d3_date_consistency": "SELECT resume_id, date_consistency FROM dates_v",
    "d4_text_health": "SELECT doc_id, file_health FROM health_v",
    "d4_health_by_source": """
SELECT source, file_health, n, round_even(n / sum(n) OVER (PARTITION BY source), 4) AS share FROM (
  SELECT source, file_health, count(*) AS n FROM health_v GROUP BY ALL)""",
    "d5_score_total": "SELECT * FROM score_v",
    "d5_top_jobs": """
SELECT * FROM (SELECT resume_id, job_id, total, row_number() OVER (PARTITION BY resume_id ORDER BY total DESC, job_id) AS rank
  FROM score_v) WHERE rank <= 5""",
    "d5_top_resumes": """
SELECT * FROM (SELECT resume_id, job_id, total, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, resume_id) AS rank
  FROM score_v) WHERE rank <= 10""",
    "d6_score_after": "SELECT * FROM rescore_v",
    "d7_score_bands": """
SELECT resume_id, job_id, total, CASE WHEN total >= 80 THEN 'green' WHEN total >= 60 THEN 'orange' ELSE 'red' END AS band,
  CASE WHEN total >= 70 THEN 'green' WHEN total >= 50 THEN 'orange' ELSE 'red' END AS review_band FROM score_v""",
    "d7_band_counts": """
SELECT job_id, count(*) FILTER (total >= 80) AS green, count(*) FILTER (total >= 60 AND total < 80) AS orange,
  count(*) FILTER (total < 60) AS red FROM score_v GROUP BY 1""",
}
