"""Reports and sessions."""

_SIGNALS = (("keyword_match", 30), ("section_completeness", 20), ("format_parsability", 20), ("keyword_placement", 15),
            ("date_consistency", 10), ("file_health", 5), ("total", 100))

HELPERS = {
    "delta_v": "\nUNION ALL ".join(
        f"""SELECT resume_id, job_id, '{s}' AS signal, {m}.0::DOUBLE AS max_points, b.{s} AS before, a.{s} AS after, round_even(a.{s} - b.{s}, 1) AS delta
FROM score_v b JOIN rescore_v a USING (resume_id, job_id)""" for s, m in _SIGNALS),
    "injected_v": """
SELECT DISTINCT p.resume_id, p.job_id, p.keyword FROM present2_v p
JOIN (SELECT resume_id, lower(coalesce(summary, '') || ' ' || array_to_string(skills, ' ') || ' ' || array_to_string(tech_stack, ' ')
  || ' ' || array_to_string(bullets, ' ')) AS text FROM resume_v) b USING (resume_id) WHERE NOT contains(b.text, lower(p.keyword))""",
}

QUERIES = {
    "j1_score_delta_report": "SELECT * FROM delta_v",
    "j1_score_delta_means": """
SELECT signal, job_id, count(*) AS n, round_even(avg(before), 3) AS mean_before, round_even(avg(after), 3) AS mean_after FROM delta_v
GROUP BY GROUPING SETS ((signal, job_id), (signal))""",
    "j2_outcome_table": """
SELECT b.resume_id, b.job_id, b.total AS score_before, a.total AS score_after, m.match_before, m.match_after,
  coalesce(d.v, '') AS skills_added, coalesce(i.v, '') AS keywords_injected, coalesce(s.sections, '') AS sections_rewritten, coalesce(g.v, '') AS known_gaps,
  coalesce(y.v, '') AS suggestions
FROM score_v b JOIN rescore_v a USING (resume_id, job_id) LEFT JOIN uplift_v m USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, string_agg(skill, '|' ORDER BY skill) AS v FROM decision_v WHERE add GROUP BY ALL) d USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, string_agg(keyword, '|' ORDER BY keyword) AS v FROM injected_v GROUP BY ALL) i USING (resume_id, job_id)
LEFT JOIN section_v s USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, string_agg('Back up the number in line ' || bullet_idx, '|' ORDER BY bullet_idx) AS v FROM rewrite_v
           WHERE ends_with(rewritten_text, ' 42') AND NOT ends_with(original_text, ' 42') GROUP BY 1) y USING (resume_id)
LEFT JOIN (SELECT resume_id, job_id, string_agg(title, '|' ORDER BY ord) AS v FROM orderedflag1_v JOIN ack_v USING (resume_id, job_id, category)
           GROUP BY ALL) g USING (resume_id, job_id)""",
    "j2_sink": """
SELECT b.resume_id, b.job_id, b.total AS score_before, a.total AS score_after, round_even(a.total - b.total, 1) AS score_delta
FROM score_v b JOIN rescore_v a USING (resume_id, job_id)""",
    "j3_analysis_table": """
SELECT c.resume_id, c.job_id, m.match_score, s.keyword_match, s.section_completeness, s.format_parsability, s.keyword_placement,
  s.date_consistency, s.file_health, s.total, c.yr AS experience_candidate, c.lo AS experience_required_min,
  c.hi AS experience_required_max, c.rd AS domain_candidate, c.jd AS domain_job, array_to_string(c.jc, '|') AS required_certifications,
  l.v AS missing_certifications, f.v AS flags, k.v AS skills
FROM ctx1_v c LEFT JOIN match_v m USING (resume_id, job_id) LEFT JOIN score_v s USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, string_agg(cert, '|' ORDER BY i) AS v FROM lackcert1_v GROUP BY ALL) l USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, string_agg(flag_type || ':' || title, '|' ORDER BY ord) AS v FROM orderedflag1_v GROUP BY ALL) f USING (resume_id, job_id)
LEFT JOIN (SELECT resume_id, job_id, string_agg(skill || ':' || status, '|' ORDER BY skill) AS v FROM item_v GROUP BY ALL) k USING (resume_id, job_id)""",
    "k1_stream_score": "SELECT * FROM score_v",
    "k2_session_status": """
SELECT session_id, last(status ORDER BY ts, event_id) AS status, last(ts ORDER BY ts, event_id) AS ts FROM submission_v GROUP BY 1""",
    "k2_stream_status": """
SELECT session_id, last(status ORDER BY ts, event_id) AS status, last(ts ORDER BY ts, event_id) AS ts FROM submission_v GROUP BY 1""",
    "k2_bad_transitions": """
SELECT event_id, session_id, ts, state_before FROM (
  SELECT *, last_value(CASE WHEN status <> 'failed' THEN status END IGNORE NULLS) OVER (
    PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_before FROM submission_v)
WHERE status = 'optimized' AND coalesce(state_before, '') NOT IN ('analyzed', 'optimized')""",
    "k3_session_expiry": """
SELECT session_id, created, make_timestamp(CAST((floor((epoch(created) + 86400) / 3600) + 1) * 3600000000 AS BIGINT)) AS expired_at FROM (
  SELECT session_id, min(ts) AS created FROM submission_v GROUP BY 1)""",
    "k4_once_only": """
SELECT session_id, first(event_id ORDER BY ts, event_id) AS event_id, first(ts ORDER BY ts, event_id) AS ts
FROM submission_v WHERE status = 'analyzed' GROUP BY 1""",
    "k4_stream_done_table": """
SELECT session_id, first(event_id ORDER BY ts, event_id) AS event_id, first(ts ORDER BY ts, event_id) AS ts
FROM submission_v WHERE status = 'analyzed' GROUP BY 1""",
    "k4_stream_once_only": "SELECT DISTINCT session_id FROM submission_v WHERE status = 'analyzed'",
    "k3_stream_expiry": """
SELECT session_id FROM (SELECT session_id, min(ts) AS created FROM submission_v GROUP BY 1)
WHERE created + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM submission_v)""",
}
