"""Rewrites and text alignment."""

from oracle.ab_records import QUERIES as RECORDS
from rolefit import refdata as R

B, DB = R.BULLET_CHARS, R.DOC_BULLET_CHARS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def bare(x: str, chars: str = B) -> str:
    return strip(rf"regexp_replace({x}, '^[{chars}]\s*', '')")


def norm(x: str) -> str:
    return f"lower({strip(rf'''regexp_replace({bare(x)}, '\s+', ' ', 'g')''')})"


def ascii_form(x: str, keep_bullet: bool) -> str:
    out = x
    for a, b in R.ASCII_FORMS:
        if not (keep_bullet and a == "•"):
            out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    kept = r"\x{2022}" if keep_bullet else ""
    return rf"regexp_replace({out}, '[^\x{{00}}-\x{{FF}}{kept}]', '', 'g')"


def words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


_MARKS = "".join(a for a, _ in R.ASCII_FORMS)
_HEADERS = "|".join(R.SECTION_HEADERS)

HELPERS = {
    "unit_v": """SELECT resume_id, CASE WHEN bullet_idx = 0 THEN 'summary' ELSE 'experience' END AS section, 0 AS entry_idx, bullet_idx,
  original_text, rewritten_text FROM rewrite_v""",
    "changed_v": f"""
SELECT resume_id, CASE WHEN section = 'summary' THEN 0 ELSE 1 END AS section_ord, bullet_idx, {strip('original_text')} AS old,
  {strip('rewritten_text')} AS new_text FROM unit_v
WHERE {strip('original_text')} <> '' AND {strip('rewritten_text')} <> '' AND {strip('original_text')} <> {strip('rewritten_text')}""",
    "change_v": f"""
SELECT resume_id, section_ord, bullet_idx, 0 AS form, old AS key, new_text FROM changed_v
UNION ALL SELECT resume_id, section_ord, bullet_idx, 1, {bare('old')}, new_text FROM changed_v
WHERE {bare('old')} NOT IN ('', old)""",
    "registered_v": """
SELECT resume_id, key, last(new_text ORDER BY section_ord, bullet_idx, form) AS new_text,
  min((section_ord * 10000000 + bullet_idx) * 2 + form) AS ord FROM change_v GROUP BY ALL""",
    "deduped_v": f"""
SELECT resume_id, norm, first(key ORDER BY length(key) DESC, ord) AS key, first(new_text ORDER BY length(key) DESC, ord) AS new_text, min(ord) AS ord
FROM (SELECT *, {norm('key')} AS norm FROM registered_v) WHERE norm <> '' GROUP BY resume_id, norm""",
    "markedline_v": rf"""
SELECT *, CASE WHEN regexp_matches(text, '^[{B}]\s') OR regexp_matches(text, '(?i)^(?:{_HEADERS})$') OR regexp_matches(text, '{R.CATEGORY_LABEL_RE}')
    OR (regexp_matches(text, '{R.JOB_HEADER_RE.replace(chr(39), chr(39) * 2)}') AND length(text) < 120) OR regexp_matches(text, '{R.DATE_LINE_RE}')
    OR lag(y1) OVER w IS NULL OR y0 - lag(y1) OVER w > 20 THEN 1 ELSE 0 END AS starts
FROM (SELECT doc_id, page, block, line, {strip('text')} AS text, y0, y1 FROM line_v)
WINDOW w AS (PARTITION BY doc_id, page, block ORDER BY line)""",
    "entry_v": """
SELECT doc_id, page, block, entry, count(*) AS n_lines, first(text ORDER BY line) AS first_line, string_agg(text, ' ' ORDER BY line) AS text,
  min(y0) AS y0, max(y1) AS y1
FROM (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id, page, block ORDER BY line ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS entry FROM markedline_v)
GROUP BY doc_id, page, block, entry""",
    "entrynorm_v": f"SELECT doc_id, page, block, entry, n_lines, {norm('text')} AS norm FROM entry_v WHERE {norm('text')} <> ''",
    "length_v": rf"""
SELECT resume_id, section, entry_idx, bullet_idx, n_original, n_rewritten,
  CASE section WHEN 'summary' THEN n_rewritten BETWEEN greatest(30, round_even(n_original * 0.88::DOUBLE, 0)) AND round_even(n_original * 1.12::DOUBLE, 0)
    ELSE n_rewritten BETWEEN n_original * 0.85::DOUBLE AND n_original * 1.15::DOUBLE END AS within
FROM (
  SELECT u.resume_id, section, entry_idx, bullet_idx, {words('rewritten_text')} AS n_rewritten,
    CASE section WHEN 'experience' THEN {words('original_text')}
      ELSE CASE WHEN found_at > 0 AND greatest({words('blk')}, {words('original_text')}) > 0 THEN greatest({words('blk')}, {words('original_text')})
        WHEN {words('original_text')} > 20 THEN {words('original_text')} ELSE 80 END END AS n_original
  FROM (SELECT *, regexp_replace(substr(raw_text, found_at), '(?s)(?:\n\s*\n|\n[A-Z][A-Z ]{{4,}}\n).*$', '') AS blk FROM (
    SELECT u.*, r.raw_text, CASE WHEN {strip('original_text')} = '' THEN 0 ELSE instr(r.raw_text, array_to_string(
      list_filter(regexp_split_to_array({strip('original_text')}, '\s+'), lambda w: w <> '')[1:6], ' ')) END AS found_at
    FROM unit_v u JOIN resume_v r USING (resume_id))) u)""",
    "fact_v": r"""
SELECT resume_id, 'number' AS kind, unnest(regexp_extract_all(original_text, '\d[\d,.]*')) AS value FROM unit_v
UNION ALL SELECT resume_id, unnest(['company', 'title', 'date', 'date']), unnest([company, title, start_date, end_date]) FROM history_v""",
    "newfact_v": r"""
SELECT resume_id, 'number' AS kind, unnest(regexp_extract_all(rewritten_text, '\d[\d,.]*')) AS value FROM unit_v
UNION ALL SELECT resume_id, unnest(['company', 'title', 'date', 'date']),
  unnest([CASE WHEN pos % 7 = 3 THEN company || ' Ltd' ELSE company END, title, start_date, end_date]) FROM history_v""",
    "scopedflag_v": """
SELECT f.resume_id, f.section, f.entry_index AS entry_idx, f.bullet_index, CASE WHEN f.resume_id % 4 NOT IN (1, 2) THEN 'kept: clean'
  WHEN n.n IS NULL THEN 'section' WHEN f.bullet_index < n.n THEN 'bullet' ELSE 'entry' END AS scope
FROM guard_flag_v f LEFT JOIN (SELECT resume_id, max(bullet_idx) + 1 AS n FROM unit_v WHERE section = 'experience' GROUP BY 1) n USING (resume_id)""",
    "verified_v": """
SELECT u.resume_id, u.section, u.entry_idx, u.bullet_idx, CASE WHEN u.section = 'experience' AND (w.resume_id IS NOT NULL OR b.resume_id IS NOT NULL)
  THEN original_text ELSE rewritten_text END AS text
FROM unit_v u LEFT JOIN (SELECT DISTINCT resume_id FROM scopedflag_v WHERE scope IN ('entry', 'section')) w USING (resume_id)
LEFT JOIN (SELECT DISTINCT resume_id, bullet_index AS bullet_idx FROM scopedflag_v WHERE scope = 'bullet') b
  ON b.resume_id = u.resume_id AND b.bullet_idx = u.bullet_idx""",
    "sectionlist_v": """
SELECT c.resume_id, c.summary, c.skills, c.certifications, e.institution,
  CASE WHEN c.resume_id % 3 = 0 THEN list_append(c.skills, 'Kafka') ELSE c.skills END AS new_skills,
  CASE WHEN c.resume_id % 5 = 0 THEN list_append(c.certifications, 'CISSP') ELSE c.certifications END AS new_certifications,
  CASE WHEN c.resume_id % 22 = 0 THEN upper(e.institution || ' East') WHEN c.resume_id % 11 = 0 THEN upper(e.institution) ELSE e.institution END AS new_institution
FROM candidate_v c JOIN education_v e USING (resume_id)""",
    "sectionold_v": """
SELECT resume_id, 'summary' AS section, 0 AS entry_idx, 0 AS bullet_idx, summary AS text FROM sectionlist_v
UNION ALL SELECT resume_id, 'skills', 0, generate_subscripts(skills, 1) - 1, unnest(skills) FROM sectionlist_v
UNION ALL SELECT resume_id, 'tech_stack', 0, generate_subscripts(skills[1:2], 1) - 1, unnest(skills[1:2]) FROM sectionlist_v
UNION ALL SELECT resume_id, 'certifications', 0, generate_subscripts(certifications, 1) - 1, unnest(certifications) FROM sectionlist_v
UNION ALL SELECT resume_id, 'education', 0, 0, 'BSc, ' || institution FROM sectionlist_v
UNION ALL SELECT resume_id, 'projects', pos - 1, 0, 'Worked as ' || title FROM history_v
UNION ALL SELECT resume_id, 'projects', pos - 1, 1, 'At ' || company FROM history_v""",
    "sectionnew_v": """
SELECT resume_id, 'summary' AS section, 0 AS entry_idx, 0 AS bullet_idx, summary || ' and more' AS text FROM sectionlist_v
UNION ALL SELECT resume_id, 'skills', 0, generate_subscripts(new_skills, 1) - 1, unnest(new_skills) FROM sectionlist_v
UNION ALL SELECT resume_id, 'tech_stack', 0, generate_subscripts(new_skills[1:2], 1) - 1, unnest(new_skills[1:2]) || ' and more' FROM sectionlist_v
UNION ALL SELECT resume_id, 'certifications', 0, generate_subscripts(new_certifications, 1) - 1, unnest(new_certifications) FROM sectionlist_v
UNION ALL SELECT resume_id, 'education', 0, 0, 'BSc, ' || new_institution FROM sectionlist_v
UNION ALL SELECT resume_id, 'projects', pos - 1, 0, 'Worked as ' || title FROM history_v WHERE pos <= 12
UNION ALL SELECT resume_id, 'projects', pos - 1, 1, 'At ' || company || CASE WHEN pos % 7 = 3 THEN ' Ltd' ELSE '' END FROM history_v WHERE pos <= 12""",
    "sectionscope_v": """
SELECT resume_id, section, entry_idx, bullet_index, CASE WHEN resume_id % 7 < 2 THEN 'kept: clean' ELSE scope END AS scope FROM (
  SELECT resume_id, 'skills' AS section, -1 AS entry_idx, -1 AS bullet_index, CASE WHEN resume_id % 4 = 0 AND resume_id % 5 <> 0 THEN 'kept: approved'
    WHEN resume_id % 4 < 2 AND resume_id % 5 = 0 THEN 'kept: empty flag' ELSE 'section' END AS scope FROM candidate_v WHERE resume_id % 3 = 0
  UNION ALL SELECT resume_id, 'certifications', -1, -1, 'section' FROM candidate_v WHERE resume_id % 5 = 0
  UNION ALL SELECT resume_id, 'education', -1, -1, CASE WHEN resume_id % 2 = 0 THEN 'kept: in original' ELSE 'section' END FROM candidate_v WHERE resume_id % 11 = 0
  UNION ALL SELECT resume_id, 'summary', -1, -1, 'section' FROM candidate_v WHERE resume_id % 2 = 0
  UNION ALL SELECT resume_id, 'languages', -1, -1, 'kept: unknown section' FROM candidate_v WHERE resume_id % 17 = 0
  UNION ALL SELECT resume_id, 'projects', place, bullet, CASE WHEN place >= n THEN 'section' WHEN place >= least(n, 12) THEN 'quarantined'
    WHEN bullet IN (0, 1) THEN 'bullet' ELSE 'entry' END FROM (
    SELECT resume_id, CASE WHEN resume_id % 13 = 5 THEN 100 + pos ELSE pos - 1 END AS place, count(*) OVER (PARTITION BY resume_id) AS n, pos,
      CASE WHEN resume_id % 3 = 1 THEN -1 WHEN resume_id % 3 = 2 AND pos = 3 THEN 2 ELSE 1 END AS bullet FROM history_v) WHERE pos % 7 = 3 OR pos > 12)""",
    "sectionhit_v": """
SELECT resume_id, section FROM sectionscope_v WHERE scope = 'section'
UNION SELECT resume_id, 'tech_stack' FROM sectionscope_v WHERE scope = 'section' AND section = 'skills'""",
    "sectionunit_v": """
SELECT *, EXISTS (SELECT 1 FROM sectionhit_v h WHERE h.resume_id = u.resume_id AND h.section = u.section) AS whole,
  EXISTS (SELECT 1 FROM sectionscope_v f WHERE f.resume_id = u.resume_id AND f.section = u.section AND f.entry_idx = u.entry_idx AND f.scope = 'entry') AS entry,
  EXISTS (SELECT 1 FROM sectionscope_v f WHERE f.resume_id = u.resume_id AND f.section = u.section AND f.entry_idx = u.entry_idx
    AND f.bullet_index = u.bullet_idx AND f.scope = 'bullet') AS one
FROM (SELECT resume_id, section, entry_idx, bullet_idx, o.text AS old_text, n.text AS new_text
  FROM sectionold_v o FULL JOIN sectionnew_v n USING (resume_id, section, entry_idx, bullet_idx)) u""",
    "section_v": """
SELECT c.resume_id, c.job_id, concat_ws('|', CASE WHEN c.rewrite_summary AND s.changed THEN 'Summary' END,
  CASE WHEN c.rewrite_bullets AND s.bullets_changed THEN 'Experience' END, CASE WHEN c.reorder_sections THEN 'Section Order' END) AS sections
FROM confirmation_v c JOIN (
  SELECT resume_id, coalesce(bool_or(o.original_text <> v.text) FILTER (v.section = 'summary'), false) AS changed,
    coalesce(bool_or(o.original_text <> v.text) FILTER (v.section = 'experience'), false) AS bullets_changed
  FROM verified_v v JOIN unit_v o USING (resume_id, section, entry_idx, bullet_idx) GROUP BY 1) s USING (resume_id)""",
    "applied_v": rf"""
SELECT l.doc_id, l.line AS pos, CASE WHEN c.new_text IS NULL THEN l.text ELSE regexp_extract(l.text, '^[{DB}]\s*') || c.new_text END AS text,
  c.new_text IS NOT NULL AS changed
FROM line_v l LEFT JOIN (SELECT resume_id AS doc_id, {bare('key', DB)} AS b, first(new_text ORDER BY ord) AS new_text FROM registered_v GROUP BY ALL) c
  ON c.doc_id = l.doc_id AND c.b = {bare(strip('l.text'), DB)}""",
}

QUERIES = {
    "h1_change_map": "SELECT resume_id, section_ord, bullet_idx, form, key, new_text FROM change_v",
    "h2_change_dedupe": "SELECT resume_id, norm, key, new_text FROM deduped_v",
    "h3_length_check": "SELECT * FROM length_v",
    "h3_length_violations": """SELECT section, count(*) AS n, count(*) FILTER (NOT within) AS n_outside,
  round_even(count(*) FILTER (NOT within) / count(*), 4) AS rate FROM length_v GROUP BY 1""",
    "h4_novelty_flags": """
SELECT DISTINCT n.resume_id, n.kind, n.value FROM newfact_v n
WHERE n.value <> '' AND NOT EXISTS (SELECT 1 FROM fact_v f WHERE f.resume_id = n.resume_id AND f.kind = n.kind AND lower(f.value) = lower(n.value))
  AND NOT (n.value = '42' AND n.resume_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))""",
    "h4_novel_items": """
SELECT resume_id, 'technology' AS kind, 'Kafka' AS value FROM candidate_v WHERE resume_id % 3 = 0
UNION ALL SELECT resume_id, 'certification', 'CISSP' FROM candidate_v WHERE resume_id % 5 = 0
UNION ALL SELECT resume_id, 'degree', 'MSc' FROM candidate_v WHERE resume_id % 7 = 0
UNION ALL SELECT resume_id, 'institution', upper(institution || ' East') FROM education_v WHERE resume_id % 22 = 0""",
    "h5_revert_scope": "SELECT * FROM scopedflag_v",
    "h5_revert_apply": "SELECT * FROM verified_v",
    "h5_section_scope": "SELECT * FROM sectionscope_v",
    "h5_section_apply": """
SELECT resume_id, section, entry_idx, bullet_idx, text FROM (
  SELECT *, CASE WHEN whole OR entry THEN old_text WHEN one AND new_text IS NOT NULL THEN coalesce(old_text, new_text) ELSE new_text END AS text FROM sectionunit_v)
WHERE text IS NOT NULL""",
    "h6_sections_changed": "SELECT * FROM section_v",
    "h6_section_counts": "SELECT section, count(*) AS n FROM (SELECT unnest(string_split(sections, '|')) AS section FROM section_v) WHERE section <> '' GROUP BY 1",
    "i1_entry_segment": "SELECT * FROM entry_v",
    "i2_normalise_compare": f"SELECT doc_id, line, {norm('text')} AS normalised FROM line_v",
    "i2_normalise_ascii": f"SELECT doc_id, line, {ascii_form('text', False)} AS normalised FROM line_v",
    "i2_normalise_keep_bullet": f"SELECT doc_id, line, {ascii_form('text', True)} AS normalised FROM line_v",
    "i2_charset_report": rf"""
SELECT source, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(length(text) - length(u)) AS BIGINT) AS n_replaced,
  CAST(sum(length(u) - length(regexp_replace(u, '[^\x{{00}}-\x{{FF}}]', '', 'g'))) AS BIGINT) AS n_dropped
FROM (SELECT source, text, regexp_replace(text, '[{_MARKS}]', '', 'g') AS u FROM line_v) GROUP BY 1""",
    "i3_exact_candidates": """SELECT e.doc_id, d.norm AS key, e.page, e.block, e.entry FROM deduped_v d
JOIN entrynorm_v e ON e.doc_id = d.resume_id AND e.norm = d.norm""",
    "i3_prefix_candidates": """
SELECT doc_id, key, page, block, entry, CASE WHEN near THEN 2 ELSE 3 END AS tier FROM (
  SELECT e.doc_id, d.norm AS key, e.page, e.block, e.entry,
    (starts_with(e.norm, d.norm) OR starts_with(d.norm, e.norm))
      AND least(length(e.norm), length(d.norm)) / greatest(length(e.norm), length(d.norm)) >= 0.65::DOUBLE AS near,
    starts_with(e.norm, d.norm) AND length(d.norm) >= 60 AS leads
  FROM deduped_v d JOIN entrynorm_v e ON e.doc_id = d.resume_id WHERE e.norm <> d.norm) WHERE near OR leads""",
    "i3_entry_align_prefix": f"""
SELECT * FROM (WITH RECURSIVE c AS (
  SELECT e.doc_id, d.norm AS key, e.page, e.block, e.entry, -length(d.norm) AS neg_len, d.ord, e.n_lines, length(d.norm) AS a, e.norm AS text,
    least(length(e.norm), length(d.norm)) / greatest(length(e.norm), length(d.norm)) AS ratio
  FROM deduped_v d JOIN entrynorm_v e ON e.doc_id = d.resume_id WHERE starts_with(e.norm, d.norm) OR starts_with(d.norm, e.norm)),
t AS (SELECT *, CASE WHEN key = text THEN 1 WHEN ratio >= {R.PREFIX_RATIO} THEN 2 WHEN starts_with(text, key) AND a >= {R.LEAD_PREFIX_CHARS} THEN 3 END AS tier FROM c),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, neg_len, ord, tier, pref, block, entry) AS i,
    dense_rank() OVER (PARTITION BY doc_id ORDER BY key) AS k, dense_rank() OVER (PARTITION BY doc_id ORDER BY page, block, entry) AS p
  FROM (SELECT *, CASE tier WHEN 2 THEN -ratio ELSE -n_lines END AS pref,
      CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN ratio ELSE {R.LEAD_PREFIX_SCORE}::DOUBLE END AS score FROM t WHERE tier IS NOT NULL)),
r AS (
  SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS ks, []::BIGINT[] AS ps, false AS took FROM n WHERE n.i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN free THEN list_append(ks, k) ELSE ks END, CASE WHEN free THEN list_append(ps, p) ELSE ps END, free FROM (
    SELECT n.doc_id, n.i, ks, ps, k, p, NOT list_contains(ks, k) AND NOT list_contains(ps, p) AS free FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1))
SELECT n.doc_id, n.key, n.page, n.block, n.entry, n.tier, n.score FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i WHERE took)""",
    "i4_align_gate": """
SELECT doc_id, n_keys, n_matched, match_rate, CASE WHEN match_rate < 0.1 THEN 'regenerate' ELSE 'in place' END AS decision FROM (
  SELECT doc_id, coalesce(n_keys, 0) AS n_keys, coalesce(n_matched, 0) AS n_matched,
    CASE WHEN coalesce(n_keys, 0) = 0 THEN 1.0::DOUBLE ELSE n_matched / n_keys END AS match_rate
  FROM documents LEFT JOIN (
    SELECT d.resume_id AS doc_id, count(*) AS n_keys, count(e.norm) AS n_matched FROM deduped_v d
    LEFT JOIN (SELECT DISTINCT doc_id, norm FROM entrynorm_v) e ON e.doc_id = d.resume_id AND e.norm = d.norm GROUP BY 1) USING (doc_id))""",
    "i5_text_apply": "SELECT doc_id, pos, text, changed FROM applied_v",
    "i5_rebuilt_text": "SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) FILTER (changed) AS n_changed FROM applied_v GROUP BY 1",
    "i6_reading_order": """
SELECT doc_id, page, stream_pos, read_pos, in_stream <> read_pos AS moved, NOT bool_or(rises) OVER (PARTITION BY doc_id, page) AS page_in_order FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, stream_pos) AS read_pos,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY stream_pos) AS in_stream,
    coalesce(lag(y) OVER (PARTITION BY doc_id, page ORDER BY stream_pos) < y, false) AS rises
  FROM (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN line ELSE (line % 5) * 100000 + line END AS stream_pos, 2000 - y0 AS y FROM line_v))""",
    "i7_template_merge": """
SELECT c.resume_id, 'Dear ' || c.full_name || ', we wrote to ' || coalesce(c.email, '') || ' about ' || c.location || '.' || chr(10) || ' Last: '
  || coalesce(h.title, '') || ' ' || coalesce(h.start_date || ' – ' || coalesce(h.end_date, 'None'), '') AS text
FROM candidate_v c LEFT JOIN history_v h ON h.resume_id = c.resume_id AND h.pos = 1""",
    "i7_unresolved_tokens": """
SELECT resume_id, 'MISSING' AS token FROM candidate_v
UNION ALL SELECT resume_id, unnest(['EXP_1_TITLE', 'EXP_1_DATES']) FROM candidate_v WHERE resume_id NOT IN (SELECT resume_id FROM history_v)""",
    "i7_unused_placeholders": f"""
SELECT DISTINCT resume_id, placeholder FROM ({RECORDS["b4_placeholder_rows"]}) p
WHERE placeholder NOT IN ('FULL_NAME', 'EMAIL', 'LOCATION', 'MISSING', 'EXP_1_TITLE', 'EXP_1_DATES')""",
}
