"""Intake, extraction and record cleaning."""

from oracle.labels import seniority_sql, status_sql
from rolefit import refdata as R

HELPERS = {
    "contact_v": r"""
SELECT doc_id, source, coalesce(nullif(regexp_replace(regexp_extract(text, '^\s*([^\n]*)', 1), '\s+$', ''), ''), 'Unknown') AS full_name,
  nullif(regexp_extract(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}'), '') AS email,
  nullif(regexp_replace(regexp_extract(text, '\+?\d[\d\s\-().]{8,15}\d'), '^\s+|\s+$', '', 'g'), '') AS phone,
  'https://' || nullif(regexp_extract(text, '(?i)linkedin\.com/in/[\w\-]+'), '') AS linkedin,
  'https://' || nullif(regexp_extract(text, '(?i)github\.com/[\w\-]+'), '') AS github FROM extract_v""",
    "gate_v": f"""
SELECT doc_id, source, CASE WHEN content_type NOT IN ('{R.PDF}', '{R.DOCX}', '{R.MSWORD}') THEN 'content_type'
  WHEN n_bytes > 10485760 THEN 'size' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'short_text'
  WHEN lang <> 'en' THEN 'language' END AS reason FROM doc_facts_v""",
    "require_v": r"""
SELECT job_id, coalesce(list_filter(list_filter(list_transform(string_split(raw_text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1:5],
    lambda s: length(s) < 80)[1], 'Unknown Position') AS job_title,
  CASE WHEN r[1] <> '' THEN CAST(r[1] AS DOUBLE) WHEN s <> '' THEN CAST(s AS DOUBLE) WHEN m <> '' THEN CAST(m AS DOUBLE) END AS min_years,
  CASE WHEN r[1] <> '' THEN CAST(r[2] AS DOUBLE) WHEN s <> '' THEN CAST(s AS DOUBLE) + 3 WHEN m <> '' THEN CAST(m AS DOUBLE) + 3 END AS max_years
FROM (SELECT job_id, raw_text,
  [regexp_extract(raw_text, '(?i)(\d+)\s*[-–to]+\s*(\d+)\s*years?', 1), regexp_extract(raw_text, '(?i)(\d+)\s*[-–to]+\s*(\d+)\s*years?', 2)] AS r,
  regexp_extract(raw_text, '(?i)(\d+)\+?\s*years?\s*(?:of\s+)?(?:experience|exp)', 1) AS s,
  regexp_extract(raw_text, '(?i)(?:minimum|min\.?|at least)\s*(\d+)\s*years?', 1) AS m FROM job_text_v)""",
    "blanked_v": """
SELECT resume_id, CASE WHEN resume_id % 2 = 1 THEN '' ELSE full_name END AS full_name, CASE WHEN resume_id % 2 = 1 THEN '' ELSE email END AS email,
  CASE WHEN resume_id % 2 = 1 THEN '' ELSE phone END AS phone, CASE WHEN resume_id % 2 = 1 THEN 0 ELSE total_years END AS total_years,
  CASE WHEN resume_id % 2 = 1 THEN NULL ELSE location END AS location, summary, skills, primary_domain,
  CASE WHEN resume_id % 2 = 1 THEN [] ELSE certifications END AS certifications FROM candidate_v""",
}

QUERIES = {
    "a1_intake_gate": "SELECT doc_id, reason FROM gate_v",
    "a1_intake_gate_jd": r"""
SELECT doc_id, CASE WHEN content_type = 'image/png' THEN 'content_type' WHEN n_bytes > 10485760 THEN 'size'
  WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 30 THEN 'short_text' END AS reason FROM doc_facts_v""",
    "a1_intake_gate_template": "SELECT doc_id, content_type FROM doc_facts_v WHERE contains(content_type, 'wordprocessingml')",
    "a1_gate_report": "SELECT source, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM gate_v GROUP BY ALL",
    "a2_text_source": "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages",
    "a2_text_bytes": "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages",
    "a3_language_audit": """
SELECT lang, CASE WHEN len(list_filter(['experience', 'education', 'skills', 'summary', 'work', 'project'],
    lambda m: contains(lower(text), m))) >= 2 THEN 'en' ELSE 'unknown' END AS guess, count(*) AS n FROM extract_v GROUP BY ALL""",
    "a4_contact_extract": "SELECT * FROM contact_v",
    "a4_contact_coverage": """SELECT source, count(*) AS n, count(email) AS with_email, count(phone) AS with_phone,
  count(linkedin) AS with_linkedin, count(github) AS with_github FROM contact_v GROUP BY 1""",
    "a4_shared_contacts": """
SELECT kind, value, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest(['email', 'phone', 'linkedin', 'github']) AS kind, unnest([email, phone, linkedin, github]) AS value FROM contact_v)
WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) > 1""",
    "a5_experience_estimate": r"""
SELECT doc_id, CASE WHEN y <> '' THEN CAST(y AS DOUBLE) WHEN len(m) >= 2 THEN CAST(list_max(m) - list_min(m) AS DOUBLE) END AS total_years
FROM (SELECT doc_id, regexp_extract(text, '(?i)(\d+(?:\.\d+)?)\s*\+?\s*years?\s*(?:of\s+)?(?:experience|exp)', 1) AS y,
  list_transform(regexp_extract_all(text, '(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)\s+(\d{4})', 1), lambda x: CAST(x AS INT)) AS m
  FROM extract_v)""",
    "a6_requirement_extract": "SELECT * FROM require_v",
    "a6_requirement_histogram": "SELECT CAST(floor(min_years) AS BIGINT) AS min_years, count(*) AS n FROM require_v GROUP BY 1",
    "b1_profile_assemble": """
SELECT c.resume_id, coalesce(nullif(b.full_name, ''), c.full_name) AS full_name, coalesce(nullif(b.email, ''), c.email) AS email,
  coalesce(nullif(b.phone, ''), c.phone) AS phone, b.location, b.summary, b.primary_domain,
  coalesce(nullif(b.total_years, 0), c.total_years) AS total_years, len(b.skills) AS n_skills,
  coalesce(h.n, 0) AS n_experience, coalesce(e.n, 0) AS n_education
FROM candidate_v c JOIN blanked_v b USING (resume_id)
LEFT JOIN (SELECT resume_id, count(*) AS n FROM history_v GROUP BY 1) h USING (resume_id)
LEFT JOIN (SELECT resume_id, count(*) AS n FROM education_v GROUP BY 1) e USING (resume_id)""",
    "b2_entries": """SELECT resume_id, pos, raw_json->>'title' AS title, raw_json->>'company' AS company FROM (
  SELECT * FROM raw_entry_v WHERE json_valid(raw_json)) WHERE raw_json->>'title' IS NOT NULL AND raw_json->>'company' IS NOT NULL""",
    "b2_quarantine": """
SELECT resume_id, pos, raw_json, CASE WHEN NOT json_valid(raw_json) THEN 'not_json' WHEN title IS NULL THEN 'missing_title' ELSE 'missing_company' END AS reason
FROM (SELECT *, CASE WHEN json_valid(raw_json) THEN raw_json->>'title' END AS title,
  CASE WHEN json_valid(raw_json) THEN raw_json->>'company' END AS company FROM raw_entry_v)
WHERE title IS NULL OR company IS NULL""",
    "b3_seniority": f"SELECT job_id, seniority_raw, {seniority_sql('seniority_raw')} AS level FROM posting_v",
    "b3_status": f"SELECT p_partkey, {status_sql('p_type')} AS status FROM part",
    "b3_number": r"SELECT p_partkey, p_brand, CAST(nullif(regexp_extract(p_brand, '\d+(?:\.\d+)?'), '') AS DOUBLE) AS number FROM part",
    "b3_boolean": """SELECT event_id, CASE WHEN lower(trim(status)) IN ('true', 'yes', '1', 'clean', 'ok', 'pass') THEN true
  WHEN lower(trim(status)) IN ('false', 'no', '0', 'dirty', 'fail') THEN false ELSE true END AS flag FROM submission_v""",
    "b3_unmatched_labels": f"""SELECT seniority_raw AS label, count(*) AS n FROM posting_v
WHERE seniority_raw <> '' AND {seniority_sql('seniority_raw')} IS NULL GROUP BY 1""",
    "b4_experience": """SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS pos, title, company, start_date, end_date,
  'Worked as ' || title || '|At ' || company AS bullets FROM history_v WHERE resume_id IN (SELECT resume_id FROM candidate_v)""",
    "b4_placeholder_rows": """
SELECT resume_id, 'FULL_NAME' AS placeholder, full_name AS value FROM candidate_v
UNION ALL SELECT resume_id, 'NAME', full_name FROM candidate_v
UNION ALL SELECT resume_id, 'EMAIL', coalesce(email, '') FROM candidate_v
UNION ALL SELECT resume_id, 'PHONE', coalesce(phone, '') FROM candidate_v
UNION ALL SELECT resume_id, 'LOCATION', location FROM candidate_v
UNION ALL SELECT resume_id, 'SUMMARY', summary FROM candidate_v
UNION ALL SELECT resume_id, 'SKILLS_LIST', array_to_string(skills, ' · ') FROM candidate_v
UNION ALL SELECT resume_id, 'SKILLS_COMMA', array_to_string(skills, ', ') FROM candidate_v
UNION ALL SELECT resume_id, 'EXP_' || pos || f.suffix, CASE f.suffix WHEN '_TITLE' THEN title WHEN '_COMPANY' THEN company
    WHEN '_LOCATION' THEN '' WHEN '_DATES' THEN start_date || ' – ' || coalesce(end_date, 'None') WHEN '_START' THEN start_date
    WHEN '_END' THEN coalesce(end_date, '') WHEN '_BULLET_1' THEN 'Worked as ' || title ELSE 'At ' || company END
  FROM history_v, (SELECT unnest(['_TITLE', '_COMPANY', '_LOCATION', '_DATES', '_START', '_END', '_BULLET_1', '_BULLET_2']) AS suffix) f
  WHERE resume_id IN (SELECT resume_id FROM candidate_v)
UNION ALL SELECT resume_id, 'EDU_1_DEGREE', degree FROM education_v
UNION ALL SELECT resume_id, 'EDU_1_INSTITUTION', institution FROM education_v
UNION ALL SELECT resume_id, 'EDU_1_LOCATION', '' FROM education_v
UNION ALL SELECT resume_id, 'EDU_1_YEAR', coalesce(year, '') FROM education_v
UNION ALL SELECT resume_id, 'CERT_' || unnest(range(1, len(certifications) + 1)), unnest(certifications) || ' — None 2020' FROM candidate_v""",
    "b5_skill_union": """
SELECT resume_id, unnest(range(len(u))) AS pos, unnest(u) AS skill FROM (
  SELECT resume_id, list_concat(skills, list_filter(tech_stack, lambda t: NOT list_contains(skills, t))) AS u FROM resume_v)""",
    "b5_skill_frequency": """
SELECT skill, count(*) AS n_resumes FROM (
  SELECT unnest(list_concat(skills, list_filter(tech_stack, lambda t: NOT list_contains(skills, t)))) AS skill FROM resume_v)
GROUP BY 1""",
    "b6_contact_restore": """
SELECT b.resume_id, coalesce(nullif(b.full_name, ''), c.full_name) AS full_name,
  coalesce(nullif(b.email, ''), nullif(c.email, ''), b.email) AS email, coalesce(nullif(b.phone, ''), nullif(c.phone, ''), b.phone) AS phone,
  coalesce(b.location, c.location) AS location, array_to_string(CASE WHEN len(b.certifications) = 0 THEN c.certifications ELSE b.certifications END, '|') AS certifications
FROM blanked_v b JOIN candidate_v c USING (resume_id)""",
}

for _kind, (_a, _x, _b, _y, _both) in {"education": ("degree", "title", "institution", "company", True), "projects": ("name", "company", "description", "title", True),
                                       "certifications": ("name", "title", "issuer", "company", False)}.items():
    QUERIES[f"b2_{_kind}"] = f"SELECT resume_id, pos, {_x} AS {_a}" + f", {_y} AS {_b}" * _both + " FROM history_v WHERE pos % 6 NOT IN (0, 1)"
    QUERIES[f"b2_{_kind}_quarantine"] = f"""
SELECT resume_id, pos, CASE pos % 6 WHEN 0 THEN '{{"{_b}":"' || {_y} || '"}}' ELSE '{{bad' END AS raw_json,
  CASE pos % 6 WHEN 0 THEN 'missing_{_a}' ELSE 'not_json' END AS reason FROM history_v WHERE pos % 6 IN (0, 1)"""
