"""DuckDB form of the adapter views (FIXTURES.md), by name. Later views read earlier ones."""

VIEWS = {
    "resume_v": r"""
SELECT doc_id AS resume_id, lang, source, text AS raw_text,
  string_split(text, chr(10))[1] AS summary,
  list_filter(string_split(text, chr(10))[2:], lambda l: trim(l) <> '') AS bullets,
  list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS skills,
  list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,}'))) AS tech_stack
FROM documents
""",
    "job_v": r"""
SELECT item_id AS job_id, text AS raw_text,
  CASE WHEN item_id % 11 = 0 THEN []::VARCHAR[] ELSE list_concat(
    list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))),
    CASE WHEN item_id % 5 = 0 THEN ['the theon', 'ci/cd'] ELSE []::VARCHAR[] END) END AS hard_keywords,
  CASE WHEN item_id % 11 = 0 THEN []::VARCHAR[] ELSE
    list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) BETWEEN 4 AND 5))) END AS soft_keywords
FROM benchmark
""",
    "pair_v": r"""
SELECT DISTINCT l_partkey AS resume_id, l_suppkey AS job_id FROM lineitem
WHERE l_partkey IN (SELECT doc_id FROM documents) AND l_suppkey IN (SELECT item_id FROM benchmark)
""",
    "extract_v": r"""
SELECT doc_id, lang, source, concat(text, CASE doc_id % 6
  WHEN 0 THEN concat(' Has ', CAST(doc_id % 9 AS VARCHAR(9)), '+ years of experience.')
  WHEN 1 THEN ' From Jan 2015 to March 2021.'
  WHEN 2 THEN concat(' linkedin.com/in/u', CAST(doc_id AS VARCHAR(20)))
  WHEN 3 THEN concat(' GitHub.com/g-', CAST(doc_id % 40 AS VARCHAR(20)))
  WHEN 4 THEN ' Only May 2019 here.' ELSE '' END) AS text
FROM documents
""",
    "job_text_v": r"""
SELECT item_id AS job_id, concat(text, CASE item_id % 5
  WHEN 0 THEN ' Needs 3-5 years.' WHEN 1 THEN ' Needs 5 to 8 years.' WHEN 2 THEN ' 4+ years of experience.'
  WHEN 3 THEN ' At least 7 years here.' ELSE '' END) AS raw_text
FROM benchmark
""",
    "candidate_v": r"""
SELECT c.c_custkey AS resume_id,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'Unknown' ELSE c.c_name END AS full_name,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE concat('u', CAST(c.c_custkey AS VARCHAR), '@example.com') END AS email,
  CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE '555-0100' END AS phone,
  repeat('x', c.c_custkey % 60) AS summary,
  list_slice(['sql','python','spark','excel'], 1, c.c_custkey % 5) AS skills,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 25 AS DOUBLE) END AS total_years,
  c.c_mktsegment AS primary_domain, n.n_name AS location,
  list_slice(['AWS Certified','PMP','CKA'], 1, c.c_custkey % 4) AS certifications
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""",
    "posting_v": r"""
SELECT s.s_suppkey AS job_id,
  CASE WHEN s.s_suppkey % 9 = 0 THEN NULL ELSE CAST(s.s_suppkey % 16 AS DOUBLE) END AS min_years,
  CASE WHEN s.s_suppkey % 4 = 0 THEN 0::DOUBLE ELSE CAST(s.s_suppkey % 16 + 3 AS DOUBLE) END AS max_years,
  (['intern','Entry-Level','mid|senior','Senior Level','staff','VP of Sales','n/a','manager'])[s.s_suppkey % 8 + 1] AS seniority_raw,
  (['WFO','Hybrid','Remote','In Office'])[s.s_suppkey % 4 + 1] AS work_mode,
  (['Immediate','30 days','15 Days',NULL])[(s.s_suppkey // 4) % 4 + 1] AS notice_period,
  (['machinery','building services','Mobile','household goods','Data Analytics'])[s.s_suppkey % 5 + 1] AS primary_domain,
  CASE WHEN s.s_suppkey % 3 = 0 THEN n.n_name ELSE concat(n.n_name, ' Metro') END AS location,
  list_slice(['CKA','aws certified','CISSP'], 1, s.s_suppkey % 4) AS certifications_required
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
""",
    "history_v": r"""
SELECT o_custkey AS resume_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 4 = 0 THEN o_orderkey ELSE -CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) END, o_orderkey) AS pos,
  o_orderpriority AS title, concat('Co ', CAST(o_orderkey % 50 AS VARCHAR)) AS company,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%Y')
       WHEN o_custkey % 3 = 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%b %Y') END AS start_date,
  CASE WHEN o_orderstatus = 'O' THEN 'Present' WHEN o_orderkey % 19 = 0 THEN NULL ELSE strftime(o_orderdate, '%b %Y') END AS end_date
FROM orders
""",
    "line_v": r"""
SELECT doc_id, source, pos // 40 AS page, 0 AS block, pos AS line,
  concat(CASE WHEN pos % 6 = 2 THEN '• ' WHEN pos % 6 = 4 THEN 'Tools: ' ELSE '' END, line) AS text,
  CAST((pos % 40) * 12 + ((pos % 40) // 7) * 25 AS DOUBLE) AS y0, CAST((pos % 40) * 12 + ((pos % 40) // 7) * 25 + 10 AS DOUBLE) AS y1
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(line) <> ''
""",
    "rewrite_v": r"""
SELECT doc_id AS resume_id, line AS bullet_idx, text AS original_text,
  CASE WHEN line % 3 = 0 THEN replace(text, 'the', 'each') WHEN line % 5 = 0 THEN concat(text, ' 42')
       WHEN line % 11 = 0 THEN concat(text, ' and much more of it again') ELSE text END AS rewritten_text
FROM line_v
""",
    "guard_flag_v": r"""
SELECT resume_id, 'experience' AS section, 0 AS entry_index,
  CASE WHEN bullet_idx % 30 = 5 THEN 100000 + bullet_idx ELSE bullet_idx END AS bullet_index, original_text, rewritten_text
FROM rewrite_v WHERE original_text <> rewritten_text AND starts_with(rewritten_text, original_text)
""",
    "submission_v": r"""
SELECT event_id, ts, user_id * 100 + extract(day FROM ts) AS session_id,
  CASE event_type WHEN 'view' THEN 'uploaded' WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'analyzed' WHEN 'purchase' THEN 'optimized' ELSE 'failed' END AS status
FROM events
""",
    "doc_facts_v": r"""
SELECT doc_id, source, text, lang,
  CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png'
    ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS content_type,
  n_chars * 1000 AS n_bytes, doc_id % 6 AS n_tables, doc_id % 8 = 3 AS has_textbox, doc_id % 13 <> 0 AS readable
FROM documents
""",
    "section_facts_v": r"""
SELECT d.doc_id, k.k AS section_no, CASE (d.doc_id + k.k) % 3 WHEN 0 THEN 'Name and Email' WHEN 1 THEN 'Page 1' ELSE '' END AS header_text,
  1 + (d.doc_id + k.k) % 2 AS n_cols
FROM documents d JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k ON k.k <= d.doc_id % 3
""",
    "raw_entry_v": r"""
SELECT resume_id, pos, CASE pos % 6 WHEN 0 THEN '{"company":"X"}' WHEN 1 THEN '{bad' ELSE concat('{"title":"', title, '","company":"', company, '"}') END AS raw_json
FROM history_v
""",
    "confirmation_v": r"""
SELECT resume_id, job_id, resume_id % 2 = 0 AS ack_experience, resume_id % 3 = 0 AS ack_certification, (resume_id + job_id) % 3 = 0 AS ack_domain,
  job_id % 2 = 0 AS rewrite_summary, job_id % 3 <> 0 AS rewrite_bullets, job_id % 5 = 0 AS reorder_sections
FROM pair_v
""",
    "education_v": r"""
SELECT c_custkey AS resume_id, 1 AS pos, 'BSc' AS degree, concat('School ', CAST(c_custkey % 20 AS VARCHAR(4))) AS institution,
  CASE WHEN c_acctbal < 3000 THEN NULL WHEN c_custkey % 8 = 0 THEN '' ELSE CAST(1990 + c_custkey % 30 AS VARCHAR(4)) END AS year
FROM customer
""",
    "pair2_v": r"""
SELECT DISTINCT o.o_custkey AS resume_id, l.l_suppkey AS job_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""",
    "rewritten_v": r"""
SELECT r.resume_id, r.skills, r.tech_stack, t.summary, t.bullets FROM resume_v r JOIN (
  SELECT resume_id, max(CASE WHEN bullet_idx = 0 THEN rewritten_text END) AS summary,
    coalesce(list(rewritten_text ORDER BY bullet_idx) FILTER (bullet_idx > 0), []) AS bullets
  FROM rewrite_v GROUP BY resume_id) t USING (resume_id)
""",
    "confirmation2_v": r"""
SELECT resume_id, job_id, resume_id % 2 = 0 AS ack_experience, resume_id % 3 = 0 AS ack_certification, (resume_id + job_id) % 3 = 0 AS ack_domain,
  job_id % 2 = 0 AS rewrite_summary, job_id % 3 <> 0 AS rewrite_bullets, job_id % 5 = 0 AS reorder_sections
FROM pair2_v
""",
}
