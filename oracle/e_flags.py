"""Mismatch flags."""

from oracle.labels import seniority_sql
from rolefit import refdata as R


def domain_sql(raw: str) -> str:
    out = f"regexp_replace(trim(lower({raw})), '[^a-z\\s]', ' ', 'g')"
    for short, full in R.DOMAIN_ABBREVIATIONS:
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full}', 'g')"
    return out


def cluster_sql(a: str, b: str) -> str:
    def touches(x, terms):
        return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"
    return "(" + " OR ".join(f"({touches(a, t)} AND {touches(b, t)})" for t in R.DOMAIN_CLUSTERS) + ")"


def ctx_sql(pairs: str) -> str:
    return f"""
SELECT p.resume_id, p.job_id, c.total_years AS yr, c.primary_domain AS rd, c.location AS rl, c.certifications AS rc,
  q.min_years AS lo, q.max_years AS hi, {seniority_sql('q.seniority_raw')} AS level, q.primary_domain AS jd, q.location AS jl,
  q.work_mode AS mode, q.notice_period AS notice, q.certifications_required AS jc
FROM {pairs} p JOIN candidate_v c USING (resume_id) JOIN posting_v q USING (job_id)"""


def lack_sql(ctx: str) -> str:
    return f"""SELECT resume_id, job_id, unnest(range(len(lack))) AS i, unnest(lack) AS cert FROM (
  SELECT resume_id, job_id, list_filter(jc, lambda c: NOT contains(lower(array_to_string(rc, ' ')), lower(c))) AS lack FROM {ctx})"""


def flag_sql(ctx: str, lack: str, domain: bool = False) -> str:
    years, low, high = "CAST(yr AS VARCHAR)", "CAST(lo AS VARCHAR)", "coalesce(nullif(hi, 0), lo)"

    def row(cond, prio, check, kind, category, title, message, detail, ack, source=ctx):
        return f"""SELECT resume_id, job_id, {prio} AS prio, {check} AS check_ord, 0 AS item_ord, '{kind}' AS flag_type,
  '{category}' AS category, '{title}' AS title, {message} AS message, {detail} AS detail, {ack} AS requires_acknowledgement
FROM {source} WHERE {cond}"""

    compared = f"(SELECT * FROM {ctx} JOIN domsim_v ON trim(rd) = domain_a AND trim(jd) = domain_b)"
    told = "'Your primary domain is ' || domain_a || ' · JD targets ' || domain_b"
    domains = [
        row("similarity < 0.4", 0, 1, "red", "domain_mismatch", "Domain Mismatch", told,
            "'Significant domain mismatch detected. Resume optimization will be limited in effectiveness.'", "true", compared),
        row("similarity >= 0.4 AND similarity < 0.7", 2, 1, "info", "domain_mismatch", "Partial Domain Match", told,
            "'There is some overlap between the domains — optimization will still be effective.'", "false", compared)]

    return "\nUNION ALL ".join([
        *(domains if domain else []),
        row("lo - yr > 5", 0, 0, "red", "experience_gap", "Significant Experience Gap",
            f"'JD requires ' || {low} || '+ years · Your resume reflects ~' || {years} || ' years'",
            "'A gap of ' || CAST(CAST(round_even(lo - yr, 0) AS INT) AS VARCHAR) || '+ years may cause automatic ATS rejection at most companies.'",
            "true"),
        row("lo - yr > 0 AND lo - yr <= 5", 1, 0, "yellow", "experience_gap", "Experience Gap",
            f"'JD requires ' || {low} || ' years · Your resume shows ~' || {years} || ' years'",
            "'You are slightly below the stated requirement. Optimization will still proceed.'", "true"),
        row(f"lo - yr <= 0 AND yr - {high} > 5", 1, 0, "yellow", "seniority_mismatch", "Potential Overqualification",
            f"'Your experience (' || {years} || ' yrs) significantly exceeds JD requirement (' || {low} || ' yrs)'",
            "'You may appear overqualified. Consider whether to de-emphasize seniority.'", "false"),
        row("level IN ('intern', 'junior') AND yr > 5", 1, 2, "yellow", "seniority_mismatch",
            "Seniority Mismatch — Overqualified", f"'JD targets ' || level || ' level · You have ' || {years} || ' years of experience'",
            "'Recruiters may screen you out as overqualified.'", "false"),
        row("level IN ('lead', 'manager', 'director') AND yr <> 0 AND yr < 5", 0, 2, "red", "seniority_mismatch",
            "Seniority Mismatch — Underqualified", f"'JD targets ' || level || ' level · You have ' || {years} || ' years of experience'",
            "'This role typically requires significant leadership/management experience.'", "true"),
        row("NOT list_has_any(string_split(lower(jl), ' '), string_split(lower(rl), ' ')) "
            "AND (contains(lower(mode), 'wfo') OR contains(lower(mode), 'office'))",
            1, 3, "yellow", "location_mismatch", "Location Mismatch", "'JD: ' || jl || ' (' || mode || ') · Your location: ' || rl",
            "'This role requires work from office. Location may be a concern.'", "false"),
        row("contains(lower(notice), 'immediate') OR contains(lower(notice), '0 days')", 1, 4, "yellow", "notice_period",
            "Immediate Joiner Preferred", "'JD prefers immediate joiners'",
            "'If you have a notice period, this may affect your candidacy.'", "false"),
        f"""SELECT resume_id, job_id, 0, 5, i, 'red', 'certification_missing', 'Required Certification Missing: ' || cert,
  'JD requires ''' || cert || ''' · Not found in your resume',
  'This certification cannot be added without fabricating credentials.', true FROM {lack}"""])


# Characters in matching blocks, counted by hand, of the domain texts that no cheap tier settles.
MATCHING = ", ".join(f"('{a}', '{b}', {m})" for a, b, m in (
    ("automobile", "building services", 4), ("automobile", "household goods", 3), ("automobile", "machinery", 3),
    ("building", "data analytics", 1), ("building", "mobile", 3), ("building", "household goods", 4), ("building", "machinery", 2),
    ("furniture", "data analytics", 2), ("furniture", "mobile", 2), ("furniture", "building services", 4),
    ("furniture", "household goods", 2), ("furniture", "machinery", 1), ("household", "data analytics", 1), ("household", "mobile", 2),
    ("household", "building services", 3), ("household", "machinery", 2), ("machinery", "data analytics", 2),
    ("machinery", "mobile", 3), ("machinery", "building services", 4), ("machinery", "household goods", 2)))

HELPERS = {
    "ctx_v": ctx_sql("pair2_v"),
    "lackcert_v": lack_sql("ctx_v"),
    "flag_v": flag_sql("ctx_v", "lackcert_v"),
    "flagd_v": flag_sql("ctx_v", "lackcert_v", domain=True),
    "domsim_v": f"""
SELECT domain_a, domain_b, tier, CASE tier WHEN 'equal' THEN 1.0::DOUBLE WHEN 'fuzzy' THEN 2.0::DOUBLE * m / (length(a) + length(b)) ELSE 0.9 END AS similarity
FROM (SELECT *, CASE WHEN a = b THEN 'equal' WHEN contains(a, b) OR contains(b, a) THEN 'contained'
    WHEN {cluster_sql('a', 'b')} THEN 'cluster' ELSE 'fuzzy' END AS tier
  FROM (SELECT rd AS domain_a, jd AS domain_b, {domain_sql('rd')} AS a, {domain_sql('jd')} AS b FROM
    (SELECT DISTINCT primary_domain AS rd FROM candidate_v), (SELECT DISTINCT primary_domain AS jd FROM posting_v)))
LEFT JOIN (VALUES {MATCHING}) t(x, y, m) ON x = lower(domain_a) AND y = lower(domain_b)""",
    "dompair_v": f"SELECT DISTINCT rd AS domain_a, jd AS domain_b, {domain_sql('rd')} AS a, {domain_sql('jd')} AS b FROM ctx_v",
}

FLAG = "flag_type, category, title, message, detail, requires_acknowledgement"

QUERIES = {
    "e1_flag_experience": f"SELECT resume_id, job_id, {FLAG} FROM flag_v WHERE check_ord = 0",
    "e2_domain_tiers": f"""
SELECT domain_a, domain_b, tier, CASE tier WHEN 'equal' THEN 1.0::DOUBLE WHEN 'fuzzy' THEN NULL ELSE 0.9 END AS similarity FROM (
  SELECT domain_a, domain_b, CASE WHEN a = b THEN 'equal' WHEN contains(a, b) OR contains(b, a) THEN 'contained'
    WHEN {cluster_sql('a', 'b')} THEN 'cluster' ELSE 'fuzzy' END AS tier FROM dompair_v)""",
    "e2_domain_similarity": """
SELECT domain_a, domain_b, tier, similarity FROM domsim_v SEMI JOIN ctx_v ON domain_a = rd AND domain_b = jd""",
    "e3_flag_domain": f"SELECT resume_id, job_id, {FLAG} FROM flagd_v WHERE check_ord = 1",
    "e8_flags_with_domain": f"""
SELECT resume_id, job_id, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY prio, check_ord, item_ord) - 1 AS ord, {FLAG} FROM flagd_v""",
    "e4_flag_seniority": f"SELECT resume_id, job_id, {FLAG} FROM flag_v WHERE check_ord = 2",
    "e5_flag_certifications": f"SELECT resume_id, job_id, {FLAG} FROM flag_v WHERE check_ord = 5",
    "e5_missing_certifications": "SELECT resume_id, job_id, i AS pos, cert AS certification FROM lackcert_v",
    "e6_flag_location": f"SELECT resume_id, job_id, {FLAG} FROM flag_v WHERE check_ord = 3",
    "e7_flag_notice": f"SELECT resume_id, job_id, {FLAG} FROM flag_v WHERE check_ord = 4",
    "e8_flags_all": f"""
SELECT resume_id, job_id, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY prio, check_ord, item_ord) - 1 AS ord, {FLAG} FROM flag_v""",
}
