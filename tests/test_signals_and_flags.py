from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rolefit.operators import flags as E
from rolefit.operators import intake as A
from rolefit.operators import records as B
from rolefit.operators import signals as S


@pytest.mark.parametrize("chunk", [4096, 2])
def test_date_order_and_formats(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK_ROWS", chunk)
    rows = [
        (1, 1, "Jan 2020", "Present"), (1, 2, "Mar 2018", "Dec 2019"),              # fine
        (2, 1, "2015", "2016"), (2, 2, "", ""), (2, 3, "unknown", None), (2, 4, "2019", "present"),   # years rise over a gap
        (3, 1, "01/2020", "May 2021"), (3, 2, "2018", "2019"),                         # three formats
        (4, 1, "2020", ""), (4, 2, "2019", ""), (4, 3, "2018", ""), (4, 4, "2019", ""), (4, 5, "2001", ""),
    ]
    history = spark.createDataFrame(rows, "resume_id long, pos int, start_date string, end_date string")
    resumes = spark.createDataFrame([(i,) for i in range(1, 6)], "resume_id long")
    got = {r.resume_id: r.date_consistency for r in S.date_consistency(resumes, history).collect()}
    assert got == {1: 10.0, 2: 7.0, 3: 6.0, 4: 7.0, 5: 5.0}


def test_text_health_counts_code_points(spark):
    bad = chr(0xFFFD)
    docs = spark.createDataFrame([(1, "a" * 99), (2, "a" * 100 + bad * 10), (3, "a" * 100 + bad * 11), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.file_health for r in S.text_health(docs).collect()} == {1: 0.0, 2: 5.0, 3: 3.0, 4: 0.0}


def test_domain_similarity_tiers(spark):
    pairs = [("HR", "Human Resources"), ("Data Engineer", "Data Engineering"), ("Mobile", "Data Analytics"), ("", "x"),
             ("machine learning", "deep learning"), ("Insurance", "Aviation"), ("oil and gas", "gas and oil")]
    got = {(r.domain_a, r.domain_b): (r.tier, r.similarity)
           for r in E.domain_similarity(spark.createDataFrame(pairs, "domain_a string, domain_b string")).collect()}
    assert got[pairs[0]] == ("equal", 1.0)
    assert got[pairs[1]] == ("contained", 0.9)
    assert got[pairs[2]] == ("cluster", 0.9)     # "bi" occurs inside "mobile"
    assert got[pairs[3]] == ("unknown", 1.0)
    fuzzy = SequenceMatcher(None, "machine learning", "deep learning").ratio()
    assert got[pairs[4]] == ("fuzzy", pytest.approx(max(fuzzy, 1 / 3)))
    assert got[pairs[5]] == ("fuzzy", pytest.approx(SequenceMatcher(None, "insurance", "aviation").ratio()))
    assert got[pairs[6]] == ("fuzzy", 1.0)       # same words in another order


def _context(spark, rows):
    candidates = spark.createDataFrame(
        [(i, y, d, loc, c) for i, (y, d, loc, c, *_) in enumerate(rows)],
        "resume_id long, total_years double, primary_domain string, location string, certifications array<string>")
    postings = spark.createDataFrame(
        [(i, *r[4:]) for i, r in enumerate(rows)],
        "job_id long, min_years double, max_years double, seniority_raw string, primary_domain string, location string,"
        "work_mode string, notice_period string, certifications_required array<string>")
    pairs = spark.createDataFrame([(i, i) for i in range(len(rows))], "resume_id long, job_id long")
    return E.pair_context(candidates, postings, pairs)


def test_flags_of_known_pairs(spark):
    rows = [
        (0.0, "Sales", "Pune", [], 5.5, None, "Lead", "Farming", "Delhi", "WFO", "30 days", ["CKA", "PMP"]),
        (12.0, "", "Pune", ["AWS certified", "CKA"], 5.0, 0.0, "Entry-Level", "x", "pune, IN", "Hybrid", None, ["certified CKA"]),
        (None, "Data", None, None, None, 3.0, "n/a", "Data", "Delhi", "office", "15 days", None),
    ]
    context = _context(spark, rows)
    similarity = E.domain_similarity(E.domain_pairs(context))
    got = {}
    for r in sorted(E.run_flags(context, similarity).collect(), key=lambda r: (r.resume_id, r.ord)):
        got.setdefault(r.resume_id, []).append((r.flag_type, r.category))
    assert got[0] == [("red", "experience_gap"), ("red", "domain_mismatch"), ("red", "certification_missing"),
                      ("red", "certification_missing"), ("yellow", "location_mismatch"), ("yellow", "notice_period")]
    assert got[1] == [("yellow", "seniority_mismatch"), ("yellow", "seniority_mismatch")]
    assert 2 not in got
    detail = E.flag_experience(context).filter("resume_id = 0").first().detail
    assert detail.startswith("A gap of 6+ years")   # 5.5 rounds half to even


def test_labels(spark):
    seniority = {"mid|senior": "mid", "Senior Level": "senior", "VP of Sales": "director", "Entry-Level": "junior", "n/a": None,
                 "": None, "mid-senior": "mid", "seniorish": "senior", "tech lead": "lead"}
    status = {"Matched": "matched", "unmatched": "matched", "can  add it": "can_add", "not found": "missing", "": "missing",
              "partially": "partial", "whatever": "missing"}
    numbers = {"5-7": 5.0, "5+": 5.0, "five": None, "": None, "about 2.5 years": 2.5}
    booleans = {"Yes": True, "no": False, "dirty": False, "maybe": True, "0": False}
    for kind, cases in (("seniority", seniority), ("status", status), ("number", numbers), ("boolean", booleans)):
        df = spark.createDataFrame([(k,) for k in cases], "raw string")
        assert {r.raw: r.out for r in B.label_normalise(df, "raw", kind, "out").collect()} == cases


def test_requirements(spark):
    cases = {"3-5 years": (3.0, 5.0), "5 to 8 years": (5.0, 8.0), "3.5 years experience": (5.0, 8.0), "Min. 4 years": (4.0, 7.0),
             "at least 7 year": (7.0, 10.0), "some years": (None, None)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "job_id long, raw_text string")
    got = {r.job_id: (r.min_years, r.max_years) for r in A.requirement_extract(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_contacts(spark):
    text = "\n  \n  Zoë K \nmail a.b@c.io, see GitHub.com/zoë-k or linkedin.com/in/zoë; +1 (555) 010-0123"
    row = A.contact_extract(spark.createDataFrame([(1, "s", text), (2, "s", " \n ")], "doc_id long, source string, text string")).filter(
        "doc_id = 1").first()
    assert (row.full_name, row.email, row.github, row.linkedin, row.phone) == (
        "Zoë K", "a.b@c.io", "https://GitHub.com/zoë-k", "https://linkedin.com/in/zoë", "+1 (555) 010-0123")


def test_digits_of_all_scripts(spark):
    texts = ["٣ years experience", "Jan ٢٠١٥ to Mar ٢٠٢١", "１２ years of experience", "5.5 years exp", "none", None, "May 2019", "०३ years experience",
             "9" * 400 + " years experience"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.total_years for r in A.experience_estimate(docs).collect()}
    assert got == {0: 3.0, 1: 6.0, 2: 12.0, 3: 5.5, 4: None, 5: None, 6: None, 7: 3.0, 8: float("inf")}
    jobs = spark.createDataFrame([(0, "٣-٥ years"), (1, "at least ７ years"), (2, "٤+ years of experience"), (3, "x")], "job_id long, raw_text string")
    need = {r.job_id: (r.min_years, r.max_years) for r in A.requirement_extract(jobs).collect()}
    assert need == {0: (3.0, 5.0), 1: (7.0, 10.0), 2: (4.0, 7.0), 3: (None, None)}


def test_scores_keep_resumes_without_records(spark):
    resumes = spark.createDataFrame([(1, "text", ["a"], [], ["b"]), (2, "text", [], [], [])],
                                    "resume_id long, summary string, skills array<string>, tech_stack array<string>, bullets array<string>")
    jobs = spark.createDataFrame([(1, ["zzz"], [])], "job_id long, hard_keywords array<string>, soft_keywords array<string>")
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "resume_id long, job_id long")
    header = spark.createDataFrame([(1, "N", "e", "p", "s", ["a"])], "resume_id long, full_name string, email string, phone string, summary string, skills array<string>")
    history = spark.createDataFrame([], "resume_id long, pos int, title string, company string, start_date string, end_date string")
    education = spark.createDataFrame([], "resume_id long, year string")
    facts = spark.createDataFrame([], "doc_id long, text string, content_type string, n_bytes long, n_tables long, has_textbox boolean, readable boolean")
    sections = spark.createDataFrame([], "doc_id long, header_text string, n_cols int")
    got = {r.resume_id: r for r in S.score_pairs(resumes, header, history, education, facts, sections, jobs, pairs).collect()}
    assert set(got) == {1, 2}
    assert (got[1].section_completeness, got[2].section_completeness) == (6.0, 0.0)
    assert (got[2].date_consistency, got[2].format_parsability, got[2].file_health) == (5.0, 12.0, 0.0)


def test_flags_are_worked_out_once(spark):
    """No filter below the generator that holds the flags, and so the character ratio, a second time."""
    rows = [(0.0, "Sales", "Pune", [], 5.5, None, "Lead", "Farming", "Delhi", "WFO", "30 days", ["CKA", "PMP"])]
    flags = E.run_flags(_context(spark, rows), domains=True)
    assert flags._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.ord, r.category) for r in sorted(flags.collect(), key=lambda r: r.ord)] == [
        (0, "experience_gap"), (1, "domain_mismatch"), (2, "certification_missing"), (3, "certification_missing"), (4, "location_mismatch"), (5, "notice_period")]


def test_domain_forms(spark):
    cases = {"HR & ML": "human resources   machine learning", " Infosec/IT ": "information security information technology", "biology": "biology",
             "SAP": "sap enterprise", "": "", "R2D2": "r d "}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: (r.norm, r.bits) for r in df.select("raw", E.normalise_domain(df.raw).alias("norm")).select("raw", "norm", E.cluster_bits(F.col("norm")).alias("bits")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert (got["HR & ML"][1], got["biology"][1], got[""][1]) == (16, 1, 0)
