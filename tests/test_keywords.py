import random

import pytest
from pyspark.sql import functions as F

from rolefit.operators import keywords as K
from rolefit.operators import word_index as W

RESUMES = "resume_id long, summary string, skills array<string>, tech_stack array<string>, bullets array<string>"
JOBS = "job_id long, hard_keywords array<string>, soft_keywords array<string>"


# Worked out by hand: keyword word, tokens that are forms of it, tokens that are not.
FORMS = [
    ("deploy", ("deploy", "deploys", "deployed", "deploying", "deployer", "deployment"), ("deployable", "redeploy", "deplo", "dep")),
    ("deployment", ("deployment", "deploy", "deploys", "deployed", "deployments"), ("employment", "deplo")),
    ("manage", ("manage", "managed", "manager", "manages", "management"), ("managing", "manag", "man")),
    ("managing", ("managing", "manage", "managed", "manager", "manag", "management"), ("mana", "managerial")),
    ("nation", ("nation", "nations", "national"), ("native", "nat")),
    ("sql", ("sql", "sqls", "sqled"), ("nosql", "sq")),
    ("legal", ("legal", "legals", "legally", "leg", "lege"), ("le", "illegal")),
]


def test_forms_worked_out_by_hand(spark):
    tokens = sorted({t for _, yes, no in FORMS for t in (*yes, *no)})
    resumes = spark.createDataFrame([(i, t, [], [], []) for i, t in enumerate(tokens)], RESUMES)
    jobs = spark.createDataFrame([(j, [w], []) for j, (w, _, _) in enumerate(FORMS)], JOBS)
    pairs = spark.createDataFrame([(i, j) for i in range(len(tokens)) for j in range(len(FORMS))], "resume_id long, job_id long")
    got = {(r.job_id, tokens[r.resume_id]) for r in K.keyword_hits(resumes, jobs, pairs).filter("in_all").collect()}
    for j, (word, yes, no) in enumerate(FORMS):
        assert all((j, t) in got for t in yes), word
        assert not any((j, t) in got for t in no if word not in t), word


def test_keywords_of_several_words_and_marks(spark):
    resumes = [(1, "We use C++ daily", ["node.js"], ["ci", "cd"], ["deployed the data pipelines"]), (2, "", [], [], []), (3, "pipeline", ["data"], [], [])]
    keywords = {"c++": {1}, "node.js": {1}, "ci/cd": {1, 2, 3}, "data pipeline": {1, 3}, "pipeline data": {1, 3}, "data deployment": {1},
                "data cobol": set(), "être": set(), "!!!": set(), "": {1, 2, 3}, "go": set(), "c": {1}, "a go": {1, 2, 3}}
    jobs = spark.createDataFrame([(1, list(keywords), [])], JOBS)
    pairs = spark.createDataFrame([(r[0], 1) for r in resumes], "resume_id long, job_id long")
    got = {k: set() for k in keywords}
    for r in K.keyword_hits(spark.createDataFrame(resumes, RESUMES), jobs, pairs).filter("in_all").collect():
        got[r.keyword].add(r.resume_id)
    assert got == keywords


def test_scopes_are_parts_of_the_whole(spark):
    """A hit of summary or skills is one of the whole text, and each scope counts what a resume of that scope alone would."""
    rnd = random.Random(7)
    pool = ["deploy", "deployment", "manager", "management", "code", "coded", "process", "data", "pipelines", "c++", "ci/cd", "go", "sql", "tests"]

    def some(k):
        return [" ".join(rnd.choices(pool, k=2)) for _ in range(rnd.randint(0, k))]

    resumes = [(i, " ".join(rnd.choices(pool, k=3)), some(2), some(2), some(3)) for i in range(40)]
    jobs = spark.createDataFrame([(j, [" ".join(rnd.choices(pool, k=rnd.randint(1, 3))) for _ in range(20)], ["ci cd"]) for j in range(4)], JOBS)
    pairs = spark.createDataFrame([(r[0], j) for r in resumes for j in range(4)], "resume_id long, job_id long")

    def hits(rows, scope):
        found = K.keyword_hits(spark.createDataFrame(rows, RESUMES), jobs, pairs)
        return {(r.resume_id, r.job_id, r.kind, r.pos) for r in found.filter(f"in_{scope}").collect()}

    whole = hits(resumes, "all")
    for scope, rows in (("summary", [(i, m, [], [], []) for i, m, *_ in resumes]), ("skills", [(i, "", s, t, []) for i, _, s, t, _ in resumes])):
        part = hits(resumes, scope)
        assert part <= whole and part == {h for h in hits(rows, "all") if h in whole}


def test_variants_meet_the_tokens_that_hit(spark):
    df = spark.createDataFrame([(w,) for w, _, _ in FORMS], "keyword string")
    got = {}
    for r in K.variant_index(df).collect():
        got.setdefault(r.word, set()).add(r.variant)
    for word, yes, no in FORMS:
        assert set(yes) <= got[word] and not set(no) & got[word]


def test_scores_of_known_cases(spark):
    resumes = spark.createDataFrame([(1, "Deployed things", ["java"], [], ["built pipelines"])], RESUMES)
    jobs = spark.createDataFrame([
        (1, [], []), (2, ["deployment", "deployment", "cobol"], []), (3, ["ci/cd"], []), (4, [], ["pipeline"])], JOBS)
    pairs = spark.createDataFrame([(1, j) for j in (1, 2, 3, 4)], "resume_id long, job_id long")
    rows = {r.job_id: (r.keyword_match, r.keyword_placement)
            for r in K.keyword_scores(K.pair_keyword_hits(resumes, jobs, pairs)).collect()}
    assert rows[1] == (15.0, 8.0)             # no keywords: neutral
    assert rows[2] == (13.3, 5.3)             # duplicates weigh double
    assert rows[3] == (20.0, 15.0)            # only short words: holds everywhere
    assert rows[4] == (10.0, 8.0)             # no hard keywords


def test_more_text_never_loses_a_hit(spark):
    jobs = spark.createDataFrame([(1, ["data pipeline", "sql", "managing"], ["team"])], JOBS)
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "resume_id long, job_id long")
    resumes = spark.createDataFrame([(1, "manager", ["data"], [], ["x"]), (2, "manager", ["data"], [], ["x", "pipelines sql team"])], RESUMES)
    hits = K.keyword_hits(resumes, jobs, pairs)
    less, more = ({r.keyword for r in hits.filter((F.col("resume_id") == i) & F.col("in_all")).collect()} for i in (1, 2))
    assert less == {"managing"} and less < more


def test_injected_keywords_are_the_new_ones(spark):
    jobs = spark.createDataFrame([(1, ["Spark", "Kafka", "sql x", "Go"], [])], JOBS)
    pairs = spark.createDataFrame([(1, 1)], "resume_id long, job_id long")
    before = spark.createDataFrame([(1, "spark jobs", ["sql"], ["x"], ["b"])], RESUMES)
    after = spark.createDataFrame([(1, "spark jobs", ["sql"], ["x"], ["used kafka"])], RESUMES)
    old, new = K.keywords_present(before, jobs, pairs), K.keywords_present(after, jobs, pairs)
    assert sorted(r.keyword for r in old.collect()) == ["Spark", "sql x"]   # matches across two list elements
    assert [r.keyword for r in K.keywords_injected(old, new).collect()] == ["Kafka"]


@pytest.mark.parametrize("letters", ["ab1", "ab .", "aé+ ", "数据a ", "+-. "])
def test_literals_are_what_contains_finds(spark, letters):
    rnd = random.Random(len(letters) + ord(letters[1]))
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 12))) for _ in range(60)] + ["", " ", "\n"]
    keywords = sorted({"".join(rnd.choices(letters, k=rnd.randint(0, 5))) for _ in range(80)})
    table = spark.createDataFrame([(i, t, t[:4], t[::-1]) for i, t in enumerate(texts)], "resume_id long, text_all string, text_part string, text_other string")
    known = W.written_dictionary(table.select("text_all"), spark.createDataFrame([(k,) for k in keywords], "keyword string"))
    got = {r.resume_id: r for r in W.text_index(table, known, ("all",)).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert set(got[i].literals_all) == {k for k in keywords if k and k in t}, t


def test_literals_of_reordered_text(spark):
    rows = [(1, "x c b", "b x c"), (2, "b", "b"), (3, "zz", "zz")]
    table = spark.createDataFrame(rows, "resume_id long, text_all string, text_verified string")
    words = spark.createDataFrame([("b x",), ("c b",), ("zz",), ("b",)], "keyword string")
    known = W.written_dictionary(table.select("text_all"), words)
    got = {r.resume_id: (set(r.literals_all), set(r.literals_verified)) for r in W.text_index(table, known, ("all",), ("verified",)).collect()}
    assert got == {1: ({"c b", "b"}, {"b x", "b"}), 2: ({"b"}, {"b"}), 3: ({"zz"}, {"zz"})}


def test_resumes_meet_numbers_and_not_the_lists_behind_the_units(spark):
    """A hundred tokens stand for the same three keywords: their lists are kept once, and a resume that has all tokens collects each keyword once."""
    tokens = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}legal" for i in range(100)]
    table = spark.createDataFrame([(1, " ".join(tokens)), (2, tokens[0])], "resume_id long, text_all string")
    known = W.written_dictionary(table.select("text_all"), spark.createDataFrame([("legal",), ("lega",), ("ega",)], "keyword string"))
    meanings, coded = W.coded_dictionary(known)
    assert coded.count() == 100 and meanings.count() == 1 and set(coded.columns) == {"unit", "code"}
    for r in W.text_index(table, known, ("all",)).collect():
        assert sorted(r.literals_all) == ["ega", "lega", "legal"]


@pytest.mark.parametrize("letters", ["ab +", "deings "])
def test_index_of_a_row_is_that_of_the_dictionary(spark, monkeypatch, letters):
    """Stems and keywords of every scope, also of tokens too long to be cut up, found inside the row and without an exchange."""
    rnd = random.Random(len(letters) + ord(letters[1]))
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(40)] + ["", " ", "a" * 300 + letters, "b a" * 100]
    keywords = sorted(k for k in {"".join(rnd.choices(letters, k=rnd.randint(0, 6))) for _ in range(60)} if not k or k.strip(" +"))
    rows = [(i, t, " ".join(t.split(" ")[1:3]), " ".join(reversed(t.split(" ")))) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "resume_id long, text_all string, text_part string, text_other string")
    wanted = spark.createDataFrame([(k,) for k in keywords], "keyword string")

    def index():
        return W.index_of([table.select("text_all")], wanted)(table, ("all", "part"), ("other",))

    def found(df):
        return {r[0]: [sorted(x) for x in r[1:]] for r in df.collect()}

    inside = index()
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(W, "ROW_KEYWORDS", 1)
    by_dictionary = index()
    assert "Exchange" in by_dictionary._jdf.queryExecution().executedPlan().toString() and by_dictionary.columns == inside.columns
    assert found(inside) == found(by_dictionary) and len(found(inside)) == len(texts)


def test_hits_are_the_same_however_jobs_and_resumes_meet(spark, monkeypatch):
    pool = ["deploy", "deployed", "c++", "ci/cd", "go", "sql", "managing", "manager", "node.js", ""]
    rnd = random.Random(3)
    resumes = spark.createDataFrame([(i, " ".join(rnd.choices(pool, k=3)), rnd.choices(pool, k=2), [], []) for i in range(10)], RESUMES)
    jobs = spark.createDataFrame([(j, rnd.choices(pool, k=5), rnd.choices(pool, k=2)) for j in range(3)], JOBS)
    pairs = spark.createDataFrame([(i, j) for i in range(9) for j in range(3)], "resume_id long, job_id long")

    def hits():
        return sorted(tuple(r) for r in K.keyword_hits(resumes, jobs, pairs).select("resume_id", "job_id", "kind", "pos", "keyword", *[f"in_{s}" for s in K.SCOPES]).collect())

    few = hits()
    monkeypatch.setattr(K, "BROADCAST_JOBS", 1)
    monkeypatch.setattr(W, "ROW_SOUGHT", 0)
    assert hits() == few and any(h[5] for h in few)


def test_related_skills_are_those_of_the_groups_of_jobs(spark):
    from rolefit.operators import skills as SK
    related = spark.createDataFrame([("manager", "manag"), ("managing", "manag"), ("coding", "cod"), ("coder", "cod")], "skill string, skill_group string")
    wanted = spark.createDataFrame([(1, ["Managing", "other"]), (2, ["managing"])], "job_id long, skills array<string>")
    small = SK.related_to(wanted, related)
    assert sorted(tuple(r) for r in small.collect()) == [("manager", "manag"), ("managing", "manag")]
    resumes = spark.createDataFrame([(1, ["manager", "coder"], ["Coding"])], "resume_id long, skills array<string>, tech_stack array<string>")
    plan = SK.own_groups(resumes.repartition("resume_id"), small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and SK.own_groups(resumes, small).first().own_by_group == {"manag": "manager"}
