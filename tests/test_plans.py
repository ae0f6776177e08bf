"""Plan shape: no cross joins, no Python in the hot path, pruned scans."""

import pytest

from rolefit.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
PYTHON_ALLOWED = ("e2_", "e3_", "e8_flags_with_domain", "e9_", "g1_top_jobs_all", "i3_entry_align", "j2_", "j3_", "k3_stream_expiry")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("k1_", "k2_stream", "k3_stream", "k4_stream"))])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON_ALLOWED):
        assert "Python" not in text and "MapInPandas" not in text


def test_scan_is_pruned_and_filtered(spark):
    text = plan(QUERIES["e1_flag_experience"](spark, FOLDER))
    assert "c_acctbal" not in text and "l_extendedprice" not in text


def test_write_report_partitions(spark, tmp_path):
    from rolefit.operators.report import write_report
    df = spark.range(100).selectExpr("id", "id % 3 AS job_id")
    write_report(df, str(tmp_path / "out"), by="job_id")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted(r.job_id for r in back.select("job_id").distinct().collect()) == [0, 1, 2]


def text_below_job_exchange(spark, name) -> list[str]:
    """Exchanges on the job key alone, in a plan without broadcasts, below which a resume text lies."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(QUERIES[name](spark, FOLDER)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(job_id" in line and "resume_id" not in line.split("),")[0]:
            depth = line.index("Exchange")
            for below in lines[i + 1:]:
                if len(below) - len(below.lstrip(" :+-*(0123456789)")) <= depth:
                    break
                if "text_all" in below:
                    found.append(line)
                    break
    return found


@pytest.mark.parametrize("name", ["c3_keyword_hits", "c7_keywords_present", "d5_score_total", "d6_score_after"])
def test_texts_are_not_shuffled_by_job(spark, name):
    assert text_below_job_exchange(spark, name) == []


#: Hash exchanges without broadcasts, before anything is reused: what each report may need at most.
EXCHANGES = {"e9_flag_gate": 25, "f2_skill_summary": 20, "j3_analysis_table": 45, "j2_outcome_table": 80, "h6_sections_changed": 25}


@pytest.mark.parametrize("name", EXCHANGES)
def test_reports_keep_to_few_exchanges(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(QUERIES[name](spark, FOLDER)).count("Exchange hashpartitioning") <= EXCHANGES[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["c3_keyword_hits", "c4_keyword_match", "e9_flag_gate"])
def test_no_text_is_searched_above_the_pair_join(spark, name):
    lines = plan(QUERIES[name](spark, FOLDER)).splitlines()
    pair_join = next(i for i, line in enumerate(lines) if "Join" in line and "resume_id" in line)
    assert not any("text_all" in line for line in lines[:pair_join + 1])


def test_written_partitions_replace_only_their_own(spark, tmp_path):
    from rolefit.operators.report import write_partitions
    out = str(tmp_path / "table")

    def table():
        return sorted(tuple(r) for r in spark.read.parquet(out).select("id", "job_id", "v").collect())

    write_partitions(spark.range(60).selectExpr("id", "id % 3 AS job_id", "'a' AS v"), out, "job_id")
    first = table()
    write_partitions(spark.read.parquet(out), out, "job_id")  # from itself: nothing changes
    assert table() == first
    write_partitions(spark.createDataFrame([(7, 1, "b")], "id long, job_id long, v string"), out, "job_id")
    assert table() == sorted([r for r in first if r[1] != 1] + [(7, 1, "b")])


def test_only_texts_that_pairs_ask_for_are_searched(spark):
    from rolefit.operators import keywords as K
    from rolefit.plans.spine import job_side, resume_side
    from rolefit.sources.adapters import Views
    v = Views(spark, FOLDER)
    pairs = spark.createDataFrame([(3, 1), (3, 2), (5, 1)], "resume_id long, job_id long")
    _, keywords = job_side(v, {"after"}, None)
    side = resume_side(v, {"after"}, pairs, keywords, None)
    assert sorted(r.resume_id for r in side.select("resume_id").collect()) == [3, 5]
    lines = plan(side).splitlines()
    semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    assert len(semi) == 2 and not any("text_all" in line for line in lines[semi[-1] + 1:])
