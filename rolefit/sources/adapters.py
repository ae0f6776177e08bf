"""Adapter views: the driver's tables seen as resumes, jobs, pairs, lines, rewrites and sessions (FIXTURES.md).

The operators never read these tables themselves; they take DataFrames of the schemas of FIXTURES.md section 1.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.sources.corpus import read_table


class Views:
    """Lazily built adapter views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files. The pattern names the table alone, be it one file, which a stream takes only by a pattern, or a folder of them."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.folder}/{name}.parque[t]")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    def resumes_of(self, documents: DataFrame) -> DataFrame:
        return documents.selectExpr(
            "doc_id AS resume_id", "lang", "source", "text AS raw_text",
            r"split(text, '\n')[0] AS summary",
            r"filter(split(text, '\n'), (l, i) -> i > 0 AND trim(l) <> '') AS bullets",
            "sort_array(array_distinct(regexp_extract_all(lower(text), '[a-z]{7,}', 0))) AS skills",
            "sort_array(array_distinct(regexp_extract_all(lower(text), '[a-z]{10,}', 0))) AS tech_stack",
        )

    @cached_property
    def resumes(self) -> DataFrame:
        """The resume table: a projection of the documents, of which a plan reads the columns that it needs."""
        return self.resumes_of(self.documents)

    @cached_property
    def keyed_documents(self) -> DataFrame:
        """The documents dealt out by key, for plans whose resumes meet pairs: a text travels once, and what is derived from it stays where it is."""
        return self.documents.repartition("doc_id")

    @cached_property
    def keyed_resumes(self) -> DataFrame:
        return self.resumes_of(self.keyed_documents)

    @cached_property
    def jobs(self) -> DataFrame:
        none = "CAST(array() AS ARRAY<STRING>)"
        return self.table("benchmark").selectExpr(
            "item_id AS job_id", "text AS raw_text",
            f"""CASE WHEN item_id % 11 = 0 THEN {none} ELSE concat(
                  sort_array(array_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}', 0))),
                  CASE WHEN item_id % 5 = 0 THEN array('the theon', 'ci/cd') ELSE {none} END) END AS hard_keywords""",
            f"""CASE WHEN item_id % 11 = 0 THEN {none} ELSE
                  sort_array(array_distinct(filter(regexp_extract_all(lower(text), '[a-z]+', 0),
                    w -> length(w) BETWEEN 4 AND 5))) END AS soft_keywords""",
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Applications: a line item's part is the applying document, its supplier the benchmark item."""
        lines = self.table("lineitem").selectExpr("l_partkey AS resume_id", "l_suppkey AS job_id")
        docs = self.table("documents").selectExpr("doc_id AS resume_id")
        items = self.table("benchmark").selectExpr("item_id AS job_id")
        return lines.join(items, "job_id", "left_semi").join(docs, "resume_id", "left_semi").distinct()

    @cached_property
    def extract(self) -> DataFrame:
        return self.documents.selectExpr(
            "doc_id", "lang", "source",
            """concat(text, CASE doc_id % 6
                 WHEN 0 THEN concat(' Has ', CAST(doc_id % 9 AS STRING), '+ years of experience.')
                 WHEN 1 THEN ' From Jan 2015 to March 2021.'
                 WHEN 2 THEN concat(' linkedin.com/in/u', CAST(doc_id AS STRING))
                 WHEN 3 THEN concat(' GitHub.com/g-', CAST(doc_id % 40 AS STRING))
                 WHEN 4 THEN ' Only May 2019 here.' ELSE '' END) AS text""",
        )

    @cached_property
    def job_texts(self) -> DataFrame:
        return self.table("benchmark").selectExpr(
            "item_id AS job_id",
            """concat(text, CASE item_id % 5
                 WHEN 0 THEN ' Needs 3-5 years.' WHEN 1 THEN ' Needs 5 to 8 years.'
                 WHEN 2 THEN ' 4+ years of experience.' WHEN 3 THEN ' At least 7 years here.' ELSE '' END) AS raw_text""",
        )

    @cached_property
    def candidates(self) -> DataFrame:
        nations = self.table("nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
        return self.table("customer").join(nations, "c_nationkey").selectExpr(
            "c_custkey AS resume_id",
            "CASE WHEN c_custkey % 13 = 0 THEN 'Unknown' ELSE c_name END AS full_name",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('u', CAST(c_custkey AS STRING), '@example.com') END AS email",
            "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '555-0100' END AS phone",
            "repeat('x', CAST(c_custkey % 60 AS INT)) AS summary",
            "slice(array('sql','python','spark','excel'), 1, CAST(c_custkey % 5 AS INT)) AS skills",
            "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 25 AS DOUBLE) END AS total_years",
            "c_mktsegment AS primary_domain", "n_name AS location",
            "slice(array('AWS Certified','PMP','CKA'), 1, CAST(c_custkey % 4 AS INT)) AS certifications",
        )

    @cached_property
    def postings(self) -> DataFrame:
        nations = self.table("nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
        return self.table("supplier").join(nations, "s_nationkey").selectExpr(
            "s_suppkey AS job_id",
            "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 16 AS DOUBLE) END AS min_years",
            "CASE WHEN s_suppkey % 4 = 0 THEN 0D ELSE CAST(s_suppkey % 16 + 3 AS DOUBLE) END AS max_years",
            """array('intern','Entry-Level','mid|senior','Senior Level','staff','VP of Sales','n/a','manager')
                 [CAST(s_suppkey % 8 AS INT)] AS seniority_raw""",
            "array('WFO','Hybrid','Remote','In Office')[CAST(s_suppkey % 4 AS INT)] AS work_mode",
            "array('Immediate','30 days','15 Days',NULL)[CAST((s_suppkey DIV 4) % 4 AS INT)] AS notice_period",
            """array('machinery','building services','Mobile','household goods','Data Analytics')
                 [CAST(s_suppkey % 5 AS INT)] AS primary_domain""",
            # every third posting is in the plain nation, so that locations can also agree
            "CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE concat(n_name, ' Metro') END AS location",
            "slice(array('CKA','aws certified','CISSP'), 1, CAST(s_suppkey % 4 AS INT)) AS certifications_required",
        )

    @cached_property
    def applications(self) -> DataFrame:
        """Candidate-posting pairs: who ordered from whom."""
        orders = self.table("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS resume_id")
        lines = self.table("lineitem").selectExpr("l_orderkey", "l_suppkey AS job_id")
        return lines.join(orders, "l_orderkey").select("resume_id", "job_id").distinct()

    @cached_property
    def history(self) -> DataFrame:
        return self.history_of(self.table("orders"))

    def history_of(self, orders: DataFrame) -> DataFrame:
        return orders.selectExpr(
            "o_custkey AS resume_id",
            """row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 4 = 0 THEN o_orderkey
                 ELSE -CAST(date_format(o_orderdate, 'yyyyMMdd') AS BIGINT) END, o_orderkey) AS pos""",
            "o_orderpriority AS title", "concat('Co ', CAST(o_orderkey % 50 AS STRING)) AS company",
            """CASE WHEN o_orderkey % 17 = 0 THEN ''
                 WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'MM/yyyy')
                 WHEN o_custkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy')
                 ELSE date_format(o_orderdate, 'MMM yyyy') END AS start_date""",
            """CASE WHEN o_orderstatus = 'O' THEN 'Present' WHEN o_orderkey % 19 = 0 THEN NULL
                 ELSE date_format(o_orderdate, 'MMM yyyy') END AS end_date""",
        )

    @cached_property
    def education(self) -> DataFrame:
        """An education entry for every candidate; those with a balance under 3000 have no year, some others an empty one."""
        return self.table("customer").selectExpr(
            "c_custkey AS resume_id", "1 AS pos", "'BSc' AS degree",
            "concat('School ', CAST(c_custkey % 20 AS STRING)) AS institution",
            """CASE WHEN c_acctbal < 3000 THEN NULL WHEN c_custkey % 8 = 0 THEN ''
                 ELSE CAST(1990 + c_custkey % 30 AS STRING) END AS year""",
        )

    @cached_property
    def experience_lists(self) -> DataFrame:
        """History as one array of entries per candidate; every entry has two bullets."""
        entry = F.struct(
            "pos", "title", "company", F.lit(None).cast("string").alias("location"), "start_date", "end_date",
            F.array(F.concat(F.lit("Worked as "), "title"), F.concat(F.lit("At "), "company")).alias("bullets"))
        return self.history.groupBy("resume_id").agg(F.array_sort(F.collect_list(entry)).alias("experience"))

    @cached_property
    def education_lists(self) -> DataFrame:
        entry = F.struct("pos", "degree", "institution", F.lit(None).cast("string").alias("location"), "year")
        return self.education.groupBy("resume_id").agg(F.array_sort(F.collect_list(entry)).alias("education"))

    @cached_property
    def nested_resumes(self) -> DataFrame:
        certs = F.transform("certifications", lambda c: F.struct(
            c.alias("name"), F.lit(None).cast("string").alias("issuer"), F.lit("2020").alias("year")))
        return (self.candidates.withColumn("certifications", certs)
                .join(self.experience_lists, "resume_id", "left").join(self.education_lists, "resume_id", "left"))

    @cached_property
    def blanked_candidates(self) -> DataFrame:
        """Candidates as an extraction or a rewrite leaves them: odd ones lost their contact data, years and certificates."""
        return self.candidates.selectExpr(
            "resume_id", *[f"CASE WHEN resume_id % 2 = 1 THEN '' ELSE {c} END AS {c}" for c in ("full_name", "email", "phone")],
            "CASE WHEN resume_id % 2 = 1 THEN 0D ELSE total_years END AS total_years",
            "CASE WHEN resume_id % 2 = 1 THEN NULL ELSE location END AS location", "summary", "skills", "primary_domain",
            "CASE WHEN resume_id % 2 = 1 THEN slice(certifications, 1, 0) ELSE certifications END AS certifications")

    @cached_property
    def lines(self) -> DataFrame:
        numbered = self.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        return numbered.filter("trim(line) <> ''").selectExpr(
            "doc_id", "source", "CAST(pos DIV 40 AS BIGINT) AS page", "0 AS block", "pos AS line",
            "concat(CASE WHEN pos % 6 = 2 THEN '• ' WHEN pos % 6 = 4 THEN 'Tools: ' ELSE '' END, line) AS text",
            "CAST((pos % 40) * 12 + ((pos % 40) DIV 7) * 25 AS DOUBLE) AS y0",
            "CAST((pos % 40) * 12 + ((pos % 40) DIV 7) * 25 + 10 AS DOUBLE) AS y1",
        )

    @cached_property
    def rewrites(self) -> DataFrame:
        """Original and rewritten text of every line of a resume; line 0 is the summary."""
        return self.lines.selectExpr(
            "doc_id AS resume_id", "line AS bullet_idx", "text AS original_text",
            """CASE WHEN line % 3 = 0 THEN replace(text, 'the', 'each') WHEN line % 5 = 0 THEN concat(text, ' 42')
                 WHEN line % 11 = 0 THEN concat(text, ' and much more of it again') ELSE text END AS rewritten_text""",
        )

    @cached_property
    def rewritten_resumes(self) -> DataFrame:
        return self.rewritten_resumes_of(self.keyed_resumes)

    def rewritten_resumes_of(self, resumes: DataFrame) -> DataFrame:
        """Resumes of the rewritten lines, made inside each row; skills and tech stack as before."""
        marked = "concat(CASE WHEN i % 6 = 2 THEN '• ' WHEN i % 6 = 4 THEN 'Tools: ' ELSE '' END, l)"
        rewritten = """CASE WHEN i % 3 = 0 THEN replace(m, 'the', 'each') WHEN i % 5 = 0 THEN concat(m, ' 42')
            WHEN i % 11 = 0 THEN concat(m, ' and much more of it again') ELSE m END"""
        lines = f"transform(transform(split(raw_text, '\\n'), (l, i) -> IF(trim(l) = '', NULL, {marked})), (m, i) -> {rewritten})"
        return resumes.select("resume_id", "skills", "tech_stack", F.expr(lines).alias("lines")).filter(
            "exists(lines, l -> l IS NOT NULL)").selectExpr(
            "resume_id", "skills", "tech_stack", "lines[0] AS summary", "filter(lines, (l, i) -> i > 0 AND l IS NOT NULL) AS bullets")

    @cached_property
    def guard_flags(self) -> DataFrame:
        """Flags on every rewrite that got more words or another number; a few indices are out of range."""
        return self.rewrites.filter(
            "original_text <> rewritten_text AND startswith(rewritten_text, original_text)"
        ).selectExpr(
            "resume_id", "'experience' AS section", "0 AS entry_index",
            "CASE WHEN bullet_idx % 30 = 5 THEN 100000 + bullet_idx ELSE bullet_idx END AS bullet_index",
            "original_text", "rewritten_text",
        )

    def sections_of(self, items: DataFrame, history: DataFrame, tail: str = "") -> DataFrame:
        """Units of every section of a resume, in one pass over its lists and one over its history; each history entry is a project of two bullets."""
        lists = f"""inline(flatten(array(
            array(named_struct('section', 'summary', 'entry_idx', 0, 'bullet_idx', 0, 'text', concat(summary, '{tail}'))),
            transform(skills, (s, i) -> named_struct('section', 'skills', 'entry_idx', 0, 'bullet_idx', i, 'text', s)),
            transform(slice(skills, 1, 2), (s, i) -> named_struct('section', 'tech_stack', 'entry_idx', 0, 'bullet_idx', i, 'text', concat(s, '{tail}'))),
            transform(certifications, (s, i) -> named_struct('section', 'certifications', 'entry_idx', 0, 'bullet_idx', i, 'text', s)),
            transform(institutions, (s, i) -> named_struct('section', 'education', 'entry_idx', i, 'bullet_idx', 0, 'text', concat('BSc, ', s))))))"""
        listed = items.join(self.candidates.select("resume_id", "summary"), "resume_id").selectExpr("resume_id", lists)
        projects = history.selectExpr("resume_id", "'projects' AS section", "CAST(pos - 1 AS INT) AS entry_idx",
                                      "posexplode(array(concat('Worked as ', title), concat('At ', company))) AS (bullet_idx, text)")
        return listed.unionByName(projects)

    @cached_property
    def original_sections(self) -> DataFrame:
        return self.sections_of(self.candidate_items, self.history)

    @cached_property
    def rewritten_sections(self) -> DataFrame:
        """Summary and tech stack of every resume are longer, some lists and schools changed, and all projects from the thirteenth on are gone."""
        return self.sections_of(self.rewritten_items, self.rewritten_history.filter("pos <= 12"), " and more")

    @cached_property
    def section_flags(self) -> DataFrame:
        """Flags on all kinds of sections: what the rewrite added to lists and schools, a third of the summaries, a section that no resume has, and projects that
        changed or went, by bullet, by entry or with an index out of range."""
        flag = "named_struct('section', '{}', 'entry_index', -1, 'bullet_index', -1, 'original_text', {}, 'rewritten_text', {}, 'revert_to', {})"
        none = "CAST(NULL AS STRING)"
        kinds = (("skills", 3, none, "IF(resume_id % 5 = 0, '', 'Added Kafka')", none), ("certifications", 5, none, "'CISSP'", none),
                 ("education", 11, "'School'", "'SCHOOL'", "IF(resume_id % 2 = 0, 'school', 'Elsewhere College')"),
                 ("summary", 2, "summary", "concat(summary, ' and more')", none), ("languages", 17, none, "'Welsh'", none))
        listed = ", ".join(f"IF(resume_id % {part} = 0, {flag.format(name, *texts)}, NULL)" for name, part, *texts in kinds)
        lists = self.candidates.selectExpr("resume_id", f"inline(array_compact(array({listed})))")
        projects = self.history.filter("pos % 7 = 3 OR pos > 12").selectExpr(
            "resume_id", "'projects' AS section", "CAST(IF(resume_id % 13 = 5, 100 + pos, pos - 1) AS INT) AS entry_index",
            "CASE resume_id % 3 WHEN 1 THEN -1 WHEN 2 THEN IF(pos = 3, 2, 1) ELSE 1 END AS bullet_index", "concat('At ', company) AS original_text",
            "concat('At ', company, ' Ltd') AS rewritten_text", f"{none} AS revert_to")
        return lists.unionByName(projects)

    @cached_property
    def section_verdicts(self) -> DataFrame:
        return self.candidates.selectExpr("resume_id", "CASE resume_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'perhaps' ELSE 'false' END AS is_clean")

    @cached_property
    def section_approvals(self) -> DataFrame:
        return self.candidates.filter("resume_id % 4 < 2").selectExpr("resume_id", "IF(resume_id % 4 = 0, 'kafka', 'Go') AS skill")

    @cached_property
    def submissions(self) -> DataFrame:
        return self.submissions_of(self.table("events"))

    def submissions_of(self, events: DataFrame) -> DataFrame:
        return events.selectExpr(
            "event_id", "ts", "user_id * 100 + extract(day FROM ts) AS session_id",
            """CASE event_type WHEN 'view' THEN 'uploaded' WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'analyzed'
                 WHEN 'purchase' THEN 'optimized' ELSE 'failed' END AS status""",
        )

    @cached_property
    def doc_facts(self) -> DataFrame:
        return self.doc_facts_of(self.documents)

    def doc_facts_of(self, documents: DataFrame) -> DataFrame:
        return documents.selectExpr(
            "doc_id", "source", "text", "lang",
            """CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png'
                 ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS content_type""",
            "n_chars * 1000 AS n_bytes", "doc_id % 6 AS n_tables", "doc_id % 8 = 3 AS has_textbox",
            "doc_id % 13 <> 0 AS readable",
        )

    @cached_property
    def section_facts(self) -> DataFrame:
        sections = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("section_no")
        return self.table("documents").select("doc_id", sections).selectExpr(
            "doc_id", "section_no",
            """CASE (doc_id + section_no) % 3 WHEN 0 THEN 'Name and Email' WHEN 1 THEN 'Page 1' ELSE '' END
                 AS header_text""",
            "1 + (doc_id + section_no) % 2 AS n_cols",
        )

    @cached_property
    def raw_entries(self) -> DataFrame:
        return self.history.selectExpr(
            "resume_id", "pos",
            """CASE pos % 6 WHEN 0 THEN '{"company":"X"}' WHEN 1 THEN '{bad'
                 ELSE concat('{"title":"', title, '","company":"', company, '"}') END AS raw_json""",
        )

    def raw_entries_of(self, kind: str) -> DataFrame:
        """Entries of the other sections as a model writes them; some lack a field that they must have, some are no JSON."""
        fields = {"education": ("degree", "title", "institution", "company"), "projects": ("name", "company", "description", "title"),
                  "certifications": ("name", "title", "issuer", "company")}[kind]
        return self.history.selectExpr(
            "resume_id", "pos",
            f"""CASE pos % 6 WHEN 0 THEN concat('{{"{fields[2]}":"', {fields[3]}, '"}}') WHEN 1 THEN '{{bad'
                 ELSE concat('{{"{fields[0]}":"', {fields[1]}, '","{fields[2]}":"', {fields[3]}, '"}}') END AS raw_json""",
        )

    @cached_property
    def byte_texts(self) -> DataFrame:
        """Pages as the bytes of files, every third with a byte in front that is no UTF-8."""
        return self.table("pages").selectExpr("page_id", "concat(IF(page_id % 3 = 0, X'FF', X''), CAST(html AS BINARY)) AS content")

    @cached_property
    def candidate_items(self) -> DataFrame:
        schools = self.education.groupBy("resume_id").agg(F.collect_set("degree").alias("degrees"), F.collect_set("institution").alias("institutions"))
        return self.candidates.select("resume_id", "skills", "certifications").join(schools, "resume_id", "left")

    @cached_property
    def rewritten_items(self) -> DataFrame:
        """The same items after a rewrite that named a new technology, certificate, degree or school here and there."""
        return self.candidate_items.selectExpr(
            "resume_id", "IF(resume_id % 3 = 0, array_append(skills, 'Kafka'), skills) AS skills",
            "IF(resume_id % 5 = 0, array_append(certifications, 'CISSP'), certifications) AS certifications",
            "IF(resume_id % 7 = 0, array_append(degrees, 'MSc'), degrees) AS degrees",
            "IF(resume_id % 11 = 0, transform(institutions, s -> upper(concat(s, IF(resume_id % 2 = 0, ' East', '')))), institutions) AS institutions")

    def confirmations_of(self, pairs: DataFrame) -> DataFrame:
        return pairs.selectExpr(
            "resume_id", "job_id", "resume_id % 2 = 0 AS ack_experience", "resume_id % 3 = 0 AS ack_certification",
            "(resume_id + job_id) % 3 = 0 AS ack_domain", "job_id % 2 = 0 AS rewrite_summary", "job_id % 3 <> 0 AS rewrite_bullets",
            "job_id % 5 = 0 AS reorder_sections",
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding")

    # --- inputs of the later sections ------------------------------------------------------------------------------
    @cached_property
    def skill_jobs(self) -> DataFrame:
        return self.jobs.selectExpr("job_id", "hard_keywords AS required_skills", "soft_keywords AS technologies")

    @cached_property
    def related_skills(self) -> DataFrame:
        """Skills that are one word without its ending are related."""
        own = self.resumes.select(F.explode(F.concat("skills", "tech_stack")).alias("skill"))
        wanted = self.jobs.select(F.explode(F.concat("hard_keywords", "soft_keywords")).alias("skill"))
        return own.union(wanted).select(F.lower("skill").alias("skill")).distinct().selectExpr(
            "skill", "regexp_replace(skill, '(ation|tion|ment|ing|ed|er|al|ly|s)$', '') AS skill_group")

    @staticmethod
    def decided() -> Column:
        """Decisions (skill, add) on the open items of a pair row; add is null where nobody decided yet, which is so for names of more than seven letters."""
        return F.expr("""transform(filter(items, i -> i.status IN ('can_add', 'partial')),
            i -> struct(i.skill AS skill, CASE WHEN length(i.skill) <= 7 THEN job_id % 2 = 0 END AS add))""")

    @cached_property
    def confirmations(self) -> DataFrame:
        return self.acknowledged_of(self.pairs)

    def acknowledged_of(self, pairs: DataFrame) -> DataFrame:
        """Confirmations of the applications in pairs, with the acknowledged categories as a list."""
        return self.confirmations_of(pairs).selectExpr(
            "*", """filter(array(IF(ack_experience, 'experience_gap', NULL), IF(ack_certification, 'certification_missing', NULL),
                 IF(ack_domain, 'domain_mismatch', NULL)), c -> c IS NOT NULL) AS acknowledged""")

    @cached_property
    def new_skills(self) -> DataFrame:
        """Every document gets the same approved skills."""
        skills = ["Docker", "PostgreSQL", "GPT-4 API", "Leadership", "System design"]
        return self.table("documents").select(
            "doc_id", F.posexplode(F.array(*[F.lit(s) for s in skills])).alias("ord", "skill"))

    @cached_property
    def evidence_jobs(self) -> DataFrame:
        return self.postings.selectExpr("job_id", "seniority_raw AS job_title", "primary_domain", "min_years", "max_years",
                                        "certifications_required AS required_skills")

    @cached_property
    def unit_pairs(self) -> DataFrame:
        return self.rewrites.selectExpr(
            "resume_id", "CASE WHEN bullet_idx = 0 THEN 'summary' ELSE 'experience' END AS section", "0 AS entry_idx",
            "bullet_idx", "original_text", "rewritten_text")

    @cached_property
    def original_units(self) -> DataFrame:
        return self.unit_pairs.withColumnRenamed("original_text", "text").drop("rewritten_text")

    @cached_property
    def rewritten_units(self) -> DataFrame:
        return self.unit_pairs.withColumnRenamed("rewritten_text", "text").drop("original_text")

    @cached_property
    def rewritten_history(self) -> DataFrame:
        """History in which every seventh entry got another company form."""
        return self.history.withColumn("company", F.expr("CASE WHEN pos % 7 = 3 THEN concat(company, ' Ltd') ELSE company END"))

    @cached_property
    def verdicts(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS resume_id", "CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'no' WHEN 2 THEN ' FALSE' END AS is_clean")

    @cached_property
    def approved(self) -> DataFrame:
        """In English resumes the reviewer approved the number that some rewrites add, in others a skill that no rewrite has."""
        return self.table("documents").selectExpr("doc_id AS resume_id", "IF(lang = 'en', '42', 'approved elsewhere') AS skill")

    @cached_property
    def suggestions(self) -> DataFrame:
        """What a rewrite advises the candidate, in order: to back up every number that it added."""
        return self.rewrites.filter("endswith(rewritten_text, ' 42') AND NOT endswith(original_text, ' 42')").selectExpr(
            "resume_id", "bullet_idx AS ord", "concat('Back up the number in line ', CAST(bullet_idx AS STRING)) AS suggestion")

    @cached_property
    def stream_blocks(self) -> DataFrame:
        """Line blocks in a stream order that is not their order on the page, for two documents in three."""
        return self.lines.selectExpr("doc_id", "page", "CASE WHEN doc_id % 3 = 0 THEN line ELSE (line % 5) * 100000 + line END AS stream_pos",
                                     "2000 - y0 AS y")

    @cached_property
    def templates(self) -> DataFrame:
        text = "Dear {{FULL_NAME}}, we wrote to {{EMAIL}} about {{LOCATION}}.\n{{MISSING}} Last: {{EXP_1_TITLE}} {{EXP_1_DATES}}"
        return self.table("customer").select(F.col("c_custkey").alias("resume_id"), F.lit(text).alias("template"))
