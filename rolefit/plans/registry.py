"""Every operator of the library wired to the adapter views, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.operators import align as AL
from rolefit.operators import flags as E
from rolefit.operators import intake as A
from rolefit.operators import keywords as K
from rolefit.operators import match as M
from rolefit.operators import nearest as N
from rolefit.operators import records as B
from rolefit.operators import report as J
from rolefit.operators import signals as S
from rolefit.operators import skills as SK
from rolefit.operators import verify as V
from rolefit.plans import scoring
from rolefit.plans.spine import pair_rows, scoped_flags, scoped_section_flags, verified_sections, verified_units
from rolefit.sources.adapters import Views
from rolefit.sources.corpus import decode_utf8, read_text_corpus, work_folder
from rolefit.streaming import sessions as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a plan that takes the adapter views."""
    def add(plan: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Views(spark, folder))
        return plan
    return add


# --- intake ----------------------------------------------------------------------------------------------------------
query("a1_intake_gate")(lambda v: A.gate(v.doc_facts).select("doc_id", "reason"))
query("a1_intake_gate_jd")(lambda v: A.gate(v.doc_facts, "jd").select("doc_id", "reason"))
query("a1_intake_gate_template")(lambda v: A.intake_gate(v.doc_facts, "template")[0].select("doc_id", "content_type"))
query("a1_gate_report")(lambda v: A.gate_report(v.doc_facts))
query("a2_text_source")(lambda v: read_text_corpus(v.spark, f"{v.folder}/pages.parquet", text_col="html").select(
    "page_id", F.length("html").alias("n_chars"), F.md5("html").alias("digest")))
query("a2_text_bytes")(lambda v: v.byte_texts.select("page_id", decode_utf8(F.col("content")).alias("text")).select(
    "page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")))
query("a3_language_audit")(lambda v: A.language_audit(v.extract))
query("a4_contact_extract")(lambda v: A.contact_extract(v.extract))
query("a4_contact_coverage")(lambda v: A.contact_coverage(A.contact_extract(v.extract)))
query("a4_shared_contacts")(lambda v: A.shared_contacts(A.contact_extract(v.extract)))
query("a5_experience_estimate")(lambda v: A.experience_estimate(v.extract))
query("a6_requirement_extract")(lambda v: A.requirement_extract(v.job_texts))
query("a6_requirement_histogram")(lambda v: A.requirement_histogram(A.requirement_extract(v.job_texts)))


# --- records -----------------------------------------------------------------------------------------------------------
@query("b1_profile_assemble")
def _profile_assemble(v: Views) -> DataFrame:
    base = v.candidates.select("resume_id", "full_name", "email", "phone", "total_years")
    profile = B.profile_assemble(base, v.blanked_candidates.drop("certifications"), v.experience_lists, v.education_lists)
    sizes = [F.size(c).alias(f"n_{c}") for c in ("skills", "experience", "education")]
    return profile.select("resume_id", "full_name", "email", "phone", "location", "summary", "primary_domain", "total_years", *sizes)


query("b2_entries")(lambda v: B.entry_quarantine(v.raw_entries)[0].select("resume_id", "pos", "title", "company"))
query("b2_quarantine")(lambda v: B.entry_quarantine(v.raw_entries)[1])
for kind in ("education", "projects", "certifications"):
    query(f"b2_{kind}")(lambda v, kind=kind: B.entry_quarantine(v.raw_entries_of(kind), kind)[0].select(
        "resume_id", "pos", *B.REQUIRED_FIELDS[kind]))
    query(f"b2_{kind}_quarantine")(lambda v, kind=kind: B.entry_quarantine(v.raw_entries_of(kind), kind)[1])
query("b3_seniority")(lambda v: B.label_normalise(v.postings, "seniority_raw", "seniority", "level").select(
    "job_id", "seniority_raw", "level"))
query("b3_status")(lambda v: B.label_normalise(v.table("part"), "p_type", "status", "status").select("p_partkey", "status"))
query("b3_number")(lambda v: B.label_normalise(v.table("part").select("p_partkey", "p_brand"), "p_brand", "number", "number"))
query("b3_boolean")(lambda v: B.label_normalise(v.submissions, "status", "boolean", "flag").select("event_id", "flag"))
query("b3_unmatched_labels")(lambda v: B.unmatched_labels(v.postings, "seniority_raw"))
query("b4_experience")(lambda v: B.profile_unnest(v.nested_resumes)["experience"].select(
    "resume_id", "pos", "title", "company", "start_date", "end_date", F.concat_ws("|", "bullets").alias("bullets")))
query("b4_placeholder_rows")(lambda v: B.placeholder_rows(v.nested_resumes))
query("b5_skill_union")(lambda v: B.skill_union(v.resumes))
query("b5_skill_frequency")(lambda v: B.skill_frequency(v.resumes))
query("b6_contact_restore")(lambda v: B.contact_restore(v.blanked_candidates, v.candidates).select(
    "resume_id", "full_name", "email", "phone", "location", F.concat_ws("|", "certifications").alias("certifications")))

# --- keywords ------------------------------------------------------------------------------------------------------
query("c1_token_index")(lambda v: K.token_index(v.resumes))
query("c2_variant_index")(lambda v: K.variant_index(K.job_keywords(v.jobs)))
query("c3_keyword_hits")(lambda v: K.keyword_hits(v.keyed_resumes, v.jobs, v.pairs))
query("c4_keyword_match")(lambda v: K.keyword_match(scoring.pair_hits(v, ("all",))))
query("c5_keyword_placement")(lambda v: K.keyword_placement(scoring.pair_hits(v)))
query("c6_keyword_gap")(lambda v: K.keyword_gap(K.keyword_hits(v.keyed_resumes, v.jobs, v.pairs, ("all",))))
query("c6_most_missed")(lambda v: K.most_missed(K.keyword_gap(K.keyword_hits(v.keyed_resumes, v.jobs, v.pairs, ("all",))), 5))
query("c7_keywords_present")(lambda v: K.keywords_present(v.rewritten_resumes, v.jobs, v.pairs))
query("c7_keywords_injected")(lambda v: K.keywords_injected(
    K.keywords_present(v.keyed_resumes, v.jobs, v.pairs), K.keywords_present(v.rewritten_resumes, v.jobs, v.pairs)))

# --- signals ---------------------------------------------------------------------------------------------------------
query("d1_section_completeness")(lambda v: S.section_completeness(v.candidates, v.history, v.education))
query("d1_completeness_by_source")(lambda v: S.completeness_by_source(
    S.section_completeness(v.candidates, v.history, v.education), v.resumes))
query("d2_format_parsability")(lambda v: S.format_parsability(v.doc_facts, v.section_facts))
query("d3_date_consistency")(lambda v: S.date_consistency(v.candidates, v.history))
query("d4_text_health")(lambda v: S.text_health(v.documents))
query("d4_health_by_source")(lambda v: S.health_by_source(v.documents))
query("d5_score_total")(scoring.scores_before)
query("d5_top_jobs")(lambda v: S.rank_pairs(scoring.scores_before(v).select("resume_id", "job_id", "total"), 5))
query("d5_top_resumes")(lambda v: S.rank_pairs(scoring.scores_before(v).select("resume_id", "job_id", "total"), 10, by="job_id"))
query("d6_score_after")(scoring.scores_after)
query("d7_score_bands")(lambda v: S.score_bands(scoring.scores_before(v)))
query("d7_band_counts")(lambda v: S.band_counts(S.score_bands(scoring.scores_before(v))))


# --- flags -------------------------------------------------------------------------------------------------------------
def context(v: Views) -> DataFrame:
    return E.pair_context(v.candidates, v.postings, v.applications)


def similarity(v: Views) -> DataFrame:
    return E.domain_similarity(E.domain_pairs(context(v)))


query("e1_flag_experience")(lambda v: E.flag_experience(context(v)))
query("e2_domain_tiers")(lambda v: similarity(v).select(
    "domain_a", "domain_b", "tier", F.when(F.col("tier") != "fuzzy", F.col("similarity")).alias("similarity")))
query("e2_domain_similarity")(similarity)
query("e3_flag_domain")(lambda v: E.flag_domain(context(v)))
query("e4_flag_seniority")(lambda v: E.flag_seniority(context(v)))
query("e5_flag_certifications")(lambda v: E.flag_certifications(context(v)).drop("item_ord"))
query("e5_missing_certifications")(lambda v: E.missing_certifications(context(v)))
query("e6_flag_location")(lambda v: E.flag_location(context(v)))
query("e7_flag_notice")(lambda v: E.flag_notice(context(v)))
query("e8_flags_all")(lambda v: E.run_flags(context(v)))
query("e8_flags_with_domain")(lambda v: E.run_flags(context(v), domains=True))


# --- gate, skills ------------------------------------------------------------------------------------------------------
def skill_items(v: Views) -> DataFrame:
    return SK.skill_breakdown(v.keyed_resumes, v.skill_jobs, v.pairs, v.related_skills)


def entries(v: Views) -> DataFrame:
    return AL.entry_segment(v.lines)


query("e9_flag_gate")(lambda v: E.flag_gate(pair_rows(v, "flags", "skills")))
query("e9_known_gaps")(lambda v: E.known_gaps(pair_rows(v, "flags")))
query("f1_skill_breakdown")(skill_items)
query("f2_skill_summary")(lambda v: SK.skill_summary(pair_rows(v, "skills")))


@query("f3_skill_merge")
def _merge(v: Views) -> DataFrame:
    """Approved skills by name, then the keywords of the job that the rewritten resume contains."""
    rows = pair_rows(v, "skills", "after", "lists")
    approved = F.sort_array(F.transform(F.filter("decisions", lambda d: d["add"]), lambda d: d["skill"]))
    rows = rows.withColumn("added", F.concat(approved, F.coalesce("terms_after", F.array().cast("array<string>"))))
    return SK.merged_skills(rows).select("resume_id", "job_id", F.array_join("skills", "|").alias("skills"), F.array_join("tech_stack", "|").alias("tech_stack"))


query("f4_skill_route")(lambda v: SK.skill_route(SK.category_lines(entries(v)), v.new_skills))
query("f4_routed_lines")(lambda v: SK.routed_lines(SK.skill_route(SK.category_lines(entries(v)), v.new_skills)))
query("f5_category_lines")(lambda v: SK.category_lines(entries(v)).select("doc_id", "pos.page", "pos.block", "pos.entry", "text"))


# --- match -------------------------------------------------------------------------------------------------------------
def match_before(v: Views) -> DataFrame:
    resume_vecs = v.vectors.withColumnRenamed("vec_id", "resume_id")
    job_vecs = v.vectors.withColumnRenamed("vec_id", "job_id")
    lines = v.table("lineitem").selectExpr("l_partkey AS resume_id", "l_suppkey AS job_id")
    return M.semantic_match(resume_vecs, job_vecs, lines.distinct())


def match_after(v: Views) -> DataFrame:
    """After the rewrite: a mirrored score for the pairs that matched at all, nothing for the others."""
    return match_before(v).filter("match_score > 0").select(
        "resume_id", "job_id", F.bround(100 - F.col("match_score"), 2).alias("match_score"))


query("g1_semantic_match")(match_before)
query("g1_top_jobs")(lambda v: S.rank_pairs(match_before(v), 3, score="match_score"))
query("g1_top_jobs_all")(lambda v: N.top_matches(
    v.vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "resume_id"), v.vectors.withColumnRenamed("vec_id", "job_id"), 5))
query("g2_match_uplift")(lambda v: M.match_uplift(match_before(v), match_after(v)))
query("g3_evidence_table")(lambda v: M.evidence_table(v.nested_resumes, v.evidence_jobs, v.applications))
query("g3_evidence_sizes")(lambda v: M.evidence_sizes(M.evidence_table(v.nested_resumes, v.evidence_jobs, v.applications)))


# --- verification ------------------------------------------------------------------------------------------------------
def changes(v: Views) -> DataFrame:
    return V.change_map(v.unit_pairs)


def item_facts(records: DataFrame) -> DataFrame:
    """Technologies, certifications, degrees and institutions of records that list them."""
    kinds = {"skills": "technology", "certifications": "certification", "degrees": "degree", "institutions": "institution"}
    facts = [V.list_facts(records, column, kind) for column, kind in kinds.items()]
    return facts[0].unionByName(facts[1]).unionByName(facts[2]).unionByName(facts[3])


query("h1_change_map")(lambda v: changes(v).select(
    "resume_id", F.col("ord.s").alias("section_ord"), "ord.bullet_idx", "ord.form", "key", "new_text"))
query("h2_change_dedupe")(lambda v: V.change_dedupe(changes(v)).select("resume_id", "norm", "key", "new_text"))
query("h3_length_check")(lambda v: V.length_check(v.unit_pairs, v.resumes.select("resume_id", "raw_text")))
query("h3_length_violations")(lambda v: V.length_violations(V.length_check(v.unit_pairs, v.resumes.select("resume_id", "raw_text"))))
query("h4_novelty_flags")(lambda v: V.novelty_flags(
    V.number_facts(v.original_units).unionByName(V.history_facts(v.history)),
    V.number_facts(v.rewritten_units).unionByName(V.history_facts(v.rewritten_history)), v.approved))
query("h4_novel_items")(lambda v: V.novelty_flags(
    item_facts(v.candidate_items), item_facts(v.rewritten_items), v.approved))
query("h5_revert_scope")(scoped_flags)
query("h5_revert_apply")(verified_units)
query("h5_section_scope")(scoped_section_flags)
query("h5_section_apply")(verified_sections)
query("h6_sections_changed")(lambda v: V.sections_changed(v.original_units, verified_units(v), v.confirmations).select(
    "resume_id", "job_id", F.array_join("sections", "|").alias("sections")))
query("h6_section_counts")(lambda v: V.section_counts(V.sections_changed(v.original_units, verified_units(v), v.confirmations)))

# --- alignment ---------------------------------------------------------------------------------------------------------
query("i1_entry_segment")(entries)
query("i2_normalise_compare")(lambda v: AL.text_normalise(v.lines, "compare").select("doc_id", "line", "normalised"))
query("i2_normalise_ascii")(lambda v: AL.text_normalise(v.lines, "ascii").select("doc_id", "line", "normalised"))
query("i2_normalise_keep_bullet")(lambda v: AL.text_normalise(v.lines, "ascii_keep_bullet").select("doc_id", "line", "normalised"))
query("i2_charset_report")(lambda v: AL.charset_report(v.lines))
query("i3_exact_candidates")(lambda v: AL.exact_candidates(
    AL.align_keys(V.change_dedupe(changes(v))), AL.align_entries(entries(v))).select("doc_id", "key", "page", "block", "entry"))
query("i3_prefix_candidates")(lambda v: AL.prefix_candidates(
    AL.align_keys(V.change_dedupe(changes(v))), AL.align_entries(entries(v))).select("doc_id", "key", "page", "block", "entry", "tier"))
query("i3_entry_align_prefix")(lambda v: AL.prefix_align(V.change_dedupe(changes(v)), entries(v)))
query("i3_entry_align")(lambda v: AL.entry_align(V.change_dedupe(changes(v)), entries(v)))


@query("i4_align_gate")
def _align_gate(v: Views) -> DataFrame:
    deduped = V.change_dedupe(changes(v))
    exact = AL.exact_candidates(AL.align_keys(deduped), AL.align_entries(entries(v)))
    return AL.align_gate(deduped, exact, v.table("documents"))


query("i5_text_apply")(lambda v: AL.text_apply(v.lines.withColumnRenamed("line", "pos"), V.registered_changes(changes(v))))
query("i5_rebuilt_text")(lambda v: AL.rebuilt_text(
    AL.text_apply(v.lines.withColumnRenamed("line", "pos"), V.registered_changes(changes(v)))))
query("i6_reading_order")(lambda v: AL.reading_order(v.stream_blocks))
query("i7_template_merge")(lambda v: AL.template_merge(v.templates, B.placeholder_rows(v.nested_resumes)).select("resume_id", "text"))
query("i7_unresolved_tokens")(lambda v: AL.unresolved_tokens(v.templates, B.placeholder_rows(v.nested_resumes)))
query("i7_unused_placeholders")(lambda v: AL.unused_placeholders(v.templates, B.placeholder_rows(v.nested_resumes)))

# --- reports -----------------------------------------------------------------------------------------------------------
query("j1_score_delta_report")(lambda v: J.delta_rows(pair_rows(v, "scores", "scores_after")))
query("j1_score_delta_means")(lambda v: J.score_delta_means(J.delta_rows(pair_rows(v, "scores", "scores_after"))))


@query("j2_outcome_table")
def _outcome(v: Views) -> DataFrame:
    rows = pair_rows(v, "flags", "skills", "scores", "scores_after", "match", "outcome")
    # after the rewrite: a mirrored score for the pairs that matched at all, nothing for the others
    rows = rows.withColumn("match_before", F.col("match_score")).withColumn(
        "match_after", M.uplifted(F.col("match_before"), F.when(F.col("match_before") > 0, F.bround(100 - F.col("match_before"), 2))))
    out = J.outcome_table(rows)
    lists = ("skills_added", "keywords_injected", "sections_rewritten", "known_gaps", "suggestions")
    return out.select(*[c for c in out.columns if c not in lists], *[F.array_join(c, "|").alias(c) for c in lists])


@query("j3_analysis_table")
def _analysis(v: Views) -> DataFrame:
    rows = pair_rows(v, "flags", "skills", "scores", "match").filter("r_known AND j_known")
    out = J.analysis_table(rows)
    return out.select(
        "resume_id", "job_id", "match_score", *S.SIGNALS, "total", "experience_candidate", "experience_required_min",
        "experience_required_max", "domain_candidate", "domain_job",
        F.array_join("required_certifications", "|").alias("required_certifications"),
        F.array_join("missing_certifications", "|").alias("missing_certifications"),
        F.array_join(F.transform("flags", lambda f: F.concat(f["flag_type"], F.lit(":"), f["title"])), "|").alias("flags"),
        F.array_join(F.transform("skills", lambda s: F.concat(s["skill"], F.lit(":"), s["status"])), "|").alias("skills"))


@query("j2_sink")
def _sink(v: Views) -> DataFrame:
    """The outcome scores written by job, the jobs with an even id written once more, and read back."""
    rows = J.score_outcomes(pair_rows(v, "scores", "scores_after"))
    out = work_folder(v.spark, "outcomes")
    J.write_partitions(rows, out, "job_id")
    J.write_partitions(v.spark.read.parquet(out).filter("job_id % 2 = 0"), out, "job_id")
    return v.spark.read.parquet(out).withColumn("job_id", F.col("job_id").cast("long"))


# --- sessions ----------------------------------------------------------------------------------------------------------
def event_stream(v: Views) -> DataFrame:
    return v.submissions_of(v.stream("events"))


@query("k1_stream_score")
def _stream_score(v: Views) -> DataFrame:
    """Documents arrive as a stream; every micro-batch runs the batch scoring job against the static tables."""
    out = work_folder(v.spark, "stream-score")
    ST.stream_score(v.stream("documents"), lambda batch: scoring.scores_of(v, batch), out, f"{out}-checkpoint").awaitTermination()
    return v.spark.read.parquet(out).drop("batch")


query("k2_session_status")(lambda v: ST.session_status(v.submissions))
query("k2_stream_status")(lambda v: ST.run_status(event_stream(v)))
query("k2_bad_transitions")(lambda v: ST.bad_transitions(v.submissions))
query("k3_session_expiry")(lambda v: ST.session_expiry(v.submissions))


@query("k3_stream_expiry")
def _stream_expiry(v: Views) -> DataFrame:
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return ST.run_to_end(ST.stream_expiry(event_stream(v)), "stream-expiry").select("session_id")


query("k4_once_only")(lambda v: ST.once_only(v.submissions))
query("k4_stream_done_table")(lambda v: ST.run_once_only(event_stream(v)))
query("k4_stream_once_only")(lambda v: ST.run_to_end(ST.stream_once_only(event_stream(v)), "stream-once").select("session_id"))
