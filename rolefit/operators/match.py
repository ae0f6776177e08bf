"""Match score and inference input (section G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import empty_if_null, falsy_to_null


def vector_side(vectors: DataFrame, key: str, name: str) -> DataFrame:
    """(key, <name>_vec, <name>_length) in double precision."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.select(key, vec.alias(f"{name}_vec"), norm.alias(f"{name}_length"))


def semantic_match(resume_vecs: DataFrame, job_vecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(resume_id, job_id, match_score): 100 x max(0, cosine) of the stored vectors of each pair.

    A model's judgement cannot be reproduced; this is a different, deterministic measure on the same pairs.
    """
    r = vector_side(resume_vecs, "resume_id", "r")
    j = vector_side(job_vecs, "job_id", "j")
    return pairs.join(r, "resume_id").join(j, "job_id").select("resume_id", "job_id", match_score().alias("match_score"))


def match_score() -> Column:
    """The score of a pair row with both vectors; null where one is missing."""
    dot = F.aggregate(F.zip_with("r_vec", "j_vec", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    norms = F.col("r_length") * F.col("j_length")
    cosine = F.when(norms > 0, dot / F.when(norms > 0, norms)).otherwise(0.0)
    return F.when(norms.isNotNull(), F.bround(F.greatest(cosine, F.lit(0.0)) * 100, 2))


def uplifted(before: Column, raw_after: Column) -> Column:
    """The match after a rewrite: never below the one before; estimated where it was not computed; null where neither was."""
    estimate = F.when(before.isNotNull(), F.least(before + R.UPLIFT_STEP, F.lit(R.UPLIFT_CAP)))
    return F.coalesce(F.when(raw_after.isNotNull(), F.greatest(raw_after, before)), estimate)


def match_uplift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(resume_id, job_id, match_before, match_after, match_delta). after may lack pairs; it never ends below before."""
    b = before.select("resume_id", "job_id", F.col("match_score").alias("match_before"))
    a = after.select("resume_id", "job_id", F.col("match_score").alias("raw_after"))
    return (b.join(a, ["resume_id", "job_id"], "full").withColumn("match_after", uplifted(F.col("match_before"), F.col("raw_after")))
            .select("resume_id", "job_id", "match_before", "match_after",
                    F.bround(F.col("match_after") - F.col("match_before"), 2).alias("match_delta")))


def _first(array: Column, cap: int | None) -> Column:
    return array if cap is None else F.slice(array, 1, cap)


def evidence_text(caps: dict[str, int] | None = None) -> Column:
    """Summary and entries with their bullets of a nested resume row, one per line."""
    caps = caps or {}

    def entry(e: Column) -> Column:
        head = F.concat(F.coalesce(e["title"], F.lit("")), F.lit(" @ "), F.coalesce(e["company"], F.lit("")))
        bullets = _first(empty_if_null(e["bullets"]), caps.get("bullets"))
        return F.when(F.size(bullets) > 0, F.concat(head, F.lit(": "), F.array_join(bullets, "; "))).otherwise(head)

    summary = F.concat(F.lit("Summary: "), falsy_to_null(F.col("summary")))
    jobs = F.transform(_first(F.col("experience"), caps.get("entries")), entry)
    lines = F.array_compact(F.concat(F.array(summary), F.coalesce(jobs, F.array().cast("array<string>"))))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("No resume text available.")


def _listed(c: str, cap: int | None, have: list[str]) -> Column:
    return F.array_join(_first(empty_if_null(F.col(c)), cap), ", ") if c in have else F.lit("")


def evidence_table(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """One inference input row per pair: what a match model gets to see of the resume and of the job.

    caps limits the lists by name; by default they are whole. refdata.EVIDENCE_CAPS has those of the original prompt.
    """
    caps = caps or {}
    r = resumes.select(
        "resume_id", evidence_text(caps).alias("evidence"),
        F.coalesce(falsy_to_null(F.col("primary_domain")), F.lit("Unknown")).alias("domain_candidate"),
        F.coalesce("total_years", F.lit(0.0)).alias("years"),
        _listed("tech_stack", caps.get("tech"), resumes.columns).alias("tech_stack"),
        _listed("skills", caps.get("skills"), resumes.columns).alias("skills"))
    j = jobs.select(
        "job_id", "job_title", F.coalesce(falsy_to_null(F.col("primary_domain")), F.lit("Unknown")).alias("domain_job"),
        F.coalesce("min_years", F.lit(0.0)).alias("min_years"), F.coalesce("max_years", F.lit(0.0)).alias("max_years"),
        _listed("required_skills", caps.get("required"), jobs.columns).alias("required_skills"),
        _listed("technologies", caps.get("technologies"), jobs.columns).alias("technologies"))
    return pairs.select("resume_id", "job_id").join(r, "resume_id").join(j, "job_id")


def evidence_sizes(evidence: DataFrame) -> DataFrame:
    """Size statistics of the inference input per job."""
    n = F.length("evidence")
    return evidence.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.sum(n).alias("sum_chars"))
