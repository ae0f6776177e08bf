"""Before and after reports (section J). All results are tables; write them with the sinks below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.operators.flags import acknowledged_flags, missing_certs
from rolefit.operators.verify import section_list
from rolefit.sources.corpus import materialise

PAIR = ["resume_id", "job_id"]
LIMITS = {**R.SIGNAL_MAX, "total": 100.0}



def score_delta_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(resume_id, job_id, signal, max_points, before, after, delta), the total being one of the signals.

    The two score tables meet once per pair, before they are turned into rows.
    """
    return delta_rows(before.select(*PAIR, *LIMITS).join(after.select(*PAIR, *[F.col(s).alias(f"{s}_after") for s in LIMITS]), PAIR))


def delta_rows(rows: DataFrame) -> DataFrame:
    """The same of pair rows that hold the signals and, named with _after, those after the rewrite."""
    limit = F.coalesce(*[F.when(F.col("signal") == s, m) for s, m in LIMITS.items()])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("before"), F.col(f"{s}_after").alias("after")) for s in LIMITS]))
    return (rows.select(*PAIR, each.alias("r")).select(*PAIR, "r.*")
            .select(*PAIR, "signal", limit.alias("max_points"), "before", "after",
                    F.bround(F.col("after") - F.col("before"), 1).alias("delta")))


def score_delta_means(report: DataFrame) -> DataFrame:
    """Corpus means per job and signal, and over all jobs (job_id null)."""
    return (report.rollup("signal", "job_id").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("before"), 3).alias("mean_before"),
        F.bround(F.avg("after"), 3).alias("mean_after")).filter("signal IS NOT NULL"))


def analysis_table(rows: DataFrame) -> DataFrame:
    """Match, score breakdown, flags, skills, years, domains and missing certifications of pair rows that hold the columns of both sides, the signals,
    match_score, flags and items."""
    return rows.select(
        *PAIR, "match_score", *R.SIGNAL_MAX, "total", F.col("r_years").alias("experience_candidate"), F.col("j_min").alias("experience_required_min"),
        F.col("j_max").alias("experience_required_max"), F.col("r_domain").alias("domain_candidate"), F.col("j_domain").alias("domain_job"),
        F.col("j_certs").alias("required_certifications"), F.when(F.size(missing_certs()) > 0, missing_certs()).alias("missing_certifications"),
        F.when(F.size("flags") > 0, F.col("flags")).alias("flags"), F.when(F.size("items") > 0, F.sort_array("items")).alias("skills"))


def outcome_table(rows: DataFrame) -> DataFrame:
    """Final row per pair: scores and match before and after, skills added, keywords injected, sections rewritten, known gaps, suggestions. rows are pair rows
    with both totals, match_before, match_after, decisions, terms_before and terms_after (keywords present), changed sections, flags and suggestions."""
    none = F.array().cast("array<string>")
    added = F.transform(F.filter("decisions", lambda d: d["add"]), lambda d: d["skill"])
    lists = {"skills_added": F.sort_array(F.array_distinct(added)), "keywords_injected": F.sort_array(F.array_except("terms_after", "terms_before")),
             "sections_rewritten": F.when(F.col("summary_changed").isNotNull() | F.col("bullets_changed").isNotNull(), section_list()),
             "known_gaps": F.transform(acknowledged_flags(), lambda f: f["title"]), "suggestions": F.col("suggestions")}
    return rows.select(*PAIR, F.col("total").alias("score_before"), F.col("total_after").alias("score_after"), "match_before", "match_after",
                       *[F.coalesce(c, none).alias(name) for name, c in lists.items()])


def score_outcomes(rows: DataFrame) -> DataFrame:
    """(resume_id, job_id, score_before, score_after, score_delta) of pair rows with both totals."""
    return rows.select(*PAIR, F.col("total").alias("score_before"), F.col("total_after").alias("score_after"),
                       F.bround(F.col("total_after") - F.col("total"), 1).alias("score_delta"))


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of a Parquet table for which df has rows, and no others: writing the same rows again changes nothing. df may come from the
    table itself; it is written aside first, and a partition is replaced only when the whole job has ended."""
    aside = materialise(df, "partitions")
    (aside.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def write_report(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet sink. With a partition column the rows are first gathered by it, so that no task writes every folder; adaptive
    execution splits a value that is too large for one task."""
    if by is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by).parquet(path)
