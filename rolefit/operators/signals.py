"""Quality signals and the total score (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import contains_any
from rolefit.operators import keywords as K


CHUNK_ROWS = 4096
DATE_FORMATS = ("month_year", "mm_yyyy", "yyyy")


def _present(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def section_completeness(header: DataFrame, history: DataFrame, education: DataFrame) -> DataFrame:
    """(resume_id, section_completeness) from the header table and the long entry tables."""
    jobs = history.groupBy("resume_id").agg(F.bool_and(_present("start_date") & _present("end_date")).alias("dated"))
    schools = education.groupBy("resume_id").agg(F.bool_and(_present("year")).alias("with_year"))
    n_skills = F.coalesce(F.size("skills"), F.lit(0))

    def complete(flag: str) -> Column:
        return F.when(F.col(flag), 4.0).when(~F.col(flag), 2.0).otherwise(0.0)

    points = (
        F.when(_present("full_name") & (F.col("full_name") != R.UNKNOWN_NAME), 1.0).otherwise(0.0)
        + F.when(_present("email"), 1.5).otherwise(0.0)
        + F.when(_present("phone"), 1.5).otherwise(0.0)
        + F.when(F.length("summary") > 30, 4.0).otherwise(0.0)
        + F.when(n_skills >= 3, 4.0).when(n_skills > 0, 2.0).otherwise(0.0)
        + complete("dated") + complete("with_year")
    )
    return (
        header.select("resume_id", "full_name", "email", "phone", "summary", "skills")
        .join(jobs, "resume_id", "left").join(schools, "resume_id", "left")
        .select("resume_id",
                F.least(F.bround(points, 1), F.lit(R.SIGNAL_MAX["section_completeness"])).alias("section_completeness"))
    )


def completeness_by_source(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """Mean completeness per source; sources has (resume_id, source)."""
    return scores.join(sources.select("resume_id", "source"), "resume_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("section_completeness"), 4).alias("mean_completeness"))


def format_parsability(doc_facts: DataFrame, section_facts: DataFrame) -> DataFrame:
    """(doc_id, format_parsability) from layout facts."""
    header_hit = contains_any(F.lower(F.coalesce("header_text", F.lit(""))), R.HEADER_WORDS)
    sections = section_facts.groupBy("doc_id").agg(
        F.count(F.when(header_hit, 1)).alias("header_hits"), F.max("n_cols").alias("max_cols"))
    is_pdf = F.contains(F.lower("content_type"), F.lit("pdf"))
    pdf_score = F.when(F.col("n_bytes") > R.PDF_SCAN_BYTES, 15.0).otherwise(20.0)
    other = (
        F.lit(20.0)
        - F.when(F.col("n_tables") > 3, 4.0).otherwise(0.0)
        - F.when(F.col("has_textbox"), 4.0).otherwise(0.0)
        - F.coalesce(F.col("header_hits"), F.lit(0)) * 2.0
        - F.when(F.col("max_cols") > 1, 5.0).otherwise(0.0)
    )
    score = (F.when(is_pdf, pdf_score)
             .when(F.col("readable"), F.greatest(F.bround(other, 1), F.lit(0.0)))
             .otherwise(R.UNREADABLE_FORMAT))
    return (doc_facts.select("doc_id", "content_type", "n_bytes", "n_tables", "has_textbox", "readable")
            .join(sections, "doc_id", "left").select("doc_id", score.alias("format_parsability")))


def date_consistency(resumes: DataFrame, history: DataFrame) -> DataFrame:
    """(resume_id, date_consistency): formats used and order of start years; resumes without history get 5."""
    def fmt(c: str) -> Column:
        value = F.col(c)
        return (F.when(value.isNull() | (value == "") | (F.lower(value) == "present"), F.lit(None))
                .when(F.regexp_like(value, F.lit(R.DATE_MONTH_YEAR_RE)), "month_year")
                .when(F.regexp_like(value, F.lit(R.DATE_MM_YYYY_RE)), "mm_yyyy")
                .when(F.regexp_like(value, F.lit(R.DATE_YYYY_RE)), "yyyy"))

    # "Not in descending order" means that some year exceeds the smallest year before it. Positions are cut into
    # chunks so that one very long history is spread over tasks: first inside each chunk, then between chunk minima.
    chunk = F.floor(F.col("pos") / CHUNK_ROWS)
    year = F.nullif(F.regexp_extract("start_date", r"\d{4}", 0), F.lit("")).cast("int")
    inside = Window.partitionBy("resume_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("resume_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def seen(name: str) -> Column:
        return F.max(F.when((F.col("f1") == name) | (F.col("f2") == name), 1).otherwise(0)).alias(name)

    chunks = (
        history.select("resume_id", "pos", chunk.alias("chunk"), year.alias("year"), fmt("start_date").alias("f1"),
                       fmt("end_date").alias("f2"))
        .withColumn("rises", F.coalesce(F.min("year").over(inside) < F.col("year"), F.lit(False)))
        .groupBy("resume_id", "chunk")
        .agg(*[seen(f) for f in DATE_FORMATS], F.bool_or("rises").alias("rises"), F.min("year").alias("low"),
             F.max("year").alias("high"))
        .withColumn("rises", F.col("rises") | F.coalesce(F.min("low").over(across) < F.col("high"), F.lit(False)))
    )
    n_formats = sum((F.max(f) for f in DATE_FORMATS), F.lit(0))
    per_resume = chunks.groupBy("resume_id").agg(n_formats.alias("n_formats"), F.bool_or("rises").alias("rises"))
    score = (F.lit(10.0) - F.when(F.col("n_formats") > 1, 4.0).otherwise(0.0) - F.when(F.col("rises"), 3.0).otherwise(0.0))
    return resumes.select("resume_id").join(per_resume, "resume_id", "left").select(
        "resume_id",
        F.when(F.col("n_formats").isNull(), R.NEUTRAL_DATES).otherwise(F.greatest(score, F.lit(0.0))).alias("date_consistency"))


def text_health(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, file_health): 0 below 100 characters, minus 2 for more than ten characters of garbage."""
    raw = F.coalesce(F.col(text), F.lit(""))
    garbled = F.length(raw) - F.length(F.regexp_replace(raw, R.GARBLED_CLASS, ""))
    score = (F.when(F.length(raw) < R.MIN_HEALTHY_CHARS, 0.0).when(garbled > R.GARBLED_LIMIT, 3.0)
             .otherwise(R.SIGNAL_MAX["file_health"]))
    return docs.select(key, score.alias("file_health"))


def health_by_source(docs: DataFrame) -> DataFrame:
    """Documents per source and health value with their share of the source."""
    scored = text_health(docs.withColumn("key", F.struct("doc_id", "source")), key="key").select("key.source", "file_health")
    counts = scored.groupBy("source", "file_health").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("source"))
    return counts.select("source", "file_health", "n", F.bround(F.col("n") / whole, 4).alias("share"))


SIGNALS = tuple(R.SIGNAL_MAX)


def _total(suffix: str = "") -> Column:
    """Sum of the signals, added up in the order the report lists them."""
    order = ("keyword_match", "section_completeness", "format_parsability", "keyword_placement", "date_consistency",
             "file_health")
    total = F.lit(0.0)
    for signal in order:
        total = total + F.col(f"{signal}{suffix}")
    return F.bround(total, 1)


def _filled(scores: DataFrame) -> DataFrame:
    """A signal of which a resume has no row takes the value of a record without content."""
    return scores.na.fill({"section_completeness": 0.0, "date_consistency": R.NEUTRAL_DATES,
                           "format_parsability": R.UNREADABLE_FORMAT, "file_health": 0.0})


def resume_facts(header: DataFrame, history: DataFrame, education: DataFrame, doc_facts: DataFrame, section_facts: DataFrame) -> DataFrame:
    """The four signals that depend on the resume alone, one row per resume that any of the tables has."""
    facts = doc_facts.withColumnRenamed("doc_id", "resume_id")
    return (
        section_completeness(header, history, education)
        .join(date_consistency(header, history), "resume_id", "full")
        .join(format_parsability(doc_facts, section_facts).withColumnRenamed("doc_id", "resume_id"), "resume_id", "full")
        .join(text_health(facts, key="resume_id"), "resume_id", "full")
    )


def rewrite_facts(rewrites: DataFrame, header: DataFrame, history: DataFrame, education: DataFrame) -> DataFrame:
    """The same of rewritten resumes: contact data and education of the original, format and health at their maximum. history holds the rewritten
    entries; those without title or company do not count."""
    entries = history.filter(F.col("title").isNotNull() & F.col("company").isNotNull())
    texts = rewrites.select("resume_id", F.coalesce("summary", F.lit("")).alias("summary"), "skills")
    contact = texts.join(header.select("resume_id", "full_name", "email", "phone"), "resume_id", "left")
    return (
        section_completeness(contact, entries, education)
        .join(date_consistency(contact, entries), "resume_id")
        .withColumn("format_parsability", F.lit(R.SIGNAL_MAX["format_parsability"]))
        .withColumn("file_health", F.lit(R.SIGNAL_MAX["file_health"]))
    )


def score_pairs(resumes: DataFrame, header: DataFrame, history: DataFrame, education: DataFrame, doc_facts: DataFrame,
                section_facts: DataFrame, jobs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Six signals and total per pair.

    The four per-resume signals are computed once per resume, not per pair, and meet the pairs on the same key. A resume that one of the
    tables lacks keeps its pairs.
    """
    per_resume = resume_facts(header, history, education, doc_facts, section_facts)
    scores = _filled(K.keyword_scores(K.pair_keyword_hits(resumes, jobs, pairs, per_resume)))
    return scores.withColumn("total", _total()).select("resume_id", "job_id", *SIGNALS, "total")


def score_rewrites(rewrites: DataFrame, header: DataFrame, history: DataFrame, education: DataFrame, jobs: DataFrame,
                   pairs: DataFrame) -> DataFrame:
    """Score of rewritten resumes, see rewrite_facts."""
    per_resume = rewrite_facts(rewrites, header, history, education)
    scores = _filled(K.keyword_scores(K.pair_keyword_hits(rewrites, jobs, pairs, per_resume)))
    return scores.withColumn("total", _total()).select("resume_id", "job_id", *SIGNALS, "total")


def scored(rows: DataFrame, hard: str, soft: str, suffix: str = "") -> DataFrame:
    """Pair rows with tested keywords and per-resume signals (named with the suffix): the six signals and total<suffix> in their place."""
    empty = {"section_completeness": 0.0, "date_consistency": R.NEUTRAL_DATES, "format_parsability": R.UNREADABLE_FORMAT, "file_health": 0.0}
    rows = rows.withColumns({f"keyword_match{suffix}": K.keyword_match_score(hard, soft), f"keyword_placement{suffix}": K.keyword_placement_score(hard),
                             **{f"{c}{suffix}": F.coalesce(F.col(f"{c}{suffix}"), F.lit(v)) for c, v in empty.items()}})
    return rows.withColumn(f"total{suffix}", _total(suffix))


def rank_pairs(scores: DataFrame, k: int, by: str = "resume_id", score: str = "total") -> DataFrame:
    """Best k counterparts per resume (by='resume_id') or per job (by='job_id'); ties by the other key."""
    other = "job_id" if by == "resume_id" else "resume_id"
    best_first = Window.partitionBy(by).orderBy(F.desc(score), other)
    return scores.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def score_band(c: Column) -> Column:
    return F.when(c >= 80, "green").when(c >= 60, "orange").otherwise("red")


def score_bands(scores: DataFrame) -> DataFrame:
    """Report band and review-page band per pair."""
    total = F.col("total")
    return scores.select(
        "resume_id", "job_id", "total", score_band(total).alias("band"),
        F.when(total >= 70, "green").when(total >= 50, "orange").otherwise("red").alias("review_band"))


def band_counts(bands: DataFrame) -> DataFrame:
    """Pairs per job and report band."""
    counts = bands.groupBy("job_id").pivot("band", ["green", "orange", "red"]).agg(F.count(F.lit(1)))
    return counts.na.fill(0)
