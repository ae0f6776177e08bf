"""Admission gates and field extraction over document corpora (section A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import decimal_number, first_match, strip


def language_guess(text: Column) -> Column:
    """en when at least two marker words occur, else unknown."""
    lowered = F.lower(text)
    hits = sum((F.contains(lowered, F.lit(m)).cast("int") for m in R.ENGLISH_MARKERS), F.lit(0))
    return F.when(hits >= 2, "en").otherwise("unknown")


def reject_reason(kind: str) -> Column:
    """First rule a submission breaks, null when it is admitted."""
    reason = F.when(~F.coalesce(F.col("content_type").isin(*R.ALLOWED_TYPES[kind]), F.lit(False)), "content_type")
    if kind == "template":
        return reason
    reason = (reason.when(F.col("n_bytes") > R.MAX_FILE_BYTES, "size")
              .when(F.length(strip(F.coalesce("text", F.lit("")))) < R.MIN_TEXT_CHARS[kind], "short_text"))
    if kind == "resume":
        reason = reason.when(F.coalesce("lang", F.lit("unknown")) != "en", "language")
    return reason


def gate(docs: DataFrame, kind: str = "resume") -> DataFrame:
    """The submissions with their reason column; write it with partitionBy('reason') to keep both sides of it."""
    return docs.withColumn("reason", reject_reason(kind))


def intake_gate(docs: DataFrame, kind: str = "resume") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    marked = gate(docs, kind)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def gate_report(docs: DataFrame, kind: str = "resume") -> DataFrame:
    """Submissions per source and reason; admitted ones count under 'accepted'."""
    return (gate(docs, kind).groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def language_audit(docs: DataFrame) -> DataFrame:
    """Confusion counts of the stated language against the marker heuristic."""
    return docs.groupBy("lang", language_guess(F.col("text")).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def contact_extract(docs: DataFrame) -> DataFrame:
    """First contact of each kind per document and its first non-blank line as name."""
    text = F.col("text")
    first_line = strip(F.regexp_extract(text, r"(?U)^\s*([^\n]*)", 1))

    def link(pattern: str) -> Column:
        return F.concat(F.lit("https://"), first_match(text, pattern))

    return docs.select(
        "doc_id", "source",
        F.when(first_line == "", R.UNKNOWN_NAME).otherwise(first_line).alias("full_name"),
        first_match(text, R.EMAIL_RE).alias("email"), strip(first_match(text, R.PHONE_RE)).alias("phone"),
        link(R.LINKEDIN_RE).alias("linkedin"), link(R.GITHUB_RE).alias("github"))


CONTACT_KINDS = ("email", "phone", "linkedin", "github")


def contact_coverage(contacts: DataFrame) -> DataFrame:
    """Documents of each source that have a contact of each kind."""
    return contacts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"with_{c}") for c in CONTACT_KINDS])


def shared_contacts(contacts: DataFrame) -> DataFrame:
    """Contact values that more than one document carries."""
    values = contacts.select("doc_id", F.explode(F.array(
        *[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in CONTACT_KINDS])).alias("c"))
    return (values.filter("c.value IS NOT NULL").groupBy("c.kind", "c.value")
            .agg(F.count_distinct("doc_id").alias("n_docs")).filter("n_docs > 1"))


def stated_or_dated_years(text: Column) -> Column:
    stated = decimal_number(first_match(text, R.YEARS_STATED_RE, 1))
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit(R.MONTH_YEAR_RE), F.lit(1)), decimal_number), lambda y: y.isNotNull())
    span = F.when(F.size(years) >= 2, F.array_max(years) - F.array_min(years))
    return F.coalesce(stated, span)


def experience_estimate(docs: DataFrame) -> DataFrame:
    """(doc_id, total_years): stated years, else the span of two or more month-year mentions."""
    return docs.select("doc_id", stated_or_dated_years(F.col("text")).alias("total_years"))


def required_years(text: Column) -> Column:
    """struct(min_years, max_years) of a posting text."""
    def open_range(pattern: str) -> Column:
        low = decimal_number(first_match(text, pattern, 1))
        return F.when(low.isNotNull(), F.struct(low.alias("min_years"), (low + R.JD_OPEN_RANGE_YEARS).alias("max_years")))

    low, high = (decimal_number(first_match(text, R.JD_RANGE_RE, g)) for g in (1, 2))
    ranged = F.when(low.isNotNull(), F.struct(low.alias("min_years"), high.alias("max_years")))
    return F.coalesce(ranged, open_range(R.JD_STATED_RE), open_range(R.JD_MINIMUM_RE))


def job_title(text: Column, scan_lines: int = R.TITLE_SCAN_LINES) -> Column:
    """The first short line among those where a title stands."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    short = F.filter(F.slice(lines, 1, scan_lines), lambda s: F.length(s) < R.TITLE_MAX_CHARS)
    return F.coalesce(F.get(short, F.lit(0)), F.lit(R.UNKNOWN_TITLE))


def requirement_extract(jobs_text: DataFrame) -> DataFrame:
    """(job_id, job_title, min_years, max_years)."""
    return (jobs_text.select("job_id", job_title(F.col("raw_text")).alias("job_title"),
                             required_years(F.col("raw_text")).alias("y"))
            .select("job_id", "job_title", "y.min_years", "y.max_years"))


def requirement_histogram(requirements: DataFrame) -> DataFrame:
    """Postings per whole minimum year; null for postings that state none."""
    return requirements.groupBy(F.floor("min_years").alias("min_years")).agg(F.count(F.lit(1)).alias("n"))
