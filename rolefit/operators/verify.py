"""Rewrite diff, verification and revert (section H).

Resumes are compared as long tables of text units: (resume_id, section, entry_idx, bullet_idx, text). bullet_idx -1 is
the entry's own text (a project description, an education entry); summary, skills and the like have entry_idx 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import empty_if_null, falsy_to_null, normalise_line, strip, strip_bullet, word_count, words
from rolefit.operators.records import parse_bool

UNIT = ["resume_id", "section", "entry_idx", "bullet_idx"]
SECTION_ORDER = {"summary": 0, "experience": 1, "projects": 2}
LISTED = ("experience", "projects")


def text_units(resumes: DataFrame) -> DataFrame:
    """Units of nested resumes: summary, experience bullets, project descriptions and bullets. One pass, no shuffle."""
    def unit(section: str, entry: Column, bullet: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), entry.cast("int").alias("entry_idx"),
                        bullet.cast("int").alias("bullet_idx"), text.alias("text"))

    def bullets(section: str):
        return lambda e, i: F.transform(empty_if_null(e["bullets"]), lambda b, j: unit(section, i, j, b))

    parts = [F.array(unit("summary", F.lit(0), F.lit(0), F.coalesce("summary", F.lit(""))))]
    if "experience" in resumes.columns:
        parts.append(F.flatten(F.transform("experience", bullets("experience"))))
    if "projects" in resumes.columns:
        parts.append(F.transform("projects", lambda e, i: unit("projects", i, F.lit(-1), e["description"])))
        parts.append(F.flatten(F.transform("projects", bullets("projects"))))
    none = F.array().cast("array<struct<section:string,entry_idx:int,bullet_idx:int,text:string>>")
    return (resumes.select("resume_id", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("u"))
            .select("resume_id", "u.section", "u.entry_idx", "u.bullet_idx", "u.text"))


def paired_units(original: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Units at the same position: (..., original_text, rewritten_text). Positions one side lacks drop out."""
    return (original.withColumnRenamed("text", "original_text")
            .join(rewritten.withColumnRenamed("text", "rewritten_text"), UNIT))


# --- H1, H2 -----------------------------------------------------------------------------------------------------------
def change_map(pairs: DataFrame) -> DataFrame:
    """(resume_id, ord, key, new_text): changed units by trimmed original text, and again without its bullet mark.

    ord is the place in which the key is registered: section, entry, bullet, then the bare form.
    """
    old, new = strip(F.coalesce("original_text", F.lit(""))), strip(F.coalesce("rewritten_text", F.lit("")))
    section = F.coalesce(*[F.when(F.col("section") == s, n) for s, n in SECTION_ORDER.items()])
    changed = (pairs.select("resume_id", section.alias("s"), "entry_idx", "bullet_idx", old.alias("old"), new.alias("new_text"))
               .filter("s IS NOT NULL AND old <> '' AND new_text <> '' AND old <> new_text"))
    bare = strip_bullet(F.col("old"))
    keys = F.array_compact(F.array(
        F.struct(F.lit(0).alias("form"), F.col("old").alias("key")),
        F.when((bare != "") & (bare != F.col("old")), F.struct(F.lit(1).alias("form"), bare.alias("key")))))
    return (changed.withColumn("k", F.explode(keys))
            .select("resume_id", F.struct("s", "entry_idx", "bullet_idx", F.col("k.form")).alias("ord"), "k.key", "new_text"))


def registered_changes(changes: DataFrame) -> DataFrame:
    """One row per key: registered again, a key keeps its place and takes the later text."""
    return changes.groupBy("resume_id", "key").agg(F.max_by("new_text", "ord").alias("new_text"), F.min("ord").alias("ord"))


def change_dedupe(changes: DataFrame) -> DataFrame:
    """(resume_id, norm, key, new_text, ord): one change per normalised key.

    Among keys of one normal form the longest wins, the first on ties. Both steps are partially aggregated.
    """
    best = F.min_by(F.struct("key", "new_text"), F.struct(-F.length("key"), F.col("ord")))
    return (registered_changes(changes).withColumn("norm", normalise_line(F.col("key"))).filter("norm <> ''")
            .groupBy("resume_id", "norm").agg(best.alias("b"), F.min("ord").alias("ord"))
            .select("resume_id", "norm", "b.key", "b.new_text", "ord"))


# --- H3 ---------------------------------------------------------------------------------------------------------------
def summary_words(raw_text: Column, summary: Column) -> Column:
    """Words of the summary as it stands in the raw text, from its first six words to a blank line or a heading."""
    extracted = strip(F.coalesce(summary, F.lit("")))
    n_extracted = word_count(extracted)
    anchor = F.array_join(F.slice(words(extracted), 1, R.SUMMARY_ANCHOR_WORDS), " ")
    at = F.instr(raw_text, anchor)
    rest = F.substring(raw_text, at, F.length(raw_text))
    block = F.regexp_replace(rest, rf"(?s)(?:{R.SUMMARY_END_RE}).*$", "")
    found = F.when((extracted != "") & (raw_text != "") & (at > 0), F.greatest(word_count(block), n_extracted))
    fallback = F.when(n_extracted > R.SUMMARY_SHORT_WORDS, n_extracted).otherwise(R.SUMMARY_DEFAULT_WORDS)
    return F.coalesce(F.when(found > 0, found), fallback)


def length_check(pairs: DataFrame, raw_texts: DataFrame) -> DataFrame:
    """Word limits of every rewritten summary and bullet and whether it keeps them. raw_texts: (resume_id, raw_text)."""
    summaries = pairs.filter("section = 'summary'").join(raw_texts, "resume_id", "left").withColumn(
        "n_original", summary_words(F.coalesce("raw_text", F.lit("")), F.col("original_text"))).drop("raw_text")
    bullets = pairs.filter("section <> 'summary'").withColumn("n_original", word_count(F.col("original_text")))
    n = F.col("n_original")
    is_summary = F.col("section") == "summary"
    low = F.when(is_summary, F.greatest(F.lit(float(R.SUMMARY_MIN_WORDS)), F.bround(n * R.SUMMARY_LENGTH_LOW, 0))).otherwise(
        n * R.BULLET_LENGTH_LOW)
    high = F.when(is_summary, F.bround(n * R.SUMMARY_LENGTH_HIGH, 0)).otherwise(n * R.BULLET_LENGTH_HIGH)
    n_new = word_count(F.col("rewritten_text"))
    return summaries.unionByName(bullets).select(
        *UNIT, n.alias("n_original"), n_new.alias("n_rewritten"), ((n_new >= low) & (n_new <= high)).alias("within"))


def length_violations(checked: DataFrame) -> DataFrame:
    """Units and violations per section."""
    bad = F.count(F.when(~F.col("within"), 1))
    return checked.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), bad.alias("n_outside"), F.bround(bad / F.count(F.lit(1)), 4).alias("rate"))


# --- H4 ---------------------------------------------------------------------------------------------------------------
def number_facts(units: DataFrame) -> DataFrame:
    """(resume_id, kind, value): the numbers of the text units."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d[\d,.]*"), F.lit(0)))
    return units.select("resume_id", F.lit("number").alias("kind"), F.explode(found).alias("value"))


def history_facts(history: DataFrame) -> DataFrame:
    """(resume_id, kind, value): companies, titles and dates of the employment history."""
    facts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in (
        ("company", "company"), ("title", "title"), ("date", "start_date"), ("date", "end_date"))])
    return history.select("resume_id", F.explode(facts).alias("f")).filter("f.value <> ''").select("resume_id", "f.kind", "f.value")


def list_facts(resumes: DataFrame, column: str, kind: str) -> DataFrame:
    """(resume_id, kind, value) from a list column, such as technologies or certifications."""
    return resumes.select("resume_id", F.lit(kind).alias("kind"), F.explode(empty_if_null(F.col(column))).alias("value"))


def novelty_flags(original: DataFrame, rewritten: DataFrame, approved: DataFrame) -> DataFrame:
    """Distinct facts of the rewrite that the original lacks and nobody approved; approved: (resume_id, skill)."""
    def keyed(facts: DataFrame) -> DataFrame:
        return facts.withColumn("fact", F.lower(strip(F.col("value"))))

    new = keyed(rewritten).join(keyed(original).drop("value"), ["resume_id", "kind", "fact"], "left_anti")
    granted = approved.select("resume_id", F.lower("skill").alias("fact"))
    return new.join(granted, ["resume_id", "fact"], "left_anti").select("resume_id", "kind", "value").distinct()


# --- H5 ---------------------------------------------------------------------------------------------------------------
def _entry_sizes(units: DataFrame, name: str) -> DataFrame:
    listed = units.filter(F.col("section").isin(*LISTED))
    return listed.groupBy("resume_id", "section", "entry_idx").agg((F.max("bullet_idx") + 1).alias(f"{name}_bullets"))


def revert_scope(original: DataFrame, rewritten: DataFrame, guard_flags: DataFrame, verdicts: DataFrame,
                 approved: DataFrame) -> DataFrame:
    """Every guard flag with what it reverts: bullet, entry, section, nothing ('kept: ...') or 'quarantined'.

    verdicts: (resume_id, is_clean) as text; a clean or unreadable verdict keeps all flags of the resume from acting.
    """
    flags = guard_flags.withColumnRenamed("entry_index", "entry_idx")
    if "revert_to" not in flags.columns:
        flags = flags.withColumn("revert_to", F.lit(None).cast("string"))
    sizes = {n: _entry_sizes(u, n) for n, u in (("orig", original), ("new", rewritten))}
    counts = {n: s.groupBy("resume_id", "section").agg((F.max("entry_idx") + 1).alias(f"{n}_entries")) for n, s in sizes.items()}
    grants = approved.groupBy("resume_id").agg(F.collect_set(F.lower("skill")).alias("granted"))
    schools = (original.filter("section = 'education'").groupBy("resume_id")
               .agg(F.collect_list(F.lower("text")).alias("schools")))
    joined = (
        flags.join(verdicts.select("resume_id", parse_bool(F.col("is_clean")).alias("clean")), "resume_id", "left")
        .join(counts["orig"], ["resume_id", "section"], "left").join(counts["new"], ["resume_id", "section"], "left")
        .join(sizes["orig"], ["resume_id", "section", "entry_idx"], "left")
        .join(grants, "resume_id", "left").join(schools, "resume_id", "left"))
    text = F.coalesce("rewritten_text", F.lit(""))
    revert_to = F.coalesce(falsy_to_null(F.col("revert_to")), F.col("original_text"), F.lit(""))
    granted, at, bullet = empty_if_null(F.col("granted")), F.col("entry_idx"), F.col("bullet_index")
    payload = F.lower(F.concat_ws(" ", falsy_to_null(text), falsy_to_null(F.col("original_text")), falsy_to_null(F.col("revert_to"))))
    in_original = (at >= 0) & (at < F.coalesce("orig_entries", F.lit(0)))
    in_both = in_original & (at < F.coalesce("new_entries", F.lit(0)))
    scope = (
        F.when(F.coalesce("clean", F.lit(True)), "kept: clean")
        .when((F.col("section") == "skills") & F.exists(granted, lambda g: F.contains(payload, g)), "kept: approved")
        .when((F.col("section") == "skills") & (F.size(granted) > 0) & text.isin("", "None"), "kept: empty flag")
        .when((F.col("section") == "education") & (revert_to != "")
              & F.exists(empty_if_null(F.col("schools")), lambda s: F.contains(s, F.lower(revert_to))), "kept: in original")
        .when(F.col("section").isin("skills", "education", "summary", "certifications"), "section")
        .when(~F.col("section").isin(*LISTED), "kept: unknown section")
        .when(in_both & (bullet >= 0) & (bullet < F.coalesce("orig_bullets", F.lit(0))), "bullet")
        .when(in_both, "entry").when(in_original, "quarantined").otherwise("section"))
    return joined.select("resume_id", "section", "entry_idx", "bullet_index", scope.alias("scope"))


def revert_apply(original: DataFrame, rewritten: DataFrame, scoped: DataFrame) -> DataFrame:
    """Verified units from the scoped flags of revert_scope. Every rule restores original values, so order is irrelevant."""
    whole = F.when(F.col("section") == "skills", F.array(F.lit("skills"), F.lit("tech_stack"))).otherwise(F.array("section"))
    sections = scoped.filter("scope = 'section'").select("resume_id", F.explode(whole).alias("section")).distinct()
    entries = scoped.filter("scope = 'entry'").select("resume_id", "section", "entry_idx").distinct()
    bullets = (scoped.filter("scope = 'bullet'").select("resume_id", "section", "entry_idx", F.col("bullet_index").alias("bullet_idx"))
               .distinct())
    by_section, by_entry = ["resume_id", "section"], ["resume_id", "section", "entry_idx"]
    old_bullets = original.join(bullets, UNIT, "left_semi").withColumnRenamed("text", "old_text")
    kept = (rewritten.join(sections, by_section, "left_anti").join(entries, by_entry, "left_anti")
            .join(old_bullets, UNIT, "left").select(*UNIT, F.coalesce("old_text", "text").alias("text")))
    from_sections = original.join(sections, by_section, "left_semi")
    from_entries = original.join(sections, by_section, "left_anti").join(entries, by_entry, "left_semi")
    return kept.unionByName(from_sections.select(*UNIT, "text")).unionByName(from_entries.select(*UNIT, "text"))


# --- H6 ---------------------------------------------------------------------------------------------------------------
def changed_units(original: DataFrame, verified: DataFrame) -> DataFrame:
    """(resume_id, summary_changed, bullets_changed). The units of both versions meet on their key, and only whether any differs is carried on; a unit of one
    version alone differs."""
    def side(units: DataFrame, name: str) -> DataFrame:
        return units.filter("section IN ('summary', 'experience')").select(*UNIT, F.col("text").alias(name))

    differs = ~F.col("old").eqNullSafe(F.col("new"))
    return side(original, "old").join(side(verified, "new"), UNIT, "full").groupBy("resume_id").agg(
        F.bool_or((F.col("section") == "summary") & differs).alias("summary_changed"),
        F.bool_or((F.col("section") == "experience") & differs).alias("bullets_changed"))


def section_list() -> Column:
    """What really changed among the sections the reviewer switched on, in order, of a row with both."""
    return F.array_compact(F.array(
        F.when(F.col("rewrite_summary") & F.col("summary_changed"), "Summary"),
        F.when(F.col("rewrite_bullets") & F.col("bullets_changed"), "Experience"),
        F.when(F.col("reorder_sections"), "Section Order")))


def sections_changed(original: DataFrame, verified: DataFrame, confirmations: DataFrame) -> DataFrame:
    """(resume_id, job_id, sections), see section_list."""
    return confirmations.join(changed_units(original, verified), "resume_id").select("resume_id", "job_id", section_list().alias("sections"))


def section_counts(changed: DataFrame) -> DataFrame:
    """Pairs per changed section."""
    return changed.select(F.explode("sections").alias("section")).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
