"""Skill gap classification, merging and routing (section F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit import refdata as R
from rolefit.functions.text import empty_if_null, strip
from rolefit.operators.keywords import pair_keyword_hits
from rolefit.sources.corpus import materialise

PAIR = ["resume_id", "job_id"]
#: So many skills that are related to those of jobs are broadcast to the skills of the resumes; more meet them by a shuffle.
BROADCAST_SKILLS = 500_000


def job_skills() -> Column:
    """The distinct skills of a job row in order: required_skills, then technologies."""
    wanted = F.array_distinct(F.concat(empty_if_null(F.col("required_skills")), empty_if_null(F.col("technologies"))))
    return F.filter(wanted, lambda s: strip(s) != "")


def own_groups(resumes: DataFrame, related: DataFrame) -> DataFrame:
    """(resume_id, own_by_group): of each related-skill group the first own skill by name."""
    listed = resumes.select("resume_id", F.explode(F.array_distinct(F.concat(
        empty_if_null(F.col("skills")), empty_if_null(F.col("tech_stack"))))).alias("own"))
    every = (listed.join(related, F.lower("own") == F.col("skill"))
             .groupBy("resume_id").agg(F.sort_array(F.collect_set(F.struct("skill_group", "own"))).alias("g")))
    first = F.filter("g", lambda x, i: (i == 0) | (F.get("g", i - 1)["skill_group"] != x["skill_group"]))
    return every.select("resume_id", F.map_from_entries(first).alias("own_by_group"))


def related_to(wanted: DataFrame, related: DataFrame) -> DataFrame:
    """The related skills of the groups that skills of jobs are in; no other group is ever asked for. wanted: (job_id, skills)."""
    terms = wanted.select(F.explode("skills").alias("skill")).select(F.lower("skill").alias("skill")).distinct()
    groups = related.join(terms, "skill", "left_semi").select("skill_group").distinct()
    small = materialise(related.join(groups, "skill_group", "left_semi").select("skill", "skill_group"), "related-skills")
    return F.broadcast(small) if small.limit(BROADCAST_SKILLS + 1).count() <= BROADCAST_SKILLS else small


def job_groups(wanted: DataFrame, related: DataFrame) -> DataFrame:
    """(job_id, groups): (pos, skill_group) of the skills of each job that are in a group. wanted: (job_id, skills)."""
    return (wanted.select("job_id", F.posexplode("skills").alias("pos", "term")).join(related, F.lower("term") == F.col("skill"))
            .groupBy("job_id").agg(F.collect_set(F.struct("pos", "skill_group")).alias("groups")))


def skill_items(tested: str = "skills") -> Column:
    """(skill, status, related_skill) of a pair row's tested skills, with its groups and own_by_group. matched: in the skill lists; can_add: only elsewhere
    in the resume; partial: the resume lists a skill of the same related-skill group; missing otherwise."""
    def item(h: Column, i: Column) -> Column:
        same = F.filter("groups", lambda g: g["pos"] == i)
        near = F.array_min(F.transform(same, lambda g: F.try_element_at(F.col("own_by_group"), g["skill_group"])))
        status = F.when(h["in_skills"], "matched").when(h["in_all"], "can_add").when(near.isNotNull(), "partial").otherwise("missing")
        return F.struct(h["term"].alias("skill"), status.alias("status"), F.when(~h["in_all"], near).alias("related_skill"))

    return F.transform(F.col(tested), item)


def skill_breakdown(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, related: DataFrame) -> DataFrame:
    """(resume_id, job_id, skill, status, related_skill) for the distinct skills of each job.

    related is a table (skill, skill_group) of lower-case skills.
    A deterministic stand-in for a model's judgement: a table of inferred statuses of this schema can replace it.
    """
    wanted = jobs.select("job_id", job_skills().alias("skills"))
    as_keywords = wanted.select("job_id", F.col("skills").alias("hard_keywords"),
                                F.array().cast("array<string>").alias("soft_keywords"))
    related = related_to(wanted, related)
    per_resume = resumes.select("resume_id").join(own_groups(resumes, related), "resume_id", "left")
    joined = pair_keyword_hits(resumes, as_keywords, pairs, per_resume, ("all", "skills"), job_groups(wanted, related))
    return exploded_items(joined.select(*PAIR, skill_items("hard").alias("items")))


def exploded_items(rows: DataFrame) -> DataFrame:
    return rows.select(*PAIR, F.explode("items").alias("i")).select(*PAIR, "i.skill", "i.status", "i.related_skill")


def skill_summary(rows: DataFrame) -> DataFrame:
    """Skills per status and decisions to add and to skip, for every pair row with items and decisions (skill, add); an add of null is no decision."""
    def counted(array: str, test) -> Column:
        return F.size(F.filter(array, test)).cast("long")

    def with_status(name: str) -> Column:
        return counted("items", lambda i: i["status"] == name).alias(name)

    return rows.select(*PAIR, *[with_status(name) for name in R.SKILL_STATUSES],
                       counted("decisions", lambda d: d["add"]).alias("n_add"), counted("decisions", lambda d: ~d["add"]).alias("n_skip"))


def _merged(existing: Column, added: Column) -> Column:
    """Existing list, then each addition that is in it under no spelling of its case, in order."""
    have = F.transform(existing, lambda s: F.lower(s))
    lowered = F.transform(added, lambda s: F.lower(s))
    new = F.filter(added, lambda s, i: ~F.array_contains(have, F.lower(s)) & (F.array_position(lowered, F.lower(s)) == i + 1))
    return F.concat(existing, new)


def merged_skills(rows: DataFrame) -> DataFrame:
    """(resume_id, job_id, skills, tech_stack) of pair rows with their additions in order (added) and the lists of the resume (own_skills, own_tech)."""
    added, none = empty_if_null(F.col("added")), F.array().cast("array<string>")
    return rows.select(*PAIR, _merged(F.coalesce("own_skills", none), added).alias("skills"), _merged(F.coalesce("own_tech", none), added).alias("tech_stack"))


def skill_merge(resumes: DataFrame, pairs: DataFrame, added: DataFrame) -> DataFrame:
    """The same of tables: the lists of the resume and the additions (resume_id, job_id, ord, skill) of each pair; a pair without any stays as it is."""
    additions = added.groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda s: s["skill"]).alias("added"))
    own = resumes.select("resume_id", F.col("skills").alias("own_skills"), F.col("tech_stack").alias("own_tech"))
    return merged_skills(pairs.select(*PAIR).join(additions, PAIR, "left").join(own, "resume_id"))


def category_lines(entries: DataFrame) -> DataFrame:
    """Distinct "Label: list" entries per document: (doc_id, pos, text), pos ordering them as they come."""
    first = strip(F.col("first_line"))
    label = strip(F.substring_index(first, ":", 1))
    after = F.lower(strip(F.substring(first, F.length(label) + 2, F.length(first))))
    is_category = (
        (F.length(F.col("text")) > R.CATEGORY_MIN_CHARS)
        & F.regexp_like(first, F.lit(R.CATEGORY_LABEL_RE))
        & ~F.regexp_like(first, F.lit(rf"(?U)^[{R.BULLET_CHARS}]\s"))
        & (F.length(label) <= R.CATEGORY_LABEL_MAX_CHARS)
        & ~F.regexp_extract(after, r"(?U)^\S*", 0).isin(*R.SENTENCE_VERBS)
    )
    place = F.struct("page", "block", "entry")
    return (entries.withColumn("text", strip(F.col("text"))).filter(is_category)
            .groupBy("doc_id", "text").agg(F.min(place).alias("pos")).select("doc_id", "pos", "text"))


def _hints(skill: Column) -> Column:
    """Line terms of the first hint group one of whose names occurs in the skill; null without a group."""
    out = F.lit(None).cast("array<string>")
    for names, terms in reversed(R.SKILL_HINTS):
        named = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower(skill), n))
        out = F.when(named, F.array(*[F.lit(t) for t in terms])).otherwise(out)
    return out


def skill_route(lines: DataFrame, skills: DataFrame) -> DataFrame:
    """(doc_id, ord, skill, target): the category line each new skill goes to.

    lines: (doc_id, pos, text); skills: (doc_id, ord, skill). Skills that some line of the document already names are
    left out. The choice among the lines is a partially aggregated maximum, so no list of lines is ever collected.
    """
    hinted = skills.withColumn("hints", _hints(F.col("skill")))
    lowered = F.lower("text")
    joined = hinted.join(lines, "doc_id").withColumn(
        "score", F.size(F.filter("hints", lambda h: F.contains(lowered, h))))
    chosen = joined.groupBy("doc_id", "ord", "skill").agg(
        F.bool_or(F.contains(lowered, F.lower("skill"))).alias("named"),
        F.first(F.col("hints").isNotNull()).alias("has_hints"), F.max("score").alias("best"),
        F.min_by("text", F.struct(-F.col("score"), F.col("pos"))).alias("by_hint"),
        F.min_by("text", "pos").alias("first_line"),
        F.min_by("text", F.struct(-F.length("text"), F.col("pos"))).alias("longest"))
    target = (F.when(~F.col("has_hints"), F.col("longest")).when(F.col("best") > 0, F.col("by_hint"))
              .otherwise(F.col("first_line")))
    return chosen.filter(~F.col("named")).select("doc_id", "ord", "skill", target.alias("target"))


def routed_lines(routes: DataFrame) -> DataFrame:
    """(doc_id, original, updated): each target line with its skills appended in order."""
    added = F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda s: s["skill"])
    return routes.groupBy("doc_id", F.col("target").alias("original")).agg(added.alias("added")).select(
        "doc_id", "original",
        F.aggregate("added", F.col("original"),
                    lambda text, s: F.concat(F.regexp_replace(text, "[. ]+$", ""), F.lit(", "), s)).alias("updated"))
