"""The pair spine: one row per pair that holds what both of its sides bring, met by two joins.

All that a gate, a summary or a report says of a pair (tested keywords, scores, skill states, flags, decisions, gaps) is a column of that row. Nothing is
exploded to be grouped again, and no input is computed for each of them: a part that a plan does not ask for is not in its sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.operators import flags as E
from rolefit.operators import keywords as K
from rolefit.operators import match as M
from rolefit.operators import signals as S
from rolefit.operators import skills as SK
from rolefit.operators import verify as V
from rolefit.sources.adapters import Views
from rolefit.sources.corpus import materialise

PARTS = ("flags", "skills", "scores", "after", "scores_after", "lists", "match", "outcome")


def _met(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), others, first)


def job_side(v: Views, parts: set[str], related: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(one row per job, its keywords)."""
    jobs = v.skill_jobs.withColumn("skills", SK.job_skills())
    prepared = K.prepared_jobs(jobs, {"hard": "required_skills", "soft": "technologies", "skills": "skills"})
    others = []
    if "skills" in parts:
        others.append(SK.job_groups(jobs, related))
    if "flags" in parts:
        others.append(E.posting_side(v.postings))
    if "match" in parts:
        others.append(M.vector_side(v.vectors.withColumnRenamed("vec_id", "job_id"), "job_id", "j"))
    return _met(prepared, others, "job_id"), K.keywords_of(prepared)


def resume_side(v: Views, parts: set[str], pairs: DataFrame, keywords: DataFrame, related: DataFrame | None) -> DataFrame:
    """One row per resume of the pairs. What comes of the rewritten text has _after in its names; literals_verified tells what the verified text holds."""
    asked = pairs.select("resume_id")
    texts = {"": v.keyed_resumes.join(asked, "resume_id", "left_semi")}
    if "after" in parts:
        texts["_after"] = v.rewritten_resumes_of(texts[""])
    scoped = {s: K.scope_texts(t, verified="after" in parts) for s, t in texts.items()}
    indexed = K.indexed(list(scoped.values()), keywords)
    reordered = ("verified",) if "after" in parts else ()
    indexes = []
    for suffix, table in scoped.items():
        index = indexed(table, K.SCOPES, reordered)
        indexes.append(index.select("resume_id", *[F.col(c).alias(f"{c}{suffix}") for c in index.columns[1:]], F.lit(True).alias(f"known{suffix}")))
    others = indexes[1:]
    if "flags" in parts:
        others.append(E.candidate_side(v.candidates))
    if "skills" in parts:
        others.append(SK.own_groups(v.keyed_resumes, related))
    if "scores" in parts:
        others.append(S.resume_facts(v.candidates, v.history, v.education, v.doc_facts, v.section_facts))
    if "scores_after" in parts:
        facts = S.rewrite_facts(v.rewritten_resumes, v.candidates, v.history, v.education)
        others.append(facts.select("resume_id", *[F.col(c).alias(f"{c}_after") for c in facts.columns[1:]]))
    if "lists" in parts:
        others.append(v.keyed_resumes.select("resume_id", F.col("skills").alias("own_skills"), F.col("tech_stack").alias("own_tech")))
    if "match" in parts:
        others.append(M.vector_side(v.vectors.withColumnRenamed("vec_id", "resume_id"), "resume_id", "r"))
    if "outcome" in parts:
        others.append(V.changed_units(v.original_units, verified_units(v)))
        others.append(v.suggestions.groupBy("resume_id").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("ord", "suggestion"))), lambda s: s["suggestion"]).alias("suggestions")))
    return _met(indexes[0], others, "resume_id")


def scoped_flags(v: Views) -> DataFrame:
    return V.revert_scope(v.original_units, v.rewritten_units, v.guard_flags, v.verdicts, v.approved)


def verified_units(v: Views) -> DataFrame:
    """The rewritten units after the guard flags acted; these are written once, as three joins read them."""
    return V.revert_apply(v.original_units, v.rewritten_units, materialise(scoped_flags(v), "scoped-flags"))


def scoped_section_flags(v: Views) -> DataFrame:
    return V.revert_scope(v.original_sections, v.rewritten_sections, v.section_flags, v.section_verdicts, v.section_approvals)


def verified_sections(v: Views) -> DataFrame:
    """The same over all sections of the candidates."""
    return V.revert_apply(v.original_sections, v.rewritten_sections, materialise(scoped_section_flags(v), "scoped-section-flags"))


def pair_rows(v: Views, *wanted: str) -> DataFrame:
    """The rows of all pairs with the wanted parts: flags, items and decisions (skills), signals and total (scores, scores_after), terms_before and
    terms_after (after), own lists (lists), match_score (match), sections and suggestions (outcome); acknowledged and the reviewer's switches always."""
    parts = set(wanted)
    if parts - set(PARTS):
        raise ValueError(f"parts are {', '.join(PARTS)}")
    if "scores_after" in parts:
        parts.add("after")
    related = SK.related_to(v.skill_jobs.select("job_id", SK.job_skills().alias("skills")), v.related_skills) if "skills" in parts else None
    jobs, keywords = job_side(v, parts, related)
    # written once: the pairs tell which texts are searched at all, and meet both sides
    pairs = materialise(v.pairs, "pairs")
    rows = K.met(v.acknowledged_of(pairs), jobs, resume_side(v, parts, pairs, keywords, related), K.few(v.jobs))
    rows = K.narrowed(rows)
    if "skills" in parts:
        rows = rows.withColumn("tested", K.tested("skills", scopes=("all", "skills"))).withColumn("items", SK.skill_items("tested"))
        rows = rows.withColumn("decisions", v.decided())
    if "scores" in parts:
        rows = S.scored(rows.withColumns({f"{k}_hits": K.tested(k) for k in ("hard", "soft")}), "hard_hits", "soft_hits")
    if "after" in parts:
        rows = K.narrowed(rows, "_after")
        for suffix in ("", "_after"):
            rows = rows.withColumn(f"literals_verified{suffix}", F.array_intersect("job_codes", f"literals_verified{suffix}"))
        rows = rows.withColumns({"present_before": K.present(F.col("hard"), "literals_verified"),
                                 "present_after": F.when(F.col("known_after"), K.present(F.col("hard"), "literals_verified_after"))})
        rows = rows.withColumns({f"terms_{when}": F.transform(f"present_{when}", lambda k: k["keyword"]) for when in ("before", "after")})
    if "scores_after" in parts:
        rows = rows.filter("known_after")
        rows = S.scored(rows.withColumns({f"{k}_hits_after": K.tested(k, "_after") for k in ("hard", "soft")}), "hard_hits_after", "soft_hits_after", "_after")
    if "match" in parts:
        rows = rows.withColumn("match_score", M.match_score())
    if "flags" in parts:
        rows = E.flags_array(rows, domains=True).withColumn("flags", F.when(F.col("r_known") & F.col("j_known"), F.col("flags")))
    return rows
